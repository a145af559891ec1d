"""Collections that a remote hands out page by page, read through a function that fetches one page. The function is the
only thing that knows a network; saved pages in a folder read alike, so that a crawl can be repeated offline.

A crawl of one collection is sequential by nature, since a page names the next: it is one task of a DataSource, and
collections are read side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[str, dict], dict]
# Under which names pages carry their rows.
ROWS = ("results", "values", "issues", "comments", "projects", "issueTypes")


def rows_of_page(page: dict) -> list:
    return next((page[name] for name in ROWS if isinstance(page.get(name), list)), [])


def linked(fetch: Fetch, path: str, limit: int = 250) -> Iterator[dict]:
    """Rows of a collection whose pages link to the next; the limit goes with the first request only, as the link has it."""
    params: dict = {"limit": limit}
    seen: set[str] = set()
    while path and path not in seen:
        seen.add(path)
        page = fetch(path, params)
        yield from rows_of_page(page)
        path, params = (page.get("_links") or {}).get("next") or "", {}


def numbered(fetch: Fetch, path: str, size: int = 100) -> Iterator[dict]:
    """Rows of a collection read by offset: until a page says it is the last, is empty, or the total is reached."""
    start = 0
    while True:
        page = fetch(path, {"startAt": start, "maxResults": size})
        rows = rows_of_page(page)
        yield from rows
        start += len(rows)
        total = page.get("total")
        if not rows or page.get("isLast") is True or (isinstance(total, int) and start >= total):
            return


def continued(fetch: Fetch, path: str, size: int = 50) -> Iterator[dict]:
    """Rows of a search whose pages hand out a token for the next one."""
    token: str | None = ""
    while token is not None:
        page = fetch(path, {"maxResults": max(1, min(100, size))} | ({"nextPageToken": token} if token else {}))
        yield from rows_of_page(page)
        token = None if page.get("isLast") is True else page.get("nextPageToken") or None


READS = {"linked": linked, "numbered": numbered, "continued": continued}


def saved(folder: str) -> Fetch:
    """Fetches pages saved in a folder: ``path`` and its parameters as one file name."""

    def fetch(path: str, params: dict) -> dict:
        name = path.strip("/").replace("/", "_") + "".join(f",{k}={v}" for k, v in sorted(params.items()) if k not in ("limit", "maxResults"))
        return json.loads((Path(folder) / f"{name}.json").read_text(encoding="utf-8"))

    return fetch


class SavedCollections(DataSource):
    """``spark.read.format("saved_collections").option("folder", …).option("reads", "linked").load()`` reads the collections
    named by ``paths`` (comma-separated): a row ``collection, position, payload`` for each member, a task a collection."""

    @classmethod
    def name(cls) -> str:
        return "saved_collections"

    def schema(self) -> str:
        return "collection string, position int, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.strip()) for p in self.options.get("paths", "").split(",") if p.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = READS[self.options.get("reads", "linked")](saved(self.options["folder"]), partition.value)
        for i, row in enumerate(rows, 1):
            yield partition.value, i, json.dumps(row, ensure_ascii=False, sort_keys=True)
