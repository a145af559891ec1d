import json

import pytest

from papyrion import options
from papyrion.__main__ import main
from papyrion.sources import remote


def pages(by):
    asked = []

    def fetch(path, params):
        asked.append((path, params))
        return by[path, params.get("startAt", params.get("nextPageToken", 0))]

    return fetch, asked


def test_links_carry_their_own_parameters():
    fetch, asked = pages({("/a", 0): {"results": [{"i": 1}], "_links": {"next": "/a?c=2"}}, ("/a?c=2", 0): {"results": [{"i": 2}], "_links": {}}})
    assert list(remote.linked(fetch, "/a")) == [{"i": 1}, {"i": 2}] and asked == [("/a", {"limit": 250}), ("/a?c=2", {})]
    loop, _ = pages({("/a", 0): {"results": [{"i": 1}], "_links": {"next": "/a"}}})
    assert list(remote.linked(loop, "/a")) == [{"i": 1}]


def test_offsets_end_by_flag_total_or_emptiness():
    for end in ({"isLast": True}, {"total": 3}, {}):
        fetch, asked = pages({("/v", 0): {"values": [1, 2]}, ("/v", 2): {"values": [3], **end}, ("/v", 3): {"values": []}})
        assert list(remote.numbered(fetch, "/v", 2)) == [1, 2, 3] and len(asked) == (2 if end else 3)
    assert list(remote.numbered(lambda p, q: {}, "/v")) == []


def test_tokens():
    fetch, asked = pages({("/s", 0): {"issues": [1], "nextPageToken": "t"}, ("/s", "t"): {"issues": [2], "isLast": True, "nextPageToken": "u"}})
    assert list(remote.continued(fetch, "/s", 500)) == [1, 2] and asked[0][1] == {"maxResults": 100}


def test_saved_collections_as_a_source(spark, tmp_path):
    for name, page in {"a": {"results": [{"k": 1}], "_links": {"next": "/a2"}}, "a2": {"results": [{"k": 2}]}, "b": {"results": []}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    spark.dataSource.register(remote.SavedCollections)
    rows = spark.read.format("saved_collections").option("folder", str(tmp_path)).option("paths", "/a, /b").load()
    assert sorted((r.collection, r.position, r.payload) for r in rows.collect()) == [("/a", 1, '{"k": 1}'), ("/a", 2, '{"k": 2}')]


def test_options(tmp_path, capsys):
    assert options.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    file = tmp_path / "o.json"
    assert options.load(file) == options.DEFAULTS
    options.save(file, {"language": "fr"})
    options.save(file, {"language": "de", "chunks": {"overlap": 0}})
    assert options.load(file)["language"] == "de" and options.load(file)["chunks"] == {"max_characters": 1600, "overlap": 0, "with_heading_path": True}
    assert json.loads((tmp_path / "o.json.bak").read_text()) == {"language": "fr"}
    assert options.assigned({}, ["a.b=3", "a.c=text"]) == {"a": {"b": 3, "c": "text"}}
    with pytest.raises(ValueError):
        options.assigned({}, ["nothing"])
    assert [k for k, _ in options.keys(options.DEFAULTS)][:2] == ["chunks.max_characters", "chunks.overlap"]
    assert main(["options", str(file), "language=es"]) == 0 and "language = es" in capsys.readouterr().out
    assert main(["list"]) == 0 and "chunks_documents" in capsys.readouterr().out and main([]) == 2
