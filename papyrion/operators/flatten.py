"""Deeply nested records to related flat tables.

``merged_schema`` infers, over all records, which fields of which entity are scalars, objects or collections.
``explode_records`` then turns each collection of that schema into rows of a child entity that name their parent and
their ordinal, where the records lie.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.runtime import store

ROOT = "document"
LIST, ONE = "array<object>", "object"

ROWS = "key long, entity string, no int, parent_entity string, parent_no int, ordinal int, up map<string,int>, fields map<string,string>"


@dataclass(frozen=True)
class Form:
    """What is known of a record format before any record is read. ``entities`` names the entity of a collection field
    (any other collection's entity has the field's name); its fields hold collections even where only a lone object is
    met. ``nested_only`` limits a collection to parents whose field has one of the given values, ``sort_maps`` names the
    field by which the values of a collection in map form are ordered, ``root_marks`` the fields that tell a record
    from an envelope around it."""

    entities: dict[str, str] = field(default_factory=dict)
    nested_only: dict[tuple[str, str], tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    sort_maps: str = "file"
    root_marks: tuple[str, ...] = ()


#: The canonical document: blocks within blocks, list items and table cells; assets and their occurrences.
CANONICAL = Form(
    entities={"blocks": "block", "items": "item", "rows": "row", "cells": "cell", "assets": "asset", "display_occurrences": "occurrence"},
    nested_only={("block", "blocks"): ("type", ("blockquote",)), ("block", "items"): ("type", ("list",)), ("block", "rows"): ("type", ("table",))},
    root_marks=("blocks", "schema_version", "assets"),
)


@dataclass(frozen=True)
class Layout:
    """The collections of a merged schema: ``children[entity]`` lists ``(field, child entity)``, ``marks[entity]`` the
    fields by which a lone object is told from a map of them."""

    form: Form
    children: dict[str, list[tuple[str, str]]]
    marks: dict[str, frozenset[str]]


_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:"]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity)')
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def parse_deep(text: str) -> object:
    """``json.loads`` for any depth of nesting: open containers are kept in a list, not on the call stack."""
    end, stack = len(text), []  # (container, key under which the next value goes)
    at, key, result, done = 0, None, None, False
    expect = "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if done and not text[at:].strip(" \t\n\r"):
                return result
            raise ValueError(f"unexpected text at {at} of {end}")
        if done:
            raise ValueError(f"text after the value at {at}")
        token, at = m.group(1), m.end()
        if expect in ("first key", "key") and token == '"':
            key, at = scanstring(text, at, True)
            colon = _TOKEN.match(text, at)
            if colon is None or colon.group(1) != ":":
                raise ValueError(f"no colon at {at}")
            at, expect = colon.end(), "value"
            continue
        if expect in ("value", "first value") and token not in "}],:":
            if token == "{" or token == "[":
                stack.append(({} if token == "{" else [], key))
                key, expect = None, "first key" if token == "{" else "first value"
                continue
            if token == '"':
                value, at = scanstring(text, at, True)
            else:
                value = _WORDS[token] if token in _WORDS else json.loads(token)
        elif stack and token == ("}" if isinstance(stack[-1][0], dict) else "]") and expect in ("first key", "first value", "more"):
            value, key = stack.pop()
        elif stack and token == "," and expect == "more":
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        else:
            raise ValueError(f"unexpected {token!r} before {at}")
        if not stack:
            result, done = value, True
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
        else:
            stack[-1][0].append(value)
        key, expect = None, "more"


def parse(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)


def read_record(text: str | None, root_marks: tuple[str, ...] = CANONICAL.root_marks) -> dict | None:
    """The object in ``text``, which may be encoded any number of times or wrapped in envelopes; None if unreadable.
    Each decoding shortens the text and each envelope is left for what is within it, so both come to an end."""
    value: object = text
    try:
        while isinstance(value, str):
            value = parse(value)
    except ValueError:
        return None
    while isinstance(value, dict) and root_marks and not any(m in value for m in root_marks):
        inner = None
        for v in value.values():
            try:
                v = parse(v) if isinstance(v, str) and v[:1] in ("{", '"') else v
            except ValueError:
                continue
            if isinstance(v, dict) and (any(m in v for m in root_marks) or any(isinstance(x, dict) for x in v.values())):
                inner = v
                break
        if inner is None:
            break
        value = inner
    return value if isinstance(value, dict) else None


def members(value: object, marks: frozenset[str], sort_maps: str = "file") -> list[dict]:
    """The members of a collection given as array, single object or map; nulls and scalars don't count. An object with a
    field that members have is a member itself."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict) and value:
        if any(m in value for m in marks) or not all(isinstance(x, dict) or x is None for x in value.values()):
            return [value]
        named = [(str(v.get(sort_maps) or k), str(k), v) for k, v in value.items() if isinstance(v, dict)]
        return [v for *_, v in sorted(named, key=lambda x: x[:2])]
    return []


def _scalar(v: object) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _flat(value: dict, skip: set[str]) -> dict[str, str | None]:
    """Scalars of ``value`` by dotted name, nested objects at any depth; arrays and empty objects as JSON text."""
    out: dict[str, str | None] = {}
    stack = [("", value)]
    while stack:
        prefix, own = stack.pop()
        below = []
        for k, v in own.items():
            if not prefix and k in skip:
                continue
            if isinstance(v, dict) and v:
                below.append((f"{prefix}{k}.", v))
            else:
                try:
                    out[prefix + k] = _scalar(v)
                except RecursionError:  # an array nested too deep to be written again
                    out[prefix + k] = None
        stack.extend(reversed(below))
    return out


def walk(record: dict, layout: Layout, wanted: frozenset[str] | None, with_fields: bool) -> Iterator[tuple]:
    """Rows of one record, parents first and otherwise in order: (entity, no, parent_entity, parent_no, ordinal, up,
    fields). ``no`` counts each entity through the record, ``up`` maps each enclosing entity to the nearest one's no.
    Keeps its own stack, so that depth is bounded by memory alone."""
    counts: dict[str, int] = {}
    stack: list[tuple[dict, str, str, int, int, dict[str, int]]] = [(record, ROOT, "", 0, 0, {})]
    while stack:
        value, entity, parent, parent_no, ordinal, up = stack.pop()
        no = counts[entity] = counts.get(entity, 0) + 1
        kids = [(f, child) for f, child in layout.children.get(entity, []) if f in value and counted(value, entity, f, layout.form)]
        if wanted is None or entity in wanted:
            yield entity, no, parent, parent_no, ordinal, up, _flat(value, {f for f, _ in kids}) if with_fields else {}
        inside = {**up, entity: no}
        below = []
        for f, child in kids:
            below += [(x, child, entity, no, i, inside) for i, x in enumerate(members(value[f], layout.marks.get(child, frozenset()), layout.form.sort_maps), 1)]
        stack.extend(reversed(below))


def counted(value: dict, entity: str, name: str, form: Form) -> bool:
    """Whether a field of an object holds a collection that counts there."""
    only = form.nested_only.get((entity, name))
    return only is None or value.get(only[0]) in only[1]


def merged_schema(df: DataFrame, payload: str, form: Form = CANONICAL) -> DataFrame:
    """The schema merged over all readable records: ``entity, field, kinds, n``. ``kinds`` lists the JSON kinds met there,
    ``n`` the objects that have the field. A field that holds an array of objects anywhere begins a child entity, in
    which a field of the same name begins the same entity again: recursion folds. Fields of objects within an entity
    have dotted names; where an object's values are all objects, its keys are data and become ``*``. Counted within each
    task first."""

    def kind(v: object) -> str:
        if isinstance(v, list):
            return LIST if any(isinstance(x, dict) for x in v) else "array"
        return {dict: ONE, str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                record = read_record(text, form.root_marks)
                stack = [(record, ROOT, "")] if record is not None else []
                while stack:
                    value, entity, prefix = stack.pop()
                    many = bool(prefix) and len(value) > 1 and all(isinstance(v, dict) for v in value.values())
                    for k, v in value.items():
                        name = prefix + ("*" if many else k)
                        at = (entity, name, kind(v))
                        seen[at] = seen.get(at, 0) + 1
                        child = form.entities.get(k, k)
                        if isinstance(v, list):
                            stack += [(x, child, "") for x in v if isinstance(x, dict)]
                        elif isinstance(v, dict) and k in form.entities:  # a lone object, or a map of them
                            stack += [(x, child, "") for x in members(v, frozenset(), form.sort_maps)]
                        elif isinstance(v, dict):
                            stack.append((v, entity, name + "."))
            if len(seen) > 200_000:
                yield _schema_rows(seen)
                seen = {}
        yield _schema_rows(seen)

    parts = df.select(F.col(f"`{payload}`").alias("payload")).where("payload is not null").mapInArrow(infer, "entity string, field string, kind string, n long")
    return parts.groupBy("entity", "field").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.sum("n").alias("n"))


def _schema_rows(seen: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.string()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], ["entity", "field", "kind", "n"])


def layout_of(schema: DataFrame, form: Form = CANONICAL) -> Layout:
    """The collections of a merged schema. Only what names an entity comes to the driver: one row for each field that
    holds arrays of objects, or is named by the form, and the fields of those entities' members; keys of maps are
    folded already."""
    plain = schema.where(~F.col("field").contains("."))
    kinds = F.split("kinds", r"\|")
    lists = plain.where(F.array_contains(kinds, LIST) | (F.col("field").isin(*form.entities) & F.array_contains(kinds, ONE))).select("entity", "field").collect()
    children: dict[str, list[tuple[str, str]]] = {}
    for entity, name in sorted((r["entity"], r["field"]) for r in lists):
        children.setdefault(entity, []).append((name, form.entities.get(name, name)))
    entities = {child for kids in children.values() for _, child in kids}
    marks: dict[str, set[str]] = {}
    for r in plain.where(F.col("entity").isin(*entities)).select("entity", "field").collect() if entities else []:
        marks.setdefault(r["entity"], set()).add(r["field"])
    return Layout(form, children, {e: frozenset(m) for e, m in marks.items()})


def last_records(df: DataFrame, key: str, payload: str, delivered: str, form: Form = CANONICAL) -> DataFrame:
    """``key, payload``: of each key the readable payload delivered last, of several at one time the greatest. A record
    delivered again and again shrinks to one before it travels, and nothing is flattened before that."""

    def readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([read_record(t, form.root_marks) is not None for t in batch.column(1).to_pylist()], pa.bool_()))

    # where key is null no parent could be named
    source = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{payload}`").alias("payload"), F.col(f"`{delivered}`").cast("timestamp").alias("delivered")).where("key is not null and payload is not null")
    last = F.struct(F.coalesce("delivered", F.lit(0).cast("timestamp")).alias("at"), "payload")
    rows = source.mapInArrow(readable, "key long, payload string, delivered timestamp")
    return rows.groupBy("key").agg(F.max(last).alias("last")).select("key", "last.payload")


def explode_records(df: DataFrame, key: str, payload: str, delivered: str, form: Form = CANONICAL, wanted: tuple[str, ...] | None = None, with_fields: bool = True) -> DataFrame:
    """Rows of all entities of all readable records, see ``ROWS``. The collections are those of the merged schema of the
    records. A record delivered again counts once, and of different records with one key the last delivered counts.
    Null keys, null, empty and unreadable payloads give no rows; other columns are not looked at."""
    want = frozenset(wanted) if wanted is not None else None
    names = ["key", "entity", "no", "parent_entity", "parent_no", "ordinal", "up", "fields"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.int32()), pa.map_(pa.string(), pa.string())]
    records = store(last_records(df, key, payload, delivered, form), "records")
    layout = layout_of(store(merged_schema(records, "payload", form), "schema"), form)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for entity, no, parent, parent_no, ordinal, up, fields in walk(read_record(text, form.root_marks), layout, want, with_fields):
                    for column, v in zip(out, (k, entity, no, parent, parent_no, ordinal, list(up.items()), list(fields.items())), strict=True):
                        column.append(v)
                    if len(out[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                        out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return records.mapInArrow(explode, ROWS)


def entity_table(rows: DataFrame, entity: str, columns: dict[str, str], key: str) -> DataFrame:
    """One flat table: ``key``, ``no``, the parent and ordinal, and ``columns`` (name: dotted field) as text."""
    return rows.where(F.col("entity") == entity).select(F.col("key").alias(key), "no", "parent_entity", "parent_no", "ordinal", *[F.col("fields")[path].alias(name) for name, path in columns.items()])
