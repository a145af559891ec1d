"""Long exact spans shared between records.

A span of ``length`` characters has, among its shorter windows, one of least hash: the same in every record that holds
the span. Merged task sketches overestimate in how many records each such window occurs (count-min prefilter); the
second pass counts and groups only windows estimated repeated, exactly, and compares the text around those that are. None
is lost: an overestimate only lets more hashes through to the exact count, and no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm import sketch as cm
from papyrion.llm.sketch import opened
from papyrion.llm.text import Powers, arrow, chunks, code_points, mixed, prefix_sums, rows_of
from papyrion.runtime import discard, small, store

#: Windows with more occurrences than this are not grouped in one task but matched by distributed aggregation.
HOT_WINDOW = 4096
#: Up to so many members are compared pairwise, more by their texts at each offset.
FEW = 8


def least_windows(texts: list[str], length: int, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Over the concatenated texts: the hash of each window of ``width`` characters, and for each start of a span
    of ``length`` the least of those within it. Starts that run over the end of a text have to be left out."""
    sums = prefix_sums(code_points("".join(texts)), powers)
    hashes = mixed((sums[width:] - sums[:-width]) * powers.down[: len(sums) - width])
    return hashes, _sliding(np.minimum, hashes, length - width + 1)


def _sliding(best: np.ufunc, values: np.ndarray, need: int) -> np.ndarray:
    """The least or greatest of every ``need`` neighbours."""
    reach = 1
    while reach * 2 <= need:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[: len(values) - (need - reach)], values[need - reach :]) if need > reach else values


def _starts(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts, and which span starts lie within one text."""
    sizes = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(change, offsets[:-1], 1)
    np.add.at(change, offsets[:-1] + sizes - length + 1, -1)
    return offsets, np.cumsum(change)[: int(offsets[-1]) - length + 1] > 0


def _runs(least: np.ndarray, valid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each run of equal least hashes within one text."""
    cut = np.ones(len(least) + 1, bool)
    cut[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    cut[offsets[offsets < len(least)]] = True
    at = np.flatnonzero(cut)
    first, last = at[:-1], at[1:] - 1
    keep = valid[first]
    return first[keep], last[keep]


def _stands_for(hashes: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray, rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high): the places of the least windows of each run of span starts, each with the least and the
    greatest distance to the starts it stands for. A window that comes again within reach takes the starts beyond it."""
    padding = np.zeros(rest, np.uint64)
    chosen = np.flatnonzero(_sliding(np.maximum, np.concatenate([padding, least, padding]), rest + 1) == hashes)
    values, rank = np.unique(hashes[chosen], return_inverse=True)
    shift = np.int64(1) << np.int64(33)
    keys = np.sort(rank * shift + chosen)
    place = keys[np.searchsorted(keys, np.searchsorted(values, least[first]) * shift + first)] % shift
    found = [(place, place - np.minimum(last, place), place - first)]
    more: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(last > place).tolist():
        lo, b = int(place[k]) + 1, int(last[k])
        for p in (np.flatnonzero(hashes[lo : b + rest + 1] == least[first[k]]) + lo).tolist():
            hi = min(b, p)
            if hi >= lo:
                more.append((p, p - hi, p - lo))
                lo = hi + 1
            if lo > b:
                break
    if more:
        found.append(tuple(np.array(more, np.int64).T))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


WINDOWS = "w1 long, doc long, at int, low int, high int"
MEMBERS = "w1 long, w2 long, doc long, at int, low int, high int, left_text string, right_text string"


def windows(df: DataFrame, length: int, width: int) -> DataFrame:
    """A row for each window that stands for spans: its hash and place, and for which distances ``low..high`` to a
    span's start it stands for the span. No text travels."""
    rest = length - width

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for rows in chunks(r for r in rows_of(batch) if len(r[-1]) >= length):
                texts = [r[-1] for r in rows]
                hashes, least = least_windows(texts, length, width, powers)
                offsets, valid = _starts(texts, length)
                place, low, high = _stands_for(hashes, least, *_runs(least, valid, offsets), rest)
                own = np.searchsorted(offsets, place - high, "right") - 1
                docs = np.array([r[0] for r in rows], np.int64)
                yield arrow({"w1": (hashes[place].view(np.int64), pa.int64()), "doc": (docs[own], pa.int64()), "at": (place - offsets[own], pa.int32()), "low": (low, pa.int32()), "high": (high, pa.int32())})

    return df.mapInArrow(find, WINDOWS)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Hashes of the windows of a batch, once for each text: a repetition within one is none between two."""
    h, doc = (batch.column(i).to_numpy() for i in range(2))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    if len(h):
        yield h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])].view(np.uint64)


def _repeated(found: DataFrame, n: int) -> DataFrame:
    """The windows that stand in several texts. The merged sketch overestimates and rules out what it has met once;
    what it lets through is counted exactly, by hash, and only then gathered by text."""
    shared = cm.share(found, cm.merged(found.select("w1", "doc"), _hashes, cm.bits_for(n)))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = opened(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(counts.estimate(batch.column(0).to_numpy().view(np.uint64)) >= 2))

    likely = store(found.mapInArrow(estimated, WINDOWS), "likely")
    twice = likely.groupBy("w1").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("w1")
    return likely.join(twice, "w1")


def _members(df: DataFrame, places: DataFrame, length: int, width: int) -> DataFrame:
    """The repeated windows with the text around them that their spans cover."""
    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("w1", "at", "low", "high")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, own in rows_of(batch):
                for x in own:
                    at, low, high = x["at"], x["low"], x["high"]
                    w2 = xxhash.xxh3_64_intdigest(text[at : at + width].encode("utf-32-le", "surrogatepass")) - (1 << 63)
                    out.append((x["w1"], w2, doc, at, low, high, text[at - high : at], text[at + width : at - low + length]))
                if len(out) > 20_000:
                    yield _member_rows(out)
                    out = []
            yield _member_rows(out)

    return df.join(by_doc, "doc").select("doc", "text", "places").mapInArrow(cut, MEMBERS)


def _member_rows(out: list[tuple]) -> pa.RecordBatch:
    w1, w2, doc, at, low, high, left, right = zip(*out, strict=True) if out else ((),) * 8
    return arrow({"w1": (w1, pa.int64()), "w2": (w2, pa.int64()), "doc": (doc, pa.int64()), "at": (at, pa.int32()), "low": (low, pa.int32()), "high": (high, pa.int32()), "left_text": (left, pa.string()), "right_text": (right, pa.string())})


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _matched(group: list[tuple], rest: int) -> Iterator[tuple[int, int, int]]:
    """(doc, start, end offset of starts) of the members of one window that stand in another document as well: the
    least and the greatest distance at which they do. Members: (doc, at, low, high, left, right)."""
    n = len(group)
    found: list[tuple[int, int] | None] = [None] * n

    def note(i: int, low: int, high: int) -> None:
        had = found[i]
        found[i] = (low, high) if had is None else (min(had[0], low), max(had[1], high))

    if n <= FEW:
        for i in range(n):
            for j in range(i):
                a, b = group[i], group[j]
                if a[0] != b[0]:
                    low = max(a[2], b[2], rest - _common(a[5], b[5]))
                    high = min(a[3], b[3], _common(a[4][::-1], b[4][::-1]))
                    if low <= high:
                        note(i, low, high)
                        note(j, low, high)
    else:
        for o in range(rest + 1):
            seen: dict[tuple[str, str], tuple[int, list[int]]] = {}
            for i, (doc, _, low, high, left, right) in enumerate(group):
                if low <= o <= high:
                    key = (left[len(left) - o :], right[: rest - o])
                    entry = seen.get(key)
                    if entry is None:
                        seen[key] = (doc, [i])
                    elif entry[0] is None:
                        note(i, o, o)
                    elif entry[0] == doc:
                        entry[1].append(i)
                    else:
                        for k in (*entry[1], i):
                            note(k, o, o)
                        seen[key] = (None, [])
    for (doc, at, *_), f in zip(group, found, strict=True):
        if f is not None:
            yield doc, at - f[1], at - f[0]


def _group_members(members: DataFrame, length: int, width: int) -> DataFrame:
    rest = length - width

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for w1, w2, *row in rows_of(batch):
                if (w1, w2) != key:
                    if len(group) > 1:
                        out.extend(_matched(group, rest))
                    key, group = (w1, w2), []
                group.append(tuple(row))
            if len(out) > 10_000:
                yield _spans(out, length)
                out = []
        if len(group) > 1:
            out.extend(_matched(group, rest))
        yield _spans(out, length)

    return members.repartition("w1", "w2").sortWithinPartitions("w1", "w2").mapInArrow(match, "doc long, start int, stop int")


def _spans(found: list[tuple[int, int, int]], length: int) -> pa.RecordBatch:
    return arrow({"doc": ([d for d, *_ in found], pa.int64()), "start": ([a for _, a, _ in found], pa.int32()), "stop": ([b + length for *_, b in found], pa.int32())})


def _spread_members(members: DataFrame, length: int, width: int) -> DataFrame:
    """The same for windows with very many occurrences: one row a span, counted before the shuffle, joined by as many
    ``salts`` as the window needs."""
    rest = length - width
    rows = members.select("w1", "w2", "doc", "at", "high", "left_text", "right_text", "salts", F.explode(F.sequence("low", "high")).alias("o")).select(
        "w1", "w2", "o", "doc", "at", "salts", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"),
        F.unhex(F.md5(F.concat_ws("\u0000", F.expr("substring(left_text, high - o + 1, o)"), F.expr(f"substring(right_text, 1, {rest} - o)")))).alias("around"),
    )
    repeated = rows.groupBy("w1", "w2", "o", "around").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("salts").alias("salts")).where("a < b")
    repeated = repeated.select("w1", "w2", "o", "around", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    found = rows.join(repeated, ["w1", "w2", "o", "around", "salt"]).groupBy("doc", "at").agg(F.max("o").alias("high"), F.min("o").alias("low"))
    return found.select("doc", (F.col("at") - F.col("high")).cast("int").alias("start"), (F.col("at") - F.col("low") + length).cast("int").alias("stop"))


def shared_spans(df: DataFrame, doc: str, text: str, length: int = 300, hot: int = HOT_WINDOW) -> DataFrame:
    """Maximal stretches ``doc_id, span_start, span_end`` of each text in which every character lies in a span of at
    least ``length`` code points that stands identically in another document; overlapping and touching spans are one.

    Null ids and null texts are left out, texts shorter than ``length`` have none; rows repeated exactly count once.
    Whole copies need no windows: their text is one stretch, and only one of them goes through the passes.
    """
    width = length // 2
    docs = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    # of copies only the first goes on; the join by digest is split where one text is very often repeated
    digests = store(docs.select("doc", F.length("text").alias("n"), F.unhex(F.md5("text")).alias("digest")), "digests")
    copied = digests.groupBy("digest", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = store(digests.join(copied, ["digest", "n"]).select("doc", "n", "first").distinct(), "copies")
    extra = copies.where("doc <> first").select("doc")
    single = docs.join(small(extra, extra.count()), "doc", "left_anti")

    found = store(windows(single, length, width), "windows")
    members = store(_members(single, _repeated(found, found.count()), length, width), "members")
    discard(found)
    many = members.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("w1", "w2", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    many = store(many, "hot")
    n_many = many.count()
    grouped = _group_members(members.join(small(many, n_many), ["w1", "w2"], "left_anti") if n_many else members, length, width)
    if n_many:
        grouped = grouped.unionByName(_spread_members(members.join(small(many, n_many), ["w1", "w2"]), length, width))
    whole = copies.select("doc", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"))
    return stretches(grouped.unionByName(whole))


def stretches(spans: DataFrame) -> DataFrame:
    """Joins overlapping and touching ``doc, start, stop`` of each document: ``doc_id, span_start, span_end``."""
    by = Window.partitionBy("doc").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("start").alias("span_start"), F.max("stop").alias("span_end")).select(F.col("doc").alias("doc_id"), "span_start", "span_end")


def shares(spans: DataFrame, df: DataFrame, doc: str, text: str) -> DataFrame:
    """For each document ``doc_id, n_chars, shared_chars, share``, those without shared spans included."""
    sizes = df.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("n_chars")).where("doc_id is not null").distinct()
    covered = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    joined = sizes.join(covered, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
