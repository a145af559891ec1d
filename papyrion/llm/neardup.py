"""Near-duplicate records by exact set similarity, after the set-relation skipping of index and answers.

Each record is the set of its word runs. Counts, taken where a run's hash belongs, order runs from rare to frequent,
alike everywhere; a run that occurs once can't be shared and is counted but never indexed. Index lists hold, by run, the sets that
have it among their first positions, in blocks of equal size sorted by position: within a block the scan stops at the
first position that can no longer reach the threshold, and blocks of unfit size are skipped. Candidate pairs are then
answered from a similar set's answer: each set is compared once with its leader, and what two followers similar to it
share follows from their differences to the leader.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.text import CHUNK_CHARS, Words, arrow, inside, rows_of, run_hashes
from papyrion.runtime import discard, partitions_for, session_of, small, store

#: Common runs asked of the prefixes of a pair; more of them make longer prefixes and fewer false candidates.
COMMON = 4
#: Runs of the records of one block; runs counted in one part of the hash range; bits by which a fingerprint is longer
#: than the number of runs is.
BLOCK_RUNS, PART_RUNS, FINGERPRINT_BITS = 1 << 20, 1 << 22, 8
#: Index lists longer than this are cut into parts that are compared two by two in tasks of their own.
LIST_PART = 1000
#: Copies are written out as pairs where two classes have at most so many pairs; otherwise their members stand in for
#: them: every copy is paired with the first of its class, the firsts with each other.
COPY_PAIRS = 1024


def _flat_runs(texts: list[str], n: int, parse: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each text, and the number of the text each is from."""
    ids, lengths = parse(texts)
    keys = run_hashes(ids, n)
    ok = inside(lengths, n)[: len(keys)]
    own = np.repeat(np.arange(len(texts)), lengths)[: len(keys)]
    return keys[ok], own[ok]


def _gathered(texts: DataFrame) -> DataFrame:
    """Rows of one record within a batch as one row, a text repeated there once: fewer rows to shuffle, and a record
    delivered very often shrinks before it meets itself."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, owner = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            text = batch.column(1).dictionary_encode()
            pairs = owner.astype(np.int64) * (len(text.dictionary) + 1) + text.indices.to_numpy()
            kept = np.unique(pairs, return_index=True)[1]  # by record, each text where it stands first
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(keys)))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.dictionary.take(text.indices.take(pa.array(kept))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["key", "texts"])

    return texts.mapInArrow(gather, "key long, texts array<string>")


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[int], np.ndarray]]:
    """(texts, keys, how many of the texts each key has) of pieces of about ``CHUNK_CHARS`` of a batch of gathered rows; a
    longer text comes alone and whole, and a row's texts may fall into several pieces."""
    keys, lists = batch.column(0).to_pylist(), batch.column(1)
    texts = lists.flatten().to_pylist()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    rows = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy())
    at = 0
    while at < len(texts):
        limit = (ends[at - 1] if at else 0) + CHUNK_CHARS
        stop = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        own = rows[at:stop]
        yield texts[at:stop], keys[own[0] : own[-1] + 1], np.bincount(own - own[0])
        at = stop


def _packed(values: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones: small differences then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


#: A block of records: their keys, sizes and digests; the different runs of all of them, sorted and as differences; and,
#: record by record, which of those runs it has.
BLOCKS = "block long, keys array<long>, sizes array<int>, digests array<binary>, runs binary, index binary"


def _blocks(texts: DataFrame, n: int) -> DataFrame:
    """Every record that has a run, in blocks of about ``BLOCK_RUNS``. A block is named by its first key."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Words()
        done: list[tuple[int, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            keys, sets = zip(*done, strict=True) if done else ((), ())
            done.clear()
            runs, index = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            one = len(keys) > 0
            return arrow({
                "block": (keys[:1], pa.int64()), "keys": ([keys] * one, pa.list_(pa.int64())), "sizes": ([[len(x) for x in sets]] * one, pa.list_(pa.int32())),
                "digests": ([[xxhash.xxh3_128_digest(x.tobytes()) for x in sets]] * one, pa.list_(pa.binary())),
                "runs": ([_packed(np.diff(runs, prepend=np.uint64(0)))] * one, pa.binary()), "index": ([_packed(index.astype(np.uint32))] * one, pa.binary()),
            })

        current, parts, held, total = None, [], 0, 0
        for batch in batches:
            for texts, keys, counts in _chunked(batch):
                found, own = _flat_runs(texts, n, parse)
                ends = np.searchsorted(own, np.cumsum(counts))  # runs of a row's texts stand together
                start = 0
                for key, end in zip(keys, ends.tolist(), strict=True):
                    if key != current:
                        if parts and len(runs := np.unique(np.concatenate(parts))):
                            done.append((current, runs))
                            total += len(runs)
                            if total >= BLOCK_RUNS:
                                yield block()
                                total = 0
                        current, parts, held = key, [], 0
                    parts.append(found[start:end])
                    held += end - start
                    if held > 4_000_000:  # many repeated rows of one record: keep its set only
                        parts = [np.unique(np.concatenate(parts))]
                        held = 0
                    start = end
        if parts and len(runs := np.unique(np.concatenate(parts))):
            done.append((current, runs))
        if done:
            yield block()

    return _gathered(texts).repartition("key").sortWithinPartitions("key").mapInArrow(build, BLOCKS)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(block, keys, sizes, runs, index) of the blocks of a batch, by the names of its columns."""
    for block, keys, sizes, runs, index in zip(*(batch.column(c) for c in ("block", "keys", "sizes", "runs", "index")), strict=True):
        yield block.as_py(), keys.as_py(), sizes.values.to_numpy(), np.cumsum(_unpacked(runs.as_py(), "uint64"), dtype=np.uint64), _unpacked(index.as_py(), "uint32")


def _classes(blocks: DataFrame, total: int) -> DataFrame:
    """``block, replies``: how often each run of a block occurs over all records, as a class that grows with the count;
    0 says for certain once. Runs are counted where their hash belongs: a block sends each part of the hash range the
    fingerprints it has there, sorted and as differences, and gets their classes back in the same order. Nothing is
    held but one part at a time; fingerprints are long enough that hardly two runs share one, and those that do only
    count as more frequent than they are."""
    bits = min(64, max(16, total.bit_length() + FINGERPRINT_BITS))
    part_bits = min(bits - 1, max(0, (total // PART_RUNS).bit_length(), (4 * partitions_for(session_of(blocks)) - 1).bit_length()))
    shift, low = np.uint64(64 - bits), np.uint64((1 << (bits - part_bits)) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _, runs, index in _opened(batch):
                prints, n = runs >> shift, np.bincount(index, minlength=len(runs)).astype(np.uint32)
                part = (prints >> np.uint64(bits - part_bits)).astype(np.int64)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                rows = [(int(part[a]), _packed(np.diff(prints[a:b] & low, prepend=np.uint64(0))), _packed(n[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                p, f, c = zip(*rows, strict=True)
                yield arrow({"part": (p, pa.int64()), "block": ([block] * len(p), pa.int64()), "prints": (f, pa.binary()), "n": (c, pa.binary())})

    def count(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        prints = [np.cumsum(_unpacked(f, "uint64"), dtype=np.uint64) for _, f, _ in rows]
        _, place = np.unique(np.concatenate(prints), return_inverse=True)
        n = np.bincount(place, np.concatenate([_unpacked(c, "uint32") for *_, c in rows]))
        classes = np.minimum(255, np.floor(4 * np.log2(n))).astype(np.uint8)[place]
        cut = np.cumsum([len(f) for f in prints])[:-1]
        replies = [c.tobytes() for c in np.split(classes, cut)]
        return arrow({"block": ([b for b, *_ in rows], pa.int64()), "part": ([part] * len(rows), pa.int64()), "classes": (replies, pa.binary())})

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for part, *row in rows_of(batch):
                if part != current:
                    if rows:
                        yield count(current, rows)
                    current, rows = part, []
                rows.append(tuple(row))
        if rows:
            yield count(current, rows)

    sent = blocks.select("block", "keys", "sizes", "runs", "index").mapInArrow(send, "part long, block long, prints binary, n binary")
    replies = sent.repartition("part").sortWithinPartitions("part").mapInArrow(reply, "block long, part long, classes binary")
    return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "classes"))).alias("replies"))


def _prefixes(blocks: DataFrame, total: int, num: int, den: int, common: int, part_size: int) -> DataFrame:
    """``key, size, first, often, runs``: of each record the runs to be indexed, rare first and alike everywhere, with
    the position ``first`` of their first; only from the ``often``-th on may one have a list of over ``part_size``. Runs
    that occur once come before all others and can't be shared: they are counted, not indexed. Records with too many of
    them to be similar to any are left out."""
    long_class = int(np.floor(4 * np.log2(part_size)))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, keys, sizes, runs, index), replies in zip(_opened(batch), batch.column("replies").to_pylist(), strict=True):
                classes = np.frombuffer(b"".join(r["classes"] for r in replies), np.uint8)[index]
                record = np.repeat(np.arange(len(sizes)), sizes)
                placed = np.argsort((record << 8) | classes, kind="stable")  # equal classes stay in the order of their hashes
                shared = np.bincount(record[classes > 0], minlength=len(sizes))
                often = np.bincount(record[classes >= long_class], minlength=len(sizes))
                ends = np.cumsum(sizes)
                out: list[tuple] = []
                for key, size, both, full, end in zip(keys, sizes.tolist(), shared.tolist(), often.tolist(), ends.tolist(), strict=True):
                    # runs after the prefix are fewer than the least overlap, less what is asked of the prefix
                    n = size - -(-size * num // den) + common - (size - both)
                    if both * den >= num * size and n > 0:
                        out.append((key, size, size - both, both - full, runs[index[placed[end - both : min(end, end - both + n)]]].view(np.int64)))
                k, s, f, o, r = zip(*out, strict=True) if out else ((),) * 5
                yield arrow({"key": (k, pa.int64()), "size": (s, pa.int32()), "first": (f, pa.int32()), "often": (o, pa.int32()), "runs": (list(r), pa.list_(pa.int64()))})

    return blocks.join(_classes(blocks, total), "block").select("block", "keys", "sizes", "runs", "index", "replies").mapInArrow(order, "key long, size int, first int, often int, runs array<long>")


def _records(blocks: DataFrame) -> DataFrame:
    """``key, n, digest`` of each record."""
    each = blocks.select(F.explode(F.arrays_zip("keys", "sizes", "digests")).alias("r"))
    return each.select(F.col("r.keys").alias("key"), F.col("r.sizes").alias("n"), F.col("r.digests").alias("digest"))


def _sets(blocks: DataFrame) -> DataFrame:
    """``key, n, runs`` of each record."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, sizes, runs, index in _opened(batch):
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(runs[index].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), lists], ["key", "n", "runs"])

    return blocks.select("block", "keys", "sizes", "runs", "index").mapInArrow(unpack, "key long, n int, runs array<long>")


def least_common(a: int, b: int, num: int, den: int) -> int:
    """How much two sets of these sizes must share for a similarity of num/den: ceil(num * (a + b) / (num + den))."""
    return -(-num * (a + b) // (num + den))


def _list_pairs(entries: list[tuple[int, int, int, int]], num: int, den: int, before: int) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, size of a, size of b) of the pairs of one index list that can still be similar. Entries: (size, position,
    id, part), sorted; where parts are given, pairs within one part belong to another task, see ``_cut``. ``before`` runs
    may be shared before this one."""
    blocks: list[tuple[int, list[tuple[int, int, int]]]] = []
    for size, at, key, part in entries:
        if not blocks or blocks[-1][0] != size:
            blocks.append((size, []))
        blocks[-1][1].append((at, key, part))
    sizes = [s for s, _ in blocks]
    for i, (size, own) in enumerate(blocks):
        stop = bisect_right(sizes, size * den // num)
        for j in range(i, stop):
            other, theirs = blocks[j]
            need = least_common(size, other, num, den) - before
            for x, (at, key, part) in enumerate(own):
                if size - at < need:
                    break  # positions only grow: the rest of the block is skipped
                last = other - need  # the last position from which the need can be met
                for y in range(x + 1 if j == i else 0, len(theirs)):
                    at2, key2, part2 = theirs[y]
                    if at2 > last:
                        break
                    if part != part2 or part < 0:
                        yield (key, key2, size, other) if key < key2 else (key2, key, other, size)


PAIRS = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32()}


def _list_starts(columns: list[np.ndarray]) -> np.ndarray:
    run, task = columns[:2]
    return np.concatenate([[0], np.flatnonzero((run[1:] != run[:-1]) | (task[1:] != task[:-1])) + 1]) if len(run) else np.zeros(1, np.int64)


def _pairs_of_lists(columns: list[np.ndarray], starts: np.ndarray, num: int, den: int, before: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole lists, which start where ``starts`` says and end with the last of them. Lists of one entry give
    none, lists of two are looked at all together, longer ones block by block."""
    _, _, size, at, key, part = columns
    lengths = np.diff(starts)
    i = starts[:-1][lengths == 2]
    if len(i):
        sa, sb = size[i].astype(np.int64), size[i + 1].astype(np.int64)
        need = -(-num * (sa + sb) // (num + den)) - before
        fits = (sb <= sa * den // num) & (sa - at[i] >= need) & (at[i + 1] <= sb - need) & ((part[i] < 0) | (part[i] != part[i + 1]))
        i = i[fits]
        flip = key[i] > key[i + 1]
        j, k = np.where(flip, i + 1, i), np.where(flip, i, i + 1)
        yield arrow({n: (v, t) for (n, t), v in zip(PAIRS.items(), (key[j], key[k], size[j], size[k]), strict=True)})
    out: list[tuple[int, int, int, int]] = []
    for s, n in zip(starts[:-1][lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        own = slice(s, s + n)
        out.extend(_list_pairs(list(zip(size[own].tolist(), at[own].tolist(), key[own].tolist(), part[own].tolist(), strict=True)), num, den, before))
        if len(out) >= 50_000:
            yield arrow({n: (v, t) for (n, t), v in zip(PAIRS.items(), zip(*out, strict=True), strict=True)})
            out = []
    if out:
        yield arrow({n: (v, t) for (n, t), v in zip(PAIRS.items(), zip(*out, strict=True), strict=True)})


def _cut(entries: DataFrame, part_size: int) -> DataFrame:
    """Adds ``task`` and ``part``: lists longer than ``part_size`` are cut into parts, and every two parts, or one part
    with itself, form a task. In a task of two parts only pairs between them count. Runs that occur too seldom for such
    a list are not counted again."""
    doubtful = entries.where("doubtful")
    counts = doubtful.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_size)
    long_lists = store(counts.select("run", F.ceil(F.col("n") / part_size).cast("int").alias("parts")), "lists")
    n_long = long_lists.count()
    plain = entries.select("run", F.lit(0).alias("task"), "size", "at", "key", F.lit(-1).alias("part"))
    if not n_long:
        return plain
    plain = plain.join(small(long_lists.select("run"), n_long), "run", "left_anti")
    placed = doubtful.join(small(long_lists, n_long), "run").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = (F.least("own", "other") * F.col("parts") + F.greatest("own", "other") + 1).cast("int")
    part = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    return plain.unionByName(tasks.withColumn("task", task).withColumn("part", part).select("run", "task", "size", "at", "key", "part"))


def _candidates(prefixes: DataFrame, num: int, den: int, common: int, part_size: int) -> DataFrame:
    """Pairs ``a, b`` of set ids that share enough of their first positions to be looked at, with how many: ``met``."""
    entries = prefixes.select("key", "size", "first", "often", F.posexplode("runs").alias("i", "run"))
    entries = entries.select("run", "size", (F.col("first") + F.col("i")).alias("at"), "key", (F.col("i") >= F.col("often")).alias("doubtful"))
    lists = _cut(entries, part_size).repartition("run", "task").sortWithinPartitions("run", "task", "size", "at", "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if left is not None:
                columns = [np.concatenate(c) for c in zip(left, columns, strict=True)]
            starts = _list_starts(columns)
            left = [c[starts[-1] :] for c in columns]  # the last list may go on
            yield from _pairs_of_lists([c[: starts[-1]] for c in columns], starts, num, den, common - 1)
        if left is not None:
            yield from _pairs_of_lists(left, np.array([0, len(left[0])]), num, den, common - 1)

    pairs = lists.select("run", "task", "size", "at", "key", "part").mapInArrow(scan, "a long, b long, na int, nb int")
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return met.where(F.col("met") >= F.least(F.lit(common), need)).select("a", "b", "na", "nb", "met")


#: Followers of one leader compared with it in one task.
FOLLOWERS = 5000


def _stars(sets: DataFrame, led: DataFrame, num: int, den: int) -> DataFrame:
    """Each set compared once with its leader: ``a`` (leader)``, b, na, nb, common``, and, where the two are similar, the
    differences ``without`` and ``more``. Every set travels once, to its leader; followers of a leader beyond
    ``FOLLOWERS`` go to tasks of their own, each with a copy of the leader."""
    stars = store(led.where("a = leader").select("leader", F.col("b").alias("id")), "stars")
    sized = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).select("leader", F.ceil(F.col("n") / FOLLOWERS).cast("int").alias("salts"))
    n = stars.count()
    followers = stars.join(small(sized, n), "leader").select("leader", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    roles = followers.unionByName(sized.select("leader", F.col("leader").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    placed = sets.select(F.col("key").alias("id"), "n", "runs").join(small(roles, 2 * n), "id").select("leader", "salt", "id", "n", "runs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, size, whole = None, 0, np.empty(0, np.int64)
        names = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32(), "common": pa.int32(), "without": pa.list_(pa.int64()), "more": pa.list_(pa.int64())}
        for batch in batches:
            leaders, salts, ids, sizes = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for leader, salt, own, n, runs in zip(leaders, salts, ids, sizes, batch.column(4), strict=True):
                runs = np.sort(runs.values.to_numpy())
                if (leader, salt) != head:  # the least id, the leader's own row, comes first
                    head, size, whole = (leader, salt), n, runs
                    continue
                without, more = np.setdiff1d(whole, runs, True), np.setdiff1d(runs, whole, True)
                common = size - len(without)
                if common * den < num * (size + n - common):
                    without = more = without[:0]
                out.append((leader, own, size, n, common, without, more))
            columns = zip(*out, strict=True) if out else ((),) * 7
            yield arrow({k: (list(v), t) for (k, t), v in zip(names.items(), columns, strict=True)})

    schema = "a long, b long, na int, nb int, common int, without array<long>, more array<long>"
    return placed.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "id").mapInArrow(compare, schema)


def _answers(sets: DataFrame, candidates: DataFrame, num: int, den: int) -> DataFrame:
    """Similar pairs ``a, b, common, na, nb`` of the candidates. A set's leader is the first of its candidate partners
    that share at least half as much of its first positions as the best does. Where two followers have proved similar
    to one leader, their answer is derived from their differences to it; others are computed."""
    candidates = store(candidates, "candidates")
    best = candidates.groupBy("b").agg(F.max("met").alias("best"))
    leaders = candidates.join(best, "b").where("2 * met >= best").groupBy("b").agg(F.min("a").alias("leader"))
    led = store(candidates.drop("met").join(leaders, "b"), "led")
    star = store(_stars(sets, led, num, den), "stars")
    alike = F.col("common") * den >= num * (F.col("na") + F.col("nb") - F.col("common"))
    by = star.where(alike).select("a", "b", "na", "without", "more")
    one = by.select(F.col("a").alias("leader"), F.col("b").alias("a"), F.col("na").alias("whole"), F.col("without").alias("w1"), F.col("more").alias("m1"))
    two = by.select(F.col("a").alias("leader"), "b", F.col("without").alias("w2"), F.col("more").alias("m2"))
    rest = led.where("a <> leader").join(by.select(F.col("b").alias("a"), F.col("a").alias("leader1")), "a", "left").join(by.select("b", F.lit(True).alias("led")), "b", "left")
    rest = store(rest.select("a", "b", "na", "nb", "leader", (F.coalesce(F.col("leader1") == F.col("leader"), F.lit(False)) & F.coalesce("led", F.lit(False))).alias("same")), "rest")
    same = rest.where("same").select("a", "b", "na", "nb", "leader").join(one, ["leader", "a"]).join(two, ["leader", "b"])
    missing = F.size("w1") + F.size("w2") - F.size(F.array_intersect("w1", "w2"))
    derived = same.select("a", "b", "na", "nb", (F.col("whole") - missing + F.size(F.array_intersect("m1", "m2"))).alias("common"))
    others = rest.where("not same").select("a", "b", "na", "nb")
    found = star.select("a", "b", "na", "nb", "common").unionByName(derived)
    n = others.count()
    if n:
        ids = others.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        runs = sets.join(small(ids, 2 * n), "key", "left_semi").select("key", "runs")
        left, right = runs.select(F.col("key").alias("a"), F.col("runs").alias("ra")), runs.select(F.col("key").alias("b"), F.col("runs").alias("rb"))
        found = found.unionByName(others.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ra", "rb")).alias("common")))
    return found.where(alike)


def similar(texts: DataFrame, key: str, text: str, n: int = 5, num: int = 8, den: int = 10, common: int = COMMON, part_size: int = LIST_PART) -> tuple[DataFrame, DataFrame]:
    """(members ``key, class``; links ``a, b, common, na, nb`` between classes) of the records whose sets of runs of n
    words have a Jaccard similarity of num/den or more.

    Rows of one ``key`` form one record; runs don't cross rows. Records of equal sets form a class, named by its least
    key, and are linked through it. Null keys are left out, null texts give no runs; a record without any run is a class
    of its own and linked with none; repeated rows count once. An empty table gives empty results, and columns other
    than the two are not looked at. Every record is a member of one class.
    """
    keyed = texts.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null")
    blocks = store(_blocks(keyed.where("text is not null"), n), "sets")
    total = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (s, x) -> s + x)"))).first()[0] or 0
    records = _records(blocks)
    named = records.groupBy("digest", "n").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
    copies = store(records.join(named.where("copies > 1"), ["digest", "n"]).select("key", "class"), "classes")
    extra = copies.where("key <> class").select("key")
    n_extra = extra.count()
    single = (lambda df: df.join(small(extra, n_extra), "key", "left_anti")) if n_extra else (lambda df: df)
    prefixes = store(single(_prefixes(blocks, total, num, den, common, part_size)), "prefixes")
    links = store(_answers(_sets(blocks), _candidates(prefixes, num, den, common, part_size), num, den), "links")
    members = keyed.select("key").distinct().join(copies, "key", "left").select("key", F.coalesce("class", "key").alias("class"))
    return members, links


def pairs(members: DataFrame, links: DataFrame, limit: int = COPY_PAIRS) -> DataFrame:
    """The links as pairs of records ``a < b``. Pairs of copies are written out up to ``limit`` for two classes, which
    is any but a mass of equal copies; beyond it each copy is paired with the first of its class only."""
    copied = store(members.groupBy("class").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copied")
    n = copied.count()
    if not n:
        return links.select("a", "b")
    own = members.join(small(copied, n), "class").select("class", "key", "copies")
    small_classes = own.where(F.col("copies") * F.col("copies") <= limit)
    within = small_classes.select("class", F.col("key").alias("a")).join(small_classes.select("class", F.col("key").alias("b")), "class").where("a < b").select("a", "b")
    star = own.where((F.col("copies") * F.col("copies") > limit) & (F.col("key") != F.col("class"))).select(F.col("class").alias("a"), F.col("key").alias("b"))
    sized = links.select("a", "b")
    for side in ("a", "b"):
        sized = sized.join(small(copied.select(F.col("class").alias(side), F.col("copies").alias(f"n{side}")), n), side, "left")
    sized = sized.select("a", "b", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb")).withColumn("out", F.col("na") * F.col("nb") <= limit)
    wide = sized.where(F.col("out") & (F.col("na") * F.col("nb") > 1))
    for side in ("a", "b"):
        wide = wide.join(own.select(F.col("class").alias(side), F.col("key").alias(f"k{side}")), side, "left").withColumn(f"k{side}", F.coalesce(f"k{side}", side))
    plain = sized.where(~F.col("out") | (F.col("na") * F.col("nb") == 1)).select("a", "b")
    spread = wide.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return plain.unionByName(spread).unionByName(within).unionByName(star)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, group, class, n_links`` of every record: the group is named by its least key, ``n_links`` counts the other
    classes it is linked with; a record like no other is its own group and class. Least labels spread along links until
    none changes; a round's labels are removed once the next are there."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = store(ends, "ends")
    degree = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    labels = store(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("new")), "labels")
    while True:
        old = labels.select("a", F.col("new").alias("label"))
        near = ends.join(old.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        over = old.select(F.col("a").alias("label"), F.col("label").alias("far"))
        # the least of the own, the neighbours' and the label's own label
        new = store(old.join(near, "a").join(over, "label", "left").select("a", F.least("label", "near", F.coalesce("far", "label")).alias("new"), "label"), "labels")
        discard(labels)
        labels = new
        if new.where("new <> label").isEmpty():
            break
    full = members.join(labels.select(F.col("a").alias("class"), F.col("new").alias("label")), "class", "left").join(degree.select(F.col("a").alias("class"), "n_links"), "class", "left")
    return full.select("key", F.coalesce("label", "class").alias("group"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
