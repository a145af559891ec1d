"""Evaluation passages in a training corpus, by template canonicalisation.

Every word becomes itself, if the evaluation items use it as an ordinary word, or a typed placeholder: number, unit,
code or name. Windows of canonical words are hash-joined with those of the items; the slots behind the placeholders
then tell a verbatim passage (all equal) from a re-parameterised one (another value for each slot, used consistently).
What a word becomes depends on the word alone, so equal passages always meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.text import CHUNK_CHARS, WORD, Words, arrow, chunks, inside, rows_of, run_hashes
from papyrion.runtime import session_of, store

#: Words taken as units of measure: symbols, and units of time (English, French, German, Spanish).
UNITS = (
    "mm cm m km g kg t l ml s min h kb mb gb tb percent "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "seconde secondes heure heures jour jours semaine semaines mois an ans "
    "sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años"
).split()
NUMBER, UNIT, CODE, NAME = (np.uint64(k) for k in (1, 2, 3, 4))
#: Filters of at most so many bits are sent to the workers (16 MB), with so many bits for each value if there is room.
MOST_BITS, BITS_EACH = 27, 16


class Sieve:
    """A set of hashes as a bit array of bounded size: it knows every value put in, and, the fuller it is, others too."""

    def __init__(self, packed: np.ndarray):
        self.cells = np.unpackbits(packed, bitorder="little").view(bool)
        self.bits = int(len(self.cells)).bit_length() - 1

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        low, high = places(hashes, self.bits)
        return self.cells[low] & self.cells[high]


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64), (hashes >> np.uint64(64 - bits)).astype(np.int64)


def sieve_of(hashes: DataFrame) -> np.ndarray:
    """The packed bits of a ``Sieve`` of the column ``h``. Its cells are put together where they belong, a slice in a
    row; the driver gets slices of a bounded total."""
    hashes = store(hashes.select("h").distinct(), "hashes")
    bits = min(MOST_BITS, max(16, (hashes.count() * BITS_EACH).bit_length()))
    slice_bits = 13

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield arrow({"slice": (at >> slice_bits, pa.int32()), "at": (at & ((1 << slice_bits) - 1), pa.int32())})

    slices = hashes.mapInArrow(cells, "slice int, at int").distinct().groupBy("slice").agg(F.collect_set("at").alias("at"))
    full = np.zeros(1 << bits, bool)
    for row in slices.toLocalIterator():
        full[(row["slice"] << slice_bits) + np.array(row["at"], np.int64)] = True
    return np.packbits(full, bitorder="little")


class Canonical:
    """Hashes of words and of their canonical forms, for many texts at once."""

    def __init__(self, literals: Sieve):
        self.parse, self.literals = Words(), literals
        self.units = np.sort(self.parse(UNITS)[0])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, hash of its form, words by text)."""
        ids, lengths, chars, digits = self.parse.detailed(texts)
        unit = self.units[np.minimum(np.searchsorted(self.units, ids), len(self.units) - 1)] == ids
        forms = np.select([unit, self.literals.has(ids), (digits == chars), (digits > 0)], [UNIT, ids, NUMBER, CODE], NAME)
        return ids, forms, lengths


def ordinary_words(text: str) -> list[str]:
    """Words that a text has in lower case, or in a script without case, and no digit in them."""
    return [w for w in WORD.findall(text) if w == w.lower() and not any(map(str.isdigit, w))]


WINDOWS = "key long, id long, at int, exact long, solid boolean, raw array<long>"


def windows(texts: DataFrame, run: int, literals, sieve) -> DataFrame:
    """Windows of ``run`` words of ``id, text``, see ``WINDOWS``: ``key`` the hash of their template, ``exact`` that of the
    words, ``raw`` the words' hashes, which are the values of the slots where there are some; ``solid`` where at least a
    third are no slots. The others have too little of a template to be known reworded, and ``exact`` as their key: long
    tables of numbers meet only themselves. With a ``sieve`` only those whose key it knows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(Sieve(literals.value))
        known = Sieve(sieve.value) if sieve is not None else None
        for batch in batches:
            for rows in chunks(rows_of(batch), CHUNK_CHARS):
                ids, forms, lengths = canonical([t for _, t in rows])
                whole = inside(lengths, run)
                exact = run_hashes(ids, run)
                plain = np.concatenate([[0], np.cumsum(forms > NAME)])
                solid = (plain[run:] - plain[:-run]) * 3 >= run
                keys = np.where(solid, run_hashes(forms, run), exact)
                at = np.flatnonzero(whole if known is None else whole & known.has(keys))
                if not len(at):
                    continue
                starts = np.concatenate([[0], np.cumsum(lengths)])
                own = np.searchsorted(starts, at, "right") - 1
                around = at[:, None] + np.arange(run)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * run, pa.int32()), pa.array(ids[around].reshape(-1).view(np.int64)))
                names = np.array([k for k, _ in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(names[own]), pa.array((at - starts[own]).astype(np.int32)), pa.array(exact[at].view(np.int64)), pa.array(solid[at]), lists], ["key", "id", "at", "exact", "solid", "raw"])

    return texts.mapInArrow(scan, WINDOWS)


def consistent(a: Column, b: Column) -> Column:
    """Whether the words of b are those of a with other slot values: the same value for the same value throughout, and
    no two alike. Words that are no slots are equal already."""
    pairs = F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b")))
    return (F.size(pairs) == F.size(F.array_distinct(a))) & (F.size(pairs) == F.size(F.array_distinct(b)))


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, reworded: bool = True) -> DataFrame:
    """Documents that hold ``run`` or more consecutive words of an item: ``doc_id, item_id, kind, windows, first_word``.

    ``kind`` is ``verbatim``, or, with ``reworded``, ``reparameterised`` where the words are an item's template with
    consistently other slot values; a window that is verbatim from any item is not counted as reworded from another,
    and an item that a document holds verbatim is not reported as reworded there. Either way windows meet by their template
    and are told apart by what stands in its slots.
    ``windows`` counts the matching windows of the document, ``first_word`` is the first one's place. Null ids or texts
    on either side and texts of fewer words match nothing; repeated rows count once; an empty table on either side gives
    no rows, and other columns are not looked at. Ordinary words are taken from all items at once, and windows of both
    sides meet in a join, whatever the number of items: only two bit arrays of bounded size are sent to the workers. A
    fuller one lets more windows through to the join, or takes more words for ordinary, on both sides alike.
    """
    known = items.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("id is not null and text is not null").distinct()
    corpus = docs.select(F.col(f"`{doc}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    context = session_of(docs).sparkContext

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Words()
        for batch in batches:
            for rows in chunks(rows_of(batch), CHUNK_CHARS):
                found = parse(list({w for _, t in rows for w in ordinary_words(t)}))[0]
                yield arrow({"h": (np.unique(found).view(np.int64), pa.int64())})

    literals = context.broadcast(sieve_of(known.mapInArrow(ordinary, "h long")))
    asked = store(windows(known, run, literals, None).dropDuplicates(["key", "id", "exact"]), "items")
    sieve = context.broadcast(sieve_of(asked.select(F.col("key").alias("h"))))
    theirs = asked.select("key", F.col("id").alias("item_id"), F.col("raw").alias("item_raw"))
    met = windows(corpus, run, literals, sieve).join(theirs, "key").withColumn("same", F.col("raw") == F.col("item_raw"))
    like = F.col("same") | (F.col("solid") & consistent(F.col("raw"), F.col("item_raw"))) if reworded else F.col("same")
    hits = met.where(like).select(F.col("id").alias("doc_id"), "item_id", "at", "same")
    if not reworded:
        return _counted(hits.select("doc_id", "item_id", "at", F.lit("verbatim").alias("kind")))
    hits = store(hits, "hits")
    verbatim = hits.where("same")
    other = hits.where("not same").join(verbatim.select("doc_id", "at").distinct(), ["doc_id", "at"], "left_anti").join(verbatim.select("doc_id", "item_id").distinct(), ["doc_id", "item_id"], "left_anti")
    columns = ("doc_id", "item_id", "at")
    return _counted(verbatim.select(*columns, F.lit("verbatim").alias("kind")).unionByName(other.select(*columns, F.lit("reparameterised").alias("kind"))))


def _counted(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id", "item_id", "kind").agg(F.count_distinct("at").cast("int").alias("windows"), F.min("at").alias("first_word"))
