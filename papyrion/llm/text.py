"""Words, batches and hashes shared by the text operators. A word is a maximal run of letters and digits, lower case."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Characters handled at a time by the array code, so that memory doesn't follow the size of a batch.
CHUNK_CHARS = 1_000_000

_ODD = np.random.Generator(np.random.PCG64(20240117)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> list[str]:
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown as needed by each worker."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.multiply.accumulate(np.full(size - 1, self.BASE, np.uint64))])
            self.down = np.concatenate([one, np.multiply.accumulate(np.full(size - 1, pow(self.BASE, -1, 1 << 64), np.uint64))])
        return self.up[:n], self.down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_sums(codes: np.ndarray, powers: Powers) -> np.ndarray:
    """Sums s of the characters' hashes times rising powers: (s[b] - s[a]) / BASE^a depends on the characters from a to
    b alone, whatever stands before them."""
    values = codes.astype(np.uint64)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    up, _ = powers.to(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    values *= up[1:]
    np.cumsum(values, out=sums[1:])
    return sums


class Words:
    """The words of many texts at once, by array operations: the 64-bit hash of each, and how many each text has. Gives
    a word the same hash wherever it stands; equal to ``words`` for every character."""

    #: Characters whose lower case depends on their neighbours or is longer: texts with them are read word by word.
    SPECIAL = re.compile("[\u0130\u03a3]")

    def __init__(self):
        self.powers = Powers()
        low = [chr(c).lower() for c in range(0x10000)]
        self.member = np.array([chr(c).isalnum() for c in range(0x10000)])
        self.lower = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)
        self.digit = np.array([chr(c).isdigit() for c in range(0x10000)])

    def _tables(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if codes.size and codes.max() > 0xFFFF:
            far, place = np.unique(codes, return_inverse=True)
            chars = [chr(c) for c in far.tolist()]
            return np.array([c.isalnum() for c in chars])[place], np.array([ord(c.lower()) for c in chars], np.uint32)[place]
        return self.member[codes], self.lower[codes]

    def _digits(self, codes: np.ndarray) -> np.ndarray:
        if codes.size and codes.max() > 0xFFFF:
            far, place = np.unique(codes, return_inverse=True)
            return np.array([chr(c).isdigit() for c in far.tolist()])[place]
        return self.digit[codes]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, lengths, _, _ = self.detailed(texts, False)
        return hashes, lengths

    def detailed(self, texts: list[str], digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As a call, and with ``digits`` also how many characters each word has, and how many of them are digits."""
        joined = "\n".join(texts)
        if self.SPECIAL.search(joined):
            lists = [words(t) for t in texts]
            codes = code_points("\n".join(w for x in lists for w in x))
            member, lengths = codes != 10, np.array([len(x) for x in lists], np.int64)
        else:
            member, codes = self._tables(code_points(joined))
            lengths = None
        edges = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = prefix_sums(codes, self.powers)
        hashes = mixed((sums[ends] - sums[starts]) * self.powers.down[starts])
        if lengths is None:
            stops = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
            lengths = np.diff(np.searchsorted(starts, stops), prepend=0)
        if not digits:
            return hashes, lengths, lengths, lengths
        n = np.concatenate([[0], np.cumsum(self._digits(codes))])
        return hashes, lengths, ends - starts, n[ends] - n[starts]


    def placed(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, characters) of the words of one text."""
        if self.SPECIAL.search(text):
            found = [(m.start(), m.group().lower()) for m in WORD.finditer(text)]
            hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for _, w in found], np.uint64)
            return hashes, np.array([at for at, _ in found], np.int64), np.array([len(w) for _, w in found], np.int64)
        member, codes = self._tables(code_points(text))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = prefix_sums(codes, self.powers)
        return mixed((sums[ends] - sums[starts]) * self.powers.down[starts]), starts, ends - starts


@lru_cache(maxsize=1)
def worker_words() -> Words:
    """The ``Words`` of this process: its tables are made once."""
    return Words()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive ids of a flat array: len(ids) - n + 1 values."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        total += ids[j : len(ids) - n + 1 + j] * _ODD[j]
    return mixed(total)


def inside(lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of the runs of n items over concatenated lists of these lengths lie within one list."""
    total = int(lengths.sum())
    if total < n:
        return np.empty(0, bool)
    ok = np.ones(total, bool)
    ends = np.cumsum(lengths)
    for j in range(1, n):
        at = ends - j
        ok[at[(at >= 0) & (at >= ends - lengths)]] = False
    return ok[: total - n + 1]


def chunks(texts: Iterable[tuple], size: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Lists of (…, text) rows of about ``size`` characters; a longer text comes alone and whole."""
    rows, total = [], 0
    for row in texts:
        if rows and total + len(row[-1]) > size:
            yield rows
            rows, total = [], 0
        rows.append(row)
        total += len(row[-1])
    if rows:
        yield rows


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def arrow(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))
