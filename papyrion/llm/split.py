"""Splitting oversized texts at natural boundaries, with overlap.

A text is cut into units: sections, within them paragraphs, table rows, sentences, and only then words. Sliding blocks
of words on both sides of each boundary give its lexical cohesion; its depth is how far the similarity falls there
below the peaks around it. Within the window that the size limit leaves, the deepest valley is cut, boundaries of a
higher rank first where they are not too early. Every piece but the first starts with the given end of its predecessor.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.text import arrow, rows_of, worker_words

SIZE, OVERLAP = 1600, 150
#: Words in a block on each side of a boundary, and how much of a window a cut should leave filled at least.
BLOCK_WORDS, FILLED = 40, 0.5
HEADING = re.compile(r"#{1,6}[ \t]+\S")
SECTION, PARAGRAPH, LINE, SENTENCE, BLANK = 5, 4, 3, 2, 1
#: What a rank adds to the depth of a valley (depths lie between 0 and 2).
BONUS = {SECTION: 2.0, PARAGRAPH: 1.2, LINE: 0.8, SENTENCE: 0.6}
SENTENCE_END = re.compile(r"""[.!?…]["'”’»)\]]*\s+|[。！？][”’」』）]*""")


def read_newlines(text: str) -> str:
    return text.replace("\r\n", "\n")


def section_starts(text: str) -> list[int]:
    """Where sections start: at 0 and at each heading line outside code fences."""
    starts, at, fenced = [0], 0, False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and at and HEADING.match(line):
            starts.append(at)
        at += len(line) + 1
    return starts


def sections(text: str) -> list[tuple[int, int]]:
    """Start and end of the sections of a text with LF line ends, without the white space around them; empty ones are
    dropped."""
    starts = [*section_starts(text), len(text)]
    spans = ((a + len(part) - len(part.lstrip()), a + len(part.rstrip())) for a, b in zip(starts, starts[1:], strict=False) for part in (text[a:b],))
    return [(a, b) for a, b in spans if a < b]


def boundaries(text: str) -> dict[int, int]:
    """Offsets at which the text may be cut, each with its rank."""
    found: dict[int, int] = {}
    at, fenced, blank = 0, False, False
    for line in text.split("\n"):
        fence = line.startswith("```")
        if at:
            found[at] = PARAGRAPH if blank and not fenced else LINE
        if not fenced and not fence:
            for m in SENTENCE_END.finditer(line):
                if m.end() < len(line):
                    found[at + m.end()] = SENTENCE
        fenced ^= fence
        blank = not line.strip()
        at += len(line) + 1
    for s in section_starts(text)[1:]:
        found[s] = SECTION
    found.pop(0, None)
    return found


def similarities(text: str, offsets: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """The cosine of the words of the blocks before and after each offset. Words of up to two letters don't count. The
    products of counts are numbers of equal pairs, so many blocks are compared at once."""
    hashes, starts, chars = worker_words().placed(text)
    _, ids = np.unique(hashes, return_inverse=True)
    ids = np.where(chars > 2, ids.astype(np.int32) + 1, 0)
    padded = np.concatenate([np.zeros(block, np.int32), ids, np.zeros(block, np.int32)])
    at = np.searchsorted(starts, np.array(offsets, np.int64)) + block
    around = np.lib.stride_tricks.sliding_window_view(padded, block)
    out: list[float] = []
    for k in range(0, len(at), 128):
        a, b = around[at[k : k + 128] - block], around[at[k : k + 128]]
        pairs = [((x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)).sum(axis=(1, 2)) for x, y in ((a, b), (a, a), (b, b))]
        norm = np.sqrt(pairs[1].astype(np.float64) * pairs[2])
        out += np.divide(pairs[0], norm, out=np.zeros(len(norm)), where=norm > 0).tolist()
    return out


def depths(text: str, offsets: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """How deep a valley of similarity each offset is: the peaks left and right of it above its own similarity."""
    similar = similarities(text, offsets, block)
    n = len(similar)
    left, right = similar[:], similar[:]
    for i in range(1, n):  # climb while the similarity rises
        left[i] = left[i - 1] if similar[i - 1] >= similar[i] else similar[i]
    for i in range(n - 2, -1, -1):
        right[i] = right[i + 1] if similar[i + 1] >= similar[i] else similar[i]
    return [left[i] + right[i] - 2 * similar[i] for i in range(n)]


def blank_end(text: str, low: int, high: int) -> int:
    """The last place after ``low`` and up to ``high`` where white space ends, 0 if there is none."""
    for end in range(high, low, -1):
        if text[end - 1].isspace() and (end == len(text) or not text[end].isspace()):
            return end
    return 0


def limits(size: int | None, overlap: int | None) -> tuple[int, int]:
    """Size and overlap in use: null or less than one means the default; an overlap of the size or more, with which no
    piece would advance, is the size less one."""
    size = SIZE if size is None or size < 1 else size
    overlap = OVERLAP if overlap is None else max(0, overlap)
    return size, min(overlap, size - 1)


def pieces(text: str, size: int | None, overlap: int | None) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap, how) of the pieces: ``text[start:end]`` is at most ``size`` code points, the first
    ``overlap`` of which end the piece before, so that the rest of all pieces together is the text. ``how`` names what
    the end of the piece is: section, paragraph, line, sentence, blank, or character where nothing else is in reach."""
    size, overlap = limits(size, overlap)
    n = len(text)
    if not text.strip():
        return []
    if n <= size:
        return [(0, n, 0, "end")]
    ranks = boundaries(text)
    offsets = sorted(ranks)
    deep = depths(text, offsets)
    names = {SECTION: "section", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence"}
    out, start, lap = [], 0, 0
    while n - start > size:
        # a cut lies after what is repeated, and if possible leaves the next piece enough to repeat
        after = start + max(lap + 1, overlap)
        last, first = start + size, max(after, start + lap + max(1, int((size - lap) * FILLED)))
        i, j = bisect_left(offsets, first), bisect_right(offsets, last)
        blank = 0
        if i == j:  # nothing in the fuller half: anything that leaves enough, or rather a short piece than a cut word
            blank = blank_end(text, start + lap, last)
            i = bisect_left(offsets, after)
            if i >= j and blank < after:
                i = bisect_right(offsets, start + lap)
        if i < j:
            best = max(range(i, j), key=lambda k: (deep[k] + BONUS[ranks[offsets[k]]], offsets[k]))
            end, how = offsets[best], names[ranks[offsets[best]]]
        elif blank:
            end, how = blank, "blank"
        else:
            end, how = last, "character"
        out.append((start, end, lap, how))
        lap = min(overlap, end - start)  # a shorter piece is repeated whole
        start = end - lap
    out.append((start, n, lap, "end"))
    return out


def long_sections(df: DataFrame, key: str, text: str, size: str) -> DataFrame:
    """``key, section_no`` of the sections longer than the row's size (null: the default) in code points.

    They are the sections within which ``pieces`` had to cut, measured once more: a section longer than the size can't
    lie within one piece. No piece is under a size below one, so there every section counts. Null keys and texts give no
    rows; repeated rows count once, which the few rows found tell more cheaply than the texts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, t, s in rows_of(batch):
                t, limit = read_newlines(t), SIZE if s is None else s
                cuts = [b for _, b, _, _ in pieces(t, limit, 0)][:-1]
                for no, (a, b) in enumerate(sections(t), 1):
                    cut = limit < 1 or bisect_left(cuts, b) > bisect_right(cuts, a)
                    if cut and b - a > limit:
                        found.append((k, no))
            yield arrow({"key": ([k for k, _ in found], pa.int64()), "section_no": ([i for _, i in found], pa.int32())})

    return _rows(df, key, text, size).mapInArrow(scan, "key long, section_no int").distinct()


def _rows(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").cast("int").alias(f"m{i}") for i, c in enumerate(more)]).where("key is not null and text is not null")


def split(df: DataFrame, key: str, text: str, size: str, overlap: str, stated: str) -> DataFrame:
    """Pieces of each text: ``key, piece_no, span_start, span_end, overlap, ends_at, piece, pieces, stated``.

    Offsets are code points of the text with CRLF read as LF. Null keys and texts, and texts of white space alone,
    give no rows; rows repeated exactly count once. ``pieces`` is their true number beside the ``stated`` one.
    """
    names = {"key": pa.int64(), "piece_no": pa.int32(), "span_start": pa.int32(), "span_end": pa.int32(), "overlap": pa.int32(), "ends_at": pa.string(), "piece": pa.string(), "pieces": pa.int32(), "stated": pa.int32()}

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return arrow({n: (v, ty) for (n, ty), v in zip(names.items(), zip(*out, strict=True) if out else [()] * len(names), strict=True)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for k, t, s, o, c in rows_of(batch):
                t = read_newlines(t)
                parts = pieces(t, s, o)
                for i, (a, b, lap, how) in enumerate(parts, 1):
                    out.append((k, i, a, b, lap, how, t[a:b], len(parts), c))
                    held += b - a  # wide overlaps repeat a text many times
                    if held > 4_000_000:
                        yield packed(out)
                        out, held = [], 0
            yield packed(out)

    return _rows(df, key, text, size, overlap, stated).distinct().mapInArrow(cut, "key long, piece_no int, span_start int, span_end int, overlap int, ends_at string, piece string, pieces int, stated int")
