"""Repair of text from scanned pages.

Running headers, footers and page numbers are found by fuzzy repetition of lines at page edges and by the sequence of
their numbers; words broken over lines are joined, and misread characters set right, by the vocabulary of the whole
corpus. Word counts are exact: a sketch of fixed size only says which of them can matter. A document is read whole in one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm import sketch as cm
from papyrion.llm.sketch import Sketch, opened
from papyrion.llm.text import arrow, rows_of
from papyrion.runtime import store

#: Lines that are not blank at each edge of a page among which furniture is looked for.
EDGE_LINES = 3
#: How alike two edge lines are at least to be the same.
ALIKE = 0.86
#: How much two of them may differ in length, and on how many pages a line stands that runs over them in any case.
NEAR, OFTEN = 4, 3
#: A word of more readings than this is read alike for signs of one kind.
MANY_READINGS = 64
#: A word is taken for misread if a reading of it is so many times as frequent, and has been met so often.
RATIO, KNOWN = 4, 4

# What scanners read, and what stood there.
SIGNS = {"0": "o", "1": "li", "|": "li", "!": "il", "5": "s", "6": "bé", "9": "g", "@": "a", "8": "b", "$": "s", "€": "e", "£": "e", "+": "t"}
SHAPES = (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("c", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"))
DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "B": "8", "g": "9", "b": "6"})
LOST = "�"
BREAKS = "-‐­¬"  # hyphen-minus, hyphen, soft hyphen, not sign
ALWAYS = "­¬"
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâçéèêëîïôûùœñáíóú"
PAGE_WORDS = "page|seite|página|pagina|pág|pag|p|s|sheet|blatt|feuille|hoja"
OF_WORDS = "of|von|sur|de|aus"

WORDLIKE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CODE = re.compile(r"[A-Z]{2,5}-\d+|[vV]\d+(?:\.\d+)+")
NUM = r"[\dlIOoSB|!]{1,6}"
PURE = re.compile(rf"^[\[(\-—–\s]*(?:(?:{PAGE_WORDS})[.:]?\s*)?({NUM})(?:\s*(?:/|{OF_WORDS})\s*({NUM}))?[\])\-—–\s.]*$", re.I)
ROMAN = re.compile(r"^[\[(\-—–\s]*([ivxlcIVXLC|1!]{1,8})[\])\-—–\s.]*$")
AFTER = re.compile(rf"^(.*[^\W\d_].*?)(?:\s{{2,}}|\s*[|·]\s*)({NUM})\s*$")
BEFORE = re.compile(rf"^\s*({NUM})(?:\s{{2,}}|\s*[|·]\s*)(.*[^\W\d_].*)$")
GAP = re.compile(r"\s\s|[|·]")  # without one, no number is set apart from a text
BODY_START = re.compile(r"^\s*(?:#|\||[-*+]\s|\d+[.)]\s)")


def key_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Counts:
    """Word frequencies over the corpus: exact for the words ``asked`` named, 0 for others, whose counts decide nothing."""

    def __init__(self):
        self.exact: dict[int, int] = {}
        self.read: dict[str, str | None] = {}

    def __call__(self, word: str) -> int:
        return self.exact.get(key_of(word), 0)


class Asking:
    """Stands in for the counts to find out which of them can matter. A sketch never underestimates: a word it has not
    met has count 0, and where no reading can be frequent enough, none is asked for."""

    def __init__(self, sketch: Sketch):
        self.sketch = sketch
        self.bounds: dict[str, int] = {}
        self.of_token: dict[str, frozenset[str]] = {}

    def bound(self, word: str) -> int:
        n = self.bounds.get(word)
        if n is None:
            if len(self.bounds) > 500_000:
                self.bounds.clear()
            n = self.bounds[word] = int(self.sketch.estimate(np.array([key_of(word)], np.uint64))[0])
        return n

    def prepare(self, words: set[str]) -> None:
        """Looks many words up at once."""
        new = [w for w in words if w not in self.bounds]
        if len(self.bounds) + len(new) > 1_000_000:
            self.bounds.clear()
            new = list(words)
        estimates = self.sketch.estimate(np.fromiter(map(key_of, new), np.uint64, len(new)))
        self.bounds.update(zip(new, estimates.tolist(), strict=True))

    def token(self, token: str) -> frozenset[str]:
        """The words whose counts decide how a token is read, whichever way ``_misread`` goes."""
        found = self.of_token.get(token)
        if found is None:
            if len(self.of_token) > 500_000:
                self.of_token.clear()
            words: set[str] = set()
            for part in re.split(r"(['’\-])", split_token(token)[1]):
                if len(part) > 1:
                    words |= self.word(part)
                    if part[-1] == "!" and part[:-1].isalpha():
                        words |= self.word(part[:-1]) | {part[:-1].lower()}
            found = self.of_token[token] = frozenset(w for w in words if self.bound(w))
        return found

    def word(self, word: str) -> set[str]:
        low = word.lower()
        possible = {r for r in readings(low) if self.bound(r)}
        least = 2 if damaged(low) else KNOWN
        return possible | {low} if any(self.bound(r) >= least for r in possible) else set()


def asked(pages: list[tuple[int, list[str]]], asking: Asking, marks: set[tuple[int, int]]) -> set[int]:
    """Keys of all words whose counts ``repair`` may need for these pages, whose furniture is marked."""
    lines = [text for p, (_, own) in enumerate(pages) for i, text in enumerate(own) if text.strip() and (p, i) not in marks]
    following = [x.split()[0] for x in lines[1:]]
    halves = [(half, rest) for text, rest in zip(lines, following, strict=False) if (half := broken_end(text))]
    tokens = {t for text in lines for t in text.split()} | {t for half, rest in halves for t in (half[0], half[0] + rest)}
    asking.prepare(possible_words(t for t in tokens if t not in asking.of_token) | {w for half, rest in halves for group in ways(half[0], rest) for w in group})
    words: set[str] = set()
    for text, after in zip(lines, [*lines[1:], None], strict=False):
        for token in text.split():
            words |= asking.token(token)
        half = broken_end(text)
        if half and after is not None:
            rest = after.split()[0]
            words |= asking.token(half[0]) | asking.token(half[0] + rest)
            if half[1] not in ALWAYS:
                words |= {w for group in ways(half[0], rest) for w in group if asking.bound(w)}
    return {key_of(w) for w in words}


def possible_words(tokens: Iterable[str]) -> set[str]:
    """The words that tokens may stand for, as they are or misread."""
    found: set[str] = set()
    for token in tokens:
        for part in re.split(r"(['’\-])", split_token(token)[1]):
            if len(part) > 1:
                lows = {part.lower(), part[:-1].lower()} if part[-1] == "!" else {part.lower()}
                found |= lows
                for low in lows:
                    found.update(readings(low))
    return found


def vocabulary_of(text: str) -> list[str]:
    """Words of a page in lower case, but not the halves of words broken at a line's end; with compounds."""
    out: list[str] = []
    skip = False
    for line in text.split("\n"):
        bare = line.rstrip()
        tokens = bare.split()
        broken = bool(bare) and bare[-1] in BREAKS and len(bare) > 1 and bare[-2].isalnum()
        for i, token in enumerate(tokens):
            if (i == 0 and skip) or (broken and i == len(tokens) - 1):
                continue
            low = token.strip(".,;:!?()[]«»\"“”„'’").lower()
            if "-" in low and not CODE.fullmatch(low.upper()):
                out.append(low)
            if "'" in low or "’" in low or "-" in low:
                out += [w for w in WORDLIKE.findall(low.replace("'", " ").replace("’", " "))]
            elif low:
                out.append(low)
        if bare:
            skip = broken
    return out


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    low = text.lower().replace("1", "i").replace("|", "i").replace("!", "i")
    total = 0
    for a, b in zip(low, low[1:] + " ", strict=False):
        total += -values[a] if values.get(b, 0) > values[a] else values[a]
    return total or None


def number(text: str) -> int | None:
    digits = text.translate(DIGITS)
    return int(digits) if digits.isdigit() else None


def skeleton(text: str) -> str:
    """A line without what scanners confuse: signs and shapes become the letters they stand for."""
    low = " ".join(text.lower().split())
    for sign, letters in SIGNS.items():
        low = low.replace(sign, letters[0])
    for shape, letter in SHAPES:
        low = low.replace(shape, letter)
    return low.replace("i", "l")


@dataclass
class Edge:
    page: int  # index in the document
    line: int  # index in the page
    top: bool
    depth: int  # how many other edge lines lie further out
    text: str
    bare: str = ""  # skeleton without page number
    numbers: tuple[int, ...] = ()
    pure: bool = False


def edge_of(page: int, line: int, top: bool, depth: int, text: str) -> Edge:
    e = Edge(page, line, top, depth, text)
    stripped = text.strip()
    if m := PURE.match(stripped):
        n = number(m.group(1))
        e.pure, e.numbers = n is not None, (n,) if n is not None else ()
    if not e.pure and (m := ROMAN.match(stripped)):
        n = roman(m.group(1))
        e.pure, e.numbers = n is not None, (n,) if n is not None else ()
    elif e.pure and (m := ROMAN.match(stripped)):
        e.numbers += (roman(m.group(1)) or -1,)
    if not e.pure:
        parted = GAP.search(stripped) is not None
        if m := parted and AFTER.match(stripped):
            n = number(m.group(2))
            e.bare, e.numbers = skeleton(m.group(1)), (n,) if n is not None else ()
        elif m := parted and BEFORE.match(stripped):
            n = number(m.group(1))
            e.bare, e.numbers = skeleton(m.group(2)), (n,) if n is not None else ()
        else:
            e.bare = skeleton(stripped)
    return e


def furniture(pages: list[tuple[int, list[str]]]) -> set[tuple[int, int]]:
    """(page index, line index) of running headers, footers and page numbers of consecutive pages of one document."""
    edges: list[Edge] = []
    for p, (_, lines) in enumerate(pages):
        full = [i for i, x in enumerate(lines) if x.strip()]
        top, bottom = full[:EDGE_LINES], full[-EDGE_LINES:][::-1]
        edges += [edge_of(p, i, True, d, lines[i]) for d, i in enumerate(top)]
        edges += [edge_of(p, i, False, d, lines[i]) for d, i in enumerate(bottom)]
    offsets: Counter = Counter()
    for e in edges:
        for n in set(e.numbers):
            offsets[(e.top, n - pages[e.page][0])] += 1
    usual = {o for o, n in offsets.items() if n >= 2} | {(True, 0), (False, 0)}
    met: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for top in (True, False):
        for b in {(e.page, e.bare) for e in edges if e.top == top and not e.pure and usable(e)}:
            met[top][b[1]] += 1
    merged = {(top, b): n for top, counts in met.items() for b, n in repeated(counts).items()}

    def runs(e: Edge) -> bool:
        fits = any((e.top, n - pages[e.page][0]) in usual for n in e.numbers)
        if e.pure:
            # marks around a number, or a line of its own at the very edge, say what it is
            return fits or e.depth == 0 or not e.text.strip().isalnum()
        if not usable(e):
            return False
        n = merged.get((e.top, e.bare), 0)
        if fits and n >= 1 and e.bare:
            return True
        first = e.text.strip()[:1]
        return n >= (2 if not first.islower() and len(e.bare) >= 6 else 3)

    found: set[tuple[int, int]] = set()
    titled: dict[bool, set[int]] = {True: set(), False: set()}
    by: dict[tuple[int, bool], list[Edge]] = defaultdict(list)
    for e in edges:
        by[e.page, e.top].append(e)
    for (p, top), own in by.items():
        for e in sorted(own, key=lambda x: x.depth):
            if (p, e.line) in found or not runs(e):
                break
            found.add((p, e.line))
            if not e.pure:
                titled[top].add(p)
    # a header or footer that stands on one page only: this line looks like one, the more readily if most pages have one
    for top in (True, False):
        most = len(pages) >= 3 and len(titled[top]) >= 2 and len(titled[top]) * 2 >= len(pages)
        for p in range(len(pages)):
            if p in titled[top] or not (most or not top or pages[p][0] > 1):
                continue
            for e in sorted(by.get((p, top), []), key=lambda x: x.depth):
                if (p, e.line) not in found:
                    if titlelike(e, pages[p][1], top, 0.85 if most else 0.7):
                        found.add((p, e.line))
                    break
    return found


def usable(e: Edge) -> bool:
    """Whether a line may run over pages: no heading, list item or table row, and not the end of a sentence."""
    text = e.text.strip()
    return not BODY_START.match(text) and text[-1:] not in ".,;:" and any(c.isalpha() for c in text)


def titlelike(e: Edge, lines: list[str], top: bool, width: float) -> bool:
    text = e.text.strip()
    widths = sorted(len(x) for x in lines if x.strip())
    wide = widths[int(len(widths) * 0.8)] if widths else 0
    if not usable(e) or e.pure or text[:1].islower() or text[-1:] in BREAKS or len(text) > width * wide:
        return False
    if re.match(r"^(?:Table|Tabelle|Tableau|Tabla|Figure|Figura|Abbildung|Fig\.)\s*\d", text):
        return False
    beside = lines[e.line + 1] if top and e.line + 1 < len(lines) else lines[e.line - 1] if not top and e.line else ""
    following = beside.strip()
    return not following or following[:1].islower() or text.isupper() or not top


def alike(a: str, b: str) -> bool:
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE


def pairs_of_letters(text: str) -> list[tuple[str, int]]:
    """Neighbouring letters, numbered where they come again, so that sets of them meet as often as the letters do."""
    seen: Counter = Counter()
    out = []
    for pair in zip(text, text[1:], strict=False):
        seen[pair] += 1
        out.append(("".join(pair), seen[pair]))
    return out


def shared_at_least(a: int, b: int) -> int:
    """Pairs of letters that two lines of these lengths share at least if they are alike: of a common part of m letters
    a line's own a - m letters break two pairs each, and the other's b - m one each."""
    m = math.ceil(ALIKE * (a + b) / 2 - 1e-9)
    return 3 * m - a - b - 1


def repeated(counts: Counter) -> dict[str, int]:
    """On how many pages each line stands, it or one like it; counted on only until ``OFTEN``. Each line meets all
    others that share a rare pair of letters, which lines that are alike must (prefix filter)."""
    total = dict(counts)
    pairs = {b: frozenset(pairs_of_letters(b)) for b in counts}
    rank = Counter(x for own in pairs.values() for x in own)
    index: dict[tuple[str, int], list[str]] = defaultdict(list)
    rare: dict[str, list[tuple[str, int]]] = {}
    for b, own in pairs.items():
        least = min((shared_at_least(len(b), n) for n in range(max(1, len(b) - NEAR), len(b) + NEAR + 1)), default=1)
        rare[b] = sorted(own, key=lambda x: (rank[x], x))[: len(own) - max(1, least) + 1]
        for x in rare[b]:
            index[x].append(b)
    for b, n in counts.items():
        seen = {b}
        own = pairs[b]
        for x in rare[b]:
            if n >= OFTEN:
                break
            for other in index[x]:
                if other in seen:
                    continue
                seen.add(other)
                if abs(len(other) - len(b)) <= NEAR and len(own & pairs[other]) >= shared_at_least(len(b), len(other)) and alike(b, other):
                    n += counts[other]
                    if n >= OFTEN:
                        break
        total[b] = n
    return total


def readings(word: str) -> Iterator[str]:
    """What a word in lower case may have been: one shape set right, or all signs, or a lost letter."""
    signs = [i for i, c in enumerate(word) if c in SIGNS]
    if LOST in word:
        at = word.index(LOST)
        for c in LETTERS:
            yield word[:at] + c + word[at + 1 :]
        return
    if signs:
        if math.prod(len(SIGNS[word[i]]) for i in signs) > MANY_READINGS:
            # so many doubtful signs that a scanner reads each kind of them alike throughout
            kinds = sorted({word[i] for i in signs})
            for letters in product(*[SIGNS[c] for c in kinds]):
                yield word.translate(str.maketrans(dict(zip(kinds, letters, strict=True))))
            return
        options = [word]
        for i in signs:
            options = [o[:i] + c + o[i + 1 :] for o in options for c in SIGNS[word[i]]]
        yield from options
        return
    for shape, letter in SHAPES:
        i = word.find(shape)
        while i >= 0:
            yield word[:i] + letter + word[i + len(shape) :]
            i = word.find(shape, i + 1)


def damaged(low: str) -> bool:
    """Whether a word has a lost letter, or signs among its letters."""
    return LOST in low or (any(c in SIGNS for c in low) and any(c.isalpha() for c in low))


def repaired(word: str, counts: Counts) -> str | None:
    """The likeliest reading of a misread word, None if the word stands as it is. Case follows the word."""
    low = word.lower()
    spoilt = damaged(low)
    if not spoilt and (len(low) < 3 or not low.replace("'", "").replace("’", "").isalpha()):
        return None
    own = counts(low)
    best, most = None, 0
    for r in readings(low):
        n = counts(r)
        if n > most:
            best, most = r, n
    if best is None or most < (2 if spoilt else KNOWN) or most < RATIO * own:
        return None
    if word.isupper():
        return best.upper()
    return best[:1].upper() + best[1:] if word[:1].isupper() else best


EDGE_SIGNS = ".,;:?()[]«»\"“”„"


def split_token(token: str) -> tuple[str, str, str]:
    """Punctuation before, the word, punctuation after; signs that scanners read for letters stay with the word."""
    start, end = 0, len(token)
    while start < end and token[start] in EDGE_SIGNS:
        start += 1
    while end > start and token[end - 1] in EDGE_SIGNS:
        end -= 1
    return token[:start], token[start:end], token[end:]


def misread(token: str, counts: Counts) -> str | None:
    """As ``_misread``, remembered: words come again and again."""
    known = counts.read
    if token not in known:
        if len(known) > 500_000:
            known.clear()
        known[token] = _misread(token, counts)
    return known[token]


def _misread(token: str, counts: Counts) -> str | None:
    """A token with its misread characters set right, None if there are none. Codes and numbers stand."""
    before, word, after = split_token(token)
    if not word or CODE.fullmatch(word) or word.isdigit():
        return None
    has_letter = any(c.isalpha() for c in word)
    if not has_letter and LOST not in word:
        return None
    if re.fullmatch(r"[\dlIOSB]+", word) and any(c.isdigit() for c in word):
        fixed = word.translate(DIGITS)
        return before + fixed + after if fixed.isdigit() and fixed != word else None
    parts = re.split(r"(['’\-])", word)
    changed = False
    for i, part in enumerate(parts):
        if len(part) > 1:
            core, tail = part, ""
            if part[-1] == "!" and part[:-1].isalpha() and counts(part[:-1].lower()) >= KNOWN:
                core, tail = part[:-1], "!"
            fixed = repaired(core, counts)
            if fixed is None and (LOST in core or re.search(r"[^\W\d_][@!|$+]|[@!|$+][^\W\d_]", core) or re.search(r"[^\W\d_]\d[^\W\d_]|^\d[^\W\d_]{2,}$|^[^\W\d_]{3,}\d$", core)):
                guess = next(readings(core.lower()), core.lower())
                fixed = guess[:1].upper() + guess[1:] if core[:1].isupper() else guess
            if fixed is not None and fixed != core:
                parts[i], changed = fixed + tail, True
    return before + "".join(parts) + after if changed else None


def broken_end(line: str) -> tuple[str, str] | None:
    """(half word, mark) where a line ends in a mark that may break a word."""
    bare = line.rstrip()
    if len(bare) < 2 or bare[-1] not in BREAKS or not (bare[-2].isalnum() or bare[-2] in SIGNS or bare[-2] == LOST):
        return None
    return bare.split()[-1][:-1], bare[-1]


def first_part(rest: str) -> str:
    return split_token(rest)[1].split("-")[0].split("'")[0].split("’")[0].lower()


def ways(half: str, rest: str) -> tuple[list[str], list[str]]:
    """What a broken word may be without its mark, and with it."""
    a, b = split_token(half)[1].split("-")[-1].split("'")[-1].split("’")[-1].lower(), first_part(rest)
    whole, compound = split_token(half)[1].lower() + "-" + split_token(rest)[1].lower(), a + "-" + b
    return [a + b, *readings(a + b)], [whole, compound, *readings(compound)]


def joins(half: str, mark: str, rest: str, counts: Counts) -> bool:
    """Whether the mark is no part of the word: the word without it is commoner in the corpus than with it."""
    if mark in ALWAYS:
        return True
    b = first_part(rest)
    if not b or not b[:1].isalpha() and b[:1] not in SIGNS and b[:1] != LOST:
        return False
    without, with_mark = ways(half, rest)
    together, apart = max(map(counts, without)), max(map(counts, with_mark))
    if together or apart:
        return together >= apart
    return split_token(rest)[1][:1].islower()


@dataclass
class Line:
    page: int
    line: int
    text: str
    furniture: bool = False
    hyphen: bool = False
    char: bool = False
    fixed: str = ""
    joined: bool = field(default=False)


def repair(pages: list[tuple[int, list[str]]], counts: Counts, marks: set[tuple[int, int]] | None = None) -> list[Line]:
    """All lines of consecutive pages, with their noise and their repaired text; where ``joined``, the next line that
    is no furniture and not blank goes on with the same word."""
    marks = furniture(pages) if marks is None else marks
    lines = [Line(no, i + 1, text, (p, i) in marks) for p, (no, own) in enumerate(pages) for i, text in enumerate(own)]
    body = [x for x in lines if not x.furniture and x.text.strip()]
    carried = ""
    for k, x in enumerate(body):
        tokens = x.text.split()
        half = broken_end(x.text)
        after = body[k + 1] if k + 1 < len(body) else None
        taken = carried
        carried = ""
        fixed: list[str] = []
        for i, token in enumerate(tokens):
            if i == 0 and taken:
                fixed.append(taken)
                continue
            if half and i == len(tokens) - 1 and after is not None:
                rest = after.text.split()[0]
                if joins(half[0], half[1], rest, counts) and not BODY_START.match(after.text):
                    x.hyphen = x.joined = True
                    whole = half[0] + rest
                    right = misread(whole, counts)
                    if right is not None:
                        same = len(right) - len(whole)
                        if right.lower().startswith(half[0].lower()):
                            after.char = True
                        else:
                            x.char = True
                            if same == 0 and right[len(half[0]) :] != rest or not right.lower().endswith(rest.lower()):
                                after.char = after.char or not right.lower().endswith(rest.lower())
                    fixed.append(right or whole)
                    carried = " "
                    continue
                x.joined = True
                token_fixed = misread(half[0], counts)
                x.char = x.char or token_fixed is not None
                fixed.append((token_fixed or half[0]) + "-")
                continue
            right = misread(token, counts)
            if right is not None:
                x.char = True
                fixed.append(right)
            else:
                fixed.append(token)
        x.fixed = " ".join(t for t in fixed if t != " ")
    return lines


def paragraphs(lines: list[Line]) -> list[str]:
    """Continuous paragraphs of repaired lines. A paragraph ends at a blank line, unless a page ends within a sentence;
    headings, list items, tables and captions stay lines of their own."""
    out: list[str] = []
    text, kind, gap, page = "", "", False, None
    within = glue = False  # within a word; and its second half follows the mark
    for x in lines:
        if x.furniture:
            continue
        if not x.text.strip():
            gap = True
            continue
        own = "line" if BODY_START.match(x.text) or re.fullmatch(r"\s*\d+(?:\s{2,}\d+)+\s*", x.text) else "text"
        same = kind == own == "text" and text and (within or not gap or (page != x.page and text[-1:] not in ".!?:" and x.fixed[:1].islower()))
        if same:
            text = text + x.fixed if glue or not x.fixed else f"{text} {x.fixed}"
        else:
            if text:
                out.append(text)
            text = x.fixed
        within, glue = x.joined, x.joined and not x.hyphen
        kind, gap, page = own, False, x.page
    if text:
        out.append(text)
    return out


def _pages(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """A row per page with a text. Repeated rows count once, before they meet."""
    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{page}`").cast("int").alias("page"), F.col(f"`{text}`").alias("text")).where("doc is not null and page is not null and text is not null")
    return rows.groupBy("doc", "page").agg(F.max("text").alias("text"))


def _words(batch: pa.RecordBatch) -> Counter:
    counts: Counter = Counter()
    for (t,) in rows_of(batch):
        counts.update(vocabulary_of(t))
    return counts


def word_sketch(rows: DataFrame) -> Sketch:
    """Upper bounds of the frequencies of all words of the corpus."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if counts := _words(batch):
            yield np.repeat(np.array([key_of(w) for w in counts], np.uint64), np.array(list(counts.values()), np.int64))

    return cm.merged(rows, hashes_of, min(cm.WIDE_BITS, cm.bits_for(chars // 8)), "uint32")


def word_counts(rows: DataFrame) -> DataFrame:
    """``key, n``: exact frequencies of all words of the corpus, by the words' 64-bit keys, added up within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(_words(batch))
            if len(held) > 500_000:
                yield _keyed(held)
                held = Counter()
        yield _keyed(held)

    return rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _keyed(counts: Counter) -> pa.RecordBatch:
    return arrow({"key": (_signed([key_of(w) for w in counts]), pa.int64()), "n": (list(counts.values()), pa.int64())})


def _signed(keys) -> np.ndarray:
    return np.array(list(keys), np.uint64).view(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[str]]], list[tuple[int, int]]]]:
    """Documents one after the other: key, pages in order, and what came along: keys with counts, or -1 where the key is
    a line of furniture. Rows are ``doc, page, text`` and, beside them, ``key, n`` on rows without page, which come first."""
    current, own, exact = None, [], []
    for batch in batches:
        for d, p, t, *more in rows_of(batch):
            if d != current:
                if own:
                    yield current, own, exact
                current, own, exact = d, [], []
            if p is None:
                exact.append((more[0], more[1]))
            else:
                own.append((p, t.split("\n")))
    if own:
        yield current, own, exact


def _documents(df: DataFrame, doc: str, page: str, text: str, schema: str, make) -> DataFrame:
    """What ``make`` gives for each document, whole, with the exact counts of the words it asks for."""
    pages = store(_pages(df, doc, page, text), "pages")
    texts = pages.select("text")
    shared = cm.share(df, word_sketch(texts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = Asking(opened(shared.value))
        for d, own, _ in _whole(batches):
            marks = furniture(own)
            keys = np.concatenate([_signed(asked(own, asking, marks)), np.array([p << 32 | i for p, i in marks], np.int64)])
            yield arrow({"doc": (np.full(len(keys), d, np.int64), pa.int64()), "key": (keys, pa.int64()), "mark": (np.arange(len(keys)) >= len(keys) - len(marks), pa.bool_())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for d, own, exact in _whole(batches):
            marks = {(k >> 32, k & 0xFFFFFFFF) for k, n in exact if n < 0}
            counts.exact = {k & 0xFFFFFFFFFFFFFFFF: n for k, n in exact if n > 0}
            yield from make(d, own, counts, marks)

    wanted = store(pages.repartition("doc").sortWithinPartitions("doc", "page").mapInArrow(ask, "doc long, key long, mark boolean"), "wanted")
    counted = wanted.where("not mark").join(word_counts(texts), "key").select("doc", "key", "n")
    beside = counted.unionByName(wanted.where("mark").select("doc", "key", F.lit(-1).cast("long").alias("n")))
    known = beside.select("doc", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "key", "n")
    rows = pages.select("doc", "page", "text", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n")).unionByName(known)
    return rows.repartition("doc").sortWithinPartitions("doc", F.col("page").asc_nulls_first()).mapInArrow(run, schema)


def noise(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``doc, page, line_no, noise``: furniture, or else hyphen and char, of each line. Null keys and texts give no
    rows, and so do empty texts; rows repeated count once, of different texts of one page the greatest counts."""

    def make(key: int, own: list, counts: Counts, marks: set) -> Iterator[pa.RecordBatch]:
        out = []
        for x in repair(own, counts, marks):
            out += [(x.page, x.line, n) for n, on in (("furniture", x.furniture), ("hyphen", x.hyphen), ("char", x.char)) if on]
        yield arrow({"doc": ([key] * len(out), pa.int64()), "page": ([p for p, *_ in out], pa.int32()), "line_no": ([i for _, i, _ in out], pa.int32()), "noise": ([n for *_, n in out], pa.string())})

    return _documents(df, doc, page, text, "doc long, page int, line_no int, noise string", make)


def readable(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``doc, first_page, paragraph_no, paragraph`` in order, numbered over all pages of the document, the first of which
    is ``first_page``."""

    def make(key: int, own: list, counts: Counts, marks: set) -> Iterator[pa.RecordBatch]:
        found = paragraphs(repair(own, counts, marks))
        n = len(found)
        yield arrow({"doc": ([key] * n, pa.int64()), "first_page": ([own[0][0]] * n, pa.int32()), "paragraph_no": (list(range(1, n + 1)), pa.int32()), "paragraph": (found, pa.string())})

    return _documents(df, doc, page, text, "doc long, first_page int, paragraph_no int, paragraph string", make)
