import random

from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import split

SCHEMA = "export_id long, rag_markdown string, chunk_size int, overlap_chars int, chunk_count int, key string, piece string"


def check(text, size, overlap):
    found = split.pieces(text, size, overlap)
    size, overlap = split.limits(size, overlap)
    if not text.strip():
        assert found == []
        return found
    assert "".join(text[a + lap : b] for a, b, lap, _ in found) == text
    for (a, b, lap, _), before in zip(found, [None, *found], strict=False):
        assert 0 < b - a <= size
        if before:
            assert lap == min(overlap, before[1] - before[0]) and a == before[1] - lap and b > before[1]
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#|`é𝄞", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_round_trip(text, size, overlap):
    check(text, size, overlap)


def test_boundaries_are_preferred():
    text = "# A\n\n" + "Alpha beats beta. " * 10 + "\n\n# B\n\n" + "Gamma rules delta. " * 10
    found = check(text, 230, 0)
    assert found[0][3] == "section" and text[found[1][0] :].startswith("# B")
    assert check("x" * 1000, 300, 100)[0][3] == "character"
    assert check("word " * 200, 300, 30)[0][3] == "blank"


def test_any_overlap_below_the_size_is_kept():
    text = "Alpha beats beta. " * 40 + "\n\n# B\n\n" + "Gamma rules delta and more. " * 60 + "x" * 700
    for size, overlap in ((300, 200), (400, 150), (800, 400), (1000, 400), (100, 99), (7, 6), (400, 400), (400, 900)):
        found = check(text, size, overlap)
        wanted = min(overlap, size - 1)
        assert len(found) > 1 and all(lap == min(wanted, before[1] - before[0]) for before, (_, _, lap, _) in zip(found, found[1:], strict=False))
        assert overlap * 2 >= size or all(lap == overlap for _, _, lap, _ in found[1:])
        assert found[-1][2] == wanted
        assert all(text[a : a + lap] == text[before[1] - lap : before[1]] for before, (a, _, lap, _) in zip(found, found[1:], strict=False))


def test_cohesion_valley_between_equal_boundaries():
    a, b = "red apple tree fruit garden. ", "steel engine motor wheel gear. "
    text = a * 9 + b * 9
    cut = check(text, len(a) * 12, 0)[0][1]
    assert abs(cut - len(a) * 9) <= len(a)


def brute_sections(text):
    text, out, own, fenced = text.replace("\r\n", "\n"), [], [], False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#"):
            marks = len(line) - len(line.lstrip("#"))
            rest = line[marks:]
            if 1 <= marks <= 6 and rest[:1] in (" ", "\t") and rest.lstrip(" \t")[:1].strip():
                out.append("\n".join(own))
                own = []
        own.append(line)
    out.append("\n".join(own))
    return [s.strip() for s in out if s.strip()]


def test_sections_against_brute_force():
    rng = random.Random(3)
    parts = ["# A", "## B\t", "#", "#x", "####### no", "```", "``` py", "text", "", "\r", "#\tT", " # no", "# "]
    for _ in range(300):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        own = split.read_newlines(text)
        assert [own[a:b] for a, b in split.sections(own)] == brute_sections(text)


def test_tables(spark):
    long = "# H\n" + "x" * 1700
    rows = [(1, long, None, None, 3), (1, long, None, None, 3), (2, None, 100, 10, 1), (3, "", 100, 10, None), (4, "y" * 500, 100, 900, None), (None, long, 10, 1, 1), (5, "# a\r\n" + "z" * 50, 50, 5, 2)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in split.long_sections(df, "export_id", "rag_markdown", "chunk_size").collect()) == [(1, 1), (4, 1), (5, 1)]
    got = split.split(df, "export_id", "rag_markdown", "chunk_size", "overlap_chars", "chunk_count").collect()
    assert {r.key for r in got} == {1, 4, 5} and all(len(r.piece) <= (1600 if r.key == 1 else 100) for r in got)
    assert {(r.pieces, r.stated) for r in got if r.key == 1} == {(3, 3)} and len([r for r in got if r.key == 1]) == 3
    assert split.split(df.limit(0), "export_id", "rag_markdown", "chunk_size", "overlap_chars", "chunk_count").count() == 0
