import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from papyrion.operators import chunks as C

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def model(text, most, overlap):
    """The contract, read line by line."""
    most = max(300, most)
    overlap = max(0, min(overlap, most // 3))
    sections, stack, own = [], [], []
    for line in text.splitlines():
        m = HEADING.match(line)
        if m:
            sections.append(([t for t in stack if t], own))
            stack = (stack + [""] * 6)[: len(m[1]) - 1] + [m[2].strip()]
            own = []
        own.append(line)
    sections.append(([t for t in stack if t], own))
    out = []
    for path, lines in sections:
        body = "\n".join(lines).strip()
        if len(body) <= most:
            out += [(path, body)] if body else []
            continue
        buffer = ""
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", body))):
            joined = f"{buffer}\n\n{p}" if buffer else p
            if len(joined) <= most:
                buffer = joined
            elif buffer:
                out.append((path, buffer))
                buffer = f"{buffer[-overlap:]}\n\n{p}".strip() if overlap else p
            else:
                at = 0
                while True:
                    if part := p[at : at + most].strip():
                        out.append((path, part))
                    if at + most >= len(p):
                        break
                    at += most - overlap
        if buffer:
            out.append((path, buffer))
    return out


def run(spark, texts, most=300, overlap=50):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    got = {}
    for r in sorted(C.chunk(df, "text", ["doc"], most, overlap).collect(), key=lambda r: (r.doc, r.chunk_id)):
        assert r.chunk_id == len(got.get(r.doc, [])) + 1
        got.setdefault(r.doc, []).append((list(r.heading_path), r.content))
    return [got.get(i, []) for i in range(len(texts))]


def test_heading_path_and_embedding(spark):
    df = spark.createDataFrame([(1, "# A\n\nalpha\n\n## B\n\nbeta")], "doc long, text string")
    last = sorted(C.chunk(df, "text", ["doc"], 300, 0).collect(), key=lambda r: r.chunk_id)[-1]
    assert list(last.heading_path) == ["A", "B"] and last.embedding_text.startswith("A > B\n\n")


def test_against_the_model(spark):
    p = "word " * 30
    texts = [
        "", "   \n ", "intro\n# A\n" + "\n\n".join([p] * 5), "# A\n### C\ntext\n## B\n# D\n" + "x" * 1000, "```\n# in a fence\n```\n" + "y" * 700,
        "a" * 299 + "\n\n" + "b" * 301 + "\n\nc", "\r\n".join(["# H", p, "", p, "", p]), "𝄞" * 650, "line one ## not\n####### seven\n#no", "z" * 300, "p\n\n" + "q" * 900 + "\n\nr",
    ]
    for overlap in (0, 50, 100):
        assert run(spark, texts, 300, overlap) == [model(t, 300, overlap) for t in texts]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["# A", "## B", "#### C", "", " ", "word " * 20, "x" * 350, "é" * 120]), max_size=25), min_size=15, max_size=15))
def test_random_texts(spark, pieces):
    texts = ["\n".join(p) for p in pieces]
    assert run(spark, texts) == [model(t, 300, 50) for t in texts]


@pytest.mark.parametrize("text,expected", [("a\nb\n\nc", [(1, 2, "a\nb"), (2, 1, "c")]), ("\n\n a \n\n\n", [(1, 1, "a")]), ("", [])])
def test_paragraphs(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert [tuple(r) for r in C.paragraphs(df, "text", []).collect()] == expected


def test_open_fence_ends_with_text(spark):
    df = spark.createDataFrame([("a\n```py\nx = 1\n```\n```\nopen",)], "text string")
    assert [tuple(r) for r in C.fences(df, "text", []).collect()] == [(1, "py", "x = 1"), (2, "", "open")]
