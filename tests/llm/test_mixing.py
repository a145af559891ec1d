import pytest

from papyrion.llm import mixing

T, D = "source string, target_share double, max_repeats int, tokens long", "doc_id long, text string, source string, tokens string"


def mix(spark, tokens, targets, **kw):
    t = spark.createDataFrame(tokens, "doc long, source string, tokens long")
    goals = spark.createDataFrame([(*g, 0) for g in targets], T)
    out, report = mixing.mixture(t, goals, "source", "target_share", "max_repeats", **kw)
    return [tuple(r) for r in out.collect()], {r.source: r for r in report.collect()}


@pytest.mark.parametrize("block", [50_000, 37])
def test_shares_caps_and_copies(spark, block):
    tokens = [(i, "a", 10 + i % 90) for i in range(900)] + [(1000 + i, "b", 20) for i in range(60)] + [(5000, None, 9), (5001, "c", 5)]
    rows, report = mix(spark, tokens, [("a", 0.7, 1), ("b", 0.2, 3), ("gone", 0.1, 2)], block_docs=block)
    assert report["a"].reached_share == pytest.approx(0.7 / 0.9, abs=0.01) and report["b"].reached_share == pytest.approx(0.2 / 0.9, abs=0.01)
    assert report["gone"].mixed_tokens == 0 and report["c"].reached_share == 0 and report["c"].target_share == 0 and None in report
    assert report["b"].most_copies <= 3 and report["a"].most_copies <= 1
    by = {}
    for d, _, _, c in rows:
        by.setdefault(d, []).append(c)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by.values())
    copies = report["b"].expected_copies
    assert {len(by.get(1000 + i, [])) for i in range(60)} <= {int(copies), int(copies) + 1}


def test_total_and_repeated_rows(spark):
    tokens = [(i, "a", 10) for i in range(100)] * 2 + [(None, "a", 1)]
    rows, report = mix(spark, tokens, [("A ", 1.0, 5)], total=500)
    assert report["a"].mixed_tokens == 500 and len(rows) == 50 and report["a"].documents == 100


def test_counting_and_spelling(spark):
    df = spark.createDataFrame([(1, "Hello world", " PDF", "x"), (2, None, "pdf", "x"), (3, "", None, "x"), (4, "<|endoftext|>", "", "x")], D)
    got = {r.doc: (r.source, r.tokens) for r in mixing.token_counts(df, "doc_id", "text", "source").collect()}
    assert got[1] == ("pdf", 2) and got[2] == ("pdf", 0) and got[3] == (None, 0) and got[4][0] is None and got[4][1] > 1


def test_nothing(spark):
    rows, report = mix(spark, [], [("a", 1.0, 1)])
    assert rows == [] and report["a"].mixed_tokens == 0
    rows, report = mix(spark, [(1, "a", 0)], [("a", 1.0, 1)])
    assert rows == [] and report["a"].reached_share == 0
