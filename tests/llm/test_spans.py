import random

import pytest

from papyrion.llm import spans

SCHEMA = "doc_id long, text string, doc string, start int, stop int"


def brute(texts, length):
    owners = {}
    for k, t in texts:
        for i in range(len(t) - length + 1):
            owners.setdefault(t[i : i + length], set()).add(k)
    out = set()
    for k, t in texts:
        own = None
        for i in range(len(t) - length + 1):
            if len(owners[t[i : i + length]]) > 1:
                if own and i <= own[1]:
                    own[1] = i + length
                else:
                    if own:
                        out.add((k, *own))
                    own = [i, i + length]
        if own:
            out.add((k, *own))
    return out


def corpus(seed, n=24, length=40):
    """Texts of few letters that share, repeat and overlap pieces, with exact copies and spans at the ends."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefgh 𝄞é") for _ in range(k))
    pool = [noise(rng.randint(length - 3, 3 * length)) for _ in range(6)]
    texts = []
    for _ in range(n):
        texts.append("".join(rng.choice([noise(rng.randint(0, 60)), rng.choice(pool), rng.choice(pool)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 6))))
    texts += [texts[0], texts[0], pool[0], "", "short", "a" * 3 * length, "a" * 2 * length, "ab" * 2 * length]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in texts] + [(99, None, None, None, None), (None, texts[0][1], "y", 0, 0)], SCHEMA)
    got = {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 40, hot=hot).collect()}
    assert got == brute(texts, 40)


def test_a_full_sketch_changes_nothing_and_moves_no_text(spark, monkeypatch):
    texts = corpus(4)
    full = spans.cm.merged

    def loose(*given):
        sketch = full(*given)
        sketch.cells[:] = sketch.most  # as if every cell were full
        return sketch

    df = spark.createDataFrame(texts, "doc_id long, text string")
    docs = df.selectExpr("doc_id AS doc", "text").where("length(text) >= 40")
    members = lambda: spans._members(docs, spans._repeated(spans.windows(docs, 40, 20), 100), 40, 20)
    before = sorted(tuple(r) for r in members().collect())
    monkeypatch.setattr(spans.cm, "merged", loose)
    assert sorted(tuple(r) for r in members().collect()) == before
    assert {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 40).collect()} == brute(texts, 40)


def test_many_members_of_one_window(spark):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdef") for _ in range(60))
    texts = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) + word + rng.choice(["", "q", "qq"])) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", 50).collect()} == brute(texts, 50)


def test_empty_and_shares(spark):
    df = spark.createDataFrame([(1, "k" * 50 + "z"), (2, "k" * 50), (3, None), (4, "")], "doc_id long, text string")
    assert spans.shared_spans(df.limit(0), "doc_id", "text", 40).count() == 0
    found = spans.shared_spans(df, "doc_id", "text", 40)
    assert {r.doc_id: (r.n_chars, r.shared_chars) for r in spans.shares(found, df, "doc_id", "text").collect()} == {1: (51, 50), 2: (50, 50), 3: (0, 0), 4: (0, 0)}
