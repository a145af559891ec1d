import random

import pytest

from papyrion.llm import neardup
from papyrion.llm.text import words

SCHEMA = "package_id long, text string, key string, runs string"


def brute(rows, n, num, den):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None:
            w = words(t)
            own = sets.setdefault(k, set())
            own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    keys = sorted(k for k, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    rows = []
    for k in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary + ["new"])
        half = rng.randint(0, len(own))
        rows += [(k, " ".join(own[:half])), (k, " ".join(own[half:]).upper())]
    return rows + [(500, None), (501, ""), (502, "one two"), (0, rows[0][1]), (None, "a b c d e f")]


@pytest.mark.parametrize("part", [1000, 3])
@pytest.mark.parametrize("seed,n,num", [(1, 3, 7), (2, 5, 8), (3, 2, 5)])
def test_against_brute_force(spark, seed, n, num, part):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in rows], SCHEMA)
    members, links = neardup.similar(df, "package_id", "text", n, num, 10, part_size=part)
    assert {tuple(r) for r in neardup.pairs(members, links).collect()} == brute(rows, n, num, 10)


def test_same_answers_for_blocks_parts_and_fingerprints_of_any_size(spark, monkeypatch):
    rows = corpus(4)
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in rows], SCHEMA)
    for name, value in (("BLOCK_RUNS", 60), ("PART_RUNS", 8), ("FINGERPRINT_BITS", -20), ("CHUNK_CHARS", 40)):
        monkeypatch.setattr(neardup, name, value)
    members, links = neardup.similar(df, "package_id", "text", 3, 7, 10, part_size=3)
    assert {tuple(r) for r in neardup.pairs(members, links).collect()} == brute(rows, 3, 7, 10)
    assert {r.key for r in members.collect()} == {k for k, _ in rows if k is not None}


def test_groups_and_copies(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(i, text) for i in range(40)] + [(100, text + " more"), (200, "quite another text with words of its own")]
    df = spark.createDataFrame(rows, "id long, text string")
    members, links = neardup.similar(df, "id", "text", 3, 7, 10)
    got = {r.key: (r.group, r["class"], r.n_links) for r in neardup.groups(members, links).collect()}
    assert len(got) == 42 and got[200] == (200, 200, 0) and got[100] == (0, 100, 1) and {got[i] for i in range(40)} == {(0, 0, 1)}
    few = {tuple(r) for r in neardup.pairs(members, links, limit=10).collect()}
    assert few == {(0, i) for i in range(1, 40)} | {(0, 100)}
    assert len(neardup.pairs(members, links, limit=10_000).collect()) == 41 * 40 // 2


def test_empty(spark):
    members, links = neardup.similar(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert members.count() == links.count() == neardup.groups(members, links).count() == neardup.pairs(members, links).count() == 0


def test_block_skip_keeps_all_pairs_that_fit():
    entries = sorted((s, a, k, -1) for k, (s, a) in enumerate([(10, 0), (10, 4), (12, 1), (13, 9), (30, 0)]))
    found = {(a, b) for a, b, *_ in neardup._list_pairs(entries, 7, 10, 0)}
    keyed = {k: (s, a) for s, a, k, _ in entries}
    need = neardup.least_common
    assert found == {(a, b) for a in keyed for b in keyed if a < b and min(keyed[a][0], keyed[b][0]) * 10 >= 7 * max(keyed[a][0], keyed[b][0]) and all(keyed[x][0] - keyed[x][1] >= need(keyed[a][0], keyed[b][0], 7, 10) for x in (a, b))}
