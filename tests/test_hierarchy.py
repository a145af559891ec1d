import random

import pytest
from pyspark.sql import functions as F

from papyrion.operators import hierarchy


def brute(parents):
    out = {}
    for v in parents:
        seen, at = [], v
        while True:
            if at in seen:
                loop = seen[seen.index(at) :]
                out[v] = (min(loop, key=lambda x: (len(x), x)), -1)
                break
            seen.append(at)
            p = parents[at]
            if p is None or p not in parents:
                out[v] = (at, len(seen) - 1)
                break
            at = p
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id string, parent_id string, version_no int, node string, root string, path string")
    return hierarchy.hierarchy(df, "page_id", "parent_id", "version_no")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    parents = {str(i): rng.choice([None, str(rng.randint(1, 60)), str(max(1, i - 1)), "999"]) for i in range(1, 61)}
    tree = run(spark, [(k, v, 1, "x", "y", "z") for k, v in parents.items()])
    got = {r.node: (r.root, r.depth) for r in tree.collect()}
    assert got == brute(parents)


def test_long_chain_and_descendants(spark):
    n = 45
    tree = run(spark, [(str(i), str(i - 1) if i > 1 else None, 1, None, None, None) for i in range(1, n + 1)])
    assert max(r.depth for r in tree.collect()) == n - 1
    assert hierarchy.descendants(tree).count() == n * (n + 1) // 2
    assert {r.node: r.n_descendants for r in hierarchy.with_counts(tree).collect()}["1"] == n - 1


def test_rounds_grow_with_the_logarithm_of_the_levels(spark, monkeypatch):
    rounds = []
    full = hierarchy.store_counted
    monkeypatch.setattr(hierarchy, "store_counted", lambda *a, **k: rounds.append(a[1]) or full(*a, **k))
    rows = [(str(i), str(i - 1) if i > 1 else None, 1, None, None, None) for i in range(1, 121)] + [("900", "901", 1, None, None, None), ("901", "900", 1, None, None, None)]
    assert max(r.depth for r in run(spark, rows).collect()) == 119
    assert rounds.count("levels") <= 9 and rounds.count("loops") <= 4


def test_without_paths(spark):
    df = spark.createDataFrame([("1", None), ("2", "1"), ("3", "2"), ("8", "9"), ("9", "8")], "id string, up string")
    tree = hierarchy.hierarchy(df, "id", "up", paths=False).collect()
    assert {(r.node, r.root, r.depth, r.path) for r in tree} == {("1", "1", 0, None), ("2", "1", 1, None), ("3", "1", 2, None), ("8", "8", -1, None), ("9", "8", -1, None)}


def test_spellings_versions_and_nulls(spark):
    rows = [("1", None, 1), ("2", " 1", 1), ("3", "1.0", 1), ("4", "1 ", 2), ("4", "77", 1), ("5", "0", 1), ("6", "", 1), (None, "1", 1), ("7", "7", 1), ("2", " 1", 1)]
    tree = run(spark, [(a, b, c, None, None, None) for a, b, c in rows])
    assert {r.node: (r.root, r.depth) for r in tree.collect()} == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 1), "4": ("1", 1), "5": ("5", 0), "6": ("6", 0), "7": ("7", -1)}
    assert [tuple(r) for r in hierarchy.loops(tree).collect()] == [("7", 1)]


def test_empty_and_only_loops(spark):
    assert run(spark, []).count() == 0
    tree = run(spark, [("1", "2", 1, None, None, None), ("2", "1", 1, None, None, None), ("3", "1", 1, None, None, None)])
    assert {(r.node, r.root, r.depth) for r in tree.collect()} == {("1", "1", -1), ("2", "1", -1), ("3", "1", -1)}
    assert tree.where(F.col("path").isNotNull()).count() == 0
