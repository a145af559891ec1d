import random

from papyrion.llm import leakage, queries
from papyrion.llm.text import words

DOCS, ITEMS = "doc_id long, text string, item_id long, kind string", "item_id long, txt string, doc_id long, text string"
ITEM = "Which gauge must the Blex operator of Zorn close before the crate at Flim reaches 161 units, given that Gnur opens late?"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, 1, "c") for k, t in docs], DOCS)
    i = spark.createDataFrame([(k, t, 1, "c") for k, t in items], ITEMS)
    return {(r.doc_id, r.item_id, r.kind): (r.windows, r.first_word) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "txt", **kw).collect()}


def test_whole_part_and_too_short(spark):
    w = words(ITEM)
    docs = [(1, "Intro. " + ITEM.upper()), (2, " ".join(w[3:15])), (3, " ".join(w[3:14])), (4, None), (5, ""), (6, "x " + " - ".join(w[:13]) + " y"), (None, ITEM)]
    got = run(spark, docs, [(7, ITEM), (7, ITEM), (8, None), (9, "too short"), (None, ITEM)])
    assert set(got) == {(1, 7, "verbatim"), (2, 7, "verbatim"), (6, 7, "verbatim")}
    assert got[1, 7, "verbatim"] == (len(w) - 11, 1) and got[2, 7, "verbatim"] == (1, 0)


def test_reworded_consistently_or_not(spark):
    other = ITEM.replace("Zorn", "Quax").replace("Blex", "Tarp").replace("161", "9").replace("Flim", "Osk").replace("Gnur", "Wim")
    mixed = ITEM.replace("Blex", "Same").replace("Zorn", "Same").replace("Flim", "Same").replace("Gnur", "Same")
    got = run(spark, [(1, other), (2, mixed)], [(7, ITEM)])
    assert {k for k in got if k[0] == 1} == {(1, 7, "reparameterised")} and not {k for k in got if k[0] == 2}
    assert run(spark, [(1, other)], [(7, ITEM)], reworded=False) == {}


def test_random_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["the", "of", "crate", "9", "17", "Zorn", "Blex", "kg", "ab3"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 9)))) for i in range(20)]
    docs = [(i, " ".join(rng.choice([*vocabulary, rng.choice(items)[1]]) for _ in range(12))) for i in range(30)]
    runs = lambda t: {tuple(w[i : i + 4]) for w in [words(t)] for i in range(len(w) - 3)}
    expected = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    assert {k[:2] for k in run(spark, docs, items, run=4, reworded=False)} == expected
    for bits in (27, 16, 4):  # full sieves let all through to the join and make every word ordinary
        monkeypatch.setattr(leakage, "MOST_BITS", bits)
        assert {k[:2] for k in run(spark, docs, items, run=4, reworded=False)} == expected
        assert {k[:2] for k in run(spark, docs, items, run=4) if k[2] == "verbatim"} == expected


def test_planted_rewordings_are_found(spark):
    rng = random.Random(8)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(8) for j in range(8)]
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize()
    number = lambda: str(rng.randint(1, 9999))
    items, docs = [], []
    for k in range(60):
        shape = [rng.choice([name, number, None, None]) for _ in range(20)]
        words_of = [rng.choice(plain) for _ in shape]
        fill = lambda: " ".join(s() if s else w for s, w in zip(shape, words_of, strict=True))  # noqa: E731, B023
        items.append((k, fill()))
        docs.append((k, "before it " + fill() + " after it"))
    got = run(spark, docs, items)
    enough = {k for k, t in items if any(sum(w in plain for w in t.split()[i : i + 12]) >= 4 for i in range(9))}
    assert len(enough) > 50 and {k[0] for k in got if k[0] == k[1] and k[2] == "reparameterised"} >= enough


def test_words_used_by_any_item_are_ordinary_in_all(spark):
    # the first item alone would take Blex for a name
    other = ITEM.replace("Zorn", "Quax").replace("Blex", "Tarp").replace("161", "9").replace("Flim", "Osk").replace("Gnur", "Wim")
    alone, both = (run(spark, [(1, other)], items)[1, 7, "reparameterised"] for items in ([(7, ITEM)], [(7, ITEM), (8, "they blex every day")]))
    assert 0 < both[0] < alone[0]


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_found_goes_through_templates_and_slots(spark, monkeypatch, tmp_path):
    other = ITEM.replace("Zorn", "Quax").replace("Blex", "Tarp").replace("161", "9").replace("Flim", "Osk").replace("Gnur", "Wim")
    spark.createDataFrame([(1, "x " + ITEM), (2, other), (3, other + " then " + ITEM)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, ITEM)], "item_id long, txt string").write.parquet(str(tmp_path / "eval_items.parquet"))
    asked, own = [], leakage.consistent
    monkeypatch.setattr(leakage, "consistent", lambda a, b: asked.append((a, b)) or own(a, b))
    assert {tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()} == {(1, 7), (3, 7)} and len(asked) == 1
    assert {(r.doc_id, r.kind) for r in queries.p7_leaks(spark, str(tmp_path)).collect()} == {(1, "verbatim"), (2, "reparameterised"), (3, "verbatim")}


def test_tables_of_numbers_meet_only_themselves(spark):
    # by their template alone all windows of one would meet all of another
    numbers = lambda k: " ".join(str(k * 10_000 + i) for i in range(400))
    docs, items = spark.createDataFrame([(1, numbers(1)), (2, numbers(2))], "id long, text string"), spark.createDataFrame([(7, numbers(1)), (8, numbers(3))], "id long, text string")
    literals = spark.sparkContext.broadcast(leakage.sieve_of(spark.createDataFrame([(1,)], "h long")))
    theirs = leakage.windows(items, 12, literals, None)
    met = leakage.windows(docs, 12, literals, None).alias("d").join(theirs.alias("i"), "key")
    assert theirs.where("not solid").count() == 2 * 389 and met.count() == 389
    got = run(spark, [(1, numbers(1)), (2, numbers(2))], [(7, numbers(1)), (8, numbers(3))])
    assert got == {(1, 7, "verbatim"): (389, 0)}
