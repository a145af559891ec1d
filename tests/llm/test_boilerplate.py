import math
import random
from collections import defaultdict

from papyrion.llm import boilerplate

SCHEMA = "package_id long, block_no int, source_url string, kind string, txt string, ingested_at timestamp, host string, blocks string"


def site_pages(n=400):
    rng = random.Random(7)
    nouns = [f"thing{i}" for i in range(60)]
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(6)) for _ in range(400)]
    rows, truth = [], set()
    for p in range(n):
        site = f"site{p % 4}"
        title = f"How {rng.choice(nouns)} meets {rng.choice(nouns)} {p}"
        slug = title.lower().replace(" ", "-")
        sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + f" {rng.choice(nouns)} REF-{rng.randint(1, 9999)}."
        page = [("list", "- [Home](/home)\n- [Docs](/docs)", 0), ("paragraph", f"Home > Other > {title}", 0), ("heading", title, 1)]
        page += [("paragraph", " ".join(sentence() for _ in range(3)), 1) for _ in range(3)]
        page.insert(4, ("paragraph", f"Subscribe to the {site} newsletter today.", 0))
        page += [("code_block", f"set x {rng.randint(1, 99999)}", 1), ("paragraph", "Was this page helpful? [Yes](#y) [No](#n)", 0), ("heading", "Related articles", 0), ("list", "- [A](/a)\n- [B](/b)", 0), ("paragraph", f"© 2024 {site}. All rights reserved.", 0)]
        for b, (kind, text, main) in enumerate(page):
            rows.append((p, b, f"https://www.{site}.example/{slug}/{p}" if p % 9 else None, kind, text))
            if not main:
                truth.add((p, b))
    return rows, truth


def run(spark, rows):
    df = spark.createDataFrame([(*r, None, "c", "c") for r in rows], SCHEMA)
    return boilerplate.judge(boilerplate.pages(df, "package_id", "block_no", "source_url", "kind", "txt", "ingested_at"))


def score(got, truth):
    found = {(r.package_id, r.block_no) for r in got if not r.main and r.package_id < 900}
    return len(found & truth) / len(found | truth)


def test_main_content_is_told_from_the_rest(spark):
    rows, truth = site_pages()
    extra = [(900, 0, None, None, None), (900, 1, None, "paragraph", ""), (None, 1, None, "paragraph", "x"), (901, None, "u", "paragraph", "x"), (902, 0, "not an address", "paragraph", "word " * 5000), *rows[:30]]
    got = run(spark, rows + extra).collect()
    keys = [(r.package_id, r.block_no) for r in got]
    assert len(keys) == len(set(keys)) == len(rows) + 3
    assert score(got, truth) > 0.97
    assert {(r.package_id, r.block_no): r.importance for r in got}[900, 0] == 0.0


def test_without_the_entropies_nothing_is_told(spark, monkeypatch):
    rows, truth = site_pages(120)
    full = boilerplate.importances
    monkeypatch.setattr(boilerplate, "importances", lambda *a: full(*a).withColumn("importance", boilerplate.F.lit(1.0)))
    assert score(run(spark, rows).collect(), truth) < 0.6


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_importances_against_brute_force(spark):
    rng = random.Random(3)
    found = [(p, 0, rng.choice([1, 2, None]) if p % 5 else 1, leaf, rng.randint(1, 3) if leaf % 2 else None, None) for p in range(40) for leaf in rng.sample(range(8), 4)]
    by_page = {p: h for p, _, h, *_ in found}
    found = [(p, b, by_page[p], leaf, c, f) for p, b, _, leaf, c, f in found]
    df = spark.createDataFrame(found, boilerplate.LEAVES)
    hosts = defaultdict(int)
    for h in by_page.values():
        hosts[h] += 1
    got = {(r.leaf, r.host): r.importance for r in boilerplate.importances(df, spark.createDataFrame([(h, n) for h, n in hosts.items() if h], "host long, pages long"), 40).collect()}
    want = {}
    for leaf in range(8):
        own = [(h, c) for _, _, h, k, c, _ in found if k == leaf]
        n, contexts = len(own), defaultdict(int)
        for _, c in own:
            contexts[c] += 1
        presentation = math.exp(-sum(k * math.log(k) for k in contexts.values()) / n) if leaf % 2 else 0.0
        for h in {h for h, _ in own}:
            here = sum(x == h for x, _ in own)
            content = min(1 - math.log(n) / math.log(40), 1 - math.log(here) / math.log(hosts[h]) if h else 1)
            want[leaf, h] = 1 - (1 - content) * (1 - presentation)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaves():
    of = boilerplate.leaves
    assert of("list", "- [Home](/h)\n- [Docs](/d)", "") == [("[]", False), ("[]", False)]
    assert of("paragraph", "Home > Docs > Title 7", "") == [("home", False), ("docs", False), ("title 0", False)]
    assert of("paragraph", "Last changed by Yorka on 4 May", "") == [("last changed by ~ on 0 ~", True)]
    assert of("heading", "Site Review 12", "site") == [("§ review 12", False)]
    assert of("paragraph", None, "") == of("paragraph", " \n ", "x") == []
    assert boilerplate.site_of("https://kb.marl.example/x") == ("kb.marl.example", "marl") and boilerplate.site_of(None) == ("", "")


def test_main_text(spark):
    rows, _ = site_pages(60)
    df = spark.createDataFrame([(*r, None, "c", "c") for r in rows], SCHEMA)
    own = boilerplate.pages(df, "package_id", "block_no", "source_url", "kind", "txt", "ingested_at")
    judged = boilerplate.judge(own)
    got = {r.package_id: r.main_text.split("\n\n") for r in boilerplate.main_text(own, judged).collect()}
    want = defaultdict(list)
    texts = {(p, b): t for p, b, _, _, t in rows}
    for r in sorted(judged.where("main").collect(), key=lambda r: (r.package_id, r.block_no)):
        want[r.package_id].append(texts[r.package_id, r.block_no])
    assert got == dict(want)
