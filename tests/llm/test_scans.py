import random
from collections import Counter

from papyrion.llm import scans

WORDS = "the quarterly report was approved by the second shift and the reviewer compared every template with another interface before a role-based permission was restored".split()


class Known(Counter):
    def __init__(self):
        super().__init__()
        self.read = {}

    def __call__(self, word):
        return self[word]


def counts():
    c = Known()
    for _ in range(20):
        c.update(w for x in WORDS for w in ([x, *x.split("-")] if "-" in x else [x]))
    return c


def body(n):
    """Lines of ordinary words that differ from page to page."""
    plain = [w for w in WORDS if "-" not in w]
    turned = plain[3 * n :] + plain[: 3 * n]
    return [" ".join(turned[:10]), " ".join(turned[10:]) + " before a role-"]


def pages(n=4):
    return [(i, ["Running Title Of Part", "", *body(i), "based permission was restored.", "", f"- {i + 40} -"]) for i in range(1, n + 1)]


def noise(own):
    return {(x.page, x.line, k) for x in scans.repair(own, counts()) for k, on in (("furniture", x.furniture), ("hyphen", x.hyphen), ("char", x.char)) if on}


def test_furniture_only_at_edges_and_compounds_stay():
    assert noise(pages()) == {(i, n, "furniture") for i in range(1, 5) for n in (1, 7)}


def test_misread_header_counts_and_body_numbers_dont():
    own = pages()
    own[2][1][0] = "Runn1ng Title 0f Part"
    own[0][1].insert(3, "96   158   91")
    found = noise(own)
    assert (3, 1, "furniture") in found and (1, 4, "furniture") not in found


def test_misread_headers_of_a_long_document():
    rng = random.Random(5)
    title = "department of measured interfaces"
    line = lambda: "".join(rng.choice("bcdefgkmpqswxyz ") for _ in range(40)).strip() + " end"
    own = []
    for i in range(1, 401):
        own.append((i, [line(), "", *(line() for _ in range(8))]))
    for i, at in ((397, 3), (398, 12), (399, 20)):  # each misread in its own way
        own[i][1][0] = title[:at] + "~" + title[at + 1 :]
    assert {(397, 0), (398, 0), (399, 0)} <= scans.furniture(own)


def test_repeated_lines_against_all_pairs():
    rng = random.Random(11)
    for _ in range(30):
        lines = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 16))) for _ in range(30)]
        for x in list(lines):
            at = rng.randint(0, len(x))
            lines += [x[:at] + rng.choice("abz") + x[at + rng.randint(0, 1) :], x[:at] + x[at + 1 :]]
        counts = Counter(lines)
        brute = {b: n + sum(m for o, m in counts.items() if o != b and abs(len(o) - len(b)) <= 4 and scans.alike(b, o)) for b, n in counts.items()}
        got = scans.repeated(counts)
        assert {b: min(n, 3) for b, n in brute.items()} == {b: min(n, 3) for b, n in got.items()}


def test_words_broken_over_lines_and_pages():
    own = [(1, ["the second inter-", "face was approved by the re-"]), (2, ["viewer and another re¬", "port"])]
    found = noise(own)
    assert {(1, 1, "hyphen"), (1, 2, "hyphen"), (2, 1, "hyphen")} == found
    assert scans.paragraphs(scans.repair(own, counts())) == ["the second interface was approved by the reviewer and another report"]


def test_misread_characters():
    own = [(1, ["thc second sh1ft and tlie rev!ewer", "compared ev�ry templ@te with No. 12, OPS-5601 and v1.2.0", "role-based p", "22l pages was approved."])]
    assert noise(own) == {(1, 1, "char"), (1, 2, "char"), (1, 4, "char")}
    assert scans.paragraphs(scans.repair(own, counts()))[0].startswith("the second shift and the reviewer compared every template with")


def test_tables(spark):
    schema = "package_id long, page_no int, markdown string, doc string, range int, page string"
    text = lambda p: "\n".join(p[1])
    rows = [(7, p[0], text(p)) for p in pages()] * 2 + [(7, 9, None), (None, 1, "x"), (8, 1, ""), (9, None, "x"), (10, 300, "- 300 -"), (10, 255, "tail\n- 255 -"), (10, 256, "head\n- 256 -")]
    df = spark.createDataFrame([(*r, "c", 1, "c") for r in rows], schema)
    got = {tuple(r) for r in scans.noise(df, "package_id", "page_no", "markdown").collect()}
    assert {r[1:] for r in got if r[0] == 7 and r[3] == "furniture"} == {(i, n, "furniture") for i in range(1, 5) for n in (1, 7)}
    assert {r[1:] for r in got if r[0] == 10} == {(300, 1, "furniture"), (255, 2, "furniture"), (256, 2, "furniture")}
    assert {r.doc for r in scans.readable(df, "package_id", "page_no", "markdown").collect()} == {7, 10}
    assert scans.noise(df.limit(0), "package_id", "page_no", "markdown").count() == 0


def test_documents_are_continuous_over_all_pages(spark):
    words = [w for w in WORDS if "-" not in w]
    page = lambda i: " ".join(words[i % 7 :] + words[: i % 7]) + "."
    rows = [(1, i, page(i)) for i in range(200, 260)]
    rows[55] = (1, 255, "the reviewer approved an inter-")
    rows[56] = (1, 256, "face of the second shift")
    rows += [(2, i, "Running Title Of Part\n\n" + page(i)) for i in range(250, 258)]
    df = spark.createDataFrame(rows, "d long, p int, t string")
    got = sorted((r.doc, r.paragraph_no, r.paragraph) for r in scans.readable(df, "d", "p", "t").collect())
    assert [n for d, n, _ in got if d == 1] == list(range(1, 1 + len([1 for d, *_ in got if d == 1])))
    assert any("an interface of the second shift" in t for d, _, t in got if d == 1) and not any(t.startswith("face") for _, _, t in got)
    found = {(r.page, r.line_no) for r in scans.noise(df, "d", "p", "t").where("doc = 2 and noise = 'furniture'").collect()}
    assert {(i, 1) for i in range(250, 258)} <= found


def test_counts_are_exact_however_loose_the_sketch(spark, monkeypatch):
    full = scans.word_sketch
    rows = [(1, 1, "\n".join([" ".join(WORDS)] * 9 + ["thc second sh1ft and tlie rev!ewer was an inter-", "face once."])), (2, 1, "of the word0x and a role-\nbased permission")]
    df = spark.createDataFrame(rows, "d long, p int, t string")
    want = sorted(map(tuple, scans.noise(df, "d", "p", "t").collect()))

    def loose(texts):
        sketch = full(texts)
        sketch.cells[:] = 1000  # as if every cell were full
        return sketch

    monkeypatch.setattr(scans, "word_sketch", loose)
    assert sorted(map(tuple, scans.noise(df, "d", "p", "t").collect())) == want
    assert (1, 10, 1) not in want and {(1, 1, 10, "char"), (1, 1, 10, "hyphen")} <= set(want)


def test_words_with_many_doubtful_signs_and_long_furniture():
    word = "ililililililil"
    known = lambda w: 9 * (w == "l" * 14 + "a")
    assert scans.repaired(word.replace("i", "1").replace("l", "|") + "a", known) == "l" * 14 + "a" and len(list(scans.readings("1" * 40 + "a"))) == 2
    line = "A running title that is longer than any line of this page " * 3
    own = [(i, [line, "", "first line of this page", "second line"]) for i in range(1, 5)]
    assert {(i, 0) for i in range(4)} <= scans.furniture(own)


def test_long_page():
    assert len(scans.repair([(1, ["word " * 2000] * 50)], counts())) == 50
