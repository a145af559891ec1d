import random

import numpy as np

from papyrion.llm.text import Words, words


def test_words_of_many_texts_are_those_of_each():
    rng, parse = random.Random(1), Words()
    odd = [chr(c) for c in range(0x20, 0x3000)] + ["𝔸", "😀", "𐐀", "中", "文", "\n", "_"]
    for k in range(200):
        texts = ["".join(rng.choice(odd if k % 3 else "aB c_d\n1 éÉ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 8))]
        lists = [words(t) for t in texts]
        hashes, lengths = parse(texts)
        assert lengths.tolist() == [len(x) for x in lists]
        by = {}
        for w, h in zip((w for x in lists for w in x), hashes.tolist(), strict=True):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_a_word_has_one_hash_in_any_text():
    parse = Words()
    (a,), _ = parse(["Straße"])
    b, lengths = parse(["x straße", "", "y STRASSE straSSe ΟΔΟΣ straße"])
    assert lengths.tolist() == [2, 0, 5] and b[1] == a == b[6] and b[4] != a and len(np.unique(b)) == 5
