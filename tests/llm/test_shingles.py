import random

import numpy as np

from tidemark.llm import shingles as S


def test_words_and_bounds():
    rng = random.Random(12)
    bits = ["Ab", "aB", " ", "\n", "\x0b", "é", "É", "\x1c", "", "x", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(500)] + ["", " ", "one", "y " * 700_000, "z" * 1_500_000]
    words, bounds = S.word_hashes(texts)
    known: dict = {}
    for i, text in enumerate(texts):
        own = text.encode().lower().split()
        got = words[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(own)
        for w, h in zip(own, got, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    none, bounds = S.word_hashes([])
    assert len(none) == 0 and list(bounds) == [0]


def test_no_collisions_among_many_words():
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in range(300) for c in ("ing", "gni", "nig", "ign", "ab", "ba", "bb", "aa")]
    assert len(np.unique(S.word_hashes([" ".join(words)])[0])) == len(set(words))


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits)


def test_words_that_polynomials_confuse():
    words, _ = S.word_hashes([f"{thue_morse(n, 'a', 'b')} {thue_morse(n, 'b', 'a')}" for n in (1024, 2048, 4096)])
    assert len(np.unique(words)) == 6


def test_distinct_pairs():
    x, y = np.array([3, 1, 3, 1, 3], np.uint64), np.array([5, 2, 4, 2, 5], np.uint64)
    assert [v.tolist() for v in S.distinct(x, y)] == [[1, 3, 3], [2, 4, 5]]
    assert [v.tolist() for v in S.distinct(x[:0], y[:0])] == [[], []]


def test_sets_of_short_and_empty_texts():
    sets = S.shingle_sets(["", " a ", "a", "a b c d e", "a b c d e f", "b a"])
    assert [len(x) for x, _ in sets] == [0, 1, 1, 1, 2, 1]
    assert sets[1][0] == sets[2][0] != sets[5][0] and sets[3][0][0] in sets[4][0]
