import random
import re
from itertools import combinations

import numpy as np

from tidemark.llm import minhash_dedup as M
from tidemark.llm.components import components
from tidemark.llm.shared import Scratch


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    """doc_id to (n_shingles, component_id) by all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in {tuple(sorted(p)) for own in by.values() for p in combinations(own, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def found(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_dedup(docs).collect()}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs) == brute({r.doc_id: r.text for r in docs.collect()})


def test_siblings_chains_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(300)]
    texts = {}
    for i in range(40):  # copies of one text that differ from each other more than from it
        own = list(base)
        for at in rng.sample(range(300), rng.choice([1, 3, 6, 8])):
            own[at] = word()
        texts[100 + i] = " ".join(own)
    texts[50] = " ".join(base)
    drift = [word() for _ in range(200)]
    for i in range(12):  # a chain: each text near the one before it only
        texts[200 + i] = " ".join(drift)
        drift = drift[15:] + [word() for _ in range(15)]
    texts |= {1: None, 2: "", 3: " \n", 4: "one two", 5: "ONE\ttwo", 6: "one two three", 7: "É a b c d", 8: "é a b c d", 9: "x " * 60_000}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, component_id string")
    known = brute(texts)
    assert found(docs) == known
    assert found(docs.unionByName(docs)) == known
    assert M.near_dedup(docs.limit(0)).count() == 0


def test_a_crowded_bucket_in_many_blocks(spark, monkeypatch):
    """Many texts of one family of which only some are near each other, with blocks of a few texts."""
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "SHINGLES", 1500)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, texts = [word() for _ in range(120)], {}
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([2, 4, 5, 6])):
            own[at] = word()
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs) == brute(texts)
    monkeypatch.setattr(M, "ROUNDS", 0)
    assert found(docs) == brute(texts)


def test_null_and_repeated_ids(spark):
    rows = [(5, "one two three four five six"), (5, "quite another text than the one before it"), (3, "one two three four five six"), (None, "quite another text than the one before it"), (None, None), (8, "")]
    out = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out)
    assert got == sorted([("3", 2, "3", True), ("5", 2, "3", False), ("5", 4, "5", True), ("None", 4, "5", False), ("None", 0, "None", True), ("8", 0, "8", True)])


def test_the_second_permutation_is_one():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4099)
    assert len(np.unique(M._order(x))) == len(x)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.sort(x[:3000]), np.sort(x[1000:])
    s = M.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(7, 9), (9, 8), (8, 1000)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {out[i] for i in range(100, 401)} == {100}
    assert {out[i] for i in (7, 8, 9, 1000)} == {7}
