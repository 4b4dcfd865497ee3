import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, registry, token_counts
from tidemark.llm.shared import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b's", "'s", "'", "''re", "'ll", "'ve x", "'r", "e", "l", " ", "  ", "\n", "\n\n ", "\t", " ", "  ", "12", "½", "é", "日本", "!", "?!", "\x1c", "\x00", "😀", "́", "don't", " the", "S", "'M", "'m"]


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_ids_equal_the_librarys(known):
    rng = random.Random(1)
    texts = [mixed(rng, rng.randrange(60)) for _ in range(1500)] + ["", "x" * 3000, "ab" * 2500, " " * 500, "<|endoftext|>"]
    found = byte_bpe.Encoded(texts, PATH)
    for i, text in enumerate(texts):
        assert found.of(i).tolist() == known.encode_ordinary(text), repr(text)
        assert byte_bpe.decode(found.of(i), PATH) == text.encode()


def test_one_text_alone(known):
    for text in ("", "'", "'s", " 's", "a 's", "a'sb", "\n", "a\n", "a \n b", "'re'", "'r"):
        assert byte_bpe.Encoded([text], PATH).of(0).tolist() == known.encode_ordinary(text), repr(text)


def tree_of(text):
    chars, tokens, pretokens, *_ = token_counts.leaves_of([text], PATH)
    return token_counts.Tree(text, chars.tolist(), tokens.tolist(), pretokens.tolist(), PATH)


def test_both_ways_to_merge():
    rng = random.Random(6)
    by_rank = byte_bpe.ranks(PATH)
    for _ in range(3000):
        piece = bytes(rng.choice(b"etaoinshr qz\xc3\xa9") for _ in range(rng.randrange(1, 60)))
        assert byte_bpe._merge_short(piece, by_rank) == byte_bpe._merge_long(piece, by_rank)


def test_edits_equal_a_full_count(known, monkeypatch):
    rng = random.Random(2)
    for leaf, block in ((16, 256), (2, 3)):
        monkeypatch.setattr(token_counts, "LEAF", leaf)
        monkeypatch.setattr(token_counts, "BLOCK", block)
        for _ in range(200):
            text = mixed(rng, rng.randrange(120))
            tree = tree_of(text)
            assert tree.tokens.total() == len(known.encode_ordinary(text))
            for _ in range(8):
                pos, cut, put = rng.randrange(-2, len(text) + 4), rng.choice([0, 0, 1, 3, 20, 200]), mixed(rng, rng.choice([0, 1, 3, 40]))
                at = min(max(pos, 0), len(text))
                text = text[:at] + put + text[at + cut :]
                token_counts.apply([tree], [[{"pos": pos, "cut": cut, "put": put}]])
                assert tree.text == text
                assert tree.tokens.total() == len(known.encode_ordinary(text)), repr(text)
                assert tree.chars.total() == len(text) == sum(x[0] for x in tree.leaves())
                assert all(0 < x[2] <= leaf for x in tree.leaves())


def test_an_edit_stays_local():
    text = "the quick brown fox " * 5000
    tree = tree_of(text)
    token_counts.apply([tree], [[{"pos": 50_000, "cut": 3, "put": "xyz"}]])
    assert 0 < tree.encoded < 40


def test_many_edits_cost_no_square():
    """Appending, inserting at one place and at many: each edit encodes a few leaves, however many went before."""
    rng = random.Random(4)
    for at in (lambda n: n, lambda n: 7, lambda n: rng.randrange(n + 1)):
        tree = tree_of("some words to begin with")
        for _ in range(2000):
            token_counts.apply([tree], [[{"pos": at(len(tree.text)), "cut": 0, "put": " and more"}]])
        assert tree.encoded < 2000 * 5 * token_counts.LEAF
        assert tree.tokens.total() == tree_of(tree.text).tokens.total()


def test_a_second_batch_of_edits_reads_the_stored_trees(spark, known):
    docs = spark.createDataFrame([(i, "some words and others, " * (40 * i)) for i in range(1, 6)] + [(9, None), (None, "no id")], "doc_id long, text string")
    first = token_counts.edited(token_counts.trees(docs, PATH).withColumn("edits", token_counts.derived_edits()), PATH)
    kept = Scratch(spark, "t").save(first)
    second = token_counts.edited(kept.withColumn("edits", F.expr("array(named_struct('pos', 100L, 'cut', 4L, 'put', 'zebra'))")), PATH).collect()
    assert len(second) == 7
    for r in second:
        assert r.n_tokens == len(known.encode_ordinary(r.text)) == sum(r.tokens) and r.n_pretokens == sum(r.pretokens) and sum(r.chars) == len(r.text)
        assert "zebra" in r.text and r.n_reencoded <= 5 * token_counts.LEAF


def test_defined_cases(spark, known):
    rows = [(1, None, "x", None), (2, "", "x", [(0, 0, "hi")]), (3, "hello  world's", None, [(5, None, " "), (None, 2, None)]), (3, "hello  world's", None, [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, edits array<struct<pos: bigint, cut: bigint, put: string>>")
    table = token_counts.trees(docs, PATH).join(docs.select("doc_id", "edits", F.monotonically_increasing_id().alias("n")), "doc_id")
    out = token_counts.edited(table, PATH).collect()
    assert len(out) == 6  # doc 3 twice with two edit lists each
    assert [(r.n_before, r.n_tokens, r.text) for r in out if r.doc_id == 1] == [(0, 0, "")]
    assert [(r.n_before, r.n_tokens, r.text) for r in out if r.doc_id == 2] == [(0, 1, "hi")]
    assert sorted(r.text for r in out if r.doc_id == 3) == ["hello  world's"] * 2 + ["llo   world's"] * 2
    assert token_counts.token_counts(docs.limit(0), PATH, token_counts.derived_edits()).count() == 0
    made = byte_bpe.digests(docs, PATH).collect()
    assert len(made) == 4
    assert byte_bpe.digests(docs.limit(0), PATH).count() == 0
    back = byte_bpe.decoded(byte_bpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, ""), (2, ""), (3, "hello  world's"), (3, "hello  world's")]


def test_queries_round_trip(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in registry.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    seen = 0
    counts = {r.doc_id: (r.n_tokens, r.n_edited) for r in registry.op8_token_counts(spark, "/root/testdata/sf0.001").collect()}
    edited = token_counts.trees(docs, PATH).withColumn("edits", token_counts.derived_edits())
    for r in token_counts.edited(edited, PATH).collect():
        assert r.n_tokens == len(known.encode_ordinary(r.text))
        assert counts[r.doc_id] == (len(known.encode_ordinary(texts[r.doc_id])), r.n_tokens)
        assert r.text != texts[r.doc_id]
        seen += 1
    assert seen == len(texts)
