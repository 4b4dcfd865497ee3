import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import best_fit_packing as P
from tidemark.llm.shared import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def compared(texts):
    ids, bounds, odd = P.Words(PATH).encode(pa.array(texts, pa.string()))
    for i, known in enumerate(library().encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert odd.get(i, ids[bounds[i] : bounds[i + 1]]).tolist() == known.ids, repr(texts[i])


def test_words_equal_whole_texts():
    rng = random.Random(3)
    bits = ["Hello", ",", ".", ", ", ". ", "é.", "x.,", "'s,", " ", "\n", "  ", "don't", "Été", "é", " ́", "12a", "!?", "\t", "\x1c", "日本", "<|endoftext|>", "<|ENDoftext|>", "<|", "|>", "Σ", "ΑΣ ", "'s", " ", "x" * 40, " "]
    compared(["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(600)] + ["", " ", "\n\n", None, "a <|startoftext|>b", "BELGESİ."])


def test_every_code_point_beside_letters_and_stops():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and not 0xAC00 <= c < 0xD7A4 and not 0x4E00 <= c < 0x9FFF and c < 0x20000]
    compared([shape % chr(c) for c in points for shape in ("ab%s,", ".%s", "%sx.", "A%s's")])


def test_sweep_takes_the_tightest_gap():
    # a piece of range 1 and two of range 3 meet what the ranges before have left, the last gaps first
    assert P.between([(0, 2, 3), (1, 1, 0), (3, 3, 1)]).tolist() == [[1, 0, 0, 2, 1], [3, 0, 0, 1, 2]]


def test_matches_equal_one_sweep(spark):
    """In how many ranges the rows lie does not matter: each piece gets the tightest gap, from large to small."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 1]), rng.randrange(1, 60), i) for i in range(400)]
    order = sorted(rows, key=lambda r: (-r[1], r[0], r[2]))
    open_, known = [], set()
    for kind, size, i in order:
        if kind == 0:
            open_.append((i, size))
        elif open_:
            known.add((i, size, *open_.pop()))
    frame = spark.createDataFrame(rows, "kind int, size long, id long")
    keys = [F.desc("size"), F.asc("kind"), F.asc("id")]
    for parts in (1, 7):
        swept = Scratch(spark, "t").save(frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(P.sweep, P.SWEPT))
        out = {(r.id, r.size, r.gap, r.left + r.size) for r in swept.where("kind = 2").collect()}
        left = swept.where("kind < 2").groupBy("part").agg(F.count_if(F.col("kind") == 1), F.count_if(F.col("kind") == 0)).collect()
        met = swept.where("kind < 2").mapInArrow(P._met(P.between([tuple(r) for r in left]), spark), "kind int, size long, id long, met long").where("met is not null").collect()
        gaps = {r.met: r for r in met if r.kind == 0}
        out |= {(r.id, r.size, gaps[r.met].id, gaps[r.met].size) for r in met if r.kind == 1}
        assert out == known and len(gaps) * 2 == len(met)


def checked(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_is_close_to_the_bound(spark):
    rng = random.Random(4)
    lengths = [min(4096, max(1, int(rng.lognormvariate(6, 1.3)))) for _ in range(3000)] + [4096] * 5 + [1] * 700 + [900] * 1000
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = P.pack(items).join(items, "item").collect()
    assert sorted(r.item for r in rows) == list(range(len(lengths)))
    assert checked(rows, 4096) <= -(-sum(lengths) // 4096) * 1.01 + 1


def test_large_pieces_alone(spark):
    items = spark.createDataFrame([(i, 3000 - i % 7) for i in range(50)], "item long, length long")
    rows = P.pack(items).join(items, "item").collect()
    assert checked(rows, 4096) == 50


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "word " * 9000, 7), (4, "some text", 8), (4, "other", 8), (None, "<|endoftext|>", 9)], "doc_id long, text string, length int")
    rows = P.best_fit_packing(docs, PATH).collect()
    assert len(rows) == 5 + 3 and [r.length for r in rows if r.doc_id is None] == [2]
    assert checked(rows, 4096) == 3
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 3)
    assert long == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert P.best_fit_packing(docs.limit(0), PATH).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = P.best_fit_packing(docs, PATH).collect()
    known, seen = library(), set()
    for r in rows:
        ids = np.array([*known.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.start == r.piece * 4096 and (r.length == 4096 or r.start + r.length == len(ids))
        seen.add(r.doc_id)
    assert seen == set(texts)
    assert checked(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 2
