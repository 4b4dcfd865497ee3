import random

import corpus_pipeline as C
from tests.llm.test_best_fit_packing import checked
from tests.llm.test_minhash_dedup import brute
from tidemark.llm.shared import Scratch


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = start = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scratch, seen = Scratch(spark, "t"), {}
    for name, stage in C.STAGES[:-1]:
        docs = seen[name] = scratch.save(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.columns == start.columns
    count = {k: v.count() for k, v in seen.items()}
    assert count["language_id"] == start.count()  # every document here has a language
    norm = {"".join((r.text or "").split()) for r in start.collect()}
    assert count["exact_dedup"] == len(norm)
    near = brute({r.doc_id: r.text for r in seen["exact_dedup"].collect()})
    assert {r.doc_id for r in seen["near_dedup"].collect()} == {d for d, (_, c) in near.items() if c == d}
    assert count["substring_dedup"] == count["near_dedup"]
    before = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    runs: dict = {}
    for r in seen["substring_dedup"].collect():
        assert r.n_chars == len(r.text) <= len(before[r.doc_id])
        own = r.text.lower().split()
        for i in range(len(own) - 59):
            runs.setdefault(tuple(own[i : i + 60]), set()).add(r.doc_id)
    assert all(len(ids) == 1 for ids in runs.values())


def test_odd_documents(spark):
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    rows = [(1, text, "en", None, 5), (2, text, "en", "s", 5), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "12 34", "en", "s", 5), (6, text[:-6] + " other end", "en", "s", 5), (7, "x " * 50_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        docs = Scratch(spark, "t").save(stage(spark, docs, ""), "d")
    assert sorted(r.doc_id for r in docs.collect()) == [1, 7]
    out = C.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in out} == {1, 7} and checked(out, 4096)
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        empty = Scratch(spark, "t").save(stage(spark, empty, ""), "d")
    assert empty.count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    clean, same, twice, one, two, passage = prose(80), prose(70), prose(60), prose(90), prose(50), prose(60)
    held = [(None, clean), (4, same), (None, same + " "), (5, twice), (5, twice), (6, one), (6, two), (7, passage), (8, prose(60)), (8, prose(30) + " " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in held], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[1:-1]:
        docs = Scratch(spark, "t").save(stage(spark, docs, ""), name)
    out = sorted((str(r.doc_id), r.text.strip()) for r in docs.collect())
    want = [(None, clean), (None, same), (5, twice), (6, one), (6, two), (7, passage), (8, held[8][1]), (8, held[9][1][: -len(passage)])]
    assert out == sorted((str(i), t.strip()) for i, t in want)


def test_clashing_columns(spark):
    names = "score lang_pred cuts kept keep_id component_id n_shingles digest rows key size best a b held_out __cuts_ words chains".split()
    rows = [(i, f"the words of document number {i} " * 4 + "and some of its own " * i, "en", None, 9, *["x"] * len(names)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in C.STAGES[:-1]:
        docs = Scratch(spark, "t").save(stage(spark, docs, ""), name)
        assert docs.columns[5:] == names
    assert docs.count() and all(r.score == r.best == "x" for r in docs.collect())
    assert C.STAGES[-1][1](spark, docs, "").count() == docs.count()
