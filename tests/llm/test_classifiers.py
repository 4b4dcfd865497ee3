import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id as L
from tidemark.llm import registry
from tidemark.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = registry.op10_language_id(spark, SF).collect()
    assert len(out) == len(known)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(i, f"the cat and dog number {i}", "en", 1) for i in range(20)] + [(50 + i, f"der hund und die katze {i}", "de", 1) for i in range(20)]
    rows += [(90, None, "en", 1), (91, "", None, 1), (92, "12 .. 7", "en", 1), (93, "é", None, 1), (94, "und die katze " * 50_000, None, 1), (None, "the dog", "en", 1), (93, "é", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in L.language_id(docs).collect()}
    assert [out[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and out[90].score == 0
    assert out[94].lang_pred == "de" and out[93].lang_pred in ("de", "en") and out[None].lang_pred == "en"
    assert {r.lang_pred for r in L.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.language_id(docs.limit(0)).count() == 0


def test_grams_stay_within_a_text():
    (hashed, starts, stop), *_ = list(L._grams(["ab", "", "c"], 16))
    assert list(stop - starts) == [2, 0, 1]
    pairs = list(L._grams(["ab", "", "c"], 16))[1]
    assert list(pairs[2] - pairs[1]) == [1, 0, 0]


def scalar_grams(text, bits):
    """Buckets of all n-grams of one text, a code point at a time."""
    codes, odd, low = [ord(c) for c in text.lower()], [int(x) for x in L._ODD], (1 << 32) - 1
    out = []
    for start in range(len(codes)):
        h = codes[start] * odd[0] & low
        for order in range(L.ORDERS):
            if start + order >= len(codes):
                break
            if order:
                h = ((h ^ h >> 15) * odd[order] + codes[start + order]) & low
            out.append((h * odd[2 - order] & low) >> 32 - bits)
    return out


def test_naive_bayes_by_brute_force(spark):
    rng = random.Random(14)
    sets = {"a": "abcde fgh", "b": "bcdxy zuv", "c": "éèab ñ日"}
    rows = [(i, "".join(rng.choice(sets[x]) for _ in range(rng.randrange(1, 40))), x) for i, x in enumerate(rng.choices("abc", [6, 2, 1], k=120))] + [(500, "½²Ⅷ①", "a"), (501, "7", None), (502, "ª", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2]]
    counts = {x: Counter({g: 0.5 for g in range(1 << L.BITS)}) for x in "abc"}
    for _, text, lang in train:
        counts[lang].update(scalar_grams(text, L.BITS))
    total = {x: sum(c.values()) for x, c in counts.items()}
    prior = {x: math.log(sum(r[2] == x for r in train) / len(train)) for x in "abc"}
    out = {r.doc_id: r for r in L.language_id(docs).collect()}
    for i, text, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in text):
            assert (out[i].lang_pred, out[i].score) == ("und", 0)
            continue
        logs = {x: prior[x] + sum(math.log(counts[x][g] / total[x]) for g in scalar_grams(text, L.BITS)) for x in "abc"}
        best = max(logs, key=logs.get)
        assert out[i].lang_pred == best
        assert math.isclose(out[i].score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-6)


def test_every_language_is_learned(spark):
    """300 languages, one of which has nearly all rows, most of them copies of one text."""
    names = [f"l{i:03}" for i in range(300)]
    rows = [(i, f"{chr(0x4E00 + i % 300)}{chr(0x5E00 + i % 300)} " * 3, names[i % 300]) for i in range(1200)] + [(5000 + i, "same text", "big") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix, _ = L.fit(docs, most_rows=50)
    assert langs == ["big", *names] and matrix.size <= L.MATRIX
    assert {r.lang_pred for r in L.language_id(docs, most_rows=50).collect()} == set(langs)


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = registry.op9_toxicity(spark, SF).collect()
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_toxicity_edges(spark):
    rows = [(i, "plain words of a calm text " * 3 + ("vile scum trash " if i % 4 == 0 else ""), "z") for i in range(200)] + [(900, None, "z"), (901, "", "z"), (None, "vile scum", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "q") for i in range(200)] + [(3, None, "q"), (None, 1, "q")], "doc_id long, toxic int, text string")
    out = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(out) == 203
    assert all(out[i].predicted == (i % 4 == 0) for i in range(200)) and out[900].predicted == 0
    assert out[4].passages[0].word_from == 18 and out[4].passages[0].word_to == 21
    assert T.toxicity(docs, labels.limit(0)).count() == 203
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_scores_by_brute_force(spark):
    """Weights, rate and scores from their definitions, with every maximal segment found by trial."""
    rng = random.Random(15)
    vile, plain = ["vile", "scum", "trash", "scummy"], [f"word{c}{d}" for c in "abcdefg" for d in "hijkl"]
    texts = {i: " ".join(rng.choice(vile if i % 4 == 0 and rng.random() < 0.3 else plain) for _ in range(rng.randrange(5, 25))) for i in range(160)}
    docs = spark.createDataFrame([*texts.items(), (900, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in texts], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    held = {0: Counter(), 1: Counter()}
    for i, text in texts.items():
        held[i % 4 == 0].update(set(T._features(set(text.split()))))
    n = {k: sum(len(set(t.split())) for i, t in texts.items() if (i % 4 == 0) == k) for k in (0, 1)}
    weights = {}
    for token in held[1]:
        alpha = 0.5 + T.PRIOR * (held[0][token] + held[1][token]) / (n[0] + n[1])
        yes, no = held[1][token] + alpha, held[0][token] + alpha
        w = round(math.log(yes / (n[1] + T.PRIOR - yes)) - math.log(no / (n[0] + T.PRIOR - no)) - T.DEVIATIONS * math.sqrt(1 / yes + 1 / no), 3)
        if w > 0:
            weights[token] = w
    assert model.weights.keys() == weights.keys() and all(abs(model.weights[k] - w) < 0.0011 for k, w in weights.items())

    def gains(text):
        return [max([0.0] + [model.weights.get(t, 0.0) for t in T._features({w})]) or -T.DRIFT for w in text.split()]

    others = [g for i, t in texts.items() if i % 4 for g in gains(t)]
    assert abs(sum(math.exp(model.rate * g) for g in others) / len(others) - 1) < 1e-6 or model.rate == 64
    for r in T.score(docs, model).collect():
        own = gains(texts.get(r.doc_id, ""))
        peaks = sorted((s for *_, s in maximal(own)), reverse=True)
        base = math.log1p(T.K * len(own))
        x = model.rate * peaks[0] - base + sum(max(0.0, model.rate * s - base) for s in peaks[1:]) if peaks else T.LEAST
        z = model.intercept + model.slope * min(max(x, T.LEAST), T.MOST)
        assert abs(r.score - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-6


def test_long_text_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "plain calm words " * 9 + "vile scum " * (i % 3 == 0)) for i in range(120)] + [(500, "plain calm words " * 200_000 + "vile scum vile scum"), (501, "vile scum"), (501, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] * 2, "doc_id long, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == 123 and sorted(r.predicted for r in out if r.doc_id == 501) == [0, 1]
    assert [r.passages[-1].word_to for r in out if r.doc_id == 500] == [600_004]


def best_segment(scores):
    return max((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))


def maximal(scores):
    """By definition: the best segment, then the same on what lies on its two sides."""
    if not scores or max(scores) <= 0:
        return []
    s, i, j = best_segment(scores)
    return maximal(scores[:i]) + [(i, j - 1, s)] + [(a + j, b + j, x) for a, b, x in maximal(scores[j:])]


def test_segments_by_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        scores = [rng.choice([-1.0, -1.0, -1.0, rng.random() * 4]) for _ in range(rng.randrange(1, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = sorted(T.segments(np.array(at, int), np.array([scores[i] for i in at]), 1.0))
        known = maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in known]
        assert np.allclose([s for *_, s in found], [s for *_, s in known])
