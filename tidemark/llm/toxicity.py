"""Toxicity by maximum-scoring segments.

A bounded sample of labelled rows gives each token (a word, or a word's beginning) its log-odds between
toxic and other documents under an informative Dirichlet prior; what counts is the lower end of its
credible interval, so that rare tokens weigh little and most have no evidence. Those cost DRIFT each. The linear
scan of Ruzzo and Tompa finds every maximal segment of a text; the extreme-value law of Karlin and
Altschul, with its rate solved from the token scores of other documents, turns a segment's score and the
text's length into evidence. A logistic fit on the sample maps a text's evidence to a score.

Learned from: text and the toxic label of rows outside the held-out fold. Defined cases: a null text is
the empty text and scores by its zero evidence; without labels of both kinds every score is the share of
toxic labels (0 without labels); labels and documents that repeat count each, null ids of labels
and labels other than 0 and 1 are left out; an empty table gives an empty result. Long texts are scanned whole.
Other columns are not read. The sample of `most_rows` labelled documents is the only bound: all its tokens
with evidence make the model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import Scratch, crc_fold, steps

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are tokens of their own.
HEADS = (5, 6, 7, 8)
#: Cost of a token without evidence; weight of the prior; standard deviations to the interval's lower end.
DRIFT, PRIOR, DEVIATIONS = 0.25, 1000.0, 3.0
#: The constant of the extreme-value law; its exact value is absorbed by the logistic fit.
K = 0.1
#: Bounds of a text's evidence.
LEAST, MOST = -10.0, 30.0
#: Distinct words whose score a worker keeps.
CACHED = 400_000


@dataclass
class Model:
    weights: dict[str, float]
    rate: float
    intercept: float
    slope: float


def _features(words: set[str]) -> Iterator[str]:
    for w in words:
        yield w
        for n in HEADS:
            if len(w) > n:
                yield w[:n] + "*"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that have a token, and under the token '' their words."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def counts() -> Iterator[pa.RecordBatch]:
        for toxic, own in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array([toxic] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], ["token", "toxic", "n"])
            own.clear()

    for batch in steps(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            held[toxic].update(_features(words))
            held[toxic][""] += len(words)
        if len(held[0]) + len(held[1]) > CACHED:
            yield from counts()
    yield from counts()


def segments(at: np.ndarray, gain: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score): scores gain > 0 at positions at, -drift elsewhere.

    The scan keeps, for each candidate, the cumulative score before it and after it; a new candidate joins
    the latest one that starts lower, if its own end is higher than that one's.
    """
    found: list[list] = []  # first position, last position, sum before, sum after
    total, last = 0.0, -1
    for i, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (i - last - 1)
        new = [i, i, total, total + g]
        total, last = total + g, i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scorer(dict):
    """The score of a word, by itself or by its best beginning; 0 without evidence."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED:
            self.clear()
        get = self.weights.get
        self[word] = s = max([get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in HEADS if len(word) > n)])
        return s

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = _WORD.findall(text.lower())
        gain = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(gain > 0)
        return len(words), segments(at, gain[at])


def evidence(n: int, found: list[tuple[int, int, float]], rate: float) -> float:
    """Minus the logarithm of the expected number of segments as good as the best, in a text of n words.

    Further segments that chance does not explain add what they would have alone, once each. A text
    without any segment has the least evidence there is.
    """
    if not found:
        return LEAST
    scores = sorted((s for _, _, s in found), reverse=True)
    base = math.log1p(K * n)
    total = rate * scores[0] - base + sum(max(0.0, rate * s - base) for s in scores[1:])
    return min(max(total, LEAST), MOST)


def _rate(weights_seen: Counter, neutral: int, drift: float = DRIFT) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the tokens of other documents."""
    total = neutral + sum(weights_seen.values())

    def above(rate: float) -> bool:
        return (neutral * math.exp(-rate * drift) + sum(n * math.exp(min(rate * s, 500.0)) for s, n in weights_seen.items())) > total

    low, high = 1e-3, 1.0
    while not above(high) and high < 64:
        high *= 2
    for _ in range(60):
        low, high = (low, mid) if above(mid := (low + high) / 2) else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    b = np.zeros(2)
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """A model from at most about most_rows labelled documents; labels(doc_id, toxic) are those to learn from."""
    spark = docs.sparkSession
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, most_rows / max(labels.count(), 1))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    train = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # bounded by most_rows
    counts = train.mapInArrow(_count, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("yes"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("no")).na.fill(0)
    counts = Scratch(spark, "toxic").save(counts.where("yes > 0 or token = ''"))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        share = totals.get(1, 0) / max(sum(totals.values()), 1)
        return Model({}, 1.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0)
    words = counts.where("token = ''").first()
    n_yes, n_no = (float(words.yes), float(words.no)) if words else (0.0, 0.0)
    yes, no = F.col("yes") + F.col("alpha"), F.col("no") + F.col("alpha")
    odds = F.log(yes / (n_yes + PRIOR - yes)) - F.log(no / (n_no + PRIOR - no))
    prior = F.lit(0.5) + PRIOR * (F.col("yes") + F.col("no")) / max(n_yes + n_no, 1.0)
    weighed = counts.where("token <> ''").withColumn("alpha", prior).select("token", F.round(odds - DEVIATIONS * F.sqrt(1 / yes + 1 / no), 3).alias("weight"))
    found = weighed.where("weight > 0").toPandas()  # several toxic documents of the sample have each
    weights = dict(zip(found.token, found.weight, strict=True))
    shared = spark.sparkContext.broadcast(weights)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often other documents have each score; under 0 the words without one."""
        scorer, held = Scorer(shared.value), Counter()
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                held.update(map(scorer.__getitem__, _WORD.findall((text or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.float64()), pa.array(held.values(), pa.int64())], ["score", "n"])

    histogram = train.where("toxic = 0").select("text").mapInArrow(seen, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
    null = Counter({r.score: r.n for r in histogram.collect()})  # scores have three decimals
    rate = _rate(null, null.pop(0.0, 0))

    def weighed_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in steps(batches):
            found = [evidence(*scorer.scan(text or ""), rate) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], ["toxic", "x"])

    rows = train.mapInArrow(weighed_evidence, "toxic int, x double").toPandas()  # two numbers for each document of the sample
    intercept, slope = _logistic(rows.x.to_numpy(), rows.toxic.to_numpy(float))
    return Model(weights, rate, intercept, max(slope, 0.0))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score, predicted and the significant passages as word ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.weights)
        for batch in steps(batches):
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                n, found = scorer.scan(text or "")
                z = model.intercept + model.slope * evidence(n, found, model.rate)
                scores.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
                spans.append([{"word_from": a, "word_to": b + 1, "score": s} for a, b, s in found if K * n * math.exp(-model.rate * s) < 0.05])
            kind = pa.list_(pa.struct([("word_from", pa.int64()), ("word_to", pa.int64()), ("score", pa.float64())]))
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, "score", "predicted", "passages"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, score double, predicted int, passages array<struct<word_from: bigint, word_to: bigint, score: double>>"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: Column | None = None, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, passages. Rows where fold is true are never learned from."""
    fold = crc_fold("doc_id", 5) == 0 if fold is None else fold
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold, F.lit(False)).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), labels.where(~F.coalesce(fold, F.lit(False))), most_rows)
    return score(rows, model, keep=("doc_id", "held_out"))
