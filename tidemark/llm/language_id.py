"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count hashed n-grams per language over a bounded sample of labelled rows (`most_rows` of each
language, chosen by a hash of the row); Spark sums the counts. Priors are the languages' shares of all
labelled rows. The log-probability matrix, languages x hash buckets, is broadcast; it has at most
`MATRIX` entries, as the n-grams of very many languages share fewer buckets. Scoring gathers matrix
columns for all n-grams of a step of texts at once and adds them up per text.

Defined cases: null texts and texts without a letter (str.isalpha) are `und` with score 0; ties go to the
language first in order; every language of a labelled row can be predicted; without labelled rows every text
is `und`; repeated rows count and are answered each; an empty table gives an empty result. Long texts are
scored whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import crc_fold, steps

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
BITS, ORDERS = 16, 3
#: Entries of the matrix at most: 32 MB.
MATRIX = 1 << 22


def _grams(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the hashed n-grams of all texts, and where each text's start and end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1]))
    mixed = codes * _ODD[0]
    for order in range(ORDERS):
        if order:
            if len(mixed) < 2:
                return
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _ODD[order] + codes[order:]
        stop = np.maximum(starts, ends - order)
        yield ((mixed * _ODD[2 - order]) >> np.uint32(32 - bits)).astype(np.int32), starts, stop


def _lowered(column: pa.Array) -> list[str]:
    return [(x or "").lower() for x in column.to_pylist()]


def _counts(langs: list[str], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        number = {lang: i for i, lang in enumerate(langs)}
        for batch in steps(batches, most=1_500_000):
            own_langs, texts = [number[x] for x in batch.column("lang").to_pylist()], _lowered(batch.column("text"))
            for lang in set(own_langs):
                own = [t for t, x in zip(texts, own_langs, strict=True) if x == lang and t]
                held = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for hashed, starts, stop in _grams(own, bits) if own else ():
                    inside = np.zeros(len(hashed) + 1, dtype=np.int8)
                    some = stop > starts
                    np.add.at(inside, starts[some], 1)
                    np.add.at(inside, stop[some], -1)
                    held += np.bincount(hashed[np.cumsum(inside[:-1]) > 0], minlength=1 << bits)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["lang", "gram", "n"])

    return count


def fit(docs: DataFrame, most_rows: int = 5_000, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-probabilities and log-priors, from docs(doc_id, text, lang).

    N-grams are counted over at most about most_rows rows of each language; a hash of id and text chooses
    them, so copies of one text are not all in or out. A language with fewer rows is learned from all.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(rows)
    if not langs:
        return langs, np.zeros((0, 1 << bits)), np.zeros(0)
    bits = max(1, min(bits, (MATRIX // len(langs)).bit_length() - 1))
    shares = docs.sparkSession.createDataFrame([(x, min(1 << 20, int((1 << 20) * most_rows / n) + 1)) for x, n in rows.items()], "lang string, share int")
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share"))
    found = sample.select("lang", "text").mapInArrow(_counts(langs, bits), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most MATRIX rows
    matrix = np.full((len(langs), 1 << bits), 0.5)
    matrix[found.lang.to_numpy(), found.gram.to_numpy()] += found.n.to_numpy()
    seen = np.array([rows[x] for x in langs], float)
    return langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)), np.log(seen / seen.sum())


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, prior: np.ndarray, keep: tuple[str, ...] = ("doc_id",), carry_text: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns of docs, and text if asked for, with lang_pred and score, or under other names."""
    keep = (*keep, "text") if carry_text else keep
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix, prior))
    bits = int(matrix.shape[1]).bit_length() - 1

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = shared.value
        for batch in steps(batches, most=1_500_000):
            texts = _lowered(batch.column("text"))
            sums = np.repeat(prior[:, None], len(texts), axis=1)
            for hashed, starts, stop in _grams(texts, bits) if langs else ():
                some = np.flatnonzero(stop > starts)
                edges = np.stack([starts[some], stop[some]], axis=1).ravel()
                for i in range(len(langs)):
                    if len(some):
                        sums[i, some] += np.add.reduceat(np.append(matrix[i][hashed], 0.0), edges)[::2]
            known = np.array([bool(langs) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            langs_of, scores = np.array(["und"] * len(texts), dtype=object), np.zeros(len(texts))
            if langs:
                best = sums.argmax(axis=0)
                langs_of[known] = np.array(langs, dtype=object)[best[known]]
                scores[known] = (1.0 / np.exp(sums - sums.max(axis=0)).sum(axis=0))[known]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(langs_of, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predict, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def language_id(docs: DataFrame, fold: Column | None = None, most_rows: int = 5_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows where fold is true are never learned from."""
    fold = crc_fold("doc_id", 4) == 2 if fold is None else fold
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(fold, F.lit(False)).alias("held_out"))
    return identify(rows, *fit(rows.where(~F.col("held_out")), most_rows), keep=("doc_id", "held_out"))
