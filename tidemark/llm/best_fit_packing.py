"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Each round range-sorts the pieces and the gaps of sequences together by size, from large to small. Every
task sweeps its range: a piece takes the gap met last, which is the tightest that holds it, and the gap is
gone for this round. What a range cannot match by itself, pieces before gaps, is matched with the ranges
before it by the same sweep over two counts a range; those counts are all that the driver sees, and a
piece's rank in what its range has left decides which gap it gets. Gaps are updated, those of a sequence are
merged, and the next round begins. Pieces longer than every gap get new sequences. A gap that holds the
longest piece left many times is cut into several, so that short pieces do not need a round each.

Defined cases: a null text is the empty text and holds only the end id; texts longer than the capacity
are cut into full pieces and a last shorter one; null doc_ids stay null; rows that repeat a doc_id are packed
each; ties are broken by row; a special token's string in a text gets its id, as from the library; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import Scratch, steps

CAPACITY, END = 4096, 1
#: Distinct words a worker keeps; beyond it the cache starts anew.
CACHED = 400_000
#: Words that the library encodes in one call.
CALL = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """Ids of the words between spaces and line feeds, which this kind of tokenizer treats one by one.

    Texts are split and their distinct words found in Arrow; a word new to the worker is encoded by the
    library, once. A-Z are lower-cased beforehand, as the library would do, and ASCII letters are parted from
    ASCII punctuation after them, between which it always divides. Neither holds within the string of a
    special token, so texts with such a string are left to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.trim()

    def trim(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.offset = array("I"), array("q", [0])

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        known[new] = np.arange(len(self.number), len(self.number) + len(new))
        for i in range(0, len(new), CALL):
            own = [words[k] for k in new[i : i + CALL].tolist()]
            for word, found in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                self.number[word] = len(self.number)
                self.flat.extend(found.ids)
                self.offset.append(len(self.flat))
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Ids of all texts, where each text's ids begin and end, and the ids of texts with special tokens."""
        if len(self.number) > CACHED:
            self.trim()
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        own = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(odd)}
        plain = pc.ascii_lower(pc.if_else(pa.array(odd), "", texts))
        plain = pc.replace_substring_regex(plain, pattern=r"([a-z])([!-/:-@\[-`{-~])", replacement=r"\1 \2")
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = parts.flatten().dictionary_encode()
        at = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        offset = np.frombuffer(self.offset, np.int64)
        counts = offset[at + 1] - offset[at]
        before = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(offset[at] - before[:-1], counts) + np.arange(before[-1])]
        del flat, offset  # views would keep the arrays from growing
        bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, before[bounds - bounds[0]], own


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in steps(batches, most=6_000_000):
            ids, bounds, odd = words.encode(batch.column("text"))
            rows: list[tuple] = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(odd.get(i, ids[bounds[i] : bounds[i + 1]]), end).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


GAP, PIECE, MATCHED = 0, 1, 2
SWEPT = "kind int, size long, id long, gap long, left long, part int, nth long"


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, size, id) of one range, largest first, gaps before pieces of a size: what they match.

    A matched row has the piece's size and id, its gap's id and what is left of the gap. The others keep
    their row and get the number of their range and their place among its pieces or gaps left.
    """
    part, refused = TaskContext.get().partitionId(), 0
    names, types = ["kind", "size", "id", "gap", "left", "part", "nth"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    open_: list[tuple[int, int]] = []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for batch in batches:
        rows: list[tuple] = []
        for kind, size, own in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "id")), strict=True):
            if kind == GAP:
                open_.append((size, own))
            elif open_:
                room, gap = open_.pop()
                rows.append((MATCHED, size, own, gap, room - size, None, None))
            else:
                rows.append((PIECE, size, own, None, None, part, refused))
                refused += 1
        yield table(rows)
    for i in range(0, len(open_), 50_000):
        yield table([(GAP, size, own, None, None, part, i + k) for k, (size, own) in enumerate(open_[i : i + 50_000])])


def between(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Matches between ranges from (range, pieces left, gaps left), as rows (range of pieces, first piece,
    range of gaps, last gap, how many): piece first + j meets gap last - j."""
    open_: list[list[int]] = []
    rows = []
    for part, wanting, gaps in sorted(counts):
        first = 0
        while first < wanting and open_:
            where, last = open_[-1]
            take = min(wanting - first, last + 1)
            rows.append((part, first, where, last, take))
            first += take
            if take > last:
                open_.pop()
            else:
                open_[-1][1] = last - take
        if gaps:
            open_.append([part, gaps - 1])
    return np.array(rows, np.int64).reshape(-1, 5)


def _met(runs: np.ndarray, spark) -> object:
    """A function for mapInArrow: rows that sweep has left over with `met`, the number of their match or null."""
    shared = spark.sparkContext.broadcast(runs)  # at most two rows for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        base = np.concatenate(([0], np.cumsum(runs[:, 4])))[:-1]
        low = {PIECE: runs[:, 0] << 40 | runs[:, 1], GAP: runs[:, 2] << 40 | runs[:, 3] - runs[:, 4] + 1}
        order = {k: np.argsort(v) for k, v in low.items()}
        for batch in batches:
            kind, part, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "part", "nth"))
            at, met = part << 40 | nth, np.full(len(kind), -1)
            for k in (PIECE, GAP) if len(runs) else ():
                rows = np.flatnonzero(kind == k)
                run_ = order[k][np.maximum(np.searchsorted(low[k][order[k]], at[rows], side="right") - 1, 0)]
                past = at[rows] - low[k][run_]
                fits = (past >= 0) & (past < runs[run_, 4])
                number = base[run_] + (past if k == PIECE else runs[run_, 4] - 1 - past)
                met[rows[fits]] = number[fits]
            columns = [batch.column(c) for c in ("kind", "size", "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(met, pa.int64(), mask=met < 0)], ["kind", "size", "id", "met"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, sequence_id, offset for items(item long, length long), lengths from 1 to capacity."""
    spark = items.sparkSession
    scratch = Scratch(spark, "pack")
    rows = items.select(F.lit(PIECE).alias("kind"), F.col("length").cast("long").alias("size"), F.col("item").alias("id"))
    used, turn, done = 0, 0, f"{scratch.at}/matches"
    while True:
        counts = rows.groupBy("kind", "size").count().collect()  # at most twice the capacity
        rest, room = ({r["size"]: r["count"] for r in counts if r.kind == k} for k in (PIECE, GAP))
        if not rest:
            break
        turn, widest, wanting = turn + 1, max(room, default=0), sum(s * n for s, n in rest.items())
        stuck = sum(s * n for s, n in rest.items() if s > widest)
        short = wanting - sum(s * n for s, n in room.items())  # needs new sequences however dealt
        new = -(-max(stuck, short, 0) // capacity)
        if new:
            rows = rows.unionByName(spark.range(used, used + new).select(F.lit(GAP).alias("kind"), F.lit(capacity).cast("long").alias("size"), "id"))
            room[capacity] = room.get(capacity, 0) + new
            used += new
        longest = max((s for s in rest if s <= max(room)), default=1)
        share = max(1, -(-2 * sum(rest.values()) // max(sum(room.values()), 1)))
        # A gap becomes n gaps, each with room for the longest piece left twice; the first also takes the remainder.
        n = F.when(F.col("kind") == GAP, F.greatest(F.lit(1), F.least(F.floor(F.col("size") / (2 * longest)), F.lit(share)))).otherwise(1).cast("int")
        each = F.expr("transform(sequence(1, n), i -> cast(if(i = 1, size - (n - 1) * (size div n), size div n) as long))")
        order = [F.desc("size"), F.asc("kind"), F.asc("id")]
        ranges = rows.withColumn("n", n).select("kind", F.explode(each).alias("size"), "id").repartitionByRange(*order).sortWithinPartitions(*order)
        swept = scratch.save(ranges.mapInArrow(sweep, SWEPT), "swept")
        over = swept.where(F.col("kind") != MATCHED)
        left = over.groupBy("part").agg(F.count_if(F.col("kind") == PIECE).alias("pieces"), F.count_if(F.col("kind") == GAP).alias("gaps")).collect()  # a row for each range
        over = over.mapInArrow(_met(between([tuple(r) for r in left]), spark), "kind int, size long, id long, met long")
        far = over.where(F.col("kind") == PIECE).where("met is not null").join(over.where(F.col("kind") == GAP).where("met is not null").select("met", F.col("id").alias("gap"), F.col("size").alias("room")), "met")
        found = swept.where(F.col("kind") == MATCHED).select("id", "size", "gap", "left").unionByName(far.select("id", "size", "gap", (F.col("room") - F.col("size")).alias("left")))
        found.write.parquet(f"{done}/turn={turn}")
        found = spark.read.schema(found.schema).parquet(f"{done}/turn={turn}")
        gaps = over.where(F.col("kind") == GAP).where("met is null").select("id", "size").unionByName(found.select(F.col("gap").alias("id"), F.col("left").alias("size")))
        gaps = gaps.groupBy("id").agg(F.sum("size").alias("size")).where(F.col("size") >= min(rest)).select(F.lit(GAP).alias("kind"), "size", "id")
        state = scratch.save(over.where(F.col("kind") == PIECE).where("met is null").select("kind", "size", "id").unionByName(gaps), "state")
        scratch.drop(swept, rows)
        rows = state
    if not turn:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    placed = spark.read.schema("id long, size long, gap long, left long, turn int").parquet(done)
    before = "sum(size) over (partition by gap order by turn, id rows between unbounded preceding and 1 preceding)"
    return placed.select(F.col("id").alias("item"), F.col("gap").alias("sequence_id"), F.coalesce(F.expr(before), F.lit(0)).cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "pieces")
    made = scratch.save(pieces(docs, path, capacity, end).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return made.join(pack(made, capacity), "item").drop("item")
