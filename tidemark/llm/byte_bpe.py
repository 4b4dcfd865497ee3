"""Byte-level BPE encoding and decoding of whole texts.

Boundaries come from pretokens (class arrays and a transition-function scan). The distinct slices of a step
are found in Arrow; each is merged once per worker and kept in a cache of bounded size. The ids of a step are
gathered from the cache at once, and the byte offset of every id is retained, so any range of ids maps back to
bytes.

Defined cases: a null text is the empty text, with no ids; special tokens are ordinary text; a slice of
any length merges in n log n steps; repeated rows are encoded each; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.pretokens import Cuts
from tidemark.llm.shared import steps

#: Distinct slices a worker keeps; beyond it the cache starts anew.
CACHED = 600_000
#: Bytes up to which a slice is merged by plain scans, which are quadratic but quick; longer ones use a heap.
SHORT = 48


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def vocabulary(path: str) -> list[bytes]:
    by_rank = ranks(path)
    out = [b""] * (max(by_rank.values()) + 1)
    for piece, rank in by_rank.items():
        out[rank] = piece
    return out


def merge(piece: bytes, by_rank: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until no pair has a rank."""
    if (whole := by_rank.get(piece)) is not None:
        return [whole]
    return _merge_short(piece, by_rank) if len(piece) <= SHORT else _merge_long(piece, by_rank)


def _merge_short(piece: bytes, by_rank: dict[bytes, int]) -> list[int]:
    get, none = by_rank.get, len(by_rank)
    edges = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]  # rank of the parts i and i + 1
    while pairs and (rank := min(pairs)) < none:
        i = pairs.index(rank)
        del edges[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[edges[i] : edges[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[edges[i - 1] : edges[i + 1]], none)
    return [by_rank[piece[a:b]] for a, b in pairwise(edges)]


def _merge_long(piece: bytes, by_rank: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here; 0 once it is merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := by_rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := by_rank.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := by_rank.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(by_rank[piece[i : end[i]]])
        i = end[i]
    return out


class Merged(dict):
    """Slice to its number; the ids of number i are flat[offset[i]:offset[i + 1]]."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.by_rank, self.flat, self.offset = ranks(path), array("I"), array("q", [0])

    def __missing__(self, piece: bytes) -> int:
        self.flat.extend(merge(piece, self.by_rank))
        self.offset.append(len(self.flat))
        self[piece] = n = len(self.offset) - 2
        return n

    def trim(self) -> None:
        if len(self) > CACHED:
            self.clear()
            self.flat, self.offset = array("I"), array("q", [0])


@lru_cache(2)
def cache(path: str) -> Merged:
    return Merged(path)


class Encoded:
    """Ids of several texts; those of text i lie from bounds[i] up to bounds[i + 1]."""

    def __init__(self, texts: list[str], path: str) -> None:
        self.path, merged = path, cache(path)
        merged.trim()
        self.cuts = Cuts(texts)
        slices, own = self.cuts.slices()
        distinct = np.fromiter(map(merged.__getitem__, slices.dictionary.to_pylist()), np.int64, len(slices.dictionary))
        number = distinct[slices.indices.to_numpy(zero_copy_only=False)[own]]
        flat, offset = np.frombuffer(merged.flat, np.uint32) if merged.flat else np.zeros(0, np.uint32), np.frombuffer(merged.offset, np.int64)
        self.counts = offset[number + 1] - offset[number]
        before = np.concatenate(([0], np.cumsum(self.counts)))
        self.ids = flat[np.repeat(offset[number] - before[:-1], self.counts) + np.arange(before[-1])]
        self.bounds = before[self.cuts.first]
        del flat, offset  # views would keep the arrays from growing

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def decode(ids: np.ndarray, path: str) -> bytes:
    return b"".join(map(vocabulary(path).__getitem__, ids.tolist()))


def _mapped(docs: DataFrame, keep: tuple[str, ...], row, schema: str, names: list[str], types: list[pa.DataType], path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = Encoded([x or "" for x in batch.column("text").to_pylist()], path)
            made = [row(found, i) for i in range(len(found))]
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, [*keep, *names])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, {schema}")


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ids and ends, the byte offset at which each id's bytes end."""

    def row(found: Encoded, i: int):
        sizes = list(map(len, map(vocabulary(path).__getitem__, found.of(i).tolist())))
        return found.of(i), np.cumsum(sizes, dtype=np.int64)

    return _mapped(docs, keep, row, "ids array<long>, ends array<long>", ["ids", "ends"], [pa.list_(pa.int64()), pa.list_(pa.int64())], path)


def decoded(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the text that the column ids stands for; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.array(x or [], np.int64), path).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], [*keep, "text"])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{fields}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of every text in one pass."""

    def row(found: Encoded, i: int):
        ids = found.of(i)
        raw = ids.astype("<u4").tobytes()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()

    return _mapped(docs, ("doc_id",), row, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], path)
