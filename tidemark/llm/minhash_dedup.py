"""MinHash near-dedup with circulant signatures.

Two permutations make all signature coordinates: the first scatters the shingles over the ring of
32-bit numbers, the second orders the ring, and coordinate k is the least of the second over the
shingles moved k strides around the ring, a circular shift. Texts with equal sets are one class. Classes that
share a band are candidates; a link holds if the exact Jaccard similarity of the full sets, of 96-bit shingle
hashes made from 128-bit word hashes, reaches the threshold.

No group is expanded into its pairs. In a few rounds each class is compared with the most central class of its
buckets that it has not met, which joins groups of near copies to their centres. After these only buckets
that still hold more than one component are looked at: of each the classes outside its largest component are
compared with all of it. Both kinds are dealt into blocks of bounded size; a task gets the sets of two blocks,
counts all intersections as products of a 0/1 matrix, and returns at most one link for each component that joins
another. So no link that joins components is lost.

Defined cases: a null text is the empty text; texts without words have no set, link with nothing and
stay; rows whose doc_id is null or repeated count each, and one row of a component is kept; an empty table
gives an empty result. Other columns are not read. With 32 bands of 5 coordinates a pair at similarity 0.75 is
missed with probability 1.7e-4, one at 0.1 met with 3.2e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import Scratch, by_row, small, steps
from tidemark.llm.shingles import distinct, mixed, shingle_sets

BANDS, ROWS = 32, 5
#: Rounds of comparison with central classes.
ROUNDS = 3
#: Classes and shingles of a block of a large bucket, and shingles in a step of the matrix product.
BLOCK, SHINGLES, STEP = 512, 400_000, 1024
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, onto the ring of 32-bit numbers."""
    return (mixed(x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _order(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the ring."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """A row for each set; all sets hold something."""
    ring = _scatter(np.concatenate(sets))
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), length), np.uint32)
    for k in range(length):
        out[:, k] = np.minimum.reduceat(_order(ring + np.uint32(k * 0x01000193 & 0xFFFFFFFF)), starts)
    return out


def bands(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """64-bit bucket keys, different for each band."""
    cut = signature.reshape(len(signature), count, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key.view(np.int64)


def features(docs: DataFrame, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            pairs = shingle_sets(batch.column("text"))
            sets = [s for s, _ in pairs]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, key in zip(full, bands(signatures([sets[i] for i in full], count * rows), count, rows), strict=True):
                    keys[i] = key
            digest = [xxhash.xxh3_128_digest(x.tobytes() + y.tobytes()) if len(x) else None for x, y in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"]
            )

    return _rows(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its full set, twelve bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            raw = [np.stack([x & LOW, x >> HALF, y >> HALF], axis=1).astype("<u4").tobytes() for x, y in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "packed"])

    return _rows(docs).mapInArrow(run, "doc_id long, packed binary")


LOW, HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    three = np.frombuffer(raw, "<u4").reshape(-1, 3).astype(np.uint64)
    return three[:, 0] | three[:, 1] << HALF, three[:, 2]


def _common(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two sets."""
    return len(one[0]) + len(two[0]) - len(distinct(*(np.concatenate(x) for x in zip(one, two, strict=True)))[0])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with `link`: whether the full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, link, (one, two) = (None, None), [], (batch.column("one").to_pylist(), batch.column("two").to_pylist())
            for x, y in zip(one, two, strict=True):
                if held[0] != y:
                    held = (y, _unpacked(y))  # rows of the same centre mostly follow each other
                mine = _unpacked(x)
                both = _common(mine, held[1])
                link.append(100 * both >= percent * (len(mine[0]) + len(held[1][0]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], ["a", "b", "link"])

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("packed").alias("one")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("packed").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, link boolean")


def _numbered(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each shingle of all sets, equal for equal ones, and how often each number occurs."""
    x, y = (np.concatenate(v) for v in zip(*sets, strict=True))
    order = np.lexsort((y, x))
    new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))[: len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, np.bincount(place)


def _joining(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """Links that join the components of these classes, found by all their intersections."""
        rep, n, component = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "n", "component"))
        sets = [_unpacked(x) for x in table.column("packed").to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
        place, count = _numbered(sets)
        number = np.cumsum(count > 1) - 1
        common = count[place] > 1
        owner, place = owner[common], number[place[common]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int((count > 1).sum()), STEP):
            i, j = np.searchsorted(place, [low, low + STEP])
            has = np.zeros((len(sets), STEP), np.float32)
            has[owner[i:j], place[i:j] - low] = 1
            both += has @ has.T
        held, shared = n.astype(np.float64), both.astype(np.float64)
        near = 100 * shared >= percent * (held[:, None] + held[None, :] - shared)
        x, y = np.nonzero(np.triu(near & (component[:, None] != component[None, :]), 1))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out: list[tuple[int, int, bool]] = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            one, two = find(int(component[i])), find(int(component[j]))
            if one != two:
                root[max(one, two)] = min(one, two)
                out.append((int(rep[i]), int(rep[j]), True))
        return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_())))})

    return links


def _near_sizes(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*members.columns, F.coalesce("component", "rep").alias("component"))


def _dealt(own: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, rep, n, component, meets) of the buckets that hold several components.

    The classes outside a bucket's largest component are dealt into blocks 0 to r - 1, those in it into the b
    blocks after these; every block meets each of the first r.
    """
    parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"))
    most = parts.groupBy("key").agg(F.max(F.struct("classes", "component")).alias("top"), F.count(F.lit(1)).alias("several"), F.sum("classes").alias("classes"), F.sum("shingles").alias("shingles")).where("several > 1")
    most = most.join(parts.select("key", F.col("component").alias("largest"), F.col("shingles").alias("inside")), "key").where(F.col("top.component") == F.col("largest"))

    def blocks(classes, shingles):
        return F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")

    most = scratch.save(most.select("key", "largest", blocks(F.col("classes") - F.col("top.classes"), F.col("shingles") - F.col("inside")).alias("r"), blocks(F.col("top.classes"), F.col("inside")).alias("b")), "largest")
    placed = own.join(most, "key")
    within = F.col("component") == F.col("largest")
    salt = F.xxhash64("rep", F.lit(7))
    block = F.when(within, F.col("r") + F.pmod(salt, F.col("b"))).otherwise(F.pmod(salt, F.col("r"))).cast("int")
    placed = placed.withColumn("block", block).withColumn("last", F.when(within, F.col("r") - 1).otherwise(F.col("r") + F.col("b") - 1))
    meets = F.explode(F.expr("transform(sequence(0, last), x -> struct(least(x, block) as one, greatest(x, block) as two))"))
    return placed.select("key", "rep", "n", "component", meets.alias("meets"))


def _near(docs: DataFrame, percent: int, count: int, rows: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    made = scratch.save(features(docs, count, rows), "features")
    classes = scratch.save(made.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = scratch.save(keyed.join(shared, "key"), "buckets")
    central = buckets.groupBy("rep").agg(F.sum("size").alias("score"))
    members = scratch.save(buckets.join(central, "rep").select("key", "rep", "n", "score"), "members")
    scratch.drop(buckets)

    wanted = scratch.save(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = scratch.save(packed_sets(docs.join(small(wanted), "doc_id", "left_semi")), "sets")

    links = None
    own, met = members.withColumn("component", F.col("rep")), None  # met: bucket and component of the centres so far
    for _ in range(ROUNDS):
        left = own if met is None else own.join(met, ["key", "component"], "left_anti")
        hubs = left.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("back"), "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
        chances = left.join(hubs, "key").select(F.col("rep").alias("a"), (-F.col("hub.back")).alias("b"), "n", F.col("hub.n").alias("m"), F.col("hub.score").alias("score"))
        chances = chances.where((F.col("a") != F.col("b")) & _near_sizes("n", "m", percent))
        best = scratch.save(chances.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "best")
        if best.isEmpty():
            break
        tried = scratch.save(linked(best, sets, percent), "tried").where("link")
        links = tried if links is None else links.unionByName(tried)
        labels = components(links, scratch)
        own = scratch.save(_with_components(members, labels), "own")
        centres = scratch.save(hubs.select("key", (-F.col("hub.back")).alias("rep")), "hubs")
        centres = _with_components(centres, labels).select("key", "component")
        met = centres if met is None else met.unionByName(centres)
    placed = scratch.save(_dealt(own, scratch), "open")
    if not placed.isEmpty():
        full = placed.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("key", "meets.one", "meets.two", "rep", "n", "component", "packed")
        more = scratch.save(full.groupBy("key", "one", "two").applyInArrow(_joining(percent), "a long, b long, link boolean"), "more")
        links = more if links is None else links.unionByName(more)
    links = docs.sparkSession.createDataFrame([], "a long, b long") if links is None else links
    labels = components(links, scratch)

    # Empty sets get a key of their own each, so that they do not meet in one task.
    of_class = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    alone = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary")).alias("digest")
    out = made.select("doc_id", "n_shingles", alone).join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    return by_row(_rows(docs), lambda own: _near(own, percent, count, rows), ("doc_id", "component_id"))
