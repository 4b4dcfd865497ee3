"""Edit-aware token counts.

Each document keeps a segment tree over its pre-tokens: leaves are groups of up to LEAF pre-tokens with their
code points and tokens, in blocks whose sums a segment tree holds. `trees` makes these once, as a table of
documents with their leaves; `edited` takes such a table and a list of edits for each document and returns it as
the edits leave it, without encoding a text anew. An edit finds the leaves it touches by descending the tree of
code points, takes a few code points of left context (no pre-token that ends further left can see the edit), and
re-encodes to the right until a new boundary meets the end of an old leaf: the splitting pattern never looks
behind a boundary, so all later pre-tokens stand. The new pre-tokens become leaves in place of those touched, and
the sums above them are updated.

Edits of a document come as an array in the order they apply: {pos, cut, put}, in code points of the
text as the edits before have left it. Defined cases: a null text is the empty text; a null edit list is
no edit; pos and cut are clipped to the text, nulls are 0; a null put is empty; null and repeated doc_ids are
counted each; an empty table gives an empty result. Long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.byte_bpe import Encoded
from tidemark.llm.shared import Scratch, steps

#: Code points beyond its end that can change a pre-token: the letters of a contraction.
SEEN = 3
#: Pre-tokens of a leaf at most, and leaves of a block.
LEAF, BLOCK = 16, 256
EDITS = "array<struct<pos: bigint, cut: bigint, put: string>>"
TREE = "doc_id long, text string, n_tokens long, n_pretokens long, chars array<int>, tokens array<int>, pretokens array<int>"


class Sums:
    """A segment tree of sums; leaf i is node size + i."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        level = leaves + [0] * (self.size - len(leaves))
        levels = [level]
        while len(level) > 1:
            level = [a + b for a, b in zip(level[::2], level[1::2], strict=True)]
            levels.append(level)
        self.node = [0, *(x for level in levels[::-1] for x in level)]

    def total(self) -> int:
        return self.node[1]

    def add(self, leaf: int, change: int) -> None:
        i = self.size + leaf
        while i and change:
            self.node[i] += change
            i >>= 1

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds unit `at`, and the sum before that leaf; the last leaf that is not empty for `at` = total."""
        i, before = 1, 0
        at = min(at, self.total() - 1)
        while i < self.size:
            i *= 2
            if at - before >= self.node[i]:
                before += self.node[i]
                i += 1
        return i - self.size, before


class Tree:
    """A text, the leaves over its pre-tokens, and how many pre-tokens editing it has encoded."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], pretokens: list[int], path: str) -> None:
        self.text, self.path, self.encoded = text, path, 0
        leaves = list(zip(chars, tokens, pretokens, strict=True))
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._index()

    def _index(self) -> None:
        self.chars, self.tokens, self.pretokens = (Sums([sum(x[k] for x in b) for b in self.blocks]) for k in range(3))

    def leaves(self) -> list[tuple[int, int, int]]:
        return [x for b in self.blocks for x in b]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block and place of the leaf that holds code point `at`, and where the leaf begins."""
        block, before = self.chars.find(at)
        own = self.blocks[block]
        for i, leaf in enumerate(own):
            if before + leaf[0] > at or i == len(own) - 1:
                return block, i, before
            before += leaf[0]
        return block, 0, before

    def begin(self, pos: int, cut: int, put: str) -> bool:
        """Apply an edit to the text; true if it changes anything."""
        size = len(self.text)
        pos = min(max(pos, 0), size)
        cut = min(max(cut, 0), size - pos)
        if not cut and not put:
            return False
        self.text = self.text[:pos] + put + self.text[pos + cut :]
        self.grown, self.was = len(put) - cut, size
        self.first = self._find(max(pos - SEEN, 0))
        self.last = self._find(min(pos + cut, max(size - 1, 0)))
        self._ahead()
        return True

    def _ahead(self) -> None:
        block, i, at = self.last
        self.stop = at + (self.blocks[block][i][0] if self.blocks[block] else 0)  # end of the last leaf touched, in the old text

    def window(self) -> str:
        """The touched leaves' new text, with what a pre-token beyond it may show."""
        return self.text[self.first[2] : self.stop + self.grown + SEEN]

    def settle(self, starts: np.ndarray, counts: np.ndarray) -> bool:
        """Take over the window's pre-tokens if one begins where the last touched leaf ended; else touch the next leaf."""
        self.encoded += len(counts)
        end = self.stop + self.grown - self.first[2]
        if self.stop < self.was:
            k = int(np.searchsorted(starts, end))
            if k == len(starts) or starts[k] != end:
                block, i, _ = self.last
                for _ in range(self.touched()):  # as many leaves again, so that a long pre-token costs no square
                    block, i = (block, i + 1) if i + 1 < len(self.blocks[block]) else (block + 1, 0)
                    self.last = block, i, self.stop
                    self._ahead()
                    if self.stop >= self.was:
                        break
                return False
            starts, counts = starts[:k], counts[:k]
        groups = -(-len(starts) // LEAF)
        edge = np.linspace(0, len(starts), groups + 1).astype(int)
        at = np.append(starts, end)
        before = np.concatenate(([0], np.cumsum(counts)))
        self._put([(int(at[j] - at[i]), int(before[j] - before[i]), int(j - i)) for i, j in zip(edge[:-1], edge[1:], strict=True)])
        return True

    def touched(self) -> int:
        (block, i, _), (last, j, _) = self.first, self.last
        return j - i + 1 + sum(len(self.blocks[b]) for b in range(block, last))

    def _put(self, new: list[tuple[int, int, int]]) -> None:
        """The new leaves stand for the touched ones."""
        (block, i, _), (last, j, _) = self.first, self.last
        own = self.blocks[block][:i] + new + self.blocks[last][j + 1 :]
        if block == last and 0 < len(own) <= 2 * BLOCK:
            gone = self.blocks[block][i : j + 1]
            self.blocks[block] = own
            for k, sums in enumerate((self.chars, self.tokens, self.pretokens)):
                sums.add(block, sum(x[k] for x in new) - sum(x[k] for x in gone))
        else:
            self.blocks[block : last + 1] = [own[k : k + BLOCK] for k in range(0, len(own), BLOCK)]
            self.blocks = self.blocks or [[]]
            self._index()


def apply(trees: list[Tree], edits: list[list[dict]]) -> None:
    """The first edit of every tree, then the second, and so on; the windows of a turn are encoded at once."""
    for turn in range(max(map(len, edits), default=0)):
        open_ = []
        for tree, own in zip(trees, edits, strict=True):
            if turn < len(own) and (e := own[turn]) and tree.begin(e["pos"] or 0, e["cut"] or 0, e["put"] or ""):
                open_.append(tree)
        while open_:
            found = Encoded([t.window() for t in open_], open_[0].path)
            cuts, left = found.cuts, []
            for i, tree in enumerate(open_):
                own = slice(cuts.first[i], cuts.first[i + 1])
                if not tree.settle(cuts.chars[own] - cuts.begins[i], found.counts[own]):
                    left.append(tree)
            open_ = left


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))


def leaves_of(texts: list[str], path: str) -> tuple[np.ndarray, ...]:
    """Code points, tokens and pre-tokens of the leaves of all texts; where each text's leaves, pre-tokens and tokens end."""
    found = Encoded(texts, path)
    first = found.cuts.first.astype(np.int64)
    sizes = np.diff(first)
    per = -(-sizes // LEAF)
    leaf = np.concatenate(([0], np.cumsum(per)))
    place = np.arange(leaf[-1]) - np.repeat(leaf[:-1], per)
    start = np.repeat(first[:-1], per) + place * LEAF
    stop = np.minimum(start + LEAF, np.repeat(first[1:], per))
    chars = np.append(found.cuts.chars, 0)
    ends = np.repeat(found.cuts.begins[: len(texts)] + np.fromiter(map(len, texts), np.int64, len(texts)), per)
    last = stop == np.repeat(first[1:], per)
    length = np.where(last, ends, chars[np.where(last, 0, stop)]) - chars[start]
    before = np.concatenate(([0], np.cumsum(found.counts)))
    return length, before[stop] - before[start], stop - start, leaf, sizes, np.diff(found.bounds)


def trees(docs: DataFrame, path: str) -> DataFrame:
    """Table TREE of docs(doc_id, text) and its other columns of which `edited` is to know, here none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            chars, tokens, pretokens, leaf, sizes, n = leaves_of(texts, path)
            lists = [_lists(x, leaf) for x in (chars, tokens, pretokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "text", "n_tokens", "n_pretokens", "chars", "tokens", "pretokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREE)


def edited(table: DataFrame, path: str, edits: str = "edits", whole: bool = True) -> DataFrame:
    """A table of trees with a column of edits, after the edits; n_before and n_reencoded tell what they did.

    Without `whole` only doc_id and the counts are returned, not texts and leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            held = [batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "pretokens")]
            made = [Tree(*x, path) for x in zip(*held, strict=True)]
            apply(made, [x or [] for x in batch.column("edits").to_pylist()])
            columns = [batch.column("doc_id"), batch.column("n_tokens"), *(pa.array([f(t) for t in made], pa.int64()) for f in (lambda t: t.tokens.total(), lambda t: t.pretokens.total(), lambda t: t.encoded))]
            names = ["doc_id", "n_before", "n_tokens", "n_pretokens", "n_reencoded"]
            if whole:
                leaves = [t.leaves() for t in made]
                columns += [pa.array([t.text for t in made], pa.string()), *(pa.array([[x[k] for x in own] for own in leaves], pa.list_(pa.int32())) for k in range(3))]
                names += ["text", "chars", "tokens", "pretokens"]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = "doc_id long, n_before long, n_tokens long, n_pretokens long, n_reencoded long"
    rows = table.select("doc_id", "text", "n_tokens", "chars", "tokens", "pretokens", F.col(edits).cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, fields + (", text string, chars array<int>, tokens array<int>, pretokens array<int>" if whole else ""))


def token_counts(docs: DataFrame, path: str, edits: Column) -> DataFrame:
    """doc_id, n_tokens before the edits, n_edited after them, n_pretokens (after), n_reencoded: trees are written
    once, then edited. `edits` is made of the columns doc_id and text."""
    kept = Scratch(docs.sparkSession, "trees").save(trees(docs, path))
    done = edited(kept.withColumn("edits", edits), path, whole=False)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_edited"), "n_pretokens", "n_reencoded")


def derived_edits(text: str = "text") -> Column:
    """Four edits of a document out of its own text: a deletion, an insertion, a replacement, an addition."""
    own, n = F.coalesce(F.col(text), F.lit("")), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")

    def at(share: float) -> Column:
        return F.floor(n * share).cast("long")

    def edit(pos: Column, cut: Column, put: Column) -> Column:
        return F.struct(pos.alias("pos"), cut.cast("long").alias("cut"), put.alias("put"))

    word = F.substring_index(own, " ", 1)
    return F.array(
        edit(at(0.2), F.lit(7), F.lit("")),
        edit(at(0.4), F.lit(0), F.concat(F.lit(" "), word, F.lit("'s "))),
        edit(at(0.6), F.lit(5), F.concat(F.lit("\n\n"), F.lit("ok"), F.lit("  "))),
        edit(n * 2, F.lit(0), F.concat(F.lit(" "), word)),
    )
