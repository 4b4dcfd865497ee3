"""Word hashes and 5-word shingle sets, a step of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_TOO = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lanes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of all words as rows of two numbers, and where each text's words begin and end.

    Words are runs without white space (\\x20, \\x09-\\x0D); only A-Z are lower-cased. Words are split and told apart
    in Arrow, so each distinct word of a step is hashed once.
    """
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words = lists.flatten()
    real = np.asarray(pc.binary_length(words)) > 0  # white space at an end leaves an empty word there
    before = np.concatenate(([0], np.cumsum(real)))
    offsets = np.asarray(lists.offsets)
    coded = words.dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.cast(pa.binary()).to_pylist()))
    lanes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return lanes[np.asarray(coded.indices)[real]], before[offsets - (offsets[0] if len(offsets) else 0)]


def word_hashes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin and end."""
    lanes, bounds = word_lanes(texts)
    return np.ascontiguousarray(lanes[:, 0]), bounds


def windows(words: np.ndarray, size: int, factor: np.uint64 = _MIX) -> np.ndarray:
    """A hash of every run of `size` words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * factor + words[i : i + n]
    return mixed(out)


def shingle_sets(texts: list[str] | pa.Array, size: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text as two aligned arrays of hashes, sorted; a shorter text is one shingle, an
    empty one has none."""
    lanes, bounds = word_lanes(texts)
    own = [(np.ascontiguousarray(lanes[:, k]), factor) for k, factor in enumerate((_MIX, _MIX_TOO))]
    runs = [windows(x, size, factor) for x, factor in own]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            x, y = (r[a : b - size + 1] for r in runs)
        else:
            x, y = (windows(w[a:b], b - a, factor) if b > a else w[:0] for w, factor in own)
        out.append(distinct(x, y))
    return out


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    same = x[1:] == x[:-1]
    if (y[1:][same] != y[:-1][same]).any():
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    keep = np.append(True, ~same)[: len(x)]
    return x[keep], y[keep]
