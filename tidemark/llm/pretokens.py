"""Pre-token boundaries by class arrays and an associative scan of transition functions, without regex.

The splitting pattern of the public byte-level vocabularies is a finite automaton once each code point
carries a symbol that also tells what follows it. A symbol is a function from state to state; such
functions compose associatively. So the text is cut into blocks, all blocks compose their functions at
once, a scan over blocks gives each block's entry state, and a second sweep marks where tokens begin.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Symbols. PREFIX: a space that joins what follows. LONE: another white space before something. SPACE:
# any other white space. SHORT and LONG: an apostrophe before one or two letters of a contraction.
LETTER, NUMBER, OTHER, PREFIX, LONE, SPACE, SHORT, LONG, GAP = range(9)
# States: what the open token is, or how many letters of a contraction are to come.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_PREFIX, ONE_MORE, TWO_MORE = range(8)
STATES = 8

#: Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token begins, by symbol and state."""
    to, cut = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for symbol, state in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        to[symbol] = state
        cut[symbol, [state, AFTER_PREFIX]] = False
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        to[symbol] = state
        to[symbol, [IN_OTHER, AFTER_PREFIX]] = IN_OTHER
        cut[symbol, [IN_OTHER, AFTER_PREFIX]] = False
    for state, after in ((TWO_MORE, ONE_MORE), (ONE_MORE, FRESH)):
        to[LETTER, state], cut[LETTER, state] = after, False
    to[PREFIX], to[LONE], to[SPACE], to[GAP] = AFTER_PREFIX, FRESH, IN_SPACE, FRESH
    cut[SPACE, IN_SPACE] = False
    return to.ravel(), cut.ravel()


_TO, _CUT = _tables()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    kinds[first == "L"], kinds[first == "N"] = LETTER, NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def symbols(codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The symbol of each code point; the positions in gaps lie between texts."""
    kinds = _classes()[codes]
    kinds[gaps] = GAP
    after = np.append(kinds[1:], np.uint8(GAP))
    out = kinds.copy()
    before_text = (kinds == SPACE) & (after != SPACE) & (after != GAP)
    out[before_text & (codes == 0x20)] = PREFIX
    out[before_text & (codes != 0x20)] = LONE
    marks = np.flatnonzero((codes == 0x27) & (after == LETTER))
    if len(marks):
        one = codes[marks + 1]
        two = codes[np.minimum(marks + 2, len(codes) - 1)]
        two[(marks + 2 >= len(codes)) | (kinds[np.minimum(marks + 2, len(codes) - 1)] != LETTER)] = 0
        out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        out[marks[pairs[0] | pairs[1] | pairs[2]]] = LONG
    return out


def starts(marks: np.ndarray) -> np.ndarray:
    """True where a token begins (and at gaps)."""
    n = len(marks)
    if not n:
        return np.zeros(0, bool)
    length = max(1, int(np.sqrt(n / STATES)))
    blocks = -(-n // length)
    rows = np.full(blocks * length, GAP, np.uint8)
    rows[:n] = marks
    rows = np.ascontiguousarray(rows.reshape(blocks, length).T).astype(np.int64) * STATES

    through = np.repeat(np.arange(STATES, dtype=np.int64)[:, None], blocks, axis=1)
    for row in rows:
        through = _TO[row + through].astype(np.int64)
    step = 1  # inclusive scan of the blocks' functions by doubling
    while step < blocks:
        through[:, step:] = np.take_along_axis(through[:, step:], through[:, :-step].copy(), axis=0)
        step *= 2
    state = np.concatenate(([FRESH], through[FRESH, :-1]))
    out = np.empty(rows.shape, bool)
    for i, row in enumerate(rows):
        at = row + state
        out[i] = _CUT[at]
        state = _TO[at].astype(np.int64)
    return out.T.ravel()[:n]


class Cuts:
    """Pre-tokens of several texts: byte ranges in one buffer, and each text's range of pre-tokens."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        marks = symbols(codes, ends[:-1])
        self._at = np.flatnonzero(starts(marks))
        self._real = marks[self._at] != GAP
        self.buffer = joined.encode()
        self.chars = self._at[self._real]
        if len(self.buffer) != len(codes):
            wide = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))))
            self._at = wide[self._at]
        #: the pre-tokens of text i are those from first[i] up to first[i + 1]
        self.first = np.searchsorted(self.chars, np.concatenate(([0], ends[:-1] + 1, [len(codes) + 1])))
        #: where text i begins among all code points
        self.begins = np.concatenate(([0], ends[:-1] + 1))

    def slices(self) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The bytes of all pre-tokens and of the line feeds between texts, and which are pre-tokens."""
        edges = pa.py_buffer(np.append(self._at, len(self.buffer)).astype(np.int64))
        whole = pa.Array.from_buffers(pa.large_binary(), len(self._at), [None, edges, pa.py_buffer(self.buffer)])
        return whole.dictionary_encode(), self._real
