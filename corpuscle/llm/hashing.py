"""Words and byte ranges of Arrow texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of the input."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blend(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(mix(a + U(seed)) * U(BASE) + b)


def _byte_table(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += U(32)
    return mix(code * U(BASE) + U(77))


BYTES, LOWER = _byte_table(False), _byte_table(True)
WORD_BYTES = {low: np.where(SPACE, U(0), table) for low, table in ((False, BYTES), (True, LOWER))}
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        step = pow(BASE, -1, 2**64) if inverse else BASE
        out = np.full(n, step, np.uint64)
        out[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(out)
    return have[:n]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and where each text starts (and the end)."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary())), b"\n")
    return np.frombuffer(one[0].as_py() + b"\n", np.uint8), start


def parts(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer that ends in white space begin and end."""
    gap = SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        turn = np.concatenate([[0], turn])
    return turn[0::2], turn[1::2]


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (and the end)."""
    if len(texts) == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    buf, start = joined(texts)
    table, out, begins, at = WORD_BYTES[lower], [], [], 0
    while at < len(buf):
        to = min(at + PIECE, len(buf))
        while not SPACE[buf[to - 1]]:  # never cut a word
            more = np.flatnonzero(SPACE[buf[to : to + PIECE]])
            to = to + int(more[0]) + 1 if len(more) else min(to + PIECE, len(buf))
        piece = buf[at:to]
        begin, end = word_spans(piece)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * powers(len(piece)), out=total[1:])
        code = (total[end] - total[begin]) * powers(len(piece), True)[begin]
        out.append(mix(code + (end - begin).astype(np.uint64)))
        begins.append(begin + at)
        at = to
    begin = np.concatenate(begins)
    return np.concatenate(out), np.searchsorted(begin, start)


def doubled(code: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... items up to ``longest``; the k-th array starts a run of 2**k at each item."""
    out, size = [code], 1
    while 2 * size <= longest:
        last = out[-1]
        out.append(blend(last[: max(0, len(last) - size)], last[size:], 2 * size))
        size *= 2
    return out


def runs(table: list[np.ndarray], begin: np.ndarray, end: np.ndarray, seed: int = 3) -> np.ndarray:
    """Hashes of item ranges, from the two runs that cover each; ``table`` is from doubled()."""
    size = end - begin
    level = np.frexp(size.astype(np.float64))[1] - 1
    first, last = np.empty(len(begin), np.uint64), np.empty(len(begin), np.uint64)
    for k in np.unique(level):
        here = level == k
        first[here] = table[k][begin[here]]
        last[here] = table[k][end[here] - (1 << int(k))]
    return blend(blend(first, last, seed), size.astype(np.uint64), seed)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
