"""Bracket matching over whole Arrow batches, so that units are cut at depth zero.

A parameter list, an annotation's values, an array or the head of a loop may hold braces, semicolons and line
breaks that neither open a block nor end a statement. All brackets of a batch of masked files are matched at once by
sorting them by file, depth and position; inside every round or square group that holds no block, or that a block or an
arrow follows, what would cut a unit is hidden. Marks keep the number of bytes, as all masks do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators.chunking.lexing import NEWLINE

HIDDEN = "\x05"
AT_ONCE = 1 << 19

_STEP = np.zeros(256, np.int64)
_STEP[list(b"([{")] = 1
_STEP[list(b")]}")] = -1
_OPENER = np.zeros(256, np.uint8)
_OPENER[list(b")]}")] = list(b"([{")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n\x01\x04")] = True
_CUTS = np.zeros(256, np.uint8)
_CUTS[list(b"()[]{};")] = ord(HIDDEN)
_CUTS[ord("\n")] = ord(NEWLINE)
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$")] = True
_WORD[128:] = True


def _among(letters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters)] = True
    return table


# A brace after one of these holds values, a pattern or a type; after a name, a closing bracket or an arrow it may hold a block.
# What stands in a brace right behind another is decided by the outer one.
_LITERAL = _among(b"({,:=<|&[]?")
# Languages in which a call may be followed by a block that is its last argument.
_TRAILING = ["kotlin", "swift", "scala"]
_TYPE, _AFTER_TYPE = _among(b":<|&"), _among(b"{>[|&")


def matched(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all brackets, and the indexes among them of the pairs that match; ``starts`` are the files' first bytes."""
    at = np.flatnonzero(_STEP[data])
    step = _STEP[data[at]]
    file = np.searchsorted(starts, at, "right") - 1
    total = np.concatenate([[0], np.cumsum(step)])
    level = total[1:] - total[np.searchsorted(at, starts[file])] + (step < 0)
    order = np.lexsort((at, level, file))
    one, two = order[:-1], order[1:]
    pair = (file[one] == file[two]) & (level[one] == level[two]) & (step[one] > 0) & (_OPENER[data[at[two]]] == data[at[one]])
    return at, one[pair], two[pair]


def _beside(data: np.ndarray, at: np.ndarray, code: np.ndarray, way: int) -> np.ndarray:
    """Places of the nearest bytes that are not blank before (-1) or after (1), or -1."""
    k = np.searchsorted(code, at, "right" if way > 0 else "left") + (0 if way > 0 else -1)
    inside = (k >= 0) & (k < len(code))
    return np.where(inside, code[np.clip(k, 0, max(0, len(code) - 1))] if len(code) else -1, -1)


def hide(texts: list[bytes], languages: list[str]) -> list[bytes]:
    """Masked files with everything hidden that would cut a unit inside a group without a block."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8).copy()
    starts = np.cumsum(size) - size
    at, one, two = matched(data, starts)
    if len(one):
        kind = np.array(languages, object)
        file = np.searchsorted(starts, at[one], "right") - 1
        code = np.flatnonzero(~_BLANK[data])
        opens, closes, first = at[one], at[two], data[at[one]]
        before, after = _beside(data, opens, code, -1), _beside(data, closes, code, 1)
        prev = np.where(before >= starts[file], data[before], 0)
        following = np.where((after >= 0) & (after < starts[file] + size[file]), data[after], 0)
        brace = first == ord("{")
        empty = brace & (_beside(data, opens, code, 1) == closes)
        kept = brace & ~empty & ~_LITERAL[prev]
        for k in np.flatnonzero(kept & (kind[file] == "go")):  # types without a name
            kept[k] = not data[max(0, before[k] - 8) : before[k] + 1].tobytes().endswith((b"struct", b"interface"))
        body = np.zeros(len(at), np.int64)
        body[one[kept]] = 1
        body[np.setdiff1d(np.flatnonzero(data[at] == ord("{")), one)] = 1  # never closed
        bodies = np.concatenate([[0], np.cumsum(body)])
        plain = bodies[two] - bodies[one + 1] == 0

        # Groups of declarations are blocks of their own
        group = np.zeros(len(one), bool)
        for k in np.flatnonzero((first == ord("(")) & (kind[file] == "go") & (prev == ord("e"))):
            end = before[k] + 1
            if data[max(0, end - 4) : end].tobytes() == b"type" and (end == 4 + starts[file[k]] or data[end - 5] in b"\n;\x04"):
                group[k] = True
        data[opens[group]], data[closes[group]] = ord("{"), ord("}")

        script = np.isin(kind[file], ["typescript", "tsx"])
        arrow = (following == ord("=")) & (data[np.minimum(after + 1, len(data) - 1)] == ord(">"))
        types = script & brace & plain & _TYPE[prev] & (_AFTER_TYPE[following] | arrow)
        semis = np.concatenate([[0], np.cumsum(data == ord(";"))])
        adjacent = (before == opens - 1) & _WORD[prev]
        initial = (kind[file] == "cpp") & brace & adjacent & (semis[closes] == semis[opens]) & ((following == ord(",")) | (following == ord("{")))

        head = (first == ord("(")) & ((following == ord("{")) | arrow) & ~np.isin(kind[file], _TRAILING)
        inside = ~brace & (plain | head) & ~group
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, opens[inside] + 1, 1)
        np.add.at(cover, closes[inside], -1)
        whole = types | initial
        np.add.at(cover, opens[whole], 1)
        np.add.at(cover, closes[whole] + 1, -1)
        hidden = (np.cumsum(cover[:-1]) > 0) & (_CUTS[data] > 0)
        data[hidden] = _CUTS[data[hidden]]
    return [data[s : s + n - 1].tobytes() for s, n in zip(starts.tolist(), size.tolist())]


@F.arrow_udf(T.StringType())
def nested(masked: pa.Array, language: pa.Array) -> pa.Array:
    """Files in batches of half a megabyte, as matching holds some fifty bytes for each byte; a null stays null."""
    out: list[bytes | None] = [None] * len(masked)
    places: list[int] = []
    texts: list[bytes] = []
    held = 0

    def work_off() -> None:
        if places:
            for i, text in zip(places, hide(texts, language.take(pa.array(places)).to_pylist())):
                out[i] = text
        places.clear()
        texts.clear()

    for i, text in enumerate(masked.cast(pa.binary())):
        text = text.as_py()
        if text is None:
            continue
        if held + len(text) > AT_ONCE:
            work_off()
            held = 0
        places.append(i)
        texts.append(text)
        held += len(text)
    work_off()
    return pa.array(out, pa.binary()).cast(pa.string())
