"""Arrow text as numpy arrays of code points, and back, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A batch of text is cut into pieces of about so many bytes.
PIECE_BYTES = 4 << 20


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their first bytes' places, the bytes, and the texts' bounds in code points.

    ``text`` is a string array; a null counts as empty.
    """
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if offsets[-1] == offsets[0]:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint32), empty, empty.astype(np.uint8), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return points, heads, data, np.searchsorted(heads, offsets - offsets[0])


def to_text(points: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array of texts given as code points and bounds; null where not ``valid``."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    bits = None
    if valid is not None and not valid.all():
        bits = pa.array(valid).buffers()[1]
    offsets = pa.py_buffer(ends[bounds].astype(np.int64).tobytes())
    array = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [bits, offsets, pa.py_buffer(data)])
    return array.cast(pa.string())


def pieces(text: pa.Array) -> list[pa.Array]:
    """``text`` in consecutive slices of about PIECE_BYTES, each of one text at least."""
    text = text.cast(pa.large_string())
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0))
    group = (np.cumsum(size) - size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(text)]
    return [text.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def chunks(text: pa.Array, border: regex.Pattern) -> Iterator[tuple[int, pa.Array, list[int]]]:
    """Consecutive slices of ``text`` as pieces() gives them, with the number of the first text;
    a text far above PIECE_BYTES comes alone and in parts that end with a match of ``border``,
    given with the code points at which the parts begin."""
    at = 0
    for slice_ in pieces(text):
        first, at = at, at + len(slice_)
        if len(slice_) > 1 or pc.binary_length(slice_)[0].as_py() in (None, 0) or pc.binary_length(slice_)[0].as_py() <= 2 * PIECE_BYTES:
            yield first, slice_, [0] * len(slice_)
            continue
        whole, parts, starts, low = slice_[0].as_py(), [], [], 0
        while low < len(whole):
            found = border.search(whole, low + PIECE_BYTES // 2) if low + PIECE_BYTES // 2 < len(whole) else None
            end = found.end() if found else len(whole)
            parts.append(whole[low:end])
            starts.append(low)
            low = end
        yield first, pa.array(parts, pa.large_string()), starts
