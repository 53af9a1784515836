"""Texts as flat arrays: where their words lie among all bytes of a batch, and 64-bit hashes of these, made by array operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE, LETTER, SIGN, DIGIT = 0, 1, 2, 3
LONG = 256  # bytes; words beyond are hashed one by one
_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def kinds(spaces: bytes = b" \t\n\r") -> np.ndarray:
    """The kind of each byte: spaces, ASCII letters with all bytes beyond ASCII, digits and other signs."""
    out = np.full(256, SIGN, np.uint8)
    out[list(spaces)] = SPACE
    for low, high in ((65, 91), (97, 123), (128, 256)):
        out[low:high] = LETTER
    out[48:58] = DIGIT
    return out


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, with 8 more at the end, and where each text begins and the last one ends."""
    blob = texts.cast(pa.large_binary())
    offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if blob.buffers()[2] is not None:
        data[:-8] = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(texts: pa.Array, kind_of: np.ndarray, glue=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where runs of one kind begin and end, and how many runs precede each text and the end.

    A digit is a run of its own. glue(data, kind, new) may take back places where a run would begin.
    """
    data, at = joined(texts)
    kind = kind_of[data]
    kind[-8:] = SPACE
    new = kind != SPACE
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    if glue:
        glue(data, kind, new)
    first = at[:-1][at[:-1] < at[1:]]
    new[first] = kind[first] != SPACE
    a, last = np.flatnonzero(new), kind != SPACE
    last[:-1] &= new[1:] | (kind[1:] == SPACE)
    return data, a, np.flatnonzero(last) + 1, np.searchsorted(a, at)


def hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [a, b) of each word, eight bytes at a time."""
    import xxhash

    size, eight = b - a, np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    h, at, k = size.astype(np.uint64) * _END, np.arange(len(a)), 0
    long = np.flatnonzero(size > LONG)
    while len(at):
        rest = size[at] - 8 * k
        x = (h[at] ^ (eight[a[at] + 8 * k] & _MASKS[np.minimum(rest, 8)])) * _MIX
        h[at] = x ^ (x >> np.uint64(29))
        at, k = at[(rest > 8) & (size[at] <= LONG)], k + 1
    h = (h ^ (h >> np.uint64(32))) * _END
    h ^= h >> np.uint64(29)
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(data[a[i] : b[i]].tobytes(), 5)
    return h


class Rows:
    """The row that each known hash has; rows are given in order of arrival."""

    def __init__(self):
        self.index = pd.Index(np.zeros(0, np.uint64))

    def __len__(self) -> int:
        return len(self.index)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Rows, -1 for hashes that are not known."""
        return self.index.get_indexer(h) if len(self.index) else np.full(len(h), -1)

    def add(self, h: np.ndarray) -> None:
        self.index = pd.Index(np.concatenate([self.index.to_numpy(), h]))
