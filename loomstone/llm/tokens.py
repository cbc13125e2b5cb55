"""Words of many texts as arrays of hashes, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers = {"up": np.ones(1, "u8"), "down": np.ones(1, "u8")}
CHUNK_BYTES = 1 << 21


def powers(n: int, which: str = "up") -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64, or of its inverse."""
    have = _powers[which]
    if len(have) < n:
        base = P if which == "up" else P_INV
        out = np.full(max(n, 2 * len(have)), base, "u8")
        out[0] = 1
        _powers[which] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``."""
    total = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * powers(len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(data) + 1, "down")[start] + (end - start).astype("u8"))


def groups(texts: list, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes or characters; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def parts(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes; a longer text is a slice of its own.

    A worker that turns one slice after the other into Python's strings never holds a whole batch of them, which it
    would keep as its own memory for as long as it lives.
    """
    at = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if size and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n + 1
    if at < batch.num_rows:
        yield batch.slice(at)


def words(texts: list[bytes], blank_separated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of its text.

    A word is a run of letters, digits, underscores and characters beyond ASCII, or, if
    ``blank_separated``, of anything but ASCII white space.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if blank_separated:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    else:
        inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    ends_of_texts = np.cumsum(np.array([len(t) + 1 for t in texts], "i8"))
    return span_hashes(data, start, end), np.searchsorted(ends_of_texts, start, side="right")
