"""Words of many texts as numbers, whole arrays at a time.

A word is a run of bytes other than blank and 0x09 to 0x0D (none of which occurs inside a UTF-8
character). Its hash is a polynomial over the bytes, taken from running sums, then mixed; equal
words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FACTOR = 0x9E3779B97F4A7C15
_PIECE = 1 << 18
_powers: list[np.ndarray] = []
#: Texts are taken together up to so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(_PIECE, n)
        ahead, back = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for table, base in ((ahead, _FACTOR), (back, pow(_FACTOR, -1, 1 << 64))):
            table[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done : done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        _powers[:] = [ahead, back]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of ``buf``; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _PIECE, side="right")))
        stop = int(ends[j - 1])
        ahead, back = _tables(stop - at)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum((buf[at:stop].astype(np.uint64) + np.uint64(1)) * ahead[: stop - at], out=sums[1:])
        lo, hi = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[hi] - sums[lo]) * back[lo]
        i = j
    return mixed(out)


class Words:
    """Words of ``texts`` (bytes): ``hashes`` of all, in order; those of text t are at offsets[t] to offsets[t + 1]."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        blank = BLANK[self.buf]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.offsets = np.searchsorted(self.starts, self.text_starts)
        self.hashes = hash_spans(self.buf, self.starts, self.ends)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, and offsets as in Words. A text of fewer words has one run of all of them."""
    h, off = words.hashes, words.offsets
    counts = np.diff(off)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_off = np.concatenate(([0], np.cumsum(n)))
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    at = np.arange(out_off[-1]) - np.repeat(out_off[:-1] - off[:-1], n)
    own_end = np.repeat(off[1:], n)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < own_end
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, padded[at + j], np.uint64(0))
    return mixed(out), out_off


def batches(texts: list, size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes each."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def release() -> None:
    """Hand freed memory back to the system at the end of a task; an idle worker would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: What operators keep in this worker for their own next task.
caches: list[dict] = []


def forget() -> None:
    """Let go of what tasks of other operators have kept in this worker: stages follow each other in the same workers."""
    if any(caches):
        for cache in caches:
            cache.clear()
        release()


def column_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
