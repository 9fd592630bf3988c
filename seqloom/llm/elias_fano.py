"""Elias-Fano sequences over arrays that may lie in a memory-mapped file, with look-ups for many keys at once."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _i in range(256):
    for _j, _at in enumerate([b for b in range(8) if _i >> b & 1]):
        _SELECT[_i, _j] = _at
_ONE = np.uint64(1)
#: The low bit of each byte, the top one, and every other bit, two bits, four bits.
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _EIGHTS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Values with one high part that are looked at in turn; of more the right one is found by halving.
_STEPS = 12


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other, in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        values = values & np.uint64((1 << width) - 1)
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # values don't overlap, so adding sets their bits; several fall into one word
        _add(out, word, values << bit)
        over = bit + np.uint64(width) > np.uint64(64)
        _add(out, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out


def _add(out: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
    if len(word):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] += np.add.reduceat(value, first)


def _select_in(raw: np.ndarray, left: np.ndarray) -> np.ndarray:
    """In each word, the place of the one before which ``left`` others come; the word has more than ``left`` ones.

    Eight bytes are counted at once in the bytes of one number: their ones, the running sums of these,
    and which sums don't exceed ``left``.
    """
    sums = raw - ((raw >> _ONE) & _PAIRS)
    sums = (sums & _FOURS) + ((sums >> np.uint64(2)) & _FOURS)
    sums = ((sums + (sums >> np.uint64(4))) & _EIGHTS) * _EACH
    full = ((left * _EACH | _TOPS) - sums) & _TOPS  # a byte's top bit stays if its sum, 64 at most, isn't above
    at = ((full >> np.uint64(7)) * _EACH >> np.uint64(56)) << np.uint64(3)
    left = left - ((sums << np.uint64(8)) >> at & np.uint64(255))
    return (at + _SELECT[(raw >> at & np.uint64(255)).astype(np.int64), left.astype(np.int64)]).astype(np.int64)


class EliasFano:
    """A rising sequence (equal neighbours allowed): low bits packed, high parts in unary.

    ``parts`` are the arrays of which it consists; they can be stored and given back to ``EliasFano``.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.bytes = high.view(np.uint8).reshape(-1, 8)

    @classmethod
    def of(cls, values: np.ndarray, width: int | None = None) -> EliasFano:
        """``width``: how many low bits are packed; by default what takes least space if the values are spread evenly."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        if width is None:
            width = max(0, (top // max(n, 1)).bit_length() - 1)
        up = (values >> np.uint64(width)).astype(np.int64)
        place = up + np.arange(n)
        words = (int(place[-1]) if n else 0) // 64 + 2
        high = np.zeros(words, np.uint64)
        _add(high, place >> 6, _ONE << (place & 63).astype(np.uint64))
        counts = _POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
        return cls(n, width, _packed(values, width), high, np.concatenate(([0], np.cumsum(counts))).astype(np.uint64))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.ones

    def _select(self, j: np.ndarray, of_ones: bool) -> np.ndarray:
        """Bit places of the j-th ones, or zeros."""
        if of_ones:
            word = np.searchsorted(self.ones, j, side="right") - 1
            left = j - self.ones[word].astype(np.int64)
            raw = self.high[word]
        else:
            if not hasattr(self, "zeros"):
                self.zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)).astype(np.uint64)
            word = np.searchsorted(self.zeros, j, side="right") - 1
            left = j - self.zeros[word].astype(np.int64)
            raw = ~self.high[word]
        return word * 64 + _select_in(raw, left.astype(np.uint64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> bit
        second = np.where(bit > 0, self.low[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = i.astype(np.int64)
        up = self._select(i.astype(np.uint64).astype(np.int64), True) - i
        return (up.astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that isn't below each key (n if none), and whether it equals the key."""
        order = np.argsort(keys)  # in order, neighbours' words lie side by side in memory
        keys = keys[order].astype(np.uint64)
        place, equal = np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        up = keys >> np.uint64(self.width)
        todo = np.flatnonzero(up < np.uint64(len(self.high) * 64 - self.n)) if self.n else np.zeros(0, np.int64)
        want, low = up[todo].astype(np.int64), keys[todo] & np.uint64((1 << self.width) - 1)
        bit = self._select(want, False)  # the zero that ends the values of this high part
        at, same = bit - want, np.zeros(len(todo), bool)
        flat, live = self.bytes.reshape(-1), np.arange(len(todo))
        for _ in range(_STEPS):  # back over the values that share the high part while they aren't below the key
            on = bit[live] - 1
            live = live[(on >= 0) & ((flat[np.maximum(on, 0) >> 3] >> (on & 7).astype(np.uint8)) & 1).astype(bool)]
            value = self._lows(at[live] - 1)
            enough = value >= low[live]
            live, value = live[enough], value[enough]
            if not len(live):
                break
            at[live] -= 1
            bit[live] -= 1
            same[live] = value == low[live]
        if len(live):  # many share it: by halving
            first, hi = np.zeros(len(live), np.int64), at[live]
            some = want[live] > 0
            first[some] = self._select(want[live][some] - 1, False) - (want[live][some] - 1)
            lo, key = first, low[live]
            split = np.flatnonzero(lo < hi)
            while len(split):
                mid = (lo[split] + hi[split]) >> 1
                less = self._lows(mid) < key[split]
                lo[split] = np.where(less, mid + 1, lo[split])
                hi[split] = np.where(less, hi[split], mid)
                split = split[lo[split] < hi[split]]
            at[live], same[live] = lo, self._lows(lo) == key
        place[order[todo]], equal[order[todo]] = at, same
        return place, equal
