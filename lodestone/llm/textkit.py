"""Vectorised words and word-window hashes over Arrow text columns.

Texts are handled in chunks of about CHUNK bytes, so that temporaries stay small; a longer text is a chunk of its own.
Word hashes are polynomials modulo 2**64 over random byte values, mixed afterwards; window hashes are polynomials over
word hashes. Equal words always have equal hashes, so grouping by a hash never separates equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C13), U(0xC2B2AE3D27D4EB4B)
_TOP = U(0xFFFFFFFFFFFFFFFF)

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are runs of anything but these bytes.
WHITESPACE = _separators((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class _Powers:
    """base**i and base**-i modulo 2**64, as far as asked for."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self.bases, self.arrays = (base, U(inverse)), [np.ones(1, U), np.ones(1, U)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.arrays[0]) < n:
            size = max(n, CHUNK + 4096)
            grown = []
            for base in self.bases:
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            if size > 8 * CHUNK:
                return grown
            self.arrays = grown
        return self.arrays


_BYTE_POWERS, _WORD_POWERS = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit reaches each output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Words:
    """The words of some texts. starts, ends: byte places in data; first[d]..first[d+1]: the words of text d."""

    def __init__(self, texts: pa.Array, separators: np.ndarray, lower: bool = False):
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        buffers = texts.buffers()
        places = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        raw = raw[places[0] : places[-1]]
        self.places = places - places[0]
        self.data = _LOWER[raw] if lower else raw
        inside = ~separators[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.places[(self.places > 0) & (self.places < len(raw))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.places)
        self.counts = np.diff(self.first)
        self.n = n
        self._hashes: np.ndarray | None = None
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            powers, inverse = _BYTE_POWERS.upto(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, U)
            np.cumsum(_BYTE[self.data] * powers[: len(self.data)], out=sums[1:])
            self._hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))
        return self._hashes

    def spans(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the windows of these lengths that start at words `at`; the caller keeps them inside a text."""
        powers, inverse = _WORD_POWERS.upto(len(self) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self) + 1, U)
            np.cumsum(self.hashes * powers[: len(self)], out=self._sums[1:])
        return mix((self._sums[at + length] - self._sums[at]) * inverse[at] + np.asarray(length, dtype=np.int64).astype(U) * U(0x2545F4914F6CDD1D))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k words, text borders ignored; empty if there are fewer words."""
        n = len(self) - k + 1
        return self.spans(np.arange(n), k) if n > 0 else np.zeros(0, U)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def fits(self, k: int) -> np.ndarray:
        """For windows(k): whether the window lies in one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], self.counts)[:n]
        return np.arange(n) + k <= last

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with a space before and after each text's words and one between them, texts apart by two; and the place
        of the space behind each word."""
        last = np.zeros(len(self), np.int64)
        last[self.first[1:][self.counts > 0] - 1] = 1
        sizes = self.ends - self.starts
        spaces = 1 + np.cumsum(sizes + 1 + last) - 1 - last  # one at the very beginning
        out = np.full(1 + int((sizes + 1 + last).sum()), 32, np.uint8)
        heads = spaces - sizes
        at = np.repeat(heads - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        source = np.repeat(self.starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        out[at] = self.data[source]
        return out.tobytes(), spaces


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each `width` consecutive values, by doubling."""
    pick = np.minimum if least else np.maximum
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return out[:n] if size == width else pick(out[:n], out[width - size : width - size + n])


class Sketch:
    """Content-selected phrases: in each window of `window` words the phrases of `k` words with the least hash.

    low[i] is that least hash for the window starting at word i (windows that cross texts are not `whole`); `chosen` marks
    the words at which a selected phrase starts. Selection depends on the window's words alone.
    """

    def __init__(self, words: Words, k: int, window: int):
        self.k, self.window, self.width = k, window, window - k + 1
        self.grams = words.windows(k)
        self.low = sliding(self.grams, self.width)
        self.whole = words.fits(window)
        bound = np.where(self.whole, self.low, U(0))
        padded = np.concatenate([np.zeros(self.width - 1, U), bound, np.zeros(self.width - 1, U)])
        high = sliding(padded, self.width, least=False)[: len(self.grams)]
        self.chosen = np.zeros(len(self.grams), bool)
        self.chosen[: len(high)] = (self.grams[: len(high)] == high) & (high > 0)


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `size` bytes of text."""
    if batch.num_rows == 0:
        return
    texts = batch.column(column)
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(places, places[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
