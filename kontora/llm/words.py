"""Words of Arrow text batches as numpy arrays: places and 64-bit fingerprints, for whole batches at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 2_000_000
#: Words of more bytes are hashed one by one.
LONG = 256
U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser); differs by salt."""
    x = x + U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=8)
def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(count, b, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2^64."""
    size = 1 << max(12, (count - 1).bit_length())
    return _powers(base, size) if size <= 1 << 22 else _powers.__wrapped__(base, size)


class Ranges:
    """Fingerprints of any run of values of an array, by running sums of a polynomial modulo 2^64.

    Values built for it can collide under every base, so what it finds has to be compared.
    """

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(WORD_BASE))


#: Two primes below 2^31, and a base for each, drawn once.
PRIMES, BASES = (2147483647, 2147483629), (1270891123, 1804289383)


@lru_cache(maxsize=8)
def _prime_powers(prime: int, base: int, count: int) -> np.ndarray:
    out = np.ones(count, U)
    done = 1
    while done < count:
        step = min(done, count - done)
        out[done : done + step] = out[:step] * U(pow(base, done, prime)) % U(prime)
        done += step
    return out


def prime_powers(prime: int, base: int, count: int) -> np.ndarray:
    """The powers of a base modulo a prime."""
    size = 1 << max(12, (count - 1).bit_length())
    return _prime_powers(prime, base, size) if size <= 1 << 22 else _prime_powers.__wrapped__(prime, base, size)


class Runs:
    """Fingerprints of any run of 64-bit values, by running sums of two polynomials, modulo a prime each (62 bits)."""

    def __init__(self, values: np.ndarray):
        self.sums, self.down = [], []
        for prime, base, part in zip(PRIMES, BASES, (values >> U(33), values & U(0x1FFFFFFFF)), strict=True):
            total = np.zeros(len(values) + 1, U)
            np.cumsum(part % U(prime) * prime_powers(prime, base, len(values) + 1)[: len(values)] % U(prime), out=total[1:])
            self.sums.append(total)
            self.down.append(prime_powers(prime, pow(base, -1, prime), len(values) + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((s[end] - s[start]) % U(p) * d[start] % U(p) for s, d, p in zip(self.sums, self.down, PRIMES, strict=True))
        return mix(((one << U(32)) | two) + mix((end - start).astype(U), 13))


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray  # of the words in data
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words
    doc: np.ndarray  # text of each word

    def fingerprints(self, seed: int, lower: bool = False) -> np.ndarray:
        """One 64-bit value per word, equal for equal bytes (A-Z as a-z where lower).

        A word's eights of bytes go through a mixing step one after the other; long words have a digest of the library's.
        """
        size = self.end - self.start
        out = mix(size.astype(U), seed)
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        eights = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))
        left = np.flatnonzero(size <= LONG)
        at = 0
        while len(left):
            rest = np.minimum(size[left] - at, 8).astype(U)
            chunk = eights[self.start[left] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * rest))
            out[left] = mix((out[left] ^ chunk) * U(WORD_BASE), seed + 61)
            at += 8
            left = left[size[left] > at]
        for k in np.flatnonzero(size > LONG).tolist():
            digest = hashlib.blake2b(data[self.start[k] : self.end[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            out[k] = U(int.from_bytes(digest, "little"))
        return out

    def raw(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def words(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~_WHITE[data]
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, offsets, start, end, first, doc)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a row is never cut."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield batch.slice(begin, k + 1 - begin)
            begin, total = k + 1, 0
    if begin < len(sizes):
        yield batch.slice(begin)
