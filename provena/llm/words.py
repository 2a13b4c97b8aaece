"""Word streams as arrays: exact word splits, stable 64-bit word hashes,
rolling hashes of word windows.

Everything here works inside a task on one document at a time; Spark deals out
the documents.  Hashes are the same on every worker (xxHash64 of the UTF-8
bytes), so they can be shuffle keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from .tokens import forget

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)

#: For the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: every other ASCII byte becomes a space.
_ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def space_words(text: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 bytes (bytes.split() splits at exactly these)."""
    return text.split() if text else []


def lower_space_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    r"""Lower-cased (A-Z) words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of UTF-8 bytes."""
    return text.lower().translate(_ALNUM).split() if text else []


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class WordHasher:
    """Word -> 64-bit hash with a bounded memo.  A task that begins with one frees what tasks of other kinds left in the worker."""

    def __init__(self, limit: int = 500_000):
        forget()
        self.limit, self.memo = limit, _Memo()

    def __reduce__(self) -> tuple:
        return WordHasher, (self.limit,)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.limit:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Windows:
    """Hashes of all windows of ``k`` words, by prefix sums modulo 2**64."""

    def __init__(self):
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(U64(1), np.full(2 * n, BASE, U64)), dtype=U64)
                self.down = np.cumprod(np.append(U64(1), np.full(2 * n, _INVERSE, U64)), dtype=U64)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._grow(len(h) + 1)
        return np.concatenate([np.zeros(1, U64), np.cumsum(h * self.up[: len(h)], dtype=U64)])

    def between(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words start:end, given the prefix sums."""
        return mix((p[end] - p[start]) * self.down[start] + (end - start).astype(U64))

    def all(self, h: np.ndarray, k: int) -> np.ndarray:
        if len(h) < k:
            return np.zeros(0, U64)
        at = np.arange(len(h) - k + 1)
        return self.between(self.prefix(h), at, at + k)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


Batches = Iterator[pa.RecordBatch]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Batches], Batches]:
    """mapInArrow function that applies ``f`` to every batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return run


def pressed(x: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def released(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
