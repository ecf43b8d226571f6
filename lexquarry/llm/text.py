"""Vectorised work on Arrow text columns: slicing into bounded blocks, words, and hashes.

A block is a pair (buf, off): the UTF-8 bytes of some rows, concatenated, and the n + 1 row offsets. Null texts count as
empty. Words are runs of bytes outside SEPARATORS; since these are ASCII, words never cut a UTF-8 character.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
LONG = 64
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_KEY = bytes.fromhex("8f1d6c0b52e94a37c6d5f0a91b7e2348")
_MULT = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def block_of(arr) -> tuple[np.ndarray, np.ndarray]:
    """The block of an Arrow string or binary array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def released() -> None:
    """Gives memory that is free back to the system: a worker waits for its next task with what it needs, not with its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def in_blocks(batches, column: str = "text", limit: int = 1 << 19):
    """The rows of the batches in slices whose text has at most `limit` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = block_of(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    released()


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 word offsets of the rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~IS_SEP[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_MULT)), np.full(n, U(pow(_MULT, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = -(-(n + 1) // (1 << 20)) << 20 if n > 1 << 16 else 1 << 17
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def keyed(strings: list[bytes], salt: int = 0) -> np.ndarray:
    """Two 64-bit hashes of each string: the halves of a keyed BLAKE2b, so that no pattern in the text makes them meet."""
    key = salt.to_bytes(8, "little") + _KEY
    out = b"".join(hashlib.blake2b(s, digest_size=16, key=key).digest() for s in strings)
    return np.frombuffer(out, np.uint64).reshape(-1, 2)


def gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings of bytes."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(buf[at])])


def numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from 0 for each span, the same for equal bytes alone."""
    return gathered(buf, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)


def hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0, halves: int = 1) -> np.ndarray:
    """`halves` 64-bit hashes of each span: eight bytes at a time, mixed after each step; spans over LONG bytes by `keyed`."""
    size = end - start
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    both = np.empty((halves, len(size)), np.uint64)
    out = list(both)
    for k, h in enumerate(out):
        h[:] = mix(size.astype(np.uint64) * U(_MULT) + U(_SEEDS[k]) + U(salt))
    todo, at, every = np.flatnonzero((size > 0) & (size <= LONG)), 0, len(size)
    while len(todo):
        whole = len(todo) == every  # most words are short: spare the indexing of the first step
        rest = size - at if whole else size[todo] - at
        x = eights[start + at] if whole else eights[start[todo] + at]
        x &= U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(8) - np.minimum(rest, 8).astype(np.uint64)))
        for h in out:
            if whole:
                h[:] = mix(h * U(_MULT) + x)
            else:
                h[todo] = mix(h[todo] * U(_MULT) + x)
        todo, at = todo[rest > 8], at + 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = buf.data
        of_long = keyed([raw[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], salt)
        for k, h in enumerate(out):
            h[long] = of_long[:, k]
    return both.T if halves > 1 else both[0]


class Places:
    """Hashes of spans of a block from prefix sums of a polynomial modulo 2**64: to pick places and to deal them, never
    to tell texts apart, as patterns of two strings can be made to meet."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        self.up, self.down = powers(len(buf))
        table = mix(_BYTES + U(salt)) if salt else _BYTES
        self.pre = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * self.up[: len(buf)], out=self.pre[1:])

    def keys(self, width: int) -> np.ndarray:
        """For every place, a key of the `width` bytes from it: their hash above, the place in the lower 32 bits."""
        n = len(self.pre) - width
        out = (self.pre[width:] - self.pre[:n]) * self.down[:n]
        out *= U(0xBF58476D1CE4E5B9)
        out &= U(0xFFFFFFFF00000000)
        out |= np.arange(n, dtype=np.uint64)
        return out

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.pre[end] - self.pre[start]) * self.down[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


PRIME = (1 << 61) - 1


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo 2**61 - 1, both below it."""
    low, p = U((1 << 31) - 1), U(PRIME)
    b = np.asarray(b, np.uint64)
    ah, al, bh, bl = a >> U(31), a & low, b >> U(31), b & low
    mid = ah * bl + al * bh
    x = ((ah * bh) << U(1)) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + al * bl
    x = (x & p) + (x >> U(61))
    return np.where(x >= p, x - p, x)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = times(out[:more], pow(base, have, PRIME))
        have += more
    return out[:n]


class Exact:
    """Two hashes of spans of equal length, each a polynomial modulo 2**61 - 1 at a fixed random base: two different
    strings of m bytes meet in one with probability m / 2**61, whatever their pattern."""

    BASES = tuple(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8, key=_KEY).digest(), "little") % (PRIME - 1000) + 500 for k in range(2))

    def __init__(self, buf: np.ndarray):
        self.parts = []
        for base in self.BASES:
            terms = times(buf.astype(np.uint64) + U(1), _powers_of(base, len(buf)))
            low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64) % U(PRIME)]) for x in (terms & U((1 << 31) - 1), terms >> U(31)))
            pre = low + times(high, 1 << 31)
            self.parts.append((np.where(pre >= U(PRIME), pre - U(PRIME), pre), _powers_of(pow(base, -1, PRIME), len(buf) + 1)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = []
        for pre, down in self.parts:
            x = pre[end] + U(PRIME) - pre[start]
            out.append(mix(times(np.where(x >= U(PRIME), x - U(PRIME), x), down[start])))
        return np.stack(out, 1)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashed neighbours."""
    return mix(a * U(_MULT) + b + U(0xD6E8FEB86659FD93))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; len(h) - k + 1 results. Built from runs of 1, 2, 4, ..., each mixed again."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = mix(part) if out is None else joined(out[: len(part) - done], part[done:])
            done += size
        if size * 2 > k:
            return out[:n]
        part, size = joined(part[: len(part) - size], part[size:]), size * 2


def first_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive keys; len(key) - width + 1 results."""
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    if width >= 16:  # each window is the end of one run of `width` keys and the beginning of the next
        full = -(-len(key) // width) * width
        runs_ = np.full(full, np.iinfo(key.dtype).max, key.dtype)
        runs_[: len(key)] = key
        runs_ = runs_.reshape(-1, width)
        upto = np.minimum.accumulate(runs_, 1).ravel()[width - 1 : width - 1 + n]
        after = np.minimum.accumulate(runs_[:, ::-1], 1)[:, ::-1].ravel()[:n]
        return np.minimum(upto, after)
    out, have = key, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(key) - width + 1], out[width - have : width - have + len(key) - width + 1])
    return out


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, each member's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
