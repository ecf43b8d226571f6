"""Exchanging hashes between groups of documents and buckets of hashes, many per row.

Documents are dealt to groups of a few megabytes by a hash of id and text. A group sends the distinct hashes of its
windows, dealt to buckets by hash, as one binary per bucket; the bucket sees every group's hashes, decides, and replies
in the order sent; the group, joined with the replies, makes its own hashes again and reads the answers. A window that
a third of all documents share so costs a bucket one entry per group, not one per document.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.tables import partitions
from lexquarry.ship import ship

GROUP_BYTES = 3 << 20
LEAST_GROUPS = 48
MOST_TASKS = 100_000
"""What a driver can schedule in a stage: beyond about a terabyte a task works through more groups, one after another."""
SENT = "kind int, b int, g int, body binary"
"""kind: the step of the exchange; b: bucket, g: group; body: packed arrays."""

_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64, np.int64, np.float64)


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<BQ", [np.dtype(k) for k in _KINDS].index(a.dtype), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    at, out = 1 + 9 * raw[0], []
    for i in range(raw[0]):
        kind, n = struct.unpack_from("<BQ", raw, 1 + 9 * i)
        a = np.frombuffer(raw, _KINDS[kind], n, at)
        out.append(a)
        at += a.nbytes
    return out


def groups_for(size: int, group_bytes: int = GROUP_BYTES) -> int:
    return max(1, min(LEAST_GROUPS, -(-size // (1 << 16))), -(-size // group_bytes))


def grouped(docs: DataFrame, n_groups: int, doc_id: str = "doc_id", text: str = "text", flag: Column | None = None) -> DataFrame:
    """g, doc_id, flag, body: rows dealt to groups, texts compressed for the exchange (null: empty)."""

    ship(docs.sparkSession)

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = [z.compress(t.as_buffer()) if t.is_valid else b"" for t in batch.column(3).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(body, pa.binary())], ["g", "doc_id", "flag", "body"])

    kind = docs.schema[doc_id].dataType.simpleString()
    g = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n_groups)).cast("int")
    rows = docs.select(g.alias("g"), F.col(doc_id).alias("doc_id"), (F.lit(False) if flag is None else flag).alias("flag"), F.col(text).alias("text")).mapInArrow(squeeze, f"g int, doc_id {kind}, flag boolean, body binary")
    return rows.repartition(max(partitions(docs.sparkSession), min(n_groups // 3, MOST_TASKS)), "g")


def opened(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids and block of a group, always in the same order: by id, null last, then text."""
    return flagged(table)[:3]


def flagged(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    columns = (table.column(c).to_pylist() for c in ("doc_id", "body", "flag"))
    rows = [(i is None, 0 if i is None else i, z.decompress(b) if b else b"", bool(f)) for i, b, f in zip(*columns, strict=True)]
    rows.sort()
    off = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r[2]) for r in rows], out=off[1:])
    return [None if r[0] else r[1] for r in rows], np.frombuffer(b"".join(r[2] for r in rows), np.uint8), off, np.array([r[3] for r in rows], bool)


def sent(kind: int, g: int, buckets: list[tuple[int, bytes]]) -> pa.Table:
    n = len(buckets)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "b": pa.array([b for b, _ in buckets], pa.int32()), "g": pa.array([g] * n, pa.int32()), "body": pa.array([x for _, x in buckets], pa.binary())})


def dealt(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; buckets are equal ranges of keys."""
    return np.searchsorted(keys, np.array([-(-(b << 64) // n_buckets) for b in range(n_buckets)], np.uint64)).tolist() + [len(keys)]


def planes(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as the bytes of their differences, byte by byte: the upper ones are zeros and pack to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()


def keys_of(planes_: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes_.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def replies(table: pa.Table, kind: int) -> dict[int, list[np.ndarray]]:
    """The arrays that each bucket replied in this step."""
    return {b: unpack(x) for k, b, x in zip(table.column("kind").to_pylist(), table.column("b").to_pylist(), table.column("body").to_pylist(), strict=True) if k == kind}


def answers(got: dict[int, list[np.ndarray]], cuts: list[int], which: int = 0) -> np.ndarray:
    """What was replied for each sorted key."""
    parts = [got[b][which] for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def bits(got: dict[int, list[np.ndarray]], cuts: list[int]) -> np.ndarray:
    """The same for replies of packed bits and their number."""
    return answers({b: [np.unpackbits(x[0], count=int(x[1][0]))] for b, x in got.items()}, cuts).astype(bool)


def bits_reply(table: pa.Table, kind: int, parts: list[np.ndarray]) -> pa.Table:
    """A row of bits for each row that was sent."""
    return pa.table({"kind": pa.array([kind] * table.num_rows, pa.int32()), "b": table.column("b"), "g": table.column("g"), "body": pa.array([pack(np.packbits(p), np.array([len(p)], np.int64)) for p in parts], pa.binary())})


def split(values: np.ndarray, sizes) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])
