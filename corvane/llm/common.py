"""Shared pieces: packed shuffles, text hashing, components; tables in the shared folder come from corvane.sources.store.

Packed shuffles.  Operators that move one small number per word would pay far
more for Spark's per-row overhead than for the numbers.  They pack the numbers
of one map task and one bucket into a binary cell, shuffle the cells, and work
on numpy arrays per bucket.  Buckets are hash ranges, so their sizes stay even;
their number follows the input size, so one bucket's arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import BROADCAST_BYTES, discard, materialise, release, shared_dir, sized_broadcast  # noqa: F401

BUCKETS_PER_PARTITION = 8
BYTES_PER_BUCKET = 2 << 20
UNKNOWN_BYTES = 1 << 60  # Catalyst's default for a plan without statistics is near 2**63
LONG_WORD = 64
U64 = np.uint64


def plan_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's size estimate of a plan (the file sizes, for a scan); the bytes of its text column where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def bucket_count(df: DataFrame, text: str = "text") -> int:
    """How many buckets a packed shuffle of this input deals to; grows with the input."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(BUCKETS_PER_PARTITION * parts, min(plan_bytes(df, text) // BYTES_PER_BUCKET, 1 << 22))


# ---------------------------------------------------------------- hashing

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: a bijection of 64-bit words whose bits all depend on all input bits."""
    x = np.asarray(x, dtype=U64)
    out = x >> U64(30)
    out ^= x
    out *= _M1
    rest = out >> U64(27)
    out ^= rest
    out *= _M2
    np.right_shift(out, U64(31), out=rest)
    out ^= rest
    return out


_BYTE = mix64(np.arange(1, 257, dtype=U64)) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U64(0xD6E8FEB86659FD93)
_pow = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse modulo 2**64."""
    if len(_pow["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            _pow[key] = np.cumprod(steps, dtype=U64)
    return _pow["up"], _pow["down"]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash of 64-bit symbols; span_hash() takes any span's hash from it."""
    up, _ = _powers(len(symbols))
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:], dtype=U64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever the span stands."""
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * _STEP)


def gram_hashes(prefix: np.ndarray, size: int, first: int = 0) -> np.ndarray:
    """Hash of the size symbols from each place on, the same wherever they stand, of a part of a prefix hash that begins at symbol `first`."""
    n = max(len(prefix) - size, 0)
    _, down = _powers(first + len(prefix))
    out = prefix[size : size + n] - prefix[:n]
    out *= down[first : first + n]
    return mix64(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets in them; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ([^ \\t-\\r]+) and, for each text, the index of its first word (one more entry at the end)."""
    solid = ~SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased.  A polynomial modulo 2**64 has colliding words of a thousand letters and more
    (Thue-Morse), so words beyond LONG_WORD bytes are hashed otherwise."""
    low = LOWER[raw]
    out = span_hash(prefix_hash(_BYTE[low]), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[starts[i] : ends[i]].tobytes())
    return out


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle, an empty one has none."""
    raw, at = string_buffers(column)
    starts, ends, first = word_spans(raw, at)
    words = word_hashes(raw, starts, ends)
    step = 1
    rolling = np.zeros(max(len(words) - size + 1, 0), U64)
    for k in range(size):
        rolling += words[k : k + len(rolling)] * U64(step)
        step = step * int(_STEP) % (1 << 64)
    rolling = mix64(rolling)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolling[a : b - size + 1])
        elif b > a:
            steps = np.cumprod(np.array([1] + [int(_STEP)] * (b - a - 1), dtype=U64), dtype=U64)
            yield mix64(np.array([(words[a:b] * steps).sum(dtype=U64) ^ U64(0xA5A5 + b - a)], U64))
        else:
            yield np.zeros(0, U64)


def batches_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 21, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts add up to about most_bytes (one row at least)."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            done = int(sizes[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            a = b


# ---------------------------------------------------------------- packing


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def cells(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All cells of a packed column, end to end."""
    return np.concatenate([np.zeros(0, dtype), *cells(column, dtype)])


def deal(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that occurs, with each array's entries of it packed in their order."""
    order = np.argsort(bucket, kind="stable")
    buckets, begins = np.unique(bucket[order], return_index=True)
    ends = np.append(begins, len(order))[1:]
    names, out = ["bucket"], [pa.array(buckets.astype(np.int64))]
    for name, values in arrays.items():
        values = values[order]
        names.append(name)
        out.append(pa.array([pack(values[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=names)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted parallel arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def ranges(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, end to end, and the range that each is of."""
    n = np.maximum(after - first, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + np.repeat(first - (np.cumsum(n) - n), n), owner


class UnionFind:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


# ------------------------------------------------------------- components


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b: long) to (node, root): root is the smallest node that links reach.

    Alternating large-star and small-star rounds, each an aggregate with
    map-side combining and a join that AQE may split on a hot node; the edges
    of a round are written to the shared folder.  Nodes without an edge to
    another node are not listed.
    """
    now = materialise(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("greatest(b, m) AS a", "least(b, m) AS b")
        last, now = now, materialise(small.unionByName(least.selectExpr("a", "m AS b")).distinct(), "edges")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.selectExpr("a AS node", "b AS root").unionByName(now.selectExpr("b AS node", "b AS root").distinct())
