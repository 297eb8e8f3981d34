"""Plumbing shared by the operators: shared storage, text buffers, blob shuffles, components.

Heavy operators here work on whole Arrow batches with numpy. What has to move between
machines is packed into binary *blobs*, one per (map task, shard): Spark shuffles few
large rows, and each reduce task sorts plain integer arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variora.storage import materialise, shared_dir  # noqa: F401  (used through this module)

#: Bytes of text that one vectorised step looks at; a longer text is a step of its own.
STEP_BYTES = 1 << 20


# ---------------------------------------------------------------- shared storage


#: Writer options for rows of several MB: a page holds one of them, a row group a few.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- text buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying the text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = 0
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps_ = np.full(max(n, 1 << 20), base, np.uint64)
            steps_[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps_)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any range of bits can be used as a hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def prefix_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash sums P and inverse powers: the hash of buffer[a:b] is (P[b]-P[a])*inv[a]."""
    n = len(buffer)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[buffer] * power[:n], out=sums[1:])
    return sums, inverse


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased, as 64-bit hashes.

    ``first[i]:first[i+1]`` are the words of text i. ``is_word`` marks other word bytes.
    """

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, lower: bool = True, is_word: np.ndarray = _IS_WORD):
        if lower:
            buffer = LOWER[buffer]
        n = len(buffer)
        word = is_word[buffer]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        if n:
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = offsets[:-1][np.diff(offsets) > 0]
            before[inner] = 0
            after[inner[1:] - 1] = 0
        self.buffer = buffer
        self.start = np.flatnonzero(word & (before ^ 1))
        self.end = np.flatnonzero(word & (after ^ 1)) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums, inverse = prefix_hashes(buffer)
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word; the last n-1 entries are missing."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:total].copy()
    for i in range(1, n):
        h *= _BASE
        h += hashes[i : i + total]
    return mix(h)


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a shorter text is one shingle as a
    whole, one without words has none."""
    all_grams = grams(words.hash, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            h = np.sort(all_grams[a : b - n + 1])
            if len(h) > 1:
                keep = np.empty(len(h), bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                h = h[keep]
            yield h
        elif b > a:
            whole = words.hash[a].copy()
            for x in words.hash[a + 1 : b]:
                whole = (int(whole) * int(_BASE) + int(x)) % (1 << 64)
            yield mix(np.array([(int(whole) + (b - a) * 0x632BE59BD9B4E019) % (1 << 64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


# ---------------------------------------------------------------- blob shuffles


def _murmur_int(value: int, seed: int = 42) -> int:
    """Spark's hash of one INT."""
    m = 0xFFFFFFFF

    def rot(x, r):
        return ((x << r) | (x >> (32 - r))) & m

    k = (rot((value * 0xCC9E2D51) & m, 15) * 0x1B873593) & m
    h = (rot(seed ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def shard_keys(n: int) -> np.ndarray:
    """For each of n shards an INT that Spark's hash partitioner sends to a partition of its
    own, so that shards are dealt out evenly."""
    keys, left, value = np.zeros(n, np.int32), n, 0
    seen = np.zeros(n, bool)
    while left:
        p = _murmur_int(value) % n
        if not seen[p]:
            seen[p], keys[p], left = True, value, left - 1
        value += 1
    return keys


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of a 64-bit hash by its range: shard order is hash order."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


BLOBS = "shard int, blob binary"


def blob_batches(shards: np.ndarray, keys: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One blob row for each shard met: the arrays' entries of that shard, column by column."""
    order = np.argsort(shards.astype(np.int32), kind="stable")
    shards = shards[order]
    cuts = np.flatnonzero(np.diff(shards)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shards)]])
    arrays = [np.ascontiguousarray(a[order]) for a in arrays]
    out_k, out_b = [], []
    if len(shards):
        for a, b in zip(begins.tolist(), ends.tolist()):
            out_k.append(int(keys[shards[a]]))
            out_b.append(b"".join([int(b - a).to_bytes(8, "little"), *(x[a:b].tobytes() for x in arrays)]))
    return pa.RecordBatch.from_arrays([pa.array(out_k, pa.int32()), pa.array(out_b, pa.binary())], ["shard", "blob"])


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        x = np.frombuffer(blob, kind, n, at)
        out.append(x)
        at += x.nbytes
    return out


def gather(batches, kinds: list) -> dict[int, list[np.ndarray]]:
    """All blobs of a partition, joined by shard key."""
    parts: dict[int, list] = {}
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            parts.setdefault(key, []).append(unpack(blob.as_buffer().to_pybytes(), kinds))
    return {k: [np.concatenate(x) for x in zip(*v)] for k, v in parts.items()}


# ---------------------------------------------------------------- removal

#: Ids that are broadcast, 8 bytes each; more are shuffled.
BROADCAST_IDS = 1_000_000


def own_columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever their names hold."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def without(docs: DataFrame, ids: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """``docs`` but for rows whose id is in ``ids`` (one column); a row without id goes if a null
    is among them."""
    ids = materialise(ids.select(F.col(ids.columns[0]).alias("_gone")).distinct(), name)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_column].eqNullSafe(ids["_gone"]), "left_anti")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) for each
    node, component being its smallest node.

    Minimum labels spread along edges and then jump along labels. Every round is written to
    the shared folder. The joins are plain equi-joins, which Spark splits where one node has
    very many edges; the minimum is pre-aggregated.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        spread = labels.join(near, "node").select("node", F.least("label", "m").alias("l"), F.col("label").alias("was"))
        spread = materialise(spread, f"{name}-spread")
        jump = spread.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        labels = materialise(spread.join(jump, "l").select("node", F.col("ll").alias("label"), "was"), f"{name}-labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
