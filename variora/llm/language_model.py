"""N-gram language model in a sharded Elias-Fano trie on shared storage.

Level 1 holds the words (sorted hashes), level 2 each context's successors. A level is a set
of bit-packed arrays in one file a shard, memory-mapped by the tasks that query it:

* sorted keys in Elias-Fano form (low bits packed, high bits in unary with select directories);
* monotone pointers from a context to its successors, in Elias-Fano form;
* exact counts of words, packed; quantised smoothed log probabilities of successors, packed.

A successor is searched relative to its context: the pointers give the context's range of
level 2, and the word is searched inside that range. A context is spread over 16 parts by the
first bits of the successor, so that a very frequent word doesn't fill one shard.

Smoothing is Dirichlet interpolation: p(w|u) = (c(uw) + MU p(w)) / (c(u) + MU), with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); a successor that wasn't met has MU p(w) / (c(u) + MU).
The words are counted in a first pass over the texts and the pairs in a second, which can so
look up what their smoothed probabilities need.

The files lie in the folder of spark.checkpoint.dir. Where that is a mounted folder they are
mapped in place; from another store a task copies those that it asks for and maps the copies.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from variora.llm.common import BLOBS, Words, blob_batches, gather, mix, shard_keys, shard_of, shared_dir, shuffle_width, steps, text_buffer, unmix

MU, ADDED = 500.0, 0.1
PROBABILITY_BITS = 12
_LOWEST = -10.0  # log10 of the smallest share that is told apart
_STEP = 4 << 20
END, BEGIN = np.uint64(0xE2D0000000000001), np.uint64(0xB050000000000001)
_W40 = np.uint64((1 << 40) - 1)
_SELECT = np.array([[[i for i in range(8) if not b >> i & 1][j] if j < 8 - bin(b).count("1") else 0 for j in range(8)] for b in range(256)], np.uint8)
_SELECT_ONE = np.array([[[i for i in range(8) if b >> i & 1][j] if j < bin(b).count("1") else 0 for j in range(8)] for b in range(256)], np.uint8)
_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)


# ---------------------------------------------------------------- packed arrays


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Fixed-width bit packing into 64-bit words, one spare word at the end."""
    out = np.zeros((len(values) * bits + 63) // 64 + 2, np.uint64)
    if not bits or not len(values):
        return out
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    values = values.astype(np.uint64)
    low = values << shift
    new = np.concatenate([[True], word[1:] != word[:-1]])
    first = np.flatnonzero(new)
    out[word[first]] |= np.bitwise_or.reduceat(low, first)
    over = np.flatnonzero(shift + np.uint64(bits) > 64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


class EliasFano:
    """A sorted sequence of integers below 2^``top``."""

    def __init__(self, arrays: dict, name: str):
        self.n, self.low_bits, self.top = (int(x) for x in arrays[f"{name}.head"])
        self.low, self.high, self.zeros, self.ones = (arrays[f"{name}.{x}"] for x in ("low", "high", "zeros", "ones"))

    @staticmethod
    def build(values: np.ndarray, top: int, name: str) -> dict:
        n = len(values)
        low_bits = max(0, top - max(1, int(n).bit_length()))
        values = values.astype(np.uint64)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        buckets = 1 << (top - low_bits)
        bits = np.zeros((n + buckets + 1 + 63) // 64 * 64 + 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(_ZEROS[packed].reshape(-1, 8).sum(1, dtype=np.int64))])
        return {f"{name}.head": np.array([n, low_bits, top]), f"{name}.low": pack(values & np.uint64((1 << low_bits) - 1), low_bits), f"{name}.high": packed, f"{name}.zeros": zeros, f"{name}.ones": 64 * np.arange(len(zeros)) - zeros}

    def _bit(self, k: np.ndarray, directory: np.ndarray, flip: int, select: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (``flip`` 0) or one (``flip`` 255) of the unary part."""
        word = np.searchsorted(directory, k, "right") - 1
        left = k - directory[word]
        byte = word * 8
        for _ in range(7):
            z = _ZEROS[self.high[byte] ^ flip]
            go = left >= z
            left = np.where(go, left - z, left)
            byte = np.where(go, byte + 1, byte)
        # a byte passed over stays passed: once left < z it never moves again
        return byte * 8 + select[self.high[byte], left]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th value."""
        high = self._bit(i, self.ones, 255, _SELECT_ONE) - i
        return (high << self.low_bits) | unpack(self.low, self.low_bits, i).astype(np.int64)

    def range_of(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi = self._bit(bucket, self.zeros, 0, _SELECT) - bucket
        lo = np.where(bucket > 0, self._bit(np.maximum(bucket - 1, 0), self.zeros, 0, _SELECT) - bucket + 1, 0)
        return lo, hi

    def find(self, q: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | None = None) -> np.ndarray:
        """Index of each q, or -1; of indices from ``low`` to before ``high`` alone."""
        if not self.n or not len(q):
            return np.full(len(q), -1, np.int64)
        q = q.astype(np.uint64)
        lo, end = self.range_of((q >> np.uint64(self.low_bits)).astype(np.int64))
        lo = np.maximum(lo, low)
        end = end if high is None else np.maximum(np.minimum(end, high), lo)
        hi, want = end.copy(), q & np.uint64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpack(self.low, self.low_bits, mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = lo < end
        hit[hit] = unpack(self.low, self.low_bits, lo[hit]) == want[hit]
        return np.where(hit, lo, -1)

    def all(self) -> np.ndarray:
        bits = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((bits - i).astype(np.uint64) << np.uint64(self.low_bits)) | unpack(self.low, self.low_bits, i)


# ---------------------------------------------------------------- files


def _store(folder: str):
    """(file system, path) of a folder; no file system where it is mounted."""
    scheme, _, path = folder.partition("://") if "://" in folder else ("file", "", folder.removeprefix("file:"))
    if scheme == "file":
        return None, path
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def make_folder(folder: str) -> None:
    store, path = _store(folder)
    os.makedirs(path) if store is None else store.create_dir(path)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, put in place at once, so that a repeated task does no harm."""
    head, at, parts = {}, 0, []
    for key, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[key] = (a.dtype.str, len(a), at)
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(parts[-1])
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    store, path = _store(folder)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") if store is None else store.open_output_stream(own) as f:
        f.write(len(top).to_bytes(8, "little") + top + b"".join(parts))
    os.replace(own, f"{path}/{name}") if store is None else store.move(own, f"{path}/{name}")


@lru_cache(1)
def _copies() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory()


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    store, path = _store(folder)
    file = f"{path}/{name}"
    if store is not None:  # a task's own copy: no other task looks for it
        own = os.path.join(_copies().name, f"{os.path.basename(path)}-{name}")
        with store.open_input_stream(file) as f, open(own, "wb") as out:
            while chunk := f.read(1 << 22):
                out.write(chunk)
        file = own
    raw = np.memmap(file, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {key: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for key, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


@lru_cache(4096)
def _level1(folder: str, shard: int) -> tuple[EliasFano, np.ndarray, int]:
    arrays = map_arrays(folder, f"words-{shard}")
    return EliasFano(arrays, "keys"), arrays["counts"], int(arrays["width"][0])


@lru_cache(4096)
def _level2(folder: str, shard: int) -> tuple[EliasFano, EliasFano, EliasFano, np.ndarray]:
    arrays = map_arrays(folder, f"pairs-{shard}")
    return EliasFano(arrays, "contexts"), EliasFano(arrays, "pointers"), EliasFano(arrays, "successors"), arrays["log"]


def _by_shard(h: np.ndarray, shards: int):
    """(shard, places in h) with the places in hash order."""
    order = np.argsort(h)
    cuts = np.searchsorted(shard_of(h[order], shards), np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def word_counts(folder: str, shards: int, words: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(words, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    cuts = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        keys, counts, width = _level1(folder, s)
        at = keys.find(distinct[cuts[s] : cuts[s + 1]])
        out[cuts[s] : cuts[s + 1]] = np.where(at >= 0, unpack(counts, width, np.maximum(at, 0)).astype(np.int64), 0)
    return out[back]


_SPREAD = np.uint64(0x9FB21C651E98DF25)


def _context(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Part of u's successors that w is in: 64 bits, spread over all shards."""
    return mix(u ^ (w >> np.uint64(60)) * _SPREAD)


def _first_word(context: np.ndarray, w: np.ndarray) -> np.ndarray:
    """u of ``_context(u, w)``."""
    return unmix(context) ^ (w >> np.uint64(60)) * _SPREAD


def pair_probabilities(folder: str, shards: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 p(w|u) of the pairs that were met; 0 for others."""
    out = np.zeros(len(word))
    low = (word >> np.uint64(20)) & _W40
    for s, at in _by_shard(context, shards):
        contexts, pointers, successors, log = _level2(folder, s)
        rank = contexts.find(context[at])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            continue
        begin, end = pointers.get(rank), pointers.get(rank + 1)
        i = successors.find((rank.astype(np.uint64) << np.uint64(40)) | low[at], begin, end)
        out[at[i >= 0]] = _value(unpack(log, PROBABILITY_BITS, i[i >= 0]))
    return out


def _quantised(log: np.ndarray) -> np.ndarray:
    top = (1 << PROBABILITY_BITS) - 1
    return np.clip(np.round(log / _LOWEST * top), 1, top).astype(np.uint64)


def _value(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) / ((1 << PROBABILITY_BITS) - 1) * _LOWEST


# ---------------------------------------------------------------- model


class Trie:
    """Where a finished model is, and its totals."""

    def __init__(self, folder: str, shards: int, tokens: int, types: int, texts: int, mu: float):
        self.folder, self.shards, self.tokens, self.types, self.texts, self.mu = folder, shards, tokens, types, texts, mu


def _tokens(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with one END after each text, where each text begins)."""
    words = Words(buffer, offsets)
    n = len(offsets) - 1
    out = np.full(len(words.hash) + n, END)
    out[np.arange(len(words.hash)) + words.text_of()] = words.hash
    return out, words.first[:-1] + np.arange(n)


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[first] = BEGIN
    return out


def _merge(keys: list[np.ndarray], counts: np.ndarray, exact: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Sum the counts of equal keys (major key first)."""
    if not len(counts):
        return keys, counts
    if len(keys) == 1:
        order = np.argsort(keys[0])
    elif exact:
        order = np.lexsort((keys[1], keys[0]))
    else:  # one sort; a few equal pairs may stay apart
        order = np.argsort((keys[0] & np.uint64(0xFFFFFFFF00000000)) | (keys[1] >> np.uint64(32)))
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first)


def _counts(rows: DataFrame, keys_of, parts: int, shards: int, keys: np.ndarray) -> DataFrame:
    """Blobs of the distinct keys of all texts and their counts, by shard of the first key.
    keys_of: (word before, word) to the keys' arrays."""

    def count(batches):
        held: list = []

        def flush():
            merged, n = _merge([np.concatenate([h[i] for h in held]) for i in range(parts)], np.concatenate([h[-1] for h in held]), exact=False)
            held.clear()
            yield blob_batches(shard_of(merged[0], shards), keys, [*merged, n.astype(np.uint32)])

        for batch in batches:
            buffer, offsets = text_buffer(batch.column(0))
            for lo, hi in steps(offsets, _STEP):
                tokens, first = _tokens(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                own, n = _merge(keys_of(_before(tokens, first), tokens), np.ones(len(tokens), np.int64), exact=False)
                held.append((*own, n))
                if sum(len(h[-1]) for h in held) > 2_500_000:
                    yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(count, BLOBS).repartition(shards, "shard")


def _write_words(folder: str, s: int, w: np.ndarray, n: np.ndarray) -> None:
    width = max(1, int(n.max()).bit_length()) if len(n) else 1
    write_arrays(folder, f"words-{s}", EliasFano.build(w, 64, "keys") | {"counts": pack(n, width), "width": np.array([width])})


def _write_pairs(folder: str, s: int, u: np.ndarray, v: np.ndarray, log: np.ndarray) -> None:
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    pointers = np.concatenate([first, [len(u)]]).astype(np.int64)
    rank = np.repeat(np.arange(len(first)), np.diff(pointers))
    successor = (rank.astype(np.uint64) << np.uint64(40)) | ((v >> np.uint64(20)) & _W40)
    arrays = EliasFano.build(u[first], 64, "contexts") | EliasFano.build(pointers, int(len(u)).bit_length() + 1, "pointers")
    arrays |= EliasFano.build(successor, 40 + max(1, int(len(first)).bit_length()), "successors")
    write_arrays(folder, f"pairs-{s}", arrays | {"log": pack(_quantised(log), PROBABILITY_BITS)})


def train(documents: DataFrame, text_column: str = "text", mu: float = MU) -> Trie:
    """Count words and word pairs of all texts (null: empty) and write the trie."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/variora/trie-{uuid.uuid4().hex}"
    make_folder(folder)
    shards = shuffle_width(spark)
    keys = shard_keys(shards)
    shard_with_key = {int(k): i for i, k in enumerate(keys)}
    rows = documents.select(documents[text_column].cast("string").alias("_text"))
    none = np.zeros(0, np.uint64)

    def words(batches):
        for key, (word, c) in gather(batches, [np.uint64, np.uint32]).items():
            (w,), n = _merge([word], c.astype(np.int64))
            _write_words(folder, shard_with_key[key], w, n)
            yield pa.RecordBatch.from_arrays([pa.array([shard_with_key[key]]), pa.array([int(n.sum())]), pa.array([len(n)]), pa.array([int(n[w == END].sum())])], ["shard", "tokens", "types", "texts"])

    counted = _counts(rows, lambda before, tokens: [tokens], 1, shards, keys)
    made = counted.mapInArrow(words, "shard long, tokens long, types long, texts long").collect()  # one row a shard
    for s in set(range(shards)) - {r["shard"] for r in made}:
        _write_words(folder, s, none, none)
    trie = Trie(folder, shards, sum(r["tokens"] for r in made), sum(r["types"] for r in made), sum(r["texts"] for r in made), mu)
    bottom, texts = trie.tokens + ADDED * (trie.types + 1), trie.texts

    def pairs(batches):
        for key, (context, word, c) in gather(batches, [np.uint64, np.uint64, np.uint32]).items():
            (u, v), n = _merge([context, word], c.astype(np.int64))
            del context, word, c
            log = np.empty(len(u))
            for a in range(0, len(u), 1 << 20):
                at = slice(a, a + (1 << 20))
                before = _first_word(u[at], v[at])
                of = np.where(before == BEGIN, texts, word_counts(folder, shards, before))
                word_p = (word_counts(folder, shards, v[at]) + ADDED) / bottom
                log[at] = np.log10((n[at] + mu * word_p) / (of + mu))
            _write_pairs(folder, shard_with_key[key], u, v, log)
            yield pa.RecordBatch.from_arrays([pa.array([shard_with_key[key]])], ["shard"])

    paired = _counts(rows, lambda before, tokens: [_context(before, tokens), tokens], 2, shards, keys)
    for s in set(range(shards)) - {r["shard"] for r in paired.mapInArrow(pairs, "shard long").collect()}:
        _write_pairs(folder, s, none, none, np.zeros(0))
    return trie


def score(documents: DataFrame, trie: Trie, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score: one row for each input row.

    Tokens are the text's words and one end. base_score: log10 probability by word counts
    alone; score: by the trie. A null or empty text is one end. Other columns are dropped.
    """
    rows = documents.select(documents[id_column].alias(id_column), documents[text_column].cast("string").alias("_text"))
    folder, shards, mu = trie.folder, trie.shards, trie.mu
    bottom, texts = trie.tokens + ADDED * (trie.types + 1), trie.texts

    def run(batches):
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(1))
            parts = []
            for lo, hi in steps(offsets, _STEP):
                tokens, first = _tokens(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                c = word_counts(folder, shards, tokens)
                word = (c + ADDED) / bottom
                of = np.empty_like(c)
                of[1:] = c[:-1]
                of[first] = texts
                before = _before(tokens, first)
                log = pair_probabilities(folder, shards, _context(before, tokens), tokens)
                log = np.where(log < 0, log, np.log10(mu * word / (of + mu)))
                parts.append((np.diff(np.concatenate([first, [len(tokens)]])), np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(word), first), np.add.reduceat(log, first)))
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*parts))], [id_column, "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
