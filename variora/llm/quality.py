"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A text is read as units (runs of letters, of digits, of other signs) and one shape mark a
word (case, signs at its end, repetition of the word before). Every unit has a sparse random
index vector; a unit's word vector is its index vector plus the summed index vectors of its
neighbours in the labelled sample. The mean word vector of a text goes through a two-layer
network whose probability is calibrated with a temperature on held-back sample rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variora.llm.common import LOWER, _IS_WORD, crc_mod, mix, prefix_hashes, steps, text_buffer

#: Bound of the fit: labelled documents, which are learned whole. Rarer units than LEAST in them
#: have no vector of their own.
SAMPLE_ROWS, LEAST = 2_000, 3
DIMENSIONS, HIDDEN, SEED = 64, 32, 17
EPOCHS, BATCH = 40, 64
_STEP, _FIT_STEP = 1 << 18, 1 << 20

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 sign
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_ALPHA = (_CLASS == 1).astype(np.int32)
_SIGN = (_CLASS == 3).astype(np.int32)


def units(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit hashes, first): ``first[i]:first[i+1]`` are text i's units and shape marks, each
    word's mark after its units."""
    n = len(buffer)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[buffer]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    sums, inverse = prefix_hashes(LOWER[buffer])
    hashes = mix((sums[end] - sums[start]) * inverse[start])

    word = _IS_WORD[buffer]
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    opens[0], closes[-1] = word[0], word[-1]
    opens[1:] = word[1:] & (word[:-1] ^ 1)
    closes[:-1] = word[:-1] & (word[1:] ^ 1)
    inner = offsets[(offsets > 0) & (offsets < n)]
    opens[inner] |= word[inner] == 1
    closes[inner - 1] |= word[inner - 1] == 1
    ws, we = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up = np.concatenate([[0], np.cumsum(_UPPER[buffer])])
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[buffer])])
    sign = np.concatenate([[0], np.cumsum(_SIGN[buffer])])
    ups, alphas, signs = up[we] - up[ws], alpha[we] - alpha[ws], sign[we] - sign[ws]
    whole = (sums[we] - sums[ws]) * inverse[ws]
    same = np.zeros(len(ws), np.int64)
    if len(ws) > 1:
        same[1:] = whole[1:] == whole[:-1]
        doc = np.searchsorted(offsets, ws, "right")
        same[1:] &= doc[1:] == doc[:-1]
    shape = (alphas > 0) + 2 * ((alphas > 1) & (2 * ups > alphas)) + 4 * np.minimum(signs, 3) + 16 * same
    marks = mix(shape.astype(np.uint64) + np.uint64(0x5F0E))

    at = np.concatenate([start, we - 1])
    order = np.argsort(at * 2 + np.concatenate([np.zeros(len(start), np.int64), np.ones(len(ws), np.int64)]), kind="stable")
    return np.concatenate([hashes, marks])[order], np.searchsorted(at[order], offsets)


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary vectors read from the hash: four places and their signs, +1 or -1."""
    bits = (hashes[:, None] >> (np.uint64(12) * np.arange(4, dtype=np.uint64))) & np.uint64(0xFFF)
    return (bits % np.uint64(DIMENSIONS)).astype(np.int64), np.where(bits >> np.uint64(11), 1, -1).astype(np.float32)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), DIMENSIONS), np.float32)
    places, signs = index_entries(hashes)
    np.add.at(out, (np.arange(len(hashes))[:, None], places), signs)
    return out


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray  # one more row than words: the vector of unknown units
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def pooled(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean word vector of each text; zero without units."""
        out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
        for lo, hi in steps(offsets, _STEP):
            hashes, first = units(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(hashes) == 0:
                continue
            at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
            at = np.where(self.words[at] == hashes, at, len(self.words)) if len(self.words) else np.zeros(len(hashes), np.int64)
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            for a in range(0, len(some), 64):  # bounds the memory of the gathered vectors
                rows = some[a : a + 64]
                b, e = first[rows[0]], first[rows[-1] + 1]
                sums = np.zeros((len(rows), DIMENSIONS), np.float32)
                for c in range(b, e, 1 << 15):
                    d = min(c + (1 << 15), e)
                    i, j = np.searchsorted(first[rows], c, "right") - 1, np.searchsorted(first[rows], d, "left")
                    cuts = np.maximum(first[rows[i:j]], c) - c
                    sums[i:j] += np.add.reduceat(self.vectors[at[c:d]], cuts, axis=0)
                out[lo + rows] = sums / counts[rows, None]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        x = np.clip((features - self.centre) / self.scale, -8, 8).astype(np.float64)
        z = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fit on texts and 0/1 labels; one class alone gives a constant score."""
    empty = np.zeros(0, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros((1, DIMENSIONS), np.float32), empty, empty, empty, empty, empty, 0.0, 1.0, float(labels.mean()) if len(labels) else 0.5)
    buffer, offsets = text_buffer(pa.array(texts, pa.string()))
    # step by step, so that only the counts grow with the sample
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo, hi in steps(offsets, _FIT_STEP):
        own, n = np.unique(units(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0], return_counts=True)
        words, back = np.unique(np.concatenate([words, own]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(words)).astype(np.int64)
    words = words[counts >= LEAST]
    index = np.vstack([index_vectors(words), np.zeros((1, DIMENSIONS), np.float32)])
    places, signs = (np.vstack([x, np.zeros((1, 4), x.dtype)]) for x in index_entries(words))
    context = np.zeros((len(words) + 1) * DIMENSIONS, np.float32)
    for lo, hi in steps(offsets, _FIT_STEP):
        stream, first = units(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        at = np.searchsorted(words, stream).clip(0, max(len(words) - 1, 0))
        at = np.where(words[at] == stream, at, len(words)) if len(words) else np.zeros(len(stream), np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for gap in (1, 2):
            near = doc[gap:] == doc[:-gap]
            for one, other in ((at[:-gap][near], at[gap:][near]), (at[gap:][near], at[:-gap][near])):
                for i in range(4):
                    context += np.bincount(one * DIMENSIONS + places[other, i], signs[other, i], len(context))
    context = context.reshape(-1, DIMENSIONS)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = index + np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    vectors[-1] = index_vectors(np.array([0x1234567890ABCDEF], np.uint64))[0]  # all units that the sample lacks
    model = Model(words, vectors.astype(np.float32), empty, empty, empty, empty, empty, 0.0, 1.0)
    x = model.pooled(buffer, offsets).astype(np.float64)
    y = labels.astype(np.float64)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    model.centre, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    w = [rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    z_fit, y_fit, step = z[fit], y[fit], 0
    for _ in range(EPOCHS):  # batches small enough for one BLAS thread: tasks may hold the other cores
        shuffled = rng.permutation(len(fit))
        for part in np.array_split(shuffled, max(1, len(fit) // BATCH)):
            step += 1
            x_part = z_fit[part]
            hidden = np.tanh(x_part @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30)))
            g = (p - y_fit[part]) / len(part)
            back = np.outer(g, w[2]) * (1 - hidden**2)
            grads = [x_part.T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ g + 1e-4 * w[2], np.array([g.sum()])]
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d**2
                w[i] -= 0.005 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = w[0], w[1], w[2], float(w[3][0])
    if len(held):
        logits = np.tanh(z[held] @ w[0] + w[1]) @ w[2] + w[3]
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(documents: DataFrame, labels: DataFrame, held_out_modulus: int | None = 5, rows: int = SAMPLE_ROWS, label: str = "quality") -> Model:
    """Fit on at most ``rows`` labelled documents, whole (those first in the order of a hash of
    their id), none of them held out (crc32(doc_id) mod ``held_out_modulus`` = 0).

    Labels other than 0 and 1, and labels without id, count as none. An id with both labels has
    0, and one with several texts the first of them in byte order. Ids of any type will do.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    if held_out_modulus:
        known = known.where(crc_mod("doc_id", held_out_modulus) != 0)
    chosen = known.groupBy("doc_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    schema = T.StructType([T.StructField("doc_id", known.schema["doc_id"].dataType), T.StructField("_y", T.IntegerType())])
    chosen = documents.sparkSession.createDataFrame(chosen.collect(), schema)
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    sample = documents.select(documents["doc_id"].alias("doc_id"), text.alias("_text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).collect()
    sample.sort(key=lambda r: (str(r["doc_id"]), r["_text"]))
    return train([r["_text"] for r in sample], np.array([r["_y"] for r in sample], np.int64))


def score_quality(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` (probability of label 1) and ``predicted`` added, or in place
    of columns of these names.

    One row for each input row, repeated ids included; a null or empty text is scored as a text
    without words. Other columns stay, whatever their names.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    documents = documents.drop("score", "predicted")
    names, at = documents.columns, documents.columns.index("text")
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])  # any name will do: a dot, a hyphen

    def run(batches):
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(at).cast(pa.string()))
            score = shared.value.score(shared.value.pooled(buffer, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return plain.mapInArrow(run, schema).toDF(*names, "score", "predicted")
