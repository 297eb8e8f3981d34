"""Exact BM25 top-k search: sharded inverted index, block-max WAND, exact merge.

Documents are indexed in shards that are written to the shared folder; global counts make the
shards' scores comparable. A shard keeps the largest impact of each term in each block of
BLOCK documents, and all terms' blocks have the same ends, so that the cursors of a query's
terms stand on one block together: its pivot is the next block, at or after the cursors, whose
summed block maxima reach the k-th best score so far. Blocks before the pivot are skipped, the
pivot's postings are scored, the k-th best score rises, and the cursors go on behind it. The
few blocks with the largest sums are scored before the walk, so that it starts with a high k-th
best score; a task also carries each query's k best on to its next shard. The words that very
many of a shard's documents have are scored for many queries at once, as one product of dense
matrices: a block's bound is then the largest of these exact parts and the other words' maxima,
and a pivot reads the postings of the other words alone. A shard's documents
lie in the order of their most frequent word and length, so that blocks are alike and bounds
tight. Tasks' results are merged exactly.
Queries come in broadcast blocks of bounded size, each against all shards.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variora.llm.common import BLOBS, LARGE_ROWS, Words, blob_batches, gather, materialise, shard_keys, shuffle_width, steps, text_buffer, unpack

K1, B, BLOCK = 1.2, 0.75, 64
#: Text bytes of a shard; queries, and their words, of one broadcast block.
SHARD_BYTES, QUERIES, QUERY_WORDS = 12 << 20, 4_000, 2_000_000
#: Bytes after which an Arrow batch ends: a worker holds one or two shards, not its whole split.
BATCH_BYTES = 4 << 20
#: Shards that one task searches at most, unless the session has too few cores for that.
TASK_SHARDS = 64
#: Cells (word, block) of a shard's table of bounds; where BLOCK would make more, blocks are longer.
CELLS = 4 << 20
DIGITS = 6
#: Blocks scored before the walk, and pivots that one step of it scores together.
FIRST_BLOCKS, PIVOTS = 8, 16
#: Words that one in DENSE of a shard's documents has are dense, the commonest DENSE_WORDS at most
#: (others go by postings); queries whose dense words are scored at once.
DENSE, DENSE_WORDS, AT_ONCE = 16, 1_024, 128


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: n documents, their words, and the packed postings."""
    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("_text")).where("doc_id is not null")

    def run(batches):
        parts, size = [], 0

        def shard():
            ids, lengths = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            term, doc, tf = (np.concatenate([p[i] + (at if i == 3 else 0) for p, at in zip(parts, base)]) for i in (2, 3, 4))
            terms, number, df = np.unique(term, return_inverse=True, return_counts=True)
            at = _alike(doc, tf, number, df, lengths)
            place = np.empty(len(at), np.int64)
            place[at] = np.arange(len(at))
            doc = place[doc]
            order = np.argsort(number * len(ids) + doc)
            first = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
            blob = b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in (ids[at], lengths[at], terms, first, doc[order].astype(np.uint32), tf[order].astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int(lengths.sum())]), pa.array([blob], pa.binary())], ["n", "words", "blob"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            buffer, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets):
                words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                terms, number = np.unique(words.hash, return_inverse=True)
                pair, tf = np.unique(words.text_of() * max(1, len(terms)) + number, return_counts=True)
                parts.append((ids[lo:hi], words.count(), terms[pair % max(1, len(terms))], pair // max(1, len(terms)), tf))
                size += int(offsets[hi] - offsets[lo])
                if size > shard_bytes:
                    yield shard()
                    parts, size = [], 0
        if parts:
            yield shard()

    return rows.mapInArrow(run, "n long, words long, blob binary")


def _alike(doc: np.ndarray, tf: np.ndarray, term: np.ndarray, df: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Documents by their most frequent word (the commonest of these) and their length.

    ``doc`` ascends; ``term`` numbers the words and ``df`` counts each one's documents."""
    leader = np.full(len(lengths), -1)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        weight = tf * (int(df.max()) + 1) + df[term]
        best = weight == np.repeat(np.maximum.reduceat(weight, first), np.diff(np.append(first, len(doc))))
        leader[doc[best]] = term[best]
    return np.lexsort((lengths, leader))


def _arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in (np.int64, np.int64, np.uint64, np.int64, np.uint32, np.uint32):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


class Shard:
    def __init__(self, blob: bytes, average: float):
        self.ids, lengths, self.terms, self.first, self.doc, tf = _arrays(blob)
        tf = tf.astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / average)) if len(tf) else tf
        # cell t * blocks + b: the largest impact of word t in block b
        self.size = max(BLOCK, -(-len(self.ids) * len(self.terms) // CELLS))
        self.blocks = -(-len(self.ids) // self.size)
        cell = np.repeat(np.arange(len(self.terms)) * self.blocks, np.diff(self.first)) + self.doc // self.size
        self.bound = np.zeros(len(self.terms) * self.blocks)
        if len(cell):
            piece = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            self.bound[cell[piece]] = np.maximum.reduceat(self.impact, piece)
        self.bound = self.bound.reshape(len(self.terms), self.blocks)
        df = np.diff(self.first)
        dense = np.flatnonzero(df * DENSE >= max(1, len(self.ids)))
        dense = dense[np.argsort(-df[dense], kind="stable")[:DENSE_WORDS]]
        self.column = np.full(len(self.terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(self.ids)))
        postings = _spread(self.first[dense], df[dense])
        self.dense[np.repeat(np.arange(len(dense)), df[dense]), self.doc[postings]] = self.impact[postings]

    def by_dense_words(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each query's scores of all documents by its dense words; a query is its terms and weights."""
        weights = np.zeros((len(queries), len(self.dense)))
        for row, (at, idf) in zip(weights, queries):
            column = self.column[at]
            row[column[column >= 0]] = idf[column >= 0]
        return weights @ self.dense

    def top(self, at: np.ndarray, idf: np.ndarray, scores: np.ndarray, k: int, threshold: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k for terms ``at`` (in the shard) with these weights, of
        documents that score ``threshold`` at least. ``scores``, by the dense words, are added to."""
        sparse = self.column[at] < 0
        at, idf = at[sparse], idf[sparse]
        reach = idf @ self.bound[at] + np.maximum.reduceat(scores, np.arange(0, len(scores), self.size))  # block-max sums
        best, lists = np.zeros(0, np.int64), None
        cursor, primed = 0, False
        while True:
            least = max(threshold - 10.0**-DIGITS, 0.0)
            if primed:
                now = cursor + np.flatnonzero((reach[cursor:] > 0) & (reach[cursor:] >= least))[:PIVOTS]
                if not len(now):
                    break
                cursor = int(now[-1]) + 1
            else:
                now = np.argpartition(-reach, FIRST_BLOCKS)[:FIRST_BLOCKS] if len(reach) > FIRST_BLOCKS else np.arange(len(reach))
                now = now[(reach[now] > 0) & (reach[now] >= least)]
                primed = True
                if not len(now):
                    break
            reach[now] = 0.0
            if lists is None:  # the other words are rare: their lists are read whole, once a pivot is met
                size = self.first[at + 1] - self.first[at]
                postings = _spread(self.first[at], size)
                lists = self.doc[postings], np.repeat(idf, size) * self.impact[postings]
            pivot = np.zeros(self.blocks, bool)
            pivot[now] = True
            here = pivot[lists[0] // self.size]
            scores += np.bincount(lists[0][here], lists[1][here], len(scores))
            docs = (now[:, None] * self.size + np.arange(self.size)).ravel()
            docs = docs[docs < len(self.ids)]
            best = np.concatenate([best, docs[scores[docs] > least]])
            rounded = np.round(scores[best], DIGITS)
            best = best[np.lexsort((self.ids[best], -rounded))[:k]]
            if len(best) == k:
                threshold = max(threshold, scores[best].min())
        return self.ids[best], np.round(scores[best], DIGITS)


def search(documents: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", query_id: str = "doc_id", query_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, doc_id, score, rank: the best k documents of each query by BM25.

    A query's words count once each. Scores are rounded to DIGITS digits; ties go to the
    smaller id. Only documents that share a word are found, so empty queries have no rows.
    Ids are integers (whatever casts to one; others end the job). Rows without id are neither
    found nor asked for. Rows that share one are found, and asked for, each by its own text
    under that id, and the best k are those of all of them together. Sets the session's Arrow
    batches to BATCH_BYTES.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    index = materialise(build_index(documents, id_column, text_column, shard_bytes), "bm25", LARGE_ROWS)
    totals = index.agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("shards")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-totals["shards"] // TASK_SHARDS))
    total, average = totals["n"] or 0, (totals["words"] or 0) / max(1, totals["n"] or 0) or 1.0
    asked = queries.select(queries[query_id].cast("long").alias("q"), queries[query_text].cast("string").alias("t")).where("q is not null and t is not null")
    asked = materialise(asked, "asked")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("c")).first()
    blocks = max(1, -(-size["n"] // QUERIES), -(-int(size["c"] or 0) // (6 * QUERY_WORDS)))
    width = shuffle_width(spark)
    keys = shard_keys(width)
    found = []
    for b in range(blocks):
        rows = sorted((r["q"], r["t"]) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect())
        if not rows:
            continue
        buffer, offsets = text_buffer(pa.array([t for _, t in rows], pa.large_string()))
        sets = []
        for lo, hi in steps(offsets):
            words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sets += [np.unique(words.hash[x:y]) for x, y in zip(words.first[:-1], words.first[1:])]
        terms = np.unique(np.concatenate(sets))
        if not len(terms):
            continue
        number: dict[bytes, int] = {}  # queries of the same words are one
        which = np.array([number.setdefault(s.tobytes(), len(number)) for s in sets])
        distinct = [np.searchsorted(terms, np.frombuffer(s, np.uint64)).astype(np.int32) for s in number]
        plan = spark.sparkContext.broadcast((np.array([q for q, _ in rows]), terms, which, distinct))
        parts = np.arange(len(terms)) * width // len(terms)

        def count(batches, plan=plan, parts=parts):
            terms = plan.value[1]
            df = np.zeros(len(terms), np.int64)
            for batch in batches:
                for blob in batch.column(0):
                    _, _, own, first, _, _ = _arrays(blob.as_buffer().to_pybytes())
                    at = np.searchsorted(own, terms).clip(0, max(len(own) - 1, 0))
                    if len(own):
                        df += np.where(own[at] == terms, first[at + 1] - first[at], 0)
            some = np.flatnonzero(df)
            yield blob_batches(parts[some], keys, [some, df[some]])

        def add(batches):
            for at, n in gather(batches, [np.int64, np.int64]).values():
                low, high = int(at.min()), int(at.max()) + 1
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([np.bincount(at - low, n, high - low).astype(np.int64).tobytes()], pa.binary())], ["low", "df"])

        df = np.zeros(len(terms), np.int64)
        for r in index.select("blob").mapInArrow(count, BLOBS).repartition(width, "shard").mapInArrow(add, "low long, df binary").collect():
            n = np.frombuffer(r["df"], np.int64)
            df[r["low"] : r["low"] + len(n)] += n
        weights = spark.sparkContext.broadcast(np.log(1 + (total - df + 0.5) / (df + 0.5)))

        def ask(batches, plan=plan, weights=weights):
            ids, terms, which, sets = plan.value
            reached, found_ids = np.full((len(sets), k), -1.0), np.zeros((len(sets), k), np.int64)
            for batch in batches:
                for blob in batch.column(0):
                    shard = Shard(blob.as_buffer().to_pybytes(), average)
                    if not len(shard.terms):
                        continue
                    at = np.searchsorted(shard.terms, terms).clip(0, len(shard.terms) - 1)
                    known = shard.terms[at] == terms
                    for i in range(0, len(sets), AT_ONCE):
                        owns = [own[known[own]] for own in sets[i : i + AT_ONCE]]
                        some = [(at[own], weights.value[own]) for own in owns]
                        for (own, idf), part, best, best_ids in zip(some, shard.by_dense_words(some), reached[i:], found_ids[i:]):
                            if len(own):
                                docs, scores = shard.top(own, idf, part, k, best[0])
                                if len(docs):
                                    docs, scores = np.concatenate([best_ids, docs]), np.concatenate([best, scores])
                                    order = np.lexsort((-docs, scores))[-k:]
                                    best[:], best_ids[:] = scores[order], docs[order]
            q, place = np.nonzero((reached > 0)[which])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], found_ids[which[q], place], reached[which[q], place])], ["query_id", "doc_id", "score"])

        found.append(index.select("blob").coalesce(tasks).mapInArrow(ask, "query_id long, doc_id long, score double"))
    if not found:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def oracle_sql(k: int = 10) -> str:
    """DuckDB SQL for the best k documents of each document whose id is divisible by 100."""
    return rf"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
    p AS (SELECT doc_id, t, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
    l AS (SELECT doc_id, coalesce(sum(tf), 0) AS len FROM documents LEFT JOIN p USING (doc_id) GROUP BY doc_id),
    g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM l),
    i AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY t, n),
    s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * p.tf * {K1 + 1} / (p.tf + {K1} * (1 - {B} + {B} * len / a))), {DIGITS}) AS score
          FROM p q JOIN i USING (t) JOIN p USING (t) JOIN l ON l.doc_id = p.doc_id, g WHERE q.doc_id % 100 = 0 GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {k}
    """
