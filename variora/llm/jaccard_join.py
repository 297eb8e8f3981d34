"""N-gram Jaccard join by count-vector R-trees.

1. A text becomes the set of its distinct word n-grams (64-bit hashes); equal sets form a
   class, and one document of each class goes on.
2. Two sets with a Jaccard similarity of t share one of the floor((1-t)n)+1 first hashes of
   each, in any order that all sets follow, so documents meet in blocks, one for each such hash.
   Common shingles come last in that order (by counts of hashed buckets, which decide nothing
   but the order), so that a line that many documents have makes no block where they have others.
   Blocks of one member go.
3. In a block, documents are points: how many of their hashes fall into each of a number of groups (a
   power of two that grows with the set; finer counts are folded onto coarser ones).
   The overlap of two sets is at most the sum of the coordinates' minima. An R-tree over the
   points finds the pairs whose bound reaches t; blocks hand on which documents are joined
   by such pairs, never the pairs.
4. Documents so joined are compared as sets, exactly, each against those not yet reached.
   Large candidate groups are cut into chunks that are compared two by two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variora.llm.common import BLOBS, Words, blob_batches, components, gather, grams, materialise, mix, shard_keys, shard_of, shingle_sets, shuffle_width, steps, text_buffer

#: Hashes a group on average: with more groups for larger sets the bound stays sharp.
PER_GROUP, LEAF = 2, 16
#: Buckets (a power of two) that shingles are counted in; occurrences above a bucket's mean from
#: which it is common (at least, and in roots of that mean); shingles counted at once.
BUCKETS, COMMON, ROOTS, COUNTED = 1 << 20, 64, 6, 1 << 22
#: Documents of a chunk of a block of shared prefix hashes: larger blocks are compared two chunks at a time.
BLOCK_ROWS = 8_192
#: Documents in one chunk of a candidate group; candidates up to this many are broadcast.
CHUNK, BROADCAST_ROWS = 2_000, 500_000


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union, sets being distinct n-grams."""

    words: int = 4
    percent: int = 85

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def sizes_fit(self, a, b):
        """Whether sets of a and b entries can link at all."""
        return (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (a > 0)

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1


# ---------------------------------------------------------------- count vectors


def count_vector(h: np.ndarray) -> np.ndarray:
    """Hashes by group, in bytes; groups follow low bits, as prefixes follow high ones."""
    groups = 1 << max(4, (len(h) // PER_GROUP).bit_length())
    while True:
        counts = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors with as many groups as the shortest has."""
    groups = min(map(len, vectors))
    return np.stack([v if len(v) == groups else v.reshape(-1, groups).sum(0, dtype=np.int32) for v in vectors]).astype(np.int32)


# ---------------------------------------------------------------- R-tree


class CountTree:
    """R-tree over count vectors, packed by size and then by coordinate tiles."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rule: Rule):
        self.rule = rule
        m = len(sizes)
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, int(np.ceil(np.sqrt(m / LEAF))))
        order = order[np.lexsort((points[order, 0], np.arange(m) // slab))]
        self.order = order
        self.points, self.sizes = points[order], sizes[order].astype(np.int64)
        self.levels = []
        high, small, large = self.points, self.sizes, self.sizes
        while len(small) > LEAF:
            cut = np.arange(0, len(small), LEAF)
            high = np.maximum.reduceat(high, cut, axis=0)
            small, large = np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)
            self.levels.append((high, small, large))

    def _may_link(self, level, a, b):
        high, small, large = level
        p = self.rule.percent
        ok = (100 * large[a] >= p * small[b]) & (100 * large[b] >= p * small[a])
        a, b = a[ok], b[ok]
        bound = np.minimum(high[a], high[b]).sum(1, dtype=np.int64)
        ok = (100 + p) * bound >= p * (small[a] + small[b])
        return a[ok], b[ok]

    def pairs(self, at_once: int = 1 << 14):
        """Pairs of points (as given) whose bound allows a link, in parts."""
        leaves = (self.points, self.sizes, self.sizes)
        levels = [leaves, *self.levels]
        top = len(levels) - 1
        n = len(levels[top][1])
        a, b = np.triu_indices(n, 0 if top else 1)
        stack = [(top, a, b)]
        while stack:
            depth, a, b = stack.pop()
            if len(a) > at_once:
                stack += [(depth, a[i : i + at_once], b[i : i + at_once]) for i in range(0, len(a), at_once)]
                continue
            a, b = self._may_link(levels[depth], a, b)
            if not len(a):
                continue
            if depth == 0:
                yield self.order[a], self.order[b]
                continue
            n = len(levels[depth - 1][1])
            step = max(1, at_once // (LEAF * LEAF))
            for i in range(0, len(a), step):
                x = (a[i : i + step, None] * LEAF + np.arange(LEAF)).repeat(LEAF, 1).ravel()
                y = np.tile(b[i : i + step, None] * LEAF + np.arange(LEAF), LEAF).ravel()
                ok = (x < n) & (y < n) & ((x < y) if depth == 1 else (x <= y))
                stack.append((depth - 1, x[ok], y[ok]))


def joined(points: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """For each point the smallest index that it is joined with by pairs that may link."""
    label = np.arange(len(sizes))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in CountTree(points, sizes, rule).pairs():
        x, y = label[a], label[b]
        apart = x != y
        if apart.any():
            for i, j in np.unique(np.stack([x[apart], y[apart]], 1), axis=0).tolist():
                i, j = root(i), root(j)
                if i != j:
                    label[max(i, j)] = min(i, j)
        label = label[label]
    while (label != label[label]).any():
        label = label[label]
    return label


# ---------------------------------------------------------------- exact links


def link_groups(ids: list, sets: list[np.ndarray], rule: Rule) -> list[tuple]:
    """(id, smallest id of those that links reach from it), for ids that have links."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    owners = owner[order].astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = tokens[order][1:] != tokens[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(order))
    at = np.concatenate([[0], np.cumsum(sizes)])
    open_, out = np.ones(m, bool), []
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        group, queue = [seed], [seed]
        while queue:
            d = queue.pop()
            mine = number[at[d] : at[d + 1]]
            lo, n = begin[mine], begin[mine + 1] - begin[mine]
            total = int(n.sum())
            if total == len(mine):  # only its own
                continue
            index = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            common = np.bincount(owners[index], minlength=m)
            near = np.flatnonzero(open_ & (common > 0))
            near = near[rule.linked(common[near], sizes[d], sizes[near])]
            open_[near] = False
            group += near.tolist()
            queue += near.tolist()
        if len(group) > 1:
            first = min(ids[i] for i in group)
            out += [(ids[i], first) for i in group]
    return out


# ---------------------------------------------------------------- the join


def digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two integers."""
    raw = xxhash.xxh3_128_digest(h)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _bucket(h: np.ndarray) -> np.ndarray:
    """The bucket of each hash: its middle bits, as prefixes follow high ones and vectors low ones."""
    return ((h >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def commonness(documents: DataFrame, rule: Rule, text_column: str) -> np.ndarray:
    """For each bucket of shingles 0, or how common they are: the binary logarithm of how often
    they occur above the mean, by the least that counts as common.

    All texts are counted. What falls into one bucket by chance, repeats in one text and copies
    bend the order of shingles only, never a result."""
    width = min(shuffle_width(documents.sparkSession), BUCKETS)
    keys = shard_keys(width)
    part = np.arange(BUCKETS) * width // BUCKETS
    cuts = np.searchsorted(part, np.arange(width + 1))

    def count(batches):
        counts, parts, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(0))
            for lo, hi in steps(offsets):
                words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append(_bucket(grams(words.hash, rule.words)))
                size += len(parts[-1])
                if size >= COUNTED:
                    counts += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    parts, size = [], 0
        if parts:
            counts += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        if counts.any():
            counts = np.minimum(counts, np.iinfo(np.uint16).max).astype(np.uint16)
            blobs = [counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(blob.as_buffer(), np.uint16)
                sums[key] = sums[key] + one if key in sums else one.astype(np.int64)
        for key, n in sums.items():
            mean = n.mean()
            over = (n - mean) / max(COMMON, ROOTS * mean**0.5)
            level = np.where(over > 1, np.ceil(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["shard", "blob"])

    out = np.zeros(BUCKETS, np.uint8)
    at = dict(zip(keys.tolist(), cuts.tolist()))
    texts = documents.select(documents[text_column].cast("string").alias("_text"))
    for r in texts.mapInArrow(count, BLOBS).repartition(width, "shard").mapInArrow(add, BLOBS).collect():
        level = np.frombuffer(r["blob"], np.uint8)
        out[at[r["shard"]] : at[r["shard"]] + len(level)] = level
    return out


def first_hashes(h: np.ndarray, k: int, common: np.ndarray) -> np.ndarray:
    """The first k of ascending hashes, the less common ones before the others."""
    if not common[_bucket(h[:k])].any():
        return h[:k]
    return h[np.argsort(common[_bucket(h)], kind="stable")[:k]]


def signatures(documents: DataFrame, rule: Rule, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n, k1, k2 (digest of the set), prefix and vec (packed) of each row."""
    order = documents.sparkSession.sparkContext.broadcast(commonness(documents, rule, text_column))
    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets):
                words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, k1, k2, prefix, vec = [], [], [], [], []
                for h in shingle_sets(words, rule.words):
                    n.append(len(h))
                    one, two = digest(h)
                    k1.append(one)
                    k2.append(two)
                    prefix.append(first_hashes(h, rule.prefix(len(h)), order.value).tobytes() if len(h) else b"")
                    vec.append(count_vector(h).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefix, pa.binary()), pa.array(vec, pa.binary())],
                    ["doc_id", "n", "k1", "k2", "prefix", "vec"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix binary, vec binary")


def _blocks(reps: DataFrame, rule: Rule) -> DataFrame:
    """(block, doc_id, n): documents that share a prefix hash and whose sizes can fit."""
    shards = shuffle_width(reps.sparkSession)
    keys = shard_keys(shards)

    # prefixes are small hashes for the most part: they are mixed before dealing
    def deal(batches):
        for batch in batches:
            docs, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            for a in range(0, len(raw), 4096):
                part = raw[a : a + 4096]
                count = np.array([len(x) for x in part])
                h = np.concatenate(part)
                yield blob_batches(shard_of(mix(h), shards), keys, [h, np.repeat(docs[a : a + 4096], count), np.repeat(sizes[a : a + 4096], count).astype(np.uint32)])

    def meet(batches):
        for h, doc, n in gather(batches, [np.uint64, np.int64, np.uint32]).values():
            order = np.lexsort((doc, n, h))
            h, doc, n = h[order], doc[order], n[order].astype(np.int64)
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (100 * n[:-1] < rule.percent * n[1:])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            # blocks with the same members say the same: keep one
            print_ = np.add.reduceat(mix(doc.view(np.uint64)), first) + size.astype(np.uint64)
            _, one = np.unique(print_, return_index=True)
            one = one[size[one] > 1]
            name = print_[one].view(np.int64)
            if not len(one):
                continue
            lengths = size[one]
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[one], lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, lengths)), pa.array(doc[at]), pa.array(n[at])], ["block", "doc_id", "n"])

    blobs = reps.select("doc_id", "n", "prefix").mapInArrow(deal, BLOBS).repartition(shards, "shard")
    # a block is named by its members, so that those met under several hashes become one
    return blobs.mapInArrow(meet, "block long, doc_id long, n long").distinct()


def _cells(points: DataFrame, rows: int) -> DataFrame:
    """Blocks with more than ``rows`` documents dealt to smaller ones: one for each two of a
    block's chunks, so that any two of its documents meet in one."""
    chunks = points.groupBy("block").count().where(F.col("count") > rows).select("block", F.ceil(F.col("count") / rows).alias("_k"))
    cut = points.join(chunks, "block", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    cut = cut.withColumn("_i", F.pmod(F.xxhash64("doc_id"), F.col("_k"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    cell = F.when(F.col("_k") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("_i", "_j"), F.greatest("_i", "_j")))
    return cut.withColumn("block", cell).drop("_k", "_i", "_j")


def _candidates(blocks: DataFrame, reps: DataFrame, rule: Rule, block_rows: int) -> DataFrame:
    """Edges (a, b) that say which documents of a block may be linked, directly or not.

    ``doc_id`` is here the name of a class of equal sets, one row each in ``reps`` (repeated
    rows are alike)."""
    width = shuffle_width(reps.sparkSession)

    def run(batches):
        vectors: dict[int, np.ndarray] = {}  # one a document, however many blocks it is in

        def held(batches):
            for batch in batches:
                for d, v in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                    if d not in vectors:
                        vectors[d] = np.frombuffer(v, np.uint8)
                yield batch

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in held(batches)]
        if not parts:
            return
        block, doc, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, block))
        block, doc, n = block[order], doc[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(first, len(block)))
        out_a, out_b = [], []
        for f, s in zip(first.tolist(), size.tolist()):
            if s < 2:
                continue
            # sets that can link are in one band of sizes or in neighbouring ones; counts are
            # folded no further than the two bands need
            band = np.floor(np.log(n[f : f + s]) / np.log(100 / rule.percent) + 1e-9).astype(np.int64) if s > 2 else np.zeros(s, np.int64)
            for low in np.unique(band).tolist():
                at = f + np.flatnonzero((band == low) | (band == low + 1))
                if len(at) < 2 or (band[at - f] != low).all():
                    continue
                points = folded([vectors[int(d)] for d in doc[at]])
                if len(at) == 2:
                    bound = int(np.minimum(points[0], points[1]).sum())
                    if rule.sizes_fit(n[at[0]], n[at[1]]) and (100 + rule.percent) * bound >= rule.percent * int(n[at].sum()):
                        out_a.append(doc[at[:1]])
                        out_b.append(doc[at[1:]])
                    continue
                label = joined(points, n[at], rule)
                moved = np.flatnonzero(label != np.arange(len(at)))
                out_a.append(doc[at[label[moved]]])
                out_b.append(doc[at[moved]])
        a, b = np.concatenate(out_a) if out_a else np.zeros(0, np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    points = _cells(blocks, block_rows).join(reps.select("doc_id", "vec"), "doc_id").select("block", "doc_id", "n", "vec")
    return points.repartition(width, "block").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _verified(documents: DataFrame, members: DataFrame, rule: Rule, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """((a, b) for classes with links, whether groups were cut into chunks).

    members: node, component and the class's doc_id, k1 and k2; a text with that id stands for
    the class if its set has that digest.
    """
    spark = documents.sparkSession
    sizes = members.groupBy("component").count().withColumn("k", F.ceil(F.col("count") / CHUNK)).select("component", "k")
    cut = not sizes.where("k > 1").isEmpty()
    cells = members.join(sizes, "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = cells.select("doc_id", "node", "k1", "k2", F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("cell"))
    texts = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    if not cut and members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    rows = texts.join(cells, "doc_id").select("cell", "node", "text", "k1", "k2")

    def run(batches):
        def finish(held):
            out = link_groups(list(held), list(held.values()), rule) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"]) if out else None

        now, held = None, {}
        for batch in batches:
            buffer, offsets = text_buffer(batch.column(2))
            names, nodes, k1, k2 = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for lo, hi in steps(offsets):
                words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i, h in enumerate(shingle_sets(words, rule.words), lo):
                    if names[i] != now:
                        if done := finish(held):
                            yield done
                        now, held = names[i], {}
                    if nodes[i] not in held and digest(h) == (k1[i], k2[i]):
                        held[nodes[i]] = h
        if done := finish(held):
            yield done

    links = rows.repartition(shuffle_width(spark), "cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a long, b long")
    return links, cut


def join_components(documents: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    component_id: the smallest id that links reach, the row's own included. A text of fewer
    words than an n-gram is one n-gram as a whole; null and wordless texts have none and link
    with nothing. Ids are integers (whatever casts to one; others end the job). Rows that share
    an id are judged each by its own text. A row without id takes no part and has no component.
    Other columns are dropped.
    """
    found = materialise(signatures(documents, rule, id_column, text_column), "signatures")
    some = found.where("n > 0 and doc_id is not null")
    # a class is named by its smallest id; where an id names several, the others get another name
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2"))
    other = -F.shiftrightunsigned(F.xxhash64("doc_id", "k1", "k2"), 1) - 1
    classes = materialise(classes.withColumn("_n", nth).withColumn("node", F.when(F.col("_n") == 1, F.col("doc_id")).otherwise(other)).drop("_n"), "classes")
    named = classes.select("k1", "k2", "doc_id", "node")
    reps = some.join(named, ["k1", "k2", "doc_id"]).select(F.col("node").alias("doc_id"), "n", "prefix")
    blocks = materialise(_blocks(reps, rule), "blocks")
    vectors = some.select("doc_id", "k1", "k2", "vec").join(named, ["k1", "k2", "doc_id"]).select(F.col("node").alias("doc_id"), "vec")
    edges = materialise(_candidates(blocks, vectors, rule, block_rows), "candidates")
    members = components(edges, "candidates").join(named, "node")
    links, cut = _verified(documents, members, rule, id_column, text_column)
    links = materialise(links, "links")
    if cut:
        links = components(links, "links")
    else:
        links = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    linked = materialise(links.join(classes.select("node", F.col("doc_id").alias("least")), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    known = classes.join(linked.join(least, "component").select("node", "component_id"), "node", "left").where("copies > 1 or component_id is not null")
    known = known.select("k1", "k2", F.coalesce("component_id", "doc_id").alias("component_id"))
    plain = found.select("doc_id", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return plain.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def oracle_sql(rule: Rule = Rule()) -> str:
    """DuckDB SQL for ``join_components`` over ``documents``; for small tables."""
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {rule.words} THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {rule.words - 2}), lambda i: array_to_string(w[i:i + {rule.words - 1}], ' ')))) END AS s FROM w),
    k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(s, '  '))) END AS rep, s FROM s),
    g AS (SELECT rep, n, unnest(s) AS x FROM k WHERE doc_id = rep AND n > 0),
    c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
    l AS (SELECT a, b FROM c WHERE 100 * c >= {rule.percent} * (na + nb - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
    m AS (SELECT node, min(root) AS m FROM r GROUP BY node)
    SELECT doc_id, n::BIGINT AS n_shingles, coalesce(m, rep) AS component_id FROM k LEFT JOIN m ON node = rep
    """
