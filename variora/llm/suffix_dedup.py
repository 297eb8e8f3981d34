"""Removal of repeated byte strings through suffix arrays of the places that may repeat.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one.

1. Every LENGTH-byte window has an anchor: the first of its ANCHOR-byte strings with the
   smallest hash. Equal windows have equal anchors at equal places, so all windows of one
   anchor occurrence form a *stretch* of text, and equal windows are found in stretches of
   equal anchors. Stretches that are equal as a whole are settled by their hashes: all but
   the earliest repeat.
2. What is left are anchors with different stretches: their text is fetched, and shard by shard
   a Burrows-Wheeler transform of it is expanded. Breadth-first backward extension meets the
   boundaries between suffixes in the order of their common prefix; it stops at LENGTH, and
   the boundaries it hasn't met part no two equal windows. Each class of equal windows keeps
   its earliest.
3. An anchor with very many different stretches is settled window by window on 128-bit
   hashes, dealt out by those hashes.
4. Repeated windows return to their documents, which drop the bytes they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variora.llm.common import BLOBS, blob_batches, gather, materialise, mix, own_columns, powers, prefix_hashes, shard_keys, shard_of, shuffle_width, steps, text_buffer, unpack
from variora.operators.linking import numbered

LENGTH, ANCHOR = 100, 24
#: Different stretches of one anchor that are sorted together; beyond it, windows are hashed.
GROUP = 2_000
#: Bytes of stretches in one suffix array.
BATCH = 1 << 20

_CODE2 = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---------------------------------------------------------------- anchors


def anchors(buffer: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(text, place, first and last window start, hash of the anchor, hash of the stretch) of
    all anchor occurrences; windows lie within one text."""
    n = len(buffer)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, inverse = prefix_hashes(buffer)
    gram = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    # leftmost minimum of each run of ``span`` hashes, by doubling
    span = length - k + 1
    low = gram
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(gram) - span + 1], low[span - size : span - size + len(gram) - span + 1])
    starts = np.arange(len(low))
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[text + 1]
    starts, text, low = starts[inside], text[inside], low[inside]
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)
    run = np.flatnonzero(new)
    ends = np.append(run[1:], len(starts))
    at = np.empty(len(run), np.int64)
    for i in range(0, len(run), 4096):
        part = starts[run[i : i + 4096]]
        at[i : i + 4096] = part + np.argmin(gram[part[:, None] + np.arange(span)], axis=1)
    place = np.repeat(at, ends - run)
    # windows that begin after that place have the next one with the same hash
    for i in np.flatnonzero(starts[ends - 1] > at).tolist():
        mine = starts[run[i] : ends[i]]
        places = mine[0] + np.flatnonzero(gram[mine[0] : mine[-1] + span] == low[run[i]])
        place[run[i] : ends[i]] = places[np.searchsorted(places, mine)]
    new |= np.concatenate([[True], place[1:] != place[:-1]])
    run = np.flatnonzero(new)
    ends = np.append(run[1:], len(starts)) - 1
    first, last, place = starts[run], starts[ends], place[run]
    power, _ = powers(n + 1)
    sums2 = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE2[buffer] * power[:n], out=sums2[1:])
    whole = mix((sums2[last + length] - sums2[first]) * inverse[first] + ((last - first).astype(np.uint64) << np.uint64(8)) + (place - first).astype(np.uint64))
    return text[run], place, first, last, gram[place], whole


# ---------------------------------------------------------------- suffix arrays


def suffix_array(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of their first ``length`` symbols at least, by doubling."""
    rank = symbols.astype(np.int64)
    n, step = len(rank), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = (rank << 32) | ahead
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        step *= 2
        if step >= length or rank[order[-1]] == n - 1:
            return order


def equal_windows(stretches: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the joined stretches, class) of the windows that occur more than once; every
    stretch is followed by one separator.

    Threshold-bounded interval expansion: an interval holds the suffixes that begin with some
    string w; extending w to the left by each symbol that the transform has there gives the
    intervals of the longer strings. An interval's end is a boundary with a common prefix of
    len(w) - 1 unless a shorter string met it before; only intervals with new boundaries go
    on. After strings of ``length`` symbols, boundaries never met part equal windows.
    """
    m = len(stretches)
    sizes = np.array([len(s) for s in stretches], np.int64)
    n = int(sizes.sum()) + m
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.empty(n, np.int64)
    text = np.ones(n, bool)
    text[ends] = False
    symbols[text] = np.concatenate(stretches) + np.int64(m)
    symbols[ends] = np.arange(m)  # separators differ, so that nothing equal crosses them
    order = suffix_array(symbols, length)
    before = symbols[order - 1]
    before[order == 0] = 0  # the text ends with a separator
    # LF mapping: where the suffix one symbol longer stands
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    longer = place[order - 1]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    first = symbols[order]
    lo = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    hi = np.append(lo[1:], n)
    for _ in range(length):
        fresh = ~met[hi]
        met[hi] = True
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        width = hi - lo
        one = width == 1
        a = lo[one]
        a = longer[a[before[a] >= m]]
        many_lo, many_w = lo[~one], width[~one]
        if len(many_lo):
            owner = np.repeat(np.arange(len(many_lo)), many_w)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(many_w) - many_w, many_w) + many_lo[owner]
            keep = before[at] >= m
            owner, at = owner[keep], at[keep]
            by = np.argsort(owner * np.int64(512) + (before[at] - m), kind="stable")
            key = (owner * np.int64(512) + (before[at] - m))[by]
            f = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            b = np.minimum.reduceat(longer[at[by]], f) if len(f) else f
            lo, hi = np.concatenate([a, b]), np.concatenate([a + 1, b + np.diff(np.append(f, len(key)))])
        else:
            lo, hi = a, a + 1
    # met boundaries part different windows
    group = np.cumsum(met[:n])
    count = np.bincount(group)
    again = (count[group] > 1) & (first >= m)
    return order[again], group[again]


# ---------------------------------------------------------------- blobs with text


def _text_blobs(shards, keys, arrays, begin, size, buffer) -> list[tuple[int, bytes]]:
    """(shard key, blob) with the arrays' entries and their pieces of ``buffer``."""
    out = []
    order = np.argsort(shards, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
        if len(part):
            index = np.arange(size[part].sum()) + np.repeat(begin[part] - np.cumsum(size[part]) + size[part], size[part])
            out.append((int(keys[shards[part[0]]]), b"".join([len(part).to_bytes(8, "little"), *(x[part].tobytes() for x in arrays), buffer[index].tobytes()])))
    return out


_STRETCH = [np.uint64, np.int64, np.int64, np.int64]  # anchor, document, first window, bytes
_WINDOW = [np.uint64, np.uint64, np.int64, np.int64]  # two hashes, document, start


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, last) of the runs of consecutive starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], start[first], start[np.append(first[1:], len(doc)) - 1] if len(doc) else start


def _by_document(doc: np.ndarray, arrays: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """One blob a document."""
    order = np.argsort(doc, kind="stable")
    doc, arrays = doc[order], [np.ascontiguousarray(a[order]) for a in arrays]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(doc))
    return doc[first].tolist(), [b"".join([(z - a).to_bytes(8, "little"), *(x[a:z].tobytes() for x in arrays)]) for a, z in zip(first.tolist(), ends.tolist())]


def _settle_windows(doc, start, keys):
    """(document, start) of all windows but each class's earliest; keys: what equals."""
    order = np.lexsort((start, doc, *keys))
    doc, start, keys = doc[order], start[order], [k[order] for k in keys]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(doc) else start
    again = (doc != doc[first]) | (start != start[first])  # a repeated row is no repetition
    return doc[again], start[again]


def _settle_stretches(h, doc, first, texts, length):
    """(document, start) of the windows of these stretches that occur earlier among them."""
    out_d, out_s = [], []
    order = np.argsort(h, kind="stable")
    sizes = np.array([len(t) for t in texts], np.int64)[order]
    total, cuts = np.cumsum(sizes), np.append(np.flatnonzero(np.diff(h[order])) + 1, len(order))
    a = 0
    while a < len(order):
        limit = (total[a - 1] if a else 0) + BATCH
        z = int(cuts[max(np.searchsorted(cuts, np.searchsorted(total, limit), "right") - 1, np.searchsorted(cuts, a, "right"))])
        part = order[a:z]
        at, group = equal_windows([texts[i] for i in part], length)
        begin = np.cumsum(sizes[a:z] + 1) - sizes[a:z] - 1
        which = np.searchsorted(begin, at, "right") - 1
        d, s = _settle_windows(doc[part][which], first[part][which] + at - begin[which], [group])
        out_d.append(d)
        out_s.append(s)
        a = z
    return (np.concatenate(out_d), np.concatenate(out_s)) if out_d else (np.zeros(0, np.int64), np.zeros(0, np.int64))


# ---------------------------------------------------------------- the operator

def _streamed(batches):
    """(batch, row numbers and blobs met so far by document) for rows sorted by document and
    tag: a document's blobs come before its text."""
    now, blobs = None, []
    for batch in batches:
        todo = []
        ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (d, t) in enumerate(zip(ids, tags)):
            if d != now:
                now, blobs = d, []
            if t == 0:
                blobs.append(batch.column(3)[i].as_buffer().to_pybytes())
            else:
                todo.append((i, list(blobs)))
        if todo:
            yield batch, todo


def _meeting(texts: DataFrame, blobs: DataFrame, width: int) -> DataFrame:
    if "_extra" not in texts.columns:
        texts = texts.withColumn("_extra", F.lit(0))
    none = F.lit(None).cast(texts.schema["_extra"].dataType)
    rows = blobs.select("doc_id", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("_text"), "blob", none.alias("_extra"))
    rows = rows.unionAll(texts.select("doc_id", F.lit(1).alias("tag"), "_text", F.lit(None).cast("binary").alias("blob"), "_extra"))
    return rows.repartition(width, "doc_id").sortWithinPartitions("doc_id", "tag")


def repeated_windows(texts: DataFrame, length: int = LENGTH, k: int = ANCHOR, together: int = GROUP) -> DataFrame:
    """doc_id, blob: first and last start of runs of windows that also start earlier, for
    texts (doc_id long, _text string)."""
    spark = texts.sparkSession
    shards = shuffle_width(spark)
    keys = shard_keys(shards)

    # anchors are minima, so their hashes crowd at the low end: they are mixed before dealing
    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buffer, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets, 1 << 18):
                at = offsets[lo : hi + 1] - offsets[lo]
                text, _, first, last, h, whole = anchors(buffer[offsets[lo] : offsets[hi]], at, length, k)
                if len(text):
                    yield blob_batches(shard_of(mix(h), shards), keys, [h, whole, ids[lo + text], (first - at[text]).astype(np.uint32), (last - first).astype(np.uint8 if length < 256 else np.uint32)])

    def settle(batches):
        kinds = [np.uint64, np.uint64, np.int64, np.uint32, np.uint8 if length < 256 else np.uint32]
        for h, whole, doc, first, more in gather(batches, kinds).values():
            first = first.astype(np.int64)
            order = np.lexsort((first, doc, whole, h))
            h, whole, doc, first, last = h[order], whole[order], doc[order], first[order], (first + more)[order]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], whole[1:] != whole[:-1]])
            earliest = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (doc != doc[earliest]) | (first != first[earliest])
            d, b = _by_document(doc[again], [first[again], last[again]])
            rows = [(x, 0, y) for x, y in zip(d, b)]
            group = np.cumsum(new_h) - 1
            classes = np.bincount(group, new)[group].astype(np.int64)
            left = new & (classes > 1)
            d, b = _by_document(doc[left], [first[left], last[left], h[left], (classes[left] > together).astype(np.uint8)])
            rows += [(x, 1, y) for x, y in zip(d, b)]
            del h, whole, doc, first, last, new_h, new, earliest, again, group, classes, left, d, b
            for i in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 5_000]), (pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "kind", "blob"])

    def fetch(batches):
        for batch, todo in _streamed(batches):
            held: dict[str, list] = {"c": [], "w": []}
            rows = []

            def flush():
                for tag, parts in held.items():
                    if not parts:
                        continue
                    a, b, c, d, begin, size, raw = (np.concatenate(x) for x in zip(*parts))
                    for key, blob in _text_blobs(shard_of(mix(a), shards), keys, [a, b, c, d], begin, size, raw) if tag == "c" else ():
                        rows.append((key, 0, blob))
                    if tag == "w":
                        made = blob_batches(shard_of(a, shards), keys, [a, b, c, d])
                        rows.extend((x, 1, y) for x, y in zip(made.column(0).to_pylist(), made.column(1).to_pylist()))
                held["c"], held["w"] = [], []

            waiting = at = 0
            for i, blobs in todo:
                if not blobs:
                    continue
                raw = np.frombuffer((batch.column(2)[i].as_py() or "").encode(), np.uint8)
                doc = batch.column(0)[i].as_py()
                first, last, h, hot = (np.concatenate(x) for x in zip(*(unpack(b, [np.int64, np.int64, np.uint64, np.uint8]) for b in blobs)))
                fits = last + length <= len(raw)
                first, last, h, hot = first[fits], last[fits], h[fits], hot[fits] > 0
                if hot.any():
                    starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(first[hot], last[hot])]))
                    sums, inverse = prefix_hashes(raw)
                    second = np.zeros(len(raw) + 1, np.uint64)
                    np.cumsum(_CODE2[raw] * powers(len(raw) + 1)[0][: len(raw)], out=second[1:])
                    none = np.zeros(0, np.int64)
                    held["w"].append((mix((sums[starts + length] - sums[starts]) * inverse[starts]), mix((second[starts + length] - second[starts]) * inverse[starts]), np.full(len(starts), doc, np.int64), starts, none, none, none))
                first, last, h = first[~hot], last[~hot], h[~hot]
                if len(h):
                    size = last - first + length
                    held["c"].append((h, np.full(len(h), doc, np.int64), first, size, first + at, size, raw))
                    at += len(raw)
                waiting += len(raw)
                if waiting > 4 << 20:
                    flush()
                    waiting = at = 0
            flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "tag", "blob"])

    def expand(batches):
        stretches: dict[int, list] = {}
        windows: dict[int, list] = {}
        for batch in batches:
            for key, tag, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = blob.as_buffer().to_pybytes()
                if tag:
                    windows.setdefault(key, []).append(unpack(raw, _WINDOW))
                    continue
                h, doc, first, size = unpack(raw, _STRETCH)
                body = np.frombuffer(raw, np.uint8, offset=8 + 32 * len(h))
                stretches.setdefault(key, []).append((h, doc, first, np.split(body, np.cumsum(size)[:-1])))
        found = []
        for parts in stretches.values():
            h, doc, first = (np.concatenate(x) for x in list(zip(*parts))[:3])
            found.append(_settle_stretches(h, doc, first, [t for p in parts for t in p[3]], length))
        for parts in windows.values():
            w1, w2, doc, start = (np.concatenate(x) for x in zip(*parts))
            found.append(_settle_windows(doc, start, [w1, w2]))
        for doc, start in found:
            doc, first, last = _runs(doc, start)
            d, b = _by_document(doc, [first, last])
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(b, pa.binary())], ["doc_id", "blob"])

    blobs = texts.mapInArrow(find, BLOBS).repartition(shards, "shard")
    settled = materialise(blobs.mapInArrow(settle, "doc_id long, kind int, blob binary"), "settled")
    open_ = settled.where("kind = 1").select("doc_id", "blob")
    wanted = open_.select("doc_id").distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = _meeting(texts.join(wanted, "doc_id", "left_semi"), open_, shards).mapInArrow(fetch, "shard int, tag int, blob binary")
    late = rows.repartition(shards, "shard").mapInArrow(expand, "doc_id long, blob binary")
    return settled.where("kind = 0").select("doc_id", "blob").unionAll(materialise(late, "late"))


#: Documents whose ids may be broadcast, 8 bytes each.
BROADCAST_ROWS = 1_000_000


def kept_spans(blobs: list[bytes], size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal removed runs of bytes of a text of ``size`` bytes."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = (np.concatenate(x) for x in zip(*(unpack(b, [np.int64, np.int64]) for b in blobs)))
    begin, end = first, np.minimum(last + length, size)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(end)) - 1]


def _numbered_ids(texts: DataFrame) -> DataFrame:
    """texts (doc_id of any type, _text, ...) with ``_key``: the place of (doc_id, text) in the
    order of ids and then of hashes of texts; equal rows share one."""
    hashed = texts.withColumn("_hash", F.xxhash64("_text"))
    places = materialise(numbered(hashed.select("doc_id", "_hash").distinct(), ["doc_id", "_hash"], "_key"), "places")
    same = hashed["doc_id"].eqNullSafe(places["doc_id"]) & (hashed["_hash"] == places["_hash"])
    return hashed.join(places, same).select(*[hashed[c] for c in texts.columns], "_key")


def remove_repeats(
    documents: DataFrame, output: str = "text", length: int = LENGTH, k: int = ANCHOR, together: int = GROUP, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Drop every byte that a ``length``-byte string covers which also starts earlier.

    output="text": ``documents`` with the kept bytes as text, where a character that lost some
    of its bytes goes as a whole. output="spans": id, begin, end (arrays, bytes).
    output="digest": id, n_bytes, n_removed, n_spans, kept_sha256.

    One row for each input row. A null text is empty. Ids are of any type that has an order; a
    null comes first. Rows that share an id and the text count as one document; those that share
    an id alone are documents of their own, one after another in the order of a hash of their
    texts. Other columns stay with output="text", whatever their names, and are dropped else.
    """
    if output not in ("text", "spans", "digest"):
        raise ValueError(output)
    others = [c for c in own_columns(documents) if output == "text"]
    extra = F.struct(documents[id_column].alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(others)])
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    texts = documents.select(documents[id_column].alias("doc_id"), text.alias("_text"), extra.alias("_extra"))
    ids = texts.select("doc_id", F.xxhash64("_text").alias("h")).distinct().groupBy("doc_id").count()
    integers = isinstance(texts.schema["doc_id"].dataType, T.IntegralType)
    if integers and ids.where("count > 1 or doc_id is null").isEmpty():
        texts = texts.withColumn("_key", F.col("doc_id").cast("long"))
    else:
        texts = materialise(_numbered_ids(texts), "numbered")
    texts = texts.select(F.col("_key").alias("doc_id"), "_text", "_extra")
    found = repeated_windows(texts.select("doc_id", "_text"), length, k, together)

    def finish(batches):
        for batch, todo in _streamed(batches):
            rows = []
            for i, blobs in todo:
                raw = batch.column(2)[i].as_py().encode()
                begin, end = kept_spans(blobs, len(raw), length)
                if output == "spans":
                    rows.append((begin.tolist(), end.tolist()))
                    continue
                kept = raw
                if len(begin):
                    kept = b"".join([raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)])])
                if output == "digest":
                    rows.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((kept.decode(errors="ignore"),))
            at = pa.array([i for i, _ in todo], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(4).take(at), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names)

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    kinds, made = {
        "text": ([pa.string()], [("_text", T.StringType())]),
        "spans": ([pa.list_(pa.int64())] * 2, [("begin", longs), ("end", longs)]),
        "digest": ([*[pa.int64()] * 3, pa.string()], [("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept_sha256", T.StringType())]),
    }[output]
    schema = T.StructType([texts.schema["_extra"], *(T.StructField(*f) for f in made)])
    names = schema.names
    done = _meeting(texts, found, shuffle_width(documents.sparkSession)).mapInArrow(finish, schema)
    if output != "text":
        return done.select(F.col("_extra.id").alias(id_column), *names[1:])
    kept = [F.col("_text") if c == text_column else F.col("_extra").getField(f"c{i}") for i, c in enumerate(documents.columns)]
    return done.select(*[x.alias(c) for x, c in zip(kept, documents.columns)])


def oracle_sql(length: int = LENGTH) -> str:
    """DuckDB SQL for the digest over ``documents``; for small tables."""
    return f"""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - {length - 1})) AS i, h FROM h),
    k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS k FROM p),
    f AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
    o AS (SELECT doc_id, i, i > lag(i) OVER w + {length} OR lag(i) OVER w IS NULL AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    u AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
    s AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b, lag(max(i) + {length}, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM u GROUP BY doc_id, run),
    g AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM s GROUP BY doc_id),
    t AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM s JOIN h USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
    """
