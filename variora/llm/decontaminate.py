"""Benchmark decontamination: rare seed words, then Smith-Waterman alignment of words.

A copy with a score of ``min_score`` matches at least that share of the item's words, whatever
was changed in it. So, of any set of the item's words that leaves out fewer than that share
less SEED_HITS - 1 words, every copy holds SEED_HITS; the set of the words that are rarest
over all documents is each item's seeds. Rarity decides only how much work is done, never
what is found. Where a document holds enough seeds close together, a bound that ignores the
order of the words is taken, and what passes it is aligned locally with the item, so that
edited and paraphrased copies score as far as they agree.

Items are broadcast in blocks of some BLOCK_BYTES of text and BLOCK_ITEMS items; each block
takes two passes over the documents, which are never shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variora.llm.common import Words, steps, text_buffer

#: Items in one broadcast block and bytes of their text; seed words of a step of text that are
#: held at once. Items are dealt by hash, so that blocks are alike; numbers of items fit 16 bits.
BLOCK_ITEMS, BLOCK_BYTES, HELD = 20_000, 8 << 20, 4_000_000
SEED_HITS = 4
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
MIN_SCORE = 0.4

#: Words are runs of letters, digits and non-ASCII bytes, so that punctuation doesn't matter.
ALNUM = np.zeros(256, np.uint8)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = 1


def align(item: np.ndarray, text: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """(score, begin, end) of the best local alignment of item within text[begin:end]; zeros
    where it scores below ``least``."""

    def best(a, b):
        n = len(b)
        slope = GAP * np.arange(n + 1)
        row, top, at = np.zeros(n + 1), 0.0, (0, 0)
        for i, x in enumerate(a):
            new = np.zeros(n + 1)
            np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new - slope) + slope
            j = int(np.argmax(new))
            if new[j] > top:
                top, at = float(new[j]), (i + 1, j)
            row = new
        return top, at

    score, (i, j) = best(item, text)
    if score <= 0 or score < least:
        return 0.0, 0, 0
    _, (_, back) = best(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def within(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Items:
    """A block of items as word hashes, and the words of each as numbers in ``vocabulary``."""

    def __init__(self, ids: list[int], texts: list[str], min_score: float = MIN_SCORE):
        buffer, offsets = text_buffer(pa.array(texts, pa.string()))
        words = Words(buffer, offsets, is_word=ALNUM)
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.vocabulary = np.unique(words.hash)
        self.known = [np.unique(w) for w in np.split(np.searchsorted(self.vocabulary, words.hash), words.first[1:-1])]
        numbers = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.pairs = [np.unique(w[:-1] * len(self.vocabulary) + w[1:]) for w in numbers]
        size = words.count()
        self.least = min_score * MATCH * size
        self.need = np.maximum(1, np.ceil(min_score * size - 1e-9)).astype(np.int64)
        #: Words of text that a copy can take: all words match, and the rest is what it can lose.
        self.span = size + np.maximum(0, np.floor((1 - min_score) * MATCH * size / -max(MISMATCH, GAP) + 1e-9)).astype(np.int64) + 1

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word in ``vocabulary``; -1 for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hash, at, -1)

    def seeded(self, counts: np.ndarray) -> "Items":
        """Choose each item's rarest words as seeds, as many as no copy can do without."""
        seeds, self.others = [], np.zeros(len(self.ids), np.int64)
        self.hits = np.minimum(SEED_HITS, self.need)
        for i, (known, hashes, need, hits) in enumerate(zip(self.known, self.words, self.need.tolist(), self.hits.tolist())):
            times = np.bincount(np.searchsorted(known, np.searchsorted(self.vocabulary, hashes)), minlength=len(known))
            order = np.argsort(counts[known], kind="stable")
            least = len(hashes) - need + hits
            enough = np.searchsorted(np.cumsum(times[order]), least) + 1 if need <= len(hashes) else 0
            seeds.append(known[order[:enough]])
            self.others[i] = times[order[enough:]].sum()
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in seeds])]).astype(np.int64)
        self.seed = np.concatenate(seeds).astype(np.int64)
        return self

    def found(self, numbers: np.ndarray):
        """(item, place of a word that is its seed), by item and place, some items at a time."""
        held = np.bincount(numbers[numbers >= 0], minlength=len(self.vocabulary))
        cost = np.concatenate([[0], np.cumsum(held[self.seed])])[self.first]
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        a = 0
        while a < len(self.ids):
            z = max(a + 1, int(np.searchsorted(cost, cost[a] + HELD, "right")) - 1)
            seed, item = self.seed[self.first[a] : self.first[z]], owner[self.first[a] : self.first[z]]
            order = np.argsort(seed, kind="stable")
            item = item[order]
            first = np.searchsorted(seed[order], np.arange(len(self.vocabulary) + 1))
            at = np.flatnonzero(numbers >= 0)
            at = at[np.diff(first)[numbers[at]] > 0]
            n = np.diff(first)[numbers[at]]
            entry = np.arange(n.sum()) + np.repeat(first[numbers[at]] - np.cumsum(n) + n, n)
            place, item = np.repeat(at, n), item[entry]
            order = np.argsort(item.astype(np.int16), kind="stable")
            yield item[order], place[order]
            a = z

    def windows(self, numbers: np.ndarray, words: Words):
        """(text, item, first word, end word) of all stretches that can hold a copy.

        A copy of L words with h seeds matches at most h + ``others`` words and pays for the
        rest, so that RATE * h - L has a lower bound. Each seed that can be the last of a copy
        is found from the least RATE * h - place of the seeds before it in the text.
        """
        doc, cost = words.text_of(), -max(MISMATCH, GAP)
        rate = (MATCH + cost) / cost
        lowest = self.least / cost - rate * self.others
        for item, place in self.found(numbers):
            if not len(place):
                continue
            group = np.zeros(len(place), np.int64)
            group[1:] = np.cumsum((item[1:] != item[:-1]) | (doc[place[1:]] != doc[place[:-1]]))
            gain = rate * np.arange(len(place)) - place
            gain -= group * (2 * np.abs(gain).max() + 1.0)
            low = np.minimum.accumulate(gain)
            before = np.arange(len(place)) - self.hits[item] + 1
            close = (before >= 0) & (group[before] == group)
            close &= gain - low[before] + rate - 1 >= lowest[item] - 1e-6
            item, place = item[close], place[close]
            new = np.ones(len(place), bool)
            new[1:] = (item[1:] != item[:-1]) | (doc[place[1:]] != doc[place[:-1]]) | (place[1:] - place[:-1] > self.span[item[1:]])
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(place)) - 1
            item, d = item[begins], doc[place[begins]]
            p = np.maximum(words.first[d], place[begins] - self.span[item])
            q = np.minimum(words.first[d + 1], place[ends[: len(begins)]] + self.span[item] + 1)
            yield from zip(d.tolist(), item.tolist(), p.tolist(), q.tolist())

    def bound(self, item: int, numbers: np.ndarray) -> float:
        """No alignment of the item with these words scores higher: two words that follow each
        other in the text, but not in the item, cost a gap or a word."""
        known = within(self.known[item], numbers)
        value = np.where(known, MATCH, max(MISMATCH, GAP))
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both):
            value[both] += np.where(within(self.pairs[item], numbers[both - 1] * len(self.vocabulary) + numbers[both]), 0.0, GAP)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        return float((sums - np.minimum.accumulate(sums)).max()) - GAP


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    min_score: float = MIN_SCORE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """id, item id, score, begin, end: one row for each input row and item that it holds.

    score: the alignment's, as a share of a full copy's; ``min_score`` at least. begin, end:
    bytes of the text that align. Null or wordless texts and items match nothing; items that
    repeat are all reported; rows that repeat are too. Other columns are dropped.
    """
    spark = documents.sparkSession
    rows = documents.select(documents[id_column].alias(id_column), documents[text_column].cast("string").alias("_text"))
    key = rows.schema[id_column].dataType.simpleString()
    items = benchmark.select(benchmark[item_id].alias("item"), F.coalesce(benchmark[item_text].cast("string"), F.lit("")).alias("text"))
    out_schema = f"`{id_column}` {key}, `{item_id}` {items.schema['item'].dataType.simpleString()}, score double, begin long, end long"
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    found = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        block = Items([r["item"] for r in block], [r["text"] for r in block], min_score)
        if not len(block.vocabulary):
            continue
        all_words = spark.sparkContext.broadcast(block)

        def count(batches, shared=all_words):
            index = shared.value
            total = np.zeros(len(index.vocabulary), np.int64)
            for batch in batches:
                buffer, offsets = text_buffer(batch.column(0))
                for lo, hi in steps(offsets):
                    words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], is_word=ALNUM)
                    numbers = index.numbers(words)
                    total += np.bincount(numbers[numbers >= 0], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["w", "c"])

        counts = np.zeros(len(block.vocabulary), np.int64)
        for r in rows.select("_text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).collect():
            counts[r["w"]] = r["c"]
        seeds = spark.sparkContext.broadcast(block.seeded(counts))

        def scan(batches, shared=seeds):
            index = shared.value
            for batch in batches:
                buffer, offsets = text_buffer(batch.column(1))
                out = []
                for lo, hi in steps(offsets):
                    words = Words(buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], is_word=ALNUM)
                    numbers = index.numbers(words)
                    best: dict[tuple[int, int], tuple] = {}
                    for d, i, p, q in index.windows(numbers, words):
                        full = len(index.words[i]) * MATCH
                        if index.bound(i, numbers[p:q]) < min_score * full - 1e-9:
                            continue
                        score, x, y = align(index.words[i], words.hash[p:q], min_score * full - 1e-9)
                        score /= full
                        if score >= min_score and score > best.get((d, i), (0,))[0]:
                            best[d, i] = (score, int(words.start[p + x] - offsets[lo + d] + offsets[lo]), int(words.end[p + y - 1] - offsets[lo + d] + offsets[lo]))
                    out += [(lo + d, index.ids[i], *v) for (d, i), v in best.items()]
                if out:
                    at, ids, score, begin, end = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids), pa.array(score, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        [id_column, item_id, "score", "begin", "end"],
                    )

        found.append(rows.mapInArrow(scan, out_schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], out_schema)
