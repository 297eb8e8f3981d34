"""Language identification by cross-parsing.

For each language a suffix automaton holds the whole texts of a bounded sample of labelled
documents. A text is parsed into phrases, each the longest that occurs in the sample; a
language whose sample explains the text needs few phrases. Phrases a symbol are compared
across languages.

The parse is exact over whole texts, however long, and still runs in step over many pieces:
each piece is first parsed as if a phrase began with it, and then again from the phrase that
really enters it, until both parses begin a phrase at the same place; from there on they agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variora.llm.common import crc_mod, steps, text_buffer

#: Bound of the fit: documents a language, which are learned whole.
SAMPLE_DOCS = 24
#: Symbols of a piece; any size gives the same phrases.
PIECE = 512

_FOLD = np.zeros(256, np.uint8)  # 0: space and all that is neither letter nor high byte
_FOLD[97:123] = np.arange(1, 27)
_FOLD[65:91] = np.arange(1, 27)


class Automaton:
    """The automaton of all substrings of ``text``: for each state a bit set of its symbols, 64
    a word, and its successors one after another. State 0 is the root."""

    def __init__(self, text: bytes, alphabet: int):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.words = -(-alphabet // 64)
        at = np.fromiter((s * self.words * 64 + c for s, row in enumerate(nexts) for c in sorted(row)), np.int64)
        self.to = np.fromiter((row[c] for row in nexts for c in sorted(row)), np.int32)
        self.size = len(nexts)
        self.bits = np.zeros(self.size * self.words, np.uint64)
        np.bitwise_or.at(self.bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.first = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits))[:-1]]).astype(np.int32)


class Model:
    """Languages in order, a byte to symbol map, and their automata one after another. A last
    state, which nothing leaves, is where phrases begin."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        self.fold = _FOLD.copy()
        high = np.flatnonzero(seen[128:]) + 128
        self.fold[high] = np.arange(27, 27 + len(high))
        self.alphabet = 28 + len(high)  # the last symbol: high bytes that no sample has
        self.fold[128:][~seen[128:]] = self.alphabet - 1
        made = []
        for name in self.languages:
            joined = self.fold[np.frombuffer(b" ".join(samples[name]), np.uint8)]
            joined = joined[np.concatenate([[True], (joined[1:] != 0) | (joined[:-1] != 0)])] if len(joined) else joined
            made.append(Automaton(joined.tobytes(), self.alphabet))
        self.words = -(-self.alphabet // 64)
        base = np.cumsum([0] + [a.size for a in made])
        edges = np.cumsum([0] + [len(a.to) for a in made])
        none = np.zeros(self.words, np.uint64)
        self.bits = np.concatenate([*(a.bits for a in made), none])
        self.first = np.concatenate([*(a.first + e for a, e in zip(made, edges)), none.astype(np.int32)]).astype(np.int32)
        self.to = np.concatenate([*(a.to + b for a, b in zip(made, base)), np.zeros(1, np.int32)]).astype(np.int32)
        self.dead = int(base[-1])
        self.begin = np.full((len(made), self.alphabet), self.dead, np.int32)  # the state after a phrase's first symbol
        for j, a in enumerate(made):
            here = self._next(np.full(self.alphabet, base[j]), np.arange(self.alphabet))
            self.begin[j] = np.where(here < 0, self.dead, here)

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = state * self.words + (c >> 6)
        bits, bit = self.bits[at], (c & 63).astype(np.uint64)
        to = self.to[np.minimum(self.first[at] + np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1))), len(self.to) - 1)]
        return np.where((bits >> bit) & np.uint64(1), to, -1)

    def _follow(self, symbols: np.ndarray, at: int, stop: int, state: int, language: int, old: np.ndarray) -> tuple[int, int, int]:
        """One piece's real parse, as ``phrases`` does many: (phrases begun before the parses
        meet, where they do or ``stop``, the state at ``stop``)."""
        n = 0
        for at in range(at, stop):
            c = int(symbols[at])
            place = state * self.words + (c >> 6)
            bits = int(self.bits[place])
            if bits >> (c & 63) & 1:
                state = int(self.to[int(self.first[place]) + (bits & ((1 << (c & 63)) - 1)).bit_count()])
                continue
            if old[at]:
                return n, at, -1
            n, state = n + 1, int(self.begin[language, c])
        return n, stop, state

    def phrases(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases a text and language, symbols a text)."""
        n, k = len(offsets) - 1, len(self.languages)
        symbols = self.fold[buffer]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        keep = np.ones(len(symbols), bool)
        if len(symbols):
            keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (doc[1:] != doc[:-1])
        symbols, doc = symbols[keep].astype(np.int64), doc[keep]
        size = np.bincount(doc, minlength=n)
        first = np.concatenate([[0], np.cumsum(size)])
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        out = np.zeros((n, k), np.int64)
        if not len(owner) or not k:
            return out, size
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + nth * PIECE
        stop = np.minimum(begin + PIECE, first[owner + 1])
        # all pieces as if a phrase began with each: where phrases begin, and the state at the end
        order = np.argsort(begin - stop, kind="stable")
        length, ordered = (stop - begin)[order], begin[order]
        state = np.full((k, len(owner)), self.dead, np.int64)
        starts = np.zeros((k, len(symbols)), bool)
        live = len(owner)
        for i in range(int(length[0])):
            while length[live - 1] <= i:
                live -= 1
            c = symbols[ordered[:live] + i]
            to = self._next(state[:, :live], c[None, :])
            stuck = to < 0
            starts[:, ordered[:live] + i] = stuck
            state[:, :live] = np.where(stuck, self.begin[:, c], to)
        ends = np.empty_like(state)
        ends[:, order] = state
        # the phrase that enters a piece goes on to where it ends, and the next ones, until one
        # begins where one began above; for all pieces at once, and then again for those that a
        # phrase passed through
        begun = np.concatenate([np.zeros((k, 1), np.int64), np.cumsum(starts, axis=1)], axis=1)
        total = begun[:, stop] - begun[:, begin]
        lane, piece = np.nonzero(np.broadcast_to(nth > 0, (k, len(owner))))
        at, now, went = begin[piece].copy(), ends[lane, piece - 1], np.zeros(len(piece), np.int64)
        met = np.full(len(piece), -1, np.int64)
        open_ = np.arange(len(piece))
        while len(open_):
            l, a = lane[open_], at[open_]
            c = symbols[a]
            to = self._next(now[open_], c)
            stuck = to < 0
            joined = stuck & starts[l, a]
            met[open_[joined]] = a[joined]
            went[open_] += stuck & ~joined
            now[open_] = np.where(stuck, self.begin[l, c], to)
            at[open_] += 1
            open_ = open_[~joined & (at[open_] < stop[piece[open_]])]
        real = total.copy()
        some = met >= 0
        real[lane, piece] = went + np.where(some, begun[lane, stop[piece]] - begun[lane, np.maximum(met, 0)], 0)
        # a piece that the parses never met in hands another state on: go on one by one
        reached = np.full(k, -1)
        for i in np.flatnonzero(~some).tolist():
            l, p, carried = int(lane[i]), int(piece[i]), int(now[i])
            if p <= reached[l]:
                continue
            q = p + 1
            while q < len(owner) and owner[q] == owner[p] and carried >= 0:
                more, where, carried = self._follow(symbols, int(begin[q]), int(stop[q]), carried, l, starts[l])
                real[l, q] = more + (int(begun[l, stop[q]] - begun[l, where]) if carried < 0 else 0)
                q += 1
            reached[l] = q - 1
        for j in range(k):
            out[:, j] = np.bincount(owner, real[j], n).astype(np.int64)
        return out, size

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        buffer, offsets = text_buffer(column)
        names, scores = [], []
        for lo, hi in steps(offsets):
            raw, at = buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            letters = np.concatenate([[0], np.cumsum(((_FOLD[raw] > 0) | (raw >= 128)).astype(np.int64))])
            ascii_ = np.concatenate([[0], np.cumsum((_FOLD[raw] > 0).astype(np.int64))])
            counts, size = self.phrases(raw, at)
            for i in range(hi - lo):
                a, b = at[i], at[i + 1]
                has = ascii_[b] > ascii_[a] or (letters[b] > letters[a] and any(ch.isalpha() for ch in raw[a:b].tobytes().decode(errors="ignore")))
                if not has or not self.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                rate = counts[i] / max(1, size[i])
                best = int(np.argmin(rate))
                others = np.delete(rate, best)
                names.append(self.languages[best])
                scores.append(float(1 - rate[best] / others.min()) if len(others) else 1.0)
        return names, np.array(scores, np.float64)


def fit(documents: DataFrame, keep=None, docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``docs`` whole documents a language: the first in the order of a hash of
    their id and text, among rows where ``keep`` holds, with a lang and a text."""
    rows = documents.where("lang is not null and text is not null and text <> ''")
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.select(rows["lang"].cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), rows["text"].cast("string").alias("text"))
    # hashes alone are ranked, and each task sends no more than ``docs`` of a language
    best = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").withColumn("_r", best).where(F.col("_r") <= docs).select("lang", "h").distinct()
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(samples)


def identify(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score: one row for each input row.

    score: by how much of its rivals' best phrase rate the winner's is lower, 0 to 1. A null
    text, one without letters, or a model without languages gives ``und`` and 0. Ties go to
    the first language in alphabetical order. Other columns are dropped.
    """
    rows = documents.select(documents[id_column].alias(id_column), documents[text_column].cast("string").alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_column, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, lang_pred string, score double")


def not_held_out(modulus: int = 4, remainder: int = 2):
    return crc_mod("doc_id", modulus) != remainder
