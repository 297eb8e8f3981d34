"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node whose string is a piece fails to the root
of continuations and pops one token; any other node fails to where the longest-match of its
string would stand, and keeps only the *number* of tokens popped on the way. A word is then
measured in one pass over its characters, and no piece is ever built.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from variora.llm.common import steps, text_buffer

#: Measured words that a task keeps; it forgets those not in sight when there are more.
CACHE_WORDS = 200_000


class Automaton:
    """``initial`` pieces begin a word, ``continuing`` ones follow within it."""

    def __init__(self, initial, continuing):
        self.child: list[dict[str, int]] = [{}, {}]  # 0: root, 1: root of continuations
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.child[node].get(c)
                    if nxt is None:
                        nxt = self.child[node][c] = len(self.child)
                        self.child.append({})
                        final.append(False)
                    node = nxt
                if node > 1:
                    final[node] = True
        n = len(self.child)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for u in queue:
            for c, v in self.child[u].items():
                queue.append(v)
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, more = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.child[z]:
                    more += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.child[z][c], more

    def measure(self, word: str) -> int:
        """Number of pieces of ``word``; 0 if it can't be cut into pieces."""
        child, fail, popped = self.child, self.fail, self.popped
        u = n = 0
        for c in word:
            v = child[u].get(c)
            while v is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
                v = child[u].get(c)
            u = v
        while u != 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


@lru_cache(2)
def load(model: str) -> Automaton:
    """The pieces of a SentencePiece model: those with a space mark begin a word."""
    from sentencepiece import sentencepiece_model_pb2

    with open(model, "rb") as f:
        pieces = [p.piece for p in sentencepiece_model_pb2.ModelProto.FromString(f.read()).pieces if p.type == 1]
    return Automaton([p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in pieces if "▁" not in p])


def count_tokens(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_tokens, n_unknown: one row for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+``; one that can't be cut into pieces is unknown and counts
    as one token. A null or empty text has no words. Other columns are dropped.
    """
    rows = docs.select(docs[id_column].alias(id_column), docs[text_column].cast("string").alias("_text"))

    def run(batches):
        automaton, known = load(model), {}
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets):
                part = batch.slice(lo, hi - lo)
                words = [(t or "").encode().split() for t in part.column(1).to_pylist()]
                met = set().union(*words)
                missing = met - known.keys()
                if len(known) + len(missing) > CACHE_WORDS:
                    known = {w: known[w] for w in met & known.keys()}
                known.update((w, automaton.measure(w.decode())) for w in missing)
                sizes = [list(map(known.__getitem__, w)) for w in words]
                unknown = [s.count(0) for s in sizes]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, sizes)), pa.int64()), pa.array([sum(s) + u for s, u in zip(sizes, unknown)], pa.int64()), pa.array(unknown, pa.int64())],
                    [id_column, "n_words", "n_tokens", "n_unknown"],
                )

    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
