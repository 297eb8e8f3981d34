"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by longest-prefix search in the model's compiled character map (a
double-array trie); each normalised character keeps the source bytes it came from. BPE then
runs on the normalised text, and every piece is projected back onto a byte span of the
original text.

Where no piece of a model has a space mark after another character, merges never cross the
beginning of a run of space marks: each run with the word after it is encoded on its own, once
per task while it stays in a bounded cache. Other models encode the normalised text whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from variora.llm.common import steps, text_buffer

SPACE = "▁"
#: Encoded words that a task keeps; it forgets all of them when there are more.
CACHE_WORDS = 150_000


class CharacterMap:
    """Longest-prefix replacement by a compiled character map: a uint32 with the size of a
    double-array trie in bytes, the trie, and zero-ended replacement strings."""

    def __init__(self, compiled: bytes):
        self.trie, self.texts = np.zeros(0, np.uint32), b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.trie = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.texts = compiled[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """(bytes matched at ``at``, place of the replacement); (0, -1) without a match."""
        best, trie = (0, -1), self.trie
        if not len(trie):
            return best
        unit = int(trie[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(trie):
                break
            unit = int(trie[node])
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, int(trie[node]) & 0x7FFFFFFF)
        return best

    def replace(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """(replacement, source begin, source end) along ``raw``, one character at least."""
        at = 0
        while at < len(raw):
            size, place = self.longest(raw, at)
            if size:
                text = self.texts[place : self.texts.index(b"\0", place)].decode()
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                text = raw[at : at + size].decode()
            yield text, at, at + size
            at += size


class Codec:
    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rule = proto.normalizer_spec
        self.map = CharacterMap(rule.precompiled_charsmap)
        self.dummy, self.collapse, self.escape = rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces
        texts = [p.piece for p in proto.pieces]
        self.by_word = self.dummy and self.escape and not proto.trainer_spec.treat_whitespace_as_suffix and all(SPACE not in t.lstrip(SPACE) for t in texts)
        self.by_word &= not any(p.type == 4 for p in proto.pieces)  # user-defined symbols may hold spaces
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.size = np.array([1 if p.type == 6 else len(t.encode()) for p, t in zip(proto.pieces, texts)])
        self.name = [str(i) for i in range(len(texts))]
        self.surface = [bytes([int(t[3:-1], 16)]) if p.type == 6 else t.replace(SPACE, " ").encode() for p, t in zip(proto.pieces, texts)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the normaliser below does the model's work, so BPE gets text that is normalised already
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.add_dummy_prefix = False
        self.bpe = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unknown = self.bpe.unk_id()
        self.words: dict[str, tuple] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its characters the source bytes' begin and end."""
        raw = text.encode()
        if not len(self.map.trie) and not self.collapse:  # every character stands for itself
            begin = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            end = np.append(begin[1:], len(raw))[: len(begin)]
            shown = text
            if self.dummy and raw:
                shown, begin, end = " " + shown, np.concatenate([[0], begin]), np.concatenate([[0], end])
            return shown.replace(" ", SPACE) if self.escape else shown, begin, end
        out: list[tuple[str, int, int]] = []
        for piece, a, b in self.map.replace(raw):
            for c in piece:
                if self.collapse and c == " " and (not out or out[-1][0] == " "):
                    continue
                out.append((c, a, b))
        while self.collapse and out and out[-1][0] == " ":
            out.pop()
        if self.dummy and out:
            out.insert(0, (" ", out[0][1], out[0][1]))
        shown = "".join(c for c, _, _ in out)
        if self.escape:
            shown = shown.replace(" ", SPACE)
        return shown, np.array([a for _, a, _ in out], np.int64), np.array([b for _, _, b in out], np.int64)

    def _sizes(self, shown: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normalised text that each piece stands for."""
        size = self.size[ids]
        raw, at = shown.encode(), 0
        for i in np.flatnonzero(ids == self.unknown).tolist():  # a run of unknown characters is one piece
            at = int(size[:i].sum())
            n = 0
            for c in raw[at:].decode():
                if n and self.bpe.piece_to_id(c) != self.unknown:
                    break
                n += len(c.encode())
            size[i] = n
        return size

    def project(self, text: str, shown: str, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source bytes of each piece, from those of the normalised text's characters. Byte
        pieces share their character's span where it isn't in the source as it is."""
        if not len(ids):
            return ids, ids
        raw = np.frombuffer(shown.encode(), np.uint8)
        lead = (raw & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        stop = np.cumsum(self._sizes(shown, ids))
        start = np.concatenate([[0], stop[:-1]])
        of = char[start]
        froms, tos = begin[of], end[char[stop - 1]]
        byte = np.flatnonzero(self.is_byte[ids])
        if len(byte):
            at, source = np.flatnonzero(lead), np.frombuffer(text.encode(), np.uint8)
            of = of[byte]
            part = start[byte] - at[of]
            whole = (end[of] - begin[of] == np.append(at[1:], len(raw))[of] - at[of]) & (source[np.minimum(begin[of] + part, len(source) - 1)] == raw[start[byte]])
            first = np.flatnonzero(part == 0)
            whole = np.repeat(np.logical_and.reduceat(whole, first), np.diff(np.append(first, len(part))))
            froms[byte] = begin[of] + np.where(whole, part, 0)
            tos[byte] = np.where(whole, begin[of] + part + 1, end[of])
        return froms, tos

    def _learned(self, ids: list[int]) -> tuple[str, str | None, bytes]:
        """(ids as text, what they stand for, ids as 32-bit integers)."""
        text = None if self.unknown in ids else b"".join(map(self.surface.__getitem__, ids)).decode()
        return ",".join(map(self.name.__getitem__, ids)), text, array("i", ids).tobytes()

    _run = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")

    def _cut(self, shown: str) -> list[str]:
        """The words of a normalised text, each with the marks before it but one."""
        if shown[:1] == SPACE and SPACE * 2 not in shown:
            return shown[1:].split(SPACE)
        return self._run.findall(shown)

    def pieces(self, shown: list[str]) -> list[list[tuple]]:
        """``_learned`` of each normalised text's words, or of the whole text."""
        if not self.by_word:
            return [[self._learned(ids)] if t else [] for t, ids in zip(shown, self.bpe.encode(shown, num_threads=1))]
        cut = list(map(self._cut, shown))
        met = set().union(*cut)
        missing = list(met - self.words.keys())
        if len(self.words) + len(missing) > CACHE_WORDS:  # words of now are the likeliest to come again
            self.words = {w: self.words[w] for w in met & self.words.keys()}
        if missing:
            self.words.update(zip(missing, map(self._learned, self.bpe.encode([SPACE + w for w in missing], num_threads=1))))
        return [list(map(self.words.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text."""
        made = list(map(self.normalise, texts))
        out = []
        for text, (shown, begin, end), learned in zip(texts, made, self.pieces([shown for shown, _, _ in made])):
            ids = np.frombuffer(b"".join([w[2] for w in learned]), np.int32)
            out.append((ids, *self.project(text, shown, ids, begin, end)))
        return out

    def digest(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text, end of the last span)."""
        made = list(map(self.normalise, texts))
        out = []
        for text, (shown, begin, end), learned in zip(texts, made, self.pieces([shown for shown, _, _ in made])):
            names, back, raw = zip(*learned) if learned else ((), (), ())
            ids = np.frombuffer(b"".join(raw), np.int32)
            if self.by_word and None not in back:
                back = "".join(back)[1:]
            else:
                back = self.model.decode(ids.tolist()) if len(ids) else ""
            _, tos = self.project(text, shown, ids, begin, end)
            out.append((len(ids), hashlib.sha256(",".join(names).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int(tos[-1]) if len(ids) else 0))
        return out


@lru_cache(2)
def _codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str, output: str = "spans", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text. ``model``: path of the model file, installed on every machine.

    output="spans": id, ids, begin, end (arrays; byte spans of the original text).
    output="digest": id, n_tokens, ids_sha256, decoded_sha256, source_end.
    A null or empty text has no ids. One row for each input row, repeated ids included;
    other columns are dropped.
    """
    if output not in ("spans", "digest"):
        raise ValueError(output)
    docs = docs.select(docs[id_column].alias(id_column), docs[text_column].cast("string").alias("_text"))
    key = docs.schema[id_column].dataType.simpleString()

    def spans(batches):
        codec = _codec(model)
        gc.freeze()
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets):
                part = batch.slice(lo, hi - lo)
                rows = codec.encode([t or "" for t in part.column(1).to_pylist()])
                lists = [pa.array([r[i].tolist() for r in rows], pa.list_(pa.int32())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], [id_column, "ids", "begin", "end"])

    def digest(batches):
        codec = _codec(model)
        gc.freeze()
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for lo, hi in steps(offsets):
                part = batch.slice(lo, hi - lo)
                n, ids, back, last = zip(*codec.digest([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(last, pa.int64())],
                    [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "source_end"],
                )

    if output == "spans":
        return docs.mapInArrow(spans, f"`{id_column}` {key}, ids array<int>, begin array<int>, end array<int>")
    return docs.mapInArrow(digest, f"`{id_column}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string, source_end long")


def decode_documents(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """id, text from id, ids; null ids decode to the empty text."""
    encoded = encoded.select(encoded[id_column].alias(id_column), encoded["ids"].cast("array<int>").alias("ids"))
    key = encoded.schema[id_column].dataType.simpleString()

    def decode(batches):
        codec = _codec(model)
        for batch in batches:
            texts = [codec.model.decode([i for i in x if i is not None]) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.mapInArrow(decode, f"`{id_column}` {key}, text string")
