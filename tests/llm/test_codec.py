"""Normalisation through a compiled character map and projection to source bytes."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from variora.llm.sentencepiece_codec import Codec

rng = random.Random(4)
ODD = ["", " ", "  ", "ﬁne ½ Ⅳ", "Å Å é", "㍿ x ㌔", "a b　 c", "tab\tnew\n\nline", "😀 é 日本", "▁x▁▁y", " lead", "trail ", "＂ｆｕｌｌ＂", "ﬀﬁﬂ" * 3]
TEXTS = ODD + ["".join(rng.choice("ab cdé ½ﬁ　 Å\n日") for _ in range(rng.randint(1, 60))) for _ in range(150)]


def model(rule, byte_fallback=True, marks=True, collapse=False):
    """A small BPE model made by hand: pieces, and the normaliser of a rule of the library."""
    proto = pb.ModelProto()
    made = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if rule else pb.ModelProto()
    proto.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, collapse, True
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 2, byte_fallback
    add = lambda text, kind, score=0.0: proto.pieces.add(piece=text, type=kind, score=score)
    for i, t in enumerate(["<unk>", "<s>", "</s>"]):
        add(t, 2 if i == 0 else 3)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 6)
    pieces = ["▁a", "▁f", "ab", "fi", "▁▁", "ba", "1⁄", *"▁abcdefgilnrty12⁄é"] + ([] if marks else ["a▁b"])
    for i, t in enumerate(pieces):
        add(t, 1, -float(i))
    return proto.SerializeToString()


@pytest.mark.parametrize("rule", ["", "nfkc", "nmt_nfkc"])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("marks,collapse", [(True, False), (True, True), (False, False)])
def test_ids_text_and_spans_are_the_librarys(rule, byte_fallback, marks, collapse):
    raw = model(rule, byte_fallback, marks, collapse)
    codec, library = Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert codec.by_word == marks and bool(len(codec.map.trie)) == bool(rule)
    for t, (ids, begin, end), seen in zip(TEXTS, codec.encode(TEXTS), codec.digest(TEXTS)):
        want = library.encode(t)
        assert ids.tolist() == want and seen[0] == len(want), t
        shown, _, _ = codec.normalise(t)
        assert shown == library.normalize(t) if t.strip() else True
        size = len(t.encode())
        assert np.all(begin <= end) and (not len(ids) or (0 <= begin.min() and end.max() <= size))
        assert np.all(np.diff(begin) >= 0) and np.all(np.diff(end) >= 0)
        if not rule and not collapse:  # spans part the text
            assert b"".join(t.encode()[a:b] for a, b in zip(begin, end)) == t.encode()


def test_spans_point_at_what_was_replaced():
    codec = Codec(model("nfkc"))
    (ids, begin, end), = codec.encode(["a ½ ﬁ"])
    raw = "a ½ ﬁ".encode()
    shown = [codec.bpe.id_to_piece(int(i)) for i in ids]
    by_piece = dict(zip(shown, (raw[a:b].decode() for a, b in zip(begin, end))))
    assert by_piece["1⁄"] == "½" and by_piece["2"] == "½"
    assert by_piece.get("fi", by_piece.get("▁f", "")).strip() == "ﬁ"
