import random
import struct

import pytest
import sentencepiece

from waymark.llm import pieces


def test_ids_and_round_trip_match_the_library():
    path = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    alphabet = "abcdeth  \n\t▁éñß執ゼ😀́<s>01' ., ‍"
    texts = [None, "", " ", "  ", "a", "<s> </s> <unk> <0x41>", "aaa aaaa abab", "▁▁x", "x" * 3000, *(" " * n + "the" for n in range(40)), *(" " * n for n in range(40)), *("a" + " " * n + "執" for n in range(40))]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(800)]
    found = pieces.encode_decode(texts, path)
    tokenizer = pieces.build_tokenizer(pieces.parse_model(open(path, "rb").read()))
    for text, (ids, decoded, _) in zip(texts, found):
        ids = [int(x) for x in ids.split()]
        assert ids == library.encode(text or "")
        assert tokenizer.encode(text or "", add_special_tokens=False).ids == ids
        if "▁" not in (text or ""):
            assert decoded == (text or "")


def test_rows(spark):
    rows = spark.createDataFrame([(1, "the cat", "x"), (None, None, "y"), (1, "the cat", None), (2, "", "z")], "doc_id long, text string, n_tokens string")
    out = pieces.encode_pieces(rows, pieces.default_model()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded_same, r.parity) for r in out) == [(0, 0, True, True), (1, 2, True, True), (1, 2, True, True), (2, 0, True, True)]
    assert pieces.encode_pieces(rows.limit(0), pieces.default_model()).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*fields):
    """A protobuf message of (number, int, float, bytes or text) fields."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model_file(kind, letters="▁etaoinshrdlcmfgb", byte_fallback=False, user=(), squeeze=True, charsmap=b"", suffix=False):
    """A model written by hand: letters, some words, and all byte pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_fallback
    pieces += [(x, 0.0, 4) for x in user]
    words = ["▁t", "th", "he", "▁th", "▁the", "in", "ing", "ca", "▁c", "at", "▁cat"]
    pieces += [(x, -1.0 * i - 1, 1) for i, x in enumerate(words)] + [(x, -20.0 - i, 1) for i, x in enumerate(letters)]
    out = b"".join(message((1, message((1, x), (2, score), (3, t)))) for x, score, t in pieces)
    trainer = message((3, {"unigram": 1, "bpe": 2}[kind]), (24, int(suffix)), (35, int(byte_fallback)))
    return out + message((2, trainer), (3, message((1, "own"), (2, charsmap), (3, 1), (4, int(squeeze)), (5, 1))))


TEXTS = ["", "the cat", "  the   cat  ", "xthe", "thing 執 cat", "tag the cat<u>in", "ﬁne ｔｈｅ Ⅷ", "ét", "a" * 5000, "the cat " * 20000]


@pytest.mark.parametrize("given", [{}, {"byte_fallback": True}, {"squeeze": False}, {"user": ("<u>",)}, {"charsmap": True}, {"charsmap": True, "byte_fallback": True}])
@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_models_written_by_hand(tmp_path, kind, given):
    if given.get("charsmap"):
        rules = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
        given = {**given, "charsmap": dict(pieces._fields(rules))[2]}
    (tmp_path / "m").write_bytes(data := model_file(kind, **given))
    if kind == "bpe" and given.get("user"):
        with pytest.raises(ValueError, match="not rebuilt"):
            pieces.parse_model(data)
        return
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for text, (ids, _, parity) in zip(TEXTS, pieces.encode_decode(TEXTS, str(tmp_path / "m"))):
        assert [int(x) for x in ids.split()] == library.encode(text)
        assert parity, text


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="not rebuilt"):
        pieces.parse_model(model_file("unigram", suffix=True))
    with pytest.raises(ValueError, match="not rebuilt"):
        pieces.parse_model(model_file("bpe", letters="▁etaoinshrdlcmfb"))


def test_every_text_goes_through_the_batches(spark, monkeypatch):
    texts = [None, "", "the cat", "x" * 300_000, *["word " * 400] * 600]
    assert [b - a for a, b in pieces._parts(["a" * 10, "b" * pieces.BATCH_CHARS, *["c"] * 600])] == [1, 1, 256, 256, 88]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for r in pieces.encode_pieces(rows, pieces.default_model()).collect():
        assert r.token_ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.token_ids)
        assert r.decoded_same and r.parity and r.n_bytes == len(texts[r.doc_id] or "")


def test_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    found = pieces.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.token_ids == ids and r.decoded_same == (library.decode(ids) == (texts[r.doc_id] or "")) and r.parity


def test_ids_are_those_of_the_rebuilt_tokenizer(monkeypatch):
    """The library is only held against them: with others from there, parity falls and the ids stay."""
    own = pieces.Backend(pieces.default_model())
    texts = ["the cat sat", "", "zwölf Boxkämpfer 執"]
    before = own.encode(texts)
    assert all(same for _, _, same in before)
    monkeypatch.setattr(own, "library", type("Other", (), {"encode": lambda self, given, num_threads: [[5, 6, 7] for _ in given]})())
    after = own.encode(texts)
    assert [x[:2] for x in after] == [x[:2] for x in before] and not any(same for _, _, same in after)


def test_steps_around_the_batches_are_those_of_the_tokenizer(tmp_path):
    """Markers and spaces of whole texts are replaced outside the tokenizers library, with the same results."""
    odd = [" ", "  ", "▁", "▁ x", " ▁x ▁▁ y ", "a▁b", "the cat ", "\u2581\u0000 the", "執 the"]
    rules = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    charsmap = dict(pieces._fields(rules))[2]
    files = [open(pieces.default_model(), "rb").read()]
    files += [model_file(kind, **given) for kind in ("unigram", "bpe") for given in ({}, {"squeeze": False}, {"squeeze": False, "byte_fallback": True}, {"squeeze": False, "charsmap": charsmap})]
    for i, data in enumerate(files):
        (tmp_path / str(i)).write_bytes(data)
        model = pieces.parse_model(data)
        own, whole = pieces.Backend(str(tmp_path / str(i))), pieces.build_tokenizer(model)
        assert (own.tokenizer.normalizer is None) == (not model.squeeze_spaces and not model.charsmap)
        for text, (ids, decoded, _) in zip(odd + TEXTS, own.encode(odd + TEXTS)):
            assert ids == whole.encode(text, add_special_tokens=False).ids, text
            assert decoded == whole.decode(ids, skip_special_tokens=False), text


def test_words_are_merged_in_groups():
    """A cut for each word costs more than its merges; a text without cuts, a heap that grows with it."""
    cut = pieces.build_tokenizer(pieces.parse_model(open(pieces.default_model(), "rb").read())).pre_tokenizer
    text = "▁the▁▁cat▁" + "▁word" * 1000 + "▁▁"
    parts = [x for x, _ in cut.pre_tokenize_str(text)]
    assert "".join(parts) == text and len(parts) == -(-1002 // pieces.WORDS) + 1
    assert all(x.startswith("▁") and x.strip("▁") for x in parts[:-1]) and parts[-1] == "▁▁"
