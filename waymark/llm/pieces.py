"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf here, and its parts are rebuilt as a
tokenizers pipeline: normaliser, metaspace marker, piece scores (unigram) or
the merges that the scores imply (BPE), byte fallback. Batches of whole texts are
encoded and decoded multithreaded; steps that only replace spaces by markers, or
markers by spaces, are done by str.replace around them. Each text's ids are held
against those of the sentencepiece library itself; where a text differs, `parity`
is false.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table, tidied

MARK = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Rows, and characters, that are encoded at a time, and threads of one encoding
#: batch. A longer text is a batch of its own.
BATCH_ROWS, BATCH_CHARS, THREADS = 256, 1 << 20, 2
#: Words, at most, that a BPE model merges at a time.
WORDS = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + n]
            at += n
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: str
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool


def parse_model(data: bytes) -> PieceModel:
    """The parts of a sentencepiece model file that encoding needs. Models that
    build_tokenizer() cannot rebuild exactly are refused: kinds other than unigram
    and BPE, markers behind words, white space that is not marked, and BPE models
    with pieces defined by the user (they are cut out before merges begin) or
    of characters that are no pieces."""
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
    known = {p for p, _, _ in pieces}
    odd = kind == "bpe" and any(x == USER_DEFINED or x == NORMAL and not known.issuperset(p) for p, _, x in pieces)
    if kind is None or odd or trainer.get(24, 0) or not normaliser.get(5, 1):
        raise ValueError("a model of a kind that is not rebuilt here")
    return PieceModel(
        pieces,
        kind,
        next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0),
        bool(trainer.get(35, 0)),
        normaliser.get(2, b""),
        bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)),
    )


def implied_merges(model: PieceModel) -> list[tuple[str, str]]:
    """The merges of a BPE model, first the best score. Pieces of equal score
    are merged from the left, each as far as it goes: a longer left part first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, score, kind in model.pieces:
        if kind == NORMAL and len(p) > 1:
            found += [(-score, -i, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
    return [(a, b) for _, _, a, b in sorted(found)]


def build_tokenizer(model: PieceModel):  # noqa: ANN201
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == "unigram":
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tokenizer = Tokenizer(models.BPE(vocab, implied_merges(model), cache_capacity=0, unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
        if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
            # no merge crosses the start of a word, so a text is cut there. Each cut has its
            # cost, and so has the heap of a long text. Groups of words hardly recur: no cache
            words = Regex(f"(?:{MARK}*[^{MARK}]+){{1,{WORDS}}}|{MARK}+")
            tokenizer.pre_tokenizer = pre_tokenizers.Split(words, "removed", invert=True)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    parts = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]
    tokenizer.decoder = decoders.Sequence(parts + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


class Backend:
    """A model's tokenizer, and the library to hold it against. What the tokenizer's
    first normaliser and last decoder steps replace is replaced in whole texts here:
    the tokenizers library would carry an offset of every byte through each step."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import decoders

        with open(path, "rb") as file:
            data = file.read()
        model = parse_model(data)
        self.tokenizer = build_tokenizer(model)
        self.marks = not model.charsmap and not model.squeeze_spaces
        if self.marks:  # with other steps before them, markers are left to the normaliser
            self.tokenizer.normalizer = None
        self.tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])
        self.prefix = MARK if model.dummy_prefix else ""
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def marked(self, text: str) -> str:
        """A text as the tokenizer takes it."""
        return (self.prefix + text).replace(" ", MARK) if self.marks and text else text

    def spaced(self, decoded: str) -> str:
        """A text as the model decodes it, of the joined pieces."""
        text = decoded.replace(MARK, " ")
        return text.removeprefix(" ") if self.prefix else text

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        """(ids, their decoded text, parity) of each text: ids and text by the rebuilt
        tokenizer, parity tells whether the library has the same ids."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([self.marked(x) for x in texts], add_special_tokens=False)]
        truth = self.library.encode(texts, num_threads=1)
        same = [a == b for a, b in zip(ids, truth)]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(a, self.spaced(b), c) for a, b, c in zip(ids, decoded, same)]


_loaded: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    if path not in _loaded:
        _loaded[path] = Backend(path)
    return _loaded[path]


def encode_decode(texts: list[str | None], path: str) -> list[tuple[str, str, bool]]:
    """(ids, decoded text, parity) of each text, the ids in decimal, separated by
    spaces; a null text counts as empty."""
    return [(" ".join(map(str, ids)), text, same) for ids, text, same in backend(path).encode([x or "" for x in texts])]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most BATCH_ROWS texts, and BATCH_CHARS characters if they are several."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i > first and (i - first == BATCH_ROWS or size > BATCH_CHARS):
            yield first, i
            first, size = i, len(text or "")
    if first < len(texts):
        yield first, len(texts)


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, token_ids,
    decoded_same (decoding the ids gives the text back), parity (the ids of the
    rebuilt tokenizer are those of the library). Null and empty texts have no tokens.
    Null ids, repeated rows and an empty table are as they are; other columns
    are not looked at. Texts are never cut.

    model_path must be readable on every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, token_ids array<int>, decoded_same boolean, parity boolean"

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:  # a worker that waits for its next task holds no model
            _loaded.pop(model_path, None)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            all_texts = whole.column(1).to_pylist()
            for first, end in _parts(all_texts):
                texts = all_texts[first:end]
                found = backend(model_path).encode([x or "" for x in texts])
                n = np.array([len(x[0]) for x in found], dtype=np.int64)
                ids = np.fromiter(chain.from_iterable(x[0] for x in found), dtype=np.int32, count=int(n.sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(first, end - first),
                        whole.column(2).slice(first, end - first),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids)),
                        pa.array([x[1] == (text or "") for x, text in zip(found, texts)]),
                        pa.array([x[2] for x in found]),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "token_ids", "decoded_same", "parity"],
                )

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), n_bytes.alias("n_bytes")).mapInArrow(encode, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_model())
