"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts cover every training row: each task counts n-grams into one
array per language with numpy and emits its non-zero cells, Spark adds them up.
What reaches the driver is one number per language and bucket, whatever the
corpus; the log-probability matrix goes back as a broadcast. A batch of documents is
one sparse matrix, of how often each has each bucket, whose product with the
log-probabilities scores all of them. Very many languages go in blocks, one after
the other, each with a broadcast of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import held_out, table, tidied, written

#: N-grams of 1 to 3 characters go to so many buckets.
BUCKETS, ORDERS = 1 << 14, 3
#: Languages of one broadcast matrix (67 MB); more go to several.
BLOCK_LANGUAGES = 512
#: Characters taken at a time, so that a very long text needs no large arrays; texts of
#: a sparse matrix, and numbers (cells times languages) of a product taken at a time.
PIECE, ROWS, PRODUCT = 1 << 18, 256, 1 << 21

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _letters_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_letters: np.ndarray | None = None


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """The bucket of every n-gram of the lower-case text, in which each
    character that is no letter counts as a space; nothing for a text without
    letters. Pieces of a long text overlap so that no n-gram is lost or doubled."""
    global _letters
    if _letters is None:
        _letters = _letters_table()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not _letters[codes].any():
        return
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + ORDERS - 1]
        part = np.where(_letters[part], part, 32).astype(np.uint64)
        own = min(PIECE, len(codes) - at)
        h = np.zeros(len(part), dtype=np.uint64)
        for n in range(ORDERS):
            h = (h[: len(part) - n] + part[n:] + np.uint64(1)) * _MULTIPLIERS[n]
            yield (h[:own] >> np.uint64(50)).astype(np.int64)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """langs in order; log_prior by language; log_prob: buckets x languages."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            for buckets in ngram_buckets(text):
                own += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        at, n = np.append(at, -1), np.append(own[at], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n)], ["lang", "bucket", "n"])


def fit_language_model(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row with a text and a language. No such row: a model without
    languages, which calls every text undetermined."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    cells = written(rows.mapInArrow(tidied(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "cells")
    langs = sorted(r[0] for r in cells.where("bucket = -1").select("lang").collect())
    return _assemble(langs, cells.toArrow() if langs else None, smoothing)


def _assemble(langs: list[str], cells: pa.Table | None, smoothing: float) -> LanguageModel:
    counts = np.full((BUCKETS, len(langs)), smoothing)
    docs = np.zeros(len(langs))
    if cells is not None:
        column = {x: i for i, x in enumerate(langs)}
        where = np.array([column[x] for x in cells.column("lang").to_pylist()], dtype=np.int64)
        bucket, n = cells.column("bucket").to_numpy(), cells.column("n").to_numpy().astype(float)
        docs[where[bucket < 0]] = n[bucket < 0]
        np.add.at(counts, (bucket[bucket >= 0], where[bucket >= 0]), n[bucket >= 0])
    return LanguageModel(langs, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), np.log(counts / counts.sum(axis=0)))


def _cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, n): the non-zero cells of a batch's matrix, in order of rows. A
    text without letters has none."""
    row, bucket, n = ([np.empty(0, dtype=np.int64)] for _ in range(3))
    for i, text in enumerate(texts):
        if text is None or not _has_letter(text):
            continue
        if len(text) > BUCKETS // ORDERS:
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for x in ngram_buckets(text):
                counts += np.bincount(x, minlength=BUCKETS)
            own = np.flatnonzero(counts)
            counts = counts[own]
        else:
            own, counts = np.unique(np.concatenate(list(ngram_buckets(text))), return_counts=True)
        row.append(np.full(len(own), i)), bucket.append(own), n.append(counts)
    return np.concatenate(row), np.concatenate(bucket), np.concatenate(n)


def scores(texts: list[str | None], model: LanguageModel) -> np.ndarray:
    """texts x languages: log prior plus the sparse product of the texts' counts and the
    log-probabilities; minus infinity for texts that are undetermined."""
    out = np.full((len(texts), len(model.langs)), -np.inf)
    most = max(1, PRODUCT // max(1, len(model.langs)))
    for start in range(0, len(texts), ROWS):
        row, bucket, n = _cells(texts[start : start + ROWS])
        out[start + row] = model.log_prior
        for at in range(0, len(row), most):
            own = row[at : at + most]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[start + own[first]] += np.add.reduceat(n[at : at + most, None] * model.log_prob[bucket[at : at + most]], first, axis=0)
    return out


def best(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of scores, the place and value of the largest, the first of
    equals, and the log of the sum of all."""
    place = found.argmax(axis=1)
    top = found[np.arange(len(found)), place]
    with np.errstate(invalid="ignore"):
        mass = top + np.log(np.exp(found - top[:, None]).sum(axis=1))
    return place, top, np.where(np.isneginf(top), -np.inf, mass)


def predict(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """The likeliest language and its posterior probability; `und` and 0 for a
    null text, a text without letters or a model without languages. Ties go to
    the first language in alphabetical order."""
    if not model.langs:
        return "und", 0.0
    place, top, mass = best(scores([text], model))
    return ("und", 0.0) if np.isneginf(top[0]) else (model.langs[place[0]], float(np.exp(top[0] - mass[0])))


def language_blocks(model: LanguageModel) -> list[LanguageModel]:
    k = BLOCK_LANGUAGES
    return [LanguageModel(model.langs[i : i + k], model.log_prior[i : i + k], np.ascontiguousarray(model.log_prob[:, i : i + k])) for i in range(0, len(model.langs), k)]


def predict_language(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, repeated rows and null
    ids included, as predict() does; other columns are not looked at. Blocks of
    languages follow one another in the same task: each hands on the best so far
    and the sum of all."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("mass"))
    blocks = language_blocks(model)
    for i, block in enumerate(blocks):
        own = ["doc_id", "text"][: 2 - (i == len(blocks) - 1)]  # the last needs no text behind it
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def score(batches: Iterator[pa.RecordBatch], shared=shared, own=own) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                place, top, mass = best(scores(batch.column(1).to_pylist(), shared.value))
                before, so_far = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                higher = top > before
                lang = np.where(higher, np.array(shared.value.langs, dtype=object)[place], np.array(batch.column(2).to_pylist(), dtype=object))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(lang, pa.string()), pa.array(np.maximum(top, before)), pa.array(np.logaddexp(mass, so_far))], [*own, "lang_pred", "top", "mass"])

        rows = rows.mapInArrow(tidied(score), f"doc_id {kind}, {'text string, ' * (len(own) == 2)}lang_pred string, top double, mass double")
    return rows.select("doc_id", "lang_pred", F.when(F.col("top") > float("-inf"), F.exp(F.col("top") - F.col("mass"))).otherwise(0.0).alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


#: The same from the definitions; CRC-32 and the hash of n-grams are written out.
ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, text, lang,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 = 2, false) AS held_out
  FROM documents, tab
), letters AS (
  SELECT r, p, CASE WHEN regexp_matches(x, '^\p{L}$') THEN unicode(x) ELSE 32 END::UHUGEINT AS c
  FROM (SELECT r, unnest(regexp_extract_all(lower(text), '(?s).')) AS x, unnest(generate_series(1, len(regexp_extract_all(lower(text), '(?s).')))) AS p FROM doc WHERE regexp_matches(text, '\p{L}'))
), one AS (SELECT r, p, c, (c + 1) * 11400714819323198485::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM letters),
two AS (SELECT r, p, (h + lead(c) OVER w + 1) % 18446744073709551616::UHUGEINT * 14029467366897019727::UHUGEINT % 18446744073709551616::UHUGEINT AS h, lead(c, 2) OVER w AS c FROM one WINDOW w AS (PARTITION BY r ORDER BY p)),
three AS (SELECT r, (h + c + 1) % 18446744073709551616::UHUGEINT * 1609587929392839161::UHUGEINT % 18446744073709551616::UHUGEINT AS h FROM two),
cell AS (
  SELECT r, (h // 1125899906842624::UHUGEINT)::BIGINT AS b, count(*) AS n FROM (SELECT r, h FROM one UNION ALL SELECT r, h FROM two UNION ALL SELECT r, h FROM three) WHERE h IS NOT NULL GROUP BY ALL
), train AS (SELECT r, lang FROM doc WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out),
prior AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM train GROUP BY lang),
counted AS (SELECT lang, b, sum(n) AS n FROM cell JOIN train USING (r) GROUP BY ALL),
total AS (SELECT lang, prior, coalesce(sum(n), 0) + 0.5::DOUBLE * 16384 AS total FROM prior LEFT JOIN counted USING (lang) GROUP BY ALL),
scored AS (
  SELECT r, t.lang, any_value(prior) + sum(cell.n * ln((coalesce(counted.n, 0) + 0.5::DOUBLE) / total)) AS s
  FROM cell CROSS JOIN total t LEFT JOIN counted ON counted.lang = t.lang AND counted.b = cell.b GROUP BY ALL
), best AS (SELECT r, arg_min(lang, (-s, lang)) AS lang, max(s) AS top FROM scored GROUP BY r),
sure AS (SELECT r, any_value(best.lang) AS lang, 1 / sum(exp(s - top)) AS score FROM scored JOIN best USING (r) GROUP BY r)
SELECT doc_id, held_out, coalesce(sure.lang, 'und') AS lang_pred, round(coalesce(score, 0), 6) AS score FROM doc LEFT JOIN sure USING (r)
"""
