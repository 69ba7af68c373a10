"""Quality by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled
bad. A text is compressed with each, piece by piece, so that what a dictionary is worth
does not fade along a long text. The difference of the two sizes, as a share of the
text's length, becomes a probability by a logistic curve fitted on labelled texts that
neither dictionary was built from.

A few bytes of the mean difference are added to every text (EVIDENCE), so that short and
empty texts, which say little, score as the average labelled text does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import held_out, table, tidied, written

#: At most so many labelled rows of each kind are fitted on, those of the smallest id hashes.
SAMPLE_ROWS = 12_000
#: A dictionary is built from texts of so many bytes in all (the text that passes it included), and holds so many.
DICTIONARY_SAMPLE, DICTIONARY = 8 << 20, 128 << 10
#: Bytes compressed at a time, and the level of compression.
PIECE, LEVEL = 1024, 3
#: Length of the segments and of the grams by which texts are searched for what recurs.
SEGMENT, GRAM = 256, 8
#: Bytes of the mean difference that are added to every text.
EVIDENCE = 64
#: predicted is 1 from this score on.
THRESHOLD = 0.7


@dataclass
class QualityModel:
    """Dictionaries of good and bad texts, the mean difference, slope and intercept of
    the curve; or, without dictionaries, the score of every text."""

    base: float = 0.5
    good: bytes | None = None
    bad: bytes | None = None
    mean: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0


def pieces_of(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def dictionary_of(texts: list[bytes]) -> bytes:
    """A dictionary trained on the pieces of texts; of few or short ones, which cannot
    be trained on, the last bytes of them all."""
    samples = [piece for text in texts for piece in pieces_of(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=SEGMENT, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compressors = [self._compressor(x) for x in (good, bad)]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(data)
        if data:
            known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known if data else None, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, raw: bytes) -> int:
        """By how many bytes raw is smaller with the dictionary of good texts."""
        good, bad = (sum(len(c.compress(x)) for x in pieces_of(raw)) for c in self.compressors)
        return bad - good


def share(difference: np.ndarray, n_bytes: np.ndarray, mean: float) -> np.ndarray:
    return (difference + EVIDENCE * mean) / (n_bytes + EVIDENCE)


def score_of(difference: np.ndarray, n_bytes: np.ndarray, model: QualityModel) -> np.ndarray:
    z = model.intercept + model.slope * share(difference, n_bytes, model.mean)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton's method in units of
    the spread of x; a small ridge on the slope keeps it finite where x parts the labels."""
    centre, spread = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    design = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1)
    penalty = np.diag([ridge * weight.sum(), 0.0])
    w = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float(weight @ (np.logaddexp(0, z) - good * z) + 0.5 * v @ penalty @ v)

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (weight * (p - good)) + penalty @ w
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def _train(group: pa.Table) -> pa.Table:
    """Both dictionaries, in one task: lines that texts of both kinds have speak for
    neither and are left out."""
    own: dict[bool, list[bytes]] = {True: [], False: []}
    for text, good in zip(group.column("text").to_pylist(), group.column("good").to_pylist()):
        own[good].append(text)
    lines = {y: {line for text in texts for line in text.split(b"\n")} for y, texts in own.items()}
    shared = lines[True] & lines[False]
    built = [dictionary_of([b"\n".join(x for x in text.split(b"\n") if x not in shared) for text in own[y]]) for y in (True, False)]
    return pa.table({"good": pa.array([True, False]), "dictionary": pa.array(built, pa.binary())})


def _measured(docs: DataFrame, keep: list[str], good: bytes, bad: bytes) -> DataFrame:
    """The columns keep, and how much smaller each text (binary, column text) gets with
    the good dictionary, and its length."""
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            raws = [x or b"" for x in batch.column(len(keep)).to_pylist()]
            found = [[sizes.difference(x) for x in raws], [len(x) for x in raws]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, pa.int64()) for x in found)], [*keep, "difference", "n_bytes"])

    own = docs.select(*keep, "text")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(tidied(measure), f"{kinds}, difference long, n_bytes long")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on the rows of docs (doc_id, text) that labels (doc_id, quality) has: at most
    sample_rows of each kind, without the held-out ones. Of several labels of an id, the
    largest counts; null labels, ids and texts don't, and of equal texts of a kind one
    does. One half of the texts, by a hash of the text, builds the dictionaries, the other
    fits the curve, weighted by how many labels of each kind there are; where a half lacks
    a kind, all texts do both. Without texts of both kinds the model gives every text the
    share of good rows (0.5 if there are none)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    known = written(known, "quality")
    total = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    base = total.get(True, 0) / sum(total.values()) if total else 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("good").orderBy(*order).limit(sample_rows).unionByName(known.where("not good").orderBy(*order).limit(sample_rows))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "good").dropDuplicates()
    key = F.xxhash64("text")
    sample = written(sample.select(F.col("text").cast("binary").alias("text"), "good", F.pmod(key, F.lit(2)).alias("half"), key.alias("key")), "sample")
    halves = {(r.half, r.good) for r in sample.select("half", "good").distinct().collect()}
    if not {True, False} <= {good for _, good in halves}:
        return QualityModel(base)
    both = len(halves) < 4
    first, second = (sample if both else sample.where(F.col("half") == h) for h in (0, 1))

    before = F.sum(F.length("text")).over(Window.partitionBy("good").orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < DICTIONARY_SAMPLE)
    built = {r.good: bytes(r.dictionary) for r in first.select(F.lit(0).alias("one"), "text", "good").groupBy("one").applyInArrow(_train, "good boolean, dictionary binary").collect()}

    rows = _measured(second, ["good"], built[True], built[False]).toArrow().to_pandas()
    good = rows["good"].to_numpy(dtype=bool)
    difference, n_bytes = rows["difference"].to_numpy(dtype=float), rows["n_bytes"].to_numpy(dtype=float)
    weight = np.where(good, total[True] / good.sum(), total[False] / (~good).sum()) * len(good) / (total[True] + total[False])
    mean = float(np.average(difference / np.maximum(n_bytes, 1), weights=weight))
    slope, intercept = fit_curve(share(difference, n_bytes, mean), good.astype(float), weight)
    return QualityModel(base, built[True], built[False], mean, slope, intercept)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, difference, n_bytes) for every row of docs, repeated
    rows and null ids included: the probability that the text is good, 1 where it reaches
    the threshold, and what it comes from. Null and empty texts score alike, as a text of
    the mean difference; texts of any length are compressed whole. Other columns are not
    looked at."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    if model.good is None:
        found = rows.select("doc_id", F.lit(model.base).alias("score"), F.lit(0).cast("long").alias("difference"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    else:
        x = (F.col("difference") + EVIDENCE * model.mean) / (F.col("n_bytes") + EVIDENCE)
        score = 1 / (1 + F.exp(-(F.lit(model.slope) * x + model.intercept)))
        found = _measured(rows, ["doc_id"], model.good, model.bad).select("doc_id", score.alias("score"), "difference", "n_bytes")
    return found.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference", "n_bytes")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "difference", "n_bytes")
