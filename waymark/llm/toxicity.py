"""Toxicity by weak supervision.

Lexicon voters are mined from labelled training rows, in folds: each fold votes
by the lexicons of the others, so no voter has seen the rows it votes on. Pattern voters are written by hand. A generative label model estimates, without looking at
labels, how accurate each voter is and how voters correlate (those that do vote as
one group, whose joint votes have a probability of their own), and gives every
sampled row a posterior; a linear classifier over words and word beginnings learns the
posteriors and scores every text. What terms it has, and their weights, come from
posteriors alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import shingles
from waymark.llm.common import held_out, table, tidied, written

#: At most so many labelled rows are fitted on, those of the smallest id hashes.
SAMPLE_ROWS = 20_000
#: A term of a lexicon occurs in so many toxic rows of the sample, and of the rows in which it occurs so many are toxic.
MIN_SUPPORT, MIN_PRECISION = 5, 0.9
#: Voters of a stronger correlation than this, given the label, are of one group; a joint
#: vote is backed by so many rows of what independent voters would do.
CORRELATED, BACKING = 0.2, 10.0
#: Folds of the sample: voters of one are mined in the others.
FOLDS = 5
#: Terms of the linear classifier have so many posterior rows of the label they speak for,
#: and are e times as frequent with it as with the other.
MIN_EVIDENCE, MIN_LIFT = 5.0, 1.0
#: For so many rows of the sample the classifier is fitted on one more, without terms.
EMPTY_SHARE = 20
#: Words count whole and by their first letters.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Terms of the linear classifier; lexicon voters for each kind of term (words, and beginnings of each length).
MAX_TERMS, TIERS = 4096, 3
#: predicted is 1 from this score on.
THRESHOLD = 0.3

_LETTERS = re.compile(r"[^\W\d_]+")
#: Hand-written patterns: the sign of their vote, and what they look for.
PATTERNS: list[tuple[int, re.Pattern]] = [
    (1, re.compile(r"[!?]{3,}")),
    (1, re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}")),
    (1, re.compile(r"\b(?:you|he|she|they)(?:'re| are| is) (?:an? )?(?:such )?(?:an? )?\w+[!]")),
    (1, re.compile(r"[@#$%&*]{4,}")),
    (-1, re.compile(r"\b[Ll]icen[sc]ed? under\b|\bPublic License\b")),
    (-1, re.compile(r"\|[^|\n]*\|[^|\n]*\|")),
]


def terms_of(word: str) -> list[str]:
    """The terms by which a word counts: =word, and ^ and its first letters."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)] if len(word) > 2 else []


def distinct_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


@dataclass
class ToxicityModel:
    """weights by term and bias of the classifier; lexicons of the terms mined for
    each fold; theta[y, voter, vote + 1] and strength of each voter, of the label model."""

    base: float = 0.0
    bias: float | None = None
    weights: dict[str, float] = field(default_factory=dict)
    lexicons: tuple[dict[str, int], ...] = ()
    theta: np.ndarray | None = None
    strength: np.ndarray | None = None
    prior: float = 0.0


N_LEXICONS = TIERS * (1 + len(BEGINNINGS))
N_VOTERS = N_LEXICONS + 1 + len(PATTERNS)


def lexicons_of(mined: list[str]) -> dict[str, int]:
    """The lexicon of each mined term, given the strongest first: a kind of term
    has lexicons of strong, middling and weak terms, as many terms in each."""
    kinds: dict[int, list[str]] = {}
    for term in mined:
        kinds.setdefault(0 if term[0] == "=" else 1 + BEGINNINGS.index(len(term) - 1), []).append(term)
    return {term: kind * TIERS + i * TIERS // len(own) for kind, own in kinds.items() for i, term in enumerate(own)}


def votes(text: str | None, lexicons: dict[str, int]) -> np.ndarray:
    """One vote of -1, 0 (abstains) or 1 for each voter: the lexicons (1 if a term
    occurs), one that votes -1 where no lexicon does, and the patterns."""
    out = np.zeros(N_VOTERS, dtype=np.int8)
    for word in distinct_words(text):
        for term in terms_of(word):
            at = lexicons.get(term)
            if at is not None:
                out[at] = 1
    out[N_LEXICONS] = 0 if out[:N_LEXICONS].any() else -1
    for i, (sign, pattern) in enumerate(PATTERNS):
        if pattern.search(text or ""):
            out[N_LEXICONS + 1 + i] = sign
    return out


def correlations(matrix: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Of each two voters, how their votes correlate given the label, the mean over
    both labels; nothing for those that never vote together."""
    shared = np.zeros((matrix.shape[1],) * 2)
    for weight in (1 - posterior, posterior):
        total = max(weight.sum(), 1e-9)
        centred = (matrix - (weight @ matrix) / total) * np.sqrt(weight)[:, None]
        spread = np.sqrt((centred**2).sum(axis=0))
        shared += total / len(matrix) * np.abs(centred.T @ centred / np.maximum(np.outer(spread, spread), 1e-9))
    active = (matrix != 0).astype(float)
    shared *= active.T @ active > 0
    np.fill_diagonal(shared, 0.0)
    return shared


def groups_of(shared: np.ndarray) -> list[list[int]]:
    """Voters that correlate, directly or by others, in groups of any size: only joint
    votes that occur are counted."""
    group = [[k] for k in range(len(shared))]
    i, j = np.nonzero(np.triu(shared) > CORRELATED)
    for k in np.argsort(-shared[i, j], kind="stable").tolist():
        a, b = group[i[k]], group[j[k]]
        if a is not b:
            a += b
            for x in b:
                group[x] = a
    return [g for k, g in enumerate(group) if g[0] == k]


def group_odds(matrix: np.ndarray, posterior: np.ndarray, theta: np.ndarray, group: list[int]) -> np.ndarray:
    """Of each row, the log odds of the label that the group's joint vote speaks for:
    its probability given either label, among joint votes of anyone in the group,
    from posterior counts and what independent voters would do."""
    own = matrix[:, group]
    voted = (own != 0).any(axis=1)
    out = np.zeros(len(matrix))
    if voted.any():
        kinds, of = np.unique(own[voted], axis=0, return_inverse=True)
        of = of.ravel()
        log = []
        for y, weight in ((0, 1 - posterior[voted]), (1, posterior[voted])):
            alone = np.exp(sum(np.log(theta[y, k, kinds[:, i] + 1]) for i, k in enumerate(group)))
            alone /= max(1.0 - np.exp(sum(np.log(theta[y, k, 1]) for k in group)), 1e-9)
            counted = np.bincount(of, weights=weight, minlength=len(kinds))
            total = (1 - posterior, posterior)[y].sum()
            silent = total - weight.sum()
            speaks = (weight.sum() + 0.5) / (weight.sum() + silent + 1.0)
            log.append(np.log((counted + BACKING * alone) / (weight.sum() + BACKING)) + np.log(speaks))
        out[voted] = (log[1] - log[0])[of]
    return out


def fit_label_model(matrix: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(theta, strength, posterior) of votes (rows x voters) by expectation
    maximisation: theta[y, voter, vote + 1] is the probability of the vote given
    the label. Correlations that the label does not explain are estimated along
    with it, every fifth round, and voters that correlate count as one group; strength
    is the share that a voter does not repeat of others."""
    onehot = np.stack([matrix == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.array([0.02, 0.4, 0.95])[np.minimum((matrix > 0).sum(axis=1), 2)]
    theta = np.empty((2, matrix.shape[1], 3))
    groups = [[k] for k in range(matrix.shape[1])]
    shared = np.zeros((matrix.shape[1],) * 2)
    for step in range(rounds):
        for y, weight in ((0, 1 - posterior), (1, posterior)):
            counted = np.einsum("n,nkv->kv", weight, onehot) + 0.5
            theta[y] = counted / counted.sum(axis=1, keepdims=True)
        if step % 5 == 4:
            shared = correlations(matrix, posterior)
            groups = groups_of(shared)
        odds = sum(group_odds(matrix, posterior, theta, g) for g in groups)
        posterior = 1.0 / (1.0 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -500, 500)))
    return theta, 1.0 / (1.0 + np.where(shared > 0.1, shared, 0.0).sum(axis=1)), posterior


def fit_linear(rows: list[np.ndarray], target: np.ndarray, n_terms: int, rounds: int = 400, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on presence of terms, soft targets, full batches (Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    term = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int64)
    w = np.zeros(n_terms + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6))
    for step in range(1, rounds + 1):
        z = np.bincount(at, weights=w[term], minlength=len(rows)) + w[-1]
        error = 1.0 / (1.0 + np.exp(-z)) - target
        gradient = np.append(np.bincount(term, weights=error[at], minlength=n_terms), error.sum()) / len(rows)
        gradient[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes of a row's shingles, by which copies are found."""
    salts = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            h = shingles.shingle_hashes(shingles.words(text))
            keys.append([int(shingles.mix(h + s).min().astype(np.int64)) for s in salts] if len(h) else [0, 0, 0])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(3))], ["doc_id", "text", "toxic", "k0", "k1", "k2"])


def fold_of(doc_id: int) -> int:
    """The fold of the sample that a row is of."""
    return crc32(b"fold %d" % doc_id) % FOLDS


#: Terms that a task adds up before it hands its sums on.
HELD_TERMS = 1 << 17


def _counter(weigh, n: int):  # noqa: ANN001, ANN202
    """Adds up terms over rows: weigh(doc_id, toxic) says how much a row adds to each of n sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            flat = pa.array(sums[: len(place)].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * n, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), lists], ["term", "sums"])

        place: dict[str, int] = {}
        sums = np.zeros((1 << 14, n))
        for batch in batches:
            for doc_id, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = [place.setdefault(t, len(place)) for t in {t for w in distinct_words(text) for t in terms_of(w)}]
                while len(place) > len(sums):
                    sums = np.concatenate([sums, np.zeros_like(sums)])
                sums[at] += weigh(doc_id, toxic)
                if len(place) > HELD_TERMS:
                    yield out()
                    place, sums = {}, np.zeros((1 << 14, n))
        yield out()

    return count


def _summed(sample: DataFrame, weigh, n: int) -> DataFrame:  # noqa: ANN001
    found = sample.mapInArrow(tidied(_counter(weigh, n)), "term string, sums array<double>")
    return found.groupBy("term").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on the rows of docs (doc_id, text) that labels (doc_id, toxic) has: at
    most sample_rows of them, without the held-out ones. Of several labels of
    an id, the largest counts; null labels and ids don't. Without both kinds of
    rows, the model gives every text the share of toxic rows (0 if there are none)."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).alias("toxic"))
    rows = rows.mapInArrow(tidied(_keys), "doc_id long, text string, toxic int, k0 long, k1 long, k2 long")
    sample = written(rows, "sample")
    keys = sample.drop("text")
    for k in ("k0", "k1", "k2"):  # of copies, one
        keys = keys.join(keys.groupBy(k).agg(F.min("doc_id").alias("doc_id")), [k, "doc_id"], "left_semi")
    sample = written(sample.join(keys.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"), "sample")
    n, positive = sample.agg(F.count("*"), F.sum("toxic")).first()
    positive = positive or 0
    if not 0 < positive < n:
        return ToxicityModel(base=positive / n if n else 0.0)
    prior = positive / n

    # toxic and clean rows of each term, of each fold; a fold's lexicons are mined in the others
    def by_fold(doc_id: int, toxic: int) -> list[int]:
        own = [0] * (2 * FOLDS)
        own[2 * fold_of(doc_id) + (1 - toxic)] = 1
        return own

    counted = _summed(sample, by_fold, 2 * FOLDS)
    total = [sum((F.col(f"s{2 * h + y}") for h in range(FOLDS)), F.lit(0.0)) for y in (0, 1)]
    strong = written(counted.withColumn("toxic", total[0]).withColumn("clean", total[1]).where(F.col("toxic") >= MIN_SUPPORT), "terms")
    lexicons = []
    for h in range(FOLDS):
        toxic, clean = F.col("toxic") - F.col(f"s{2 * h}"), F.col("clean") - F.col(f"s{2 * h + 1}")
        precision = (toxic + 0.5) / (toxic + clean + 1.0)
        lift = F.log((toxic + 0.5) / (clean + 0.5)) * F.sqrt(toxic)
        top = strong.where((toxic >= MIN_SUPPORT) & (precision >= MIN_PRECISION)).orderBy(lift.desc(), "term").limit(MAX_TERMS)
        lexicons.append(lexicons_of([r.term for r in top.select("term").collect()]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [votes(x, lexicons[fold_of(i)]).tobytes() for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["doc_id", "votes"])

    found = sample.mapInArrow(tidied(vote), "doc_id long, votes binary").toArrow().sort_by("doc_id")
    ids = found.column("doc_id").to_pylist()
    matrix = np.stack([np.frombuffer(x, dtype=np.int8) for x in found.column("votes").to_pylist()]).astype(int)
    theta, strength, posterior = fit_label_model(matrix, prior)

    # terms by posterior rows, those that speak for either label
    share = dict(zip(ids, posterior.tolist()))
    shared = sample.sparkSession.sparkContext.broadcast(share)
    total = float(posterior.sum())
    counted = _summed(sample, lambda i, _: [shared.value[i], 1 - shared.value[i]], 2)
    lift = F.log(((F.col("s0") + 0.5) / (total + 1.0)) / ((F.col("s1") + 0.5) / (n - total + 1.0)))
    speaks = F.when(lift > 0, F.col("s0")).otherwise(F.col("s1"))
    top = counted.where((speaks >= MIN_EVIDENCE) & (F.abs(lift) >= MIN_LIFT)).orderBy((F.abs(lift) * F.sqrt(speaks)).desc(), "term").limit(MAX_TERMS).collect()
    index = {r.term: i for i, r in enumerate(top)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({index[t] for w in distinct_words(x) for t in terms_of(w) if t in index}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "terms"])

    lists = sample.mapInArrow(tidied(features), "doc_id long, terms array<int>").toArrow().sort_by("doc_id").column("terms").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    given = [values[a:b] for a, b in zip(offsets, offsets[1:])]
    # a text without terms is like the rows that no voter calls toxic, not like the mean row
    unsaid = (matrix <= 0).all(axis=1)
    empty = np.full(-(-n // EMPTY_SHARE), posterior[unsaid].mean() if unsaid.any() else 0.0)
    weights, bias = fit_linear(given + [values[:0]] * len(empty), np.append(posterior, empty), len(top))
    return ToxicityModel(prior, bias, {r.term: float(w) for r, w in zip(top, weights)}, tuple(lexicons), theta, strength, prior)


def toxicity_score(text: str | None, model: ToxicityModel, cache: dict[str, tuple] | None = None) -> float:
    """Between 0 and 1; null and empty texts get what a text without terms gets."""
    if model.bias is None:
        return model.base
    cache = {} if cache is None else cache
    if len(cache) > 1 << 15:
        cache.clear()
    present: set[str] = set()
    for word in distinct_words(text):
        known = cache.get(word)
        if known is None:
            known = cache[word] = tuple(t for t in terms_of(word) if t in model.weights)
        if known:
            present.update(known)
    z = model.bias + sum(model.weights[t] for t in sorted(present))
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs, repeated rows and null
    ids included; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            scores = np.array([toxicity_score(x, shared.value, cache) for x in batch.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(score), f"doc_id {kind}, score double, predicted int")


def is_toxic(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """A predicate that holds for the texts that score_toxicity() predicts 1 for."""
    shared = spark.sparkContext.broadcast(model)

    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, tuple] = {}
        for texts in batches:
            yield pa.array([toxicity_score(x, shared.value, cache) >= THRESHOLD for x in texts.to_pylist()], pa.bool_())

    @F.arrow_udf("boolean")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return found(batches)

    return toxic(text)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that a model fitted on them and labels
    (doc_id, toxic) does not reject, with all their columns."""
    model = fit_toxicity(docs, labels)
    return docs.where(~is_toxic(docs.sparkSession, model, F.col("text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
