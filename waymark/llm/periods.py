"""Periodic runs of words, and texts without their repetitions.

A run of period q is at least max(24, 3 q) words long, so that it and itself q words on
share 16 words at least. Each word of a run is therefore in a stretch of 16 words that
occurs twice in the document: words outside such stretches cannot be in runs. What is
left, mostly nothing, is searched as Main and Lorentz do: a segment is halved again and
again, and for each period the run across the middle is as long as words agree with those
a period away, to the left and to the right. Agreement is looked up by ranks of the
stretches of 1, 2, 4, 8, ... words, for all middles and periods of a level at once.

The documents of a batch are searched together, as one array with a mark of its own
between any two, which nothing agrees with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table, tidied

#: A run has so many words at least, and its period so many times.
LENGTH, TIMES = 24, 3
#: Words that a run and its copy one period on share at least: LENGTH - q, or (TIMES - 1) q where that is more.
OVERLAP = min(max(LENGTH - q, (TIMES - 1) * q) for q in range(1, LENGTH))
#: Words on one side of a run's middle that agree with those a period on: what half a run has beyond a period.
AGREE = min(max(-(-LENGTH // 2) - q, -(-TIMES * q // 2) - q) for q in range(1, LENGTH))
#: Bytes of text searched at a time; a longer text is searched by itself, in some 100 bytes for each word that is left.
TOGETHER = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _marked(parts: list[np.ndarray]) -> np.ndarray:
    """One array of all parts, after each a negative number of its own."""
    out = np.empty(sum(map(len, parts)) + len(parts), dtype=np.int64)
    at = 0
    for i, part in enumerate(parts):
        out[at : at + len(part)] = part
        out[at + len(part)] = -1 - i
        at += len(part) + 1
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _ODD


def repeated(words: np.ndarray, gram: int = OVERLAP) -> np.ndarray:
    """Of an array of _marked(), the words in some stretch of gram words that occurs
    twice in its document. Stretches are compared by 64-bit hashes: now and then a word
    is left that need not be, never the other way."""
    n = len(words) - gram + 1
    if n < 2:
        return np.zeros(len(words), dtype=bool)
    part = (words.astype(np.uint64) + np.uint64(1)) * _ODD
    document = np.cumsum(np.concatenate([[False], words[: n - 1] < 0])).astype(np.uint64)
    h, have, width = document * _ODD, 0, 1
    while True:  # gram as a sum of powers of two
        if gram & width:
            h = _mixed(h) + part[have : have + n]
            have += width
        if 2 * width > gram:
            break
        part = _mixed(part[:-width]) + part[width:]
        width *= 2
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    steps[:n] += twice
    steps[gram : gram + n] -= twice
    return (np.cumsum(steps[:-1]) > 0) & (words >= 0)


class Agreement:
    """How far two places of an array agree, onwards and backwards."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.ranks) - 1) <= max(longest, AGREE):
            r, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            if len(r) <= step:
                break
            pair = r[:-step].astype(np.int64) * (int(r.max()) + 1) + r[step:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def equal(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """Whether the 2^level words from i < j on are the same."""
        r = self.ranks[level]
        fits = (i >= 0) & (j < len(r))
        out = np.zeros(len(i), dtype=bool)
        out[fits] = r[i[fits]] == r[j[fits]]
        return out

    def onwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j > i on."""
        n = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            n += self.equal(i + n, j + n, level).astype(np.int64) << level
        return n

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and before j > i."""
        n = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            n += self.equal(i - n - (1 << level), j - n - (1 << level), level).astype(np.int64) << level
        return n


def across_middles(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in the segments [low, high) of an array of
    _marked(), in order of start and period."""
    known = Agreement(words, int((high - low).max()))
    level = AGREE.bit_length() - 1
    found = []
    while len(low):
        middle, most = (low + high) // 2, (high - low) // TIMES
        node = np.repeat(np.arange(len(low)), most)
        period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        c = middle[node]
        # of a run across c, the half that is longer agrees for AGREE words with what is a period away
        right = known.equal(c, c + period, level)
        left = known.equal(c - period - (1 << level), c - (1 << level), level)
        i = np.concatenate([c[right], c[left] - period[left]])
        p = np.concatenate([period[right], period[left]])
        before = known.backwards(i, i + p)
        length = before + p + known.onwards(i, i + p)
        good = length >= np.maximum(LENGTH, TIMES * p)
        found.append(np.stack([i[good] - before[good], length[good], p[good]], axis=1))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        wide = high - low >= LENGTH
        low, high = low[wide], high[wide]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch of period q has periods 2 q, 3 q, ... too: the first counts
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each document, whose words are given as
    numbers from 0 on, in order of start and period."""
    words = _marked(documents)
    starts = np.cumsum([0] + [len(d) + 1 for d in documents])
    left = repeated(words)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    wide = high - low >= LENGTH
    low, high = low[wide], high[wide]
    if not len(low):
        return [np.empty((0, 3), dtype=np.int64)] * len(documents)
    segments = [words[a:b] for a, b in zip(low, high)]
    packed = np.cumsum([0] + [len(s) + 1 for s in segments])
    runs = across_middles(_marked(segments), packed[:-1], packed[1:] - 1)
    own = np.searchsorted(packed, runs[:, 0], side="right") - 1
    runs[:, 0] += low[own] - packed[own]
    document = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs[:, 0] -= starts[document]
    bounds = np.searchsorted(document, np.arange(len(documents) + 1))
    return [runs[a:b] for a, b in zip(bounds, bounds[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words those that are in no run beyond its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def _together(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of TOGETHER bytes at most, or of one text."""
    start = size = 0
    for i, raw in enumerate(raws):
        if i > start and size + len(raw) > TOGETHER:
            yield start, i
            start, size = i, 0
        size += len(raw)
    yield start, len(raws)


def search(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(words, runs, text without repetitions) of each text in UTF-8. bytes.split()
    parts words at the six white space characters of ASCII, and at no others."""
    for a, b in _together(raws) if raws else ():
        split = [raw.split() for raw in raws[a:b]]
        ids = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.cumsum([0] + [len(words) for words in split])
        for words, runs in zip(split, runs_of([ids[x:y] for x, y in zip(bounds, bounds[1:])])):
            if len(runs):
                yield len(words), runs, b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()])
            else:
                yield len(words), runs, b" ".join(words)


RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs, repeated rows and null ids
    included. Words are what stands between the white space of ASCII. runs holds (start,
    length, period) of every run, by start and period: words that equal those a period on
    (the smallest such period), LENGTH words and TIMES the period at least, and neither
    neighbour goes on with it. collapsed has the words that are in no run beyond its first
    period, joined by one space. Null and empty texts have no words, no runs and an empty
    collapsed. A text of any length is searched whole. Other columns are not looked at."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(search([x or b"" for x in batch.column(1).to_pylist()]))
            flat = np.concatenate([np.empty((0, 3), dtype=np.int64), *(r for _, r, _ in found)])
            offsets = np.cumsum([0] + [len(r) for _, r, _ in found])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), lists, pa.array([x for _, _, x in found], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(find), f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run that repeats its period most often, by exact fractions; of equals the first
    by start, then by period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        more, less = run.length * best.period, best.length * run.period
        ahead = (more > less) | ((more == less) & (F.struct(run.start, run.period) < F.struct(best.start, best.period)))
        return F.when(best.isNull() | ahead, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def with_periods(docs: DataFrame) -> DataFrame:
    """documents, of which one in ten by the CRC-32 of its id goes on, from some word of
    it, repeating what follows: word a + (i - a) % p stands at each place i >= a."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(unit, times))), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best.length / best.period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same from the definitions: all pairs of equal words of a document, by how far they are apart.
ORACLE = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM documents, tab
), cut AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM doc),
part AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
word AS MATERIALIZED (
  SELECT r, i, n, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM (SELECT r, a, p, n, w, unnest(range(n)) AS i FROM part)
), pair AS (
  SELECT l.r, l.i, m.i - l.i AS q FROM word l JOIN word m ON l.r = m.r AND l.x = m.x AND m.i > l.i AND 3 * (m.i - l.i) <= l.n
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k
), run AS (
  SELECT r, start, length, min(q) AS period FROM stretch WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length
), best AS (
  SELECT r, start, length, period FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) = 1
), lines AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS s FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM doc LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
