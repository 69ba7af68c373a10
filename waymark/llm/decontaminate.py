"""Benchmark decontamination: every passage of every document is a query to a
BM25 index of the test items, run by block-max WAND for all items above a
threshold; what it finds is verified by overlap with the item's question and
answer.

A score is the share of an item's own BM25 score (that of the item as a query to
itself) which a passage reaches, so one threshold fits long and short items. The
corpus statistics behind it (how many items there are and have a word, their mean and
largest length) are those of all items, in however many indexes they are held.

An edited word takes up to five shingles with it, most of those of a short item. So an
item that lacks shingles is verified by its words, too: those that stand in their order,
none shifted by more than one place against the others, must be nearly all or all but one.

Items of fewer than five words are too short to score: a document holds one if it
has its words side by side.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import shingles
from waymark.llm.common import table, tidied, written

#: BM25's constants.
K1, B = 1.2, 0.75
#: The share of an item's own score from which a passage is verified, and the
#: shares of its five-word shingles that the document must have: of all, and of
#: the question and the answer each.
RETRIEVE, OVERLAP, PART_OVERLAP = 0.5, 0.8, 0.5
#: Where shingles do not suffice: the share of an item's words that must be aligned (or
#: all but one), and what share of them must have one and the same shift. Items of so many
#: words are aligned only if they share a shingle: one edit leaves some.
ALIGNED, DIAGONAL, LONG_ITEM = 0.9, 0.45, 10
#: Items of a block of a posting list. Terms in over COMMON of the blocks are
#: bounded by one number for all blocks when windows are sifted.
BLOCK, COMMON = 2, 0.9
#: Characters of test items in one broadcast index; more items go to several indexes.
#: An index takes up to 15 bytes a character, in every worker.
INDEX_CHARS = 1 << 22
#: Steps times blocks that are sifted at a time.
CELLS = 1 << 21


def question_and_answer(tokens: list[str], text: str) -> int:
    """How many of the words are the question: those up to the first question
    mark that has words on both sides, else the first half."""
    at = text.find("?")
    n = len(shingles.words(text[:at])) if at >= 0 else 0
    return n if 0 < n < len(tokens) else -(-len(tokens) // 2)


@dataclass
class Statistics:
    """Of all items of five words or more: how many there are, their mean and largest
    number of words, and in how many each word is."""

    items: int
    mean: float
    longest: int
    frequency: dict[str, int]


def statistics(counts: list[Counter]) -> Statistics:
    lengths = [sum(c.values()) for c in counts]
    return Statistics(len(counts), sum(lengths) / max(len(lengths), 1), max(lengths, default=1), Counter(t for c in counts for t in c))


class Hashes:
    """Arrays of hashes (or other numbers), one after the other."""

    def __init__(self, own: list[np.ndarray], kind: type = np.uint64) -> None:
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.all = np.concatenate(own) if own else np.empty(0, dtype=kind)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all[self.start[i] : self.start[i + 1]]


class Index:
    """items: (item_id, text). Those of fewer words than a shingle are held apart, by
    the hash of their words; with whole, the statistics are taken from there. Lists
    lie side by side in arrays, so an index is small in every worker."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None) -> None:
        counts, hashes, sizes, short, own_words, questions = [], ([], [], []), [], {}, [], []
        self.ids = array("q")
        for item_id, text in items:
            tokens = shingles.words(text)
            if len(tokens) >= shingles.SHINGLE:
                n = question_and_answer(tokens, text)
                parts = (tokens, tokens[:n], tokens[n:])
                self.ids.append(item_id)
                for own, x in zip(hashes, parts):
                    own.append(np.unique(shingles.shingle_hashes(x)))
                sizes.append([min(len(x), shingles.SHINGLE) for x in parts])
                counts.append(Counter(tokens))
                own_words.append(tokens)
                questions.append(n)
            elif tokens:
                short.setdefault((len(tokens), int(shingles.shingle_hashes(tokens)[0])), []).append(item_id)
        #: hashes of the whole items, the questions and the answers, and the words of their shingles
        self.hashes = [Hashes(x) for x in hashes]
        self.sizes = np.array(sizes, dtype=np.int8).reshape(-1, 3)
        self.short = short
        self.short_hashes = {n: np.array(sorted(h for m, h in short if m == n), dtype=np.uint64) for n in {n for n, _ in short}}
        known = whole or statistics(counts)
        self.longest = known.longest
        terms = sorted({t for c in counts for t in c})
        self.term = {t: i for i, t in enumerate(terms)}
        #: the words of the items in order, and how many of them are the question
        self.words = Hashes([np.array([self.term[t] for t in x], dtype=np.int32) for x in own_words], np.int32)
        self.questions = np.array(questions, dtype=np.int32)
        idf = [math.log(1 + (known.items - known.frequency[t] + 0.5) / (known.frequency[t] + 0.5)) for t in terms]
        term, item, score = array("i"), array("i"), array("d")
        for i, own in enumerate(counts):
            length = sum(own.values())
            at = [self.term[t] for t in own]
            part = [idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / known.mean)) for t, n in zip(at, own.values())]
            total = sum(part)
            term.extend(at), item.extend([i] * len(at)), score.extend([x / total for x in part])
        terms_of, items_of, scores_of = (np.array(x) for x in (term, item, score))
        order = np.lexsort((items_of, terms_of))
        terms_of, items_of, scores_of = terms_of[order], items_of[order], scores_of[order]
        #: posting lists: those of term t from posted[t] to posted[t + 1]
        self.posted = array("q", np.searchsorted(terms_of, np.arange(len(terms) + 1)).tolist())
        self.postings, self.scores = array("i", items_of.astype(np.int32).tobytes()), array("d", scores_of.tobytes())
        # each list's blocks, and their largest scores
        first = np.flatnonzero(np.diff(terms_of, prepend=-1) | np.diff(items_of // BLOCK, prepend=-1))
        bounds = np.maximum.reduceat(scores_of, first) if len(first) else np.empty(0)
        self.blocked = array("q", np.searchsorted(terms_of[first], np.arange(len(terms) + 1)).tolist())
        self.blocks, self.block_bounds = array("i", (items_of[first] // BLOCK).astype(np.int32).tobytes()), array("d", bounds.tobytes())
        starts = np.array(self.blocked[:-1], dtype=np.int64)
        self.bound = array("d", (np.maximum.reduceat(bounds, starts) if len(starts) else np.empty(0)).tobytes())
        # the block bounds of all windows of a text are added up at once, but for common terms
        self.n_blocks = -(-max(len(counts), 1) // BLOCK)
        lengths = np.diff(np.array(self.blocked))
        common = lengths > COMMON * self.n_blocks
        self.common_bound = np.where(common, np.array(self.bound), 0.0)
        self.sift_start, self.sift_length = starts, np.where(common, 0, lengths)

    def nbytes(self) -> int:
        """About how much memory it takes in a worker: its arrays, and 150 bytes a word or short item."""
        lists = [self.ids, self.posted, self.postings, self.scores, self.blocked, self.blocks, self.block_bounds, self.bound]
        arrays = [x for h in [*self.hashes, self.words] for x in (h.start, h.all)] + [self.questions, self.sizes, self.common_bound, self.sift_start, self.sift_length]
        return sum(len(x) * x.itemsize for x in lists) + sum(x.nbytes for x in arrays) + 150 * (len(self.term) + len(self.short))

    def search(self, terms: list[int], least: float) -> dict[int, float]:
        """Block-max WAND: every item whose score for the distinct terms is at
        least the threshold."""
        out: dict[int, float] = {}
        least -= 1e-9
        bound, postings, scores, blocks, bounds = self.bound, self.postings, self.scores, self.blocks, self.block_bounds
        # next item, term, place in the list, its end, place in the list's blocks, their end
        cursors = [[postings[self.posted[t]], t, self.posted[t], self.posted[t + 1], self.blocked[t], self.blocked[t + 1]] for t in terms]
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += bound[c[1]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, most = item // BLOCK, 0.0
            for c in cursors[: pivot + 1]:
                k, end = c[4], c[5]
                while k < end and blocks[k] < block:
                    k += 1
                c[4] = k
                if k < end and blocks[k] == block:
                    most += bounds[k]
            if most >= least:
                if cursors[0][0] == item:
                    score = sum([scores[c[2]] for c in cursors[: pivot + 1]])
                    if score >= least:
                        out[item] = score
                    to, moved = item + 1, pivot + 1
                else:  # the lists before the pivot catch up with it
                    to, moved = item, next(k for k, c in enumerate(cursors) if c[0] == item)
            else:  # nothing in this block: on to its end, or to where another list joins
                to, moved = (block + 1) * BLOCK, pivot + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
            ended = False
            for c in cursors[:moved]:
                k, end = c[2], c[3]
                while k < end and postings[k] < to:
                    k += 1
                c[2] = k
                if k < end:
                    c[0] = postings[k]
                else:
                    ended = True
                    c[0] = -1
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return out

    def retrieve(self, tokens: list[str], least: float = RETRIEVE) -> dict[int, float]:
        """The best score of each item that any passage retrieves. Passages are
        windows of one and a half times the longest item that begin at every
        half of it, so an item lies within one of them. Texts of any length are
        taken in parts that leave out no window, so scores do not depend on them."""
        step = max(1, -(-self.longest // 2))
        most = max(4, CELLS // self.n_blocks) * step
        if len(tokens) > most:  # in parts that share two steps, so that every window is in one
            parts = [self.retrieve(tokens[i : i + most], least) for i in range(0, len(tokens) - 2 * step, most - 2 * step)]
            return {i: max(x.get(i, 0.0) for x in parts) for i in {i for x in parts for i in x}}
        known = self.term
        terms = np.array([known.get(t, -1) for t in tokens], dtype=np.int64)
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return {}
        # each step's distinct terms; a window is three steps
        keys = np.unique(at // step * len(known) + terms[at])
        step_of, terms = keys // len(known), keys % len(known)
        steps = -(-len(tokens) // step)
        common = np.bincount(step_of, weights=self.common_bound[terms], minlength=steps)
        first, n = self.sift_start[terms], self.sift_length[terms]
        total = int(n.sum())
        place = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        cell = np.repeat(step_of, n) * self.n_blocks + np.frombuffer(self.blocks, dtype=np.int32)[place]
        rare = np.bincount(cell, weights=np.frombuffer(self.block_bounds)[place], minlength=steps * self.n_blocks).reshape(steps, self.n_blocks)
        sums = np.pad(rare + common[:, None], ((0, 2), (0, 0)))
        windows = np.flatnonzero((sums[:-2] + sums[1:-1] + sums[2:]).max(axis=1) >= least - 1e-9)
        low, high = np.searchsorted(step_of, windows), np.searchsorted(step_of, windows + 3)
        best: dict[int, float] = {}
        for a, b in zip(low.tolist(), high.tolist()):
            for item, score in self.search(np.unique(terms[a:b]).tolist(), least).items():
                best[item] = max(best.get(item, 0.0), score)
        return best

    def overlaps(self, tokens: list[str], least: float = RETRIEVE) -> list[tuple[int, float, float, float, float, float | None]]:
        """(item_id, score, overlap, question's, answer's, aligned) of the items found and
        verified in the words; aligned is the share of aligned words where shingles do not
        suffice, else None."""
        retrieved = self.retrieve(tokens, least)
        if not retrieved:
            return []
        found: dict[int, np.ndarray] = {}
        out, terms = [], None
        for i, score in sorted(retrieved.items()):
            shares = [self._share(x[i], tokens, found, n) for x, n in zip(self.hashes, self.sizes[i].tolist())]
            if shares[0] >= OVERLAP and min(shares[1:]) >= PART_OVERLAP:
                out.append((self.ids[i], score, *shares, None))
            elif shares[0] > 0 or len(self.words[i]) < LONG_ITEM:
                if terms is None:
                    terms = np.array([self.term.get(t, -1) for t in tokens], dtype=np.int32)
                part = self.aligned(i, terms)
                if part is not None:
                    out.append((self.ids[i], score, *shares, part))
        return out

    def aligned(self, i: int, terms: np.ndarray) -> float | None:
        """The largest share of the item's words that stand in the text with one shift or
        one more or less, if that makes an edited item of it. Only shifts that a share of
        DIAGONAL of the words have by themselves are looked at."""
        own = self.words[i]
        n, question = len(own), int(self.questions[i])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.isin(terms, own))
        low, high = (np.searchsorted(own[order], terms[at], side=side) for side in ("left", "right"))
        times = high - low
        place = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        word = order[place]
        shift = np.repeat(at, times) - word
        best = None
        shifts, held = np.unique(shift, return_counts=True)
        for x in shifts[held >= DIAGONAL * n].tolist():
            found = np.unique(word[np.abs(shift - x) <= 1])
            asked, rest = int((found < question).sum()), int((found >= question).sum())
            if len(found) >= min(ALIGNED * n, n - 1) and asked >= PART_OVERLAP * question and rest >= PART_OVERLAP * (n - question):
                best = max(best or 0.0, len(found) / n)
        return best

    def runs(self, tokens: list[str]) -> list[int]:
        """The item_ids of the short items whose words stand side by side in the words."""
        out = []
        for n, hashes in self.short_hashes.items():
            if len(tokens) >= n:
                own = np.unique(shingles.shingle_hashes(tokens, n))
                for h in own[np.isin(own, hashes)].tolist():
                    out += self.short[n, h]
        return out

    def holds(self, tokens: list[str]) -> bool:
        return bool(self.overlaps(tokens) or self.runs(tokens))

    @staticmethod
    def _share(part: np.ndarray, tokens: list[str], sizes: dict[int, np.ndarray], n: int) -> float:
        """Of a part's shingles, the share that the words have; a part of fewer
        than five words is one shorter shingle, no words at all are there always."""
        if not len(part):
            return 1.0
        if n not in sizes:
            sizes[n] = np.unique(shingles.shingle_hashes(tokens, n)) if len(tokens) >= n else np.empty(0, dtype=np.uint64)
        return float(np.isin(part, sizes[n]).mean())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, n) of the distinct words of each item of five words or more; under
    a null term the number of its words."""
    for batch in batches:
        parts, terms, n = [], [], []
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = shingles.words(text)
            if len(tokens) >= shingles.SHINGLE:
                own = [None, *set(tokens)]
                parts += [part] * len(own)
                terms += own
                n += [len(tokens)] + [1] * (len(own) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["part", "term", "n"])


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes of all items with an id and a text; each holds about chars
    characters at most (or one longer item), so each can be broadcast. Scores are
    the same however many indexes there are."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = total // chars + 1
    if parts == 1:
        yield Index(sorted((r.item_id, r.text) for r in rows.collect()))
        return
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")
    found = written(rows.select("part", "text").mapInArrow(_terms, "part int, term string, n long"), "terms")
    items, words, longest = found.where("term is null").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    frequency = written(found.where("term is not null").groupBy("term").agg(F.count("*").alias("f")), "frequency")
    for part in range(parts):
        own = found.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct().join(frequency, "term")
        whole = Statistics(items, words / max(items, 1), longest or 1, {r.term: r.f for r in own.collect()})
        yield Index(sorted((r.item_id, r.text) for r in rows.where(F.col("part") == part).collect()), whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = INDEX_CHARS, short: bool = False) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap, aligned): a row
    for each row of docs and each test item that it contains, edited items too; aligned is
    null where the shares of shingles suffice. Null and empty
    texts contain none; a null doc_id is reported as such. Equal items of one id
    count once. Items without a word are in none; those of fewer than five words
    are looked for only with short, as exact runs of words, all of whose shares
    are 1. Other columns are not looked at. An empty table gives an empty result."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "aligned"]
    out = None
    for index in indexes(benchmark, chars=chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                found = []
                for i, own in enumerate(batch.column(1).to_pylist()):
                    tokens = shingles.words(own)
                    found += [(i, x) for x in shared.value.overlaps(tokens)]
                    found += [(i, (x, 1.0, 1.0, 1.0, 1.0, None)) for x in (shared.value.runs(tokens) if short else ())]
                ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for _, x in found], pa.int64()), *(pa.array([x[k] for _, x in found], pa.float64()) for k in range(1, 6))], names)

        part = rows.mapInArrow(tidied(find), f"doc_id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double, aligned double")
        out = part if out is None else out.unionByName(part)
    return out


def holds_item(spark: SparkSession, index: Index, text: Column) -> Column:
    """A predicate that holds for the texts that contain an item of the index, short ones too."""
    shared = spark.sparkContext.broadcast(index)

    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.holds(shingles.words(x)) for x in texts.to_pylist()], pa.bool_())

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return found(batches)

    return holds(text)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (text, ...) that contain no test item, short ones too, with
    all their columns."""
    for index in indexes(benchmark):
        docs = docs.where(~holds_item(docs.sparkSession, index, F.col("text")))
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
    return out.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap", "aligned")))


#: The same from the definitions: every window against every item that shares a word.
ORACLE = r"""
WITH tok AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id, text) AS i, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t,
    regexp_extract_all(lower(CASE WHEN strpos(text, '?') > 0 THEN text[:strpos(text, '?') - 1] ELSE '' END), '[\p{L}\p{N}_]+') AS q
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
), item AS (
  SELECT *, len(t) AS l, CASE WHEN len(q) > 0 AND len(q) < len(t) THEN len(q) ELSE (len(t) + 1) // 2 END AS nq FROM tok WHERE len(t) >= 5
), tf AS (SELECT i, term, count(*) AS n FROM (SELECT i, unnest(t) AS term FROM item) GROUP BY ALL),
df AS (SELECT term, count(*) AS f FROM tf GROUP BY term),
stats AS (SELECT count(*) AS items, avg(l) AS mean, (max(l) + 1) // 2 AS step FROM item),
part AS (
  SELECT i, term, ln(1 + (items - f + 0.5::DOUBLE) / (f + 0.5::DOUBLE)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean)) AS x
  FROM tf JOIN df USING (term) JOIN item USING (i), stats
), c AS (SELECT i, term, x / sum(x) OVER (PARTITION BY i) AS x FROM part),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL),
pos AS (
  SELECT DISTINCT r, term, (p - 1) // step AS s FROM (SELECT r, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM doc), stats
  WHERE term IN (SELECT term FROM df)
), win AS (SELECT DISTINCT r, term, s - k AS w FROM pos, (SELECT unnest([0, 1, 2]) AS k) WHERE s >= k),
found AS (
  SELECT r, i, max(x) AS score FROM (SELECT r, w, i, sum(x) AS x FROM win JOIN c USING (term) GROUP BY ALL) GROUP BY ALL HAVING max(x) >= 0.5 - 1e-9
), parts AS (
  SELECT i, 0 AS k, t AS p FROM item UNION ALL SELECT i, 1, t[:nq] FROM item UNION ALL SELECT i, 2, t[nq + 1:] FROM item
), need AS (
  SELECT DISTINCT i, k, least(5, len(p)) AS n, unnest(list_transform(range(1, len(p) - least(5, len(p)) + 2), lambda j: array_to_string(p[j:j + least(5, len(p)) - 1], ' '))) AS sh FROM parts
), have AS (
  SELECT DISTINCT r, n, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda j: array_to_string(t[j:j + n - 1], ' '))) AS sh
  FROM doc JOIN (SELECT DISTINCT r FROM found) USING (r), (SELECT DISTINCT n FROM need)
), shares AS (
  SELECT r, i, score, k, count(h.sh) / count(*) AS share FROM found JOIN need USING (i) LEFT JOIN have h USING (r, n, sh) GROUP BY ALL
), wide AS (
  SELECT r, i, score, max(share) FILTER (k = 0) AS a, max(share) FILTER (k = 1) AS b, max(share) FILTER (k = 2) AS c FROM shares GROUP BY ALL
), rest AS (
  SELECT r, i, l, nq FROM wide JOIN item USING (i) WHERE NOT (a >= 0.8 AND b >= 0.5 AND c >= 0.5) AND (a > 0 OR l < 10)
), pairs AS (
  SELECT w.r, w.i, w.l, w.nq, j, p - j AS d FROM (SELECT r, i, l, nq, unnest(t) AS term, generate_subscripts(t, 1) AS j FROM rest JOIN (SELECT i, t FROM item) USING (i)) w
  JOIN (SELECT r, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM doc JOIN (SELECT DISTINCT r FROM rest) USING (r)) x ON x.r = w.r AND x.term = w.term
), shifts AS (SELECT r, i, d FROM pairs GROUP BY r, i, d HAVING count(*) >= 0.45 * any_value(l)),
aligned AS (
  SELECT r, i, max(n / l) AS aligned FROM (
    SELECT r, i, any_value(l) AS l, any_value(nq) AS nq, count(DISTINCT j) AS n, count(DISTINCT j) FILTER (j <= nq) AS asked
    FROM pairs JOIN shifts s USING (r, i) WHERE abs(pairs.d - s.d) <= 1 GROUP BY r, i, s.d
  ) WHERE n >= least(0.9 * l, l - 1) AND asked >= 0.5 * nq AND n - asked >= 0.5 * (l - nq) GROUP BY r, i
)
SELECT doc_id, item_id, round(score, 6) AS score, round(a, 6) AS overlap, round(b, 6) AS question_overlap, round(c, 6) AS answer_overlap, round(aligned, 6) AS aligned
FROM wide JOIN doc USING (r) JOIN item USING (i) LEFT JOIN aligned USING (r, i) WHERE aligned IS NOT NULL OR a >= 0.8 AND b >= 0.5 AND c >= 0.5
UNION ALL
SELECT doc_id, item_id, 1.0, 1.0, 1.0, 1.0, NULL
FROM (SELECT item_id, array_to_string(t, ' ') AS run FROM tok WHERE len(t) BETWEEN 1 AND 4) JOIN doc ON contains(' ' || array_to_string(doc.t, ' ') || ' ', ' ' || run || ' ')
"""
