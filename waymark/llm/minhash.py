"""Near duplicates by ProbMinHash, banding and verification.

Documents with the same words are one class from the start, and only the one
of the smallest id is signed further. Signatures are cut into bands; within a
bucket of equal bands the documents are compared with the bucket's first one
(a star, not all pairs), and components are formed. What is still apart in a
bucket is compared in blocks: a task gets two blocks of bounded size, multiplies
their shingle matrices (hashes, never texts) and returns one link for each two components it joins,
no pairs. No pair that banding brings together is left out unless a chain of
verified links joins it already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm import shingles
from waymark.llm.common import components, id_filter, table, tidied, written

#: 40 bands of 5 registers: a pair of similarity 0.8 is missed with probability 1.3e-7.
BANDS, BAND_ROWS = 40, 5
#: Pairs whose signatures agree in less than the threshold minus this are not
#: verified: over five standard deviations of the estimate at 0.8.
ESTIMATE_MARGIN = 0.16
#: Documents, and shingles, of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1 << 19
#: Shingles that a block's matrices span at a time.
BLOCK_COLUMNS = 4096


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            same, signature, bands = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles.words(text)
                if not tokens:
                    same.append(None), signature.append(None), bands.append(None)
                    continue
                own = shingles.prob_min_hash(*shingles.weighted_shingles(tokens), BANDS * BAND_ROWS)
                h = salt.copy()
                for column in own.reshape(BANDS, BAND_ROWS).T:
                    h = shingles.mix(h + column)
                same.append(hashlib.blake2b(" ".join(tokens).encode(), digest_size=16).digest())
                signature.append(own.astype(np.uint16).tobytes())
                bands.append(h.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "same", "signature", "bands"],
            )


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = [float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean()) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["a", "b", "estimate"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted shingles of each text: hashes, and weights (null: all are 1). What
    is compared later are these, so a text is read and hashed once."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            hashes, weights = [], []
            for text in batch.column(1).to_pylist():
                own, n = shingles.weighted_shingles(shingles.words(text))
                hashes.append(own.tobytes())
                weights.append(n.astype(np.uint32).tobytes() if (n > 1).any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], ["doc_id", "hashes", "weights"])


def bag_of(hashes: pa.Scalar, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(hashes.as_py(), dtype=np.uint64)
    return own, np.frombuffer(weights.as_py(), dtype=np.uint32) if weights.is_valid else np.ones(len(own), dtype=np.uint32)


def _verifier(threshold: float):  # noqa: ANN202
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            similarity = [shingles.probability_jaccard(bag_of(w, x), bag_of(y, z)) for w, x, y, z in zip(*(batch.column(i) for i in range(2, 6)))]
            keep = [i for i, s in enumerate(similarity) if s >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([similarity[i] for i in keep], pa.float64())], ["a", "b", "similarity"])

    return verify


def verified_pairs(pairs: DataFrame, signed: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The (a, b, similarity) of pairs (a, b) that reach the threshold."""
    x = signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("x"))
    y = signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("y"))
    likely = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(_estimates), "a long, b long, estimate double")
    likely = written(likely.where(F.col("estimate") >= threshold - ESTIMATE_MARGIN).select("a", "b").distinct(), "likely")
    full = likely.join(bags.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa")), "a")
    full = full.join(bags.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb")), "b").select("a", "b", "ha", "wa", "hb", "wb")
    return full.mapInArrow(tidied(_verifier(threshold)), "a long, b long, similarity double")


def _block_links(threshold: float):  # noqa: ANN202
    def shares(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair, how many shingles are common, and their share in either's weight."""
        ids = np.concatenate([x[0] for x in (*left, *right)])
        known, times = np.unique(ids, return_counts=True)
        known = known[times > 1]
        out = [np.zeros((len(left), len(right))) for _ in range(3)]
        for at in range(0, len(known), BLOCK_COLUMNS):
            columns = known[at : at + BLOCK_COLUMNS]
            sides = []
            for rows in (left, right):
                has, share = np.zeros((2, len(rows), len(columns)), dtype=np.float32)
                for i, (own, weight) in enumerate(rows):
                    where = np.searchsorted(columns, own)
                    where[where == len(columns)] = 0
                    hit = columns[where] == own
                    has[i, where[hit]] = 1
                    share[i, where[hit]] = weight[hit] / weight.sum()
                sides.append((has, share))
            (has_x, share_x), (has_y, share_y) = sides
            for total, part in zip(out, (has_x @ has_y.T, share_x @ has_y.T, has_x @ share_y.T)):
                total += part
        return tuple(out)

    def links(group: pa.Table) -> pa.Table:
        """One verified link for each two components that the blocks join. The
        common shingles' share in either weight bounds the similarity from above."""
        a = [i for i, x in enumerate(group.column("side").to_pylist()) if x == 0]
        b = [i for i, x in enumerate(group.column("side").to_pylist()) if x == 1] or a
        ids, parts = group.column("doc_id").to_numpy(), group.column("part").to_numpy()
        hashes, weights = group.column("hashes"), group.column("weights")
        bags = {i: bag_of(hashes[i], weights[i]) for i in {*a, *b}}
        found: dict[tuple[int, int], tuple[int, int, float]] = {}
        if a:
            _, x, y = shares([bags[i] for i in a], [bags[i] for i in b])
            likely = (np.minimum(x, y) >= threshold - 1e-4) & (parts[a][:, None] != parts[b][None, :])
            for i, j in zip(*np.nonzero(likely)):
                i, j = a[i], b[j]
                key = (int(min(parts[i], parts[j])), int(max(parts[i], parts[j])))
                if key not in found and (s := shingles.probability_jaccard(bags[i], bags[j])) >= threshold:
                    found[key] = (int(ids[i]), int(ids[j]), s)
        rows = list(found.values())
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "similarity": pa.array([r[2] for r in rows], pa.float64())})

    return links


def links_of_parts(grouped: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, similarity) between documents of different parts of a group,
    one at least for each two parts that any link joins. grouped has (group_id,
    doc_id, part); the documents of the part that has the group's id are not
    compared with one another."""
    inner = F.col("part") == F.col("group_id")
    rows = grouped.join(bags, "doc_id").select("group_id", "doc_id", "part", "hashes", "weights", inner.alias("inner"))
    rows = written(rows, "grouped")
    blocks = lambda own: F.ceil(F.greatest(F.sum(own.cast("int")) / BLOCK_ROWS, F.sum(F.when(own, F.length("hashes") / 8).otherwise(0)) / BLOCK_SHINGLES, F.lit(1)))
    sizes = written(rows.groupBy("group_id").agg(blocks(F.col("inner")).cast("int").alias("n_in"), blocks(~F.col("inner")).cast("int").alias("n_out")), "sizes")
    rows = rows.join(sizes, "group_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("inner"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int"))
    # outer blocks meet each other once, and every inner one
    with_outer = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("p"), F.greatest(F.col("block"), k).alias("q"), (F.col("block") > k).cast("int").alias("side")))
    with_inner = F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda k: F.struct(F.col("block").alias("p"), (-k - 1).alias("q"), F.lit(0).alias("side")))
    as_inner = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda k: F.struct(k.alias("p"), (-F.col("block") - 1).alias("q"), F.lit(1).alias("side")))
    dealt = rows.select("group_id", "doc_id", "part", "hashes", "weights", F.explode(F.when(F.col("inner"), as_inner).otherwise(F.concat(with_outer, with_inner))).alias("at"))
    dealt = dealt.select("group_id", "doc_id", "part", "hashes", "weights", "at.*")
    return dealt.groupBy("group_id", "p", "q").applyInArrow(_block_links(threshold), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = shingles.SIMILAR) -> DataFrame:
    """(doc_id, class_id, kept) for every distinct doc_id: class_id is the smallest id of
    the documents that links of probability Jaccard >= threshold on weighted
    five-word shingles reach, kept says that it is the document's own.

    Documents without a word (null and empty texts too) are in no one's class,
    and shorter ones are a single shingle. Rows that repeat an id are one
    document, of which each text counts. A null id has a null class and is
    kept, one row for each. Other columns are not looked at; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(tidied(_sign), "doc_id long, same binary, signature binary, bands array<long>"), "signed")
    named = signed.where("doc_id is not null and same is not null")
    first = written(named.groupBy("same").agg(F.min("doc_id").alias("rep")), "first")
    copies = named.select("same", "doc_id").join(first, "same").select("doc_id", "rep").where("doc_id <> rep").distinct()
    banded = named.select("same", "doc_id", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("other")).where("head <> other")
    # written, so that the join deals both sides anew and can split a bucket's rows
    members = banded.join(written(heads.select("bucket", "head"), "heads"), "bucket")
    # of copies, which share all buckets, only the first
    members = members.join(first.select("same", F.col("rep").alias("doc_id")), ["same", "doc_id"], "left_semi")
    members = written(members.select("bucket", "doc_id", "head").distinct(), "members")
    pairs = members.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    likely_needed = id_filter(needed, "doc_id")
    signatures = named.select("doc_id", "signature").where(likely_needed).join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    signatures = written(signatures, "signatures")
    texts = rows.where("doc_id is not null").where(likely_needed).join(needed, "doc_id", "left_semi")
    bags = written(texts.mapInArrow(tidied(_bags), "doc_id long, hashes binary, weights binary"), "bags")
    links = written(verified_pairs(pairs, signatures, bags, threshold), "links").select("a", "b")
    done = components(links)
    known = done.select(F.col("id").alias("doc_id"), "component_id")
    apart = members.join(known, "doc_id", "left").select("bucket", "doc_id", "head", F.coalesce("component_id", "doc_id").alias("part"))
    apart = written(apart, "apart")
    split = apart.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.when(F.col("doc_id") == F.col("head"), F.col("part"))).alias("group_id")).where("low <> high")
    # buckets whose heads are of one component make one group: a document is compared there once
    grouped = apart.join(split.select("bucket", "group_id"), "bucket").select("group_id", "doc_id", "part").distinct()
    more = written(links_of_parts(grouped, bags, threshold), "links").select("a", "b")
    done = done.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more)
    classes = components(done.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "classes")
    ids = rows.where("doc_id is not null").select("doc_id").distinct().unionByName(rows.where("doc_id is null").select("doc_id"))
    out = ids.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    class_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one document of each class, that of the
    smallest id, and one row of each id: the first by text. Rows without an id
    stay. All columns stay."""
    found = written(near_duplicates(docs), "kept")
    dropped = found.where("not kept").select("doc_id")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    concerned = F.col("doc_id").isNotNull() & id_filter(written(dropped.unionByName(repeated), "concerned"), "doc_id")
    rest = docs.where(concerned).join(dropped, "doc_id", "left_anti")
    place = "place"
    while place in docs.columns:
        place += "_"
    rest = rest.withColumn(place, F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1)
    return docs.where(~concerned).unionByName(rest.select(docs.columns))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every two texts that share a shingle, compared by the similarity's definition.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), named AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY array_to_string(t, ' ')) AS rep FROM d WHERE len(t) > 0
), bag AS (
  SELECT doc_id, sh, count(*)::DOUBLE AS w FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i + 4], ' '))) AS sh
    FROM (SELECT DISTINCT doc_id, t FROM named WHERE doc_id = rep)) GROUP BY ALL
), share AS (
  SELECT *, w / sum(w) OVER (PARTITION BY doc_id) AS s FROM bag
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM share x JOIN share y ON x.sh = y.sh AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING sum(least(x.s, y.s)) >= 0.799
), element AS (
  SELECT a, b, sh, sum(x) AS x, sum(y) AS y FROM (
    SELECT a, b, sh, w AS x, 0 AS y FROM pair JOIN bag ON doc_id = a UNION ALL SELECT a, b, sh, 0, w FROM pair JOIN bag ON doc_id = b)
  GROUP BY ALL
), placed AS (
  SELECT *, sum(x) OVER (PARTITION BY a, b ORDER BY CASE WHEN y = 0 THEN 1e300 ELSE x / y END DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above,
    sum(y) OVER (PARTITION BY a, b) - sum(y) OVER (PARTITION BY a, b ORDER BY CASE WHEN y = 0 THEN 1e300 ELSE x / y END DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below
  FROM element
), link AS (
  SELECT a, b FROM placed WHERE x > 0 AND y > 0 GROUP BY ALL HAVING sum(1 / (above / x + below / y)) >= 0.8
  UNION SELECT rep, doc_id FROM named WHERE rep <> doc_id
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), root AS (
  SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a
)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN root USING (doc_id)
UNION ALL SELECT NULL, NULL, true FROM documents WHERE doc_id IS NULL
"""
