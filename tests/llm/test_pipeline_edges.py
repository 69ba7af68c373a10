"""Rows that a pipeline stage may meet: nulls, very long texts, further columns, no labels or items."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from waymark.llm import common

SF = "/root/testdata/sf0.001"


def write(spark, folder, docs, labels=None, benchmark=None):
    docs.write.parquet(f"{folder}/documents.parquet")
    (labels if labels is not None else common.table(spark, SF, "labels")).write.parquet(f"{folder}/labels.parquet")
    (benchmark if benchmark is not None else common.table(spark, SF, "benchmark")).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_documents_pass_every_stage(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    long = " ".join(f"w{i % 997} x{i % 13}" for i in range(150_000))
    odd = spark.createDataFrame([(None, "one of a kind here", None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, long, "en", "s", len(long)), (10**6 + 2, long, "en", "s", len(long))], docs.schema)
    folder = write(spark, tmp_path, docs.unionByName(odd).withColumn("token_ids", F.lit("clash")).withColumn("component_id", F.lit(1)))
    out = common.table(spark, folder, "documents")
    for name, stage in P.STAGES[:-1]:
        out = common.written(stage(spark, out, folder), name)
        assert out.columns == P.COLUMNS  # further columns are left out, as documents has none
        found = {r.doc_id: r.text for r in out.where("doc_id is null or doc_id >= 1000000").collect()}
        assert found == {None: "one of a kind here", 10**6: None, 10**6 + 1: "", 10**6 + 2: long}, name
    last = {r.doc_id: r for r in P.STAGES[-1][1](spark, out, folder).collect()}
    assert last[10**6].n_tokens == last[10**6 + 1].n_tokens == 0 and last[10**6 + 2].n_bytes == len(long) and last[10**6 + 2].parity


def test_without_labels_or_items_nothing_goes(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    folder = write(spark, tmp_path, docs, common.table(spark, SF, "labels").limit(0), common.table(spark, SF, "benchmark").limit(0))
    given = docs.count()
    assert P.clean(spark, docs, folder).count() == given and P.uncontaminated(spark, docs, folder).count() == given
