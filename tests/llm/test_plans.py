from waymark.llm import common, pseudonyms, quotes

SF = "/root/testdata/sf0.001"


def test_native_operators_run_no_python(spark):
    for out in (pseudonyms.op6_pii(spark, SF), quotes.op1_quotes(spark, SF)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_batches_are_bounded(spark):
    common.table(spark, SF, "labels")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
