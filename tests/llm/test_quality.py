from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from waymark.llm import quality
from waymark.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def words(seed, n, bad=False):
    rng = np.random.default_rng(seed)
    own = ["".join(rng.choice(list("abcdeinorst"), size=rng.integers(2, 8))) for _ in range(n)]
    return " ".join(w.upper() + "!!" for w in own) if bad else " ".join(own)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, words(i, 60, i % 5 == 0), int(i % 5 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "src", 0.0) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows], "doc_id long, quality int, text string")
    return rows, docs, labels


def brute(text, model):
    raw = (text or "").encode()
    size = []
    for data in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
        size.append(sum(len(c.compress(raw[i : i + quality.PIECE])) for i in range(0, len(raw), quality.PIECE)))
    x = (size[1] - size[0] + quality.EVIDENCE * model.mean) / (len(raw) + quality.EVIDENCE)
    return 1 / (1 + np.exp(-(model.slope * x + model.intercept)))


def test_learns_and_scores_by_sizes(spark, labelled):
    rows, docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    found = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(found) == len(rows)
    for i, text, label in rows:
        assert found[i].score == pytest.approx(brute(text, model), abs=1e-9)
        assert found[i].predicted == int(found[i].score >= 0.7)
    held = [(i, q) for i, _, q in rows if crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([found[i].predicted == q for i, q in held]) > 0.97


def test_learns_no_held_out_label(spark, labelled):
    _, docs, labels = labelled
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, turned) == quality.fit_quality(docs, labels)


def test_curve_is_the_least_of_its_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    good, weight = (x + rng.normal(size=500) > 0.2).astype(float), rng.uniform(0.5, 2, size=500)
    slope, intercept = quality.fit_curve(x, good, weight)

    def loss(a, b):
        z = a * x + b
        return weight @ (np.logaddexp(0, z) - good * z) + 0.5e-3 * weight.sum() * (a * x.std()) ** 2

    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert loss(slope, intercept) < loss(slope + da, intercept + db)


def test_odd_rows(spark, labelled):
    rows, docs, labels = labelled
    model = quality.fit_quality(docs, labels)
    long = words(1, 200_000)
    given = [(None, None), (1, None), (2, ""), (3, long), (3, long), (None, "abc"), (4, "\x00 \n")]
    odd = spark.createDataFrame([(i, t, True) for i, t in given], "doc_id long, text string, held_out boolean")
    found = quality.score_quality(odd, model).collect()
    assert sorted(((r.doc_id, round(r.score, 9)) for r in found), key=repr) == sorted(((i, round(float(brute(t, model)), 9)) for i, t in given), key=repr)
    assert all(0 <= r.score <= 1 for r in found)
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_without_both_kinds(spark, labelled):
    _, docs, labels = labelled
    for some, base in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.withColumn("quality", F.lit(None).cast("int")), 0.5)):
        model = quality.fit_quality(docs, some)
        assert {r.score for r in quality.score_quality(docs, model).select("score").distinct().collect()} == {base}
    assert quality.fit_quality(docs.limit(0), labels).good is None
    assert quality.fit_quality(docs.withColumn("text", F.lit(None).cast("string")), labels).good is None


def test_few_short_texts_make_dictionaries(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2] * (i + 1)) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert model.good is not None and quality.score_quality(docs, model).count() == 12


def test_shared_lines_speak_for_neither():
    import pyarrow as pa

    shared = b"all texts have this line"
    texts = [shared + b"\n" + words(i, 30, i % 2 == 0).encode() for i in range(20)]
    built = quality._train(pa.table({"text": texts, "good": [bool(i % 2) for i in range(20)]}))
    assert not any(shared in x for x in built.column("dictionary").to_pylist())


def test_registered_query(spark):
    found = queries()["op11_quality"](spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and "op11_quality" not in oracle_sql()
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = queries()["op11_quality"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null"), "doc_id").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) >= 0.9
