"""Personal data that the first patterns and checks let pass."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from waymark.llm import common
from waymark.llm import pseudonyms as P

SF = "/root/testdata/sf0.01"


def test_phones_of_the_format_are_replaced(spark):
    """Whatever their area and exchange, in op6 and in the pipeline."""
    pattern = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)")
    docs = common.table(spark, SF, "documents").where("text rlike '[+]1 [(][0-9]{3}[)]'")
    given = {r.doc_id: pattern.findall(r.text) for r in docs.collect()}
    assert any(x[4] < "2" for found in given.values() for x in found)
    for out in (P.op6_pii(spark, SF), corpus_pipeline.anonymous(spark, docs, SF)):
        after = {r.doc_id: pattern.findall(r.text) for r in out.where(F.col("doc_id").isin(list(given))).collect()}
        for i, found in given.items():
            assert len(after[i]) == len(found)
            assert all(a != b and (a[4] < "2") == (b[4] < "2") and (a[9] < "2") == (b[9] < "2") for a, b in zip(found, after[i]))


def test_phone_is_a_permutation(spark):
    """Of numbers below 200, too: no two get one pseudonym."""
    area, exchange = F.lpad((F.col("id") % 300).cast("string"), 3, "0"), F.lpad((F.col("id") * 7 % 300).cast("string"), 3, "0")
    value = F.concat(F.lit("("), area, F.lit(") "), exchange, F.lit("-"), F.lpad(F.col("id").cast("string"), 4, "0"))
    new = spark.range(6000).select(P.phone(value, F.lit("k")).alias("s"))
    assert new.where("s rlike '^[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}$'").distinct().count() == 6000


def test_cards_beside_other_numbers(spark):
    """A card's pseudonym is the same whatever stands beside it, and that stays."""
    spaced, plain, dashed = "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"
    american = "3782 822463 10005"
    beside = ["{} 124", "{} 12 apples", "{} 1", "12 {}", "7 {}", "12 {} 345", "1 2 {} 3 4", "1234 5679 {}", "{} 99 {} 1", "{}, 12", "{} 12x"]
    texts = [b.replace("{}", c) for c in (spaced, plain, dashed, american) for b in ["{}", *beside]]
    texts += ["4111111111111111 12/05/2024", "4111-1111-1111-1111-124", "4111111111111111 123-45-6789", "4111111111111112 12 apples", "4111 1111 1111 1112 124"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.pseudonymise(rows, "k").collect()}
    n = len(beside) + 1
    for k, c in enumerate((spaced, plain, dashed, american)):
        new = got[k * n].text
        assert new != c and re.sub(r"\d", "d", new) == re.sub(r"\d", "d", c)
        for i, b in enumerate(beside, k * n + 1):
            assert got[i].text == b.replace("{}", new), texts[i]
            assert got[i].n_private == {"card": b.count("{}")}
    date, dash, ssn, bad, worse = (got[i] for i in range(4 * n, 4 * n + 5))
    assert date.n_private == {"card": 1, "date": 1} and ssn.n_private == {"card": 1, "ssn": 1}
    assert date.text.startswith(got[n].text + " ") and ssn.text.startswith(got[n].text + " ")
    assert dash.text == got[2 * n].text + "-124"
    assert bad.text == texts[4 * n + 3] and worse.text == texts[4 * n + 4] and bad.n_private == worse.n_private == {}
