"""Each stage of the corpus pipeline, on its own input, against brute force."""

import re

import sys
from pathlib import Path

import corpus_pipeline as P

sys.path.insert(0, str(Path(__file__).parent))
from test_minhash import classes  # noqa: E402
from test_pseudonyms import brute  # noqa: E402

from waymark.llm import common, pieces, pseudonyms, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def hidden(before, after):
    """All matches are what brute force makes of them; mail is another of its form, in
    its place."""
    pattern = re.compile(pseudonyms.PATTERN.replace(r"\p{L}\p{N}_", r"\w"))
    old, new = pattern.split(before), pattern.split(after)
    pairs = list(zip(pattern.findall(before), pattern.findall(after)))
    for a, b in pairs:
        if "@" in a:
            if a == b or re.sub("[a-z0-9]", "", a) != re.sub("[a-z0-9]", "", b):
                return False
        elif brute(a, P.KEY) != b:
            return False
    return old == new


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    labels = {r.doc_id: r.toxic for r in common.table(spark, SF, "labels").collect()}
    given = rows(docs)
    model = toxicity.fit_toxicity(docs, common.table(spark, SF, "labels"))
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash", "decontamination", "pii", "sentencepiece"]

    clean = P.STAGES[0][1](spark, docs, SF)
    assert clean.columns == P.COLUMNS
    kept = rows(clean)
    assert kept.keys() == {i for i, r in given.items() if toxicity.toxicity_score(r.text, model) < 0.3}
    assert sum(labels.get(i) == 0 for i in given.keys() - kept.keys()) <= 2

    one = rows(common.written(P.STAGES[1][1](spark, clean, SF), "t"))
    found = classes([(i, r.text) for i, r in kept.items()])
    assert one.keys() == {i for i, c in found.items() if i == c}

    items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    free = rows(P.STAGES[2][1](spark, clean, SF))
    assert not [i for i, r in free.items() if any(t in r.text for t in items)]
    assert all(any(t[: len(t) // 2] in kept[i].text or t[len(t) // 2 :] in kept[i].text for t in items) for i in kept.keys() - free.keys())

    masked = rows(P.STAGES[3][1](spark, clean, SF))
    assert masked.keys() == kept.keys()
    for i, r in masked.items():
        assert r.n_chars == len(r.text) and r.lang == kept[i].lang
        assert hidden(kept[i].text, r.text)
        if not re.search("[0-9@]", kept[i].text):
            assert r.text == kept[i].text

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for i, r in rows(P.STAGES[4][1](spark, clean, SF)).items():
        assert r.token_ids == library.encode(kept[i].text) and r.decoded_same and r.n_tokens == len(r.token_ids)


def test_run_is_its_stages(spark):
    docs = common.table(spark, SF, "documents")
    for name, stage in P.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
    assert sorted(docs.collect()) == sorted(P.run(spark, SF).collect())


def test_empty_and_odd_rows(spark):
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0)], docs.schema)
    for given, n in ((docs.limit(0), 0), (odd, 2)):
        out = given
        for name, stage in P.STAGES:
            out = common.written(stage(spark, out, SF), name)
        assert out.count() == n
