import math
import random
import zlib

import numpy as np

from waymark.llm import common, langid

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = langid.op9_language_id(spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 2000 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_matches_counts_by_hand(spark):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("abcé 1.") for _ in range(rng.randrange(1, 60))), rng.choice(["x", "y"])) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit_language_model(frame)
    counts = np.full((langid.BUCKETS, 2), 0.5)
    for _, text, lang in docs:
        if any(map(str.isalpha, text)):
            for buckets in langid.ngram_buckets(text):
                for b in buckets:
                    counts[b, "xy".index(lang)] += 1
    want = np.log(counts / counts.sum(axis=0))
    assert model.langs == ["x", "y"] and np.allclose(model.log_prob, want)
    n = np.array([sum(lang == x for _, _, lang in docs) for x in "xy"])
    for _, text, _ in docs[:20]:
        if any(map(str.isalpha, text)):
            total = np.log(n / n.sum()) + sum(want[b] for own in langid.ngram_buckets(text) for b in own)
            lang, score = langid.predict(text, model)
            assert lang == "xy"[total.argmax()] and abs(score - 1 / np.exp(total - total.max()).sum()) < 1e-9


def test_pieces_of_long_texts(monkeypatch):
    text = "abc déf " * 40
    whole = np.concatenate(list(langid.ngram_buckets(text)))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert sorted(np.concatenate(list(langid.ngram_buckets(text)))) == sorted(whole)


def test_edges(spark):
    frame = spark.createDataFrame([(1, "hello there", "en", "a"), (2, "bonjour là", "fr", "b"), (3, None, "en", "c"), (4, "12 !!", "fr", "d"), (None, "hello", None, "e"), (1, "hello there", "en", "a")], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit_language_model(frame)
    out = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict_language(frame, model).collect())
    assert out == [(0, "en"), (1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und")]
    none = langid.fit_language_model(frame.limit(0))
    assert none.langs == [] and langid.predict("hello", none) == ("und", 0.0)
    assert langid.predict_language(frame.limit(0), model).count() == 0


def by_hand(text):
    """Counts of buckets, from the definition, in whole numbers."""
    chars = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    out = {}
    if any(c.isalpha() for c in text.lower()):
        for i in range(len(chars)):
            h = 0
            for n, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
                if i + n < len(chars):
                    h = (h + chars[i + n] + 1) * factor % (1 << 64)
                    out[h >> 50] = out.get(h >> 50, 0) + 1
    return out


def test_query_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, n, own = {}, {}, {}
    for r in docs:
        own[r.doc_id] = by_hand(r.text or "")
        if r.text is not None and r.lang is not None and not kept(r.doc_id):
            n[r.lang] = n.get(r.lang, 0) + 1
            for b, k in own[r.doc_id].items():
                counts.setdefault(r.lang, {})[b] = counts.get(r.lang, {}).get(b, 0) + k
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    for r in langid.op9_language_id(spark, folder).collect():
        assert r.held_out == kept(r.doc_id)
        score = {x: math.log(n[x] / sum(n.values())) + sum(k * math.log((counts[x].get(b, 0) + 0.5) / total[x]) for b, k in own[r.doc_id].items()) for x in sorted(counts)}
        if not own[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(sorted(score), key=lambda x: score[x])
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - score[best]) for v in score.values())) < 1e-6


def test_many_languages_go_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([0, 5, 40, 9000]))), f"l{i % 40:02}") for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit_language_model(frame)
    assert len(model.langs) == 40
    monkeypatch.setattr(langid, "PRODUCT", 1000)
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(frame, model).collect()}
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 7)
    many = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(frame, model).collect()}
    assert len(langid.language_blocks(model)) == 6
    for i, text, _ in docs:
        lang, score = langid.predict(text, model)
        for found in (one[i], many[i]):
            assert found[0] == lang and abs(found[1] - score) < 1e-9


def test_ties_go_to_the_first_language(spark):
    frame = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    model = langid.fit_language_model(frame)
    assert {(r.lang_pred, round(r.score, 9)) for r in langid.predict_language(frame, model).collect()} == {("a", 0.5)}


def test_query_is_its_sql(spark, sql_rows):
    sql_rows(langid.op9_language_id, langid.ORACLE)
