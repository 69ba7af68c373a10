import math
import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import common, toxicity

SF = "/root/testdata/sf0.1"


def held_out(i):
    return crc32(str(i).encode()) % 4 == 2


def test_label_model_finds_good_and_repeated_voters():
    rng = np.random.default_rng(4)
    n, k = 4000, toxicity.N_VOTERS
    y = rng.random(n) < 0.2
    votes = np.zeros((n, k), dtype=int)
    for j in range(4):  # good voters
        votes[:, j] = np.where(y & (rng.random(n) < 0.7), 1, 0)
    votes[:, 4] = np.where(rng.random(n) < 0.1, 1, 0)  # a blind one
    votes[:, 5] = votes[:, 0]  # and one that repeats a good one
    votes[:, toxicity.N_LEXICONS] = np.where((votes[:, :6] > 0).any(axis=1), 0, -1)
    theta, strength, posterior = toxicity.fit_label_model(votes, 0.2)
    odds = theta[1, :6, 2] / theta[0, :6, 2]
    assert odds[:4].min() > 10 * odds[4]
    assert max(strength[0], strength[5]) < strength[1:4].min()
    assert ((posterior > 0.5) == y).mean() > 0.9


def test_linear_classifier_separates():
    rng = np.random.default_rng(5)
    y = rng.random(500) < 0.3
    rows = [np.array(([0] if t else []) + [1 + int(rng.integers(20))]) for t in y]
    w, b = toxicity.fit_linear(rows, y.astype(float), 21)
    assert w[0] > 3 and abs(w[1:]).max() < 2 and b < -1


def test_held_out_rows_are_told_apart(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels").where("toxic is not null")
    out = toxicity.op4_toxicity(spark, SF)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    rows = [r for r in rows if r.held_out]
    hit = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.02


def test_edges(spark):
    rng = np.random.default_rng(6)
    bad = lambda: " ".join(w for w in ("awful", "rotten", "nasty", "vile", "foul", "grim") if rng.random() < 0.5) or "awful"
    docs = spark.createDataFrame([(i, f"{bad() if i % 2 else 'good'} word{i} text", "x") for i in range(200)] + [(None, None, "y"), (200, "", "z"), (200, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(out) == 202 and out[1].predicted == 1 and out[2].predicted == 0 and out[200].score == out[None].score
    assert toxicity.fit_toxicity(docs, labels.limit(0)).base == 0.0
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 1")).base == 1.0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 103
    long = spark.createDataFrame([(1, "good " * 200_000 + "awful rotten")], "doc_id long, text string")
    assert toxicity.score_toxicity(long, model).first().predicted == 1
    assert docs.where(common.held_out()).count() == sum(held_out(i) for i in range(201)) + held_out(200)


def em_by_hand(matrix, prior, groups_at, rounds):
    """Expectation maximisation row by row; groups_at(step, posterior) are the voters' groups."""
    n, k = len(matrix), len(matrix[0])
    post = [(0.02, 0.4, 0.95)[min(sum(v > 0 for v in row), 2)] for row in matrix]
    groups = [[j] for j in range(k)]
    for step in range(rounds):
        weight = [[1 - p for p in post], post]
        theta = [[[(sum(w for w, row in zip(weight[y], matrix) if row[j] == v) + 0.5) / (sum(weight[y]) + 1.5) for v in (-1, 0, 1)] for j in range(k)] for y in (0, 1)]
        groups = groups_at(step, post, groups)
        new = []
        for row in matrix:
            odds = math.log(prior / (1 - prior))
            for g in groups:
                own = [row[j] for j in g]
                if not any(own):
                    continue
                for y in (0, 1):
                    alone = math.prod(theta[y][j][row[j] + 1] for j in g) / (1 - math.prod(theta[y][j][1] for j in g))
                    said = sum(w for w, r in zip(weight[y], matrix) if any(r[j] for j in g))
                    same = sum(w for w, r in zip(weight[y], matrix) if [r[j] for j in g] == own)
                    p = (same + toxicity.BACKING * alone) / (said + toxicity.BACKING) * (said + 0.5) / (sum(weight[y]) + 1)
                    odds += math.log(p) * (1 if y else -1)
            new.append(1 / (1 + math.exp(-odds)))
        post = new
    return theta, post


def test_label_model_is_em_by_hand():
    rng = np.random.default_rng(8)
    y = rng.random(60) < 0.3
    votes = np.where(rng.random((60, 5)) < np.where(y, 0.7, 0.1)[:, None], 1, 0)
    votes[:, 3] = votes[:, 2]
    votes[:, 4] = np.where(votes[:, :4].any(axis=1), 0, -1)
    seen = []

    def groups_at(step, post, groups):
        if step % 5 != 4:
            return groups
        seen.append(toxicity.groups_of(toxicity.correlations(votes, np.array(post))))
        return seen[-1]

    theta, post = em_by_hand(votes.tolist(), 0.3, groups_at, 12)
    got = toxicity.fit_label_model(votes, 0.3, 12)
    assert np.allclose(got[0], theta) and np.allclose(got[2], post)
    assert any(2 in g and 3 in g for g in seen[-1])  # the voter that repeats another is of its group


def test_correlations_by_hand():
    rng = np.random.default_rng(9)
    votes, post = rng.integers(-1, 2, size=(50, 4)), rng.random(50)
    votes[:, 0] = 0
    got = toxicity.correlations(votes, post)
    for i in range(4):
        for j in range(4):
            want = 0.0
            for w in (1 - post, post):
                if i != j and i and j:
                    a, b = (votes[:, x] - (w * votes[:, x]).sum() / w.sum() for x in (i, j))
                    want += w.sum() / 50 * abs((w * a * b).sum() / np.sqrt((w * a * a).sum() * (w * b * b).sum()))
            assert abs(got[i, j] - want) < 1e-9
    assert toxicity.groups_of(np.array([[0, 0.9, 0.1], [0.9, 0, 0.1], [0.1, 0.1, 0]])) == [[0, 1], [2]]


def test_voters_have_not_seen_the_rows_they_vote_on(spark):
    rows = [(i, f"foulword number{i}" if i % 3 == 0 else f"fine number{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.lexicons) == toxicity.FOLDS and all("=foulword" in x for x in model.lexicons)
    only = [(i, "foulword here" if i == 0 else f"other{i % 7} text") for i in range(300)]
    seen = toxicity.fit_toxicity(spark.createDataFrame(only, "doc_id long, text string"), labels)
    assert not any("=foulword" in x for x in seen.lexicons)


def test_scores_by_hand(spark):
    model = toxicity.ToxicityModel(0.1, -1.25, {"=awful": 2.0, "^awfu": 0.5, "=good": -0.75, "^rotte": 0.2})
    texts = ["awful good", "AWFUL awful rotten", "good", "", None, "fine"]
    by_hand = [-1.25 + 2.0 + 0.5 - 0.75, -1.25 + 2.0 + 0.5 + 0.2, -1.25 - 0.75, -1.25, -1.25, -1.25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, model).collect():
        want = 1 / (1 + math.exp(-by_hand[r.doc_id]))
        assert abs(r.score - want) < 1e-12 and r.predicted == int(want >= 0.3)
    edge = toxicity.ToxicityModel(0.1, float(np.log(0.3 / 0.7)), {"=x": 0.0})
    (row,) = toxicity.score_toxicity(docs.where("doc_id = 3"), edge).collect()
    assert row.predicted == int(row.score >= 0.3)


def test_query_scores_by_the_fitted_weights(spark):
    folder = "/root/testdata/sf0.01"
    docs = common.table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, common.table(spark, folder, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.op4_toxicity(spark, folder).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        terms = {t for w in words if len(w) > 2 for t in [f"={w}", *(f"^{w[:k]}" for k in (4, 5, 6, 7, 8) if len(w) >= k)]}
        want = 1 / (1 + math.exp(-model.bias - sum(model.weights.get(t, 0.0) for t in terms)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id)
