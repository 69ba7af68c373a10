import random

import numpy as np

from waymark.llm import common, minhash, shingles


def brute_jp(a, b):
    """Probability Jaccard straight from its definition, on bags of shingles."""
    x, y = dict(zip(*[v.tolist() for v in a])), dict(zip(*[v.tolist() for v in b]))
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def classes(rows, threshold=0.8):
    """By comparing all pairs of documents."""
    ids = sorted({i for i, _ in rows if i is not None})
    bags = [(i, shingles.weighted_shingles(shingles.words(t))) for i, t in rows if i is not None and shingles.words(t)]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if shingles.probability_jaccard(a, b) >= threshold:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def documents(seed, n_groups=12, size=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    shared = " ".join(word() for _ in range(25))
    rows, i = [], 0
    for g in range(n_groups):
        base = [word() for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, size) if g else 60):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own) + (" " + shared if rng.random() < 0.4 else "") + (" same line" * 30 if rng.random() < 0.1 else "")))
            i += 1
    rng.shuffle(rows)
    return rows


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = ((np.unique(rng.integers(0, 60, 40)).astype(np.uint64),) for _ in range(2))
        a, b = (x + (rng.integers(1, 5, len(x[0])),) for x in (a, b))
        assert abs(shingles.probability_jaccard(a, b) - brute_jp(a, b)) < 1e-12
    ids = shingles.mix(np.arange(300, dtype=np.uint64))
    a, b = (ids[:200], rng.integers(1, 6, 200)), (ids[60:], rng.integers(1, 6, 240))
    m = 4000
    same = (shingles.prob_min_hash(*a, m) == shingles.prob_min_hash(*b, m)).mean()
    assert abs(same - shingles.probability_jaccard(a, b)) < 5 * np.sqrt(0.25 / m)
    one = (ids[:1], np.array([3]))
    assert (shingles.prob_min_hash(*one, 64) == ids[0]).all()
    assert shingles.probability_jaccard((ids[:0], np.array([])), (ids[:0], np.array([]))) == 0.0


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rows = documents(1)
    rows += [(i + 1000, t) for i, t in rows[:20]] + rows[:5] + [(2000, None), (2001, ""), (2002, "!!"), (2003, "two words"), (2004, "Two words"), (2005, "two"), (None, rows[0][1]), (None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    out = minhash.near_duplicates(frame).collect()
    got = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    assert got == classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out if r.doc_id is not None)
    assert len(out) == len(got) + 2 and all(r.kept and r.class_id is None for r in out if r.doc_id is None)
    assert len(set(got.values())) < len(got) - 30
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (2, "a b c d e f g", "y"), (3, "other words here", "z"), (3, "other words here", "z"), (None, "a b c d e f g", "n"), (None, None, "n"), (4, None, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.kept) for r in minhash.one_of_each(frame).collect())
    assert got == [(0, "n"), (0, "n"), (1, "x"), (3, "z"), (4, "w")]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, j) for j in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    del root[7]
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_id_filter_loses_no_id(spark):
    ids = spark.range(0, 1000, 3)
    kept = spark.range(2000).where(common.id_filter(ids, "id"))
    assert ids.join(kept, "id", "left_anti").isEmpty() and kept.count() < 400


def test_very_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    near, far = list(long), list(long)
    for k in range(0, 200_000, 60):
        near[k] = "other"
    for k in range(0, 200_000, 10):
        far[k] = "other"
    repeated = " ".join(["a b c d e f"] * 30_000)
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, repeated), (5, repeated + " f"), (6, " ".join(long[:100]))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[2] == 1 and got[5] == 4 and got[3] == 3


def test_query_is_its_sql(spark, sql_rows):
    sql_rows(minhash.op2_minhash, minhash.ORACLE)
