import numpy as np

from waymark.llm import vectors as V


def brute(rows):
    good = {}
    for i, label, e in rows:
        if i is None:
            continue
        bad = label is None or e is None or not len(e) or any(x is None or not np.isfinite(x) for x in e) or not any(e)
        key = (bad, label if label is not None else -1, tuple(e) if e is not None and not bad else ())
        if i not in good or key < good[i]:
            good[i] = key
    ids = sorted(good)
    links = {i: set() for i in ids}
    for x, i in enumerate(ids):
        for j in ids[:x]:
            (bad_i, label_i, a), (bad_j, label_j, b) = good[i], good[j]
            if not bad_i and not bad_j and label_i == label_j and len(a) == len(b):
                a, b = np.array(a, dtype=float), np.array(b, dtype=float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i].add(j), links[j].add(i)
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
        if new == root:
            return {i: (len(links[i]), root[i], root[i] == i) for i in ids}
        root = new


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        base = rows[rng.integers(len(rows))] if rows and rng.random() < 0.6 else None
        if base is None:
            rows.append((i, int(rng.integers(3)), rng.normal(size=12)))
        elif rng.random() < 0.3:
            rows.append((i, base[1], base[2] * rng.choice([1.0, 1.0, 2.0])))
        else:  # about as far as the threshold: chains
            rows.append((i, base[1], base[2] + rng.normal(size=12) * 0.15 * np.linalg.norm(base[2]) / np.sqrt(12)))
    rows = [(i, label, [float(x) for x in e]) for i, label, e in rows]
    rows += [(600, None, rows[0][2]), (601, 0, None), (602, 0, [0.0] * 12), (603, 0, [float("nan")] * 12), (604, 0, [None] * 12), (605, 0, []), (606, 0, [float("inf")] * 12), (607, rows[0][1], rows[0][2][:5]), (608, rows[0][1], rows[0][2][:5])]
    rows += [rows[3], rows[4], (5, 2, rows[6][2]), (None, 0, rows[0][2])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, component_id string")
    got = V.near_duplicate_vectors(frame).collect()
    named = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert len(got) == len(named) + 1
    want = brute(rows)
    assert named == want and sum(n for n, _, _ in want.values()) > 100
    assert V.near_duplicate_vectors(frame.limit(0)).count() == 0
    assert V.near_duplicate_vectors(frame.where("vec_id = 601")).collect()[0].kept


def test_more_than_a_thousand_lengths(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(1, 1101):
        base = rng.normal(size=n)
        rows += [(3 * n, 0, base.tolist()), (3 * n + 1, 0, (base * 2 + 1e-3).tolist()), (3 * n + 2, 0, rng.normal(size=n).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicate_vectors(frame).collect()}
    want = {}
    for at in range(0, len(rows), 3):
        want |= brute(rows[at : at + 3])
    assert got == want and sum(n > 0 for n, _, _ in want.values()) > 2000


def test_cells_grow_and_lose_no_link(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("CELL_ROWS", 10), ("TILE", 5), ("MAX_CELLS", 64)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        base = rows[rng.integers(len(rows))][2] if rows and rng.random() < 0.5 else rng.normal(size=6)
        rows.append((i, int(rng.random() < 0.1), (np.array(base) + rng.normal(size=6) * 0.1).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert len(V.centroids_of(frame.withColumnRenamed("vec_id", "class_id"))[6]) > 30
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicate_vectors(frame).collect()}
    assert got == brute(rows)


def test_query_is_its_sql(spark, sql_rows):
    sql_rows(V.op3_embeddings, V.ORACLE)
