import hashlib
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import periods
from waymark.llm.queries import oracle_sql, queries


def brute(words):
    """Every period by itself: stretches of words that equal those a period on."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items()) and [(s, n, q) for s, n, q in sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))]


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def hold(texts):
    for text, (n, runs, collapsed) in zip(texts, periods.search([t.encode() for t in texts]), strict=True):
        words = text.encode().split()
        want = brute(words)
        assert n == len(words) and [tuple(r) for r in runs.tolist()] == want and collapsed == collapse(words, want)


@st.composite
def texts(draw):
    out = []
    for _ in range(draw(st.integers(1, 5))):
        unit = draw(st.lists(st.sampled_from(["a", "b", "c", "é"]), min_size=1, max_size=draw(st.sampled_from([1, 2, 3, 9, 14]))))
        out += (unit * 40)[: draw(st.integers(0, 90))]
    return " ".join(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts(), min_size=1, max_size=6))
def test_equals_all_periods(given_texts):
    hold(given_texts)


def test_equals_all_periods_of_random_words():
    rng = np.random.default_rng(0)
    for letters in ("ab", "abc", "abcdefgh"):
        hold([" ".join(rng.choice(list(letters), size=rng.integers(0, 400))) for _ in range(60)])


def test_neighbouring_runs_of_one_period():
    """Two runs of the same period on both sides of a middle, neither part of the other."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = int(rng.integers(2, 9))
        a, b = (rng.choice(list("abcdefghij"), size=p).tolist() for _ in range(2))
        hold([" ".join((a * 30)[: rng.integers(20, 50)] + (b * 30)[: rng.integers(20, 50)])])


def test_what_a_run_is():
    unit = [f"w{i}" for i in range(10)]
    assert brute(unit * 3) == [(0, 30, 10)]
    hold([" ".join(unit * 3), " ".join((unit * 3)[:-1]), "x " * 24, "x " * 23, " ".join(unit + ["y"] + unit * 4 + ["w0", "z"])])


def test_stretches_that_occur_twice():
    assert (periods.OVERLAP, periods.AGREE) == (16, 4)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 10**6, size=500)
    words[300:316] = words[100:116]
    found = periods.repeated(periods._marked([words, words[:50]]))
    assert np.flatnonzero(found).tolist() == [*range(100, 116), *range(300, 316)]


def test_white_space_is_that_of_ascii():
    text = "a\x1cb c d\x85e\tf\ng\x0bh\x0ci\rj  k"
    assert [n for n, _, _ in periods.search([text.encode()])] == [7]


def query_row(doc_id, text):
    words = (text or "").encode()
    words, n = words.split(), len(words.split())
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(collapse(words, runs)))


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    long = " ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=3000))
    rows = [(i, t) for i in range(30) for t in (None, "", "  \n", "a", " ".join(f"w{j % 37}" for j in range(150)), long if i % 10 == 0 else "x y z " * 9)]
    rows += [(None, None), (None, "a b " * 30), (1, "a b " * 30), (1, "a b " * 30)]
    assert sum(crc32(str(i).encode()) % 10 == 0 for i in range(30)) >= 2
    spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, n_words int, best string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = periods.op13_periods(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((query_row(*r) for r in rows), key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periods.op13_periods(spark, str(tmp_path)).count() == 0


def test_a_very_long_text():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3000, size=400_000).astype(str).tolist()
    words[1000:201_000] = (words[1000:1777] * 300)[:200_000]
    [(n, runs, collapsed)] = periods.search([" ".join(words).encode()])
    assert n == 400_000 and runs[:, 2].tolist() == [777] and runs[0, 0] <= 1000 and runs[0, :2].sum() >= 201_000
    assert len(collapsed.split()) == 400_000 - runs[0, 1] + 777


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_registered_query(sql_rows, folder):
    sql_rows(queries()["op13_periods"], oracle_sql()["op13_periods"], folder)
