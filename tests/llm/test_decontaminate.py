import math
import pickle
import random
from collections import Counter

from waymark.llm import decontaminate as D
from waymark.llm import shingles


def corpus(seed=3, n_items=60, n_docs=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", *("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(150))]
    make = lambda n: [rng.choice(vocab[: rng.choice([3, 20, 150])]) for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(1, 40)))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        words = make(rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            if rng.random() < 0.5 and len(own) > 3:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, " ".join(words)))
    return items, docs


def brute_scores(index, items, terms):
    """BM25 straight from its definition, for every item."""
    counts = [Counter(shingles.words(t)) for _, t in items if len(shingles.words(t)) >= 5]
    mean = sum(sum(c.values()) for c in counts) / len(counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        w = {t: math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, n in c.items()}
        out.append(sum(w[t] for t in terms if t in w) / sum(w.values()))
    return out


def test_wand_finds_what_brute_force_finds():
    items, docs = corpus()
    index = D.Index(items)
    names = {i: t for t, i in index.term.items()}
    for _, text in docs:
        tokens = shingles.words(text)
        step = max(1, -(-index.longest // 2))
        want = {}
        for a in range(0, max(1, -(-len(tokens) // step)) * step, step):
            terms = sorted({index.term[t] for t in tokens[a : a + 3 * step] if t in index.term})
            scores = brute_scores(index, items, [names[t] for t in terms])
            found = index.search(terms, 0.5) if terms else {}
            assert set(found) == {i for i, s in enumerate(scores) if s >= 0.5 - 1e-9}
            for i, s in found.items():
                assert abs(s - scores[i]) < 1e-9
                want[i] = max(want.get(i, 0), s)
        assert index.retrieve(tokens).keys() == want.keys()


def test_long_texts_in_parts(monkeypatch):
    items, docs = corpus(4)
    index = D.Index(items)
    tokens = [w for _, t in docs for w in shingles.words(t)]
    whole = index.retrieve(tokens)
    monkeypatch.setattr(D, "CELLS", 6 * index.n_blocks)
    parts = index.retrieve(tokens)
    assert whole.keys() <= parts.keys()


def aligned(item, doc, n_question):
    """Whether all but one or nine tenths of the words stand in their order, by every shift."""
    n = len(item)
    for shift in range(-n, len(doc) + 1):
        at = lambda j, by: 0 <= j + shift + by < len(doc) and doc[j + shift + by] == item[j]
        if sum(at(j, 0) for j in range(n)) >= 0.45 * n:
            found = [j for j in range(n) if any(at(j, by) for by in (-1, 0, 1))]
            asked = sum(j < n_question for j in found)
            if len(found) >= min(0.9 * n, n - 1) and asked >= 0.5 * n_question and len(found) - asked >= 0.5 * (n - n_question):
                return True
    return False


def test_edited_items_are_found_at_every_length():
    """One word replaced, left out or put in, at any place, in items of 5 to 60 words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    vocab = [word() for _ in range(3000)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(n))) for n in range(5, 61)]
    index = D.Index(items)
    found = Counter()
    for n, text in items:
        for k in range(9):
            own = text.split()
            at = rng.randrange(n)
            own[at : at + (k % 3 != 1)] = [] if k % 3 == 2 else [word()]
            doc = [rng.choice(vocab) for _ in range(200)]
            doc[100:100] = own
            found[n] += n in [x[0] for x in index.overlaps(doc)]
    assert sum(found.values()) >= 0.95 * 9 * len(items) and min(found[n] for n in range(10, 61)) >= 8
    clean = [[rng.choice(vocab) for _ in range(400)] for _ in range(300)]
    assert not any(index.overlaps(doc) for doc in clean)


def test_rows(spark):
    items, docs = corpus(5)
    bench = spark.createDataFrame([*items, (98, None), (None, "x y"), (99, ""), items[0]], "item_id long, text string")
    frame = spark.createDataFrame([*((i, t, "a") for i, t in docs), (None, items[3][1], "b"), (5000, None, "c"), (5001, "", "d"), docs[7][:2] + ("e",)], "doc_id long, text string, item_id string")
    whole = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in D.contaminated(frame, bench).collect())
    want, index = [], D.Index(items)
    for doc_id, text, _ in frame.collect():
        tokens = shingles.words(text)
        for i, t in items:
            own = shingles.words(t)
            if len(own) < 5:
                continue
            n = D.question_and_answer(own, t)
            shares = []
            for part in (own, own[:n], own[n:]):
                k = min(5, len(part))
                have = {tuple(tokens[j : j + k]) for j in range(len(tokens) - k + 1)}
                need = {tuple(part[j : j + k]) for j in range(len(part) - k + 1)} if part else set()
                shares.append(len(need & have) / len(need) if need else 1.0)
            retrieved = i in {index.ids[k] for k in index.retrieve(tokens)}
            if shares[0] >= 0.8 and min(shares) >= 0.5 or retrieved and (shares[0] > 0 or len(own) < 10) and aligned(own, tokens, n):
                want.append((doc_id if doc_id is not None else -1, i))
    assert whole == sorted(want) and len(want) > 20
    split = D.contaminated(frame, bench, chars=900)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in split.collect()) == sorted(want)
    assert D.contaminated(frame, bench.limit(0)).count() == 0 and D.contaminated(frame.limit(0), bench).count() == 0


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    items, docs = corpus(6)
    items += [(100, "alpha beta?"), (101, "gamma"), (102, "alpha beta gamma delta"), (103, "Gamma!"), (104, "?!")]
    docs += [(200, "x alpha beta y"), (201, "x, GAMMA. y"), (202, "alpha, beta gamma delta"), (203, "alpha x beta"), (204, "alpha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda **given: sorted((tuple(round(x, 9) if x is not None else -1.0 for x in r) for r in D.contaminated(frame, bench, **given).collect()))
    whole = rows()
    assert len(list(D.indexes(bench, chars=900))) > 4
    assert rows(chars=900) == whole and rows(chars=100) == whole and len(whole) > 20
    short = [(i, j, 1.0, 1.0, 1.0, 1.0, -1.0) for i, own in {200: [100], 201: [101, 103], 202: [100, 101, 102, 103]}.items() for j in own]
    words = {"th", "er", "on", "an", "re", "the", "of", "and"}
    one = [(i, t.split()) for i, t in items if len(t.split()) < 5 and set(t.split()) - words or i < 60]
    for i, text in docs:
        for j, run in one:
            if j < 60 and len(run) < 5 and any(text.split()[k : k + len(run)] == run for k in range(len(text.split()))):
                short.append((i, j, 1.0, 1.0, 1.0, 1.0, -1.0))
    assert rows(short=True) == rows(short=True, chars=900) == sorted(whole + short)


def test_long_texts_in_parts_have_the_same_scores(monkeypatch):
    items, docs = corpus(4)
    index = D.Index(items)
    tokens = [w for _, t in docs for w in shingles.words(t)] * 5
    whole = index.retrieve(tokens)
    monkeypatch.setattr(D, "CELLS", 6 * index.n_blocks)
    parts = index.retrieve(tokens)
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-9 for i in whole)


def test_an_index_is_small():
    rng = random.Random(1)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 200_000}" for _ in range(40))) for i in range(4000)]
    chars = sum(len(t) for _, t in items)
    assert D.Index(items).nbytes() < 15 * chars
    assert len(pickle.dumps(D.Index(items))) < 15 * chars


def test_query_is_its_sql(spark, sql_rows):
    sql_rows(D.op10_decontamination, D.ORACLE)
