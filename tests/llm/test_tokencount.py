import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_match_the_library():
    rng = random.Random(8)
    library = Tokenizer.from_file(PATH)
    texts = [None, "", " ", "Hello  World's 123 it's!! 'S áb ½ Ⅷ", "I'LL <|endoftext|> x<|startoftext|>'re", "a'", "''s", " x y\x1cz\x85w​q", "don'tx", "!'sx", "'r", "'re've'll'd'v'l 'r 'rx 'lv", "İΣΑΣ ẞ", "中文字", "éé", "Aa" * 3000, "x" * 5000, "'" * 200, "<|EndOfText|>", "퟿\U0010ffff"]
    alphabet = "aAsStTrRvVeEmMlLdD'' \n.!éΣ́中1½\U0001f600"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(500)]
    syllables = ["the", "ing", "tion", "é", "ch", "ou", "er", "re", "an", "on", "en", "at", "st", "nd", "th", " ", " ", "'", "ñ", "ción"]
    texts += ["".join(rng.choice(syllables) for _ in range(200)) for _ in range(300)]
    counter = tokencount.TokenCounter(PATH)
    want = [len(library.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert counter.count(texts) == want


def test_long_texts_are_counted_in_parts(monkeypatch):
    library = Tokenizer.from_file(PATH)
    text = "the cat's <|endoftext|> hat 12 " * 500
    monkeypatch.setattr(tokencount, "PIECE", 100)
    assert tokencount.TokenCounter(PATH).count([text, "", text]) == [len(library.encode(text, add_special_tokens=False).ids), 0, len(library.encode(text, add_special_tokens=False).ids)]


def test_rows(spark):
    rows = spark.createDataFrame([(1, "the cat", 5), (None, None, 6), (1, "the cat", 7), (2, "", 8)], "doc_id long, text string, n_tokens int")
    out = tokencount.count_tokens(rows, PATH, limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [(0, 0, 0, False), (1, 7, 2, True), (1, 7, 2, True), (2, 0, 0, False)]
    assert tokencount.count_tokens(rows.limit(0), PATH).count() == 0


def test_every_code_point():
    library = Tokenizer.from_file(PATH)
    counter = tokencount.TokenCounter(PATH)
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        assert counter.count(part) == [len(x.ids) for x in library.encode_batch_fast(part, add_special_tokens=False)]


def test_long_words_are_composed_of_chunks(monkeypatch):
    rng = random.Random(3)
    library = Tokenizer.from_file(PATH)
    texts = ["x" * 10_000, "abc" * 5000, "thecatsat" * 3000, "執é" * 4000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "the " + "z" * 64, "z" * 65, "z" * 128]
    want = [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert tokencount.TokenCounter(PATH).count(texts) == want
    for name, value in (("SIDE_BY_SIDE", 1024), ("LOOK_BACK", 0), ("MAX_STATES", 500), ("WORD_CHUNK", 7)):
        monkeypatch.setattr(tokencount, name, value)
        assert tokencount.TokenCounter(PATH).count(texts) == want


def test_a_word_of_a_megabyte_takes_seconds():
    counter = tokencount.TokenCounter(PATH)
    for word in ("x" * 1_000_000, "abc" * 333_333):
        began = time.perf_counter()
        assert counter.count([word]) == [len(Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids)]
        assert time.perf_counter() - began < 20


def test_query_is_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = sorted((i, len(x.encode()), n := len(library.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in texts.items())
    assert sorted(map(tuple, tokencount.op8_token_counts(spark, "/root/testdata/sf0.01").collect())) == want


def test_neighbours_are_what_merging_gives():
    rng = random.Random(4)
    words = tokencount.TokenCounter(PATH).words
    tokens = [t for t in words.token_at.values() if words.reachable(t)][::7]
    short = [t for t in words.token_at.values() if len(t.removesuffix(words.end)) <= 3 and set(t.removesuffix(words.end)) <= set("aehinost") and words.reachable(t)]
    found = 0
    for k in range(30_000):
        left, right = (rng.choice(tokens if k % 2 else short) for _ in range(2))
        if left.endswith(words.end):
            continue
        want = words.merged(words.symbols_of(left) + words.symbols_of(right)) == [left, right]
        assert words.neighbours(left, right) == want, (left, right)
        found += want
    assert 1000 < found < 20_000
