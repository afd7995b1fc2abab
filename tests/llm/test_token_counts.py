"""Prefix counts against the tokenizers library itself."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from tagledger.llm import queries, token_counts
from tagledger.llm.token_counts import PrefixCounter, packed, unpacked

PARTS = [" ", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "　", "\x1c", "\0", "a", "ll", "'", "'l", "'ll", "'re", "'r", "'v", "'s",
         "x", "é", "ñandú", "あ", "😀", "́", "1", "23", "=", "==", "!", "...", "the", "ing", "tion", "A", "S", "<|endoftext|>", "<|end", "|>"]
VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter.of(VOCABULARY)


def lengths(model, text):
    return [len(model.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def made(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(parts))) for _ in range(n)]


def test_every_prefix_of_awkward_texts(model, counter):
    for text in made(1, 1500, 14):
        assert unpacked(packed(counter.steps(text))).tolist() == lengths(model, text), repr(text)


def test_prefixes_of_words_merge_as_the_library_does(model, counter):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("etaoinshr-=#") for _ in range(rng.randrange(1, 60)))
        assert unpacked(packed(counter.steps(text))).tolist() == lengths(model, text), text


def test_long_runs_take_linear_time_and_are_counted(model, counter):
    for text in ("=" * 200_000, "ab" * 100_000, " " * 200_000 + "x", "あ" * 60_000):
        counts = unpacked(packed(counter.steps(text)))
        assert len(counts) == len(text) + 1
        for k in (0, 1, 17, 9_999, len(text)):
            assert counts[k] == len(model.encode(text[:k], add_special_tokens=False).ids)


def test_bounded_memory_gives_the_same_counts(monkeypatch, model):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "FITS", 5)
    monkeypatch.setattr(token_counts, "SHORT", 4)
    small = PrefixCounter(VOCABULARY)
    for text in made(3, 200, 12):
        assert unpacked(packed(small.steps(text))).tolist() == lengths(model, text), repr(text)


def test_whole_table(spark, model):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_token_counts"](spark, SF).collect()}
    counts = {d: len(model.encode(t, add_special_tokens=False).ids) for d, t in docs}
    assert found == {d: (len(t.encode()), counts[d], counts[d] > 1024) for d, t in docs}
    assert any(r[2] for r in found.values()) and not all(r[2] for r in found.values())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("n_tokens", "prefixes", "n_chars", "kept_chars", "steps")}).repartition(3)


def test_awkward_rows(spark, model):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 70_000), (5, "<|endoftext|>")]
    found = sorted(map(tuple, token_counts.prefix_counts(frame(spark, rows), VOCABULARY).select(
        "doc_id", "n_bytes", "n_chars", "n_tokens").collect()), key=str)
    assert found == sorted(((d, len((t or "").encode()), len(t or ""), lengths(model, t or "")[-1] if len(t or "") < 99 else
                             len(model.encode(t).ids)) for d, t in rows), key=str)
    empty = token_counts.prefix_counts(frame(spark, rows).limit(0), VOCABULARY)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefixes"]


def test_budgets_and_places(spark, model):
    texts = [t for t in made(4, 60, 20)] + ["", "word " * 400]
    docs = frame(spark, list(enumerate(texts)))
    counted = token_counts.prefix_counts(docs, VOCABULARY)
    for chars in (-1, 0, 5, 10_000):
        got = {r["doc_id"]: r["tokens_before"] for r in token_counts.tokens_before(counted, chars).collect()}
        assert got == {d: len(model.encode(t[:max(chars, 0)], add_special_tokens=False).ids) for d, t in enumerate(texts)}
    for budget in (-1, 0, 1, 7, 300):
        got = {r["doc_id"]: r for r in token_counts.truncated(docs, VOCABULARY, budget).collect()}
        for d, text in enumerate(texts):
            counts = lengths(model, text)
            place = max(k for k, c in enumerate(counts) if c <= max(budget, 0))
            assert (got[d]["text"], got[d]["kept_tokens"], got[d]["n_tokens"]) == (text[:place], counts[place], counts[-1])


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
