"""Collocations against plain counting, and the registered query against its SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from tagledger.llm import collocations, queries
from verification.compare import compare, duck

rng = random.Random(11)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, longest=4, share=80, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    often = {k: f for k, f in counts.items() if f >= least}
    rows = []
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        inside = any(x == lang and len(long) > len(words) and 100 * f >= share * a and
                     any(long[i:i + len(words)] == words for i in range(len(long) - len(words) + 1))
                     for (x, long), f in often.items())
        if not inside:
            rows.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return out


WORDS = ["the", "The", "red", "fox", "été", "日本", "a\xa0b", "x", "of", "course", "new", "york", "\x1c", "😀"]


def awkward(n=500):
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.4:
            text += " in the new york city "
        docs.append((rng.choice([" ", "", "\t"]) + text, rng.choice(["en", "en", "fr", None, "und", "É"])))
    return docs + [(None, "en"), ("", None), (" \n\t.", "fr"), ("....", "en"), ("of course " * 900, "en"), ("y" * 9000 + " z", "en")]


def frame(spark, docs):
    df = spark.createDataFrame([(i // 3, *d) for i, d in enumerate(docs)], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in ("phrase", "n", "f", "fp", "c", "rank", "words", "place")}).repartition(3)


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0].encode(), r[1]))


def plain(rows):
    return sorted(rows, key=lambda r: (r[0].encode(), r[1]))


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_awkward_texts(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    collocations._POWERS.clear()
    docs = awkward(2500)
    expected = plain(brute(docs))
    assert len(expected) > 30 and {r[0] for r in expected} == {"en", "fr", "und", "É"}
    assert found(collocations.collocations(frame(spark, docs))) == expected
    small = collocations.collocations(frame(spark, docs), least=12, longest=3, share=50, top=7)
    assert found(small) == plain(brute(docs, 12, 3, 50, 7))
    pairs = collocations.collocations(frame(spark, docs), longest=2)
    assert found(pairs) == plain(brute(docs, longest=2))


def test_collisions_are_told_apart(spark, monkeypatch):
    """With fingerprints of three bits nearly all runs collide, and counts are those of the texts."""
    def narrow(self, first, n):
        start = self.start[first]
        return (self.prefix[self.end[first + (n - 1)]] - self.prefix[start]) * self.down[start] & np.uint64(7) << np.uint64(61)

    docs = awkward(200)
    expected = plain(brute(docs))
    batches = [(t or "", l or "und") for t, l in docs]
    monkeypatch.setattr(collocations.Words, "fingerprints", narrow)
    import pyarrow as pa

    words = next(collocations._blocks([pa.RecordBatch.from_arrays(
        [pa.array([t.encode() for t, _ in batches]), pa.array([l for _, l in batches])], names=["text", "lang"])], 4))
    first = words.runs(2)
    texts = words.texts(first, np.full(len(first), 2)).to_pylist()
    for _ in range(3):
        other = np.array([rng.randrange(len(first)) for _ in first])
        same = words.same(first, first[other], np.full(len(first), 2))
        langs = [(words.lang[i], t) for i, t in zip(first, texts)]
        assert same.tolist() == [x == langs[o] for x, o in zip(langs, other)]
    assert len(expected) > 0


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 0)
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    docs = awkward(300)
    assert found(collocations.collocations(frame(spark, docs))) == plain(brute(docs))


def test_counts_of_phrases_and_words(spark):
    docs = [("a b, A B; a\tb c", "en")] * 10 + [("a b", None)]
    counts = {(r.lang, r.n, r.phrase): r.f for r in collocations.phrase_counts(frame(spark, docs), least=2).collect()}
    assert counts == {("en", 0, ""): 70, ("und", 0, ""): 2, ("en", 1, "a"): 30, ("en", 1, "b"): 30, ("en", 1, "c"): 10,
                      ("en", 2, "a b"): 30, ("en", 2, "b c"): 10, ("en", 3, "a b c"): 10}


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, [("a", "b")]).limit(0)).count() == 0


def test_large_counts_stay_exact(spark, monkeypatch):
    """Counts of which the products pass 64 bits."""
    big = 4 * 10**15
    made = spark.createDataFrame([("en", 0, "", 9 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big - 1)],
                                 "lang string, n int, phrase string, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: made)
    row, = collocations.collocations(made).collect()
    assert tuple(row) == ("en", 1, "a b", big - 1, big + 1, big + 3, 9 * big, 2_000_000 * (big - 1) // (2 * big + 4))


def test_whole_table(spark):
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    query = queries.QUERIES["op12_collocations"]
    assert found(query(spark, SF)) == plain(brute(docs))
    count, difference = compare(spark, duck(SF), SF, "op12_collocations", query, entry.oracle_sql()["op12_collocations"])
    assert difference is None and count > 30
