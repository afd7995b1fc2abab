"""Cross-tokenizer alignment against whole-text encoding and plain sets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tagledger.llm import alignment, queries

A, B = queries.vocabulary(), queries.piece_vocabulary()
rng = random.Random(9)
PARTS = [" ", " ", "  ", "   ", "\n", "\n ", "\t", "\xa0", "é", "ñandú", "あ", "日本語", "😀", "́", "1", "2024", "=", "====", "!", "the",
         "ing", "tion", "Hello", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "\0", "\r\n", "x" * 30, "zqzqzq", "▁"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def unicode_bytes():
    """Byte-level characters to bytes: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = unicode_bytes()


def plain_groups(models, text):
    """[(ids of A, ids of B)] of a text by sets of ends; none if the bytes differ."""
    a, b = models
    if not text:
        return []
    whole = (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pa = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ia]
    names = [b.id_to_piece(i) for i in ib]
    pb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, names)]
    if b"".join(pa) != whole or b"".join(pb) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(p) for p in pa]).tolist(), np.cumsum([len(p) for p in pb]).tolist()
    cuts, groups, at = sorted(set(ends_a) & set(ends_b)), [], 0
    for cut in cuts:
        groups.append(([i for i, e in zip(ia, ends_a) if at < e <= cut], [i for i, e in zip(ib, ends_b) if at < e <= cut]))
        at = cut
    return groups


def brute(models, docs):
    groups = [plain_groups(models, t or "") for _, t in docs]
    counts = Counter()
    for of in groups:
        counts.update({(x, y) for ga, gb in of for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (d, _), of in zip(docs, groups):
        links = [(x, y) for ga, gb in of for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in of)
        out.append((d, sum(len(g[0]) for g in of), sum(len(g[1]) for g in of), len(of), len(links),
                    sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(shown.encode()).hexdigest() if of else ""))
    return out, counts


def awkward(n=400):
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(16))) for _ in range(n)]
    return texts + [None, "", " ", "a ", "\n", "ab" * 700, "=" * 900, "the cat " * 300, "the cat " * 300, "▁", "x▁y"]


def frame(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("a", "b", "n", "chunk", "n_a", "place", "uses")}).repartition(3)


def key(row):
    return (str(row[0]), *row[1:])


def found(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("settings", [{}, {"CHUNK_TEXTS": 3, "WIDE": 4, "REMEMBERED": 50}])
def test_awkward_texts(spark, models, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    docs = [(None if i % 90 == 0 else i // 2 * 2, t) for i, t in enumerate(awkward())]
    expected, counts = brute(models, docs)
    assert sum(1 for r in expected if r[1]) > 250 and any(r[4] > 3 * r[3] for r in expected)
    assert found(alignment.linked_documents(frame(spark, docs), A, B)) == sorted(expected, key=key)
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(frame(spark, docs), A, B).collect()} == counts
    for r in alignment.alignments(frame(spark, [(i, t) for i, t in enumerate(awkward(40))]), A, B).collect():
        cuts_a, cuts_b = [0, *r.a_cuts], [0, *r.b_cuts]
        assert cuts_a[-1] == len(r.a_ids) and cuts_b[-1] == len(r.b_ids) and len(cuts_a) == len(cuts_b)
        assert all(x < y for c in (cuts_a, cuts_b) for x, y in zip(c, c[1:]))


def test_empty_table(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert alignment.linked_documents(empty, A, B).count() == 0
    assert alignment.alignments(empty, A, B).count() == 0 and alignment.pair_counts(empty, A, B).count() == 0


def test_cuts_of_any_shape():
    """Cuts by halving are all common ends, wherever they lie."""
    draw = np.random.default_rng(4)
    for _ in range(300):
        sizes = [(draw.integers(1, 6, draw.integers(1, 80)), draw.integers(1, 6, draw.integers(1, 80))) for _ in range(draw.integers(1, 6))]
        ends_a, ends_b, stops_a, stops_b, at = [], [], [], [], 0
        for a, b in sizes:
            a, b = np.cumsum(a), np.cumsum(b)
            last = max(a[-1], b[-1])
            a[-1] = b[-1] = last
            ends_a.extend(at + a)
            ends_b.extend(at + b)
            at += last
            stops_a.append(len(ends_a))
            stops_b.append(len(ends_b))
        cuts_a, cuts_b = alignment.shared_cuts(*map(np.array, (ends_a, ends_b, stops_a, stops_b)))
        common = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[c - 1] for c in cuts_a] == common == [ends_b[c - 1] for c in cuts_b]


def test_whole_table(spark, models):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_alignment"](spark, SF)) == sorted(brute(models, docs)[0], key=key)
