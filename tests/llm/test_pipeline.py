"""The stages in a row, on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tagledger.llm import queries

rng = random.Random(9)
SYLLABLES = "an be cor dil em fus gra hol it jul kan lor".split()


def prose(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, f"{prose(15)}. {prose(12)}.") for i in range(5)]
    texts = {i: prose(rng.randrange(80, 200)) for i in range(300)}
    toxic = {i for i in texts if i % 6 == 0}
    for i in toxic:
        texts[i] += " " + " ".join(rng.choice(("grolbad", "grolvile")) for _ in range(4))
    for i in range(1, 40, 6):
        texts[1000 + i] = texts[i]  # a copy
        words = texts[i].split()
        texts[2000 + i] = " ".join(words[:40] + ["other"] + words[41:])  # a near copy
    for i in range(5):
        texts[3000 + i] = prose(70) + " " + items[i][1] + " " + prose(70)
    rows = [(d, t, "en", f"src{d % 3}", len(t)) for d, t in texts.items()]
    for name, data, ddl in (
            ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", [(d, 1, int(d in toxic)) for d in range(300)], "doc_id long, quality int, toxic int"),
            ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, ddl).write.parquet(f"{folder}/{name}.parquet")
    return folder, texts, toxic


def test_stages(spark, tables):
    folder, texts, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "mixing", "tokens"]
    expected = set(texts) - toxic
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        left.append({r[0] for r in docs.select("doc_id").collect()})
    assert left[0] == expected
    component = brute.simhash([(d, texts[d]) for d in expected])
    assert left[1] == {d for d in expected if component[d][1] == d}
    assert not any(1000 <= d < 2000 for d in left[1])
    assert left[2] == {d for d in left[1] if d < 3000}
    assert left[3] <= left[2]
    per_source = docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("taken")).collect()
    goal = brute.targets([(d, f"src{d % 3}", texts[d]) for d in left[2]])
    for r in per_source:
        assert r["taken"] == pytest.approx(goal[r["source"]][1], rel=0.02)

    from tokenizers import Tokenizer

    mixed = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    ids = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()), key=lambda r: r[1])
    assert ids == brute.tokens(mixed, Tokenizer.from_file(queries.vocabulary()))
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1])
    assert whole == ids


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
