import pytest

from conftest import rows
from tagledger.operators import validate as V


def broken(spark, tags, **options):
    df = spark.createDataFrame([(1, tags)], "id int, tags map<string,string>")
    return [(k, r) for _, k, r in rows(V.tag_violations(df, ["id"], **options))]


@pytest.mark.parametrize("tags,expected", [
    ({"": "v"}, [("", "key_length")]),
    ({"k" * 127: "v"}, []),
    ({"k" * 128: "v"}, [("k" * 128, "key_length")]),
    ({"ß" * 127: "v"}, []),
    ({"aws:foo": "v"}, [("aws:foo", "key_reserved")]),
    ({"AWS:Foo": "v"}, [("AWS:Foo", "key_reserved")]),
    ({"awsfoo": "v"}, []),
    ({"größe": "Ω — 12 €"}, []),
    ({"k": ""}, []),
    ({"k": "v" * 255}, []),
    ({"k": "v" * 256}, [("k", "value_length")]),
    ({"k": None}, [("k", "value_missing")]),
    ({}, [(None, "empty")]),
    (None, [(None, "empty")]),
    ({f"k{i}": "v" for i in range(20)}, []),
    ({f"k{i}": "v" for i in range(21)}, [(None, "too_many")]),
    ({"k" * 200: "v" * 300}, [("k" * 200, "key_length"), ("k" * 200, "value_length")]),
])
def test_limits(spark, tags, expected):
    assert broken(spark, tags) == expected


def test_every_reserved_prefix(spark):
    for prefix in V.C.RESERVED_KEY_PREFIXES:
        key = prefix.title() + "_x"
        assert broken(spark, {key: "v"}) == [(key, "key_reserved")]
        assert broken(spark, {key: "v"}, reserved_prefixes=()) == []


def test_other_numbers_of_tags(spark):
    assert broken(spark, {"a": "1", "b": "2"}, most=1) == [(None, "too_many")]


def test_confirmed_empty_payload(spark):
    assert broken(spark, {}, allow_empty=True) == []


def test_bad_intent_is_refused(spark):
    def run(*pairs):
        df = spark.createDataFrame(list(pairs), "tag_key string, tag_value string")
        return rows(V.checked(df))

    assert run(("k", ""), ("größe", "v")) == [("größe", "v"), ("k", "")]
    for bad in (("", "v"), ("aws:x", "v"), ("k", None), ("k", "v" * 256)):
        with pytest.raises(Exception, match="tag not allowed"):
            run(("k", "v"), bad)
