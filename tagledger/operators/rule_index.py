"""The first matching rule of each workload for rule sets of any size.

Rules are a table (``RULE_TABLE``), not literals in the plan. A rule with text in it can only match a
workload that holds all runs of three characters (grams) of that text, so each rule is filed under the one of its
grams that fewest texts hold, workloads' distinct texts are exploded to grams, and the two are joined by field and
gram. What meets there is checked in full, and the smallest ``rule_idx`` wins. ``equals`` rules are joined
by the whole text, patterns of wildcards alone by the text's length. Every join has equal keys, and each text and each
condition is looked at once, however many workloads or rules share it. Adaptive execution may broadcast a side that turned
out small after a shuffle, or split a gram that many texts hold. Exploded sides are never broadcast: Spark guesses their size
before the explosion, and the driver would have to hold all of them.

Workloads are stored before they are matched. The index reads them several times, and if each reading repeated the plan that
makes them, the driver would hold a plan many times as large for as long as adaptive execution works on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tagledger.constants import RULE_FIELDS
from tagledger.functions.rules import NO_RULE, complete_rules
from tagledger.plans.session import work_folder

RULE_TABLE = "rule_idx int, field string, op string, value string, tags map<string,string>"
#: Characters of a gram. A rule whose longest text is shorter is filed under a gram of that length.
GRAM = 3
TEXT = ["field", "text"]


def rule_table(spark: SparkSession, rules: Sequence) -> DataFrame:
    """A list of rules as a table, numbered as ``complete_rules`` does."""
    rows = [(i, r.field, r.op, r.value, dict(r.tags)) for i, r in enumerate(complete_rules(rules))]
    return spark.createDataFrame(rows, RULE_TABLE)


def complete_rows(rules: DataFrame) -> DataFrame:
    """Rules of a table that have both a value and tags. Smaller numbers win; they need not be gapless."""
    return rules.where((F.coalesce("value", F.lit("")) != "") & (F.coalesce(F.size("tags"), F.lit(0)) > 0))


def _grams(text: Column, size: int | Column) -> Column:
    """All runs of ``size`` characters, each once."""
    letters = F.split(text, "")
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.array_join(F.slice(letters, i, size), "")))


def _filed(rules: DataFrame) -> DataFrame:
    """Rules by what they look for, in lower case: ``pattern``. A row may stand in the table more than once."""
    return complete_rows(rules).select("field", "op", F.lower("value").alias("pattern"), F.col("rule_idx").cast("int").alias("rule_idx"))


def _only_marks() -> Column:
    """No text beside the wildcards; cheap, as Spark tests it on every rule before it brings equal ones together."""
    return F.translate("pattern", "*?", "") == ""


def _like(pattern: Column) -> Column:
    return F.translate(F.regexp_replace(pattern, r"([\\%_])", r"\\$1"), "*?", "%_")


def _by_text(texts: DataFrame, rules: DataFrame) -> DataFrame:
    equal = rules.where("op = 'equals'").select("rule_idx", "field", F.col("pattern").alias("text"))
    # texts are told apart already, and Spark guesses their size before they are exploded
    return texts.hint("merge").join(equal.groupBy(*TEXT).agg(F.min("rule_idx").alias("rule_idx")), TEXT)


def _by_gram(texts: DataFrame, rules: DataFrame) -> DataFrame:
    gram_ops = (F.col("op") == "contains") | ((F.col("op") == "matches") & ~_only_marks())
    # of rules that ask the same only the smallest number can win; so each stands once, however often the table has it
    alike = rules.where(gram_ops).groupBy("field", "op", "pattern").agg(F.min("rule_idx").alias("rule_idx"))
    pieces = F.when(F.col("op") == "matches", F.split("pattern", "[*?]")).otherwise(F.array("pattern"))
    longest = F.array_max(F.transform("pieces", F.char_length))
    grams = F.array_distinct(F.flatten(F.transform("pieces", lambda p: _grams(p, F.col("size")))))
    wanted = alike.withColumn("pieces", pieces).withColumn("size", F.least(longest, F.lit(GRAM))).withColumn("grams", grams).drop("pieces")
    # no rule lacks grams; for a plain explode Spark would test that, by making them, on every rule before equal ones meet
    filed = wanted.withColumn("n_grams", F.size("grams")).select("*", F.explode_outer("grams").alias("gram")).drop("grams")
    needed = filed.select("field", "gram").distinct()
    sizes = wanted.agg(F.collect_set("size")).scalar()
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains(sizes, n), _grams(F.col("text"), n)).otherwise(none) for n in range(1, GRAM + 1)]
    held = texts.select(*TEXT, F.explode(F.concat(*parts)).alias("gram")).join(needed, ["field", "gram"], "left_semi")
    often = held.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n_texts"))
    # a rule with a gram that no text holds matches nothing; of a left join only the right side may be broadcast
    keyed = filed.join(often, ["field", "gram"], "left").groupBy("rule_idx", "field", "op", "pattern", "n_grams").agg(
        F.count("n_texts").alias("n_held"), F.min(F.struct("n_texts", "gram"))["gram"].alias("gram")) \
        .where("n_held = n_grams").drop("n_held", "n_grams")
    text, pattern = F.col("text"), F.col("pattern")
    holds = F.when(F.col("op") == "contains", F.contains(text, pattern)).otherwise(F.like(text, _like(pattern), F.lit("\\")))
    return held.join(keyed.hint("merge"), ["field", "gram"]).where(holds).select(*TEXT, "rule_idx")


def _by_length(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Patterns of ? and * alone ask for a length, or for a least length. The smallest rule number up to each
    length that occurs is a running minimum over lengths, of which there are few."""
    marks = rules.where((F.col("op") == "matches") & _only_marks()).select(
        "rule_idx", "field", F.contains("pattern", F.lit("*")).alias("open"),
        F.char_length(F.translate("pattern", "*", "")).alias("length"))
    sized = texts.withColumn("length", F.char_length("text"))
    exact = marks.where("NOT open").groupBy("field", "length").agg(F.min("rule_idx").alias("exact"))
    steps = marks.where("open").groupBy("field", "length").agg(F.min("rule_idx").alias("step"))
    upward = Window.partitionBy("field").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    floors = sized.select("field", "length").distinct().join(steps, ["field", "length"], "full") \
        .withColumn("floor", F.min("step").over(upward)).drop("step")
    # every text has its floor; of a left join only the right side may be broadcast
    found = sized.join(floors, ["field", "length"], "left").join(exact, ["field", "length"], "left")
    return found.select(*TEXT, F.least("floor", "exact").alias("rule_idx")).where("rule_idx IS NOT NULL")


def _stored(workloads: DataFrame) -> DataFrame:
    """The workloads as a table, each row with a number of its own in ``_row``."""
    numbered = workloads.withColumn("_row", F.monotonically_increasing_id())
    path = work_folder(workloads.sparkSession, "workloads")
    numbered.write.parquet(path)
    return workloads.sparkSession.read.schema(numbered.schema).parquet(path)


def with_first_rule(workloads: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``first_rule``, the smallest ``rule_idx`` of the rules in the table that match, or -1. Same matching as
    ``functions.rules``: without regard to case, nulls as empty texts, unknown operators match nothing."""
    def text(field: str) -> Column:
        return F.lower(F.coalesce(F.col(RULE_FIELDS[field]), F.lit("")))

    stored = _stored(workloads)
    held = stored.select("_row", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), text(f).alias("text")) for f in RULE_FIELDS])).alias("t")).select("_row", "t.*")
    texts, filed = held.select(*TEXT).distinct(), _filed(rules)
    first = _by_text(texts, filed).select(*TEXT, "rule_idx").unionByName(_by_gram(texts, filed)) \
        .unionByName(_by_length(texts, filed)).groupBy(*TEXT).agg(F.min("rule_idx").alias("rule_idx"))
    # a key that the index is not grouped by, so that both sides are plain shuffles and a text that many hold can be split
    key = F.struct(*TEXT).alias("_text")
    per_row = held.select("_row", key).join(first.select(key, "rule_idx"), "_text", "left") \
        .groupBy("_row").agg(F.min("rule_idx").alias("_rule"))
    return stored.join(per_row, "_row", "left").select(
        *[F.col(c) for c in workloads.columns], F.coalesce("_rule", F.lit(NO_RULE)).alias("first_rule"))


def tags_of(rules: DataFrame) -> DataFrame:
    """The relation (rule_idx, tag_key, tag_value) of a rule table, joined by a shuffle as it may be of any size."""
    return complete_rows(rules).select(F.col("rule_idx").cast("int").alias("rule_idx"),
                                       F.explode("tags").alias("tag_key", "tag_value")).hint("merge")


def values_for_key(rules: DataFrame, key: str) -> DataFrame:
    """(first_rule, new_tag_value): what each rule gives to ``key``, '' where it does not set it. Joined by a shuffle."""
    value = F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit(""))
    return complete_rows(rules).select(F.col("rule_idx").cast("int").alias("first_rule"), value.alias("new_tag_value")).hint("merge")
