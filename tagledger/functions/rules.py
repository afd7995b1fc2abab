"""Tagging rules: an ordered list, the first rule that matches wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagledger.constants import RULE_FIELDS

NO_RULE = -1

# In a glob, * and ? are wildcards and everything else is literal.
_GLOB_TO_LIKE = str.maketrans({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": "\\\\"})


@dataclass(frozen=True)
class Rule:
    """``field`` is owner, workspace, product or name; ``op`` is equals,
    contains or matches (a glob). Text is compared without regard to case and
    a null column counts as empty."""

    field: str
    op: str
    value: str
    tags: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, rule: "Rule | Mapping") -> "Rule":
        if isinstance(rule, Rule):
            return rule
        return cls(rule["field"], rule["op"], rule.get("value") or "", dict(rule.get("tags") or {}))

    @property
    def complete(self) -> bool:
        return bool(self.value) and bool(self.tags)


def complete_rules(rules: Sequence) -> list[Rule]:
    """Rules that have both a value and tags; the rest take no part and do not
    count towards rule positions."""
    return [r for r in map(Rule.of, rules) if r.complete]


def _text(rule: Rule) -> Column:
    return F.lower(F.coalesce(F.col(RULE_FIELDS[rule.field]), F.lit("")))


def rule_match(rule: Rule) -> Column:
    """Does the workload row match? The rule's text is only ever a literal; an
    unknown operator matches nothing."""
    if rule.op == "equals":
        return _text(rule) == F.lower(F.lit(rule.value))
    if rule.op == "contains":
        return F.contains(_text(rule), F.lower(F.lit(rule.value)))
    if rule.op == "matches":
        pattern = F.lower(F.lit(rule.value.translate(_GLOB_TO_LIKE)))
        return F.like(_text(rule), pattern, F.lit("\\"))
    return F.lit(False)


def first_match(rules: Sequence[Rule]) -> Column:
    """Position of the first matching rule, or -1.

    The ``equals`` rules of a field are one constant array, and their first hit
    is looked up in it; all others are one CASE ladder. The smaller position
    wins, which is the same as testing all rules in order, and holds for any number of
    rules. Spark lowers the text on both sides."""
    equals: dict[str, list[tuple[int, Rule]]] = {}
    ladder = F.lit(None).cast("int")
    for position, rule in reversed(list(enumerate(rules))):
        if rule.op == "equals":
            equals.setdefault(rule.field, []).insert(0, (position, rule))
        else:
            ladder = F.when(rule_match(rule), position).otherwise(ladder)
    found = [ladder, F.lit(None).cast("int")]
    for listed in equals.values():
        values = F.array(*[F.lower(F.lit(r.value)) for _, r in listed])
        hit = F.array_position(values, _text(listed[0][1])).cast("int")
        found.append(F.get(F.array(*[F.lit(i) for i, _ in listed]), hit - 1))
    return F.coalesce(F.least(*found), F.lit(NO_RULE))


def with_first_rule(workloads: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``first_rule``."""
    return workloads.withColumn("first_rule", first_match(rules))


def rule_tags(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The literal relation (rule_idx, tag_key, tag_value)."""
    rows = [
        F.struct(F.lit(i).alias("rule_idx"), F.lit(k).alias("tag_key"), F.lit(v).alias("tag_value"))
        for i, rule in enumerate(rules) for k, v in rule.tags.items()
    ]
    shape = "array<struct<rule_idx:int,tag_key:string,tag_value:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(shape)))


def value_for_key(rules: Sequence[Rule], key: str, position: str = "first_rule") -> Column:
    """Value the winning rule gives to ``key``: '' when that rule does not set
    it, null when no rule won."""
    values = F.array(*[F.lit(rule.tags.get(key, "")) for rule in rules])
    return F.when(F.col(position) >= 0, F.get(values, F.col(position)))


def covers_key(rules: Sequence[Rule], key: str, position: str = "first_rule") -> Column:
    """Does the winning rule set ``key``?"""
    setters = [i for i, rule in enumerate(rules) if key in rule.tags]
    return F.col(position).isin(*setters) if setters else F.lit(False)
