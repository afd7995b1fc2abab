"""Check tag maps against the limits; the result lists every violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagledger import constants as C
from tagledger.schemas import RESOURCE_KEY


def _outside(text: Column, bounds: tuple[int, int]) -> Column:
    """Length in characters (code points, not bytes) out of bounds."""
    return ~F.char_length(text).between(*bounds)


def violations(tags: Column, allow_empty: bool = False, most: int = C.MAX_TAGS,
               reserved_prefixes: Sequence[str] = C.RESERVED_KEY_PREFIXES) -> Column:
    """Array of (tag_key, rule) structs; empty when the map is fine. An empty
    map would wipe a resource, so it is refused unless confirmed. Other places
    that tags are written to may allow another number or other prefixes."""
    def hit(rule: str, key: Column) -> Column:
        return F.struct(key.alias("tag_key"), F.lit(rule).alias("rule"))

    def of_map(rule: str, broken: Column) -> Column:
        return F.when(broken, F.array(hit(rule, F.lit(None).cast("string"))))

    def of_entry(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        reserved = F.lit(False)
        for prefix in reserved_prefixes:
            reserved = reserved | F.startswith(F.lower(key), F.lit(prefix))
        checks = {
            "key_length": _outside(key, C.KEY_LENGTH),
            "key_reserved": reserved,
            "value_missing": value.isNull(),
            "value_length": value.isNotNull() & _outside(value, C.VALUE_LENGTH),
        }
        return F.filter(F.array(*[F.when(bad, hit(rule, key)) for rule, bad in checks.items()]),
                        lambda found: found.isNotNull())

    none = F.array().cast("array<struct<tag_key:string,rule:string>>")
    size = F.coalesce(F.size(tags), F.lit(0))
    missing = F.lit(False) if allow_empty else (tags.isNull() | (size == 0))
    entries = F.when(tags.isNotNull(), F.flatten(F.transform(F.map_entries(tags), of_entry)))
    return F.concat(
        F.coalesce(of_map("empty", missing), none),
        F.coalesce(of_map("too_many", size > most), none),
        F.coalesce(entries, none),
    )


def tag_violations(rows: DataFrame, ids: Sequence[str], tags: str = "tags", **limits) -> DataFrame:
    """One row (ids, tag_key, rule) per violation; ``limits`` as for ``violations``."""
    return rows.select(*ids, F.inline(violations(F.col(tags), **limits)))


def checked(rows: DataFrame) -> DataFrame:
    """The same rows; computing one whose tag_key and tag_value break a limit
    fails the job, so bad intent is never stored."""
    found = violations(F.create_map("tag_key", "tag_value"))
    message = F.concat(F.lit("tag not allowed: "), F.to_json(found))
    return rows.withColumn(
        "tag_key", F.when(F.size(found) > 0, F.raise_error(message)).otherwise(F.col("tag_key")))


def overfull(rows: DataFrame, tag_state: DataFrame, open_rows: DataFrame,
             most: int = C.MAX_TAGS) -> DataFrame:
    """Resources (with their count of keys) that would hold more than ``most``
    tags once ``rows`` and the intent that is already open took effect."""
    wanted = rows.select(*RESOURCE_KEY, "tag_key")
    touched = wanted.select(*RESOURCE_KEY).distinct()
    held = tag_state.select(*RESOURCE_KEY, F.explode(F.map_keys("tags")).alias("tag_key"))
    others = held.unionByName(open_rows.select(*RESOURCE_KEY, "tag_key")).join(
        touched, list(RESOURCE_KEY), "left_semi")
    return wanted.unionByName(others).groupBy(*RESOURCE_KEY).agg(
        F.count_distinct("tag_key").alias("tags")).filter(F.col("tags") > most)
