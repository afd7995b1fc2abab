"""Expressions over tag maps: merge one key, fold many, normalise shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY_TAGS = "map<string,string>"


def no_tags() -> Column:
    return F.create_map().cast(EMPTY_TAGS)


def value_of(tags: Column, key: Column) -> Column:
    return F.try_element_at(tags, key)


def without(tags: Column, keys: Column) -> Column:
    return F.map_filter(tags, lambda k, _: ~F.array_contains(keys, k))


def merge_changes(tags: Column, changes: Column) -> Column:
    """Apply a map key -> new value to a tag map. A null value removes the key,
    every key not named is kept."""
    kept = without(F.coalesce(tags, no_tags()), F.map_keys(changes))
    return F.map_concat(kept, F.map_filter(changes, lambda _, v: v.isNotNull()))


def merge_one(tags: Column, key: Column, value: Column) -> Column:
    return merge_changes(tags, F.create_map(key, value))


def is_noop(old: Column, new: Column) -> Column:
    """The key already stands as wanted: same value, or absent and to be removed."""
    return old.eqNullSafe(new)


def tags_from_pairs(pairs: Column) -> Column:
    """Map from an array of {key, value}; of a repeated key the last one counts, and a pair without a key does not."""
    pairs = F.filter(pairs, lambda p: p["key"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))

    def last(k: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]

    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, last)), no_tags())


def tags_from_maps(maps: Column) -> Column:
    """Union of an array of tag maps; later maps win."""
    pairs = F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), F.map_entries))
    return tags_from_pairs(pairs)
