"""Identity of a usage record: which workload, what it is called, who owns it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagledger.constants import OWNER_FIELDS, WORKLOAD_ID_FIELDS, WORKLOAD_NAME_FIELDS


def _first_of(struct: str, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(struct)[f] for f in fields])


def workload_id() -> Column:
    return _first_of("usage_metadata", WORKLOAD_ID_FIELDS)


def workload_name() -> Column:
    return _first_of("usage_metadata", WORKLOAD_NAME_FIELDS)


def owner() -> Column:
    return _first_of("identity_metadata", OWNER_FIELDS)


def tag_keys(tags: str = "custom_tags") -> Column:
    """Sorted keys of a tag map; null map gives null. Sorting makes equal key
    sets equal as grouping keys."""
    return F.sort_array(F.map_keys(F.col(tags)))


def days_since(date: Column, as_of) -> Column:
    return F.datediff(F.lit(as_of), date)
