"""Predicates shared by reports, proposals and the queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tagledger import capability, constants as C


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def carries_key(keys: Sequence[str], column: str = "tag_keys") -> Column:
    """Does this row's key array hold any chosen key (any key at all when none
    are chosen)? A null array holds nothing. A group of rows misses all keys
    when no row carries one, so a boolean maximum of this replaces the union of
    the arrays and nothing is ever collected."""
    keys = list(keys)
    held = F.arrays_overlap(F.col(column), _array(keys)) if keys else F.size(column) > 0
    return F.coalesce(held, F.lit(False))


def untagged(keys: Sequence[str], column: str = "tag_keys") -> Column:
    """A single row misses all chosen keys."""
    return ~carries_key(keys, column)


def taggable(product: str = "product", serverless: str = "is_serverless") -> Column:
    """Not governed by a policy, and not serverless SQL."""
    governed = F.col(product).isin(*capability.policy_governed_products())
    return ~governed & ~((F.col(product) == "SQL") & (F.col(serverless) == 1))


def not_taggable_reason(product: str = "product", serverless: str = "is_serverless") -> Column:
    """POLICY_GOVERNED, UI_ONLY, TAGGABLE or NO_API."""
    p, s = F.col(product), F.col(serverless)
    return (
        F.when(p.isin(*capability.policy_governed_products()), C.POLICY_GOVERNED)
        .when(p == "SQL", F.when(s == 1, C.POLICY_GOVERNED).when(s == 0, C.TAGGABLE)
              .otherwise(C.NO_API))
        .when(p.isin(*capability.ui_only_products()), C.UI_ONLY)
        .when(p.isin(*capability.always_taggable_products()), C.TAGGABLE)
        .otherwise(C.NO_API)
    )


def confidence_floor(cutoff: float) -> float:
    """Confidences come in steps of 0.1; half a step below the cutoff takes in
    the rows stored at the cutoff whatever their last binary digit."""
    return float(cutoff) - C.CONFIDENCE_SLACK


def confident(cutoff: float, value: str = "suggested_cost_center",
              confidence: str = "confidence") -> Column:
    """A real suggestion (not null, not "unknown") at or above the cutoff."""
    return (
        F.col(value).isNotNull()
        & (F.lower(value) != "unknown")
        & (F.col(confidence) >= F.lit(confidence_floor(cutoff)))
    )


def is_resource() -> Column:
    """False for the rows that stand for a failed listing; their own column says so,
    whatever the id looks like."""
    return ~F.coalesce(F.col("listing_failed"), F.lit(False))
