"""Actual tag state: raw listings -> inventory rows, and reports on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tagledger import capability, constants as C
from tagledger.functions.predicates import is_resource
from tagledger.functions.tagmaps import no_tags, tags_from_maps, tags_from_pairs
from tagledger.schemas import INVENTORY

# Shape of ``tags`` in each product's raw listing.
LISTING_SHAPES = {
    "JOBS": "map",
    "ALL_PURPOSE": "map",
    "POOL": "map",
    "SQL": "pairs",
    "MODEL_SERVING": "pairs",
    "DLT": "maps",
    "DATABASE": "pairs",
    "LAKEBASE": "pairs",
    "VECTOR_SEARCH": "none",
}
# Product shown for a workspace that was out of reach as a whole.
UNREACHABLE_PRODUCT = "__workspace__"
UNREADABLE = "tags of this product cannot be read"


def _tags(shape: str) -> Column:
    tags = F.col("tags")
    built = {"map": lambda: tags, "pairs": lambda: tags_from_pairs(tags),
             "maps": lambda: tags_from_maps(tags), "none": no_tags}[shape]()
    return F.coalesce(built, no_tags())


def normalise_listing(listing: DataFrame, product: str) -> DataFrame:
    """One product's raw listing (workspace_id, workload_id, workload_name,
    owner, tags, read_error) with tags as one map. A listing with
    ``cluster_source`` keeps only clusters that people or the API started. Where a product
    does not show its tags, its resources are known and their tags are not."""
    if "cluster_source" in listing.columns:
        listing = listing.filter(F.col("cluster_source").isin(*C.INTERACTIVE_CLUSTER_SOURCES))
    shape = LISTING_SHAPES[product]
    if shape == "none":
        listing = listing.withColumn("read_error", F.coalesce("read_error", F.lit(UNREADABLE)))
    failed = F.col("read_error").isNotNull()
    return listing.select(
        "workspace_id", F.lit(product).alias("product"), "workload_id", "workload_name", "owner",
        F.when(failed, no_tags()).otherwise(_tags(shape)).alias("tags"),
        (~failed).alias("tag_read_ok"), "read_error", F.lit(False).alias("listing_failed"),
    )


def failed_listings(errors: DataFrame) -> DataFrame:
    """A marker row per listing that failed (workspace_id, product, error); a
    null product means that the whole workspace was out of reach."""
    whole = F.col("product").isNull()
    return errors.select(
        "workspace_id",
        F.coalesce("product", F.lit(UNREACHABLE_PRODUCT)).alias("product"),
        F.when(whole, F.concat(F.lit("__unreachable__"), "workspace_id"))
        .otherwise(F.concat(F.lit("__list_error__"), "product")).alias("workload_id"),
        F.lit(None).cast("string").alias("workload_name"),
        F.lit(None).cast("string").alias("owner"),
        no_tags().alias("tags"), F.lit(False).alias("tag_read_ok"),
        F.concat(F.when(whole, "workspace unreachable: ").otherwise("list failed: "), "error")
        .alias("read_error"), F.lit(True).alias("listing_failed"),
    )


def inventory_sweep(listings: Mapping[str, DataFrame], scan_id: str, scanned_at: dt.datetime,
                    errors: DataFrame | None = None) -> DataFrame:
    """Inventory rows of one scan over all listings. A read that failed has no
    known tags, which is not the same as being untagged."""
    parts = [normalise_listing(frame, product) for product, frame in listings.items()]
    if errors is not None:
        parts.append(failed_listings(errors))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    can = capability.capability_matrix(union.sparkSession).select("product", "direct_tag", "fallback")
    return union.join(F.broadcast(can), "product", "left").withColumns({
        "scan_id": F.lit(scan_id),
        "scanned_at": F.lit(scanned_at),
        "tag_keys": F.sort_array(F.map_keys("tags")),
        "tag_count": F.size("tags"),
        "direct_tag": F.coalesce("direct_tag", F.lit(False)),
        "raw_state": F.lit(None).cast("string"),
    }).select(*INVENTORY.fieldNames())


def sweep_counts(sweep: DataFrame) -> DataFrame:
    """Rows and untagged resources per product of one sweep."""
    return sweep.groupBy("product").agg(
        F.count(F.lit(1)).alias("resources"),
        F.count_if(F.col("tag_read_ok") & (F.col("tag_count") == 0)).alias("untagged"))


def latest_scan(inventory: DataFrame, by: str = "time") -> DataFrame:
    """Rows of the latest scan: the last one made, or with ``by="id"`` the one
    whose id sorts last. The scan id is a scalar subquery: one value, which the
    scan of the table uses as a filter."""
    newest = {
        "time": F.max(F.struct("scanned_at", "scan_id"))["scan_id"],
        "id": F.max("scan_id"),
    }[by]
    return inventory.filter(F.col("scan_id") == inventory.agg(newest.alias("s")).scalar())


def inventory_summary(inventory: DataFrame, by: str = "time") -> DataFrame:
    """Per product of the latest scan: resources, untagged (read and without
    tags), tagged, unreadable."""
    return (
        latest_scan(inventory, by).filter(is_resource())
        .groupBy("product")
        .agg(
            F.count(F.lit(1)).alias("resources"),
            F.count_if(F.col("tag_read_ok") & (F.col("tag_count") == 0)).alias("untagged"),
            F.count_if(F.col("tag_count") > 0).alias("tagged"),
            F.count_if(~F.col("tag_read_ok")).alias("read_failed"),
            F.max("fallback").alias("fallback"),
        )
        .orderBy(F.desc("resources"), "product")
    )


def inventory_meta(inventory: DataFrame, by: str = "time") -> DataFrame:
    """Id, time and row count of the latest scan, marker rows included."""
    return latest_scan(inventory, by).groupBy("scan_id").agg(
        F.max("scanned_at").alias("scanned_at"), F.count(F.lit(1)).alias("resources"))


def inventory_report(inventory: DataFrame, by: str = "time") -> DataFrame:
    """The meta row (product ``__meta__``) and the product rows in one frame."""
    meta = inventory_meta(inventory, by).withColumn("product", F.lit("__meta__"))
    return meta.unionByName(inventory_summary(inventory, by), allowMissingColumns=True)


def coverage(summary: DataFrame) -> DataFrame:
    """Share of tagged resources per product of ``inventory_summary``."""
    share = F.round(F.lit(100) * F.col("tagged") / F.nullif("resources", F.lit(0)), 0)
    return summary.withColumn("coverage_pct", F.coalesce(share, F.lit(0)).cast("int"))


def coverage_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("resources").alias("resources"), F.sum("untagged").alias("untagged"))


def state_of(scan: DataFrame) -> DataFrame:
    """What one scan says of the state that changes apply to: a row per resource, with
    its tags or why they are unknown, and a row per listing that failed. A resource that is listed
    twice counts once."""
    unreachable = F.col("product") == UNREACHABLE_PRODUCT
    known = F.struct(F.when(F.col("tag_read_ok"), F.col("tags")).alias("tags"), F.col("read_error").alias("problem"))
    rows = scan.select(
        "workspace_id", F.when(~unreachable | is_resource(), F.col("product")).alias("product"),
        F.when(is_resource(), F.col("workload_id")).alias("workload_id"), known.alias("known"))
    order = F.struct(F.col("known.problem").isNull(), F.coalesce(F.to_json("known.tags"), F.lit("")))
    return rows.groupBy("workspace_id", "product", "workload_id").agg(F.max_by("known", order).alias("known")).select(
        "workspace_id", "product", "workload_id", "known.tags", "known.problem")


def tag_state(inventory: DataFrame, by: str = "time") -> DataFrame:
    """The state that the latest scan alone shows."""
    return state_of(latest_scan(inventory, by))
