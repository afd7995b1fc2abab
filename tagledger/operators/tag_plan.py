"""Can this workload take a direct tag, and how? One answer per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagledger import capability


def tag_plan(requests: DataFrame) -> DataFrame:
    """Add resource_type, id_kind, call_hint, supported and warning to rows with
    product and is_serverless, from the capability dimension. A product without an id
    field cannot be planned; one without a direct tag, and a serverless one that
    differs, is refused with its reason."""
    can = capability.capability_matrix(requests.sparkSession).select(
        "product", F.struct("*").alias("_can"))
    rows = requests.join(F.broadcast(can), "product", "left")
    can, serverless = F.col("_can"), F.coalesce(F.col("is_serverless").cast("int") == 1, F.lit(False))
    planned = F.coalesce(can["id_field"] != "", F.lit(False))
    refused = ~can["direct_tag"] | (can["serverless_differs"] & serverless)
    refusal = F.when(~planned, F.concat(F.lit("nothing to tag is known for product "), F.coalesce("product", F.lit("(none)")))) \
        .when(refused, can["reason"])
    note = F.when(serverless & (can["note"] != ""), can["note"])
    return rows.withColumns({
        "resource_type": F.when(planned, can["resource"]).otherwise("unknown"),
        "id_kind": F.when(planned, can["id_field"]),
        "call_hint": F.when(planned, F.coalesce(F.nullif(can["write_path"], F.lit("")), can["fallback"])),
        "supported": refusal.isNull(),
        "warning": F.coalesce(refusal, note),
    }).drop("_can")
