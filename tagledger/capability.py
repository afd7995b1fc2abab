"""What each billing product supports, as one small fixed dimension."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagledger.constants import BUDGET_POLICY, DIRECT, EXCEPTION_QUEUE, UI_ONLY


@dataclass(frozen=True)
class Capability:
    product: str
    label: str
    read_path: str
    write_path: str
    tag_method: str
    direct_tag: bool
    create_time_only: bool
    policy_driven: bool
    ui_only: bool
    rollback: bool
    fallback: str
    reason: str = ""
    serverless_differs: bool = False
    resource: str = ""      # what carries the tags, where there is one such thing
    id_field: str = ""      # the field of usage_metadata that names it
    note: str = ""          # what to know before a serverless one is tagged


def _direct(product: str, resource: str, id_field: str = "", *, reason: str = "", note: str = "",
            readable: bool = True, serverless_differs: bool = False) -> Capability:
    return Capability(
        product, f"{resource[0].upper()}{resource[1:]} usage",
        read_path=f"listed with the {resource}" if readable else "",
        write_path=f"write the tags of the {resource}", tag_method=product,
        direct_tag=True, create_time_only=False, policy_driven=False, ui_only=False,
        rollback=readable, fallback=DIRECT, reason=reason, serverless_differs=serverless_differs,
        resource=resource, id_field=id_field, note=note)


def _indirect(product: str, resource: str, fallback: str, reason: str, id_field: str = "") -> Capability:
    ui = fallback == UI_ONLY
    return Capability(
        product, f"{resource[0].upper()}{resource[1:]} usage",
        read_path="listed with its clusters" if ui else "", write_path="", tag_method="",
        direct_tag=False, create_time_only=False, policy_driven=not ui, ui_only=ui,
        rollback=False, fallback=fallback, reason=reason, resource=resource, id_field=id_field)


# Product codes, flags, remedies and id fields. Texts are our own.
CAPABILITIES = (
    _direct("ALL_PURPOSE", "cluster", "cluster_id"),
    _indirect("AI_GATEWAY", "model gateway", BUDGET_POLICY, "Only a budget policy reaches gateway spend."),
    _indirect("APPS", "app", BUDGET_POLICY, "Only a budget policy reaches app spend.", "app_id"),
    _direct("DATABASE", "database warehouse"),
    _indirect("DLT", "pipeline", UI_ONLY, "Its tags belong to the pipeline's own settings.", "dlt_pipeline_id"),
    _indirect("INTERACTIVE", "shared session", EXCEPTION_QUEUE,
              "Nothing here carries tags by itself; a person decides.", "cluster_id"),
    _direct("JOBS", "job", "job_id"),
    _direct("LAKEBASE", "database instance", "database_instance_id",
            note="Check who owns the instance before tagging it."),
    _indirect("LAKEFLOW_CONNECT", "ingestion connector", BUDGET_POLICY,
              "Only a budget policy reaches connector spend."),
    _direct("MODEL_SERVING", "serving endpoint", "endpoint_id",
            note="Earlier usage of the endpoint keeps its old tags."),
    _direct("POOL", "instance pool", "instance_pool_id",
            reason="Never billed by itself: jobs and clusters that use the pool are.",
            note="Clusters take over the pool's tags when they next start."),
    _direct("SQL", "warehouse", "warehouse_id", serverless_differs=True,
            reason="A serverless warehouse follows its budget policy, whatever its tags say."),
    _direct("VECTOR_SEARCH", "search endpoint", "endpoint_id", readable=False,
            reason="Its tags can be written but not read, so what they were is unknown."),
)

BY_PRODUCT = {c.product: c for c in CAPABILITIES}
COLUMNS = tuple(f.name for f in fields(Capability))


def capability_matrix(spark: SparkSession) -> DataFrame:
    """One row per product, thirteen in all, so broadcasting it is always safe."""
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(COLUMNS, astuple(c))]) for c in CAPABILITIES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def direct_tag_products() -> tuple[str, ...]:
    return tuple(c.product for c in CAPABILITIES if c.direct_tag)


def always_taggable_products() -> tuple[str, ...]:
    """Direct tag whatever the serverless flag says."""
    return tuple(c.product for c in CAPABILITIES
                 if c.direct_tag and not c.ui_only and not c.serverless_differs)


def policy_governed_products() -> tuple[str, ...]:
    return tuple(c.product for c in CAPABILITIES if c.policy_driven and not c.serverless_differs)


def ui_only_products() -> tuple[str, ...]:
    return tuple(c.product for c in CAPABILITIES if c.ui_only)


def serverless_dependent_products() -> tuple[str, ...]:
    return tuple(c.product for c in CAPABILITIES if c.serverless_differs)


def policy_reasons() -> dict[str, str]:
    """Explanation per governed product, and for the serverless case of SQL."""
    named = policy_governed_products() + serverless_dependent_products()
    return {p: BY_PRODUCT[p].reason for p in named}
