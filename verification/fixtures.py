"""The engine's input tables, derived from the given Parquet tables.

Each function reads whole tables; nothing is sampled. ``pk`` is a part key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagledger.schemas import QUANTITY, QUEUE_MONEY, RATE, conform

AS_OF = dt.date(2024, 4, 29)
NOW = dt.datetime(2024, 4, 29, 12, 0, 0)

PRODUCTS = (
    "JOBS", "ALL_PURPOSE", "SQL", "DATABASE", "MODEL_SERVING", "LAKEBASE", "VECTOR_SEARCH",
    "DLT", "APPS", "AI_GATEWAY", "INTERACTIVE", "LAKEFLOW_CONNECT", "AGENT_BRICKS",
)
STATUSES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "UNSUPPORTED", "SKIPPED_DRYRUN", "ROLLED_BACK")
LISTED = {"JOBS": "JOBS", "ALL_PURPOSE": "ALL_PURPOSE", "SQL": "SQL", "MODEL_SERVING": "MODEL_SERVING",
          "DLT": "DLT", "AGENT_BRICKS": "POOL", "DATABASE": "DATABASE", "LAKEBASE": "LAKEBASE",
          "VECTOR_SEARCH": "VECTOR_SEARCH"}
HOSTILE = "Zoë's 5%_off\\--;"
TEAM_WORDS = {
    "growth": ("promo", "campaign"),
    "accounts": ("economy", "ledger"),
    "core": ("standard", "infra"),
}
RULES = (
    {"field": "owner", "op": "contains", "value": "ECO", "tags": {"cost_center": "data-eng", "team": "de"}},
    {"field": "product", "op": "equals", "value": "jobs", "tags": {"cost_center": "platform"}},
    {"field": "name", "op": "matches", "value": "*ring-brand#1?", "tags": {"cost_center": "marketing"}},
    {"field": "name", "op": "contains", "value": "d_r", "tags": {"cost_center": "never"}},
    {"field": "name", "op": "equals", "value": HOSTILE.upper(), "tags": {"cost_center": "odd"}},
    {"field": "workspace", "op": "equals", "value": "", "tags": {"cost_center": "incomplete"}},
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)


def product(pk: Column) -> Column:
    return _pick(PRODUCTS, pk % 13)


def workload_id(pk: Column) -> Column:
    half = F.shiftright(pk, 1).cast("string")
    return F.when(pk % 97 == 0, None).when(pk % 26 == 0, F.concat(F.lit("w"), half)).otherwise(half)


def workspace(pk: Column) -> Column:
    return (pk % 14).cast("string")


def _part_name() -> Column:
    return F.concat_ws("-", "p_name", "p_brand")


def _owner() -> Column:
    return F.concat(F.lower("p_type"), F.lit("@corp.example"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    pk, wid = F.col("l_partkey"), F.col("wid")
    name = F.when(pk % 10 >= 3, F.when(pk % 53 == 4, HOSTILE).otherwise(_part_name()))
    owner = F.when(pk % 25 >= 7, _owner())

    def only(*products: str):
        return lambda value: F.when(F.col("product").isin(*products), value)

    clusters = ("ALL_PURPOSE", "AI_GATEWAY", "INTERACTIVE", "LAKEFLOW_CONNECT", "AGENT_BRICKS")
    job_cluster = F.when(wid.isNotNull(), F.concat(F.lit("c"), pk.cast("string")))
    meta = {
        "job_id": only("JOBS")(wid),
        "warehouse_id": only("SQL", "DATABASE")(wid),
        "dlt_pipeline_id": only("DLT")(wid),
        "endpoint_id": only("MODEL_SERVING")(wid),
        "app_id": only("APPS")(wid),
        "index_id": only("VECTOR_SEARCH")(wid),
        "database_instance_id": only("LAKEBASE")(wid),
        "cluster_id": F.coalesce(only(*clusters)(wid), only("JOBS")(job_cluster)),
        "job_name": only("JOBS")(name),
        "endpoint_name": only("MODEL_SERVING", "VECTOR_SEARCH")(name),
        "app_name": only("APPS")(name),
        "run_name": F.when(~F.col("product").isin("JOBS", "MODEL_SERVING", "VECTOR_SEARCH", "APPS"), name),
    }
    identity = {
        "owned_by": F.when(pk % 3 == 0, owner),
        "run_as": F.when(pk % 3 < 2, F.when(pk % 3 == 0, F.lit("someone-else")).otherwise(owner)),
        "created_by": owner,
    }
    identity["run_as"] = F.when(owner.isNotNull(), identity["run_as"])
    tags = F.map_filter(
        F.create_map(
            F.lit("cost_center"), F.when((pk % 5 == 0) & (F.col("l_returnflag") == "A"), "cc"),
            F.lit("team"), F.when(pk % 7 == 0, "team"),
        ), lambda _, v: v.isNotNull())
    rows = line.join(part, pk == F.col("p_partkey")).withColumns(
        {"product": product(pk), "wid": workload_id(pk)})
    return conform(rows.select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("l_orderkey") % 120).cast("int")).alias("usage_date"),
        workspace(pk).alias("workspace_id"),
        F.col("product").alias("billing_origin_product"),
        F.struct(*[c.cast("string").alias(n) for n, c in meta.items()]).alias("usage_metadata"),
        F.struct(*[c.cast("string").alias(n) for n, c in identity.items()]).alias("identity_metadata"),
        F.struct((pk % 3 == 0).alias("is_serverless")).alias("product_features"),
        F.col("p_brand").alias("sku_name"),
        F.col("l_quantity").cast(QUANTITY).alias("usage_quantity"),
        F.when(F.col("l_linenumber") == 7, "GB").otherwise("DBU").alias("usage_unit"),
        F.when((F.size(tags) > 0) | (pk % 11 != 0), tags).alias("custom_tags"),
    ), "usage")


def list_prices(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring("p_brand", 7, 10).cast("int")
    brands = table(spark, sf, "part").select("p_brand").distinct().select(
        "p_brand", number.alias("n"))
    opened = F.lit(dt.datetime(2024, 1, 1))
    closed = F.lit(dt.datetime(2023, 1, 1))
    current = brands.filter("n <> 13").select(
        "p_brand", (F.col("n") / 100).cast(RATE).alias("rate"), opened.alias("price_start_time"),
        F.lit(None).cast("timestamp").alias("price_end_time"))
    past = brands.filter("n % 2 = 0").select(
        "p_brand", F.lit(9).cast(RATE).alias("rate"), closed.alias("price_start_time"),
        opened.alias("price_end_time"))
    return conform(current.unionByName(past).select(
        F.col("p_brand").alias("sku_name"), F.struct(F.col("rate").alias("default")).alias("pricing"),
        "price_start_time", "price_end_time"), "list_prices")


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    pk = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        product(pk).alias("product"), workload_id(pk).alias("workload_id"),
        _part_name().alias("workload_name"), _owner().alias("owner"),
        workspace(pk).alias("workspace_id"), F.col("p_retailprice").alias("list_cost"),
        F.when(F.col("p_type") == "ECONOMY", "unknown").when(F.col("p_size") % 9 == 0, None)
        .otherwise(F.lower("p_type")).alias("suggested_cost_center"),
        ((F.col("p_size") % 10) / 10).alias("confidence"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("rationale"),
        F.lit(NOW).alias("annotated_at"),
    )
    return conform(rows.filter("workload_id IS NOT NULL"), "suggestions")


def tagged_workloads(spark: SparkSession, sf: str) -> DataFrame:
    """A tagged workload per part: its team follows from its type or, for types that name none, from its brand;
    one in eleven is of another team."""
    pk, brand = F.col("p_partkey"), F.substring("p_brand", 7, 10).cast("int")
    teams = tuple(TEAM_WORDS)
    team = (F.when(F.col("p_type") == "PROMO", "growth").when(F.col("p_type") == "ECONOMY", "accounts")
            .when(F.col("p_type") == "STANDARD", "core").otherwise(_pick(teams, brand % 3)))
    return table(spark, sf, "part").select(
        product(pk).alias("product"), F.concat(F.lit("t"), pk.cast("string")).alias("workload_id"), workspace(pk).alias("workspace_id"),
        F.when(pk % 9 != 4, _part_name()).alias("workload_name"), F.when(pk % 7 != 3, _owner()).alias("owner"),
        F.when(pk % 11 == 0, _pick(teams, pk % 3)).otherwise(team).alias("team"))


def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Three rules per part, later parts first, some without tags; the first parts' match by length or two letters."""
    pk = F.col("p_partkey")
    tags = F.when(pk % 31 != 5, F.create_map(F.lit("cost_center"), F.concat(F.lit("cc-"), (pk % 5).cast("string")),
                                             F.lit("team"), F.lit("t"))).otherwise(F.create_map().cast("map<string,string>"))
    number = F.substring("p_brand", 7, 10)

    def rule(place: int, op: str, field: Column, value: Column) -> Column:
        return F.struct((F.lit(10_000_000) - 3 * pk - place).cast("int").alias("rule_idx"), field.alias("field"),
                        F.lit(op).alias("op"), value.alias("value"))

    wild = F.when(pk == 1, "????????????*").when(pk == 2, "?").otherwise(
        F.concat(F.lit("*"), F.upper(F.substring("p_name", 2, 5)), F.lit("?*#"), number))
    rules = F.array(
        rule(0, "matches", F.when(pk == 2, "workspace").otherwise("name"), wild),
        rule(1, "contains", F.lit("name"), F.when(pk == 3, "w5").otherwise(F.concat(F.lit("C"), (pk * 7).cast("string")))),
        rule(2, "equals", F.lit("name"), F.concat("p_name", F.lit("-"), F.upper("p_brand"))))
    return table(spark, sf, "part").select(F.inline(rules), tags.alias("tags"))


def queue(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("o_orderkey")
    pk = (ok % 2000) * 4 + 1
    batch = F.floor(ok / 2000).cast("bigint")
    status = _pick(STATUSES, ok % 7)
    minutes = (ok % 60).cast("int")
    number = ok.cast("string")
    error = F.when(F.col("status") == "FAILED", F.when(
        ok % 3 == 0, F.concat(F.lit("PermissionDenied: job "), number)).when(
        ok % 3 == 1, F.concat(F.lit("ResourceDoesNotExist: "), number)).otherwise(""))
    rows = table(spark, sf, "orders").filter(workload_id(pk).isNotNull()).withColumn("status", status)
    return conform(rows.select(
        F.concat(F.lit("batch-"), batch.cast("string")).alias("batch_id"),
        F.col("o_orderdate").cast("timestamp").alias("enqueued_at"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 7).cast("string")).alias("requested_by"),
        workspace(pk).alias("workspace_id"), product(pk).alias("product"),
        workload_id(pk).alias("workload_id"),
        F.concat(F.lit("name-"), pk.cast("string")).alias("workload_name"),
        (pk % 3 == 0).cast("int").alias("is_serverless"),
        F.when(ok % 5 == 0, "team").otherwise("cost_center").alias("tag_key"),
        F.concat(F.lit("cc-"), ((batch + pk) % 3).cast("string")).alias("tag_value"),
        F.when(ok % 41 != 0, F.col("o_totalprice").cast(QUEUE_MONEY)).alias("list_cost"),
        "status",
        (F.col("status") != "PENDING").cast("int").alias("attempts"),
        error.alias("last_error"),
        F.when(F.col("status") == "RUNNING", F.lit(NOW) - F.make_dt_interval(mins=minutes))
        .when(F.col("status") != "PENDING", F.lit(NOW - dt.timedelta(days=1))).alias("executed_at"),
    ), "write_queue")


def tag_state(spark: SparkSession, sf: str) -> DataFrame:
    pk = F.col("p_partkey")
    value = F.concat(F.lit("cc-"), (pk % 3).cast("string"))
    tags = F.map_filter(F.create_map(
        F.lit("env"), F.when(pk % 8 != 0, "prod"),
        F.lit("cost_center"), F.when((pk % 5 != 0) & (pk % 3 != 2), value),
        F.lit("team"), F.when(pk % 10 == 0, value),
    ), lambda _, v: v.isNotNull())
    there = (F.col("p_size") > 2) & workload_id(pk).isNotNull()
    rows = table(spark, sf, "part").filter(there).select(
        workspace(pk).alias("workspace_id"), product(pk).alias("product"),
        workload_id(pk).alias("workload_id"), tags.alias("tags"))
    return conform(rows, "tag_state")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    ok, sk, ln = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    pk = F.col("l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rows = table(spark, sf, "lineitem").filter(workload_id(pk).isNotNull())
    return conform(rows.select(
        F.concat_ws("-", ok, ln, F.col("l_partkey"), sk, cents).alias("audit_id"),
        F.concat(F.lit("batch-"), F.floor(ok / 2000).cast("bigint").cast("string")).alias("batch_id"),
        F.col("l_shipdate").cast("timestamp").alias("executed_at"),
        F.lit("writer").alias("executed_by"),
        workspace(pk).alias("workspace_id"), product(pk).alias("product"),
        workload_id(pk).alias("workload_id"),
        F.when(pk % 5 == 0, "team").otherwise("cost_center").alias("tag_key"),
        F.when(sk % 3 != 0, F.concat(F.lit("old-"), (sk % 5).cast("string"))).alias("old_value"),
        F.concat(F.lit("cc-"), (ok % 4).cast("string")).alias("new_value"),
        F.when(ln == 6, "ROLLBACK").otherwise("SET").alias("action"),
        F.when(ln == 5, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(ln == 5, "PermissionDenied: no access").alias("error"),
    ), "audit")


OLD_SCAN = ("scan-f00", dt.datetime(2024, 4, 22, 6, 0, 0))
NEW_SCAN = ("scan-a11", dt.datetime(2024, 4, 29, 6, 0, 0))


def listings(spark: SparkSession, sf: str, scan: tuple = NEW_SCAN) -> dict[str, DataFrame]:
    """Raw listings per product, tags in the shape that product reports."""
    pk = F.col("p_partkey")
    new = scan == NEW_SCAN
    env, dev = F.when(pk % 4 != 0, "prod"), F.when(pk % 6 == 1, "dev")
    cost = F.when(pk % (5 if new else 10) == 0, F.concat(F.lit("cc-"), (pk % 3).cast("string")))

    def entry(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))

    def known(*entries: Column) -> Column:
        return F.filter(F.array(*entries), lambda e: e.isNotNull())

    def tag_map(**values: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    shapes = {
        "map": tag_map(env=F.coalesce(dev, env), cost_center=cost),
        "pairs": known(entry("env", env), entry("cost_center", cost), entry("env", dev)),
        "maps": F.array(tag_map(env=env, cost_center=cost), tag_map(env=dev)),
        "none": F.lit(None).cast("string"),
    }
    from tagledger.operators.inventory import LISTING_SHAPES

    part = table(spark, sf, "part").filter(workload_id(pk).isNotNull())
    if new:
        part = part.filter("p_size <> 7")  # deleted since the older scan
    found = {}
    for code, name in LISTED.items():
        rows = part.filter(product(pk) == code).select(
            workspace(pk).alias("workspace_id"), workload_id(pk).alias("workload_id"),
            _part_name().alias("workload_name"), _owner().alias("owner"),
            shapes[LISTING_SHAPES[name]].alias("tags"),
            F.when(pk % 11 == 0, F.concat(F.lit("PermissionDenied: "), pk.cast("string")))
            .alias("read_error"),
            _pick(("UI", "API", "JOB"), F.floor(pk / 13) % 3).alias("cluster_source"))
        found[name] = rows if name == "ALL_PURPOSE" else rows.drop("cluster_source")
    return found


def listing_errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        _text("n_nationkey").alias("workspace_id"),
        F.when(F.col("n_regionkey") % 2 == 0, "SQL").alias("product"), F.lit("timeout").alias("error"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    from tagledger.operators.inventory import inventory_sweep

    older = inventory_sweep(listings(spark, sf, OLD_SCAN), *OLD_SCAN)
    newer = inventory_sweep(listings(spark, sf), *NEW_SCAN, errors=listing_errors(spark, sf))
    return conform(older.unionByName(newer), "inventory")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Tag requests and reviewed selections: one per part."""
    pk = F.col("p_partkey")
    return table(spark, sf, "part").select(
        workspace(pk).alias("workspace_id"), product(pk).alias("product"),
        workload_id(pk).alias("workload_id"),
        F.when(pk % 4 != 0, _part_name()).alias("workload_name"),
        (pk % 3 == 0).cast("int").alias("is_serverless"),
        F.when(pk % 9 == 0, "").otherwise(F.lower("p_type")).alias("tag_value"),
        F.create_map(F.lit("cost_center"), F.lower("p_type"), F.lit("team"),
                     F.concat(F.lit("t"), (pk % 3).cast("string"))).alias("tags"),
        F.when(pk % 10 != 0, F.col("p_retailprice").cast(QUEUE_MONEY)).alias("list_cost"),
    ).withColumn("cost", F.col("list_cost"))


def tag_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A tag map per document, some within the limits and some not."""
    doc = F.col("doc_id")
    key = (
        F.when(doc % 7 == 0, F.concat(F.lit("AWS:"), "source"))
        .when(doc % 7 == 1, F.repeat(F.lit("k"), F.lit(128)))
        .when(doc % 7 == 2, "").otherwise(F.col("lang"))
    )
    tags = F.create_map(key, F.col("text"), F.concat(F.lit("src-"), "source"),
                        F.when(doc % 5 != 0, F.col("lang")))
    many = F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: F.concat(F.lit("k"), i.cast("string"))),
        F.array_repeat(F.col("lang"), 21))
    return table(spark, sf, "documents").select(
        "doc_id", F.when(doc % 11 == 0, F.create_map().cast("map<string,string>"))
        .when(doc % 11 == 1, many).otherwise(tags).alias("tags"))
