"""The registered queries as DuckDB SQL on the given tables.

Written apart from the operators: untagged is a maximum of CASE flags instead
of array logic, histories are window functions, tag maps are rows.
"""

from __future__ import annotations

RESERVED = "(starts_with(lower(k), 'aws:') OR starts_with(lower(k), 'databricks'))"
HOSTILE = "'Zoë''s 5%_off\\--;'"
PRODUCTS = ("['JOBS','ALL_PURPOSE','SQL','DATABASE','MODEL_SERVING','LAKEBASE','VECTOR_SEARCH',"
            "'DLT','APPS','AI_GATEWAY','INTERACTIVE','LAKEFLOW_CONNECT','AGENT_BRICKS']")
STATUSES = "['PENDING','RUNNING','SUCCEEDED','FAILED','UNSUPPORTED','SKIPPED_DRYRUN','ROLLED_BACK']"
AS_OF = "DATE '2024-04-29'"
NOW = "TIMESTAMP '2024-04-29 12:00:00'"
GOVERNED = "('APPS','AI_GATEWAY','INTERACTIVE','LAKEFLOW_CONNECT')"
DIRECT = "('JOBS','ALL_PURPOSE','POOL','SQL','DATABASE','MODEL_SERVING','LAKEBASE','VECTOR_SEARCH')"
HANDLED = "('SUCCEEDED','PENDING','RUNNING','UNSUPPORTED','FAILED')"


def product(pk: str) -> str:
    return f"({PRODUCTS})[CAST({pk} % 13 AS INTEGER) + 1]"


def wid(pk: str) -> str:
    return (f"CASE WHEN {pk} % 97 = 0 THEN NULL WHEN {pk} % 26 = 0 "
            f"THEN 'w' || ({pk} // 2) ELSE CAST({pk} // 2 AS VARCHAR) END")


def ws(pk: str) -> str:
    return f"CAST({pk} % 14 AS VARCHAR)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def query(sql: str, *needs: str) -> str:
    """``sql`` with the CTEs it needs in front, each once and in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in done:
            done.append(name)

    for need in needs:
        add(need)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    return f"WITH {head}\n{sql}" if head else sql


cte("usage", f"""
  SELECT DATE '2024-01-01' + CAST(l_orderkey % 120 AS INTEGER) AS usage_date,
         {ws('l_partkey')} AS workspace_id, {product('l_partkey')} AS product,
         {wid('l_partkey')} AS workload_id,
         CASE WHEN l_partkey % 10 >= 3 THEN CASE WHEN l_partkey % 53 = 4 THEN {HOSTILE}
              ELSE p_name || '-' || p_brand END END AS given_name,
         CASE WHEN l_partkey % 25 >= 7 THEN lower(p_type) || '@corp.example' END AS owner,
         CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS is_serverless,
         p_brand AS sku_name, CAST(l_quantity AS DECIMAL(18,6)) AS dbus,
         CASE WHEN l_linenumber = 7 THEN 'GB' ELSE 'DBU' END AS unit,
         CASE WHEN l_partkey % 5 = 0 AND l_returnflag = 'A' THEN 1 ELSE 0 END AS cc,
         CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS team,
         l_partkey AS pk
  FROM lineitem JOIN part ON p_partkey = l_partkey""")
cte("records", f"""
  SELECT usage_date, workspace_id, product, workload_id,
         coalesce(given_name, CASE
           WHEN product = 'JOBS' THEN 'c' || pk
           WHEN product IN ('MODEL_SERVING','VECTOR_SEARCH','APPS') THEN NULL
           ELSE workload_id END) AS workload_name,
         owner, is_serverless, sku_name, dbus, cc, team, pk
  FROM usage
  WHERE usage_date >= {AS_OF} - 90 AND unit = 'DBU' AND workload_id IS NOT NULL""", "usage")
cte("price", """
  SELECT DISTINCT p_brand AS sku_name,
         CAST(CAST(substr(p_brand, 7) AS INTEGER) / 100.0 AS DECIMAL(10,4)) AS rate
  FROM part WHERE p_brand <> 'Brand#13'""")
cte("summary", """
  SELECT usage_date, workspace_id, product, workload_id, max(workload_name) AS workload_name,
         max(owner) AS owner, max(is_serverless) AS is_serverless, max(cc) AS cc, max(team) AS team,
         sum(dbus) AS dbus, sum(dbus * coalesce(rate, 0)) AS list_cost,
         sum(CASE WHEN rate IS NULL THEN dbus ELSE 0 END) AS unpriced_dbus
  FROM records LEFT JOIN price USING (sku_name)
  GROUP BY usage_date, workspace_id, product, workload_id""", "records", "price")


def rollup(days: int = 30, where: str = "") -> str:
    return f"""
  SELECT product, workload_id, max(workspace_id) AS workspace_id,
         max(workload_name) AS workload_name, max(owner) AS owner,
         max(is_serverless) AS is_serverless, max(usage_date) AS last_seen,
         max(cc) AS cc, max(team) AS team, sum(list_cost) AS cost
  FROM summary WHERE usage_date >= {AS_OF} - {days} {where}
  GROUP BY product, workload_id"""


cte("wl", rollup(), "summary")
cte("wl90", rollup(90), "summary")
cte("wl_ws", rollup(60, "AND workspace_id IN ('1','3','5')"), "summary")
cte("queue", f"""
  SELECT 'batch-' || (ok // 2000) AS batch_id, o_orderdate AS enqueued_at,
         'user-' || (o_custkey % 7) AS requested_by, {ws('pk')} AS workspace_id,
         {product('pk')} AS product, {wid('pk')} AS workload_id, 'name-' || pk AS workload_name,
         CASE WHEN pk % 3 = 0 THEN 1 ELSE 0 END AS is_serverless,
         CASE WHEN ok % 5 = 0 THEN 'team' ELSE 'cost_center' END AS tag_key,
         'cc-' || ((ok // 2000 + pk) % 3) AS tag_value,
         CASE WHEN ok % 41 <> 0 THEN CAST(o_totalprice AS DECIMAL(38,6)) END AS list_cost,
         status, CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END AS attempts,
         CASE WHEN status = 'FAILED' THEN CASE ok % 3 WHEN 0 THEN 'PermissionDenied: job ' || ok
           WHEN 1 THEN 'ResourceDoesNotExist: ' || ok ELSE '' END END AS last_error,
         CASE WHEN status = 'RUNNING' THEN {NOW} - to_minutes(CAST(ok % 60 AS INTEGER))
              WHEN status <> 'PENDING' THEN TIMESTAMP '2024-04-28 12:00:00' END AS executed_at
  FROM (SELECT *, o_orderkey AS ok, 4 * (o_orderkey % 2000) + 1 AS pk,
               ({STATUSES})[CAST(o_orderkey % 7 AS INTEGER) + 1] AS status
        FROM orders)
  WHERE {wid('pk')} IS NOT NULL""")
cte("handled", f"""
  SELECT DISTINCT product, workload_id FROM queue
  WHERE tag_key = 'cost_center' AND status IN {HANDLED}""", "queue")
cte("suggestions", f"""
  SELECT {product('p_partkey')} AS product, {wid('p_partkey')} AS workload_id,
         CASE WHEN p_type = 'ECONOMY' THEN 'unknown' WHEN p_size % 9 = 0 THEN NULL
              ELSE lower(p_type) END AS suggested_cost_center,
         CAST((p_size % 10) AS DOUBLE) / 10 AS confidence
  FROM part WHERE {wid('p_partkey')} IS NOT NULL""")

TAGGABLE = f"(product NOT IN {GOVERNED} AND NOT (product = 'SQL' AND is_serverless = 1))"
CONFIDENT = ("(suggested_cost_center IS NOT NULL AND lower(suggested_cost_center) <> 'unknown' "
             "AND confidence >= 0.75)")
cte("cand", f"""
  SELECT wl.*, suggested_cost_center, confidence
  FROM wl JOIN suggestions USING (product, workload_id)
  WHERE cc = 0 AND cost > 0 AND {CONFIDENT} AND {TAGGABLE}
    AND NOT EXISTS (SELECT 1 FROM handled h
                    WHERE h.product = wl.product AND h.workload_id = wl.workload_id)""",
    "wl", "suggestions", "handled")
FIRST_RULE = f"""CASE
    WHEN contains(lower(coalesce(owner, '')), 'eco') THEN 0
    WHEN lower(product) = 'jobs' THEN 1
    WHEN regexp_matches(lower(coalesce(workload_name, '')), '^.*ring-brand#1.$') THEN 2
    WHEN contains(lower(coalesce(workload_name, '')), 'd_r') THEN 3
    WHEN lower(coalesce(workload_name, '')) = lower({HOSTILE}) THEN 4
    ELSE -1 END"""
cte("ruled", f"""
  SELECT *, {FIRST_RULE} AS first_rule FROM wl WHERE cc = 0 AND cost > 0 AND {TAGGABLE}""", "wl")
cte("ruled_open", """
  SELECT * FROM ruled r WHERE NOT EXISTS (
    SELECT 1 FROM handled h WHERE h.product = r.product AND h.workload_id = r.workload_id)""",
    "ruled", "handled")
cte("rule_tags", """
  SELECT * FROM (VALUES (0, 'cost_center', 'data-eng'), (0, 'team', 'de'), (1, 'cost_center', 'platform'),
                        (2, 'cost_center', 'marketing'), (3, 'cost_center', 'never'),
                        (4, 'cost_center', 'odd')) AS t(rule_idx, tag_key, tag_value)""")
cte("rule_rows", """
  SELECT *, CAST(10000000 - 3 * p_partkey AS INTEGER) AS base, substr(p_brand, 7) AS number FROM part WHERE p_partkey % 31 <> 5""")
cte("many_rules", """
  SELECT base AS rule_idx, CASE WHEN p_partkey = 2 THEN 'workspace' ELSE 'name' END AS field, 'matches' AS op,
         CASE WHEN p_partkey = 1 THEN '????????????*' WHEN p_partkey = 2 THEN '?'
              ELSE '*' || upper(substr(p_name, 2, 5)) || '?*#' || number END AS value, p_partkey FROM rule_rows
  UNION ALL SELECT base - 1, 'name', 'contains', CASE WHEN p_partkey = 3 THEN 'w5' ELSE 'C' || (p_partkey * 7) END, p_partkey FROM rule_rows
  UNION ALL SELECT base - 2, 'name', 'equals', p_name || '-' || upper(p_brand), p_partkey FROM rule_rows""", "rule_rows")
cte("rule_texts", """
  SELECT DISTINCT 'name' AS field, lower(coalesce(workload_name, '')) AS text FROM wl
  UNION ALL SELECT DISTINCT 'workspace', workspace_id FROM wl""", "wl")
cte("first_rules", """
  SELECT t.field, t.text, min(rule_idx) AS rule_idx FROM rule_texts t JOIN many_rules r ON r.field = t.field AND CASE r.op
    WHEN 'equals' THEN t.text = lower(r.value) WHEN 'contains' THEN contains(t.text, lower(r.value))
    ELSE t.text LIKE replace(replace(lower(r.value), '*', '%'), '?', '_') END
  GROUP BY t.field, t.text""", "rule_texts", "many_rules")
cte("ruled_many", f"""
  SELECT w.*, coalesce(least(n.rule_idx, s.rule_idx), -1) AS first_rule FROM wl w
  LEFT JOIN first_rules n ON n.field = 'name' AND n.text = lower(coalesce(workload_name, ''))
  LEFT JOIN first_rules s ON s.field = 'workspace' AND s.text = workspace_id
  WHERE cc = 0 AND cost > 0 AND {TAGGABLE}""", "wl", "first_rules")
cte("ruled_many_open", """
  SELECT * FROM ruled_many r WHERE NOT EXISTS (
    SELECT 1 FROM handled h WHERE h.product = r.product AND h.workload_id = r.workload_id)""",
    "ruled_many", "handled")
cte("many_rule_tags", """
  SELECT rule_idx, tag_key, CASE tag_key WHEN 'team' THEN 't' ELSE 'cc-' || (p_partkey % 5) END AS tag_value
  FROM many_rules, (VALUES ('cost_center'), ('team')) AS k(tag_key)""", "many_rules")
cte("by_product", """
  SELECT product, round(sum(cost), 0) AS total_cost,
         round(sum(CASE WHEN cc = 0 THEN cost ELSE 0 END), 0) AS untagged_cost,
         round(sum(CASE WHEN cc = 1 THEN cost ELSE 0 END), 0) AS tagged_cost,
         round(100.0 * CAST(sum(CASE WHEN cc = 0 THEN cost ELSE 0 END) AS DOUBLE)
               / CAST(nullif(sum(cost), 0) AS DOUBLE), 1) AS pct_untagged
  FROM wl GROUP BY product HAVING round(sum(cost), 0) > 0""", "wl")


def kpi(untagged: str, source: str) -> str:
    return query(f"""
SELECT round(sum(cost), 0) AS total_cost,
       round(sum(CASE WHEN {untagged} THEN cost ELSE 0 END), 0) AS untagged_cost,
       round(100.0 * CAST(sum(CASE WHEN {untagged} THEN cost ELSE 0 END) AS DOUBLE)
             / CAST(nullif(sum(cost), 0) AS DOUBLE), 1) AS pct_untagged,
       count(DISTINCT CASE WHEN {untagged} THEN workload_id END) AS untagged_workloads
FROM {source}""", source)


def kpi_live(costs: str, credits: str) -> str:
    return query(f"""
SELECT total AS total_cost, remaining AS untagged_cost, greatest(0, n - workloads) AS untagged_workloads,
       coalesce(round(100.0 * CAST(remaining AS DOUBLE) / CAST(nullif(total, 0) AS DOUBLE), 1), 0) AS pct_untagged,
       credit AS tagged_live_cost, workloads AS tagged_live_workloads,
       coalesce(round(100.0 * CAST(credit AS DOUBLE) / CAST(nullif(credit + remaining, 0) AS DOUBLE), 1), 0)
         AS pct_tagged_live
FROM (SELECT k.*, l.workloads, coalesce(l.cost, 0) AS credit, greatest(0, missing - coalesce(l.cost, 0)) AS remaining
      FROM (SELECT round(sum(cost), 0) AS total, round(sum(CASE WHEN cc = 0 THEN cost ELSE 0 END), 0) AS missing,
                   count(DISTINCT CASE WHEN cc = 0 THEN workload_id END) AS n FROM {costs}) k, {credits} l)""",
                 costs, credits)


cte("live", """
  SELECT count(*) AS workloads, round(sum(c), 0) AS cost
  FROM (SELECT workload_id, max(list_cost) AS c FROM queue
        WHERE status = 'SUCCEEDED' AND tag_key = 'cost_center' GROUP BY workload_id)""", "queue")
cte("live_ws", """
  SELECT count(*) AS workloads, round(sum(c), 0) AS cost
  FROM (SELECT workload_id, max(list_cost) AS c FROM queue
        WHERE status = 'SUCCEEDED' AND tag_key = 'cost_center' AND workspace_id IN ('1','3','5')
        GROUP BY workload_id)""", "queue")
cte("wl90_ws", rollup(90, "AND workspace_id IN ('1','3','5')"), "summary")
cte("breakdown", f"""
  SELECT product, reason, count(*) AS workloads, round(sum(cost), 0) AS cost
  FROM (SELECT *, CASE WHEN product IN {GOVERNED} THEN 'POLICY_GOVERNED'
                       WHEN product = 'SQL' AND is_serverless = 1 THEN 'POLICY_GOVERNED'
                       WHEN product = 'DLT' THEN 'UI_ONLY'
                       WHEN product IN {DIRECT} THEN 'TAGGABLE' ELSE 'NO_API' END AS reason
        FROM wl WHERE cc = 0 AND cost > 0)
  WHERE reason <> 'TAGGABLE' GROUP BY product, reason""", "wl")
cte("requests", f"""
  SELECT {ws('p_partkey')} AS workspace_id, {product('p_partkey')} AS product,
         {wid('p_partkey')} AS workload_id,
         CASE WHEN p_partkey % 4 <> 0 THEN p_name || '-' || p_brand END AS workload_name,
         CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS is_serverless,
         CASE WHEN p_partkey % 9 = 0 THEN '' ELSE lower(p_type) END AS tag_value,
         lower(p_type) AS cc_value, 't' || (p_partkey % 3) AS team_value,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_retailprice AS DECIMAL(38,6)) END AS list_cost
  FROM part""")
PLANNED = ("product IN ('JOBS','SQL','MODEL_SERVING','VECTOR_SEARCH','ALL_PURPOSE','LAKEBASE') "
           "AND NOT (product = 'SQL' AND is_serverless = 1)")
NEW_ROW = (f"'batch-new' AS batch_id, {NOW} AS enqueued_at, 'me' AS requested_by, workspace_id, product, workload_id, workload_name, is_serverless, tag_key, tag_value, "
           "list_cost, 'PENDING' AS status, 0 AS attempts")

# Apply: histories as window functions, tags as rows.
cte("state_tags", f"""
  SELECT {ws('p_partkey')} AS workspace_id, {product('p_partkey')} AS product,
         {wid('p_partkey')} AS workload_id, t.tag_key, t.tag_value
  FROM part, LATERAL (VALUES
         ('env', CASE WHEN p_partkey % 8 <> 0 THEN 'prod' END),
         ('cost_center', CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 2
                              THEN 'cc-' || (p_partkey % 3) END),
         ('team', CASE WHEN p_partkey % 10 = 0 THEN 'cc-' || (p_partkey % 3) END)
       ) AS t(tag_key, tag_value)
  WHERE p_size > 2 AND {wid('p_partkey')} IS NOT NULL""")
cte("resources", f"""
  SELECT true AS there, {ws('p_partkey')} AS workspace_id, {product('p_partkey')} AS product,
         {wid('p_partkey')} AS workload_id
  FROM part WHERE p_size > 2 AND {wid('p_partkey')} IS NOT NULL""")
FREE = (f"(status = 'PENDING' OR (status = 'RUNNING' AND executed_at < {NOW} - INTERVAL 30 MINUTE))")
cte("claimed", f"SELECT * FROM queue WHERE {FREE}", "queue")
REASON = """CASE product WHEN 'AI_GATEWAY' THEN 'Only a budget policy reaches gateway spend.'
    WHEN 'APPS' THEN 'Only a budget policy reaches app spend.'
    WHEN 'LAKEFLOW_CONNECT' THEN 'Only a budget policy reaches connector spend.'
    WHEN 'INTERACTIVE' THEN 'Nothing here carries tags by itself; a person decides.'
    WHEN 'DLT' THEN 'Its tags belong to the pipeline''s own settings.' END"""
SERVERLESS_SQL = "'A serverless warehouse follows its budget policy, whatever its tags say.'"


def refusal(serverless: str) -> str:
    """Why a product, the serverless flag or an id rules a write out."""
    return f"""CASE WHEN product = 'AGENT_BRICKS' THEN 'no way to write tags of product AGENT_BRICKS'
         WHEN product = 'SQL' AND {serverless} THEN {SERVERLESS_SQL}
         WHEN product = 'JOBS' AND starts_with(workload_id, 'w') THEN 'InvalidId: job id must be an integer, not ' || workload_id
         ELSE {REASON} END"""


MISSING = "'ResourceDoesNotExist: ' || product || ' ' || workload_id"


def audit_id(run: str, action: str) -> str:
    return f"sha256(CAST(to_json(['{run}', '{action}', batch_id, workload_id, product, tag_key]) AS VARCHAR))"


cte("judged", f"""
  SELECT c.*, coalesce({refusal("is_serverless = 1")}, CASE WHEN r.there IS NULL THEN {MISSING} END) AS error, CASE
           WHEN c.product NOT IN {DIRECT} THEN 'UNSUPPORTED'
           WHEN c.product = 'SQL' AND c.is_serverless = 1 THEN 'UNSUPPORTED'
           WHEN c.product = 'JOBS' AND starts_with(c.workload_id, 'w') THEN 'FAILED'
           WHEN r.there IS NULL THEN 'FAILED' ELSE 'SUCCEEDED' END AS result,
         s.tag_value AS stored
  FROM claimed c
  LEFT JOIN resources r USING (workspace_id, product, workload_id)
  LEFT JOIN state_tags s USING (workspace_id, product, workload_id, tag_key)""",
    "claimed", "resources", "state_tags")
cte("tried", """
  SELECT *, CASE WHEN result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH' THEN
              coalesce(lag(tag_value) OVER (
                PARTITION BY workspace_id, product, workload_id, tag_key, result
                ORDER BY enqueued_at, batch_id), stored) END AS old_value
  FROM judged""", "judged")
cte("tried_flags", """
  SELECT *, result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH'
            AND coalesce(old_value = tag_value, false) AS noop
  FROM tried""", "tried")
cte("writes", """
  SELECT workspace_id, product, workload_id, tag_key, arg_max(tag_value, k) AS tag_value
  FROM (SELECT *, strftime(enqueued_at, '%Y%m%d%H%M%S') || batch_id AS k
        FROM tried WHERE result = 'SUCCEEDED')
  GROUP BY workspace_id, product, workload_id, tag_key""", "tried")

# Rollback.
cte("audit", f"""
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(round(l_extendedprice * 100) AS BIGINT) AS audit_id,
         'batch-' || (l_orderkey // 2000) AS batch_id, l_shipdate AS executed_at,
         {ws('pk')} AS workspace_id, {product('pk')} AS product, {wid('pk')} AS workload_id,
         CASE WHEN pk % 5 = 0 THEN 'team' ELSE 'cost_center' END AS tag_key,
         CASE WHEN l_suppkey % 3 <> 0 THEN 'old-' || (l_suppkey % 5) END AS old_value,
         'cc-' || (l_orderkey % 4) AS new_value,
         CASE WHEN l_linenumber = 6 THEN 'ROLLBACK' ELSE 'SET' END AS action,
         CASE WHEN l_linenumber = 5 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, 'writer' AS executed_by,
         CASE WHEN l_linenumber = 5 THEN 'PermissionDenied: no access' END AS error
  FROM (SELECT *, l_partkey AS pk FROM lineitem) WHERE {wid('pk')} IS NOT NULL""")


def undo(order: str, more: str = "") -> str:
    return f"""
  SELECT batch_id, l.workspace_id, l.product, l.workload_id, l.tag_key, f.old_value, l.new_value
  FROM (SELECT *, row_number() OVER (PARTITION BY product, workload_id, tag_key
                 ORDER BY executed_at DESC, audit_id DESC) AS rn FROM sets) l
  JOIN (SELECT product, workload_id, tag_key, old_value,
               row_number() OVER (PARTITION BY product, workload_id, tag_key
                 ORDER BY executed_at {order}, audit_id {order}) AS fn FROM sets) f
    ON l.product = f.product AND l.workload_id = f.workload_id AND l.tag_key = f.tag_key
  WHERE rn = 1 AND fn = 1 {more}"""


cte("sets", """
  SELECT * FROM audit WHERE batch_id = 'batch-0' AND action = 'SET' AND status = 'SUCCEEDED'""", "audit")
cte("plan", undo("DESC"), "sets")
cte("plan_first", undo("ASC"), "sets")
cte("plan_remaining", undo("DESC", """AND NOT EXISTS (
    SELECT 1 FROM audit a WHERE a.batch_id = 'batch-0' AND a.action = 'ROLLBACK'
      AND a.status = 'SUCCEEDED' AND a.product = l.product AND a.workload_id = l.workload_id
      AND a.tag_key = l.tag_key)"""), "sets")
cte("undone", f"""
  SELECT *, CASE WHEN error IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS status
  FROM (SELECT p.*, coalesce({refusal("false")},
                 CASE WHEN product = 'VECTOR_SEARCH' THEN 'PreviousValueUnknown: VECTOR_SEARCH ' || workload_id
                      WHEN r.there IS NULL THEN {MISSING} END) AS error
        FROM plan p LEFT JOIN resources r USING (workspace_id, product, workload_id))""", "plan", "resources")
UNDONE_AUDIT = f"""
SELECT {audit_id('run-1', 'ROLLBACK')} AS audit_id, batch_id, {NOW} AS executed_at, 'me' AS executed_by, workspace_id,
       product, workload_id, tag_key, new_value AS old_value, old_value AS new_value, 'ROLLBACK' AS action, status, error
FROM undone"""

# Inventory: last duplicate of a key wins.
cte("listed", f"""
  SELECT pk, scan.id AS scan_id, scan.made AS scanned_at, {ws('pk')} AS workspace_id,
         CASE pk % 13 WHEN 0 THEN 'JOBS' WHEN 1 THEN 'ALL_PURPOSE' WHEN 2 THEN 'SQL'
              WHEN 3 THEN 'DATABASE' WHEN 4 THEN 'MODEL_SERVING' WHEN 5 THEN 'LAKEBASE'
              WHEN 6 THEN 'VECTOR_SEARCH' WHEN 7 THEN 'DLT' WHEN 12 THEN 'POOL' END AS product,
         {wid('pk')} AS workload_id, p_name || '-' || p_brand AS workload_name,
         lower(p_type) || '@corp.example' AS owner, pk % 11 <> 0 AND pk % 13 <> 6 AS ok,
         CASE WHEN pk % 6 = 1 THEN 'dev' WHEN pk % 4 <> 0 THEN 'prod' END AS env,
         CASE WHEN pk % scan.step = 0 THEN 'cc-' || (pk % 3) END AS cc
  FROM (SELECT *, p_partkey AS pk FROM part)
  CROSS JOIN (VALUES ('scan-f00', TIMESTAMP '2024-04-22 06:00:00', 10, false),
                     ('scan-a11', TIMESTAMP '2024-04-29 06:00:00', 5, true)) AS scan(id, made, step, new)
  WHERE pk % 13 IN (0, 1, 2, 3, 4, 5, 6, 7, 12) AND {wid('pk')} IS NOT NULL
    AND NOT (scan.new AND p_size = 7) AND NOT (pk % 13 = 1 AND (pk // 13) % 3 = 2)""")
cte("inventory", f"""
  SELECT scan_id, scanned_at, workspace_id, product, workload_id, workload_name, owner, ok,
         CASE WHEN ok THEN concat_ws(',', CASE WHEN cc IS NOT NULL THEN 'cost_center=' || cc END,
                                     CASE WHEN env IS NOT NULL THEN 'env=' || env END)
              ELSE '' END AS tags,
         CASE WHEN ok THEN (CASE WHEN cc IS NULL THEN 0 ELSE 1 END)
                         + (CASE WHEN env IS NULL THEN 0 ELSE 1 END) ELSE 0 END AS tag_count,
         product <> 'DLT' AS direct_tag, CASE WHEN product = 'DLT' THEN 'UI_ONLY' ELSE 'DIRECT' END AS fallback,
         CASE WHEN pk % 11 = 0 THEN 'PermissionDenied: ' || pk
              WHEN pk % 13 = 6 THEN 'tags of this product cannot be read' END AS read_error
  FROM listed
  UNION ALL
  SELECT 'scan-a11', TIMESTAMP '2024-04-29 06:00:00', CAST(n_nationkey AS VARCHAR),
         CASE WHEN n_regionkey % 2 = 0 THEN 'SQL' ELSE '__workspace__' END,
         CASE WHEN n_regionkey % 2 = 0 THEN '__list_error__SQL'
              ELSE '__unreachable__' || n_nationkey END,
         NULL, NULL, false, '', 0, n_regionkey % 2 = 0,
         CASE WHEN n_regionkey % 2 = 0 THEN 'DIRECT' END,
         CASE WHEN n_regionkey % 2 = 0 THEN 'list failed: timeout' ELSE 'workspace unreachable: timeout' END
  FROM nation""", "listed")


def inventory_summary(scan: str) -> str:
    return f"""
  SELECT product, count(*) AS resources,
         count(*) FILTER (ok AND tag_count = 0) AS untagged, count(*) FILTER (tag_count > 0) AS tagged,
         count(*) FILTER (NOT ok) AS read_failed, max(fallback) AS fallback
  FROM inventory WHERE scan_id = '{scan}' AND NOT starts_with(workload_id, '__') GROUP BY product"""


cte("inv_new", inventory_summary("scan-a11"), "inventory")
cte("batches", """
  SELECT batch_id, max(enqueued_at) AS enqueued_at, max(requested_by) AS requested_by,
         count(*) AS rows, count(DISTINCT workload_id) AS workloads, round(sum(list_cost), 0) AS cost,
         count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running,
         count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed,
         count(*) FILTER (status = 'UNSUPPORTED') AS unsupported,
         count(*) FILTER (status = 'SKIPPED_DRYRUN') AS dry_run,
         count(*) FILTER (status = 'ROLLED_BACK') AS rolled_back
  FROM queue GROUP BY batch_id ORDER BY enqueued_at DESC, batch_id LIMIT 25""", "queue")

AFTER = """CASE WHEN b AND o.result IS NOT NULL THEN o.result ELSE q.status END"""
SCORES = {"growth": "promo|campaign", "accounts": "economy|ledger", "core": "standard|infra"}


def _score(name_result: str, owner_result: str, otherwise: str) -> str:
    """CASE over name words, then owner words; {t} stands for the team."""
    arms = [
        f"WHEN regexp_matches(lower({column}), '(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)') THEN {result.format(t=team)}"
        for column, result in (("workload_name", name_result), ("owner", owner_result))
        for team, words in SCORES.items()
    ]
    return f"CASE {' '.join(arms)} ELSE {otherwise} END"


cte("scored", f"""
  SELECT product, workload_id, workload_name, owner, workspace_id, cost AS list_cost,
         {_score("'{t}'", "'{t}'", "'unknown'")} AS suggested_cost_center,
         {_score('0.8', '0.6', '0.2')} AS confidence,
         {_score("'workload mentions {t}'", "'owner mentions {t}'",
                 "'no signal in name or owner'")} AS rationale
  FROM wl WHERE cc = 0 AND cost > 0""", "wl")
TEAMS3 = "['growth','accounts','core']"
cte("tagged_part", f"""
  SELECT *, substr(md5(product || '|' || workload_id), 1, 1) IN ('0','4','8','c') AS held_out FROM (
    SELECT {product('p_partkey')} AS product, 't' || p_partkey AS workload_id, {ws('p_partkey')} AS workspace_id,
           CASE WHEN p_partkey % 9 <> 4 THEN p_name || '-' || p_brand END AS workload_name,
           CASE WHEN p_partkey % 7 <> 3 THEN lower(p_type) || '@corp.example' END AS owner,
           CASE WHEN p_partkey % 11 = 0 THEN ({TEAMS3})[CAST(p_partkey % 3 AS INTEGER) + 1]
                WHEN p_type = 'PROMO' THEN 'growth' WHEN p_type = 'ECONOMY' THEN 'accounts' WHEN p_type = 'STANDARD' THEN 'core'
                ELSE ({TEAMS3})[CAST(substr(p_brand, 7) AS INTEGER) % 3 + 1] END AS team
    FROM part)""")


def _words(source: str) -> str:
    facts = (("name", "workload_name"), ("owner", "owner"), ("workspace", "workspace_id"))
    return " UNION ALL ".join(f"""
  SELECT product, workload_id, '{fact}:' || w AS word FROM (
    SELECT product, workload_id, unnest(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}
    WHERE {column} IS NOT NULL) WHERE w <> ''""" for fact, column in facts)


cte("tagged_words", f"""SELECT w.*, t.team, t.held_out FROM ({_words('tagged_part')}) w
  JOIN tagged_part t USING (product, workload_id)""", "tagged_part")
cte("learned_counts", "SELECT team, word, count(*) AS n FROM tagged_words WHERE NOT held_out GROUP BY ALL", "tagged_words")
cte("learned_teams", """
  SELECT team, CAST(round(ln(docs / sum(docs) OVER ()), 9) AS DECIMAL(18,9)) AS prior,
         CAST(round(ln(1.0 / (used + (SELECT count(DISTINCT word) FROM learned_counts))), 9) AS DECIMAL(18,9)) AS unseen
  FROM (SELECT team, CAST(count(*) AS DOUBLE) AS docs FROM tagged_part WHERE NOT held_out GROUP BY team)
  JOIN (SELECT team, sum(n) AS used FROM learned_counts GROUP BY team) USING (team)""", "tagged_part", "learned_counts")
cte("learned_weights", """
  SELECT word, team, CAST(round(ln(n + 1.0), 9) AS DECIMAL(18,9)) AS weight FROM learned_counts""", "learned_counts")


def _judged(name: str, source: str, words: str) -> None:
    cte(name, f"""
  SELECT product, workload_id, team, word, CAST(least(floor(round(1 / odds, 9) * 20), 19) AS INTEGER) AS bin FROM (
    SELECT *, sum(exp(CAST(score - best AS DOUBLE))) OVER (PARTITION BY product, workload_id) AS odds,
           row_number() OVER (PARTITION BY product, workload_id ORDER BY score DESC, team) AS place
    FROM (SELECT *, max(score) OVER (PARTITION BY product, workload_id) AS best FROM (
      SELECT l.product, l.workload_id, c.team, h.word,
             c.prior + CAST(l.length AS DECIMAL(9,0)) * c.unseen + coalesce(h.total, 0) AS score
      FROM (SELECT product, workload_id, count(*) AS length FROM {words}
            WHERE word IN (SELECT word FROM learned_counts) GROUP BY ALL) l
      CROSS JOIN learned_teams c
      LEFT JOIN (SELECT product, workload_id, team, sum(weight) AS total, max({{'weight': weight, 'word': word}}).word AS word
                 FROM {words} JOIN learned_weights USING (word) GROUP BY ALL) h
        ON h.product = l.product AND h.workload_id = l.workload_id AND h.team = c.team)))
  WHERE place = 1""", *source.split(), "learned_counts", "learned_teams", "learned_weights")


cte("load_words", _words("(SELECT * FROM wl WHERE cc = 0 AND cost > 0)"), "wl")
cte("test_words", "SELECT product, workload_id, word FROM tagged_words WHERE held_out", "tagged_words")
_judged("judged_loads", "load_words", "load_words")
_judged("judged_test", "test_words", "test_words")
cte("reliability", """
  SELECT bin, round((count(*) FILTER (j.team = t.team) + 2 * (bin + 0.5) / 20) / (count(*) + 2), 6) AS confidence
  FROM judged_test j JOIN tagged_part t USING (product, workload_id) GROUP BY bin""", "judged_test", "tagged_part")
PROMPT = """'Which of these teams runs the workload: growth, accounts, core?' || chr(10)
  || 'workload: ' || coalesce(workload_name, '(none)') || chr(10) || 'owner: ' || coalesce(owner, '(none)') || chr(10)
  || 'product: ' || product || chr(10) || 'Reply as JSON with cost_center, confidence from 0 to 1 and rationale; '
  || 'if no team fits, cost_center is "unknown".'"""
MATRIX = """(VALUES
  ('ALL_PURPOSE', 'cluster', 'DIRECT', '', 'cluster_id', ''),
  ('AI_GATEWAY', 'model gateway', 'BUDGET_POLICY', 'Only a budget policy reaches gateway spend.', '', ''),
  ('APPS', 'app', 'BUDGET_POLICY', 'Only a budget policy reaches app spend.', 'app_id', ''),
  ('DATABASE', 'database warehouse', 'DIRECT', '', '', ''),
  ('DLT', 'pipeline', 'UI_ONLY', 'Its tags belong to the pipeline''s own settings.', 'dlt_pipeline_id', ''),
  ('INTERACTIVE', 'shared session', 'EXCEPTION_QUEUE', 'Nothing here carries tags by itself; a person decides.',
   'cluster_id', ''),
  ('JOBS', 'job', 'DIRECT', '', 'job_id', ''),
  ('LAKEBASE', 'database instance', 'DIRECT', '', 'database_instance_id',
   'Check who owns the instance before tagging it.'),
  ('LAKEFLOW_CONNECT', 'ingestion connector', 'BUDGET_POLICY', 'Only a budget policy reaches connector spend.', '', ''),
  ('MODEL_SERVING', 'serving endpoint', 'DIRECT', '', 'endpoint_id', 'Earlier usage of the endpoint keeps its old tags.'),
  ('POOL', 'instance pool', 'DIRECT', 'Never billed by itself: jobs and clusters that use the pool are.',
   'instance_pool_id', 'Clusters take over the pool''s tags when they next start.'),
  ('SQL', 'warehouse', 'DIRECT', 'A serverless warehouse follows its budget policy, whatever its tags say.',
   'warehouse_id', ''),
  ('VECTOR_SEARCH', 'search endpoint', 'DIRECT', 'Its tags can be written but not read, so what they were is unknown.',
   'endpoint_id', '')) AS m(product, thing, fallback, reason, id_field, note)"""
cte("matrix", f"""
  SELECT product, upper(thing[1]) || thing[2:] || ' usage' AS label,
         CASE WHEN product = 'VECTOR_SEARCH' THEN '' WHEN fallback = 'DIRECT' THEN 'listed with the ' || thing
              WHEN fallback = 'UI_ONLY' THEN 'listed with its clusters' ELSE '' END AS read_path,
         CASE WHEN fallback = 'DIRECT' THEN 'write the tags of the ' || thing ELSE '' END AS write_path,
         CASE WHEN fallback = 'DIRECT' THEN product ELSE '' END AS tag_method, fallback = 'DIRECT' AS direct_tag,
         false AS create_time_only, fallback IN ('BUDGET_POLICY', 'EXCEPTION_QUEUE') AS policy_driven,
         fallback = 'UI_ONLY' AS ui_only, fallback = 'DIRECT' AND product <> 'VECTOR_SEARCH' AS rollback,
         fallback, reason, product = 'SQL' AS serverless_differs, thing, id_field, note FROM {MATRIX}""")
# What the latest scan shows: workspaces out of reach or without a list of warehouses, and unreadable tags.
cte("scanned", f"""
  SELECT *, coalesce({refusal("is_serverless = 1")},
           CASE WHEN n_regionkey % 2 = 1 THEN 'Unknown: workspace unreachable: timeout'
                WHEN product = 'SQL' THEN 'Unknown: list failed: timeout'
                WHEN pk IS NULL THEN {MISSING}
                WHEN NOT ok AND product <> 'VECTOR_SEARCH' THEN 'TagsUnreadable: PermissionDenied: ' || pk END) AS error
  FROM (SELECT c.*, l.pk, l.ok, l.cc, n.n_regionkey FROM claimed c
        LEFT JOIN (SELECT * FROM listed WHERE scan_id = 'scan-a11') l USING (workspace_id, product, workload_id)
        LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = c.workspace_id)""", "claimed", "listed")
cte("scanned_result", """
  SELECT *, CASE WHEN error IS NULL THEN 'SUCCEEDED'
                 WHEN product IN ('AGENT_BRICKS','AI_GATEWAY','APPS','LAKEFLOW_CONNECT','INTERACTIVE','DLT')
                   OR product = 'SQL' AND is_serverless = 1 THEN 'UNSUPPORTED' ELSE 'FAILED' END AS result
  FROM scanned""", "scanned")
cte("scanned_tried", """
  SELECT *, CASE WHEN result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH' THEN
              coalesce(lag(tag_value) OVER (
                PARTITION BY workspace_id, product, workload_id, tag_key, result ORDER BY enqueued_at, batch_id),
                CASE WHEN tag_key = 'cost_center' THEN cc END) END AS old_value FROM scanned_result""", "scanned_result")
# Two runs that overlap and a rollback: their batches share no resource.
cte("run_rows", """
  SELECT *, result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH' AND coalesce(stored = tag_value, false) AS noop
  FROM judged WHERE batch_id IN ('batch-0', 'batch-1')""", "judged")
cte("run_changes", "SELECT * FROM run_rows WHERE result = 'SUCCEEDED' AND NOT noop", "run_rows")
cte("run_back", "SELECT * FROM run_changes WHERE batch_id = 'batch-1' AND product <> 'VECTOR_SEARCH'", "run_changes")
cte("payload", """
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'AWS:' || source WHEN 1 THEN repeat('k', 128)
                      WHEN 2 THEN '' ELSE lang END AS k1, text AS v1,
         'src-' || source AS k2, CASE WHEN doc_id % 5 <> 0 THEN lang END AS v2
  FROM documents WHERE doc_id % 11 > 1""")
cte("pairs", "SELECT doc_id, k1 AS k, v1 AS v FROM payload UNION ALL SELECT doc_id, k2, v2 FROM payload",
    "payload")
LIVE_QUEUE = """
  SELECT q.batch_id, q.workload_id, q.product, q.tag_key,
         coalesce(t.result, q.status) AS status,
         CASE WHEN t.result IS NULL THEN q.attempts ELSE q.attempts + 1 END AS attempts,
         CASE WHEN t.result IS NULL THEN q.executed_at ELSE TIMESTAMP '2024-04-29 12:00:00' END AS executed_at
  FROM queue q LEFT JOIN {source} t USING (batch_id, workload_id, product, tag_key)"""


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["usage_scan"] = query("""
SELECT usage_date, workspace_id, product, workload_id, workload_name, owner, is_serverless, sku_name,
       CASE WHEN cc + team > 0 OR pk % 11 <> 0 THEN concat_ws(',',
         CASE WHEN cc = 1 THEN 'cost_center' END, CASE WHEN team = 1 THEN 'team' END) END AS tag_keys,
       dbus FROM records""", "records")
    o["current_prices"] = query("SELECT * FROM price", "price")
    o["daily_summary"] = query("""
SELECT usage_date, workspace_id, product, workload_id, workload_name, owner, is_serverless,
       concat_ws(',', CASE WHEN cc = 1 THEN 'cost_center' END, CASE WHEN team = 1 THEN 'team' END) AS tag_keys,
       dbus, list_cost, unpriced_dbus FROM summary""", "summary")
    o["summary_sink"] = query(f"""
SELECT usage_date, count(*) AS rows, sum(list_cost) AS list_cost, sum(cc) AS with_cost_center FROM summary
WHERE usage_date >= {AS_OF} - 90 GROUP BY usage_date""", "summary")
    o["workload_rollup"] = query("""
SELECT product, workload_id, workspace_id, workload_name, owner, is_serverless, last_seen,
       cc = 0 AS is_untagged, cost FROM wl""", "wl")
    o["kpi_summary"] = kpi("cc = 0", "wl")
    o["kpi_two_keys"] = kpi("cc + team = 0", "wl90")
    o["kpi_no_keys"] = kpi("cc + team = 0", "wl_ws")
    o["by_product"] = query("SELECT * FROM by_product", "by_product")
    o["product_risk"] = query("""
SELECT product, CASE WHEN pct_untagged >= 95 THEN 'high' WHEN pct_untagged >= 70 THEN 'medium'
                     ELSE 'low' END AS risk,
       greatest(2, round(100.0 * CAST(untagged_cost AS DOUBLE)
                         / (SELECT CAST(max(untagged_cost) AS DOUBLE) FROM by_product), 0)) AS bar
FROM by_product""", "by_product")
    o["tagged_live_adjustment"] = query("SELECT * FROM live", "live")
    for name, costs, credits in (("kpi_live", "wl90", "live"), ("kpi_live_workspaces", "wl90_ws", "live_ws")):
        o[name] = kpi_live(costs, credits)
    o["not_taggable_breakdown"] = query("SELECT * FROM breakdown", "breakdown")
    o["reason_rollup"] = query(
        "SELECT reason, sum(workloads) AS workloads, sum(cost) AS cost FROM breakdown GROUP BY reason",
        "breakdown")
    o["taggable_by_reason"] = query(f"""
SELECT product, is_serverless, {TAGGABLE} AS taggable, CASE WHEN product IN {GOVERNED} THEN 'POLICY_GOVERNED'
         WHEN product = 'SQL' AND is_serverless = 1 THEN 'POLICY_GOVERNED' WHEN product = 'DLT' THEN 'UI_ONLY'
         WHEN product IN {DIRECT} THEN 'TAGGABLE' ELSE 'NO_API' END AS reason, count(*) AS workloads
FROM wl GROUP BY ALL""", "wl")
    for name, column in (("owner", "owner"), ("workspace", "workspace_id"), ("product", "product"),
                         ("name", "workload_name")):
        o[f"field_values_{name}"] = query(f"""
SELECT {column} AS value, round(sum(list_cost), 0) AS cost, count(DISTINCT workload_id) AS workloads
FROM summary WHERE usage_date >= {AS_OF} - 30 AND {column} IS NOT NULL AND {column} <> ''
GROUP BY {column} ORDER BY lower({column}), {column} LIMIT 2000""", "summary")
    o["kpi_two_keys_bits"], o["kpi_no_keys_bits"] = o["kpi_two_keys"], o["kpi_no_keys"]
    o["freshness"] = query("SELECT max(usage_date) AS as_of, count(*) AS rows FROM summary", "summary")
    o["explore"] = query(f"""
SELECT product, workload_id, workload_name, owner, cost, last_seen FROM wl
WHERE cost >= 10 AND {AS_OF} - last_seen <= 14
  AND (contains(lower(coalesce(workload_name, workload_id)), 'eco') OR contains(lower(coalesce(owner, '')), 'eco'))""",
                         "wl")
    o["rule_matches"] = query("SELECT product, workload_id, first_rule FROM ruled", "ruled")
    o["rule_matches_many"] = query(f"""
SELECT product, workload_id, coalesce(t.pos, b.pos, -1) AS first_rule
FROM (SELECT * FROM wl WHERE cc = 0 AND cost > 0 AND {TAGGABLE}) w
LEFT JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS pos FROM (SELECT DISTINCT p_type FROM part)) t
  ON lower(w.owner) = lower(t.p_type) || '@corp.example'
LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 + (SELECT count(DISTINCT p_type) FROM part) AS pos
           FROM (SELECT DISTINCT p_brand FROM part)) b
  ON ends_with(lower(w.workload_name), lower(b.p_brand))""", "wl")
    o["rule_impact"] = query("""
SELECT count(*) AS total_untagged, round(sum(cost), 0) AS total_untagged_cost,
       count(*) FILTER (first_rule >= 0) AS matched_count,
       round(sum(cost) FILTER (first_rule >= 0), 0) AS matched_cost FROM ruled_open""", "ruled_open")
    o["rule_sample"] = query("""
SELECT workload_id, product, workspace_id, workload_name, owner, is_serverless, round(cost, 0) AS cost,
       last_seen, tag_value AS new_tag_value
FROM ruled_open JOIN rule_tags ON rule_idx = first_rule AND tag_key = 'cost_center'
ORDER BY round(cost, 0) DESC, product, workload_id LIMIT 200""", "ruled_open", "rule_tags")
    o["rule_matches_indexed"] = query("SELECT product, workload_id, first_rule FROM ruled_many", "ruled_many")
    o["rule_impact_indexed"] = query("""
SELECT count(*) AS total_untagged, round(sum(cost), 0) AS total_untagged_cost,
       count(*) FILTER (first_rule >= 0) AS matched_count,
       round(sum(cost) FILTER (first_rule >= 0), 0) AS matched_cost FROM ruled_many_open""", "ruled_many_open")
    o["rule_sample_indexed"] = query("""
SELECT workload_id, product, workspace_id, workload_name, owner, is_serverless, round(cost, 0) AS cost,
       last_seen, tag_value AS new_tag_value
FROM ruled_many_open JOIN many_rule_tags ON rule_idx = first_rule AND tag_key = 'cost_center'
ORDER BY round(cost, 0) DESC, product, workload_id LIMIT 200""", "ruled_many_open", "many_rule_tags")
    o["enqueue_rules_indexed"] = query(f"""
SELECT {NEW_ROW.replace('list_cost', 'cost AS list_cost')} FROM ruled_many JOIN many_rule_tags ON rule_idx = first_rule""",
                                       "ruled_many", "many_rule_tags")
    o["handled_guard"] = query("""
SELECT product, count(*) AS open_workloads FROM suggestions s
WHERE NOT EXISTS (SELECT 1 FROM handled h WHERE h.product = s.product AND h.workload_id = s.workload_id)
GROUP BY product""", "suggestions", "handled")
    o["scoring_prompts"] = query(
        f"SELECT product, workload_id, {PROMPT} AS prompt FROM wl WHERE cc = 0 AND cost > 0", "wl")
    o["score_workloads"] = query("SELECT * FROM scored", "scored")
    o["score_learned"] = query(f"""
SELECT product, workload_id, workload_name, owner, workspace_id, cost AS list_cost,
       coalesce(f.team, 'unknown') AS suggested_cost_center, coalesce(f.confidence, 0) AS confidence,
       CASE WHEN f.team IS NULL THEN 'no known word' ELSE 'learned from ' || coalesce(f.word, 'the team''s size') END AS rationale
FROM wl LEFT JOIN (
  SELECT j.*, coalesce(r.confidence, round((j.bin + 0.5) / 20, 6)) AS confidence
  FROM judged_loads j LEFT JOIN reliability r USING (bin)) f USING (product, workload_id)
WHERE cc = 0 AND cost > 0""", "wl", "judged_loads", "reliability")
    o["learned_accuracy"] = query(f"""
SELECT 'learned' AS method, count(*) AS n, count(*) FILTER (j.team = t.team) AS n_right
FROM (SELECT * FROM tagged_part WHERE held_out) t LEFT JOIN judged_test j USING (product, workload_id)
UNION ALL SELECT 'words', count(*), count(*) FILTER ({_score("'{t}'", "'{t}'", "'unknown'")} = team) FROM tagged_part WHERE held_out""", "tagged_part", "judged_test")
    o["suggestion_impact"] = query("""
SELECT count(*) AS workloads, round(sum(cost), 0) AS cost,
       count(DISTINCT suggested_cost_center) AS distinct_values FROM cand""", "cand")
    o["suggestion_list"] = query("""
SELECT product, workload_id, workspace_id, is_serverless, workload_name, round(cost, 0) AS cost, last_seen,
       suggested_cost_center AS new_tag_value, round(confidence, 2) AS confidence
FROM cand ORDER BY round(cost, 0) DESC, product, workload_id LIMIT 100""", "cand")
    o["policy_governed_impact"] = query(f"""
SELECT count(*) AS workloads, round(sum(cost), 0) AS cost FROM wl JOIN suggestions USING (product, workload_id)
WHERE cc = 0 AND cost > 0 AND {CONFIDENT} AND NOT {TAGGABLE}""", "wl", "suggestions")
    for name, source in (("enqueue_rules", "ruled"), ("enqueue_rules_skip_handled", "ruled_open")):
        o[name] = query(f"""
SELECT {NEW_ROW.replace('list_cost', 'cost AS list_cost')} FROM {source} JOIN rule_tags ON rule_idx = first_rule""",
                        source, "rule_tags")
    o["enqueue_single"] = query(f"""
SELECT {NEW_ROW} FROM (
  SELECT workspace_id, product, workload_id, coalesce(workload_name, workload_id) AS workload_name,
         is_serverless, t.tag_key, t.tag_value, list_cost
  FROM requests, LATERAL (VALUES ('cost_center', cc_value), ('team', team_value)) AS t(tag_key, tag_value)
  WHERE {PLANNED})""", "requests")
    o["enqueue_selected"] = query(f"""
SELECT {NEW_ROW} FROM (
  SELECT workspace_id, product, workload_id, coalesce(workload_name, workload_id) AS workload_name,
         is_serverless, 'cost_center' AS tag_key, tag_value, list_cost
  FROM requests WHERE workload_id IS NOT NULL AND tag_value <> '')""", "requests")
    o["enqueue_suggestions"] = query(f"""
SELECT {NEW_ROW} FROM (
  SELECT workspace_id, product, workload_id, workload_name, is_serverless, 'cost_center' AS tag_key,
         suggested_cost_center AS tag_value, cost AS list_cost
  FROM cand WHERE NOT EXISTS (
    SELECT 1 FROM queue q WHERE q.batch_id = 'batch-0' AND q.tag_key = 'cost_center'
      AND q.product = cand.product AND q.workload_id = cand.workload_id))""", "cand", "queue")
    cte("auto", """
  SELECT r.workspace_id, r.product, r.workload_id, t.tag_key, t.tag_value, 'rule' AS origin
  FROM ruled r JOIN rule_tags t ON rule_idx = first_rule
  UNION ALL
  SELECT workspace_id, product, workload_id, 'cost_center', suggested_cost_center, 'suggestion'
  FROM cand WHERE NOT EXISTS (
    SELECT 1 FROM ruled r WHERE first_rule >= 0 AND r.product = cand.product
      AND r.workload_id = cand.workload_id)""", "ruled", "rule_tags", "cand")
    o["auto_tag"] = query("SELECT * FROM auto", "auto")
    o["auto_tag_counts"] = query("""
SELECT count(*) FILTER (origin = 'rule') AS rule_rows, count(*) FILTER (origin = 'suggestion') AS suggestion_rows,
       count(*) AS total_rows FROM auto""", "auto")
    o["tag_plan"] = query(f"""
SELECT r.product, is_serverless, refusal IS NULL AS supported, id_kind, resource_type, call_hint,
       coalesce(refusal, CASE WHEN is_serverless = 1 AND note <> '' THEN note END) AS warning, count(*) AS requests
FROM (SELECT q.product, is_serverless, m.note, nullif(m.id_field, '') AS id_kind,
             CASE WHEN m.id_field <> '' THEN m.thing ELSE 'unknown' END AS resource_type,
             CASE WHEN m.id_field <> '' THEN coalesce(nullif(m.write_path, ''), m.fallback) END AS call_hint,
             CASE WHEN coalesce(m.id_field, '') = '' THEN 'nothing to tag is known for product ' || q.product
                  WHEN NOT m.direct_tag OR (q.product = 'SQL' AND is_serverless = 1) THEN m.reason END AS refusal
      FROM requests q LEFT JOIN matrix m ON m.product = q.product) r GROUP BY ALL""", "requests", "matrix")
    columns = """label, read_path, write_path, tag_method, direct_tag, create_time_only, policy_driven, ui_only, rollback,
       fallback, reason, serverless_differs"""
    o["capability_of_usage"] = query(f"""
SELECT s.product, {columns}, dbus FROM (SELECT product, sum(dbus) AS dbus FROM summary GROUP BY product) s
LEFT JOIN matrix m ON m.product = s.product""", "summary", "matrix")
    o["capability_matrix"] = query(f"""
SELECT m.product, {columns}, coalesce(parts, 0) AS parts FROM matrix m LEFT JOIN (
  SELECT CASE WHEN {product('p_partkey')} = 'AGENT_BRICKS' THEN 'POOL' ELSE {product('p_partkey')} END AS product,
         count(*) AS parts FROM part GROUP BY 1) p ON p.product = m.product""", "matrix")
    for name, scope in (("claim_workspace", "workspace_id = '3'"), ("claim_batch", "batch_id = 'batch-0'")):
        o[name] = query(f"""
SELECT batch_id, workspace_id, workload_id, product, tag_key, CASE WHEN f THEN 'RUNNING' ELSE status END AS status,
       CASE WHEN f THEN 'run-1' ELSE last_error END AS last_error,
       CASE WHEN f THEN {NOW} ELSE executed_at END AS executed_at
FROM (SELECT *, coalesce({FREE}, false) AND {scope} AS f FROM queue)""", "queue")
    o["claim"] = query(f"""
SELECT batch_id, workload_id, product, tag_key, CASE WHEN f THEN 'RUNNING' ELSE status END AS status,
       CASE WHEN f THEN 'run-1' ELSE last_error END AS last_error,
       CASE WHEN f THEN {NOW} ELSE executed_at END AS executed_at
FROM (SELECT *, coalesce({FREE}, false) AS f FROM queue)""", "queue")
    o["drain_order"] = query(f"""
SELECT batch_id, workload_id, product, tag_key, list_cost FROM claimed ORDER BY list_cost DESC NULLS LAST""", "claimed")
    o["apply_attempts"] = query("""
SELECT batch_id, workload_id, product, tag_key, result AS status, error, old_value,
       CASE WHEN result = 'SUCCEEDED' THEN tag_value END AS new_value, noop FROM tried_flags""", "tried_flags")
    o["apply_scanned"] = query("""
SELECT batch_id, workload_id, product, tag_key, result AS status, error, old_value,
       CASE WHEN result = 'SUCCEEDED' THEN tag_value END AS new_value,
       result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH' AND coalesce(old_value = tag_value, false) AS noop
FROM scanned_tried""", "scanned_tried")
    o["apply_dry_run"] = query("""
SELECT batch_id, workload_id, product, tag_key,
       CASE WHEN result = 'SUCCEEDED' AND NOT (product <> 'VECTOR_SEARCH' AND coalesce(stored = tag_value, false))
            THEN 'SKIPPED_DRYRUN' ELSE result END AS status FROM judged""", "judged")
    o["apply_queue_bucketed"] = query(LIVE_QUEUE.format(source="tried"), "queue", "tried")
    o["apply_queue"] = query(LIVE_QUEUE.format(source="tried"), "queue", "tried")
    o["apply_audit"] = query(f"""
SELECT {audit_id('run-1', 'SET')} AS audit_id, {NOW} AS executed_at, 'me' AS executed_by, error, batch_id, workspace_id, product, workload_id, tag_key, old_value,
       CASE WHEN result = 'SUCCEEDED' THEN tag_value END AS new_value, 'SET' AS action, result AS status
FROM tried_flags WHERE result = 'FAILED' OR (result = 'SUCCEEDED' AND NOT noop)""", "tried_flags")
    o["apply_state"] = query("""
SELECT workspace_id, product, workload_id, tag_key, coalesce(w.tag_value, s.tag_value) AS tag_value
FROM (SELECT * FROM state_tags WHERE tag_value IS NOT NULL) s
FULL JOIN writes w USING (workspace_id, product, workload_id, tag_key)""", "state_tags", "writes")
    o["run_summary"] = query("SELECT result AS status, count(*) AS rows FROM tried GROUP BY result", "tried")
    o["rollback_plan"] = query("SELECT * FROM plan", "plan")
    o["rollback_plan_earliest"] = query("SELECT * FROM plan_first", "plan_first")
    o["rollback_plan_remaining"] = query("SELECT * FROM plan_remaining", "plan_remaining")
    o["rollback_trial"] = query("SELECT *, 'DRY_RUN' AS status, NULL AS error FROM plan", "plan")
    o["rollback_audit"] = query(UNDONE_AUDIT, "undone")
    o["rollback_state"] = query("""
SELECT workspace_id, product, workload_id, tag_key,
       CASE WHEN u.product IS NULL THEN s.tag_value ELSE u.old_value END AS tag_value
FROM (SELECT * FROM state_tags WHERE tag_value IS NOT NULL) s
FULL JOIN (SELECT * FROM undone WHERE status = 'SUCCEEDED') u USING (workspace_id, product, workload_id, tag_key)
WHERE u.product IS NULL OR u.old_value IS NOT NULL""", "state_tags", "undone")
    o["rollback_queue"] = query(f"""
SELECT q.batch_id, q.workload_id, q.product, q.tag_key,
       CASE WHEN u.product IS NULL THEN q.status ELSE 'ROLLED_BACK' END AS status,
       CASE WHEN u.product IS NULL THEN q.executed_at ELSE {NOW} END AS executed_at
FROM queue q LEFT JOIN undone u ON u.status = 'SUCCEEDED' AND q.batch_id = 'batch-0' AND q.status = 'SUCCEEDED'
  AND u.product = q.product AND u.workload_id = q.workload_id AND u.tag_key = q.tag_key""", "queue", "undone")
    o["recent_batches"] = query("SELECT * FROM batches", "batches")
    o["batch_progress"] = query("""
SELECT batch_id, rows, cost,
       CASE WHEN rolled_back > 0 THEN round(100.0 * rolled_back / (succeeded + rolled_back), 0)
            WHEN rows > 0 THEN round(100.0 * succeeded / rows, 0) ELSE 0 END AS pct,
       rolled_back > 0 AS reverting, pending + running > 0 AS in_flight,
       rolled_back > 0 AND succeeded > 0 AND pending + running = 0 AS residual,
       failed + unsupported AS not_tagged FROM batches""", "batches")
    o["batch_failure_breakdown"] = query("""
SELECT product, status, coalesce(nullif(trim(split_part(last_error, ':', 1)), ''), 'unknown') AS reason,
       count(*) AS rows, round(sum(list_cost), 0) AS cost, min(last_error) AS sample_reason
FROM queue WHERE batch_id = 'batch-0' AND status IN ('FAILED', 'UNSUPPORTED')
GROUP BY 1, 2, 3 ORDER BY rows DESC, product, status, reason LIMIT 50""", "queue")
    o["queue_history"] = query("""
SELECT batch_id, workspace_id, product, workload_id, tag_key, tag_value,
       lag(tag_value) OVER (PARTITION BY workspace_id, product, workload_id, tag_key ORDER BY enqueued_at, batch_id) AS previous
FROM queue""", "queue")
    o["count_queue_rows"] = query("SELECT count(*) AS n FROM queue WHERE batch_id = 'batch-0'", "queue")
    o["inventory_rows"] = query("""
SELECT scan_id, scanned_at, workspace_id, product, workload_id, workload_name, owner, tags, tag_count,
       direct_tag, fallback, ok AS tag_read_ok, read_error FROM inventory""", "inventory")
    o["inventory_summary"] = query("SELECT * FROM inv_new", "inv_new")
    o["inventory_summary_by_id"] = query(inventory_summary("scan-f00"), "inventory")
    o["inventory_meta"] = query("""
SELECT scan_id, max(scanned_at) AS scanned_at, count(*) AS resources FROM inventory
WHERE scan_id = 'scan-a11' GROUP BY scan_id""", "inventory")
    o["inventory_report"] = query("""
SELECT scan_id, '__meta__' AS product, count(*) AS resources, NULL AS untagged, NULL AS tagged FROM inventory
WHERE scan_id = 'scan-a11' GROUP BY scan_id
UNION ALL SELECT NULL, product, resources, untagged, tagged FROM inv_new""", "inventory", "inv_new")
    o["inventory_coverage"] = query(
        "SELECT product, resources, tagged, round(100.0 * tagged / resources, 0) AS coverage_pct FROM inv_new",
        "inv_new")
    o["inventory_totals"] = query(
        "SELECT sum(resources) AS resources, sum(untagged) AS untagged FROM inv_new", "inv_new")
    o["sweep_counts"] = query("""
SELECT product, count(*) AS resources, count(*) FILTER (ok AND tag_count = 0) AS untagged FROM inventory
WHERE scan_id = 'scan-a11' GROUP BY product""", "inventory")
    o["tag_violations"] = query(f"""
SELECT doc_id, NULL AS tag_key, 'empty' AS rule FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, NULL, 'too_many' FROM documents WHERE doc_id % 11 = 1
UNION ALL SELECT doc_id, k, 'key_length' FROM pairs WHERE length(k) NOT BETWEEN 1 AND 127
UNION ALL SELECT doc_id, k, 'key_reserved' FROM pairs WHERE {RESERVED}
UNION ALL SELECT doc_id, k, 'value_missing' FROM pairs WHERE v IS NULL
UNION ALL SELECT doc_id, k, 'value_length' FROM pairs WHERE length(v) > 255""", "pairs")
    o["queue_append"] = query(f"""
SELECT batch_id, enqueued_at, requested_by, workspace_id, product, workload_id, workload_name, is_serverless, tag_key,
       tag_value, list_cost, status, attempts, last_error, executed_at FROM queue
UNION ALL SELECT {NEW_ROW.replace('list_cost', 'cost AS list_cost')}, NULL, NULL
FROM ruled JOIN rule_tags ON rule_idx = first_rule""", "queue", "ruled", "rule_tags")
    o["audit_append"] = query(f"""
SELECT audit_id, batch_id, executed_at, executed_by, workspace_id, product, workload_id, tag_key, old_value, new_value,
       action, status, error FROM audit UNION ALL {UNDONE_AUDIT}""", "audit", "undone")
    o["inventory_append"] = o["inventory_rows"]
    o["ledger_run"] = query(f"""
SELECT 'queue' AS kind, q.batch_id, q.workspace_id, q.product, q.workload_id, q.tag_key,
       CASE WHEN b.batch_id IS NOT NULL THEN 'ROLLED_BACK' ELSE coalesce(r.result, q.status) END AS status,
       NULL AS old_value, NULL AS new_value
FROM queue q LEFT JOIN run_rows r USING (batch_id, product, workload_id, tag_key)
LEFT JOIN run_back b USING (batch_id, product, workload_id, tag_key)
UNION ALL SELECT 'queue', 'late', workspace_id, product, workload_id, tag_key, 'PENDING', NULL, NULL
FROM queue WHERE batch_id = 'batch-0' AND status = 'ROLLED_BACK'
UNION ALL SELECT 'state', NULL, workspace_id, product, workload_id, tag_key, NULL, NULL, coalesce(w.tag_value, s.tag_value)
FROM (SELECT * FROM state_tags WHERE tag_value IS NOT NULL) s
FULL JOIN (SELECT workspace_id, product, workload_id, tag_key, tag_value FROM run_changes
           WHERE batch_id = 'batch-0' OR product = 'VECTOR_SEARCH') w USING (workspace_id, product, workload_id, tag_key)
UNION ALL SELECT 'SET', batch_id, workspace_id, product, workload_id, tag_key, result,
       CASE WHEN result = 'SUCCEEDED' AND product <> 'VECTOR_SEARCH' THEN stored END,
       CASE WHEN result = 'SUCCEEDED' THEN tag_value END
FROM run_rows WHERE result = 'FAILED' OR (result = 'SUCCEEDED' AND NOT noop)
UNION ALL SELECT 'ROLLBACK', batch_id, workspace_id, product, workload_id, tag_key,
       CASE WHEN product = 'VECTOR_SEARCH' THEN 'FAILED' ELSE 'SUCCEEDED' END, tag_value,
       CASE WHEN product <> 'VECTOR_SEARCH' THEN stored END
FROM run_changes WHERE batch_id = 'batch-1'""", "queue", "run_rows", "run_back", "run_changes", "state_tags")
    o["suggestions_sink"] = query("""
SELECT suggested_cost_center, count(*) AS rows, sum(list_cost) AS list_cost FROM scored
GROUP BY suggested_cost_center""", "scored")
    o["status_stream"] = query("""
SELECT q.batch_id, q.workload_id, q.product, q.tag_key, coalesce(t.result, q.status) AS status,
       CASE WHEN t.result IS NULL THEN q.attempts ELSE q.attempts + 2 END AS attempts
FROM queue q LEFT JOIN tried t USING (batch_id, workload_id, product, tag_key)""", "queue", "tried")
    return o
