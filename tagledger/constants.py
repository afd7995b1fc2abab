"""Codes and limits that results depend on."""

from __future__ import annotations

# Queue statuses.
PENDING = "PENDING"
RUNNING = "RUNNING"
SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"
UNSUPPORTED = "UNSUPPORTED"
SKIPPED_DRYRUN = "SKIPPED_DRYRUN"
ROLLED_BACK = "ROLLED_BACK"
QUEUE_STATUSES = (PENDING, RUNNING, SUCCEEDED, FAILED, UNSUPPORTED, SKIPPED_DRYRUN, ROLLED_BACK)

# A workload with a queue row in one of these is not proposed again for that key.
HANDLED_STATUSES = (SUCCEEDED, PENDING, RUNNING, UNSUPPORTED, FAILED)

# Audit actions, and the status a rollback trial run reports.
SET = "SET"
ROLLBACK = "ROLLBACK"
DRY_RUN = "DRY_RUN"

# Why a workload cannot take a direct tag.
POLICY_GOVERNED = "POLICY_GOVERNED"
UI_ONLY = "UI_ONLY"
TAGGABLE = "TAGGABLE"
NO_API = "NO_API"

# Remedies per product.
DIRECT = "DIRECT"
BUDGET_POLICY = "BUDGET_POLICY"
CREATE_TIME = "CREATE_TIME"
EXCEPTION_QUEUE = "EXCEPTION_QUEUE"

# Windows and limits.
SUMMARY_DAYS = 90
SCORING_DAYS = 30
STALE_CLAIM_MINUTES = 30
CONFIDENCE_SLACK = 0.05

# Limits that the registered top-k queries ask for; operators have none of their own.
RULE_SAMPLE_LIMIT = 200
SUGGESTION_LIMIT = 100
FIELD_VALUE_LIMIT = 2000
BATCH_LIMIT = 25
FAILURE_REASON_LIMIT = 50

# Tag limits.
MAX_TAGS = 20
KEY_LENGTH = (1, 127)
VALUE_LENGTH = (0, 255)
RESERVED_KEY_PREFIXES = ("aws:", "databricks")

# Workload id and name: the first non-null field of usage_metadata wins.
WORKLOAD_ID_FIELDS = (
    "job_id", "warehouse_id", "dlt_pipeline_id", "endpoint_id",
    "app_id", "index_id", "database_instance_id", "cluster_id",
)
WORKLOAD_NAME_FIELDS = (
    "job_name", "endpoint_name", "app_name", "run_name",
    "dlt_pipeline_id", "warehouse_id", "cluster_id", "database_instance_id",
)
OWNER_FIELDS = ("owned_by", "run_as", "created_by")

# Rule field -> summary column.
RULE_FIELDS = {
    "owner": "owner",
    "workspace": "workspace_id",
    "product": "product",
    "name": "workload_name",
}

# Cluster sources whose clusters are taggable in their own right.
INTERACTIVE_CLUSTER_SOURCES = ("UI", "API")
