from tagledger import capability as cap, constants as C
from tagledger.operators.tag_plan import tag_plan


def test_product_sets():
    assert set(cap.policy_governed_products()) == {
        "APPS", "AI_GATEWAY", "INTERACTIVE", "LAKEFLOW_CONNECT"}
    assert set(cap.always_taggable_products()) == {
        "JOBS", "ALL_PURPOSE", "POOL", "MODEL_SERVING", "LAKEBASE", "VECTOR_SEARCH", "DATABASE"}
    assert cap.ui_only_products() == ("DLT",)
    assert cap.serverless_dependent_products() == ("SQL",)


def test_reasons_cover_governed_products_and_sql():
    assert set(cap.policy_reasons()) == set(cap.policy_governed_products()) | {"SQL"}
    assert all(cap.policy_reasons().values())


def test_the_flags_of_a_product_agree(spark):
    """Properties of the flags, for every row."""
    rows = cap.capability_matrix(spark).collect()
    assert len(rows) == 13 and set(rows[0].asDict()) == set(cap.COLUMNS)
    for r in rows:
        assert r["direct_tag"] + r["policy_driven"] + r["ui_only"] == 1, r
        assert r["direct_tag"] == (r["fallback"] == C.DIRECT) == bool(r["write_path"]) == bool(r["tag_method"])
        assert r["rollback"] <= r["direct_tag"] and r["rollback"] <= bool(r["read_path"])
        assert r["direct_tag"] or r["reason"]


def test_tag_plan(spark):
    asked = spark.createDataFrame(
        [("JOBS", 0), ("SQL", 0), ("SQL", 1), ("MODEL_SERVING", 1), ("DATABASE", 0), ("DLT", 0),
         ("APPS", 0), ("POOL", None), ("NEW_THING", 0)], "product string, is_serverless int")
    found = {(r["product"], r["is_serverless"]): r for r in tag_plan(asked).collect()}
    assert [k for k, r in found.items() if r["supported"]] and len(found) == 9
    supported = {k for k, r in found.items() if r["supported"]}
    assert supported == {("JOBS", 0), ("SQL", 0), ("MODEL_SERVING", 1), ("POOL", None)}
    assert found["MODEL_SERVING", 1]["warning"] and found["JOBS", 0]["warning"] is None
    assert "NEW_THING" in found["NEW_THING", 0]["warning"]
    assert found["NEW_THING", 0]["resource_type"] == "unknown"
    assert found["DATABASE", 0]["id_kind"] is None
    assert found["DLT", 0]["id_kind"] == "dlt_pipeline_id"
