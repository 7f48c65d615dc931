"""Ids that are shuffled as bytes come back as they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions.packing import packed, unpacked
from shoebox.operators import facets
from shoebox.operators import workspace as reads


def test_any_text_is_packed_without_loss(spark):
    ids = ["p_" + "ab" * 16, "person_00ff", "c_", "_", "", "_ab", "c_AB", "c_ab", "c_abc", "x_y_ab", "é_ab", "plain", None, "c_a\u0000", "z" * 300 + "_ab", "2p_ab"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", packed(F.col("id")).alias("b"), unpacked(packed(F.col("id"))).alias("u")).collect()
    assert [r.u for r in rows] == ids and len({r.b and bytes(r.b) for r in rows}) == len(ids) and len(rows[0].b) == 18


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_shuffle_ids_as_bytes_and_broadcast_no_table(spark, roles):
    """Before, ids were shuffled as text, and tables of ids made from short keys were broadcast as if small."""
    found = facets.people_in_published_pictures(roles.people, roles.links, roles.pictures)
    summary = reads.cluster_summary(roles.clusters, roles.faces, roles.pictures, roles.people)
    for joined in (found, summary, reads.crossing_links(roles.cannot_links, roles.faces)):
        assert "unhex" in plan(joined)
    assert "Broadcast" not in plan(found)
    assert found.join(roles.links, ["photo_id", "person_id"], "left_anti").isEmpty() and not found.isEmpty()


def test_facts_of_rules_are_shuffled_as_bytes(spark):
    from shoebox.operators.rules import Checked, broken_rules

    rows = spark.createDataFrame([("c_00ff", "a|b"), ("c_00ff", "a|b"), ("plain", None)], "id string, other string")
    found = broken_rules(Checked(rows, F.col("id"), unique={"pair": ["id", "other"]}, references={"there": ["id"]}))
    assert "unhex" in plan(found)
    assert {tuple(r) for r in found.collect()} == {("pair", "c_00ff|a|b", 1), ("there", "c_00ff", 2), ("there", "plain", 1)}


def test_a_plan_carries_columns_of_its_photos(spark, roles):
    """Tables of earlier uploads need no join with the photos."""
    from shoebox.plans.ingest import upload_plan

    found = upload_plan(roles.keyed_pictures, "/objects", keep=("o_orderkey",))
    assert found.columns == [*upload_plan(roles.keyed_pictures, "/objects").columns, "o_orderkey"] and "Join" not in plan(found)
