from contrasta.operators import choice_evidence as H


def test_groups_and_roles_move_once_by_item(spark):
    edges = spark.createDataFrame([(1, 0, "date", "1995", 3, True, False, True), (1, 1, "date", "1995H1", 3, True, False, True)], "item int, letter int, family string, node string, tier int, verbal boolean, soft boolean, eligible boolean")
    up = spark.createDataFrame([("1995H1", "1995")], "node string, ancestor string")
    rationale = spark.createDataFrame([(1, "date", "1995", 2)], "item int, family string, node string, covers int")
    groups = H.universe(edges.repartition("item"), up, up.select("node").union(up.select("ancestor")), ["date"])
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the lookup of nodes
    roles = H.tiers(groups, rationale)
    assert roles._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert {(r.node, r.role, r.contained) for r in roles.collect()} == {("1995", "MANDATORY", 2), ("1995H1", "ALTERNATIVE", 0)}
    found = H.select_before(groups.join(roles.select("item", "family", "node", "role", "alt_for", "place"), ["item", "family", "node"]), "hard", 2)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
