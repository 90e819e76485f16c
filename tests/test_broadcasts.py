"""The per-root search broadcasts by numbers of rows, never by sizes of files."""

import pytest
from test_per_root import LINK, NODE, brute

from tidegraph import lineage
from tidegraph.operators import closure as cl
from tidegraph.operators import hydrate as hy

# Roots a lead to b and c, those to d and e; e is no type that may be entered.
PAIRS = [(("a", str(k)), (t, str(k % n))) for k in range(90) for t, n in (("b", 40), ("c", 7), ("e", 3))]
PAIRS += [(("b", str(k)), ("d", str(k % 5))) for k in range(40)] + [(("c", str(k)), ("b", str(k))) for k in range(3)]
ALLOWED = {(t, str(k)) for t, n in (("a", 90), ("b", 35), ("c", 6), ("d", 4)) for k in range(n)}
ROOTS = [("a", str(k)) for k in range(90)]


@pytest.mark.parametrize("few", [0, 20, 60])
def test_plans_hold_no_broadcast_of_more_rows(spark, monkeypatch, few):
    for module in (cl, hy):
        monkeypatch.setattr(module, "MAX_HOT_KEYS", few, raising=False)
    plans, settled = [], lineage.settled

    def planned(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return settled(df)

    for module in (lineage, cl, hy):
        monkeypatch.setattr(module, "settled", planned)
    resources = spark.createDataFrame([(*n, False, "") for n in sorted(ALLOWED)], f"{NODE}, deleted boolean, resource string")
    edges = spark.createDataFrame([(*a, *b) for a, b in PAIRS], LINK.replace("src", "from").replace("dst", "to"))
    # As files these tables are far below the planner's limit.
    rows = hy.hydrate_keys(lineage.settled(resources), lineage.settled(edges), spark.createDataFrame(ROOTS, NODE))
    plans.append(rows._jdf.queryExecution().sparkPlan().toString())
    got = [(r.root_type, r.root_id, r.type, r.id) for r in rows.filter("role = 'included'").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(PAIRS, ROOTS, ALLOWED)
    joins = sum(plan.count("BroadcastHashJoin") for plan in plans)
    assert joins == 0 if few == 0 else joins > 0
    assert any("SortMergeJoin" in plan for plan in plans)


def test_a_round_gets_only_links_out_of_its_types(spark):
    links = spark.createDataFrame([(*a, *b) for a, b in PAIRS], "type string, id string, dst_type string, dst_id string")
    inner = cl._Inner(links, cl._entering(spark.createDataFrame(sorted(ALLOWED), NODE)))
    named = lambda types: [(p.sources, p.rows) for p in inner.out_of(types)]
    first = (["b"], 32)  # eight of b's links lead to a d that may not be entered
    assert named(["b"]) == [first]
    assert named(["c", "d"]) == [(["c"], 3)]
    assert named(["b", "c"]) == [first, (["c"], 3)]
    assert named(["d"]) == [] == named([])
