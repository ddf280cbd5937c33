"""Guardrails and final blocks on odd rows; every rule by literal cases is in the registered queries."""

from lotwise.operators import guardrails as G
from lotwise.operators import rulebook as R


def test_odd_matches(spark):
    rows = [(1, "61234 white", None, None), (2, None, "x", "y"), (3, "61234 white", "61234 white", "61234 white"), (3, "61234 white", "61234 white", "61234 white"), (4, "rolex daytona 5", "", ""), (5, "61234 white", "61234 " + "w " * 2000 + "white tag", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "query_id int, query_text string, listing_text string, raw_listing_text string, refs string").where("query_id < 9")
    plans = R.annotate_query_plan(df.select("query_id", "query_text"))
    out = G.with_guardrails(df, plans, ["query_id"])
    got = sorted((r.query_id, r.guardrail_group, tuple(r.guardrail_reasons)) for r in out.collect())
    product = (3, 0, ("evidence.product_color:white",))
    assert got == [(1, 0, ()), (2, 0, ()), product, product, (4, 1, ("guardrail.brand_model_phrase_missing",)), (5, 0, ())]
    kept, blocked = G.block_final(out, plans)
    assert sorted(r.query_id for r in kept.collect()) == [1, 2, 3, 3, 5] and [(r.query_id, r.guardrail_action) for r in blocked.collect()] == [(4, "block_from_final")]
    alone = G.with_guardrails(df, plans.limit(0), ["query_id"])
    assert {(r.guardrail_group, r.alias_score) for r in alone.collect()} == {(0, 0)}


def test_matches_are_guarded_row_by_row(spark, tiny):
    from pyspark.sql import functions as F

    from lotwise.plans import guards

    texts = [c[:3] for c in guards.CASES] + [("61234 blue", t, None) for t in ("61234 blue red 5711x", "61234 rot black tag", "61234 é bläck rednew", "61234 cho", "61234 grey dial", "61234 blue", None)]
    texts += [("61234 rg", f"61234 {t}", t) for t in ("rose gold white gold", "whitegold", "rot", "rosegold")] + [("panda daytona 61234", "61234 daytona x", None), (None, None, None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "query_id int, query_text string, listing_text string, raw_listing_text string")
    plans = R.annotate_query_plan(rows.select("query_id", "query_text"))
    out = ["query_id", "guardrail_group", "guardrail_reasons", "alias_score", "alias_reason"]
    want = sorted(map(str, G.with_guardrails(rows, plans, ["query_id"]).select(*out).collect()))
    beside = rows.join(G.asked_plans(plans), "query_id", "left")
    assert sorted(map(str, G.guard_matches(beside).select(*out).collect())) == want and len(set(want)) == len(texts)
    looked = {r.query_text: r.n for r in beside.groupBy("query_text").agg(F.count_if(G._looked_into()).alias("n")).collect()}
    assert looked["61234"] == 0 and 0 < looked["61234 blue"] < 6 and looked["61234 rg"] == 2


def test_ranking_by_plan_writes_no_matches(spark, tiny):
    from test_scored import _columns, _nodes

    from lotwise.plans import guards

    ranked = guards.w4_rank_by_plan(spark, tiny)
    dealt = [c for n in _nodes(ranked) if n.nodeName() == "RepartitionByExpression" for c in _columns(n)]
    assert "query_id" in dealt and "alias_score" in dealt and not {"listing_text", "image_url", "query_text", "__required"} & set(dealt)
