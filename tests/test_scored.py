"""Matches that are scored where a search meets a listing, against scores of the joined matches."""

import re

from pyspark.sql import functions as F

from lotwise.operators import evidence as E
from lotwise.operators import match as M
from lotwise.operators import similar as S
from lotwise.plans.queries import SCORED, joined, listings, offers, scored
from lotwise.sources.views import view


def _nodes(df):
    """Nodes of the optimized plan."""
    todo, out = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        out.append(todo.pop())
        todo += [out[-1].children().apply(i) for i in range(out[-1].children().size())]
    return out


def _columns(node):
    return [node.output().apply(i).name() for i in range(node.output().size())]


def test_scores_equal_those_of_joined_matches(spark, tiny):
    cols = ["query_id", "listing_id", "posted_date", "rank_in", *E.COMPONENTS]
    want = sorted(map(tuple, E.score_components(joined(spark, tiny)).select(*cols).collect()))
    assert sorted(map(tuple, scored(spark, tiny).select(*cols).collect())) == want and want
    index = M.reference_index(view(spark, tiny, "queries_v"), listings(spark, tiny), SCORED)
    also = scored(spark, tiny, index, size=F.length("listing_text"))
    got = sorted(map(tuple, also.select(*cols, "size").collect()))
    assert [g[:-1] for g in got] == want and all(g[-1] > 0 for g in got)


def test_ranking_deals_matches_once_and_without_texts(spark, tiny):
    ranked = E.rank_by_quality(scored(spark, tiny)).select("query_id", "listing_id", "rank")
    dealt = [c for n in _nodes(ranked) if n.nodeName() == "RepartitionByExpression" for c in _columns(n)]
    assert "query_id" in dealt and "severity" in dealt and not {"listing_text", "image_url", "issues", "query_text"} & set(dealt)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id", plan)) == 1


def test_pairs_of_searches_without_reference_are_mapped_too(spark):
    ls = spark.createDataFrame([("a", "5711 blue 2020"), ("b", "blue rot"), ("c", "wtb blue rot"), ("d", "rot 5711 5712 blue")], "listing_id string, listing_text string")
    q = spark.createDataFrame([(1, "5711 blue", "x"), (2, "rot blue", "y"), (3, "5712 5711 blue", "z")], "query_id int, query_text string, owner string")
    both = lambda rows: rows.withColumn("both", F.concat("owner", F.lit("-"), F.col("listing_text")))
    got = M.match_listings(q, ls, ["listing_text"], None, ["owner"], both, ["both"], ("query_id",))
    texts = {r.listing_id: r.listing_text for r in ls.collect()}
    want = {(r.query_id, r.listing_id, f"{'xyz'[r.query_id - 1]}-{texts[r.listing_id]}") for r in M.match_listings(q, ls).collect()}
    assert {tuple(r) for r in got.select("query_id", "listing_id", "both").collect()} == want and {w[0] for w in want} == {1, 2, 3}
    plain = M.match_listings(q, ls, ["listing_text"], ask=["owner"])
    assert {(r.query_id, r.listing_id, f"{r.owner}-{r.listing_text}") for r in plain.collect()} == want


def test_offers_give_the_pairs_of_joined_matches(spark, tiny):
    want = sorted(map(tuple, S.similar_pairs(joined(spark, tiny), 0.3, True).collect()))
    got = S.similar_pairs(offers(spark, tiny), 0.3, True)
    assert sorted(map(tuple, got.collect())) == want
    joins = lambda rows: sum(n.nodeName() == "Join" for n in _nodes(rows))
    assert joins(offers(spark, tiny)) < joins(joined(spark, tiny).select("query_id", "listing_id", "listing_text", "rank_in"))
