"""Queries whose pairs are judged where a search meets a listing: the same rows as the plain forms, and no texts of pairs in a shuffle."""

import pytest
from pyspark.sql import functions as F
from test_index import _rows
from test_scored import _columns, _nodes

from lotwise.functions import text as T
from lotwise.operators import evidence as E
from lotwise.operators import intent as N
from lotwise.operators import match as M
from lotwise.operators import similar as S
from lotwise.plans import more  # noqa: F401  registers its queries
from lotwise.plans.queries import QUERIES, offers
from lotwise.sources.shared import written


def _dealt(df):
    """Columns of every step that deals rows anew."""
    return [set(_columns(n)) for n in _nodes(df) if n.nodeName() == "RepartitionByExpression"]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_near_pairs_equal_candidates_without_matches(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "QUERIES_SENT", sent)
    q, ls = _rows(spark)
    text, ref = E.fuzzy_score("query_text", "listing_text")
    parsed = M.reference_candidates(q, ls).select("query_id", "listing_id").distinct().join(q, "query_id").join(ls, "listing_id")
    parsed = parsed.withColumns({"reference_score": ref, "descriptor_score": text, "overall_score": ((ref + text) / 2).cast("int")})
    want = M.ambiguous_candidates(parsed, M.match_listings(q, ls), ["query_id", "listing_id"]).select("query_id", "listing_id")
    asked = q.withColumn("asked", E.fuzzy_words("query_text")).withColumn("first_ref", E.first_reference(F.col("asked")))
    text, ref = E.fuzzy_score_of(F.col("asked"), F.col("first_ref"), F.col("shown"))
    scores = lambda rows: rows.withColumns({"reference_score": ref, "descriptor_score": text, "overall_score": ((ref + text) / 2).cast("int")})
    got = M.ambiguous_pairs(asked, ls.withColumn("shown", E.fuzzy_words("listing_text")), ["shown"], ["asked", "first_ref"], scores)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_ambiguous_candidates_are_dealt_once_without_texts(spark, tiny):
    got = QUERIES["j6_ambiguous_candidates"](spark, tiny)
    pairs = [c for c in _dealt(got) if "query_id" in c]
    assert len(pairs) == 1 and not {"listing_text", "query_text", "shown", "asked"} & pairs[0]
    assert not any("LeftAnti" in n.toString().split("\n")[0] for n in _nodes(got))


def test_only_offers_with_a_pair_are_labelled(spark, monkeypatch):
    rows = [(q, f"{i:03}", i, f"oliven kupfer {i // 2 if i < 6 else 'w' * i} 77700 hkd", i % 2) for q in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, listing_id string, rank_in int, listing_text string, quality_group int")
    pairs = spark.createDataFrame([(1, "000", "001"), (1, "001", "002"), (2, "004", "009")], "query_id int, a_listing_id string, b_listing_id string")
    kept, whole = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda x, *a: kept.append((x.columns, x.count())) or whole(x, *a))
    got = {(r.query_id, r.listing_id): (r.group_id, r.group_size, r.is_primary) for r in S.group_similar(df, pairs).collect()}
    assert len(got) == 80 and kept and all(n <= 6 and "listing_text" not in cols for cols, n in kept)
    assert [got[1, i] for i in ("000", "001", "002", "003")] == [("000", 3, True), ("000", 3, False), ("000", 3, False), ("003", 1, True)]
    assert [got[2, i] for i in ("004", "009", "000")] == [("004", 2, True), ("004", 2, False), ("000", 1, True)]
    monkeypatch.setattr(M, "SENT", 0)
    assert {(r.query_id, r.listing_id): (r.group_id, r.group_size, r.is_primary) for r in S.group_similar(df, pairs).collect()} == got


def test_sides_of_pairs_have_no_texts(spark, tiny):
    assert not {"listing_text", "all_words", "letters", "spelling"} & set(S.profile(offers(spark, tiny)).columns)


def test_pairs_at_hand_match_as_the_index_has_them(spark):
    q, ls = _rows(spark)
    q = q.unionByName(spark.createDataFrame([(50, "5711"), (51, "3502 rot"), (52, "35-02 5711"), (53, "2021"), (54, "")], q.schema))
    offers_ = ls.where(~T.is_non_sale("listing_text")).withColumn("toks", T.tokens("listing_text")).withColumn("plain", M.plain_text("toks"))
    pairs = M.query_terms(q).crossJoin(offers_)
    got = pairs.where(M.pair_matches("refs", "descs", "toks", "plain")).select("query_id", "listing_id")
    want = sorted(map(tuple, M.match_listings(q, ls).collect()))
    assert sorted(map(tuple, got.collect())) == want and {w[0] for w in want} >= {0, 1, 2, 3, 4, 5, 8, 50, 52, 53}


def test_filtered_sources_write_ids_alone(spark, tiny, monkeypatch):
    kept = []
    monkeypatch.setattr(N, "written", lambda df, name: kept.append((name, df.columns)) or written(df, name))
    rows = QUERIES["f3_prefiltered_match"](spark, tiny)
    assert {r.kept_by for r in rows.collect()} == {"match", "source", "image"}
    assert [k for k in kept if "listing_id" in k[1]] == [("judged", ["query_id", "listing_id", "policy", "rank_in", "kept_by"])]


def test_searches_without_matches_keep_other_rows(spark):
    ls = [("a", 3, "5711 rot", "x"), ("b", 2, "5711 gelb", "x"), ("c", 1, "5711 gelb", None), ("d", 0, "wtb 5711", "x"), ("e", 4, "57112 blue", "x")]
    cols = "listing_id string, rank_in int, listing_text string, image_url string"
    q = spark.createDataFrame([(1, "5711"), (2, "57119"), (3, "57119 gelb"), (4, "5711 lila"), (5, "5711 rot"), (6, "gelb oliv")], "query_id int, query_text string")
    rows = q.select("query_id").crossJoin(spark.createDataFrame(ls, cols))
    got = sorted((r.query_id, r.listing_id, r.kept_by) for r in N.prefiltered_match(rows, q).collect())
    want = [(1, x, "match") for x in "abc"] + [(2, x, "source") for x in "abce"] + [(4, "a", "image"), (4, "b", "image"), (5, "a", "match")]
    assert got == want
