"""The index of the places that searches ask for, and what matches carry, against the plain forms."""

import random

from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.operators import match as M


def _rows(spark):
    rng = random.Random(3)
    toks = ["5711", "5711/1a", "rm35", "rm", "35-02", "126.500ln", "5711.1.x", "blue", "rot", "2021", "ab", "77k", "wtb", "rm35-02"]
    texts = [" ".join(rng.choices(toks, k=rng.randint(0, 9))) for _ in range(300)]
    ls = spark.createDataFrame([(f"{i:04}", t or None, f"s{i}", i) for i, t in enumerate(texts)], "listing_id string, listing_text string, seller string, rank_in int")
    asked = ["5711 blue", "35-02", "rm35 rot", "5711/1a", "126500ln 5711 blue", "57111x", "ab5711", "rm3502", "rot blue", "5711 2021"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id int, query_text string"), ls


def test_index_finds_every_spelling(spark):
    q, ls = _rows(spark)
    plain = M.token_table(ls).select("listing_id", "pos", F.explode_outer(M.reference_keys(F.col("tok"), F.col("tok_next"), F.col("tok_next2"))).alias("k"), "tok", "tok_next")
    plain = plain.where(F.col("tok").rlike("[0-9]") | F.col("tok_next").rlike("[0-9]"))
    want = {tuple(r) for r in plain.join(M.wanted_keys(q), "k").select("query_id", "listing_id", "pos", "ref").collect()}
    index = M.reference_index(q, ls)
    got = M.reference_candidates(q, ls).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    asked = {r.k for r in M.wanted_keys(q).collect()}
    assert {r.k for r in index.collect()} <= asked  # nothing else is shuffled
    assert {tuple(r) for r in M.reference_pairs(q, index).collect()} == {w[:2] for w in want}
    assert {r.listing_id for r in M.referenced_listings(q, index).collect()} == {w[1] for w in want}


def test_matches_carry_their_listings(spark):
    q, ls = _rows(spark)
    carry = ["listing_text", "seller", "rank_in"]
    index = M.reference_index(q, ls, carry)
    plain, carried = M.match_listings(q, ls).collect(), M.match_listings(q, ls, carry, index).collect()
    want = {tuple(r) for r in M.match_listings(q, ls).join(ls, "listing_id").select("query_id", "listing_id", *carry).collect()}
    assert {tuple(r) for r in carried} == want and len(carried) == len(plain) > 30
    assert not any((r.listing_text or "").startswith("wtb") for r in carried)
    local = {tuple(r) for r in M.local_descriptor_join(M.reference_candidates(q, ls), q, ls).collect()}
    assert {tuple(r) for r in M.local_matches(q, ls).collect()} == local


def test_more_keys_than_are_sent_give_the_same(spark, monkeypatch):
    q, ls = _rows(spark)
    want = sorted(map(tuple, M.match_listings(q, ls).collect()))
    monkeypatch.setattr(M, "SENT", 0)
    monkeypatch.setattr(M, "QUERIES_SENT", 0)
    assert sorted(map(tuple, M.match_listings(q, ls).collect())) == want


def test_local_words_by_one_pattern(spark):
    rng = random.Random(5)
    toks = ["2021", "77k", "1.5m", "hkd900", "900hkd", "hkd", "n12", "n12/2020", "12/20", "2020-11y", "5711", "571", "57-11", "5711/1a", "126500ln", "19991", "ab12", "a1",
            "grey", "choco", "cho", "rose", "gold", "white", "mother", "of", "pearl", "rose-gold", "blau"]
    rows = [(i, " ".join(rng.choices(toks, k=rng.randint(0, 18))), rng.randint(0, 5)) for i in range(3000)] + [(3000, None, 0)]
    df = spark.createDataFrame(rows, "i int, t string, pos int").withColumn("toks", T.tokens("t"))
    got = df.select(M.local_words("t", "pos").alias("a"), M._local_words("toks", "pos", 12).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(len(r.a) > 2 for r in got) > 500


def test_folding_of_plain_texts_skips_nothing(spark):
    df = spark.createDataFrame([("ÀB\u0301 Éß K",), ("\u212a2 E\u0301",), ("AB c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.fold("t")).collect()] == ["ab eß k", "k2 e", "ab c", "", ""]


def test_listings_are_read_once_where_every_search_names_a_reference(spark):
    q, ls = _rows(spark)
    named = q.where("query_text <> 'rot blue'")
    both = M.match_listings(q, ls)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan(both) and "Union" not in plan(M.match_listings(named, ls))
    want = {tuple(r) for r in both.join(named.select("query_id"), "query_id", "left_semi").collect()}
    assert {tuple(r) for r in M.match_listings(named, ls).collect()} == want and want


def test_classes_of_more_words_than_stand_beside_give_the_same(spark, monkeypatch):
    q, ls = _rows(spark)
    q = q.unionByName(spark.createDataFrame([(50, "blue rot"), (51, "rot"), (52, "ab")], q.schema))
    want = sorted(map(tuple, M.descriptor_classes(q, ls).collect()))
    pairs, of = [w[1:] for w in want if w[0] == "pair"], lambda kind: [w[1:] for w in want if w[0] == kind]
    whole = sorted((int(i), k) for a, b in pairs for i, x in of("query") if x == a for k, y in of("listing") if y == b)
    assert whole == sorted(map(tuple, M.descriptor_candidates(q, ls).collect())) and len(pairs) < len(whole)
    monkeypatch.setattr(M, "WORDS_BESIDE", 0)
    assert sorted(map(tuple, M.descriptor_classes(q, ls).collect())) == want


def test_lengths_of_keys_drop_no_place(spark, monkeypatch):
    q, ls = _rows(spark)
    row = lambda r: (r.listing_id, r.pos, r.k, tuple(r.local), r.non_sale)
    got = sorted(map(row, M.reference_index(q, ls).collect()))
    plain, none = q.where("query_id IN (0, 6, 7)"), q.where("query_id = 8")
    few = sorted(map(row, M.reference_index(plain, ls).collect()))
    seen = []
    cut = M._asked_for
    monkeypatch.setattr(M, "_asked_for", lambda rows, *a: seen.append(rows.count()) or cut(rows, *a))
    assert sorted(map(row, M.reference_index(plain, ls).collect())) == few and M.reference_index(none, ls).count() == 0
    monkeypatch.setattr(M, "LENGTHS", 0)  # more lengths than are looked at: every place is spelled
    assert sorted(map(row, M.reference_index(q, ls).collect())) == got and got
    assert sorted(map(row, M.reference_index(plain, ls).collect())) == few and few
    assert seen[0] < seen[-1]  # fewer keys are spelled for searches of few lengths
