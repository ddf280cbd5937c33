"""The rulebook on rule tables of its caller, odd rows, and its plans; literal searches are in the registered queries."""

import random

from lotwise.operators import rulebook as R


def plans(spark, rows, *rules):
    df = spark.createDataFrame(list(enumerate(rows)), "query_id int, query_text string")
    return R.annotate_query_plan(df, *rules)


def test_phrases_of_a_large_table_equal_a_direct_search(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    phrases = [("collection", i, " ".join(rng.choices(vocab, k=rng.randint(1, 3))), f"c{i % 400}", f"b{i % 60}") for i in range(600)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 8))) for _ in range(120)]
    rules = spark.createDataFrame(phrases, "source string, rule int, phrase string, name string, brand string")
    for r in plans(spark, texts, rules).collect():
        words = f" {texts[r.query_id]} "
        held = [p for p in phrases if f" {p[2]} " in words]
        assert r.collections == list(dict.fromkeys(p[3] for p in held))
        assert {b.brand: b.terms for b in r.brands} == {p[4]: p[2] for p in reversed(held)}
        assert [b.brand for b in r.brands] == list(dict.fromkeys(p[4] for p in held))


def test_odd_searches(spark):
    rows = {r.query_id: r for r in R.retrieval_plan(plans(spark, [None, "", "and or", "é", "5711 5711 blue", "blue " * 500])).collect()}
    for i in (0, 1, 2):
        assert (rows[i].intent_kind, rows[i].brands, rows[i].collections, rows[i].reasons) == ("free_text", [], [], ["reference.absent", "descriptor.absent"])
    assert rows[0].fetch == [None] and rows[1].fetch == [""]
    assert rows[4].fallback == ["5711", "nautilus 5711 blue"] and rows[4].reasons.count("collection.reference:nautilus") == 1
    assert rows[5].intent_kind == "free_text" and len(rows[5].optional) == 500
    assert R.expand_queries(plans(spark, ["x"]).limit(0)).count() == 0


def test_no_search_meets_every_rule(spark):
    text = R.expand_queries(plans(spark, ["rolex daytona panda"]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_expansion_rules_of_the_caller(spark):
    rules = spark.createDataFrame([(0, "daytona", None, [], [], [], True, ["a", "A ", "b"], ["m"], None, "code")], f"rule int, {R.EXPANSION_COLUMNS}")
    r = R.retrieval_plan(plans(spark, ["daytona black"]), rules).first()
    assert (r.fetch, r.match, r.fewer_than) == (["daytona black", "a", "b"], ["daytona black", "m"], None)
    assert r.retrieval_reasons == ["retrieval.raw_query", "code", "retrieval.duplicate_branch_skipped"]
