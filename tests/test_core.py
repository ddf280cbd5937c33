"""Literal cases of the listing operators, and every query beside its DuckDB twin at the smallest scale."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.functions import text as T
from lotwise.operators import audit as A
from lotwise.operators import dedupe as D
from lotwise.operators import evidence as E
from lotwise.operators import issues as I
from lotwise.operators import match as M
from lotwise.operators import similar as S
from lotwise.operators.suspicious import with_issues
from lotwise.plans import contracts, files, funnels, guards, markup, more, rulebook, segments, streams  # noqa: F401  they register their queries
from lotwise.plans.queries import ORACLES, QUERIES
from lotwise.sources.views import view

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("Pátek  5711/1A-010 BLUE!", "patek 5711/1a-010 blue"), (None, ""), ("8️⃣0️⃣k", "80k"), ("", ""), ("…", "")],
)
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize_text("t")) == want


@pytest.mark.parametrize(
    ("query", "refs", "descs"),
    [("5711/1A blue", ["5711/1a"], ["blue"]), ("612345 and oliv 2022", ["612345"], ["oliv", "2022"]), ("15202 or blue", ["15202or"], ["blue"]),
     ("rose gold chocolate", [], ["rg", "choco"]), ("", [], []), (None, [], [])],
)
def test_query_terms(spark, query, refs, descs):
    got = spark.createDataFrame([(query,)], "t string").select(*[c.alias(n) for c, n in zip(T.parse_query_terms("t"), "rd", strict=True)]).first()
    assert (got.r, got.d) == (refs, descs)


@pytest.mark.parametrize(
    ("text", "prices"),
    [("91234Q oliv 82.5k 61000", [82500, 61000]), ("HKD 780,000", [780000]), ("$1.2m new", [1200000]), ("no price 1997", []), (None, [])],
)
def test_prices(spark, text, prices):
    assert sorted(one(spark, text, T.price_mentions("t"))) == sorted(prices)


def test_small_text_functions(spark):
    assert one(spark, "wtb 5711", T.is_non_sale("t")) and one(spark, "Looking for 5711", T.is_non_sale("t"))
    assert not one(spark, "5711 wtb", T.is_non_sale("t")) and not one(spark, None, T.is_non_sale("t"))
    assert one(spark, "May 8, 2026 · reposted", T.parse_posted_date("t")) == dt.datetime(2026, 5, 8)
    assert one(spark, "yesterday", T.parse_posted_date("t")) is None
    assert one(spark, "+852 9123-4567", T.clean_phone("t")) == "85291234567"
    assert one(spark, "0123", T.clean_phone("t")) is None
    assert one(spark, "ftp://x", T.normalize_url("t", "https://a.example")) is None
    assert one(spark, "token = abc123 rest", T.redact("t")) == "token=[redacted] rest"
    assert one(spark, "like new", T.clean_display_text("t")) == "like new"
    assert one(spark, "5711 New", T.clean_display_text("t")) == "5711"
    assert one(spark, "rose gold", T.conflict_descriptors(T.canonical_tokens(T.tokens("t")))) == ["wg"]


def test_dedupe_latest_keeps_newer_in_first_place(spark):
    rows = [(1, "7284H New 3/2023 $777,000 HKD", "s", "2026-05-08"), (2, "7284H New 3/2023 777 000 HKD", "s", "2026-05-09"), (3, "7284H 910k", "s", None)]
    df = spark.createDataFrame(rows, "rank_in int, listing_text string, seller string, d string").withColumn("posted_date", F.to_date("d"))
    got = {(r.rank_in, r.slot) for r in D.dedupe_latest(df).collect()}
    assert (3, 3) in got and len(got) == 2
    assert {r.rank_in for r in D.dedupe_exact(df.unionByName(df.withColumn("rank_in", F.col("rank_in") + 10))).collect()} == {1, 2, 3}


def test_similar_groups(spark):
    rows = [(1, "a", 1, "612345 oliv full set 30.5k"), (1, "b", 2, "612345 oliv full set 30.5k"), (1, "c", 3, "612345 oliv full set 31.5k"), (1, "d", 4, "612345 oliv full set 2019 30.5k"), (2, "a", 1, "x")]
    df = spark.createDataFrame(rows, "query_id int, listing_id string, rank_in int, listing_text string")
    pairs = S.similar_pairs(df.where("listing_id != 'd'"), with_ratio=True)
    got = {(r.query_id, r.listing_id): (r.group_id, r.group_size, r.is_primary) for r in S.group_similar(df, pairs).collect()}
    assert got[(1, "b")] == ("a", 3, False)  # a plain number of six digits counts as a shared price
    assert got[(2, "a")] == ("a", 1, True)


def test_chains_longer_than_any_number_of_rounds(spark):
    order = [i * 37 % 101 for i in range(101)]  # 0 comes first, the labels along the second chain are mixed
    links = [(1, i, i + 1) for i in range(50)] + [(2, *sorted(p)) for p in zip(order, order[1:], strict=False)] + [(3, 7, 9)]
    pairs = spark.createDataFrame(links, "query_id int, a_listing_id int, b_listing_id int")
    rows = [(q, i, i) for q, n in ((1, 51), (2, 101), (3, 10)) for i in range(n)]
    got = S.group_similar(spark.createDataFrame(rows, "query_id int, listing_id int, rank_in int"), pairs).collect()
    assert len(got) == len(rows)
    for r in got:
        lone = r.query_id == 3 and r.listing_id not in (7, 9)
        want = (r.listing_id, 1) if lone else {1: (0, 51), 2: (0, 101), 3: (7, 2)}[r.query_id]
        assert (r.group_id, r.group_size) == want and r.is_primary == (r.listing_id == want[0])


def test_descriptor_candidates_of_all_queries(spark, tiny):
    plain = lambda t: {w for w in t.lower().split() if not any(c.isdigit() for c in w)}
    q = [(r.query_id, plain(r.query_text)) for r in view(spark, tiny, "queries_v").collect()]
    ls = [(r.listing_id, set(r.listing_text.lower().split())) for r in view(spark, tiny, "listings_v").collect()]
    got = QUERIES["j3_descriptor_candidates"](spark, tiny).collect()
    assert sorted((r.query_id, r.listing_id) for r in got) == sorted((i, k) for i, ds in q if ds for k, t in ls if ds <= t)
    assert max(r.query_id for r in got) > 100


def test_order_results_places_every_row_in_five_modes(spark):
    day = lambda i: None if i % 7 == 0 else dt.date(2024, 1, 1 + i % 5)
    rows = [(f"{i:04}", i * 37 % 1501, None if i % 3 == 0 else i % 11, day(i), None if i % 13 == 0 else "ab"[i % 2]) for i in range(1501)]
    df = spark.createDataFrame(rows, "listing_id string, rank_in int, price int, posted_date date, seller string")
    keys = {
        "rank": lambda r: (), "seller": lambda r: r[4] or "", "price_asc": lambda r: (r[2] is None, r[2] or 0), "price_desc": lambda r: (r[2] is None, -(r[2] or 0)),
        "posted_desc": lambda r: (r[3] is None, -r[3].toordinal() if r[3] else 0),
    }
    for mode, key in keys.items():
        got = {r.place: r.listing_id for r in E.order_results(df, mode).collect()}
        assert [got[i + 1] for i in range(len(got))] == [r[0] for r in sorted(rows, key=lambda r: (key(r), r[1], r[0]))]


SUSPICIOUS = [
    ("4821 blue HKD", None, "ends_with_currency"), ("4821 blue 90k HKD", None, ""), ("4821 blue USD HKD", None, "missing_price_evidence"),
    ("4821 blue price", None, "ends_with_price_marker"), ("4821 blue 💰", None, "ends_with_price_marker"), ("4821 blue 90,000", None, ""),
    ("4821 HKD new", "4821 HKD 90k new", ""), ("4821 blue HKD new", "4821 blue HKD 90k new", "missing_price_after_currency"), ("4821 new", "4821 new $95000", "missing_price_after_currency"),
    ("4821 blue 90k", "4821 blue 90k " + "and much more text " * 5, ""), ("4821 blue", "4821 blue " + "and much more text " * 5, "raw_much_longer"),
    ("4821 blue", "stock list 4821x blue 7790/2b red", "scoped_stock_list_missing_price"), ("Patek ref 4821/1A", None, "reference_only_fragment"),
    ("wtb 4821/1A", None, ""), ("4821 18k rose gold", None, "missing_price_evidence"), ("no reference", None, ""), ("", "4821 HKD 90k", ""), (None, None, ""),
]


def test_suspicious_rules(spark):
    rows = [(i, t, r) for i, (t, r, _) in enumerate(SUSPICIOUS)]
    got = with_issues(spark.createDataFrame(rows, "i int, t string, r string"), "t", "r").orderBy("i").collect()
    assert [",".join(x.reason for x in r.issues) for r in got] == [w for _, _, w in SUSPICIOUS]
    assert [r.t for r in got] == [t for t, _, _ in SUSPICIOUS]
    assert one(spark, "HK STOCK LIST 116505 5712g", E.scope_reason("t", "t")) == "scope.full_listing"
    assert one(spark, "18k gold 5711", E.has_price("t")) is False


def test_match_needs_local_descriptor(spark):
    q = spark.createDataFrame([(1, "5711 blue"), (2, "panda"), (3, "5712g")], "query_id int, query_text string")
    rows = [("a", "patek 5711 blue new 100k"), ("b", "patek 5711 15202st blue"), ("c", "wtb 5711 blue"), ("d", "daytona panda"), ("e", "rm5712-g nice"), ("f", "5712G/1 white")]
    ls = spark.createDataFrame(rows, "listing_id string, listing_text string")
    got = {(r.query_id, r.listing_id) for r in M.match_listings(q, ls).collect()}
    assert got == {(1, "a"), (2, "d"), (3, "f")}


def test_audit_rates_literal(spark):
    stages = ["raw", "parsed", "weak_match", "ambiguous_candidate", "dedupe_drop", "final"]
    rows = [("q", s, False, 52, "scope.stock_list") for s in stages]
    r = A.audit_rates(spark.createDataFrame(rows, "query string, stage string, has_image boolean, fuzzy_score int, scope_reason string")).first()
    assert (r.weak_rate, r.ambiguous_rate, r.dedupe_drop_rate, r.low_fuzzy, r.missing_image_rate, r.stock_list_rate) == (1, 1, 1, 1, 1, 1)


def test_alias_recall_literal(spark):
    rows = [("c", 1, "x", 29, True, 1), ("c", 1, "y", 27, True, 2), ("d", 1, "z", 11, True, 3)]
    got = A.alias_recall(spark.createDataFrame(rows, "canonical_query string, run_number int, query string, total_count int, ok boolean, event_id int")).collect()
    assert [(r.low, r.high, r.delta, r.ok) for r in got] == [(27, 29, 2, True)]


def test_null_reporters_are_one(spark):
    rows = [(1, "q", 1, "other", None, "t", None), (2, "q", 1, "other", None, "t", "n"), (3, "q", 1, "other", 7, "t", "m")]
    df = spark.createDataFrame(rows, "report_id int, query_text string, result_rank int, reason string, reporter_id int, listing_text string, notes string").withColumn("reported_at", F.lit("x"))
    assert sorted((r.report_count, r.notes) for r in I.upsert_feedback(df).collect()) == [(1, "m"), (2, "n")]


@pytest.fixture(scope="session")
def con(tiny):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in NAMES:
        p = f"{tiny}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def canon(df):
    def text(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return ""
        if pd.api.types.is_number(x) and not pd.api.types.is_bool(x):
            return repr(round(float(x), 9))
        return str(x).replace(" 00:00:00", "")

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, tiny, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
