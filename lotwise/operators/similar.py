"""Similar offers of one query: pairs blocked by price, and groups of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from ..sources.shared import scratch
from .match import _asked_for

# Words that don't tell products apart.
STOP = ["and", "brand", "card", "cert", "full", "hkd", "set", "usd", "used", "watch", "with"]


#: Conditions of an offer and the words that name them.
CONDITIONS = {"new": ["new", "brandnew", "nos"], "used": ["used", "likenew"], "fullset": ["fullset"], "watchonly": ["watchonly"]}


def profile(rows: DataFrame) -> DataFrame:
    """rows (query_id, listing_id, rank_in, listing_text) with the word, price, reference and year sets and conditions, without the text."""
    text = F.regexp_replace(F.regexp_replace("listing_text", r"(?i)\bfull\s*set\b", "fullset"), r"(?i)([0-9]{2,3}mm)([0-9]{4})", "$1 $2")
    toks = T.tokens(text)
    is_reference = lambda t: (
        t.rlike("[0-9]") & ~t.rlike("^[0-9]{2,3}mm$") & ~t.rlike(r"^[0-9]+(\.[0-9]+)?[km]$") & ~t.rlike("^[0-9]+$") & ~t.rlike(T.CURRENCIES)
        & ((F.length(t) >= 4) | t.contains("/"))
    )
    return rows.select("query_id", "listing_id", "rank_in", "listing_text", toks.alias("toks")).select(
        "query_id", "listing_id", "rank_in",
        F.array_distinct(F.filter("toks", lambda t: t.rlike("^[a-z]+$") & ~t.isin(STOP))).alias("words"),
        F.array_distinct(F.filter("toks", is_reference)).alias("refs"),
        F.array_distinct(F.filter("toks", T.year_like)).alias("years"),
        *[F.arrays_overlap("toks", F.array(*map(F.lit, words))).alias(name) for name, words in CONDITIONS.items()],
        T.price_mentions("listing_text").alias("prices"),
    )


def _letters(c: str) -> Column:
    """How often a text of words has each letter and the blank."""
    signs = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz "))
    return F.transform(signs, lambda x: F.length(c) - F.length(F.replace(F.col(c), x, F.lit(""))))


def ratio_bound(a: str, b: str) -> Column:
    """What the sequence ratio of two spellings can't exceed: matching blocks hold no more of a letter than both texts do."""
    common = F.aggregate(F.zip_with(f"{a}_letters", f"{b}_letters", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    total = F.length(f"{a}_spelling") + F.length(f"{b}_spelling")
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def _conflict(a: str, b: str) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _condition_conflict() -> Column:
    meet = lambda x, y: (F.col(f"a_{x}") & F.col(f"b_{y}")) | (F.col(f"a_{y}") & F.col(f"b_{x}"))
    return meet("new", "used") | meet("fullset", "watchonly")


def similar_pairs(rows: DataFrame, least: float = 0.78, with_ratio: bool = False) -> DataFrame:
    """(query_id, a_listing_id, b_listing_id, a_rank_in, b_rank_in, score): offers of one query that agree in a price.

    Blocks are (query, price): the equi-join keeps quadratic work inside a block, and AQE splits a hot one. With
    with_ratio the pairs whose word overlap falls short are scored again by their sequence ratio, if the letters that they
    have in common allow it to be enough.
    """
    p = profile(rows)
    side = lambda s: p.select("query_id", *[F.col(c).alias(f"{s}_{c}") for c in p.columns if c not in ("query_id", "prices")], F.explode_outer("prices").alias("price"))  # noqa: E731  null prices join nothing
    both = side("a").join(side("b"), ["query_id", "price"]).where(
        (F.col("a_rank_in") < F.col("b_rank_in")) | ((F.col("a_rank_in") == F.col("b_rank_in")) & (F.col("a_listing_id") < F.col("b_listing_id")))
    )
    shared = F.size(F.array_intersect("a_words", "b_words"))
    least_words = F.least(F.lit(2), F.size("a_words"), F.size("b_words"))
    score = F.when((F.size("a_words") > 0) & (F.size("b_words") > 0), shared / F.size(F.array_union("a_words", "b_words"))).otherwise(0.0)
    both = both.where(~_conflict("a_refs", "b_refs") & ~_conflict("a_years", "b_years") & ~_condition_conflict() & (shared >= least_words))
    both = both.withColumn("score", score)
    keep = ["query_id", "a_listing_id", "b_listing_id", "a_rank_in", "b_rank_in", "score"]
    out = both.where(F.col("score") >= least)
    if with_ratio:  # Python sees few pairs
        rest = both.where(F.col("score") < least)
        rest = rest.withColumns({f"{x}_spelling": F.array_join(F.array_sort(f"{x}_words"), " ") for x in "ab"})
        rest = rest.withColumns({f"{x}_letters": _letters(f"{x}_spelling") for x in "ab"}).where(ratio_bound("a", "b") >= least)
        rest = rest.withColumn("score", sequence_ratio(F.col("a_spelling"), F.col("b_spelling"))).where(F.col("score") >= least)
        out = out.select(*keep).unionByName(rest.select(*keep))
    return out.select(*keep).distinct()


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts (the standard library's), on residual pairs only."""

    @pandas_udf("double")
    def ratio(x, y):
        import pandas as pd
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, i or "", j or "").ratio() for i, j in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


#: What makes an offer the one shown for its group, before the separators in its text, its rank and its id; of these
#: columns, those count that the rows have.
PRIMARY_ORDER = ["quality_group", "severity", "-reference_score", "-descriptor_score", "-price_score"]
SEPARATORS = ["- [ ]", " • ", " | "]


def primary_key(columns: list[str]) -> Column:
    """Struct whose least value in a group is its primary's."""
    keys = [-F.col(c[1:]) if c[0] == "-" else F.col(c) for c in PRIMARY_ORDER if c.strip("-") in columns]
    text = F.coalesce(F.col("listing_text"), F.lit("")) if "listing_text" in columns else F.lit("")
    marks = sum((((F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)).cast("int") for m in SEPARATORS), F.lit(0))
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*keys, marks])], "rank_in", "listing_id")


def group_similar(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows with group_id, group_size and is_primary: connected components of the pairs within a query, named by their
    first rank; the primary is the best by PRIMARY_ORDER, then fewest separators, then rank.

    Only offers with a pair have labels that may move; the others are groups of their own, whose rows meet theirs in one join
    by ids. Transitive by design. An offer takes the least label of its neighbours, hands it to the offer that named it so far,
    and then takes its new namesake's label, until no label moves: reach about doubles each round, whatever the length
    of a chain. Each round is written to the checkpoint folder (set spark.checkpoint.dir), so a lost executor costs one
    round.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "groups"))  # in the shared folder, or an error on a cluster that names none
    both = pairs.select("query_id", F.col("a_listing_id").alias("x"), F.col("b_listing_id").alias("y"))
    both = both.unionByName(both.select("query_id", F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    paired = both.select("query_id", F.col("x").alias("listing_id")).distinct()
    offer = ["query_id", "listing_id"]
    linked = rows.select(*offer, F.struct("rank_in", "listing_id").alias("label"), primary_key(rows.columns).alias("key"))
    linked = _asked_for(linked, offer, paired).join(paired, offer, "left_semi").checkpoint()
    labels = linked.select(*offer, "label")
    while True:
        of = lambda c: labels.select("query_id", F.col("listing_id").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        seen = both.join(of("x"), ["query_id", "x"]).groupBy("query_id", "y").agg(F.min("x_label").alias("low")).join(of("y"), ["query_id", "y"])
        offers = seen.select("query_id", F.explode(F.array("y", "y_label.listing_id")).alias("listing_id"), "low")
        offers = offers.groupBy("query_id", "listing_id").agg(F.min("low").alias("low"))
        met = labels.join(offers, ["query_id", "listing_id"], "left").withColumn("near", F.least("label", F.coalesce("low", "label"))).drop("low").checkpoint()
        named = met.groupBy("query_id", F.col("listing_id").alias("namesake")).agg(F.min("near").alias("far"))
        new = met.withColumn("namesake", F.col("near.listing_id")).join(named, ["query_id", "namesake"]).select(
            "query_id", "listing_id", F.least("near", "far").alias("next"), (F.least("near", "far") < F.col("label")).alias("moved")
        ).checkpoint()
        labels = new.select("query_id", "listing_id", F.col("next").alias("label"))
        if not new.where("moved").limit(1).count():
            break
    w = Window.partitionBy("query_id", "group_id")
    members = linked.drop("label").join(labels.select(*offer, F.col("label.listing_id").alias("group_id")), offer)
    members = members.withColumns({"group_size": F.count("*").over(w), "is_primary": F.col("key") == F.min("key").over(w)}).drop("key")
    alone = {"group_id": F.col("listing_id"), "group_size": F.lit(1), "is_primary": F.lit(True)}
    return rows.join(members, offer, "left").withColumns({c: F.coalesce(c, x) for c, x in alone.items()})
