"""Dedupe of listings in input order: exact, newest of a product, and across sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exact_key() -> list[Column]:
    return [T.normalize_text(F.col(c).cast("string")) for c in ("listing_text", "seller", "posted_date")]


def dedupe_exact(listings: DataFrame, order: str = "rank_in") -> DataFrame:
    """First row of each normalised (text, seller, date)."""
    w = Window.partitionBy(*exact_key()).orderBy(order)
    return listings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def product_references(c: str) -> Column:
    """Tokens with a digit that are no date, year, k/m amount or currency; plain prices count as references here."""
    toks = T.tokens(c)
    keep = lambda t: (
        t.rlike("[0-9]") & ~t.rlike("^n?[0-9]{1,2}[/-][0-9]{2,4}y?$") & ~t.rlike(r"^[0-9]+(\.[0-9]+)?[km]$")
        & ~T.year_like(t) & ~t.rlike(T.CURRENCIES) & ((F.length(t) >= 4) | t.contains("/"))
    )
    return F.array_distinct(F.filter(toks, keep))


def product_prices(c: str) -> Column:
    """Distinct compact spellings of the amounts with a currency, thousands groups or k/m."""
    cur = T.CURRENCIES
    # The amounts that count as a product's price here.
    rx = (
        rf"(?:[$€£¥]\s*[0-9]+(?:[,\s.][0-9]+)*[km]?\s*(?:{cur})?|\b(?:{cur})\s*(?:[0-9]{{3,}}(?:[,\s.][0-9]+)*[km]?|[0-9]+(?:\.[0-9]+)?[km])"
        rf"|\b[0-9]{{1,3}}(?:[,\s.][0-9]{{3}})+(?:\.[0-9]+)?\s*(?:{cur})?\b|\b[0-9]+(?:\.[0-9]+)?[km]\b)"
    )
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(rx), F.lit(0))
    return F.array_distinct(F.transform(found, T.compact_text))


def latest_key(c: str = "listing_text") -> Column:
    refs, prices = product_references(c), product_prices(c)
    text = F.when(F.size(refs) == 0, T.normalize_text(c)).otherwise(F.array_join(F.concat(refs, prices), " "))
    return F.concat_ws("|", text, T.normalize_text("seller"))


def _newest(listings: DataFrame, key: Column, order: str, date: str) -> DataFrame:
    """Newest row of each key (undated and tied rows: the earlier), in the place of the key's first row."""
    rows = listings.withColumn("__key", key)
    best = Window.partitionBy("__key").orderBy(F.col(date).desc_nulls_last(), order)
    rows = rows.withColumns({"__n": F.row_number().over(best), "slot": F.min(order).over(Window.partitionBy("__key"))})
    return rows.where("__n = 1").drop("__n", "__key")


def dedupe_latest(listings: DataFrame, order: str = "rank_in", date: str = "posted_date") -> DataFrame:
    """Newest listing of each product and seller; `slot` is where the product first appeared."""
    return _newest(listings, latest_key(), order, date)


def dedupe_text(listings: DataFrame, order: str = "rank_in", date: str = "posted_date") -> DataFrame:
    """Newest listing of each normalised text, whoever sells it."""
    return _newest(listings, T.normalize_text("listing_text"), order, date)


def merge_candidates(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Ordered union without repeats: a row of an earlier branch, then of an earlier place, wins."""
    rows = first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("branch", "rank_in")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def distinct_queries(queries: DataFrame) -> DataFrame:
    """First query of each normalised text."""
    w = Window.partitionBy(T.normalize_text("query_text")).orderBy("query_id")
    return queries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
