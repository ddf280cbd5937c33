"""Sources and sinks: JSON posts, HTML pages, query lists, audit logs, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

NESTED = "struct<title:string,brand:string,model:string,reference:string,normalizedReference:string,dialColor:string,frontImage:string,imageUrl:string,image_url:string>"
ITEM = (
    "struct<title:string,companyName:string,fromName:string,companyWhatsapp:string,whatsappNumber:string,phoneNumber:string,number:bigint,createdOn:string,"
    f"repostedAt:string,dialColor:string,frontImage:string,imageUrl:string,image_url:string,listings:array<{NESTED}>>"
)


def listings_from_json(raw: DataFrame, column: str = "body") -> DataFrame:
    """One row for each item of `{"listings": [...]}` or `[...]`; bodies that are neither, and bad JSON, give none."""
    body = F.trim(F.col(column))
    texts = F.when(body.startswith("{"), F.from_json(body, "struct<listings:array<string>>").listings).when(body.startswith("["), F.from_json(body, "array<string>"))
    rows = raw.select("page_id", F.posexplode_outer(texts).alias("item_no", "one")).where(F.col("one").startswith("{"))  # objects only
    rows = rows.select("page_id", "item_no", F.from_json("one", ITEM).alias("i")).where("i IS NOT NULL")
    image = F.coalesce("i.frontImage", "i.imageUrl", "i.image_url")
    out = rows.select(
        "page_id", "item_no", T.squeeze("i.title").alias("listing_text"), T.squeeze(F.coalesce("i.companyName", "i.fromName")).alias("seller"),
        T.clean_phone("i.companyWhatsapp", "i.whatsappNumber", "i.phoneNumber").alias("seller_phone"),
        T.posted_date_text(F.try_to_timestamp(F.substring(F.coalesce("i.repostedAt", "i.createdOn"), 1, 10), F.lit("yyyy-MM-dd"))).alias("posted_date"),
        image.alias("image_url"), F.when(F.col("i.number").isNotNull(), F.concat(F.lit("/flash-sales/"), F.col("i.number").cast("string"))).alias("source_url"),
        F.col("i.dialColor").alias("color"), F.col("i.listings").alias("nested"),
    )
    first = Window.partitionBy("listing_text", "seller", "posted_date", "source_url").orderBy("page_id", "item_no")
    return out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def explode_nested(items: DataFrame) -> DataFrame:
    """Items plus a row for each nested item with another text; a nested image passes on only between equal colours."""
    n = items.select("*", F.posexplode("nested").alias("nested_no", "s"))
    text = T.squeeze(F.concat_ws(" ", "s.dialColor", "s.brand", "s.model", F.coalesce("s.reference", "s.normalizedReference"), "s.title"))
    own = F.coalesce("s.frontImage", "s.imageUrl", "s.image_url")
    image = F.coalesce(own, F.when(F.lower("s.dialColor") == F.lower("color"), F.col("image_url")))
    n = n.withColumns({"parent_text": F.col("listing_text"), "listing_text": text, "image_url": image}).drop("s", "nested", "color")
    n = n.where("listing_text IS NOT NULL AND lower(listing_text) <> lower(parent_text)")
    head = items.withColumn("nested_no", F.lit(-1)).withColumn("parent_text", F.lit(None).cast("string")).drop("nested", "color")
    return head.unionByName(n)


# How stock lists and the references in them look.
STOCK_LIST = r"(?i)\b(?:hk\s+)?stock\s+list\b|\bstocklist\b"
PRODUCT_REFERENCE = r"(?i)\b(?=[a-z0-9/.-]*[0-9])[a-z0-9]+(?:[./-][a-z0-9]+)*\b"
CONDITION_DATE = r"(?:n?[0-9]{1,2}|[0-9]{1,2}n)[/-][0-9]{2,4}y?|[0-9]{2,4}[/-](?:n?[0-9]{1,2}|[0-9]{1,2}n)y?|[0-9]{4}\.[0-9]{1,2}y?"
SEGMENT_EDGES = r" \t\r\n\-–—•*|,;:"
SEGMENT_CODES = ["segment.stock_list_marker", "segment.reference_boundary"]


def split_stock_lists(posts: DataFrame, key: str = "bundle_id", column: str = "raw_listing_text") -> DataFrame:
    """(key, item_no, listing_text, raw_listing_text, scope_reason, reason_codes): a row for each item of a stock list.

    A post with a stock list's marker and two different references is cut at its references, each item running up to the
    next one; the parent's text stays beside it. Plain prices of four digits and more count as references. Other posts
    stay whole, with a null scope and no codes; null posts give one row without text.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(PRODUCT_REFERENCE), F.lit(0))
    rows = posts.select(key, F.col(column).alias("raw_listing_text"), words(F.col(column)).alias("raws"), F.split(F.col(column), PRODUCT_REFERENCE, -1).alias("gaps"))

    def is_reference(word: Column) -> Column:
        w = F.lower(word)
        dated = w.rlike(f"^(?:{CONDITION_DATE})$") | T.year_like(w) | w.rlike(r"^[0-9]+(?:\.[0-9]+)?[km]$")
        return ~dated & ~w.rlike("hkd|usd|usdt|eur|aed") & ((F.length(w) >= 4) | w.contains("/"))

    at = F.filter(F.transform("raws", lambda w, i: F.when(is_reference(w), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at)
    several = F.size(F.array_distinct(F.transform("at", lambda i: F.lower(F.get("raws", i))))) > 1
    listed = F.col("raw_listing_text").rlike(STOCK_LIST) & several
    rows = rows.withColumn("listed", F.coalesce(listed, F.lit(False)))

    def item(i: Column, n: Column) -> Column:
        words = F.slice("raws", i + 1, F.coalesce(F.get("at", n + 1), F.size("raws")) - i)
        text = F.array_join(F.transform(words, lambda w, j: F.concat(w, F.get("gaps", i + j + 1))), "")
        return T.squeeze(F.regexp_replace(text, f"^[{SEGMENT_EDGES}]+|[{SEGMENT_EDGES}]+$", ""))

    items = F.when(F.col("listed"), F.filter(F.transform("at", item), lambda x: x.isNotNull())).otherwise(F.array("raw_listing_text"))
    rows = rows.select(key, "raw_listing_text", "listed", F.posexplode_outer(items).alias("item_no", "listing_text"))
    return rows.select(
        key, "item_no", "listing_text", "raw_listing_text", F.when(F.col("listed"), "scope.stock_list").alias("scope_reason"),
        F.when(F.col("listed"), F.array(*map(F.lit, SEGMENT_CODES))).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, query_text): lines that aren't blank or comments, squeezed, first of equal ones; line_no is file order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    rows = lines.select("line_no", T.squeeze("value").alias("query_text")).where("query_text IS NOT NULL AND NOT startswith(query_text, '#')")
    first = Window.partitionBy(F.lower("query_text")).orderBy("line_no")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


AUDIT = "type string, query string, stage string, decision string, reason_codes array<string>, fuzzy_score int, has_image boolean, scope_reason string, final array<struct<rank:int,has_image:boolean,scope_reason:string,reason_codes:array<string>>>"


def read_audit_artifacts(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """Event rows of JSON lines, and of per-query reports a summary row and a row for each final result; loose types are null."""
    rows = spark.read.schema(AUDIT).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(paths)
    events = rows.where("final IS NULL").drop("final")
    reports = rows.where("final IS NOT NULL")
    summary = reports.drop("final").withColumn("stage", F.lit("query_summary"))
    finals = reports.select("query", F.explode("final").alias("f")).select("query", F.lit("final_result").alias("stage"), "f.*")
    return events.unionByName(summary).unionByName(finals, allowMissingColumns=True)


def read_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


RESULT_COLUMNS = ["rank", "listing_id", "listing_text", "seller", "posted_date", "image_url", "source_url"]


def write_results_csv(results: DataFrame, path: str) -> None:
    """Seven columns, every value quoted, quotes doubled."""
    results.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RESULT_COLUMNS]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_audit_jsonl(summary: DataFrame, events: DataFrame, finals: DataFrame, path: str) -> None:
    """Rows as JSON lines; per query the summary, then events, then final rows."""
    tag = lambda df, n: df.withColumn("part", F.lit(n))
    rows = tag(summary, 0).unionByName(tag(events, 1), allowMissingColumns=True).unionByName(tag(finals, 2), allowMissingColumns=True)
    rows.repartition("query").sortWithinPartitions("query", "part").drop("part").write.json(path)


def regression_cases_from_audit(rows: DataFrame) -> DataFrame:
    """Rows that aren't clean, with a slug name for the case."""
    codes = F.coalesce("reason_codes", F.array().cast("array<string>"))
    dirty = (F.coalesce("quality_group", F.lit(0)) > 0) | F.exists(codes, lambda c: c.startswith("suspicious.") | c.startswith("guardrail."))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", "query", F.col("rank").cast("string"))), "[^a-z0-9]+", "_"), "^_|_$", "")
    return rows.where(dirty).withColumn("case_name", slug)


def regression_cases_from_issues(issues: DataFrame) -> DataFrame:
    """Expected text of each issue: the explicit one, the raw text for reasons that lost text, the shown text, the raw text."""
    lost = ["ends_with_currency", "ends_with_price_marker", "missing_price_after_currency", "reference_only_fragment", "scoped_stock_list_missing_price"]
    raw = F.when(F.col("reason").isin(lost), F.col("raw_listing_text"))
    return issues.withColumn("expected", F.coalesce("expected_text", raw, "listing_text", "raw_listing_text"))


def runs_from_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each stored search payload and retrieval branch; wrong types become null."""
    schema = (
        "struct<query:string,total_count:int,cache_hit:boolean,results:array<struct<listing_text:string>>,"
        "diagnostics:struct<parsed:int,matched:int,retrieval_timings:array<struct<branch:string,ms:bigint>>>>"
    )
    p = raw.select("*", F.from_json(column, schema).alias("p")).where("p IS NOT NULL")
    top = F.transform(F.slice("p.results", 1, 3), lambda r: r.listing_text)
    return p.select(
        F.col("p.query").alias("query"), F.col("p.total_count").alias("total_count"), F.col("p.cache_hit").alias("cache_hit"), top.alias("top_results"),
        F.col("p.diagnostics.parsed").alias("parsed"), F.col("p.diagnostics.matched").alias("matched"), F.explode_outer("p.diagnostics.retrieval_timings").alias("t"),
    ).select("query", "total_count", "cache_hit", "top_results", "parsed", "matched", "t.branch", "t.ms")
