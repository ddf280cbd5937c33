"""Registered queries of funnels: the stages of one run in one table, and their counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import evidence as E
from ..operators import match as M
from ..sources.shared import written
from .queries import RANK_SQL, SCORED, norm, query, scored, searched

_STAGE = "[" + ", ".join(f"'{x}'" for x in A.STAGES) + "]"
_CODES = "CASE event_id // 10 % 4 WHEN 0 THEN ['dedupe.latest'] WHEN 1 THEN ['dedupe.text', 'weak.text'] WHEN 2 THEN [] END"


@query(f"""WITH e AS (SELECT 'user ' || CAST(user_id AS VARCHAR) AS query, {_STAGE}[CAST(event_id % 10 AS INT) + 1] AS stage, {_CODES} AS codes FROM events),
r AS (SELECT query, code, count(*) AS n FROM (SELECT query, unnest(codes) AS code FROM e WHERE stage IN ('dedupe_drop', 'ambiguous_candidate', 'blocked_final')) GROUP BY 1, 2),
m AS (SELECT query, string_agg(code || '=' || CAST(n AS VARCHAR), ',' ORDER BY code) AS rejections FROM r GROUP BY 1),
c AS (SELECT query, {", ".join(f"count(*) FILTER (stage = '{x}') AS n_{x}" for x in A.STAGES)}, count(*) FILTER (stage = 'dedupe_drop' AND list_contains(codes, 'dedupe.latest')) AS n_latest FROM e GROUP BY query)
SELECT query, n_raw AS raw, n_parsed AS parsed, n_matched AS matched, n_converted AS converted, n_converted - n_latest AS unique_latest, n_converted - n_dedupe_drop AS unique_text, n_final AS final,
       n_dedupe_drop AS dropped, n_weak_match AS weak, n_ambiguous_candidate AS ambiguous, n_blocked_final AS blocked, n_parsed >= 5 AS truncated, coalesce(rejections, '') AS rejections FROM c LEFT JOIN m USING (query)""")
def a10_funnel(s, d):
    """All counts of the funnel over events of all ten stages, with the map of rejections."""
    codes = F.expr("CASE event_id div 10 % 4 WHEN 0 THEN array('dedupe.latest') WHEN 1 THEN array('dedupe.text', 'weak.text') WHEN 2 THEN cast(array() as array<string>) END")
    stage = F.element_at(F.array(*map(F.lit, A.STAGES)), (F.col("event_id") % 10).cast("int") + 1)
    ev = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"), stage.alias("stage"), codes.alias("reason_codes"))
    said = F.array_join(F.transform(F.map_entries("rejections"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")
    return A.funnel(ev, cut=5).withColumn("rejections", said)


@query(RANK_SQL + f""", c AS (SELECT DISTINCT query_id, listing_id FROM cand), t AS (SELECT m.query_id, m.listing_id, row_number() OVER (PARTITION BY m.query_id, {norm("listing_text")} ORDER BY m.listing_id) AS n FROM m JOIN l ON m.listing_id = l.listing_id),
f AS (SELECT t.query_id, t.listing_id, rank() OVER (PARTITION BY t.query_id ORDER BY r.rank) AS place FROM t JOIN r ON r.query_id = t.query_id AND r.listing_id = t.listing_id WHERE n = 1)
SELECT 'raw' AS stage, query_id, count(*) AS n, 0 AS codes FROM c GROUP BY query_id UNION ALL SELECT 'parsed', query_id, count(*), 0 FROM c GROUP BY query_id UNION ALL SELECT 'matched', query_id, count(*), 0 FROM m GROUP BY query_id
UNION ALL SELECT 'converted', query_id, count(*), 0 FROM m GROUP BY query_id UNION ALL SELECT 'dedupe_drop', query_id, count(*), count(*) FROM t WHERE n > 1 GROUP BY query_id
UNION ALL SELECT 'final', query_id, count(*), 0 FROM f WHERE place <= 5 GROUP BY query_id""", "listings_v", "queries_v")
def u4_funnel_events(s, d):
    """The stages of a run over all queries: what came, was read, matched, converted, dropped as a repeat and shown."""
    q, _, index = searched(s, d, SCORED)
    raw = M.reference_pairs(q, index)
    matched = scored(s, d, index, said=T.normalize_text("listing_text"))
    first = F.row_number().over(Window.partitionBy("query_id", "said").orderBy("listing_id")) == 1
    # matches are dealt by query already: repeats and ranks need no shuffle more, and one narrow table feeds four stages
    ranked = E.rank_by_quality(matched.withColumn("first", first), ["query_id", "first"])
    ranked = written(ranked.select("query_id", "listing_id", "first", "rank"), "funnel-matches")
    dropped = ranked.where("NOT first").withColumn("reason_codes", F.array(F.lit("dedupe.text")))
    final = E.top_k(ranked.where("first"), 5)
    stages = {"raw": raw, "parsed": raw, "matched": ranked, "converted": ranked, "dedupe_drop": dropped, "final": final}
    events = A.funnel_events(stages)
    return events.groupBy("stage", "query_id").agg(F.count("*").alias("n"), F.sum(F.size("reason_codes")).cast("int").alias("codes"))
