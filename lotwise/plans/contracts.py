"""Registered queries of result contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.contracts import search_violations
from .queries import query, table
from .segments import _choice, _values

_SEARCH = {"query": "NAME", "total_count": 10, "offset": 0, "limit": 3, "result_count": 3, "has_more": True, "next_offset": 3, "cache_hit": False, "matched_count": 9, "final_count": 5}
_RESULT = {"result_id": "r1", "stable_listing_id": "s1", "rank": 2, "listing_text": "NAME", "source_url": "/l/1"}
#: (what a search or its second result has instead, rules that this breaks, items of those rules)
BREAKS = [
    ({}, "", None), ({"query": " "}, "query.required", None), ({"total_count": -1}, "total_count.non_negative", None), ({"offset": None}, "offset.non_negative", None),
    ({"limit": 0}, "limit.positive", None), ({"limit": None}, "", None), ({"result_count": 2}, "result_count.equals_rows", None), ({"next_offset": None}, "next_offset.required", None),
    ({"has_more": False}, "next_offset.null", None), ({"final_count": 11}, "final_count.within_matched", None), ({"final_count": 11, "cache_hit": True}, "", None),
    ({"matched_count": -1, "final_count": -2}, "final_count.non_negative matched_count.non_negative", None), ({"has_more": None, "next_offset": None}, "has_more.boolean", None),
    ({"result_id": "  "}, "result_id.required", 1), ({"result_id": "r0"}, "result_id.unique", 1), ({"stable_listing_id": None}, "stable_listing_id.required", 1), ({"rank": 0}, "rank.positive", 1),
    ({"listing_text": None}, "listing_text.required", 1), ({"source_url": "ftp://x"}, "source_url.http_or_relative", 1), ({"source_url": "https://a.example"}, "", None),
    ({"source_url": "//a.example"}, "source_url.http_or_relative", 1), ({"rows": 0}, "result_count.equals_rows results.empty", None), ({"rows": 0, "result_count": None}, "result_count.non_negative results.empty", None),
]
_EXPECTED = [(k, item, rule) for k, (_, rules, item) in enumerate(BREAKS) for rule in rules.split()]


@query(f"""WITH w(k, item, rule) AS {_values(_EXPECTED)} SELECT p_partkey AS query_id, CAST(item AS INT) AS item, rule FROM part JOIN w ON p_partkey % {len(BREAKS)} = k""")
def f7_contract_violations(s, d):
    """Every rule broken, by a search for each part and its three results."""
    part = table(s, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name")
    pick = lambda name, usual: _choice([b.get(name, usual) for b, _, _ in BREAKS], "query_id")
    searches = part.select("query_id", *[pick(c, v).alias(c) for c, v in _SEARCH.items()])
    rows = part.withColumn("item", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where(pick("rows", 1) == 1)
    usual = {"result_id": F.concat(F.lit("r"), F.col("item").cast("string")), "stable_listing_id": F.lit("s"), "rank": F.col("item") + 1, "listing_text": F.col("p_name"), "source_url": F.lit("/l")}
    results = rows.select("query_id", "item", *[F.when(F.col("item") == 1, pick(c, v)).otherwise(usual[c]).alias(c) for c, v in _RESULT.items()])
    return search_violations(searches, results)
