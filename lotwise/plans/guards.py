"""Registered queries of guardrails, final blocks and scores by query plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import guardrails as G
from ..operators import match as M
from ..operators import rulebook as R
from ..sources.shared import written
from ..sources.views import view
from .queries import RANK_SQL, SCORED, dealt, listings, query
from .segments import _choice, _values

_PHRASE, _NICK, _CONTEXT, _CONFLICT = (f"guardrail.{x}" for x in ("brand_model_phrase_missing", "nickname_evidence_missing", "descriptor_context", "descriptor_conflict"))
#: (search, shown text, whole post; reasons, blocked, score of the brand's claim) with NAME for a part's name.
CASES = [
    ("rolex daytona 5", "rolex daytona NAME", None, _PHRASE, True, 2),
    ("rolex daytona 5", "rolex daytona 5 NAME", None, "", False, 2),
    ("rolex daytona 5", "NAME neu", "rolex daytona 5 NAME neu", _PHRASE, True, 2),
    ("rolex daytona 5", "5 NAME neu", "rolex daytona 5 NAME neu", _PHRASE, False, 2),
    ("rolex daytona 5", "NAME neu und", "NAME neu und daytona 5", _PHRASE, True, 2),
    ("rolex daytona 5", "NAME daytona", "x NAME daytona 5", _PHRASE, False, 2),
    ("panda daytona", "daytona NAME dial", None, f"{_NICK} nickname.missing:panda", False, 1),
    ("panda daytona", "daytona NAME white dial", None, "", False, 1),
    ("61234 white", "61234 full set white tag blau dial 2020 NAME", None, f"{_CONTEXT} context.accessory_color_only:white evidence.accessory_color:white", False, 0),
    ("61234 white", "61234 white dial white card NAME", None, "evidence.product_color:white evidence.accessory_color:white", False, 0),
    ("61234 white", "61234 full set white tag NAME", "61234 panda full set white tag NAME", "evidence.accessory_color:white evidence.raw_scoped_product:panda", False, 0),
    ("61234 white", "61234 full set white tag", "stock list 61234 panda full set white tag 71234Q NAME",
     f"{_CONTEXT} context.accessory_color_only:white evidence.accessory_color:white evidence.stock_list_excluded:panda", False, 0),
    ("61234 purple", "61234 champ dial purplish NAME", None, f"{_CONFLICT} conflict.local_descriptor:champ", False, 0),
    ("5711 rose gold", "5711 wg", "5711 wg NAME", f"{_CONFLICT} conflict.local_descriptor:wg", False, 3),
    ("61234 rose gold", "61234 rose gold white gold NAME", None, "", False, 0),
    ("61234 purple", "71234Q champ NAME", None, "", False, 0),
    ("61234", "61234 NAME", None, "", False, 0),
    ("white card 61234", "61234 white card NAME", None, "", False, 0),
]


def cases(s, d):
    """A case of CASES for every part, with the plans of its searches."""
    at = lambda i: F.replace(_choice([c[i] for c in CASES], "p_partkey"), F.lit("NAME"), F.replace("p_name", F.lit("blue"), F.lit("blau")))
    plain = dealt(s, d, "part").withColumn("p_name", F.regexp_replace("p_name", "^[a-z]+", "ding"))
    rows = plain.select(F.col("p_partkey").alias("query_id"), at(0).alias("query_text"), at(1).alias("listing_text"), at(2).alias("raw_listing_text"))
    plans = R.annotate_query_plan(rows.select("query_id", "query_text"))
    return G.with_guardrails(rows, plans, ["query_id"]), plans


_TABLE = f"""WITH w(k, reasons, blocked, alias_score) AS {_values([(k, c[3], int(c[4]), c[5]) for k, c in enumerate(CASES)])}"""


@query(_TABLE + f""" SELECT p_partkey AS query_id, reasons, CASE WHEN reasons LIKE 'guardrail.%' THEN 1 ELSE 0 END AS guardrail_group, alias_score
FROM part JOIN w ON p_partkey % {len(CASES)} = k""")
def p26_guardrails(s, d):
    """Every guardrail, with its evidence, over a case for each part."""
    return cases(s, d)[0].select("query_id", F.array_join("guardrail_reasons", " ").alias("reasons"), "guardrail_group", "alias_score")


@query(_TABLE + f""" SELECT p_partkey AS query_id, CASE WHEN blocked = 1 THEN 'blocked_final' ELSE 'final' END AS stage FROM part JOIN w ON p_partkey % {len(CASES)} = k""")
def f4_block_final(s, d):
    """What is shown and what is blocked, one row for each case."""
    kept, blocked = G.block_final(*cases(s, d))
    return kept.select("query_id", F.lit("final").alias("stage")).unionByName(blocked.select("query_id", "stage"))


@query(RANK_SQL + " SELECT query_id, listing_id, CAST(rank AS INT) AS rank FROM r", "listings_v", "queries_v")
def w4_rank_by_plan(s, d):
    """The quality order with all twelve keys, the brand's claim and guardrails among them."""
    queries = view(s, d, "queries_v")
    plans = G.asked_plans(R.annotate_query_plan(queries)).drop("__refs")  # search_parts has the same
    parts = written(E.search_parts(queries).join(plans, "query_id", "left"), "plans")

    def score(rows):
        rows = G.guard_matches(rows.withColumn("raw_listing_text", F.lit(None).cast("string")))
        return E.plan_scores(E.score_components(rows))

    ask, keep = ["query_text", *E.SEARCH_PARTS, *[c for c in G.ASKED if c != "__refs"]], ["posted_date", "rank_in", *E.COMPONENTS, "alias_score"]
    matches = M.match_listings(parts, listings(s, d), SCORED, None, ask, score, keep, ("query_id",))
    return E.rank_by_quality(matches).select("query_id", "listing_id", "rank")
