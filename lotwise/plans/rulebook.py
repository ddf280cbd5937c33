"""Registered queries of the rulebook: kinds, plans and branches of searches of every sort, one for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rulebook as R
from ..sources.views import view
from .queries import query, table
from .segments import _choice, _values

_BRAND = "brand_model_descriptor"
#: (search, kind, required, optional, brands, collections, nicknames, reasons) as they must come out.
SEARCHES = [
    ("Rolex Daytona panda", _BRAND, "rolex daytona panda", "", "rolex:explicit:rolex", "daytona", "panda",
     "reference.absent descriptor.present brand.explicit:rolex collection.present:daytona nickname.present:panda"),
    ("pp 5711 blue nautilus", "reference_with_descriptor", "pp blue nautilus", "", "patek_philippe:reference:5711", "nautilus", "",
     "reference.present descriptor.present brand.reference:patek_philippe collection.reference:nautilus collection.present:nautilus"),
    ("5711 blue", "reference_with_descriptor", "blue", "", "patek_philippe:reference:5711", "nautilus", "",
     "reference.present descriptor.present brand.reference:patek_philippe collection.reference:nautilus"),
    ("5711 blue 2019", "reference_with_year", "blue", "2019", "patek_philippe:reference:5711", "nautilus", "",
     "reference.present descriptor.present year.present brand.reference:patek_philippe collection.reference:nautilus"),
    ("AP royal oak 15500ST blue", "reference_with_descriptor", "ap royal oak blue", "", "audemars_piguet:explicit:ap", "royal_oak", "",
     "reference.present descriptor.present brand.explicit:audemars_piguet collection.reference:royal_oak collection.present:royal_oak"),
    ("f.p journe chronometre", _BRAND, "f.p journe chronometre", "", "fp_journe:explicit:f.p", "", "", "reference.absent descriptor.present brand.explicit:fp_journe"),
    ("patek 5712/1A rose gold", "reference_with_descriptor", "patek rg", "", "patek_philippe:explicit:patek", "nautilus", "",
     "reference.present descriptor.present brand.explicit:patek_philippe collection.reference:nautilus descriptor.conflict_group:rg"),
    ("rolex 1815 black", _BRAND, "rolex black 1815", "", "rolex:explicit:rolex", "", "", "reference.present descriptor.present reference.short_model_suffix brand.explicit:rolex"),
    ("gmt master pepsi", _BRAND, "gmt master pepsi", "", "rolex:collection:gmt", "gmt gmt_master", "pepsi",
     "reference.absent descriptor.present collection.present:gmt brand.collection:rolex collection.present:gmt_master nickname.present:pepsi"),
    ("Hulk", "free_text", "", "hulk", "rolex:nickname:hulk", "", "hulk", "reference.absent descriptor.present nickname.present:hulk brand.nickname:rolex"),
    ("RM27-03 red", "reference_with_descriptor", "red", "", "richard_mille:reference:rm27-03", "", "", "reference.present descriptor.present brand.reference:richard_mille"),
    ("5167A", "reference_only", "", "", "patek_philippe:reference:5167a", "aquanaut", "",
     "reference.present descriptor.absent brand.reference:patek_philippe collection.reference:aquanaut"),
    ("daytona panda 126500LN", "reference_with_descriptor", "daytona panda", "", "rolex:reference:126500ln", "daytona", "panda",
     "reference.present descriptor.present brand.reference:rolex collection.reference:daytona collection.present:daytona nickname.present:panda"),
    ("white dial watch", "free_text", "", "white dial watch", "", "", "", "reference.absent descriptor.present"),
    ("2021 daytona", _BRAND, "2021 daytona", "", "rolex:collection:daytona", "daytona", "", "reference.absent descriptor.present year.present collection.present:daytona brand.collection:rolex"),
    ("Nautilus 5711 blue", "reference_with_descriptor", "nautilus blue", "", "patek_philippe:reference:5711", "nautilus", "",
     "reference.present descriptor.present brand.reference:patek_philippe collection.reference:nautilus collection.present:nautilus"),
    ("5711 blue diamond", "reference_with_descriptor", "blue diamond", "", "patek_philippe:reference:5711", "nautilus", "",
     "reference.present descriptor.present brand.reference:patek_philippe collection.reference:nautilus"),
    ("71234 2020", "reference_with_year", "", "2020", "", "", "", "reference.present descriptor.present year.present"),
    ("root beer or batgirl offshore", "free_text", "", "root beer batgirl offshore", "audemars_piguet:collection:offshore rolex:nickname:batgirl", "offshore", "batgirl root_beer",
     "reference.absent descriptor.present collection.present:offshore brand.collection:audemars_piguet nickname.present:batgirl brand.nickname:rolex nickname.present:root_beer"),
]
#: Policy of a search's kind: descriptors, year, fuzzy.
_POLICY = [
    "optional ignore diagnostic" if x[1] == "reference_only" or x[1] == "free_text" else "required ignore strong_diagnostic" if x[1] == _BRAND
    else f"{'required' if x[2] else 'optional'} soft_demote warn_or_demote" if x[1] == "reference_with_year" else "required ignore warn_or_demote" for x in SEARCHES
]
#: (fetch, fallback, match, fewer_than, reasons) of the searches that do more than fetch themselves; Q is the search itself.
_PANDA = "daytona white|126500ln white|116500ln white"
BRANCHES = {
    0: (f"Q|{_PANDA}", "", f"Q|{_PANDA}", None, "retrieval.raw_query retrieval.nickname_expansion:panda"),
    1: ("Q", "5711|nautilus 5711 blue", "Q|5711 blue", 5, "retrieval.raw_query retrieval.conditional_fallback:nautilus"),
    2: ("Q", "5711|nautilus 5711 blue", "Q", 5, "retrieval.raw_query retrieval.conditional_fallback:nautilus"),
    4: ("Q", "15500st|royal oak 15500st blue", "Q|15500st blue", 5, "retrieval.raw_query retrieval.conditional_fallback:royal_oak"),
    5: ("Q", "fpj chronometre", "Q|fpj chronometre", 1, "retrieval.raw_query retrieval.conditional_fallback:fp_journe"),
    6: ("5712/1a", "", "Q", None, "retrieval.reference_with_descriptors"),
    7: ("1815", "", "Q", None, "retrieval.reference_with_descriptors"),
    10: ("rm27-03", "", "Q", None, "retrieval.reference_with_descriptors"),
    12: ("126500ln", "", "Q", None, "retrieval.reference_with_descriptors"),
    15: ("Q", "5711", "Q|5711 blue", 5, "retrieval.raw_query retrieval.conditional_fallback:nautilus retrieval.duplicate_branch_skipped"),
    16: ("5711", "", "Q", None, "retrieval.reference_with_descriptors"),
}
_PLANS = [(k, *(x.replace("Q", SEARCHES[k][0]) if isinstance(x, str) else x for x in BRANCHES.get(k, ("Q", "", "Q", None, "retrieval.raw_query")))) for k in range(len(SEARCHES))]
_BRANCH_ROWS = [(k, role, i, t) for k, fetch, back, match, _, _ in _PLANS for role, ts in (("fetch", fetch), ("fallback", back), ("match", match)) for i, t in enumerate(x for x in ts.split("|") if x)]


def searches(s, d):
    """A search of SEARCHES for every part."""
    return table(s, d, "part").select(F.col("p_partkey").alias("query_id"), _choice([x[0] for x in SEARCHES], "p_partkey").alias("query_text"))


def _words(c: str):
    return F.array_join(c, " ").alias(c)


@query(f"""WITH w(k, intent_kind, required, optional, policy) AS {_values([(k, *x[1:4], _POLICY[k]) for k, x in enumerate(SEARCHES)])}
SELECT p_partkey AS query_id, intent_kind, required, optional, policy FROM part JOIN w ON p_partkey % {len(SEARCHES)} = k""")
def p7_classify_intent(s, d):
    """Kind, descriptors and policy of searches of all five kinds."""
    policy = F.concat_ws(" ", *[F.col("policy")[x] for x in ("descriptor", "year", "fuzzy")]).alias("policy")
    return R.classify_intent(searches(s, d)).select("query_id", "intent_kind", _words("required"), _words("optional"), policy)


@query(f"""WITH w(k, brands, collections, nicknames, reasons) AS {_values([(k, *x[4:]) for k, x in enumerate(SEARCHES)])}
SELECT p_partkey AS query_id, brands, collections, nicknames, reasons FROM part JOIN w ON p_partkey % {len(SEARCHES)} = k""")
def p8_annotate_query_plan(s, d):
    """Brands, collections and nicknames that searches name, with the reasons."""
    brands = F.array_join(F.transform("brands", lambda b: F.concat_ws(":", b.brand, b.confidence, b.terms)), " ").alias("brands")
    return R.annotate_query_plan(searches(s, d)).select("query_id", brands, _words("collections"), _words("nicknames"), _words("reasons"))


@query("""SELECT query_id, CASE WHEN query_text LIKE '%1997' THEN 'reference_with_year' ELSE 'reference_with_descriptor' END AS intent_kind,
CASE WHEN regexp_matches(lower(query_text), '(^| )571[12]') THEN 'patek_philippe' WHEN regexp_matches(lower(query_text), '(^| )155[01]0st( |$)') THEN 'audemars_piguet' END AS brand FROM queries_v""", "queries_v")
def p8_query_log_plans(s, d):
    """The same for the query log, whose references rarely name a brand."""
    plans = R.annotate_query_plan(view(s, d, "queries_v"))
    return plans.select("query_id", "intent_kind", F.get("brands.brand", F.lit(0)).alias("brand"))


@query(f"""WITH w(k, role, branch_no, branch_text) AS {_values(_BRANCH_ROWS)}
SELECT p_partkey AS query_id, role, CAST(branch_no AS INT) AS branch_no, branch_text FROM part JOIN w ON p_partkey % {len(SEARCHES)} = k""")
def j4_expand_queries(s, d):
    """Every query to fetch, to fall back to and to match for a search."""
    return R.expand_queries(R.annotate_query_plan(searches(s, d)))


@query(f"""WITH w(k, fewer_than, reasons) AS {_values([(k, n, why) for k, _, _, _, n, why in _PLANS])}
SELECT p_partkey AS query_id, CAST(fewer_than AS INT) AS fewer_than, reasons FROM part JOIN w ON p_partkey % {len(SEARCHES)} = k""")
def j4_retrieval_plans(s, d):
    """When a search falls back, and why it is expanded."""
    plans = R.retrieval_plan(R.annotate_query_plan(searches(s, d)))
    return plans.select("query_id", "fewer_than", F.array_join("retrieval_reasons", " ").alias("reasons"))
