"""Query plans by a rulebook: brands, collections and nicknames that a query names, its kind, and what to fetch for it.

Rules are tables of any size. A query's words meet a phrase in an equi-join on the phrase's first word, whose place is
then compared with the whole phrase; references meet their rules in an equi-join on their beginnings; expansion rules are
joined on the collection or brand that they are for. No query is compared with every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Phrases and references with the brands, collections and nicknames that they stand for, in order.
BRAND_PHRASES = [
    ("rolex", "rolex"), ("patek philippe", "patek_philippe"), ("patek", "patek_philippe"), ("ap", "audemars_piguet"), ("audemars piguet", "audemars_piguet"),
    ("rm", "richard_mille"), ("richard mille", "richard_mille"), ("fpj", "fp_journe"), ("f.p", "fp_journe"), ("f.p.journe", "fp_journe"),
    ("f p journe", "fp_journe"), ("rp journe", "fp_journe"),
]
COLLECTION_PHRASES = [
    ("daytona", "daytona", "rolex"), ("submariner", "submariner", "rolex"), ("gmt", "gmt", "rolex"), ("gmt master", "gmt_master", "rolex"),
    ("nautilus", "nautilus", "patek_philippe"), ("aquanaut", "aquanaut", "patek_philippe"), ("royal oak", "royal_oak", "audemars_piguet"),
    ("offshore", "offshore", "audemars_piguet"),
]
NICKNAME_PHRASES = [
    ("panda", "panda", "rolex"), ("pepsi", "pepsi", "rolex"), ("batman", "batman", "rolex"), ("batgirl", "batgirl", "rolex"), ("sprite", "sprite", "rolex"),
    ("hulk", "hulk", "rolex"), ("starbucks", "starbucks", "rolex"), ("root beer", "root_beer", "rolex"),
]
#: (beginnings of references, whether they are the whole reference, brand, collection)
REFERENCE_SHAPES = [
    (["126500ln", "128500ln", "116500ln"], True, "rolex", "daytona"), (["5711", "5712"], False, "patek_philippe", "nautilus"),
    (["5167", "5167a"], True, "patek_philippe", "aquanaut"), (["15500st", "15510st"], True, "audemars_piguet", "royal_oak"),
    ([f"rm{i}" for i in range(10)], False, "richard_mille", None),
]
BRAND_WORDS = [
    "ap", "audemars", "cartier", "fpj", "iwc", "jaeger", "journe", "lange", "lecoultre", "mille", "omega", "panerai", "patek", "richard", "rm", "rolex",
    "tudor", "vacheron", "vc",
]
FAMILY_WORDS = [
    "1815", "aquanaut", "aquatimer", "baignoire", "ballon", "bay", "bleu", "calatrava", "clair", "code", "constellation", "control", "datejust", "daydate",
    "daytona", "deepsea", "deville", "duometre", "egerie", "elegante", "explorer", "fiftysix", "gmt", "historiques", "luminor", "malte", "master", "metiers",
    "nautilus", "oak", "odysseus", "offshore", "overseas", "panda", "panthere", "patrimony", "pelagos", "pilot", "polaris", "portofino", "portugieser",
    "radiomir", "ranger", "rendez", "reverso", "royal", "santos", "saxonia", "seamaster", "speedmaster", "submariner", "submersible", "tank", "titanium",
    "traditionnelle", "vous", "yacht", "zeitwerk",
]
SURE_FAMILY_WORDS = [
    "aquanaut", "calatrava", "daydate", "datejust", "daytona", "luminor", "nautilus", "overseas", "pelagos", "portugieser", "radiomir", "reverso", "seamaster",
    "speedmaster", "submariner", "submersible",
]
FAMILY_PHRASES = ["ballon bleu", "black bay", "code 1159", "gmt master", "master control", "pilot watch", "royal oak"]
#: (kind, descriptors, year, fuzzy): how strictly a query's parts are taken; reference_with_year asks for descriptors only if it has others than years
POLICIES = {
    "reference_only": ("optional", "ignore", "diagnostic"), "brand_model_descriptor": ("required", "ignore", "strong_diagnostic"),
    "reference_with_year": ("required", "soft_demote", "warn_or_demote"), "reference_with_descriptor": ("required", "ignore", "warn_or_demote"),
    "free_text": ("optional", "ignore", "diagnostic"),
}
#: What to fetch besides a query of a collection: nickname, references and descriptors it must have, others it may have,
#: whether it may have references, queries to fetch and to match, how few matches call for them (null: always).
EXPANSIONS = [
    ("daytona", "panda", [], [], [], False, ["daytona white", "126500ln white", "116500ln white"], ["daytona white", "126500ln white", "116500ln white"], None,
     "retrieval.nickname_expansion:panda"),
    ("nautilus", None, ["5711"], ["blue"], ["nautilus", "patek", "philippe", "pp"], True, ["5711", "nautilus 5711 blue"], ["5711 blue"], 5,
     "retrieval.collection_expansion:nautilus"),
    ("royal_oak", None, ["15500st"], ["blue"], ["ap", "audemars", "piguet", "royal", "oak"], True, ["15500st", "royal oak 15500st blue"], ["15500st blue"], 5,
     "retrieval.collection_expansion:royal_oak"),
]
EXPANSION_COLUMNS = (
    "collection string, nickname string, references array<string>, descriptors array<string>, extras array<string>, may_name boolean, "
    "fetch array<string>, match array<string>, fewer_than int, code string"
)
#: Brands to fetch under another word: the first of these phrases that the query has is replaced by it.
BRAND_SPELLINGS = [("fp_journe", "fpj", ["f.p journe", "f.p", "f.p.journe", "fpj", "rp journe"], 1, "retrieval.brand_alias_expansion:fp_journe")]

_SOURCES = ["explicit", "reference", "collection", "nickname"]


def phrase_rules(spark: SparkSession) -> DataFrame:
    """(source, rule, phrase, name, brand) of all phrases; a larger table of the same columns does as well."""
    rows = [("explicit", i, p, None, b) for i, (p, b) in enumerate(BRAND_PHRASES)]
    rows += [("collection", i, *r) for i, r in enumerate(COLLECTION_PHRASES)] + [("nickname", i, *r) for i, r in enumerate(NICKNAME_PHRASES)]
    return spark.createDataFrame(rows, "source string, rule int, phrase string, name string, brand string")


def reference_rules(spark: SparkSession) -> DataFrame:
    """(rule, beginning, whole, brand, name) of all reference shapes."""
    rows = [(i, x, whole, brand, name) for i, (beginnings, whole, brand, name) in enumerate(REFERENCE_SHAPES) for x in beginnings]
    return spark.createDataFrame(rows, "rule int, beginning string, whole boolean, brand string, name string")


def has_phrase(words: Column, phrase: str) -> Column:
    """Whether words hold the phrase's words in a row."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} "))


def classify_intent(queries: DataFrame, query: str = "query_text") -> DataFrame:
    """queries with refs, descs, intent_kind, required, optional and conflicts (arrays), policy (map) and intent_reasons.

    Null and empty queries are free text without descriptors.
    """
    refs, descs = T.parse_query_terms(query)
    q = queries.withColumns({"refs": refs, "descs": descs})
    none = F.array().cast("array<string>")
    named, described = F.size("refs") > 0, F.size("descs") > 0
    words = lambda xs: F.array(*map(F.lit, xs))
    years, others = F.filter("descs", T.year_like), F.filter("descs", lambda t: ~T.year_like(t))
    branded = F.arrays_overlap("descs", words(BRAND_WORDS))
    suffixes = F.forall("refs", lambda r: r.rlike("^[0-9]{1,4}$"))
    phrased = F.lit(False)
    for phrase in FAMILY_PHRASES:
        phrased = phrased | has_phrase(F.col("descs"), phrase)
    family = F.size(F.array_intersect("descs", words(FAMILY_WORDS))) >= 2
    model = (F.size("descs") >= 2) & (branded | F.arrays_overlap("descs", words(SURE_FAMILY_WORDS)) | phrased | family)
    kind = (
        F.when(named & ~described, "reference_only").when(named & branded & suffixes, "brand_model_descriptor")
        .when(named & (F.size(years) > 0), "reference_with_year").when(named, "reference_with_descriptor").when(model, "brand_model_descriptor").otherwise("free_text")
    )
    q = q.withColumn("intent_kind", kind)
    is_ = lambda *kinds: F.col("intent_kind").isin(*kinds)
    required = F.when(is_("reference_with_year"), others).when(is_("brand_model_descriptor"), F.concat("descs", "refs")).when(is_("reference_with_descriptor"), F.col("descs")).otherwise(none)
    optional = F.when(is_("reference_with_year"), years).when(is_("free_text"), F.col("descs")).otherwise(none)
    q = q.withColumns({"required": required, "optional": optional})
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in POLICIES.items() for x in (k, v[i])]), F.col("intent_kind"))
    descriptor = F.when(is_("reference_with_year") & (F.size("required") == 0), "optional").otherwise(of(0))
    reasons = F.array(
        F.when(named, "reference.present").otherwise("reference.absent"), F.when(described, "descriptor.present").otherwise("descriptor.absent"),
        F.when(F.size(years) > 0, "year.present"), F.when(named & is_("brand_model_descriptor"), "reference.short_model_suffix"),
    )
    return q.withColumns({
        "conflicts": T.conflict_descriptors(F.col("required")), "intent_reasons": F.array_compact(reasons),
        "policy": F.create_map(F.lit("descriptor"), descriptor, F.lit("year"), of(1), F.lit("fuzzy"), of(2)),
    })


def annotate_query_plan(queries: DataFrame, phrases: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """queries (query_id, query_text) with classify_intent's columns, canonical_query, brands, collections, nicknames and reasons.

    brands holds (brand, confidence, terms), the first claim of each, in order of source and rule: explicit phrases,
    references in their order, collection phrases, nickname phrases. Rows repeating a query_id share the claims of all.
    """
    spark = queries.sparkSession
    phrases = phrases if phrases is not None else phrase_rules(spark)
    references = references if references is not None else reference_rules(spark)
    q = classify_intent(queries).withColumn("words", T.canonical_tokens(T.tokens("query_text")))
    q = q.withColumn("canonical_query", F.array_join("words", " "))

    rules = phrases.withColumn("phrase_words", F.split("phrase", " ")).withColumn("first", F.get("phrase_words", F.lit(0)))
    spots = q.select("query_id", "words", F.posexplode_outer("words").alias("pos", "first")).where("first IS NOT NULL")
    named = spots.join(rules, "first").where("slice(words, pos + 1, size(phrase_words)) = phrase_words")
    source = lambda c: F.array_position(F.array(*map(F.lit, _SOURCES)), c).cast("int")
    hit = lambda order, conf, terms: F.struct(source(conf).alias("source"), order.alias("order"), "brand", "name", conf.alias("confidence"), terms.alias("terms")).alias("hit")
    named = named.select("query_id", hit(F.col("rule"), F.col("source"), F.col("phrase"))).distinct()

    longest = references.agg(F.max(F.length("beginning"))).first()[0] or 0
    refs = q.select("query_id", F.posexplode_outer("refs").alias("at", "ref")).where("ref IS NOT NULL")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length("ref"), F.lit(longest)), F.lit(1))), lambda n: F.left("ref", n))
    refs = refs.select("query_id", "at", "ref", F.explode_outer(heads).alias("beginning"))
    shaped = refs.join(references, "beginning").where("NOT whole OR beginning = ref")
    shaped = shaped.groupBy("query_id", "at", "ref").agg(F.min(F.struct("rule", "brand", "name")).alias("r")).select("query_id", "at", "ref", "r.*")
    shaped = shaped.select("query_id", hit(F.col("at"), F.lit("reference"), F.col("ref"))).distinct()

    hits = named.unionByName(shaped).groupBy("query_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    q = q.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
    nick = lambda h: h.confidence == "nickname"
    before = lambda i: F.slice("hits", F.lit(1), i)
    new_brand = lambda h, i: ~F.exists(before(i), lambda g: g.brand == h.brand)
    new_name = lambda h, i: h["name"].isNotNull() & ~F.exists(before(i), lambda g: g["name"].eqNullSafe(h["name"]) & (nick(g) == nick(h)))
    q = q.withColumn("claims", F.transform("hits", lambda h, i: h.withField("new_brand", new_brand(h, i)).withField("new_name", new_name(h, i))))

    def reasons(h: Column) -> Column:
        say = lambda kind, what: F.concat(F.lit(f"{kind}."), h.confidence, F.lit(":"), what)
        brand = F.when(h.new_brand, say("brand", h.brand))
        present = F.concat(h.confidence, F.lit(".present:"), h["name"])
        of_reference = F.when(h.new_name, say("collection", h["name"]))
        return F.array_compact(
            F.when(h.confidence == "explicit", F.array(brand)).when(h.confidence == "reference", F.array(brand, of_reference)).otherwise(F.array(present, brand))
        )

    conflict = F.transform(F.filter("required", lambda t: F.size(T.conflict_descriptors(F.array(t))) > 0), lambda t: F.concat(F.lit("descriptor.conflict_group:"), t))
    names = lambda of_nick: F.transform(F.filter("claims", lambda h: h.new_name & (nick(h) == of_nick)), lambda h: h["name"])
    claim = lambda h: F.struct(h.brand.alias("brand"), h.confidence.alias("confidence"), h.terms.alias("terms"))
    return q.withColumns({
        "brands": F.transform(F.filter("claims", lambda h: h.new_brand), claim),
        "collections": names(False), "nicknames": names(True),
        "reasons": F.array_distinct(F.concat("intent_reasons", F.flatten(F.transform("claims", reasons)), conflict)),
    }).drop("hits", "claims", "words", "intent_reasons")


def expansion_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(EXPANSIONS)], f"rule int, {EXPANSION_COLUMNS}")


def brand_spellings(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(BRAND_SPELLINGS)]
    return spark.createDataFrame(rows, "rule int, brand string, word string, groups array<string>, fewer_than int, code string")


def retrieval_plan(plans: DataFrame, expansions: DataFrame | None = None, spellings: DataFrame | None = None) -> DataFrame:
    """plans (of annotate_query_plan) with fetch, fallback and match (arrays of queries), fewer_than and retrieval_reasons.

    The first expansion rule whose constraints a query keeps decides; else the first brand that is also spelt otherwise;
    else a query of references and required descriptors fetches its references; else it fetches itself. fallback is
    fetched if fewer than fewer_than listings match.
    """
    spark = plans.sparkSession
    expansions = expansions if expansions is not None else expansion_rules(spark)
    spellings = spellings if spellings is not None else brand_spellings(spark)
    first_rule = Window.partitionBy("query_id").orderBy("rule")
    top = lambda df: df.withColumn("n", F.row_number().over(first_rule)).where("n = 1")

    q = plans.select("query_id", "collections", "nicknames", "refs", "required", "optional").dropDuplicates(["query_id"])
    wanted = q.withColumn("collection", F.explode_outer("collections")).join(expansions, "collection")
    wanted = wanted.where(
        "(may_name OR size(refs) = 0) AND size(optional) = 0 AND (nickname IS NULL OR array_contains(nicknames, nickname)) AND size(array_except(references, refs)) = 0 AND "
        "(size(descriptors) = 0 OR (size(array_except(descriptors, required)) = 0 AND size(array_except(required, concat(descriptors, references, extras))) = 0))"
    )
    by_rule = top(wanted).select("query_id", F.struct("collection", "fetch", "match", "fewer_than", "code").alias("x"))

    brands = plans.select("query_id", "canonical_query", "refs", F.explode_outer("brands.brand").alias("brand")).where("size(refs) = 0").join(spellings, "brand")
    spaced = F.concat(F.lit(" "), F.replace("canonical_query", F.lit(" "), F.lit("  ")), F.lit(" "))

    def spelt(group: Column) -> Column:
        old = F.concat(F.lit(" "), F.replace(group, F.lit(" "), F.lit("  ")), F.lit(" "))
        at = F.instr(spaced, old)
        new = F.concat(F.left(spaced, at - 1), F.lit(" "), F.col("word"), F.lit(" "), F.substr(spaced, at + F.length(old)))
        return F.when(at > 0, F.trim(F.replace(new, F.lit("  "), F.lit(" "))))

    other = F.filter(F.transform("groups", spelt), lambda t: t.isNotNull() & (t != F.col("canonical_query")))
    by_brand = top(brands.dropDuplicates(["query_id", "rule"])).select("query_id", F.struct("brand", F.get(other, F.lit(0)).alias("query"), "fewer_than", "code").alias("y"))

    key = lambda t: T.normalize_text(t)
    fresh = lambda qs, known: F.filter(qs, lambda t, i: ~F.exists(F.concat(known, F.slice(qs, F.lit(1), i)), lambda s: key(s) == key(t)))
    none, own = F.array().cast("array<string>"), F.array(F.col("query_text"))
    q = plans.join(by_rule, "query_id", "left").join(by_brand, "query_id", "left")
    q = q.withColumn("more", F.when(F.col("x").isNotNull(), fresh(F.col("x.fetch"), own)))
    way = (
        F.when(F.col("x.fewer_than").isNotNull(), "fallback").when(F.col("x").isNotNull(), "expansion").when(F.col("y.query").isNotNull(), "brand")
        .when((F.size("refs") > 0) & (F.size("required") > 0) & (F.size("optional") == 0), "reference").otherwise("raw")
    )
    q = q.withColumn("way", way)
    is_ = lambda *w: F.col("way").isin(*w)
    skipped = F.when(F.size("more") < F.size("x.fetch"), F.lit("retrieval.duplicate_branch_skipped"))
    raw = F.lit("retrieval.raw_query")
    return q.withColumns({
        "fetch": F.when(is_("expansion"), F.concat(own, "more")).when(is_("reference"), F.array(F.array_join("refs", " "))).otherwise(own),
        "fallback": F.when(is_("fallback"), F.col("more")).when(is_("brand"), F.array("y.query")).otherwise(none),
        "match": F.when(is_("expansion", "fallback"), F.array_distinct(F.concat(own, "x.match"))).when(is_("brand"), F.array_distinct(F.concat(own, F.array("y.query")))).otherwise(own),
        "fewer_than": F.when(is_("fallback"), F.col("x.fewer_than")).when(is_("brand"), F.col("y.fewer_than")),
        "retrieval_reasons": F.array_compact(
            F.when(is_("expansion"), F.array(raw, F.col("x.code"), skipped))
            .when(is_("fallback"), F.array(raw, F.concat(F.lit("retrieval.conditional_fallback:"), "x.collection"), skipped))
            .when(is_("brand"), F.array(raw, F.concat(F.lit("retrieval.conditional_fallback:"), "y.brand")))
            .when(is_("reference"), F.array(F.lit("retrieval.reference_with_descriptors"))).otherwise(F.array(raw))
        ),
    }).drop("x", "y", "more", "way")


def expand_queries(plans: DataFrame) -> DataFrame:
    """(query_id, role, branch_no, branch_text): a row for each query to fetch, to fall back to and to match, by retrieval_plan."""
    rows = retrieval_plan(plans).select("query_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("texts")) for r in ("fetch", "fallback", "match")])).alias("b"))
    return rows.select("query_id", "b.role", F.posexplode_outer("b.texts").alias("branch_no", "branch_text")).where("branch_text IS NOT NULL")
