"""Suspicious shown texts: signs that a listing's text was cut at the wrong place or lost its price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Amounts, currencies, marks and words that make a price visible.
AMOUNT = r"\d+(?:[,.]\d+)*(?:k|m|u)?"
SPACED_AMOUNT = r"\d+(?:[.,]\d+)*(?:\s*(?:k|m|u|mil|million))?"
BETWEEN = r"\s*[:;.,-]?\s*"
CODES = ["hkd", "usd", "usdt", "eur", "aed", "chf"]
SHORT_CODES = "(?:hk|hkd|us|usd|usdt|eur|aed|chf)"
LABELS = "(?:lnl|lab|label|lbl)"
BRANDS = ["ap", "audemars", "patek", "philippe", "pp", "ref", "rolex"]
KARAT = r"\b(?:9|10|14|18|19|20|21|22|24)k\s+(?:(?:rose|yellow|white|pink)\s+)?gold\b"
MONEY_SIGNS = "€£💰💲$"
MARKED_END = r"\d+(?:[,.]\d+)*(?:k|m)?(?:hk|hkd|us|usd|usdt)?[$💰💲]$"
STOCK_LIST = r"\b(?:hk\s+)?stock\s+list\b|\bstocklist\b"
REFERENCE = r"\b(?=[a-z0-9/.-]*\d)[a-z0-9]+(?:[./-][a-z0-9]+)*\b"
PRICE = [
    rf"\b{SHORT_CODES}{BETWEEN}{AMOUNT}\b",
    rf"\b{AMOUNT}{BETWEEN}{SHORT_CODES}\b",
    rf"\b{SHORT_CODES}\s*[-~]\s*{AMOUNT}\b",
    rf"[$€£¥💰💲]\s*{AMOUNT}",
    rf"\b{AMOUNT}\s*[$€£¥💰💲]",
    rf"\b{SPACED_AMOUNT}\s*\+\s*{LABELS}\b",
    rf"\b{LABELS}\s*\+\s*{SPACED_AMOUNT}\b",
    r"\b(?:19|20)\d{2}\s+\d{5,8}\b",
    r"\b(?:full\s+set|fullset|used|new|naked)\s+\d{5,8}\b",
    r"\b\d{5,8}\s*(?:lab|label|lbl|ship|shipping)\b",
    r"\b\d{1,3},\d{3}(?:\+\s*)?(?:lab|label|lbl|ship|shipping)?\b",
    r"\b\d{3,4}\s*nfc\b",
    r"\b\d+(?:\.\d+)?[km]\b",
    r"\b\d{2,3},\d{1,2}\b",
]
_UNICODE = "(?U)"  # letters and digits of all scripts count for word ends


def _plain(c: Column) -> Column:
    """Folded text with doubled currency codes single and two spellings of codes mended."""
    out = F.regexp_replace(T.fold(c), r"\b(hkd|usd|usdt|eur|aed|chf)\1\b", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\beuro\b", "eur"), r"\bhkdl\b", "hkd")


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s,]", "")


def currency_amounts(plain: Column) -> Column:
    """Array of arrays: the spellings of each amount of weight that stands beside a currency code or money symbol.

    plain is folded text (_plain). Amounts of weight end in k, m, u, mil or million or have five digits. Texts without
    any code or symbol are told by one test; the others are searched once a pattern, and groups come from the few finds.
    """
    codes = "|".join(sorted(CODES))
    heavy = lambda a: a.rlike("(?:k|m|u|mil|million)$") | (F.length(F.regexp_replace(a, r"\D", "")) >= 5)

    def found(pattern: str, amount: int, mark: int, alone: bool) -> Column:
        group = lambda m, i: _compact(F.regexp_extract(m, _UNICODE + pattern, i))
        finds = F.regexp_extract_all(plain, F.lit(_UNICODE + pattern), F.lit(0))
        pairs = F.filter(F.transform(finds, lambda m: F.struct(group(m, amount).alias("a"), group(m, mark).alias("m"))), lambda p: heavy(p["a"]))
        return F.transform(pairs, lambda p: F.array(F.concat(p["m"], p["a"]), F.concat(p["a"], p["m"]), *([p["a"]] if alone else [])))

    coded = F.concat(found(rf"\b({codes})\b{BETWEEN}({SPACED_AMOUNT})", 2, 1, False), found(rf"({SPACED_AMOUNT}){BETWEEN}\b({codes})\b", 1, 2, False))
    signed = F.concat(found(rf"([{MONEY_SIGNS}])\s*({SPACED_AMOUNT})", 2, 1, True), found(rf"({SPACED_AMOUNT})([{MONEY_SIGNS}])", 1, 2, True))
    none = F.array().cast("array<array<string>>")
    return F.concat(F.when(plain.rlike(codes), coded).otherwise(none), F.when(plain.rlike(f"[{MONEY_SIGNS}]"), signed).otherwise(none))


def shows_price(plain: Column, amounts: Column) -> Column:
    """A price can be seen in a folded text; amounts: its currency_amounts. Karat gold is none."""
    ungilded = F.when(plain.contains("gold"), F.regexp_replace(plain, _UNICODE + KARAT, " ")).otherwise(plain)
    return (F.size(amounts) > 0) | ungilded.rlike(_UNICODE + "|".join(PRICE))


def _strip(t: Column, marks: str = ":,.;/-") -> Column:
    inside = "".join("\\" + m for m in marks)
    return F.regexp_replace(t, f"^[{inside}]+|[{inside}]+$", "")


def _amount_like(t: Column) -> Column:
    return t.rlike(r"^\d+(?:[,.]\d+)*(?:k|m)?$") & ~t.rlike(r"^(?:19|20)\d\d$")


def _references(c: Column) -> Column:
    """Distinct tokens of a text that look like product references."""
    toks = F.transform(F.regexp_extract_all(c, F.lit(_UNICODE + REFERENCE), F.lit(0)), lambda t: _strip(t, ":,.;"))
    keep = lambda t: ((F.length(t) >= 4) | t.contains("/")) & ~t.rlike("|".join(CODES)) & ~_amount_like(t) & ~t.rlike(r"^(?:19|20)\d\d$")
    return F.array_distinct(F.filter(toks, keep))


def _non_sale(words: Column) -> Column:
    head = F.array_join(F.slice(words, 1, 4), " ")
    return F.get(words, F.lit(0)).isin("lookingfor", "wtb") | head.startswith("looking for") | head.startswith("want to buy")


def _word(words: Column, from_end: int, marks: str = ":,.;/-") -> Column:
    return _strip(F.coalesce(F.get(words, F.size(words) - from_end), F.lit("")), marks)


def with_issues(df: DataFrame, text: str, raw: str, out: str = "issues") -> DataFrame:
    """df with the column ``out``: array<struct<reason, severity>> of the rules that a shown text breaks.

    raw is the whole post; null and empty ones rule nothing. A text is compared in lower case with single blanks. Where a
    price shows, no rule applies. The longer post and the missing price only count where no stronger rule does. Null and
    empty texts break no rule. The parts that several rules need are columns of their own, worked out once a row.
    """
    lower = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"(?U)\s+", " "))
    keep = list(df.columns)
    t, r, words, plain, amounts, price, refs = (F.col(f"__{n}") for n in ("t", "r", "words", "plain", "amounts", "price", "refs"))
    rows = df.withColumns({"__t": lower(text), "__r": lower(raw)})
    rows = rows.withColumn("__plain", _plain(t))
    rows = rows.withColumns({"__amounts": currency_amounts(plain), "__words": F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))})
    rows = rows.withColumn("__price", shows_price(plain, amounts))
    rows = rows.withColumn("__raw", F.when(~price & (t != ""), _plain(r)))  # only looked at where no price shows
    rows = rows.withColumn("__refs", F.when(~price, _references(t)).otherwise(F.array().cast("array<string>")))

    last, second, third = _word(words, 1), _word(words, 2), _word(words, 3)
    codes = [F.lit(c) for c in CODES]
    doubled = second.isin(*codes) & ((F.size(words) == 2) | ~_amount_like(third))
    after_amount = _amount_like(_word(words, 2, ":,.;/-$")) | (second.isin("k", "m", "mil", "million") & _amount_like(third))
    ends_with_code = last.isin(*codes) & ~doubled & ~after_amount
    ends_with_marker = last.isin("price", "$", "💰", "💲") | (t.rlike("[$💰💲]$") & ~t.rlike(MARKED_END))
    lost = F.exists(currency_amounts(F.col("__raw")), lambda forms: F.exists(forms, lambda f: ~F.contains(_compact(t), f)))
    unpriced = t.rlike(_UNICODE + REFERENCE) & ~_non_sale(words)
    stock_list = (r != "") & (t != "") & (r != t) & unpriced & r.rlike(_UNICODE + STOCK_LIST) & (F.size(_references(r)) > 1)
    others = F.filter(F.transform(words, lambda w: _strip(w, ":,.;")), lambda w: ~F.array_contains(refs, w) & ~w.isin(*BRANDS))
    fragment = (F.size(refs) > 0) & (F.size(others) == 0) & ~_non_sale(words)
    longer = (r != "") & (t != "") & (r != t) & (F.length(r) >= F.greatest(F.length(t) + 40, F.floor(F.length(t) * 1.8)))

    issue = lambda name, severity: F.struct(F.lit(name).alias("reason"), F.lit(severity).alias("severity"))
    strong = F.array_compact(
        F.array(
            F.when(ends_with_code, issue("ends_with_currency", 3)), F.when(ends_with_marker, issue("ends_with_price_marker", 3)),
            F.when(lost, issue("missing_price_after_currency", 3)), F.when(stock_list, issue("scoped_stock_list_missing_price", 2)),
            F.when(fragment, issue("reference_only_fragment", 2)),
        )
    )
    none = F.array().cast("array<struct<reason:string,severity:int>>")
    rows = rows.withColumn("__strong", F.when(price | (t == ""), none).otherwise(strong))
    weak = F.when(longer, F.array(issue("raw_much_longer", 2))).when(unpriced, F.array(issue("missing_price_evidence", 1))).otherwise(none)
    found = F.when((F.size("__strong") > 0) | price | (t == ""), F.col("__strong")).otherwise(weak)
    return rows.select(*[c for c in keep if c != out], found.alias(out))
