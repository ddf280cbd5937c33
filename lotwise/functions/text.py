"""Text columns: normal forms, tokens, descriptors, dates, prices and links. Every function maps columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:[./-][a-z0-9]+)*"
CURRENCIES = "hkd|usdt|usd|eur|aed|chf"

# Composed Latin letters and their base letters (there is no built-in canonical decomposition).
_COMPOSED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Descriptor aliases, phrases, conflicts and colours.
ALIASES = {
    "choco": "choco", "chocolate": "choco", "cho": "choco", "mete": "mete", "meteorite": "mete", "gray": "gray", "grey": "gray",
    "mop": "mop", "mother-of-pearl": "mop", "motherofpearl": "mop", "rg": "rg", "rosegold": "rg", "rose-gold": "rg",
    "wg": "wg", "whitegold": "wg", "white-gold": "wg",
}
PHRASES = {"mother of pearl": "mop", "rose gold": "rg", "white gold": "wg"}
CONFLICTS = {"rg": "wg", "wg": "rg"}
COLORS = ["black", "blue", "champ", "champagne", "choco", "gray", "green", "purple", "red", "silver", "white"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def fold(c: str | Column) -> Column:
    """Lower case without accents or combining marks; texts of one byte a character have none of them."""
    text = F.coalesce(col(c), F.lit(""))
    folded = F.regexp_replace(F.translate(F.lower(text), _COMPOSED, _PLAIN), r"\p{M}", "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def tokens(c: str | Column) -> Column:
    """Tokens of letters and digits, joined inside by single dots, slashes or dashes; null has none."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def normalize_text(c: str | Column) -> Column:
    return F.array_join(tokens(c), " ")


def compact_text(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def canonical_token(t: Column) -> Column:
    return F.coalesce(F.element_at(_map(ALIASES), t), t)


def canonical_tokens(toks: Column) -> Column:
    """Aliases replaced token by token, then phrases merged from left to right (they never overlap)."""
    text = F.concat(F.lit(" "), F.array_join(F.transform(toks, canonical_token), "  "), F.lit(" "))
    for phrase, name in PHRASES.items():
        text = F.regexp_replace(text, " " + phrase.replace(" ", "  ") + " ", f" {name} ")
    return F.filter(F.split(F.trim(text), " +"), lambda t: t != "")


_RENAMED = "|".join([k for k, v in ALIASES.items() if k != v] + list(PHRASES))


def canonical_words(text: Column) -> Column:
    """canonical_tokens of the tokens that a text joins by single blanks; most texts have nothing to rename, which one test tells."""
    plain = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
    return F.when(text.rlike(f"(?:^| )(?:{_RENAMED})(?: |$)"), canonical_tokens(plain)).otherwise(plain)


def conflict_descriptors(canonical: Column) -> Column:
    return F.array_compact(F.array_distinct(F.transform(canonical, lambda t: F.element_at(_map(CONFLICTS), t))))


def color_set(c: str | Column) -> Column:
    """Canonical colour words of a text."""
    return F.array_intersect(canonical_tokens(tokens(c)), F.array(*map(F.lit, COLORS)))


def is_non_sale(c: str | Column) -> Column:
    """Somebody looks for an item instead of offering one."""
    return reads_non_sale(normalize_text(c))


def reads_non_sale(normal: Column) -> Column:
    """is_non_sale of a text whose normalize_text is at hand."""
    return normal.rlike("^(wtb|lookingfor)( |$)|^looking for|^want to buy")


def squeeze(c: str | Column) -> Column:
    """White space runs become one blank; nothing left becomes null."""
    out = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.nullif(out, F.lit(""))


def clean_display_text(c: str | Column) -> Column:
    """Squeezed text without trailing separators, brand words and `new` (but `like new` stays)."""
    out = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    out = F.regexp_replace(out, r"\s*[•|]+\s*$", "")
    out = F.regexp_replace(out, r"(?i)\s+(P\.p|PP|AP|Patek Philippe|Audemars Piguet)\s*[^a-zA-Z0-9_\s$./-]*$", "")
    shorter = F.regexp_replace(out, r"(?i)(\s*[^a-zA-Z0-9_\s$./-]*\s*new\s*)+$", "")
    return F.when(F.regexp_like(out, F.lit(r"(?i)\blike\s+new\s*$")), out).otherwise(shorter)


def parse_posted_date(c: str | Column) -> Column:
    """Date of `Month d, yyyy`, `Mon d, yyyy` or an ISO time, cut at a middle dot; else null."""
    text = F.substring(F.trim(F.split_part(col(c), F.lit("·"), F.lit(1))), 1, 19)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss")])


def posted_date_text(c: str | Column) -> Column:
    return F.date_format(col(c), "MMMM d, yyyy")


def clean_phone(*columns: str | Column) -> Column:
    """Digits of the first usable column: 8 to 15 digits, no leading zero."""
    digits = [F.regexp_replace(col(c), "[^0-9]", "") for c in columns]
    return F.coalesce(*[F.when(F.length(d).between(8, 15) & ~d.startswith("0"), d) for d in digits])


def normalize_url(c: str | Column, base: str) -> Column:
    """Absolute http(s) link of at most 2048 characters; links from the root resolve on base, others are null."""
    url = F.trim(col(c))
    whole = F.when(url.rlike("(?i)^https?://[^/ ]+"), url).when(url.startswith("/") & ~url.startswith("//"), F.concat(F.lit(base.rstrip("/")), url))
    return F.when(F.length(whole) <= 2048, whole)


def year_like(t: Column) -> Column:
    return t.rlike("^(19|20)[0-9]{2}$")


def price_like(t: Column) -> Column:
    return t.rlike(r"^[0-9]+(\.[0-9]+)?[km]$") | t.rlike(f"^({CURRENCIES})[0-9]") | t.rlike(f"^[0-9]+({CURRENCIES})$")


def date_or_condition_like(t: Column) -> Column:
    return t.rlike("^n?[0-9]{1,2}[/-][0-9]{2,4}y?$") | t.rlike("^[0-9]{4}[./-][0-9]{1,2}y?$") | t.rlike("^n[0-9]{1,2}$")


def parse_query_terms(c: str | Column) -> tuple[Column, Column]:
    """(references, descriptors) of a query: tokens with a digit that are no year, price or date, and the other tokens.

    `and` and `or` are dropped; `123 or word` is the reference `123or` before the word.
    """
    raw = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))
    fused = F.regexp_replace(F.array_join(canonical_tokens(raw), " "), "(^| )([0-9]+) or ([a-z]+)(?= |$)", "$1$2or $3")
    toks = F.filter(F.split(fused, " "), lambda t: ~t.isin("and", "or", ""))
    descriptive = lambda t: ~t.rlike("^[0-9]{2}-[0-9]{2}$") & (year_like(t) | price_like(t) | date_or_condition_like(t))
    is_reference = lambda t: t.rlike("[0-9]") & ~descriptive(t)
    return F.filter(toks, is_reference), F.filter(toks, lambda t: ~is_reference(t))


def price_mentions(c: str | Column) -> Column:
    """Distinct whole amounts: thousands groups, currency amounts, k and m amounts, plain numbers of 5 to 8 digits."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    number = r"(?:[0-9]{1,3}(?:[,. ][0-9]{3})+|[0-9]+(?:\.[0-9]+)?[km]?)"
    found = F.regexp_extract_all(text, F.lit(rf"(?:\b(?:{CURRENCIES})\s*|[$€£¥]\s*){number}|\b[0-9]{{1,3}}(?:[,. ][0-9]{{3}})+\b|\b[0-9]+(?:\.[0-9]+)?[km]\b|\b[0-9]{{5,8}}\b"), F.lit(0))

    def amount(m: Column) -> Column:
        raw = F.regexp_extract(m, r"[0-9][0-9,. ]*[0-9]|[0-9]", 0)
        times = F.when(m.rlike("m$"), 1_000_000).when(m.rlike("k$"), 1_000).otherwise(1)
        grouped = (times == 1) & raw.rlike("^[0-9]{1,3}([,. ][0-9]{3})+$")
        plain = F.when(grouped, F.regexp_replace(raw, "[,. ]", "")).otherwise(F.regexp_replace(raw, "[, ]", ""))
        return F.floor(plain.cast("double") * times).cast("long")

    return F.array_distinct(F.transform(found, amount))


def redact(c: str | Column, n: int = 160) -> Column:
    """Secret values and state paths replaced, blanks squeezed, cut to n characters with dots."""
    out = F.regexp_replace(col(c), r"(?i)\b(token|secret|password|api[_-]?key)\b\s*[:=]\s*[^ \t\n,;]+", "$1=[redacted]")
    out = F.regexp_replace(out, r"/(?:root|home|var|tmp)/[^ \t\n]*", "[path]")
    out = F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))
    return F.when(F.length(out) > n, F.concat(F.rtrim(F.substring(out, 1, n - 3)), F.lit("..."))).otherwise(out)
