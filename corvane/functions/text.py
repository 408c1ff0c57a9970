"""Tokens, sentences, claims and small text repairs as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space at either end (trim() takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words; a single character counts only if it is a letter or digit."""
    return F.transform(F.filter(words(text), lambda w: (F.length(w) > 1) | w.rlike(r"^[\p{L}\p{N}]$")), lambda w: F.lower(w))


def approx_tokens(text: Column) -> Column:
    """Blanks + 1."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def snippet(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def first_words(text: Column, n: int = 15) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def last_words(text: Column, n: int = 10) -> Column:
    own = words(text)
    return F.array_join(F.slice(own, F.greatest(F.size(own) - n + 1, F.lit(1)), n), " ")


#: Words before a full stop that don't end a sentence, and the pattern of a sentence's end.
ABBREVIATIONS = ["v", "vs", "no", "nos", "sec", "secs", "art", "dr", "mr", "mrs", "ms", "rs", "hon", "ltd", "co", "inc", "al", "ibid", "id", "sk", "md", "st", "u", "w", "cj"]
_BOUNDARY = r"""((?:(?<=[A-Za-z0-9])(?<!(?<![A-Za-z0-9])(?i:%s))|(?<=[)\]"']))[.!?]["')]*)(\s+)(?=[A-Z0-9"'(\[])""" % "|".join(ABBREVIATIONS)
CUT = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences as array<string>, trimmed; abbreviations don't end one."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, _BOUNDARY, f"$1{CUT}$2"), CUT, -1), trimmed), lambda s: s != "")


def simple_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: s != "")


#: Where a claim's sentence ends, and the connectives that cut it.
_CLAIM_SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z0-9"'])"""
_CONNECTIVE = r"(?i);|\b(?:and|but|whereas|furthermore|moreover)\b"


def decompose_claims(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, claim_index (from 1), claim_text, source_sentence, method: clauses of at least three words.

    Sentences are cut at connectives; each clause gets a capital and an end mark.
    """
    flat = trimmed(F.regexp_replace(F.col(text), r"\s+", " "))
    cut = df.select(*keys, F.posexplode_outer(F.split(flat, _CLAIM_SENTENCE, -1)).alias("_s", "source_sentence")).where("source_sentence <> ''")
    parts = F.filter(F.transform(F.split("source_sentence", _CONNECTIVE, -1), trimmed), lambda p: p != "")
    cut = cut.withColumn("_parts", parts)
    cut = cut.select(*keys, "_s", "source_sentence", F.posexplode_outer(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.array("source_sentence"))).alias("_p", "_c"))
    capital = F.concat(F.upper(F.substring("_c", 1, 1)), F.expr("substring(_c, 2)"))
    claim = F.when(capital.rlike(r"[.!?]$"), capital).otherwise(F.concat(capital, F.lit(".")))
    kept = cut.select(*keys, "_s", "_p", "source_sentence", claim.alias("claim_text")).where(F.size(F.split("claim_text", r"\s+", -1)) >= 3)
    # numbering needs a text's clauses together, never more
    packed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_s", "_p", "claim_text", "source_sentence"))).alias("_all"))
    numbered = packed.select(*keys, F.posexplode("_all").alias("_i", "_x"))
    return numbered.select(*keys, (F.col("_i") + 1).alias("claim_index"), "_x.claim_text", "_x.source_sentence", F.lit("rule_based").alias("method"))


def decompose(df: DataFrame, text: str, *keys: str, method: str = "auto", ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Claims by rule, or by a model's replies: ask adds a column `reply` (a JSON list) to df.  A reply that is no list, and any
    method but "llm" and "auto", falls back to the rules; "auto" asks only where there is someone to ask."""
    if ask is None or method not in ("llm", "auto"):
        return decompose_claims(df, text, *keys)
    replies = ask(df).withColumn("_claims", parse_claim_list(F.col("reply")))
    found = F.size(F.coalesce("_claims", F.array().cast("array<string>"))) > 0
    ruled = decompose_claims(replies.where(~found), text, *keys)
    asked = replies.where(found).select(*keys, F.posexplode("_claims").alias("_i", "claim_text"), F.col(text).alias("source_sentence"))
    return ruled.unionByName(asked.select(*keys, (F.col("_i") + 1).alias("claim_index"), "claim_text", "source_sentence", F.lit("llm").alias("method")))


def parse_claim_list(reply: Column) -> Column:
    """The strings of a JSON list, with or without a code fence; null where the reply is no such list."""
    body = F.regexp_replace(trimmed(reply), r"^```(?:json)?\s*|\s*```$", "")
    items = F.from_json(body, "array<string>")
    return F.filter(F.transform(items, trimmed), lambda s: s != "")


#: Rules for a "number" that stands for a negation, in order.
_NUMBER_RULES = [
    (r"\b(shall|will|would|could|should|can|may|might|must|do|does|did|is|are|was|were|has|have|had|having|need|dare|ought)\s+number\b(?!\s+(?:of|\d+|one|two|three|four|five)\b)", "$1 not"),
    (r"\b(there\s+(?:is|was|were|are|being))\s+number\b(?!\s+(?:of|\d+)\b)", "$1 no"),
    (r"\b(whether\s+or|or|if|why)\s+number\b(?!\s+of\b)", "$1 not"),
    (r"\bnumber\s+(only|exceeding|less\s+than|more\s+than|earlier\s+than|later\s+than|below|above|to\s+apply|to\s+be|to\s+have|to\s+interfere|being|having|found)\b", "not $1"),
    (r"\bnumber\s+(available|maintainable|sustainable|applicable|entitled|eligible|permissible|feasible|possible|acceptable|justified|satisfied|proved|proven|guilty|valid|binding|correct|true|clear|disputed|challenged)\b", "not $1"),
]


def repair_standalone_number(text: Column) -> Column:
    for pattern, put in _NUMBER_RULES:
        text = F.regexp_replace(text, "(?i)" + pattern, put)
    return text


#: Phrases in which "number" is a noun.
NUMBER_PHRASES = [
    r"number\s+of", r"the\s+number", r"a\s+number", r"large\s+number", r"small\s+number", r"total\s+number", r"any\s+number", r"case\s+number", r"serial\s+number",
    r"registration\s+number", r"order\s+number", r"rule\s+number", r"section\s+number", r"item\s+number", r"page\s+number", r"equal\s+number", r"greater\s+number", r"lesser\s+number", r"in\s+number",
]


def legit_number_count(text: Column) -> Column:
    """Hits of all phrases; one place can count for two of them."""
    total = F.lit(0)
    for phrase in NUMBER_PHRASES:
        total = total + F.regexp_count(text, F.lit(rf"(?i)\b{phrase}\b"))
    return total.cast("long")


#: Fixed value: Roman numerals after a "number".
_ROMAN = "(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)"


def negation_rule(right: Column) -> Column:
    """Label of a "number" by what follows it: non, KEEP_NUMBER or null."""
    return F.when(right.rlike(r"^\s*[-–—]\s*[a-zA-Z]"), "non").when(right.rlike(rf"(?i)^\s*(?:\d+\b|{_ROMAN}\b|\.\s*\d+)"), "KEEP_NUMBER")


def number_trigger(right: Column) -> Column:
    """dot_digit, digit or roman_numeral, or null."""
    return F.when(right.rlike(r"^\s*\.\s*\d+"), "dot_digit").when(right.rlike(r"^\s*\d+\b"), "digit").when(right.rlike(rf"(?i)^\s*{_ROMAN}\b"), "roman_numeral")


def roman_of(right: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(right, rf"(?i)^\s*({_ROMAN})\b", 1), F.lit("")))


#: Replacements that turn a claim's meaning, the first that fits is used once.
MUTATIONS = [
    (r"\ballowed\b", "dismissed"), (r"\bdismissed\b", "allowed"), (r"\bacquitted\b", "convicted"), (r"\bconvicted\b", "acquitted"),
    (r"\baffirmed\b", "set aside"), (r"\bset aside\b", "confirmed and upheld"), (r"\bguilty\b", "innocent of all charges"),
    (r"\bSection 302\b", "Section 420"), (r"\bSection 138\b", "Section 376"), (r"\bHigh Court\b", "Sessions Court"),
    (r"\bSupreme Court\b", "Gram Panchayat"), (r"\bappellant\b", "respondent"), (r"\b19\d\d\b", "2035"), (r"\b20\d\d\b", "1910"),
]


def mutate_claim(claim: Column) -> Column:
    """The first fitting mutation at its first place; else a prefix and a negation of every "is" and "was"."""
    out = None
    for pattern, put in MUTATIONS:
        hit, new = claim.rlike("(?i)" + pattern), F.regexp_replace(claim, rf"(?is)^(.*?){pattern}", f"$1{put}")
        out = F.when(hit, new) if out is None else out.when(hit, new)
    plain = F.concat(F.lit("It was conclusively held that "), F.lower(F.substring(claim, 1, 1)), F.substring(claim, F.lit(2), F.length(claim)))
    return out.otherwise(F.replace(F.replace(plain, F.lit("is"), F.lit("is not")), F.lit("was"), F.lit("was not")))
