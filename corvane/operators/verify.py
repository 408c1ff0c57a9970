"""Claim verification: docket anchoring, verdict synthesis, baseline verifiers, trust and citations."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import legal
from corvane.functions.scores import badge, dot, let
from corvane.functions.text import bm25_tokens, snippet
from corvane.operators.retrieve import EPSILON, B, K1

NO_PASSAGE = "No evidence passages retrieved for the requested source document"


class Scorer(Protocol):
    """Adds verdict, confidence and p_supported, p_contradicted, p_unsupported to rows with claim_text and text.  A native
    expression or a pandas UDF may stand behind it."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def lexical_scorer(pairs: DataFrame, supported: float = 0.70, contradicted: float = 0.70) -> DataFrame:
    """Offline default: the share of a claim's distinct tokens that the passage holds is the probability of support."""
    claim, text = F.array_distinct(bm25_tokens(F.col("claim_text"))), bm25_tokens(F.col("text"))
    pairs = pairs.withColumns({"_c": claim, "_t": text})
    share = F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("_c", "_t")), F.size("_c")), F.lit(0.0)), 6)
    pairs = pairs.withColumn("p_supported", share).withColumn("p_contradicted", F.lit(0.0)).withColumn("p_unsupported", F.round(1 - F.col("p_supported"), 6))
    verdict = F.when(F.col("p_supported") >= supported, "SUPPORTED").when(F.col("p_contradicted") >= contradicted, "CONTRADICTED").otherwise("UNSUPPORTED")
    confidence = F.when(F.col("p_supported") >= supported, F.col("p_supported")).when(F.col("p_contradicted") >= contradicted, F.col("p_contradicted")).otherwise(F.col("p_unsupported"))
    return pairs.withColumns({"verdict": verdict, "confidence": confidence}).drop("_c", "_t")


def anchored(passages: DataFrame, *claim: str, asked: str | None = None) -> DataFrame:
    """Passages (rank, doc_id) of each claim that belong to its anchor: the asked docket, else the first non-null doc_id by rank."""
    window = Window.partitionBy(*claim).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first_value(F.col("doc_id").cast("string"), F.lit(True)).over(window)
    anchor = F.coalesce(F.col(asked).cast("string"), first) if asked else first
    return passages.withColumn("anchor", anchor).where("anchor IS NULL OR cast(doc_id AS string) = anchor")


def with_legal_checks(pairs: DataFrame) -> DataFrame:
    """Adds legal_flags and deterministic (whether the references contradict)."""
    pairs = pairs.withColumn("_c", legal.entities(F.col("claim_text")))
    pairs = pairs.withColumn("_e", legal.entities(F.col("text"), F.col("_c")))
    return pairs.withColumns({"legal_flags": legal.flags(F.col("_c"), F.col("_e")), "deterministic": legal.contradicts(F.col("_c"), F.col("_e"))}).drop("_c", "_e")


def synthesize(scored: DataFrame, *claim: str) -> DataFrame:
    """One verdict per claim from scored passages (rank, chunk_id, verdict, confidence, p_unsupported, deterministic, high_flag).

    Contradiction stands above support, support above the rest.  Equal confidences go to the better rank, and evidence
    needs a confidence above 0.
    """
    con, sup = (F.col("deterministic") | (F.col("verdict") == "CONTRADICTED")), F.col("verdict") == "SUPPORTED"
    best = F.struct("confidence", -F.col("rank"))
    picked = scored.groupBy(*claim).agg(
        F.bool_or(con).alias("_con"), F.bool_or(sup & (F.col("confidence") > 0)).alias("_sup"),
        F.max_by("chunk_id", F.when(con & (F.col("confidence") > 0), best)).alias("_con_chunk"), F.max(F.when(con, F.col("confidence"))).alias("_con_conf"),
        F.max_by("chunk_id", F.when(sup & (F.col("confidence") > 0), best)).alias("_sup_chunk"), F.max(F.when(sup, F.col("confidence"))).alias("_sup_conf"),
        F.min_by("chunk_id", "rank").alias("_first"), F.max("p_unsupported").alias("_neutral"), F.bool_or("high_flag").alias("_high"),
    )
    verdict = F.when(F.col("_con"), "CONTRADICTED").when(F.col("_sup"), "SUPPORTED").otherwise("UNSUPPORTED")
    confidence = F.when(F.col("_con"), F.greatest("_con_conf", F.when(F.col("_high"), 0.85).otherwise(0.70))).when(F.col("_sup"), F.col("_sup_conf")).otherwise(F.col("_neutral"))
    evidence = F.when(F.col("_con"), F.col("_con_chunk")).when(F.col("_sup"), F.col("_sup_chunk")).otherwise(F.col("_first"))
    return picked.select(*claim, verdict.alias("verdict"), confidence.alias("confidence"), evidence.alias("evidence_id"))


def with_unmatched(claims: DataFrame, verdicts: DataFrame, *claim: str) -> DataFrame:
    """All claims; one without a passage is UNSUPPORTED with confidence 1.0 and a reason."""
    out = claims.join(verdicts, list(claim), "left")
    none = F.col("verdict").isNull()
    return out.withColumns({"reason": F.when(none, NO_PASSAGE), "confidence": F.when(none, 1.0).otherwise(F.col("confidence")), "verdict": F.coalesce("verdict", F.lit("UNSUPPORTED"))})


def trust(verdicts: DataFrame, *response: str, penalty: float = 1.0) -> DataFrame:
    """trust_score, total_claims, counts and percentages per response; without claims use empty_trust()."""
    n = F.count("*")
    sums = {v: F.sum(F.when(F.col("verdict") == v, F.col("confidence")).otherwise(0.0)) for v in ("SUPPORTED", "CONTRADICTED")}
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sums["SUPPORTED"] - penalty * sums["CONTRADICTED"]) / n)), 4)
    parts = [(v.lower(), F.count_if(F.col("verdict") == v)) for v in ("SUPPORTED", "CONTRADICTED", "UNSUPPORTED")]
    out = verdicts.groupBy(*response).agg(score.alias("trust_score"), n.alias("total_claims"), *[c.alias(f"n_{v}") for v, c in parts], *[F.round(100 * c / n, 2).alias(f"pct_{v}") for v, c in parts])
    return out.withColumn("badge", badge(F.col("trust_score")))


def citations(verdicts: DataFrame, passages: DataFrame, *response: str, dedupe: bool = False) -> DataFrame:
    """A citation per claim with evidence, numbered by the claim; optionally the first per chunk only."""
    rows = verdicts.where("evidence_id IS NOT NULL").join(passages, verdicts["evidence_id"] == passages["chunk_id"])
    out = rows.select(*response, F.col("claim_index").alias("citation_index"), "claim_index", "claim_text", "verdict", "doc_id", "chunk_id", F.array("char_start", "char_end").alias("char_span"), F.col("text").alias("evidence_text"))
    if dedupe:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*response, "chunk_id").orderBy("claim_index"))).where("_n = 1").drop("_n")
    return out


def report(verdicts: DataFrame, summary: DataFrame, *response: str) -> DataFrame:
    """A Markdown report per response."""
    line = F.format_string("%d. **[%s]** `%s` *(Confidence: %.2f)*", "claim_index", "verdict", "claim_text", "confidence")
    line = F.concat(line, F.coalesce(F.concat(F.lit("\n   - **Reason**: "), F.col("reason")), F.lit("")), F.coalesce(F.concat(F.lit("\n   - *Evidence*: "), snippet(F.col("evidence_text"), 150)), F.lit("")))
    lines = verdicts.groupBy(*response).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    head = F.format_string("# Verification report\n\n**Status**: [%s] (Trust Score: `%.2f%%`)\n**Claims**: %d Supported | %d Contradicted | %d Unsupported (Total: %d)\n\n", "badge", 100 * F.col("trust_score"), "n_supported", "n_contradicted", "n_unsupported", "total_claims")
    return summary.join(lines, list(response)).select(*response, F.concat(head, F.col("_lines")).alias("report"))


def bm25_pair_score(claim: Column, passage: Column) -> Column:
    """Score of claim tokens against passage tokens as a corpus of one: every idf is negative and floored, so no score is above 0.

    The passage is read once, for its tokens that the claim holds; each claim token is counted among these few.
    """
    ones = (F.log(F.lit(0.5)) - F.log(F.lit(1.5))) * EPSILON
    term = lambda tf: ones * tf * (K1 + 1) / (tf + K1 * (1 - B + B))
    shared = F.struct(claim.alias("c"), F.filter(passage, lambda x: F.array_contains(claim, x)).alias("held"))
    summed = let(shared, lambda s: F.aggregate(F.transform(s["c"], lambda w: F.size(F.filter(s["held"], lambda x: x == w)).cast("double")), F.lit(0.0), lambda x, tf: x + term(tf)))
    return F.when((F.size(claim) > 0) & (F.size(passage) > 0), F.round(summed, 6)).otherwise(0.0)


def bm25_verifier(pairs: DataFrame, threshold: float = 8.0, claim: str = "claim_tokens", passage: str = "passage_tokens") -> DataFrame:
    """Adds score, verdict and confidence to rows with both token arrays (see bm25_tokens); tokenise each text once, before pairing."""
    pairs = pairs.withColumn("score", bm25_pair_score(F.col(claim), F.col(passage)))
    return pairs.withColumns({"verdict": F.when(F.col("score") >= threshold, "SUPPORTED").otherwise("UNSUPPORTED"), "confidence": F.least(F.lit(1.0), F.col("score") / 20)})


def cosine_verifier(pairs: DataFrame, a: str, b: str, threshold: float = 0.70) -> DataFrame:
    pairs = pairs.withColumn("score", F.round(dot(F.col(a), F.col(b)), 6))
    return pairs.withColumn("verdict", F.when(F.col("score") >= threshold, "SUPPORTED").otherwise("UNSUPPORTED"))


def hybrid_override(verdict: Column, deterministic: Column) -> Column:
    return F.when(deterministic, "CONTRADICTED").otherwise(verdict)
