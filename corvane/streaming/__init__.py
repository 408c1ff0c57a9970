"""Streams: an extension (the batch engine has none).  Incoming claims meet a static index, and events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import bm25_tokens
from corvane.operators.retrieve import Bm25Index, term_score


def claims_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (claim_id string, claim_text string, ts timestamp) as they arrive in a folder."""
    return spark.readStream.schema("claim_id string, claim_text string, ts timestamp").json(path)


def stream_scores(claims: DataFrame, index: Bm25Index) -> DataFrame:
    """BM25 contributions of streamed claims against a static index, a row per claim, document and term (stream-static joins)."""
    terms = claims.select("claim_id", "ts", F.explode_outer(bm25_tokens(F.col("claim_text"))).alias("term")).where("term IS NOT NULL")
    hits = terms.join(index.terms, "term").join(index.postings, "term").crossJoin(F.broadcast(index.totals))
    return hits.select("claim_id", "ts", "key", "term", term_score(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("score"))


def windowed_counts(events: DataFrame, time: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count per tumbling window and kind; with a watermark, so that state is dropped."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_t", length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), kind, "n")
