"""Packing: optimal length buckets and token-budget batches.

1. Every text's length in tokens of a public byte-level BPE vocabulary.
2. The global histogram of lengths (one row per distinct length, so its size
   depends on the longest text, not on the corpus).
3. Dynamic programming over the histogram finds the bucket boundaries that
   minimise total padding, when every text is padded to its bucket's longest.
   The cost has the quadrangle inequality, so each layer is solved by divide and
   conquer in L log L steps for L lengths.
4. Inside a bucket with boundary b a batch takes max(1, token_budget // b) texts.
   Texts are ranked without gathering a bucket in one task: they are dealt to
   shards by hash, shard sizes give each shard's offset, and ranks count on from
   there.

Edge cases: null and empty texts have no token and go to bucket 0 with boundary 0
and no batch; a text beyond the token budget is a batch of its own; equal lengths
share a bucket; rows that share a doc_id are packed one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHED_LENGTH = 1 << 18, 64  # pieces remembered, and the longest of them: 30 MB or so
_MEETING = re.compile(r" \s|\s ")


class TokenCounter:
    """Token counts of whole texts.  A pre-token never reaches across a single blank, so pieces between blanks are counted
    once and remembered; texts with other runs of white space at a blank are encoded whole."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("corvane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if text[0] == " " or text[-1] == " " or _MEETING.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        known, encode = self.known, self.encode
        if len(known) > CACHE_WORDS:
            known.clear()
        total = len(encode(first))
        for piece in rest:
            n = known.get(piece)
            if n is None:
                n = len(encode(" " + piece))
                if len(piece) <= CACHED_LENGTH:
                    known[piece] = n
            total += n
        return total


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row.  The vocabulary file is read on the driver and travels with the job."""
    blob = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(blob)
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The boundaries (ascending, each a length that occurs) of at most `buckets` buckets with the least total padding."""
    L = len(lengths)
    if L <= buckets:
        return list(lengths)
    size = np.array(lengths, np.float64)
    held = np.concatenate([[0.0], np.cumsum(np.array(counts, np.float64))])
    # padded tokens of texts a..b-1 in one bucket: size[b-1] * (held[b] - held[a]); the texts' own tokens are the same for any choice
    best = size * held[1:]
    best = np.concatenate([[0.0], best])
    choice = []
    for _ in range(1, buckets):
        new, cut = np.full(L + 1, np.inf), np.zeros(L + 1, np.int64)
        new[0] = 0.0
        stack = [(1, L, 0, L - 1)]
        while stack:
            lo, hi, from_, to = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            a = np.arange(from_, min(to, mid - 1) + 1)
            cost = best[a] + size[mid - 1] * (held[mid] - held[a])
            k = int(a[np.argmin(cost)])
            new[mid], cut[mid] = cost.min(), k
            stack += [(lo, mid - 1, from_, k), (mid + 1, hi, k, to)]
        choice.append(cut)
        best = new
    out, b = [], L
    for cut in reversed(choice):
        out.append(lengths[b - 1])
        b = int(cut[b])
        if b == 0:
            break
    if b:
        out.append(lengths[b - 1])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 16_384, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bucket (from 1), boundary, batch (from 0 in its bucket; null without tokens), padding."""
    lengths = materialise(token_lengths(docs, vocabulary), "token-lengths")
    histogram = sorted((r["n_tokens"], r["n"]) for r in lengths.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds = optimal_boundaries([n for n, _ in histogram], [c for _, c in histogram], buckets)
    spark = docs.sparkSession
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    bucket = F.when(F.col("n_tokens") > 0, F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))) + 1).otherwise(0)
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lengths.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("offset"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1).join(offsets, ["bucket", "shard"])
    boundary = F.when(F.col("bucket") > 0, F.get(limits, F.col("bucket") - 1)).otherwise(0).cast("long")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.nullif(F.col("boundary"), F.lit(0))))
    return ranked.withColumn("boundary", boundary).select(
        "doc_id", "n_tokens", F.col("bucket").cast("long").alias("bucket"), "boundary",
        F.when(F.col("bucket") > 0, F.floor((F.col("offset") + F.col("at")) / per_batch)).cast("long").alias("batch"), (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
