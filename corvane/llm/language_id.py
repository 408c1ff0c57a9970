"""Language ID: every document as a mixture of languages.

Training counts hashed letter trigrams per language over a bounded sample of the
labelled rows.  For a document, expectation-maximisation estimates the
proportions of a set of languages from the trigram likelihoods.  Sets are nested:
languages enter in the order of their share in the full mixture, and the set with
the best likelihood, less PENALTY * ln(letters) for each language beyond the
first, is selected.  The language with the largest proportion is predicted; its
proportion is the score.

Edge cases: a null text, or one without a letter, is `und` with score 0 and no
mixture; whole texts are read, whatever their length; ties go to the language
whose name sorts first; without training rows every text is `und`; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U64, batches_of, mix64

SAMPLE_ROWS = 20_000  # bound of the training sample over all languages
BITS = 16
PIECE = 1 << 20
SMOOTHING = 0.05
PENALTY = 8.0
ROUNDS = 25


def _fold(code: int) -> int:
    """The code point of a letter's lower case, 0 for what is no letter."""
    return ord(chr(code).lower()[0]) if chr(code).isalpha() else 0


_tables: dict[str, np.ndarray] = {}


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams and their counts: the one that ends at each letter, with a blank for what stands before a word.

    A text is read in pieces of PIECE characters, so a long one needs no more memory than a piece.
    """
    if "fold" not in _tables:
        _tables["fold"] = np.array([_fold(c) for c in range(0x10000)], np.uint32)
    total = np.zeros(1 << BITS, np.int64) if len(text) > PIECE else None
    for first in range(0, len(text), PIECE):
        before = min(first, 2)  # characters that only stand before others
        raw = np.frombuffer(text[first - before : first + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = _tables["fold"][np.minimum(raw, 0xFFFF)]
        for i in np.flatnonzero(raw > 0xFFFF).tolist():
            code[i] = _fold(int(raw[i]))
        letter = code > 0
        letter[:before] = False
        padded = np.concatenate([np.zeros(2, np.uint32), code]).astype(U64)
        one, two, three = padded[:-2], padded[1:-1], padded[2:]
        one = np.where(two == 0, U64(0), one)
        grams = (mix64(((one * U64(0x110000) + two) * U64(0x110000) + three)[letter]) >> U64(64 - BITS)).astype(np.int64)
        if total is None:
            return np.unique(grams, return_counts=True)
        total += np.bincount(grams, minlength=1 << BITS)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = np.flatnonzero(total)
    return bucket, total[bucket]


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # buckets x languages

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], int]:
        """The selected languages with their proportions, largest first, and the number of letters."""
        bucket, count = trigrams(text or "")
        letters = int(count.sum())
        if not letters or not self.languages:
            return [], letters
        logs = self.log_likelihood[bucket]
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        n = float(count.sum())

        def fit(chosen: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
            p, own = np.full(len(chosen), 1 / len(chosen)), like[:, chosen]
            for _ in range(rounds if len(chosen) > 1 else 0):
                joint = own * p
                total = joint.sum(axis=1)
                new = (joint * (count / total)[:, None]).sum(axis=0) / n
                done = np.abs(new - p).max() < 1e-4
                p = new
                if done:
                    break
            return p, float((count * np.log((own * p).sum(axis=1))).sum())

        share, _ = fit(np.arange(len(self.languages)), 8)
        order = np.argsort(-share, kind="stable")
        best, score = None, -np.inf
        for k in range(1, len(order) + 1):
            p, ll = fit(order[:k], ROUNDS)
            value = ll - PENALTY * (k - 1) * np.log(n + 1)
            if value <= score:
                break
            best, score = (order[:k], p), value
        chosen, p = best
        return sorted(((self.languages[c], float(x)) for c, x in zip(chosen, p, strict=True)), key=lambda x: (-x[1], x[0])), letters


def sample_of(rows: DataFrame, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most about most_rows rows, chosen by a hash of doc_id, with equal quotas per language (all rows of a rarer one)."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows
    quota = most_rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, quota / n))])
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))


def train(rows: DataFrame, most_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (doc_id, text, lang); those with a null text or lang are left out.

    Each task adds up trigram counts per language and sends them as one packed row
    per language, so the driver receives languages x buckets numbers per task of a
    bounded sample.
    """
    rows = rows.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sample = sample_of(rows, most_rows).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                bucket, n = trigrams(text)
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))[bucket] += n
        rows = [(lang, int(b), int(c[b])) for lang, c in total.items() for b in np.flatnonzero(c)]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    table = np.zeros((1 << BITS, len(languages)))
    for r in counted:
        table[r["gram"], languages.index(r["lang"])] = r["n"]
    table += SMOOTHING
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32)) if languages else Model([], table)


def mixtures(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_letters, and the mixture as an array of (lang, share)."""
    schema = "doc_id long, lang_pred string, score double, n_letters long, mixture array<struct<lang:string,share:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            found = [model.mixture(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([m[0][0] if m else "und" for m, _ in found], pa.string()),
                    pa.array([min(1.0, m[0][1]) if m else 0.0 for m, _ in found], pa.float64()),
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([[{"lang": lang, "share": share} for lang, share in m] for m, _ in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                ],
                names=["doc_id", "lang_pred", "score", "n_letters", "mixture"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fold_of(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def predict_languages(docs: DataFrame, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the documents whose fold isn't 0 and predict all: doc_id, held_out, lang_pred, score, n_letters, mixture."""
    model = train(docs.where(fold_of("doc_id") != 0), most_rows)
    return mixtures(docs, model).select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_letters", "mixture")


def keep_identified(docs: DataFrame, least_share: float = 0.5, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those in which no language is found or none holds least_share of the text."""
    model = train(docs.where(fold_of("doc_id") != 0), most_rows)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            shares = [(model.mixture(t)[0] or [("und", 0.0)])[0] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != "und" and share >= least_share for lang, share in shares], pa.bool_()))

    return docs.mapInArrow(run, schema)
