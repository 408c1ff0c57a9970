"""Secret scans: base patterns plus character Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled samples.  Random: drawn
base 64, base 62, upper-case and hex strings.  Ordinary: identifiers and words from
three sources: the corpus's own words, names that the Python standard library defines,
and forms built from both (snake, kebab and camel case, paths, versions, numbered
names, dates, counted and repeated characters).

A token of LEAST_LENGTH or more is a secret when the log ratio of its likelihoods under
the two models is at least LEAST_RATIO in all and LEAST_PER_CHAR for each character.
Only steps inside its pieces between separators count, and one piece must be longer
than LEAST_PIECE: paths, UUIDs and compound names are short pieces.  Tokens of digits
alone are numbers, and those of fewer than LEAST_CHARACTERS characters repetitions.  The base patterns (assignments, access keys, hex strings) always
count; the models add `random` spans elsewhere.

All scans take time in proportion to the text.

Edge cases: a null text is empty and has no span; whole texts are scanned; equal
texts give equal rows; other columns are ignored; an empty table trains on drawn
strings and standard names alone and gives no rows; without samples of a label its
model is uniform.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import batches_of
from corvane.llm.spans import Span, as_text, base_spans, digest, free_of, in_order

KINDS = ["assign", "access", "hex", "random"]
BASE = [
    ("assign", ":=", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE).finditer, lambda m: len(m[2]) >= 8),
    ("access", "A", re.compile(r"AKIA[A-Z0-9]+").finditer, lambda m: m.end() - m.start() >= 16),
    # a run shorter than 32 is dropped and used up in either reading, so only long ones are matched
    ("hex", "0123456789abcdef", re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}").finditer, lambda m: True),
]
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_.-]{20,}+={0,2}+")
SEPARATORS = re.compile(r"[^A-Za-z0-9]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
LEAST_LENGTH = 20
LEAST_PIECE = 12
LEAST_CHARACTERS = 7  # different ones; fewer are a repetition
LEAST_RATIO = 10.0
LEAST_PER_CHAR = 0.45
SMOOTHING = 0.5
SAMPLE_ROWS = 2_000  # bound of the identifier sample (texts)
MOST_WORDS = 5_000  # of its words


@dataclass
class MarkovPair:
    random: np.ndarray  # log P(next | previous); the last row is the start
    ordinary: np.ndarray

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio of random against ordinary over the pieces of a token."""
        out = 0.0
        for piece in pieces(token):
            at = [ALPHABET.find(c) for c in piece]
            out += float(sum(self.random[p, c] - self.ordinary[p, c] for p, c in zip([len(ALPHABET), *at[:-1]], at, strict=True)))
        return out

    def is_secret(self, token: str) -> bool:
        if len(token) < LEAST_LENGTH or token.isdigit() or len(set(token)) < LEAST_CHARACTERS or max(map(len, pieces(token)), default=0) <= LEAST_PIECE:
            return False
        return (r := self.ratio(token)) >= LEAST_RATIO and r >= LEAST_PER_CHAR * len(token)


def pieces(token: str) -> list[str]:
    return [p for p in SEPARATORS.split(token) if p]


def train(samples: DataFrame) -> MarkovPair:
    """Fit both models from samples (token string, label: 1 random, 0 ordinary), piece by piece.

    Transition counts are one aggregate; the driver gets at most (letters + 1) x letters numbers a label.
    """
    cut = samples.where("token IS NOT NULL").select("label", F.explode(F.split("token", SEPARATORS.pattern)).alias("piece"))
    pairs = cut.select("label", F.filter(F.split("piece", ""), lambda c: c != "").alias("c")).where("size(c) > 0")
    steps = F.transform(F.col("c"), lambda c, i: F.struct(F.when(i == 0, F.lit("")).otherwise(F.get("c", i - 1)).alias("p"), c.alias("n")))
    rows = pairs.select("label", F.explode_outer(steps).alias("s")).groupBy("label", "s.p", "s.n").count().collect()
    out = []
    for label in (1, 0):
        table = np.full((len(ALPHABET) + 1, len(ALPHABET)), SMOOTHING)
        for r in rows:
            if r["label"] == label:
                table[ALPHABET.find(r["p"]) if r["p"] else len(ALPHABET), ALPHABET.find(r["n"])] += r["count"]
        out.append(np.log(table / table.sum(axis=1, keepdims=True)))
    return MarkovPair(*out)


def random_strings(spark: SparkSession, n: int = 4_000, seed: int = 7) -> DataFrame:
    """Labelled random strings of the usual kinds (base 64, base 62, upper-case keys, hex), drawn with a fixed seed."""
    return spark.createDataFrame([(x, 1) for x in drawn_strings(n, seed)], "token string, label int")


def drawn_strings(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    kinds = [list(ALPHABET[:64]), list(ALPHABET[:62]), list(ALPHABET[:26] + ALPHABET[52:62]), list("0123456789abcdef")]
    return ["".join(rng.choice(kinds[i % 4], int(rng.integers(20, 64)))) for i in range(n)]


#: Modules of the Python standard library whose names stand for ordinary identifiers.
MODULES = ["argparse", "asyncio", "collections", "concurrent.futures", "configparser", "csv", "ctypes", "datetime", "decimal", "difflib", "email", "functools", "gettext", "http", "http.client", "inspect", "io", "json", "locale", "logging", "os", "pathlib", "pickle", "re", "shutil", "signal", "socket", "sqlite3", "ssl", "string", "subprocess", "tarfile", "tempfile", "threading", "typing", "unicodedata", "urllib.parse", "xml.dom", "zipfile"]


def standard_names(modules: list[str]) -> list[str]:
    """Names that these modules and their classes define."""
    found = set()
    for name in modules:
        module = importlib.import_module(name)
        for own in dir(module):
            found.add(own)
            if isinstance(value := getattr(module, own, None), type):
                found.update(f"{own}.{x}" for x in dir(value))
    return sorted(x for x in found if len(x) > 3)


def built_forms(words: list[str], n: int, seed: int) -> list[str]:
    """Compound identifiers of these words, with digits and punctuation, as code, paths and logs hold them."""
    rng = np.random.default_rng(seed)
    pick = lambda k: [words[int(i)] for i in rng.integers(0, len(words), k)]
    out = []
    for i in range(n):
        w, d = pick(int(rng.integers(2, 6))), str(int(rng.integers(0, 10 ** int(rng.integers(1, 5)))))
        low = [x.lower() for x in w]
        start = int(rng.integers(0, 20))
        out.append([
            "_".join(low), "-".join(low), low[0] + "".join(x.capitalize() for x in low[1:]), "".join(x.capitalize() for x in low) + d, "_".join(x.upper() for x in w) + "_" + d, "/".join(low) + ".txt",
            "/usr/lib/" + "/".join(low) + d, low[0] + d + "." + d + "." + d, f"{low[0]}-20{d[:2]:0>2}-0{1 + i % 9}-1{i % 10}T0{i % 10}30{i % 6}0", ALPHABET[start : start + 20], ALPHABET[26 + start : 46 + start] + d, "0123456789" * 2, low[0][:2] * 12, "".join(low),
        ][i % 14])
    return out


def ordinary_identifiers(docs: DataFrame, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled identifiers: words of at most about most_rows texts, standard names, and forms built from both.

    Words that hold or touch a digit are left out: they may be parts of secrets.
    """
    spark, total = docs.sparkSession, docs.count()
    few = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < (1 << 20) * min(1.0, most_rows / max(total, 1)))
    words = few.select(F.explode_outer(F.split(F.coalesce("text", F.lit("")), r"[\s]+")).alias("w")).select(F.regexp_extract("w", r"^[^A-Za-z0-9]*([A-Za-z]{3,24})[^A-Za-z0-9]*$", 1).alias("token")).where("token <> ''")
    common = [r["token"] for r in words.groupBy("token").count().orderBy(F.desc("count"), "token").limit(MOST_WORDS).collect()]
    names = standard_names(MODULES)
    forms = built_forms(common + [p for x in names for p in pieces(x) if len(p) > 2], 6_000, 5)
    return spark.createDataFrame([(x, 0) for x in [*common, *names, *forms]], "token string, label int")


def scan(text: str, model: MarkovPair) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base = base_spans(text, BASE)
    found = [("random", m.start(), m.start() + len(own)) for m in TOKEN.finditer(text) if model.is_secret(own := m[0].rstrip(".-"))]
    return in_order(base, KINDS), list(free_of(found, base))


def secret_spans(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> in order."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base, more = scan(text or "", model)
                own = set(base)
                out.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in own} for s in in_order(base + more, KINDS)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def as_joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])).cast("long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; the models are trained on random strings and the corpus's own words."""
    spark = docs.sparkSession
    model = train(random_strings(spark).unionByName(ordinary_identifiers(docs)))
    found = secret_spans(docs, model)
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(as_joined(base), 256).alias("base_sha256"), as_joined(F.col("spans")).alias("spans")
    )
