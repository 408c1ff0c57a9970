"""PII by weak supervision: labelers vote, EM weighs them, a classifier decides the added spans.

1. Candidates are runs that could hold personal data: the base matches (email, ip,
   card, phone) and other digit groups, account numbers, handles and capitalised names.
2. Regex, gazetteer and context labelers vote yes, no or abstain on each candidate.
   Gazetteers come from the corpus: the mail domains of its base matches, and the words
   that it writes in lower case, which names are not made of.
3. Expectation-maximisation (two classes, labelers independent given the class)
   estimates each labeler's reliability and each candidate's probability from vote
   patterns alone.  They come from all texts, which are scanned once, and from a drawn
   seed corpus (SEED_ROWS sentences of a fixed seed, without labels), so that every
   kind of candidate occurs, personal and not.
4. A logistic span classifier is trained on features of the same candidates, weighted
   by those probabilities.  Candidates above THRESHOLD are added; base spans stay.

All scans take time in proportion to the text: a digit or letter run is read once
(possessive patterns, and mail addresses are looked for round each @).

Edge cases: a null text is empty; whole texts are read; base matches that fail their
test are dropped without another try; an empty table trains on the seed corpus alone
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, materialise, sized_broadcast
from corvane.llm.secrets import as_joined, count_kind
from corvane.llm.spans import Span, base_spans, free_of, in_order

KINDS = ["email", "ip", "card", "phone", "number", "iban", "handle", "name"]
SEED_ROWS = 3_000
THRESHOLD = 0.8
EM_ROUNDS = 100


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def find_mails(text: str) -> Iterator[re.Match]:
    """Matches of the mail pattern: round each @, from the start of the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _MAIL.match(text, start)):
            yield m
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


BASE = [
    ("email", "@", find_mails, lambda m: True),
    ("ip", ".", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer, lambda m: all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))),
    ("card", "0123456789", re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer, lambda m: 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)),
    ("phone", "+", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer, lambda m: 10 <= len(_digits(m[0])) <= 15),
]
MORE = [
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")),
    ("number", re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)\x20?)?[0-9]{1,5}+(?:[\x20./-][0-9]{2,5}+){1,5}(?![\w-]|\.[0-9])|(?<![\w.+-])[0-9]{6,18}+(?![\w-]|\.[0-9])")),
    ("handle", re.compile(r"(?<![\w.%+@-])@[A-Za-z0-9_]{3,30}+")),
    ("name", re.compile(r"\b(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Signed|Regards|Sincerely|The|In|On|At|And|For|From|With)\b)[A-Z][a-zà-ÿ]+(?:[\x20-][A-Z][a-zà-ÿ]+){1,2}\b|(?:(?<=\bMr\.\x20)|(?<=\bMs\.\x20)|(?<=\bDr\.\x20)|(?<=\bMrs\.\x20))[A-Z][a-zà-ÿ]+\b")),
]
#: Words before a candidate that speak for and against personal data, and what may follow a plain number.
FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|phone|telephone|tel|call|mobile|cell|fax|card|account|acct|iban|ssn|passport|licen[cs]e|name|named|signed|regards|sincerely|dear|patient|employee|customer|mr|mrs|ms|dr|prof|herr|frau|mme|señora?|follow|dm|reach|write to|telefon|téléphone|teléfono|kontakt|konto|compte|cuenta|nom|nombre)\b(?:[\s:.#,'\"(]{1,3}(?:is|at|no|number|me|us|to|on)\b){0,2}[\s:.#,'\"(]{0,3}$")
AGAINST = re.compile(r"(?i)(?:\b(?:page|pages|chapter|section|figure|table|version|release|room|year|years|since|until|from|between|in|of|the|isbn|issue|volume|order|item|build|price|costs?|total|about|around|over|score|scored|dated?|by|on|at|import|class|def|using)\b|[$€£=])[\s:]{0,2}$")
UNITS = re.compile(r"^\s?(?:%|°|(?i:km|kg|cm|mm|mb|gb|kb|px|ms|euros?|dollars|years?|pages?|people|times|points|percent|am|pm|uhr|hours?|days?|ltd|inc|gmbh|street|university|court|river|company|school|bridge|museum)\b)")
DATE = re.compile(r"^(?:(?:19|20)[0-9]{2}(?:[-/.\x20][0-9]{1,2}){0,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[-/\x20](?:19|20)[0-9]{2})$")
SHAPES = re.compile(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{2,5}\)\x20?[0-9]{3,5}[\x20-][0-9]{2,5}|0[0-9]{1,4}[\x20/-][0-9]{3,5}(?:[\x20-]?[0-9]{2,5}){1,3}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$")
THOUSANDS = re.compile(r"^[0-9]{1,3}(?:[.\x20][0-9]{3})+$")


@dataclass
class Gazetteers:
    """Words that the corpus writes in lower case, and mail domains that it holds more than once."""

    common: set[str] = field(default_factory=set)
    domains: set[str] = field(default_factory=set)


def votes(text: str, span: Span, known: Gazetteers) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 personal, 0 not, -1 abstains."""
    kind, a, b = span
    own, before, after = text[a:b], text[max(0, a - 30) : a], text[b : b + 16]
    digits = _digits(own)
    return (
        1 if kind in ("email", "phone") or kind == "number" and SHAPES.match(own) else 0 if kind == "number" and (DATE.match(own) or THOUSANDS.match(own) or len(digits) < 7) else -1,  # regex: shape
        int(iban(own)) if kind == "iban" else int(luhn(digits)) if kind == "card" or kind == "number" and len(digits) >= 14 else -1,  # regex: check digits
        (0 if own.startswith(("0.", "127.", "255.", "10.0.0.")) else 1) if kind == "ip" else -1,  # regex: address range
        1 if kind == "email" and own.rsplit("@", 1)[-1].lower() in known.domains else -1,  # gazetteer: domains
        (0 if any(w.lower() in known.common for w in re.split(r"[ -]", own)) else 1) if kind == "name" else -1,  # gazetteer: common words
        1 if FOR.search(before) else 0 if kind == "name" or AGAINST.search(before) else -1,  # context before; a name needs something that introduces it
        0 if UNITS.match(after) or kind == "handle" and after.startswith("(") else -1,  # context after
        (0 if a == 0 or before.rstrip(" \"'").endswith((".", "!", "?", "\n")) and not FOR.search(before) else -1) if kind == "name" else -1,  # context: a sentence's first words
        (0 if a == 0 or text[a - 1] == "\n" else -1) if kind == "handle" else -1,  # context: a line's first word, as in code
    )


def features(text: str, span: Span, known: Gazetteers) -> list[float]:
    kind = span[0]
    own = text[span[1] : span[2]]
    cast = votes(text, span, known)
    out = [1.0, *[float(kind == k) for k in KINDS]]
    for v in cast:
        out += [float(v == 1), float(v == 0)]
    return [*out, len(_digits(own)) / 10, (span[2] - span[1]) / 20, float(any(c in own for c in " -(/."))]


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and the further candidates that touch none of them or of each other."""
    base = base_spans(text, BASE)
    more: list[Span] = []
    for kind, pattern in MORE:
        more += free_of(list(free_of([(kind, m.start(), m.end()) for m in pattern.finditer(text)], base)), more)
    return base, more


def seed_texts(n: int = SEED_ROWS, seed: int = 19) -> list[str]:
    """Drawn sentences with and without personal data; nothing says which is which."""
    rng = np.random.default_rng(seed)
    number = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    syllables = ["ka", "ri", "mo", "len", "tor", "bel", "sa", "vin", "dra", "nu", "hal", "pe", "jo", "mir", "wes", "tan"]
    made = lambda: "".join(syllables[int(i)] for i in rng.integers(0, len(syllables), 2))
    plain = ["report", "meeting", "garden", "window", "market", "letter", "river", "station", "evening", "project", "table", "music"]
    word = lambda: plain[int(rng.integers(0, len(plain)))]

    def account() -> str:
        body = number(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    out = []
    for i in range(n):
        person = f"{made().capitalize()} {made().capitalize()}"
        out.append([
            f"Please call me at (0{number(3)}) {number(3)}-{number(4)} about the {word()}.", f"Tel: 0{number(2)} {number(4)} {number(4)}, the {word()} is open.", f"His SSN is {number(3)}-{number(2)}-{number(4)} in the file.",
            f"Account no {number(10)} belongs to the {word()}.", f"IBAN {account()} for the {word()}.", f"Follow @{made()}_{made()} for news of the {word()}.", f"Dear {person}, thank you for the {word()}.", f"The patient, Mr. {made().capitalize()} {made().capitalize()}, left.",
            f"Signed: {person}", f"Phone {number(3)}-{number(3)}-{number(4)} or write to {made()}@{made()}.org today.", f"Contact +{1 + i % 9}{number(2)} {number(3)} {number(4)} or see 8{i % 10}.1{i % 10}.22.{i % 250}.",
            f"The {word()} of 20{i % 30:02d}-0{1 + i % 9}-1{i % 10} was long.", f"On 1{i % 10}.0{1 + i % 9}.19{60 + i % 40} the {word()} closed.", f"Version 2{number(1)}.{number(2)}.{number(3)} of the {word()} is out.", f"About {1 + i % 9}{number(2)} {number(3)} people saw the {word()}.",
            f"It costs $ 1{number(1)}.{number(3)} since {1900 + i % 120}.", f"Order {number(8)} holds the {word()}.", f"See pages 1{number(1)}-{1 + i % 9}{number(2)} in the {word()}.", f"@{word()}(\"{word()}\")\ndef {word()}():", f"class {word()}:\n@{word()}\n",
            f"The {word().capitalize()} {word().capitalize()} was in the {word().capitalize()} {word().capitalize()}.", f"{word().capitalize()} {made().capitalize()} is the {word()}.", f"In the {made().capitalize()} {word().capitalize()} there is a {word()}.", f"ISBN {number(13)} and issue {number(7)} of the {word()}.",
            f"A {word()} and the {word()}, then a {word()}.", f"Loopback 127.0.0.{i % 9} in the {word()}.", f"The total of 2{number(6)} points.", f"Code AB{number(2)} {number(4)} {number(4)} {number(4)} of the {word()}.",
        ][i % 28])
    return out


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[int, ...], float], np.ndarray, np.ndarray, float]:
    """EM over vote patterns with their counts: P(personal) of each pattern, P(vote 1) of each labeler given either class, and the prior."""
    keys = sorted(patterns)
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    cast = v >= 0
    p = np.where(cast.any(axis=1), (np.where(cast, v, 0).sum(axis=1) + 0.5) / (cast.sum(axis=1) + 1), 0.5)
    for _ in range(rounds):
        hit = {c: ((n * w)[:, None] * cast * (v == 1)).sum(axis=0) + s for c, w, s in ((1, p, 1.8), (0, 1 - p, 0.2))}
        of = {c: ((n * w)[:, None] * cast).sum(axis=0) + 2.0 for c, w in ((1, p), (0, 1 - p))}
        yes, no = hit[1] / of[1], hit[0] / of[0]
        prior = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
        ll = {c: (cast * np.where(v == 1, np.log(q), np.log(1 - q))).sum(axis=1) + np.log(w) for c, q, w in ((1, yes, prior), (0, no, 1 - prior))}
        p = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
    return dict(zip(keys, p.tolist(), strict=True)), yes, no, prior


@dataclass
class SpanClassifier:
    weights: np.ndarray
    known: Gazetteers = field(default_factory=Gazetteers)

    def probability(self, text: str, span: Span) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, features(text, span, self.known)))))


_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("at", pa.int64()), ("near", pa.string())])
NEAR = (30, 16)  # characters before and after a candidate that labelers look at


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, found: every text's candidates with what stands round them (the candidate from `at` on in `near`), written down once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            out = []
            for text in batch.column("text").to_pylist():
                base, more = candidates(text or "")
                out.append([{"kind": k, "start": a, "end": b, "base": i < len(base), "at": min(a, NEAR[0]), "near": text[max(0, a - NEAR[0]) : b + NEAR[1]]} for i, (k, a, b) in enumerate(base + more)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(_FOUND))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean,at:long,near:string>>")
    return materialise(rows, "pii-candidates")


def near_span(c: dict) -> tuple[str, Span]:
    """A candidate as labelers see it: what stands round it, and its span there."""
    return c["near"], (c["kind"], c["at"], c["at"] + c["end"] - c["start"])


def gazetteers(docs: DataFrame, found: DataFrame) -> Gazetteers:
    """From all texts: what candidates can be looked up by.  The driver gets the words of names that some text writes in lower case, and repeated mail domains."""
    each = found.select(F.explode_outer("found").alias("c")).where("c IS NOT NULL").select("c.kind", F.expr("lower(substring(c.near, c.at + 1, c.end - c.start))").alias("own"))
    asked = each.where("kind = 'name'").select(F.explode_outer(F.split("own", "[ -]")).alias("w")).where("w <> ''").distinct()
    words = docs.select(F.explode_outer(F.split("text", r"[^\p{L}]+")).alias("w")).where("length(w) > 1 AND w = lower(w)")
    common = words.join(sized_broadcast(asked, 64), "w", "left_semi").distinct()
    domains = each.where("kind = 'email'").select(F.substring_index("own", "@", -1).alias("w")).groupBy("w").count().where("count > 1")
    seeds = {w for t in seed_texts() for w in re.findall(r"\b[a-z]{2,}\b", re.sub(r"@\S+", "", t))}
    return Gazetteers({r["w"] for r in common.collect()} | seeds, {r["w"] for r in domains.collect()})


def train(docs: DataFrame, found: DataFrame) -> SpanClassifier:
    """Fit on the candidates of all texts (found: see scanned) and of the seed corpus; they meet as counts of (votes, features)."""
    known = gazetteers(docs, found)

    def count(text: str, span: Span, seen: Counter) -> None:
        seen[votes(text, span, known), tuple(round(x, 1) for x in features(text, span, known))] += 1

    def counted(texts: list[str], seen: Counter) -> None:
        for text in texts:
            base, more = candidates(text)
            for s in base + more:
                count(text, s, seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for own in batch.column("found").to_pylist():
                for c in own:
                    count(*near_span(c), seen)
        yield pa.RecordBatch.from_arrays([pa.array([list(v) for v, _ in seen], pa.list_(pa.int32())), pa.array([list(f) for _, f in seen], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())], names=["votes", "features", "n"])

    rows = found.select("found").mapInArrow(run, "votes array<int>, features array<double>, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    seen: Counter = Counter()
    counted(seed_texts(), seen)
    # the corpus may hold one kind a thousand times over: no pattern weighs more than the seed corpus
    for r in sorted(rows, key=lambda r: (r["votes"], r["features"])):
        seen[tuple(r["votes"]), tuple(r["features"])] += min(r["n"], SEED_ROWS)
    patterns: dict[tuple[int, ...], float] = {}
    for (v, _), n in seen.items():
        patterns[v] = patterns.get(v, 0) + n
    belief, *_ = reliabilities(patterns)
    x, y, n = np.array([f for _, f in seen]), np.array([belief[v] for v, _ in seen]), np.array(list(seen.values()), float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of the penalised log-likelihood
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - q)) - 0.5 * w
        w = w + np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w)), slope)
    return SpanClassifier(w, known)


def pii_spans(found: DataFrame, model: SpanClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>> in order, of the candidates that scanned() found."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("found").to_pylist():
                kept = {(c["kind"], c["start"], c["end"]): c["base"] for c in own if c["base"] or model.probability(*near_span(c)) >= threshold}
                out.append([{"kind": s[0], "start": s[1], "end": s[2], "base": kept[s]} for s in in_order(list(kept), KINDS)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = scanned(docs)
    found = pii_spans(rows, train(docs, rows))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(as_joined(base), 256).alias("base_sha256"), as_joined(F.col("spans")).alias("spans"))
