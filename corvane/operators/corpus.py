"""Corpus preparation: deduplication, chunking, token repair."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.text import ABBREVIATIONS, words

# ---------------------------------------------------------------- dedup


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in the order of `order`; hash-aggregated, so a hot key needs no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def conflicting(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys whose rows disagree in a value."""
    return df.groupBy(key).agg(*[F.count_distinct(v).alias(f"n_{v}") for v in values]).where(" OR ".join(f"n_{v} > 1" for v in values))


# ---------------------------------------------------------------- chunking

_BREAK = re.compile(r"""([A-Za-z0-9]+|[)\]"'])[.!?]["')]*(?=(\s+)[A-Z0-9"'(\[])""")
_WORD = re.compile(r"\S+")
_STOPS = frozenset(ABBREVIATIONS)


def sentence_units(text: str, most_words: int = 100) -> list[tuple[int, int, int]]:
    """(start, end, words) of sentences; one beyond most_words is cut after the first comma from half that size on, or at that size."""
    breaks = [m.start(2) for m in _BREAK.finditer(text) if m[1].lower() not in _STOPS]
    spans = [m.span() for m in _WORD.finditer(text)]
    ends = [end for _, end in spans]
    commas = [i for i, end in enumerate(ends) if text[end - 1] == ","]
    units, first = [], 0
    for cut in [*breaks, len(text)]:
        after = bisect_right(ends, cut)  # the word after the sentence's last
        while first < after:
            last = after - 1
            if after - first > most_words:
                comma = bisect_left(commas, first + most_words // 2 - 1)
                last = min(first + most_words - 1, last, commas[comma] if comma < len(commas) else last)
            units.append((spans[first][0], ends[last], last - first + 1))
            first = last + 1
    return units


def chunk_spans(text: str | None, size: int = 350, overlap: int = 50) -> list[tuple[int, int]]:
    """Overlapping (start, end) spans of about `size` words that respect sentences.

    With words counted up to each unit, both ends of a chunk are searches: its end is the last unit within size, or the next one
    if that comes nearer and stays within 1.15 times size; the next start is the unit whose distance to the end is nearest to overlap.
    """
    units = sentence_units(text or "")
    upto = list(accumulate((n for *_, n in units), initial=0))
    spans, start, last = [], 0, 0
    while start < len(units):
        end = max(bisect_right(upto, upto[start] + size) - 1, start + 1)
        if end < len(units) and (wide := upto[end + 1] - upto[start]) <= int(size * 1.15) and wide - size < size - (upto[end] - upto[start]):
            end += 1
        end = max(end, min(last + 1, len(units)))
        spans.append((units[start][0], units[end - 1][1]))
        if end == len(units):
            break
        # units whose words to the end are nearest to overlap: one on each side of it, the later one on a tie
        near = bisect_left(upto, upto[end] - overlap)
        options = [i for i in (near, near - 1, end - 1) if start < i < end]
        start, last = min(options, key=lambda i: (abs(upto[end] - upto[i] - overlap), -i), default=end), end
    return spans


def chunk_documents(docs: DataFrame, doc_id: str, text: str, size: int = 350, overlap: int = 50) -> DataFrame:
    """Chunks of every document.  The walk over a document's units is sequential, so it runs in Arrow batches, one document at a time."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for key, whole in zip(frame["doc_id"], frame["text"], strict=True):
                for i, (a, b) in enumerate(chunk_spans(whole, size, overlap)):
                    own = whole[a:b]
                    rows.append((f"{key}_c{i}", key, i, own, len(own.split()), a, b))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.CHUNK.split(", ")])

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schemas.CHUNK)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("w"), F.min("word_count").alias("lo"), F.max("word_count").alias("hi"))
    return per.agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.round(F.avg("n"), 4).alias("mean_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"),
        F.count_if(F.col("n") == 1).alias("single_chunk_docs"), F.round(F.sum("w") / F.sum("n"), 4).alias("mean_words"), F.min("lo").alias("min_words"), F.max("hi").alias("max_words"),
    )


# ---------------------------------------------------------------- token repair

#: Stems put in the place of a family word, in order of preference, and words that stay.
CANDIDATES = {"company": ["co", "com", "con", "cor", "col", "cou", "cov", "cog", "cop", "cos"], "number": ["no", "not", "nor", "non", "nom", "nov"]}
KEPT = {
    "company": ["company", "companies", "company's", "companys", "companies'", "accompany", "accompanying", "accompanied", "accompaniment", "accompaniments", "intercompany"],
    "number": ["number", "numbers", "number's", "numbers'"],
}
CORRUPT = r"(?iU)\b[A-Za-z]*(?:company|number)[A-Za-z]*(?:['’][A-Za-z]+)?\b"
VALID_FREQ, RARE_FREQ, CLOSE = 1e-7, 1e-6, 10.0


def corrupt_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token and n for words that hold a family word (the cheap test stands before the pattern)."""
    low = F.lower(F.col(text))
    found = docs.where(low.contains("company") | low.contains("number")).select(key, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(CORRUPT), F.lit(0))).alias("token"))
    return found.where("token IS NOT NULL").groupBy(key, "token").agg(F.count("*").alias("n"))


def family(token: Column) -> Column:
    return F.when(F.lower(token).contains("company"), "company").when(F.lower(token).contains("number"), "number")


def restore_case(original: Column, new: Column) -> Column:
    """new in the letter case of original; of two words only the first gets a capital."""
    title = F.substring(original, 1, 1) == F.upper(F.substring(original, 1, 1))
    rest_low = F.substring(original, F.lit(2), F.length(original)) == F.lower(F.substring(original, F.lit(2), F.length(original)))
    capital = F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, F.lit(2), F.length(new))))
    return F.when(F.upper(original) == original, F.upper(new)).when(title & (rest_low | new.contains(" ")), capital).otherwise(F.lower(new))


def resolve_tokens(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """token, family, status, replacement for distinct tokens, by a dictionary (word, freq; freq 0 for listed words without one).

    Tokens are resolved once each, as a relation: candidates are exploded and joined to the dictionary.  Single words
    win over two words, those over listed words without a frequency; the highest frequency wins, then the earlier stem.
    A rare winner with a close rival is left alone (low_confidence).
    """
    base = tokens.select("token").distinct().withColumns({"family": family(F.col("token")), "low": F.lower("token")})
    keep = F.create_map(*[x for f, ws in KEPT.items() for x in (F.lit(f), F.array(*[F.lit(w) for w in ws]))])
    base = base.withColumn("kept", F.array_contains(keep[F.col("family")], F.col("low")))
    stems = F.create_map(*[x for f, cs in CANDIDATES.items() for x in (F.lit(f), F.array(*[F.lit(c) for c in cs]))])
    wide = base.where("NOT kept").select("token", "low", "family", F.posexplode(stems[F.col("family")]).alias("pos", "stem"))
    one, two = F.replace(F.col("low"), F.col("family"), F.col("stem")), F.replace(F.col("low"), F.col("family"), F.concat("stem", F.lit(" ")))
    forms = wide.select("token", "pos", F.explode(F.array(F.struct(F.lit(1).alias("kind"), one.alias("form")), F.struct(F.lit(2).alias("kind"), two.alias("form")))).alias("f")).select("token", "pos", "f.kind", "f.form")
    forms = forms.where((F.col("kind") == 1) | (F.size(F.split("form", " ")) == 2))
    parts = forms.select("*", F.posexplode(F.split("form", " ")).alias("part", "word")).where("word <> ''")
    bare = F.regexp_replace("word", "['’]s$", "")
    looked = parts.select("*", F.explode(F.array_distinct(F.array(F.col("word"), bare))).alias("look")).join(dictionary.select(F.lower("word").alias("look"), F.col("freq")), "look")
    valid = looked.groupBy("token", "pos", "kind", "form", "part").agg(F.max("freq").alias("freq"), F.bool_or(F.col("freq") == 0).alias("listed")).where((F.col("freq") >= VALID_FREQ) | F.col("listed"))
    scored = valid.groupBy("token", "pos", "kind", "form").agg(F.count("*").alias("parts"), F.min("freq").alias("score"), F.max_by("freq", "part").alias("last")).where("parts = kind")
    tier = F.when((F.col("kind") == 1) & (F.col("score") > 0), 1).when(F.col("kind") == 2, 2).otherwise(3)
    ranked = scored.withColumn("tier", tier).withColumn("best", F.min("tier").over(Window.partitionBy("token"))).where("tier = best")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "pos")))
    pick = ranked.groupBy("token").agg(F.max("tier").alias("tier"), *[F.max(F.when(F.col("place") == p, F.col(c))).alias(n) for p, c, n in ((1, "form", "form"), (1, "score", "win"), (1, "last", "last"), (2, "score", "rival"))])
    unsure = (F.col("win") < RARE_FREQ) & (F.col("rival") > 0) & (F.col("win") / F.nullif("rival", F.lit(0.0)) <= CLOSE) & ((F.col("tier") == 1) | ((F.col("tier") == 2) & (F.col("last") < RARE_FREQ)))
    out = base.join(pick, "token", "left")
    status = F.when(F.col("kept"), "unchanged").when(F.col("form").isNull(), "unresolved").when(unsure, "low_confidence").when(F.col("tier") == 1, "single").when(F.col("tier") == 2, "two_word").otherwise("single_listed")
    out = out.withColumn("status", status)
    changed = F.col("status").isin("single", "two_word", "single_listed")
    return out.select("token", "family", "status", F.when(changed, restore_case(F.col("token"), F.col("form"))).otherwise(F.col("token")).alias("replacement"))


def repair_texts(docs: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """docs with resolved tokens put in; each document gets the replacements of its own tokens only."""
    found = corrupt_tokens(docs, key, text)
    fixes = resolve_tokens(found, dictionary).where("replacement <> token")
    own = found.join(fixes, "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "replacement"))).alias("_map"))
    pieces = F.split(F.regexp_replace(F.col(text), f"({CORRUPT})", "\u0001$1\u0001"), "\u0001", -1)
    fixed = F.array_join(F.transform(F.col("_pieces"), lambda p: F.coalesce(F.col("_map")[p], p)), "")
    out = docs.join(own, key, "left").withColumn("_pieces", pieces)
    return out.withColumn(text, F.when(F.col("_map").isNull(), F.col(text)).otherwise(fixed)).drop("_map", "_pieces")


def fix_counts(found: DataFrame, resolved: DataFrame) -> DataFrame:
    return found.join(resolved.where("replacement <> token"), "token").groupBy("token", "replacement").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """word and relative frequency of a corpus, a dictionary for resolve_tokens()."""
    counts = docs.select(F.explode_outer(words(F.lower(F.col(text)))).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", (F.col("n") / F.col("total")).alias("freq"))
