"""Evaluation: confusion matrix, precision, recall, F1, safety, ablations and benchmark building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scores import LABELS, normalize_label
from corvane.functions.text import mutate_claim, simple_sentences, words
from corvane.sources.store import materialise


def labelled(df: DataFrame, truth: str, guess: str, *keep: str) -> DataFrame:
    return df.select(*keep, normalize_label(F.col(truth)).alias("t"), normalize_label(F.col(guess)).alias("p"))


def _label_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "pos int, label string")


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """A row per true label in the fixed order, a column per predicted one."""
    counts = pairs.groupBy(F.col("t").alias("label")).pivot("p", LABELS).count()
    out = _label_rows(pairs).join(counts, "label", "left").na.fill(0)
    return out.select("label", *[F.col(x).cast("long").alias(f"pred_{x.lower()}") for x in LABELS])


def per_class(pairs: DataFrame, *group: str) -> DataFrame:
    """precision, recall, f1 and support of each label; 0 where undefined."""
    sums = pairs.groupBy(*group).agg(*[x for i, n in enumerate(LABELS) for x in (F.count_if((F.col("t") == n) & (F.col("p") == n)).alias(f"tp{i}"), F.count_if(F.col("p") == n).alias(f"pp{i}"), F.count_if(F.col("t") == n).alias(f"np{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"), F.col(f"np{i}").alias("support")) for i, n in enumerate(LABELS)])).alias("x")
    out = sums.select(*group, rows).select(*group, "x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*group, "label", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), "support", f1.alias("_f1"), F.col("precision").alias("_p"), F.col("recall").alias("_r"))


def metrics(pairs: DataFrame, *group: str) -> DataFrame:
    """accuracy, macro means over all three labels, false-supported rate, contradiction recall and n, per group."""
    classes = per_class(pairs, *group).groupBy(*group).agg(*[F.round(F.avg(a), 4).alias(b) for a, b in (("_p", "macro_precision"), ("_r", "macro_recall"), ("_f1", "macro_f1"))], F.max(F.when(F.col("label") == "CONTRADICTED", F.col("recall"))).alias("contradiction_recall"))
    unsafe = F.count_if((F.col("t") != "SUPPORTED") & (F.col("p") == "SUPPORTED"))
    rest = pairs.groupBy(*group).agg(F.round(F.avg((F.col("t") == F.col("p")).cast("double")), 4).alias("accuracy"), F.round(F.coalesce(F.try_divide(unsafe, F.count_if(F.col("t") != "SUPPORTED")), F.lit(0.0)), 4).alias("fsr"), F.count("*").alias("n"))
    return rest.join(classes, list(group)) if group else rest.crossJoin(classes)


def label_distribution(df: DataFrame, label: str, *group: str) -> DataFrame:
    counts = df.groupBy(*group, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*group)), 4))


def confidence_sweep(df: DataFrame, confidence: str, correct: Column, thresholds: list[float]) -> DataFrame:
    """coverage and precision of the rows at or above each threshold; one pass over df."""
    one = df.select(F.col(confidence).alias("c"), correct.alias("ok"))
    sums = one.agg(F.count("*").alias("n"), *[x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("c") >= t).alias(f"k{i}"), F.count_if((F.col("c") >= t) & F.col("ok")).alias(f"g{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), F.col(f"g{i}").alias("good")) for i, t in enumerate(thresholds)])).alias("x")
    return sums.select("n", rows).select("x.threshold", "x.kept", F.round(F.try_divide(F.col("x.kept"), F.col("n")), 4).alias("coverage"), F.round(F.coalesce(F.try_divide(F.col("x.good"), F.col("x.kept")), F.lit(0.0)), 4).alias("precision"))


def recommended_threshold(sweep: DataFrame, target: float = 0.98) -> DataFrame:
    return sweep.agg(F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def numbered(df: DataFrame, by: str, name: str = "pos") -> DataFrame:
    """Position from 0 in the order of `by`: range partitions are sorted and numbered on their own and shifted by the sizes before them.

    The partitions are written down once with their numbers: a range exchange that is planned twice may sample other bounds, and
    sizes of one would then shift rows of the other.
    """
    spread = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id())
    spread = materialise(spread, "numbered")  # _id: the partition in the upper bits, the place in it in the lower 33
    place = spread.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_own"))
    sizes = place.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return place.join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_id", "_part", "_own", "_before")


def rotate_evidence(df: DataFrame, key: str, evidence: str, by: int = 45) -> DataFrame:
    """Each row with the evidence of the row `by` places on, in key order, round the end."""
    placed = numbered(df.select(key, evidence), key)
    n = placed.count()
    other = placed.select(F.pmod(F.col("pos") - by, F.lit(max(n, 1))).alias("pos"), F.col(key).alias(f"other_{key}"), F.col(evidence).alias("rotated"))
    return placed.select(key, "pos").join(other, "pos").drop("pos")


def stable_order(key: str, seed: int = 42) -> Column:
    """A seeded shuffle that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def balanced_label(at: Column) -> Column:
    """The class of the at-th (from 0) row when the smallest class is filled first: SUP, CON, NEI in turn."""
    return F.element_at(F.array(F.lit("SUP"), F.lit("CON"), F.lit("NEI")), (F.pmod(at, F.lit(3)) + 1).cast("int"))


CLAIM_TYPES = ["factual_holding", "legal_citation", "date_timeline", "party_identification", "procedural_history", "legal_principle"]


def build_triples(chunks: DataFrame, n: int = 300, least_words: int = 150) -> DataFrame:
    """Balanced benchmark triples from chunks (doc_id, chunk_id, text): a faithful claim, a mutated one, or one whose evidence
    comes from the next chunk of another document in the shuffled order."""
    first = F.get(F.filter(simple_sentences(F.col("text")), lambda s: F.size(words(s)) >= 8), 0)
    fit = chunks.where(F.size(words(F.col("text"))) >= least_words).select("doc_id", "chunk_id", "text", first.alias("claim"), stable_order("chunk_id").alias("_o")).where("claim IS NOT NULL")
    few = fit.orderBy("_o", "chunk_id").limit(n)
    order = Window.orderBy("_o", "chunk_id")  # n rows
    placed = few.withColumn("at", F.row_number().over(order) - 1)
    others = placed.select(F.col("at").alias("_at"), F.struct("doc_id", "chunk_id", "text").alias("other"), F.col("doc_id").alias("_doc"))
    pairs = placed.join(others, (F.col("_doc") != F.col("doc_id"))).groupBy("at").agg(F.min_by("other", F.struct(F.pmod(F.col("_at") - F.col("at"), F.lit(n)))).alias("other"))
    label = balanced_label(F.col("at"))
    rows = placed.join(pairs, "at", "left").withColumn("gold_label", label).where("gold_label <> 'NEI' OR other IS NOT NULL")
    nei = F.col("gold_label") == "NEI"
    claim = F.when(F.col("gold_label") == "CON", mutate_claim(F.col("claim"))).when((F.col("gold_label") == "SUP") & ~F.col("claim").endswith("."), F.concat("claim", F.lit("."))).otherwise(F.col("claim"))
    kind = F.element_at(F.array(*[F.lit(x) for x in CLAIM_TYPES]), (F.pmod(F.col("at"), F.lit(6)) + 1).cast("int"))
    pick = lambda c: F.when(nei, F.col(f"other.{c}")).otherwise(F.col(c))
    return rows.select(F.format_string("vrg_%04d", F.col("at") + 1).alias("example_id"), pick("doc_id").alias("doc_id"), pick("chunk_id").alias("chunk_id"), claim.alias("claim"), pick("text").alias("evidence"), "gold_label", kind.alias("claim_type"), (F.col("gold_label") == "CON").alias("is_perturbed"))


def split_by_document(df: DataFrame, doc: str = "doc_id", dev_share: float = 0.35) -> DataFrame:
    """Adds split: all rows of a document are in dev or in test, by a stable hash."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.col(doc).cast("string"), F.lit(":split"))), 1, 6), 16, 10).cast("long") % 10000
    return df.withColumn("split", F.when(bucket < int(dev_share * 10000), "dev").otherwise("test"))


def leaked(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents in both splits; empty when the split is clean."""
    return df.where("split = 'dev'").select(doc).intersect(df.where("split = 'test'").select(doc))


def per_class_sample(df: DataFrame, cls: str, doc: str, per_doc: int = 1, per_class_rows: int = 1000) -> DataFrame:
    """At most per_doc rows of a class in a document, then per_class_rows of a class, in a stable random order."""
    order = F.md5(F.concat_ws(":", F.col(cls), F.col(doc).cast("string")))
    one = df.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(cls, doc).orderBy("_o"))).where(F.col("_n") <= per_doc)
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(cls).orderBy("_o", doc))).where(F.col("_n") <= per_class_rows).drop("_o", "_n")
