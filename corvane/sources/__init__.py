"""Reading tables with explicit schemas, and the fallback chain of corpus paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of these parquet paths that exists (asked through Spark, so any store works)."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {paths}")


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark triples from JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(schemas.TRIPLE).json(path)


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; no row if the path is missing."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def config(path: str, text: str | None = None) -> dict:
    """A YAML configuration, read on the driver; PyYAML is asked for only here."""
    import yaml

    return yaml.safe_load(text if text is not None else open(path, encoding="utf-8").read()) or {}


def prompt(template: str, text: str) -> str:
    """A prompt with the text in place of {input_text}."""
    return template.replace("{input_text}", text)


def present(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these that df has."""
    return df.select(*[n for n in names if n in df.columns])


def with_label(df: DataFrame, label: str = "label") -> DataFrame:
    """label as a number, -1 where it is missing."""
    return df.withColumn(label, F.coalesce(F.col(label).cast("long"), F.lit(-1)))


def inspect(df: DataFrame, text: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows and mean, least and largest text length of a sample."""
    return df.sample(fraction=fraction, seed=seed).selectExpr("count(*) AS n", f"avg(length({text})) AS mean_chars", f"min(length({text})) AS min_chars", f"max(length({text})) AS max_chars")
