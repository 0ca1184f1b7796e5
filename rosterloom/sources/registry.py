"""Readers of registries and rosters, and the sink for a match's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_registry(spark: SparkSession, path: str, columns: list[str] | None = None, format: str = "parquet", **options: str) -> DataFrame:
    """A registry of any Spark format; only the mapped columns are read where the format allows."""
    df = spark.read.format(format).options(**options).load(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def write_match(result, path: str, mode: str = "errorifexists") -> None:
    """matches, review, unmatched and candidates as Parquet folders below ``path``."""
    for part in ("matches", "review", "unmatched", "candidates"):
        getattr(result, part).write.mode(mode).parquet(f"{path}/{part}")


def save_source_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The table as CSV with header and as Parquet."""
    df.write.mode(mode).option("header", True).csv(f"{path}/csv")
    df.write.mode(mode).parquet(f"{path}/parquet")
