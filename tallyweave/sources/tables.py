"""Scans, sinks and artefact naming."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RunScope:
    """What a stored artefact belongs to: organisation, project and run parameters."""

    organisation: str
    project: str = "survey"
    features: int | None = None
    k: int | None = None
    perplexity: int | None = None

    @property
    def run_id(self) -> str:
        parts = [self.project]
        parts += [f"f{self.features}"] if self.features is not None else []
        parts += [f"k{self.k}"] if self.k is not None else []
        parts += [f"p{self.perplexity}"] if self.perplexity is not None else []
        return "-".join(parts)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headed, quoted CSV with a declared schema; ``NA`` is null, short rows are padded."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def save_snapshot(df: DataFrame, path: str, scope: RunScope) -> None:
    """Stage table partitioned by organisation and run, so that a reader prunes folders."""
    (
        df.withColumns({"organisation": F.lit(scope.organisation), "run_id": F.lit(scope.run_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("organisation", "run_id")
        .parquet(path)
    )


def load_snapshot(spark: SparkSession, path: str, scope: RunScope) -> DataFrame:
    stored = spark.read.parquet(path)
    wanted = (F.col("organisation") == scope.organisation) & (F.col("run_id") == scope.run_id)
    return stored.where(wanted).drop("organisation", "run_id")


def write_csv(df: DataFrame, path: str, sort_by: Sequence[str] = ()) -> None:
    """CSV sink. The key is an ordinary column; rows are range-sorted only on request."""
    ordered = df.orderBy(*sort_by) if sort_by else df
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Space-separated report table."""
    df.write.mode("overwrite").option("header", True).option("sep", " ").option("nullValue", "NA").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_predictors(predictors: DataFrame, path: str) -> None:
    predictors.select("target", "predictor").write.mode("overwrite").parquet(path)


def load_predictors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("target string, predictor string").parquet(path)
