"""The stateless part of the analysis on a stream of new respondents.

Recoding, scoring the issue count, the inclusion rule and a fitted pipeline are row
operations, so the batch functions run on a stream unchanged. Imputation is not: it needs
all rows and stays a batch step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyweave.session import shared_dir


def process_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    name: str,
    files_per_trigger: int = 1000,
) -> None:
    """Process every file that has arrived in ``source`` once, and stop.

    Progress and written files are tracked under the checkpoint folder, so that a restart
    neither repeats nor loses rows.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    started = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
