"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers this package, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="tallyweave-package-")
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(folder, "tallyweave"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide row expressions rely on, and the package on the workers.

    * The JVM interprets methods above 8000 bytes of bytecode instead of compiling them. A
      fused stage with a hundred recoded columns exceeds that; the lower limit makes Spark
      fall back to split methods there (recoding runs three to five times faster).
    * Constraint propagation substitutes aliases into aliases, which takes exponential
      time on filters over dozens of recoded columns; the filters it could infer here are
      null checks on keys that are never null.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # blocks travel as rows of up to a megabyte: bound a batch by bytes, not by rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    return ship_package(spark)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine. A cluster brings its own."""
    return tuned(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as it is. Only a
    local session without the setting gets a temporary folder; a cluster without it is
    an error, because a machine-local folder would be lost with the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="tallyweave-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Loops keep short plans and a lost executor costs one step rather than the whole
    history. A table rather than a checkpoint, because a table is planned with its real
    size: a checkpoint keeps the size estimated for its old plan, and after a few rounds
    of joins those estimates make broadcasts impossible and their product astronomical.

    ``replaces`` is an earlier result of this function that nobody reads any more; its
    files go once the new ones are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    step = spark.read.schema(df.schema).parquet(path)
    step._step_path = path
    if replaces is not None:
        drop_step(replaces)
    return step


def drop_step(step: DataFrame) -> None:
    """Delete the files of a result of :func:`cut_lineage`."""
    path = getattr(step, "_step_path", None)
    if path is not None:
        folder = step.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
