"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here is written for. Only values the session has
# not set itself are applied.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM never compiles methods over 8000 bytes; wide projections run many times
    # faster as split projections than as one fused but interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A page can be close to a megabyte, so Arrow batches of pages stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Payloads are walked by recursion, whose rows grow with the input; equal keys are allowed.
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch then stores what it changed, not a snapshot of all state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to a session that did not choose its own."""
    chosen = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="anchorlake-")) / package.name), "zip",
        package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", name: str = "anchorlake") -> SparkSession:
    """A local session for tests and benchmarks."""
    parts = str(cores if str(cores).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # a static setting: recording a call site per column slows plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    On a cluster the folder must be reachable from every executor, so a missing setting
    is an error there. A single-process session without the setting gets a folder of its
    own, which goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    named = tempfile.mkdtemp(prefix="anchorlake-")
    atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Later steps read only the columns they need, with filters and statistics, and lost
    executors cost nothing that was computed before.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def folders(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders in ``path`` that hold a file of the given name; none where there is no ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop.Path(f"{path}/*/{holding}"))
    return sorted(status.getPath().getParent().getName() for status in found or [])


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove folders wherever Spark can reach them; one that is gone already is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    Many-file tables already have more input splits than cores and pass through
    without a shuffle; only a scan that would leave cores idle is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
