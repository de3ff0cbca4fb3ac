"""Session settings, checkpoints and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every query relies on; cluster-sized ones (memory, partitions) are left to the session.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply REQUIRED to a foreign session and make the package importable on its executors."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="quire-ship-")) / "quire_pkg.zip"  # driver-side only; Spark serves it to executors
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quire/{p.relative_to(root).as_posix()}")
    sc.addPyFile(str(where))
    _SHIPPED.add(sc.applicationId)


def is_single_machine(master: str) -> bool:
    """Whether a master runs all its executors on this machine."""
    return master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset on a single machine (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not is_single_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='quire-checkpoint-')}")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through the shared, reliable checkpoint folder.

    A checkpointed plan keeps the sort orders that hold for the plan it replaces, one for each way to name them; over the rounds of an
    iteration these multiply until planning takes longer than running. So the checkpointed rows are wrapped in a plan of their own.
    """
    checkpoint_dir(df.sparkSession)
    return detached(df.checkpoint(eager=True))


def detached(df: DataFrame) -> DataFrame:
    """df with a plan of its own over the same rows, whose lineage stays: what was planned for df, or is cached of it, is read, not planned again."""
    spark = df.sparkSession
    try:
        rows = df._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)
    except Exception:  # another kind of session: correct, only slower over many rounds
        return df


@contextmanager
def fixed_plans(spark: SparkSession) -> Iterator[None]:
    """Plans that are not changed while they run, for iterations of many small equal rounds, where planning anew at each shuffle takes longest."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8")))
