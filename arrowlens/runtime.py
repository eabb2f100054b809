"""Session helpers and the shared scratch folder that cuts lineage of iterative operators."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK_SHARED = "/tmp/arrowlens-checkpoints"


def session(app: str = "arrowlens", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library is tested with; settings of a cluster win over these."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):  # the driver does all the work; counts only if no JVM runs yet
            b = b.config("spark.driver.memory", "6g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session whose executors are this machine may
    leave it unset; it gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _FALLBACK_SHARED
    return found.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Named Parquet tables under the shared folder.

    A table written here survives the loss of any executor and cuts the lineage of an iterative plan. `replace`
    writes the next version of a table and removes the one before, so that an iteration holds two versions at most.
    What is left is removed when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/arrowlens-{label}-{uuid.uuid4().hex[:12]}"
        self._version: dict[str, int] = {}
        atexit.register(self.clear)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}-{version}"

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        version = self._version.get(name, -1) + 1
        path = self._path(name, version)
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        self._version[name] = version
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        out = self.write(df, name)
        if self._version[name]:
            self._delete(self._path(name, self._version[name] - 1))
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._version:
                self._delete(self._path(name, self._version[name]))

    def free(self) -> None:
        """Lets the disk go that shuffles of tables written before still hold; Spark does so for what the driver's
        garbage collector has found."""
        for _ in range(2):  # Python's references go first, and Spark's cleaner works beside
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended already
            pass
