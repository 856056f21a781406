"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library's own sessions start with; a cluster's session keeps its own.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "anchorloom", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; production code is handed its session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests, the bench) is a local folder made
    and set; on a cluster it must be given.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    given = "file://" + tempfile.mkdtemp(prefix="anchorloom-")
    spark.conf.set("spark.checkpoint.dir", given)
    return given


#: Below so many bytes a core, a table is too small for Spark to split by itself.
SMALL_BYTES_A_CORE = 2 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table over all cores, before work that is heavy for each row.

    A file with one row group is one task however many cores wait. Tables of more than
    SMALL_BYTES_A_CORE for each core, by Spark's own estimate, stay as they are: they have
    tasks enough, and a shuffle would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * SMALL_BYTES_A_CORE else df


#: Folders of workspaces that were not cleared.
_OPEN: list[str] = []


def clear_workspaces(spark: SparkSession) -> None:
    """Delete the written tables of all runs of this driver, once their results are saved."""
    for root in list(_OPEN):
        _delete(spark, root)
    _OPEN.clear()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Written tables of one run. Each cuts the lineage: what follows reads files
    that outlive any executor, and is not computed again."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _OPEN.append(self.root)
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._anchorloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a written table that nothing reads any more."""
        path = getattr(df, "_anchorloom_path", None)
        if path:
            _delete(self.spark, path)

    def clear(self) -> None:
        _delete(self.spark, self.root)
        if self.root in _OPEN:
            _OPEN.remove(self.root)
