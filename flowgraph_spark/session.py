"""Session settings and the shared folder used to cut lineage."""

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="flowgraph_spark", **conf):
    """Session with the settings the operators are tuned for.

    Shuffle width is left to AQE: a generous initial number of partitions is
    coalesced to the advisory size, and skewed join partitions are split.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Wide projections beyond what the JIT compiles run faster outside one method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster the
    folder has to survive the loss of any executor, so it must be named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise ValueError(
                    "Set spark.checkpoint.dir to a folder all executors share."
                )
            configured = tempfile.mkdtemp(prefix="flowgraph-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


class TableOwner:
    """Tables of :func:`cut_lineage` that go when the work they serve ends."""

    def __init__(self, outer):
        self.outer, self.folders = outer, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as a table that outlives this owner; an owner around it takes it over."""
        before = set(self.folders)
        kept = cut_lineage(df)
        for folder in set(self.folders) - before:
            spark = self.folders.pop(folder)
            if self.outer is not None:
                self.outer.folders[folder] = spark
        return kept


_OWNERS = threading.local()


@contextlib.contextmanager
def temporary_tables():
    """Deletes at its end every table that this thread wrote by :func:`cut_lineage` inside.

    Results that are read later are written by ``keep`` of the owner this yields.
    Also after an error nothing stays.
    """
    outer = getattr(_OWNERS, "current", None)
    owner = _OWNERS.current = TableOwner(outer)
    try:
        yield owner
    finally:
        _OWNERS.current = outer
        for folder, spark in owner.folders.items():
            _delete(spark, folder)


def _delete(spark, folder):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table_folder(spark: SparkSession) -> str:
    """A new folder for a table; the owner around it, if any, deletes it at its end."""
    folder = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    owner = getattr(_OWNERS, "current", None)
    if owner is not None:
        owner.folders[folder] = spark
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where one result feeds several readers or an iteration. Unlike a
    cached frame it survives the loss of executors, and unlike a row checkpoint
    it is columnar: later readers load only the columns they need.
    """
    path = table_folder(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables):
    """Deletes tables of :func:`cut_lineage` that nothing reads any more; None is skipped."""
    for table in tables:
        if table is None:
            continue
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            _delete(table.sparkSession, folder)
