"""SparkSession helpers: UTC session zone, ANSI on, AQE on, checkpoint dir."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

from wastelens.functions import scalars as S

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Delete checkpoint files once their RDD is garbage-collected, so long
    # sessions do not fill the shared checkpoint folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "wastelens",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    checkpoint directory is then whatever the cluster configured.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor.
            b = b.config("spark.driver.memory", conf.pop("driver_memory", "16g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only in local mode may it be unset:
    then a fresh scratch folder is created and registered. On a cluster an
    unset folder is an error, as no machine-local one could be shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wastelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def exchanges_dropped(spark: SparkSession):
    """What exchanges of a query begun in here have written is deleted when the query ends, not when the driver
    happens to collect its garbage. For queries whose result is stored and whose plan is not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df, digests=()):
    """Eager, reliable checkpoint into the shared folder of
    ``spark.checkpoint.dir`` (ensured first). Never a local checkpoint: the
    files outlive lost executors. ``digests``: columns that mostly hold SHA-256 texts, which are stored in half the room."""
    ensure_checkpoint_dir(df.sparkSession)
    with exchanges_dropped(df.sparkSession):
        stored = df.withColumns({c: S.short_digest(c) for c in digests}).checkpoint(eager=True)
    return stored.withColumns({c: S.long_digest(c) for c in digests})


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wastelens`` importable in the Python workers (as ``--py-files``
    would): zip the package once per application and add it with
    ``SparkContext.addPyFile``; Spark distributes it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="wastelens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
