"""Session set-up, shared-folder checkpoints and size-checked broadcasts.

Nothing here caches on one executor only: lineage is cut with reliable
checkpoints in the folder the cluster names in ``spark.checkpoint.dir``, so a
lost executor costs recomputed tasks, never a failed job.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: Rows and bytes up to which a side is broadcast; a side above either is joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Folder the package stands in; Python workers need it on their path.
_ROOT = str(Path(__file__).resolve().parents[1])


def build_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.executorEnv.PYTHONPATH": os.pathsep.join(filter(None, [_ROOT, os.environ.get("PYTHONPATH", "")])),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    # Workers of a local master are started from this process and have its environment.
    if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        os.environ["PYTHONPATH"] = settings["spark.executorEnv.PYTHONPATH"]
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` is used as it is. Only a local
    master, where driver and executors share one disk, gets a folder of its
    own; elsewhere a missing setting is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tidewire-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(field: StructField) -> Column:
    """Bytes of a value, roughly; nested ones as text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return F.lit(8)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and about ``size`` bytes, else as it is.

    The check reads at most ``rows + 1`` rows. Beyond the bounds the planner
    joins by shuffle, where AQE splits skewed partitions. A side that is dear to
    make is written first (``cut``), or the check makes it once more.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, **exprs: str | Column) -> DataFrame:
    """``df`` with columns that are computed once each.

    The optimizer merges neighbouring projections and so copies an expression
    to every place that uses it; a one-row generator between them keeps it
    single, which keeps the generated code small.
    """
    made = [(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in exprs.items()]
    return df.select("*", F.inline(F.array(F.struct(*made))))
