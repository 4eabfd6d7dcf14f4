"""Session defaults, lineage cuts and lookups shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "evigraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data may lie: `spark.checkpoint.dir`, or a folder of the warehouse, which a cluster shares too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor never forces a full recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


MOST_BROADCAST = 1_000_000


def listed(rows: DataFrame) -> DataFrame:
    """Short rows that are exceptions, stored; broadcast to the many rows they are looked up for while they are few, else both are shuffled."""
    stored = cut_lineage(rows)
    return F.broadcast(stored) if stored.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else stored


def lookup(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "inner") -> DataFrame:
    """Join many rows to a table that is unique in `dim_key`; the columns of both sides must not clash.

    A small dimension is broadcast by Catalyst or AQE, and AQE splits the partitions of hot keys of a large one.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup supports inner and left, not {how}")
    return facts.join(dim, F.col(fact_key) == F.col(dim_key), how)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a frame that is one row by construction (a global aggregate); no row removes all rows."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")

