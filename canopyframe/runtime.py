"""Session, lineage and size-check helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows one task may hold for a single group before the distributed route is taken.
GROUP_LIMIT = 1_000_000
#: Rows a side may have to be broadcast.
BROADCAST_LIMIT = 200_000
#: Copies of the small side in salted joins.
SALTS = 8


def local_session(app: str = "canopyframe", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and local benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CANOPYFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taken from the session configuration.

    Only a local session without one gets a temporary folder; on a cluster the
    folder must be shared by all executors, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="canopyframe-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plans from growing in loops."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_one_task(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Measure whether every group of ``keys`` (or the whole frame) stays below ``limit`` rows."""
    limit = GROUP_LIMIT if limit is None else limit
    if not keys:
        return df.select(F.lit(1)).limit(limit + 1).count() <= limit
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.where(F.col("_n") > limit).take(1)


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint only when a measured row count allows it; otherwise Spark shuffles."""
    limit = BROADCAST_LIMIT if limit is None else limit
    return F.broadcast(df) if fits_one_task(df, [], limit) else df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salts: int | None = None) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    Rows of ``big`` get a salt from a hash of the point number or else of the
    whole row, ``small`` is repeated once per salt. ``how`` may be ``inner``, ``left``, ``left_semi``
    or ``left_anti``: every row of ``big`` still meets all its partners.
    """
    salts = SALTS if salts is None else salts
    row_id = ["point_idx"] if "point_idx" in big.columns and "point_idx" not in on else _hashable(big)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how}")
    if salts <= 1:
        return big.join(small, on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() not in ("map", "variant")]
