"""Session helpers.

Library code never creates its own session; callers pass one in.  The
helpers here are for tests, the bench and ``__spark_entry__``.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tabqa") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    b = SparkSession.builder
    ev = os.environ.get("TABQA_EVENT_LOG")  # opt-in: stage/task times for profiling
    if ev:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev)
    spark = (
        b.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The value configured on the session (``spark.checkpoint.dir``) wins.  A
    folder is only set here when none is configured and the session has no
    executors elsewhere (``local`` masters, as in tests); on a cluster a
    missing setting is an error, since a local folder would not be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        conf_dir = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tabqa-checkpoints")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df, name: str = "pin"):
    """Cut lineage by writing ``df`` as Parquet under the checkpoint folder and reading it back.

    Same guarantee as a reliable checkpoint (the data lives in the shared
    folder named by ``spark.checkpoint.dir``, so losing an executor does not
    lose it), but columnar, compressed and prunable — much cheaper than the
    row-serialised RDD checkpoint.  Each call writes a fresh folder.  The
    shuffles of the write go with it, since nothing can read them afterwards:
    left alone they stay on disk until the driver collects its garbage.
    """
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tabqa-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.parquet(path)
