"""Session construction and shared-storage helpers.

The library never needs a special session: every operator works with Spark's
defaults.  ``build_session`` only adds what helps large jobs and leaves master,
memory and executor counts to the caller.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE replace a sort-merge join by a shuffled hash join when every
    # build-side partition is small, so the wide side is not sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: dict[str, str] = {}


def build_session(app_name: str = "labelloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may use a local disk, by itself a temporary folder: on
    a cluster the executors would each see a different one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="labelloom-")
        base = _local_scratch[app]
    return f"{base.rstrip('/')}/labelloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Used where several jobs read one expensive result.  Unlike cached blocks a
    written table outlives lost executors, and it cuts the lineage.
    """
    path = path or scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(scan: DataFrame, by: str, partitions: int | None = None) -> DataFrame:
    """Deal rows by the hash of their id before costly text work, if few tasks would do it otherwise.

    Multi-line CSV, gzip files and Parquet files of one row group are read by
    one task each, and the work would stay in it.  A scan that has a task for
    every core already is left as it is: dealing it out would only be a shuffle.
    ``partitions`` asks for that many in any case.
    """
    if partitions is not None:
        return scan.repartition(partitions, by)
    context = scan.sparkSession.sparkContext
    return scan.repartition(by) if scan.rdd.getNumPartitions() < context.defaultParallelism else scan
