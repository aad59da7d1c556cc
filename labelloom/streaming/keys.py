"""The ids that a stream has handled, in buckets, so that a batch reads only its own.

Ids are dealt to buckets by their hash.  A batch lists and reads the buckets of
its ids and nothing else, whatever the table has grown to.  Every ``roll``
batches the ids of the epoch before are rewritten as one file a bucket, so a
bucket never has more than ``roll`` files.  All writes replace a folder that
only this batch writes: a retried batch leaves the same table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.relational import skip_known

BUCKETS = 256
WRITERS = 32  # tasks that write buckets side by side; by itself Spark makes one of them, as ids are few bytes
ROLL = 1000
CARRIED = -1  # the batch number of the ids carried over from earlier epochs
BUCKET, BATCH = "key_bucket", "key_batch"


class KeyTable:
    """Known ids below ``path``; ``buckets`` must stay what it was when the table was begun."""

    def __init__(self, path: str, row_id: str = "id", buckets: int = BUCKETS, roll: int = ROLL):
        self.path, self.row_id, self.buckets, self.roll = path, row_id, buckets, roll

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.row_id).cast("string")), F.lit(self.buckets)).cast("int")

    def _epoch(self, batch_id: int) -> str:
        return f"{self.path}/epoch={batch_id // self.roll}"

    def _read(self, spark: SparkSession, epoch: str, folders: str, kind: T.DataType) -> DataFrame | None:
        schema = T.StructType([T.StructField(self.row_id, kind), T.StructField(BATCH, T.LongType()),
                               T.StructField(BUCKET, T.IntegerType())])
        try:
            return spark.read.schema(schema).option("basePath", epoch).parquet(f"{epoch}/{folders}")
        except AnalysisException:  # none of these folders is there yet
            return None

    def known(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Ids of earlier batches in the buckets of this one's ids."""
        # At most one value per bucket comes to the driver.
        mine = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())
        if not mine:
            return None
        wanted = f"{BATCH}=*/{BUCKET}={{{','.join(map(str, mine))}}}"
        found = self._read(batch.sparkSession, self._epoch(batch_id), wanted, batch.schema[self.row_id].dataType)
        return found if found is None else found.where(F.col(BATCH) < batch_id).select(self.row_id)

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose id no earlier batch has added."""
        if batch_id and batch_id % self.roll == 0:
            self._carry(batch.sparkSession, batch_id, batch.schema[self.row_id].dataType)
        known = self.known(batch, batch_id)
        return batch if known is None else skip_known(batch, known, self.row_id)

    def add(self, ids: DataFrame, batch_id: int) -> None:
        self._write(ids.select(self.row_id), self._epoch(batch_id), batch_id)

    def _write(self, ids: DataFrame, epoch: str, batch_id: int) -> None:
        (ids.withColumn(BUCKET, self.bucket()).repartition(min(WRITERS, self.buckets), BUCKET).write.mode("overwrite")
         .partitionBy(BUCKET).parquet(f"{epoch}/{BATCH}={batch_id}"))

    def _carry(self, spark: SparkSession, batch_id: int, kind: T.DataType) -> None:
        """Begin an epoch with all ids of the one before, which nothing writes any more."""
        before = self._read(spark, self._epoch(batch_id - 1), f"{BATCH}=*", kind)
        if before is not None:
            self._write(before.select(self.row_id), self._epoch(batch_id), CARRIED)
