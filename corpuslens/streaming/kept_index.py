"""A signature index that is kept: files keep arriving, and only what they touch is clustered anew.

The index is a folder of Parquet tables with a folder a batch, which nothing but that batch writes; so a batch that is run
again leaves what it would have left at once.

* ``buckets`` (bucket, node): each file under all bands of its signature, sorted by bucket
* ``signatures`` (file_index, sig)
* ``components`` (node, component): the files that have neighbours, by connected component
* ``stars`` (seed, node, component): clusters
* ``retired`` (component, born): components that a later batch took up into its own
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions import kernels
from ..operators import stars
from ..operators.numbering import numbered
from ..scratch import cut
from ..sources.files import exists

TABLES = {
    "buckets": "bucket binary, node long", "signatures": "file_index long, sig binary", "components": "node long, component long",
    "stars": "seed long, node long, component long", "retired": "component long, born long",
}


def connected(rows: DataFrame) -> DataFrame:
    """``node, component`` of files (``node, bucket``): the least file that can be reached through shared buckets."""
    labels = cut(rows.select("node", F.col("node").alias("component")).distinct())
    while True:
        low = rows.join(labels, "node").groupBy("bucket").agg(F.min("component").alias("low"))
        # over the label's own label too, which shortens chains
        near = rows.join(low, "bucket").groupBy("node").agg(F.min("low").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        new = cut(near.join(far, "low").select("node", F.least("low", "lower").alias("component")))
        if not new.join(labels, ["node", "component"], "left_anti").head(1):
            return new
        labels = new


class KeptIndex:
    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT) -> None:
        self.spark, self.folder, self.config = spark, folder, config

    def _table(self, name: str, before: int | None = None) -> DataFrame:
        """A table as the batches before one left it, with the batch as ``batch``."""
        path, schema = f"{self.folder}/{name}", f"{TABLES[name]}, batch long"
        rows = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def _living(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of components that no later batch took up."""
        gone = self._table("retired", before).select("component", F.col("born").alias("batch"))
        return self._table(name, before).join(gone, ["component", "batch"], "left_anti")

    def add(self, files: DataFrame, batch: int) -> None:
        """Adds files (``file_index, content``), as batch number ``batch``. Files whose index is known are left as they are.

        Of the kept index the bucket table is read once and sends on what shares a bucket with a new file; then all rows of
        the components so touched come together with the new rows, and these alone are clustered."""
        new = kernels.signatures(files.where(F.length("content") >= self.config.min_chars), self.config, raw=True)
        new = new.withColumn("file_index", F.col("file_index").cast("long")).dropDuplicates(["file_index"])
        new = new.join(self._table("signatures", batch).select("file_index"), "file_index", "left_anti")
        new = self._write(new, "signatures", batch)
        rows = self._write(stars.buckets(new, self.config).repartitionByRange("bucket").sortWithinPartitions("bucket").select("bucket", "node"), "buckets", batch)
        old = self._table("buckets", batch).select("bucket", "node")
        met = cut(old.join(rows.select("bucket").distinct(), "bucket", "left_semi").select("node").distinct())
        kept = self._living("components", batch)
        touched = cut(kept.join(met, "node", "left_semi").select("component", F.col("batch").alias("born")).distinct())
        mine = kept.join(touched.select("component", F.col("born").alias("batch")), ["component", "batch"], "left_semi").select("node")
        again = cut(mine.union(met).distinct())
        all_ = stars.shared(old.join(again, "node", "left_semi").unionByName(rows).select("node", "bucket"))
        parts = self._write(connected(all_), "components", batch)
        found = stars.stars(all_, stars.seeds(all_)).join(parts, "node").select("seed", "node", "component")
        self._write(found, "stars", batch)
        self._write(touched, "retired", batch)

    def stars(self) -> DataFrame:
        """``seed, node`` of all clusters."""
        return self._living("stars").select("seed", "node")

    def members(self) -> DataFrame:
        """``cluster_id, file_index``, ids dense in the order of the seeds."""
        own = self.stars()
        ids = numbered(own.select("seed").distinct(), ["seed"], "cluster_id")
        return own.join(ids, "seed").select("cluster_id", F.col("node").alias("file_index"))

    def signatures(self) -> DataFrame:
        return self._table("signatures").select("file_index", "sig")

    def probe(self, files: DataFrame) -> DataFrame:
        """``j, jaccard, i``: each file with its best candidate in the index, which stays as it is."""
        return stars.best_candidates(self.signatures(), cut(kernels.signatures(files, self.config, raw=True)), self.config)

    def follow(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """Adds what a stream (``file_index, content``) holds now; each micro-batch is a batch."""
        return files.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
