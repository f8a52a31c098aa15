"""The index build: files, shingle sets, similar pairs, clusters and their roll-ups, each a lazy frame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import kernels
from ..operators import clustering, compare, similarity, stars
from ..scratch import cut, spread

TYPES = ("cross-marketplace", "internal", "scaffold")


@dataclass
class Scan:
    """``files``: file_index, marketplace, plugin, relative_path, content. Exact pairs by shingle sets, or ``banded``: candidates
    by signatures, unverified, with estimated similarities; no shingle set is built then."""

    all_files: DataFrame
    config: Config = DEFAULT
    banded: bool = False

    @cached_property
    def files(self) -> DataFrame:
        return spread(self.all_files.where(F.length("content") >= self.config.min_chars))

    @cached_property
    def about(self) -> DataFrame:
        """The files without their contents, cut once for all roll-ups."""
        return cut(self.files.select("file_index", "marketplace", "plugin", "relative_path"))

    @cached_property
    def signatures(self) -> DataFrame:
        """``file_index, sig`` as bytes."""
        return cut(kernels.signatures(self.files, self.config, raw=True))

    @cached_property
    def sets(self) -> DataFrame:
        """Numbers for shingles. They take twice the texts' room on disk, so they are worked out again where they are read."""
        return similarity.with_shingles(self.files, self.config)

    @cached_property
    def _counted(self) -> tuple[DataFrame, np.ndarray]:
        return similarity.counted(self.sets)

    @property
    def of(self) -> DataFrame:
        """``file_index, rep, n``: files by equal sets."""
        return self._counted[0]

    @property
    def _near(self) -> tuple[DataFrame, float, np.ndarray]:
        return self.of, self.config.threshold, self._counted[1]

    @cached_property
    def edges(self) -> DataFrame:
        """Verified pairs of different sets, a row each; clusters take them as lists."""
        return cut(similarity.class_edges(self.sets, *self._near))

    @cached_property
    def members(self) -> DataFrame:
        if self.banded:
            return stars.members(self.signatures, self.config)
        return clustering.linked_members(similarity.class_links(self.sets, *self._near), self.of)

    @cached_property
    def raw_pairs(self) -> DataFrame:
        """All pairs inside clusters, with similarities; written, since reports read them several times."""
        return cut(self._pairs())

    def _pairs(self) -> DataFrame:
        return stars.member_pairs(self.members, self.signatures, self.config) if self.banded else clustering.member_pairs(self.members, self.sets, self.of)

    @cached_property
    def means(self) -> DataFrame:
        """``cluster_id, mean``: of the pairs, counted without listing them."""
        return stars.slot_means(self.members, self.signatures, self.config) if self.banded else clustering.pair_means(self.members, self.sets, self.of)

    @cached_property
    def _clusters(self) -> DataFrame:
        return cut(clustering.summary(self.members, self.means, self.about, self.config))

    def cluster_pairs(self) -> DataFrame:
        """The same for one reading, rounded: not written."""
        return self._pairs().withColumn("similarity", F.bround("similarity", 3))

    def clusters(self) -> DataFrame:
        return self._clusters.orderBy(F.desc("size"), "cluster_id")

    def file_index(self) -> DataFrame:
        return clustering.file_index(self.about, self.members, self.config)

    def located(self) -> DataFrame:
        """One row for each place of a file in a cluster."""
        about = self.file_index().drop("cluster_id", "in_cluster")
        return self.members.join(about, "file_index")

    def marketplace_index(self) -> DataFrame:
        return clustering.by_key(self.members, self.about, "marketplace")

    def filename_index(self) -> DataFrame:
        return clustering.by_key(self.members, self.file_index().select("file_index", "filename"), "filename")

    def by_type(self) -> DataFrame:
        kinds = self.about.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
        n = self.clusters().groupBy("type").agg(F.count("*").alias("clusters"), F.sum("size").alias("files"))
        return kinds.join(n, "type", "left").na.fill(0)

    def summary(self) -> DataFrame:
        """Totals; ``files_in_clusters`` counts a file once for each cluster, ``distinct_files_in_clusters`` once."""
        f = self.about.agg(F.count("*").alias("total_files_scanned"))
        m = self.members.agg(F.count("*").alias("files_in_clusters"), F.count_distinct("file_index").alias("distinct_files_in_clusters"), F.count_distinct("cluster_id").alias("unique_clusters"))
        p = self.marketplace_index().agg(F.count("*").alias("unique_marketplaces"))
        one = f.crossJoin(m).crossJoin(p).withColumn("unclustered_files", F.col("total_files_scanned") - F.col("files_in_clusters"))
        check = compare.sanity(F.col("total_files_scanned"), F.col("unclustered_files"), F.col("files_in_clusters"), F.col("unique_clusters"))
        return one.withColumn("_s", check).select("*", "_s.confidence", "_s.warnings").drop("_s")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A table of documents in the engine's form: source and language stand for collection and plugin."""
    return documents.select(F.col("doc_id").alias("file_index"), F.col("source").alias("marketplace"), F.col("lang").alias("plugin"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")).alias("relative_path"), F.col("text").alias("content"))
