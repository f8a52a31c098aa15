"""Sources: trees of Markdown files, installed plugins, cluster reports and capability indices.

Trees are listed and read by tasks, see :mod:`corpuslens.sources.tree`.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pandas_udfs import front_matter
from ..functions.text import description_of, kind_of, name_of, plugin_of
from ..operators.numbering import numbered
from ..scratch import cut
from . import lookup, tree

REPORT = """metadata STRUCT<version: STRING, generated_at: STRING, similarity_threshold: DOUBLE, num_permutations: INT, confidence: STRING, warnings: ARRAY<STRING>>,
summary STRUCT<total_files_scanned: INT, files_in_clusters: INT, unclustered_files: INT, unique_clusters: INT, unique_marketplaces: INT>,
file_index ARRAY<STRUCT<file_index: INT, marketplace: STRING, plugin: STRING, path: STRING, filename: STRING, is_official: BOOLEAN, cluster_id: INT, in_cluster: BOOLEAN>>,
clusters ARRAY<STRUCT<cluster_id: INT, type: STRING, size: INT, avg_similarity: DOUBLE, has_official: BOOLEAN, marketplaces: ARRAY<STRING>,
locations: ARRAY<STRUCT<file_index: INT, marketplace: STRING, plugin: STRING, path: STRING, is_official: BOOLEAN>>,
similarity_pairs: ARRAY<STRUCT<file1_index: INT, file2_index: INT, similarity: DOUBLE>>>>"""
CAPABILITIES = "metadata STRUCT<total: INT, skills: INT, agents: INT>, capabilities ARRAY<STRUCT<name: STRING, kind: STRING, description: STRING, marketplace: STRING, plugin: STRING, path: STRING, triggers: ARRAY<STRING>>>"


@dataclass(frozen=True)
class Scanned:
    """``files``: ``file_index, marketplace, plugin, relative_path, full_path, content``; ``problems``: ``full_path, error`` of what
    could not be read; ``counts``: indexed, short (left out), failed."""

    files: DataFrame
    problems: DataFrame
    counts: dict[str, int]


def _scanned(names: DataFrame, root: str, config: Config) -> Scanned:
    seen = Observation()
    read = F.col("error").isNull()
    fits = read & (F.length("content") >= config.min_chars)
    counts = [F.count_if(c).alias(n) for n, c in (("indexed", fits), ("short", read & ~fits), ("failed", ~read))]
    rows = cut(tree.with_contents(names, root).observe(seen, *counts))
    own = rows.where(fits).withColumnRenamed("collection", "marketplace").drop("error")
    ids = numbered(own.select("marketplace", "relative_path", "full_path"), ["marketplace", "relative_path", "full_path"], "file_index")
    files = own.join(ids.select("full_path", "file_index"), "full_path")
    files = files.select("file_index", "marketplace", plugin_of(F.col("relative_path")).alias("plugin"), "relative_path", "full_path", "content")
    return Scanned(files, rows.where(~read).select("full_path", "error"), seen.get)


def scan_tree(spark: SparkSession, root: str, config: Config = DEFAULT) -> Scanned:
    """The Markdown files of every collection (folder of ``root`` that isn't hidden). Paths with ``backup`` in them and short
    files are left out; bytes that are no UTF-8 are replaced. Ids are dense and follow collection and path. The files are
    read once, into a checkpoint."""
    path = F.lower(F.concat_ws("/", "collection", "relative_path"))
    names = tree.listed(spark, root).where(~F.col("collection").startswith(".") & ~F.contains(path, F.lit("backup")))
    return _scanned(names, root, config)


def scan_installed(spark: SparkSession, installed: DataFrame, config: Config = DEFAULT) -> Scanned:
    """The Markdown files below the install paths of plugins (``name, marketplace, install_path``), of which there are few; paths
    that don't exist are among the problems."""
    folders = sorted({(r.marketplace, r.install_path) for r in installed.collect()})
    root = folders[0][1] if folders else "/"
    names = tree.listed(spark, root, folders=folders).where(~F.contains(F.lower("full_path"), F.lit("backup")))
    return _scanned(names, root, config)


def scan(spark: SparkSession, root: str, config: Config = DEFAULT) -> DataFrame:
    return scan_tree(spark, root, config).files


def baseline(files: DataFrame, spec: str, installed: DataFrame | None = None) -> DataFrame:
    """The files of ``installed``, a collection or ``collection/plugin``. A collection's case counts only if both spellings exist;
    a plugin is a folder of the collection, of its ``plugins`` or of a folder in that, in this order. installed: plugins by
    name and collection, or files that :func:`scan_installed` read."""
    if not spec.strip():
        raise ValueError("the baseline is blank")
    if spec == "installed":
        if installed is None:
            raise ValueError("no installed plugins are known")
        if "content" in installed.columns:
            return installed
        return files.join(installed.select("marketplace", F.col("name").alias("plugin")).distinct(), ["marketplace", "plugin"], "left_semi")
    name, _, plugin = spec.partition("/")
    collection = lookup.collection_name(files, name)
    if collection is None:
        some = [r[0] for r in files.select("marketplace").distinct().orderBy("marketplace").limit(10).collect()]
        raise ValueError(f"not found: {name}; available: {', '.join(some)}")
    own = files.where(F.col("marketplace") == collection)
    if plugin:
        folder = lookup.plugin_folder(own, collection, plugin)
        if folder is None:
            raise ValueError(f"not found: {spec}")
        own = own.where(F.col("relative_path").startswith(f"{folder}/"))
    return own


def capabilities(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Skills and agents: files below a folder of that name, with name, description and (empty) triggers."""
    kind, meta = kind_of(F.col("relative_path")), F.col("meta")
    rows = files.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.length("content") >= config.min_capability_chars)).withColumn("meta", front_matter("content"))
    listed = F.array_join(F.from_json(F.get_json_object(meta, "$.description"), "array<string>"), " ")
    given = F.coalesce(F.nullif(listed, F.lit("")), F.nullif(F.get_json_object(meta, "$.description"), F.lit("")))
    description = F.coalesce(given, description_of(F.col("content")))
    return rows.select(name_of(F.col("relative_path")).alias("name"), "kind", description.alias("description"), "marketplace", "plugin", F.col("relative_path").alias("path"), F.array().cast("array<string>").alias("triggers"))


def installed_plugins(spark: SparkSession, path: str) -> DataFrame:
    """``name, marketplace, install_path, version`` of each install with a path; keys split at their last ``@``."""
    schema = "plugins MAP<STRING, ARRAY<STRUCT<installPath: STRING, version: STRING>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("plugins").alias("key", "installs")).select("key", F.explode("installs").alias("x"))
    name, collection = F.regexp_extract("key", r"(?s)^(.*)@[^@]*$", 1), F.regexp_extract("key", r"@([^@]*)$", 1)
    has = F.contains("key", F.lit("@"))
    out = rows.select(F.when(has, name).otherwise(F.col("key")).alias("name"), F.when(has, collection).otherwise("unknown").alias("marketplace"), F.col("x.installPath").alias("install_path"), F.coalesce("x.version", F.lit("unknown")).alias("version"))
    return out.where(F.coalesce(F.trim("install_path"), F.lit("")) != "")


def report_locations(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, type, marketplace, plugin, path, filename, is_official`` of a report, either version: where clusters
    have no id their place in the list is used."""
    rows = spark.read.schema(REPORT).json(path, multiLine=True).select(F.posexplode("clusters").alias("at", "c"))
    rows = rows.select(F.coalesce("c.cluster_id", "at").cast("long").alias("cluster_id"), F.col("c.type").alias("type"), F.explode("c.locations").alias("l"))
    return rows.select("cluster_id", "type", "l.marketplace", "l.plugin", "l.path", F.substring_index("l.path", "/", -1).alias("filename"), F.coalesce("l.is_official", F.lit(False)).alias("is_official"))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def located(spark: SparkSession, report: str | None, folder: str) -> DataFrame:
    """``cluster_id, type, marketplace, plugin, path, filename, is_official`` of every place of a file in a cluster, from a
    report or, if none is named, from the tables in ``folder`` that a scan left there."""
    path = report or f"{folder}/located"
    if not exists(spark, path):
        raise ValueError(f"no index at {path}: run scan first")
    rows = report_locations(spark, path) if report else spark.read.parquet(path)
    saved = [c for c in ("folded", "part") if c in rows.columns]
    return rows.select("cluster_id", "type", "marketplace", "plugin", "path", "filename", "is_official", *saved)


def cluster_count(spark: SparkSession, report: str | None, folder: str) -> int:
    """The number of clusters that a report, or the tables that a scan left, tell; 0 where there is none or it can't be read."""
    try:
        if report:
            rows = spark.read.schema(REPORT).json(report, multiLine=True)
            return rows.select(F.coalesce("summary.unique_clusters", F.lit(0))).first()[0]
        return spark.read.parquet(f"{folder}/clusters").count() if exists(spark, f"{folder}/clusters") else 0
    except (AnalysisException, Py4JJavaError, TypeError):
        return 0


def signed(spark: SparkSession, folder: str) -> DataFrame:
    """``file_index, marketplace, plugin, relative_path, sig`` of every file of the last scan."""
    return spark.read.parquet(f"{folder}/signatures")


def capability_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CAPABILITIES).json(path, multiLine=True).select(F.posexplode("capabilities").alias("ord", "c")).select("ord", "c.*")
    return rows.withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))


def find_file(files: DataFrame, spec: str) -> DataFrame:
    """The first skill or agent that a name, ``collection/name`` or ``collection/plugin/name`` means."""
    parts = spec.strip("/").split("/")
    name, rows = parts[-1].removesuffix(".md").lower(), files.where(kind_of(F.col("relative_path")).isNotNull())
    if len(parts) > 1:
        rows = rows.where(F.lower("marketplace") == parts[0].lower())
    if len(parts) > 2:
        rows = rows.where(F.col("plugin") == parts[1])
    stem = F.lower(F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.md$", ""))
    rows = rows.where((stem == name) | (F.lower(name_of(F.col("relative_path"))) == name))
    return rows.orderBy(F.when(kind_of(F.col("relative_path")) == "skill", 0).otherwise(1), "marketplace", "relative_path").limit(1)
