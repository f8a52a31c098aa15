"""Sinks: the report and the capability index as JSON documents, result tables as Parquet, and checkouts."""

from __future__ import annotations

import json
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.pandas_udfs import front_matter_of
from ..operators.index import lookup_part
from ..plans.scan import Scan


def write_located(located: DataFrame, folder: str, config: Config = DEFAULT) -> None:
    """The locations for lookups by file name: in parts by a hash of the name, sorted by name and with a Bloom filter of the names, so
    that a name is looked up in one part's files; ``folded`` has the names in lower case for the search by substrings."""
    rows = located.withColumn("folded", F.lower("filename")).withColumn("part", lookup_part(F.col("filename"), config.lookup_parts))
    # one file a part for small results; a hot name's part is still split by Spark's own limit on a file's rows
    rows = rows.repartition(config.lookup_parts, "part").sortWithinPartitions("part", "filename", "cluster_id")
    out = rows.write.mode("overwrite").partitionBy("part").option("maxRecordsPerFile", 5_000_000)
    out.option("parquet.bloom.filter.enabled#filename", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)


def write_tables(scan: Scan, folder: str, config: Config = DEFAULT) -> None:
    """The result as Parquet tables: the form for large collections."""
    for name in ("clusters", "cluster_pairs", "file_index", "marketplace_index", "filename_index"):
        getattr(scan, name)().write.mode("overwrite").parquet(f"{folder}/{name}")
    write_located(scan.located().join(scan.clusters().select("cluster_id", "type"), "cluster_id"), f"{folder}/located", config)
    signed = scan.signatures.join(scan.about, "file_index")
    signed.select("file_index", "marketplace", "plugin", "relative_path", "sig").write.mode("overwrite").parquet(f"{folder}/signatures")


def report(scan: Scan, config: Config = DEFAULT) -> DataFrame:
    """One row with one JSON document, the form that one reader takes whole; its size is that of the result."""
    located = scan.located().groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("file_index", "marketplace", "plugin", F.col("path"), "is_official"))).alias("locations"))
    pairs = scan.raw_pairs.withColumn("similarity", F.bround("similarity", 3)).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("file1_index", "file2_index", "similarity"))).alias("similarity_pairs"))
    clusters = scan.clusters().join(located, "cluster_id").join(pairs, "cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("_"), "cluster_id", "type", "size", "avg_similarity", "has_official", "marketplaces", "locations", "similarity_pairs"))).alias("c"))
    clusters = clusters.select(F.transform("c", lambda c: c.dropFields("_")).alias("clusters"))
    files = scan.file_index().agg(F.sort_array(F.collect_list(F.struct("file_index", "marketplace", "plugin", "path", "filename", "is_official", "cluster_id", "in_cluster"))).alias("file_index"))
    index = lambda df, key, name: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "cluster_ids")))).alias(name))
    kinds = scan.by_type().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", F.struct("clusters", "files"))))).alias("by_type"))
    total = scan.summary().crossJoin(kinds).select(F.struct("*").alias("summary"), "confidence", "warnings")
    one = total.crossJoin(files).crossJoin(index(scan.marketplace_index(), "marketplace", "marketplace_index")).crossJoin(index(scan.filename_index(), "filename", "filename_index")).crossJoin(clusters)
    meta = F.struct(F.lit("2.0").alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.lit(config.threshold).alias("similarity_threshold"), F.lit(config.slots).alias("num_permutations"), "confidence", "warnings")
    return one.select(F.to_json(F.struct(meta.alias("metadata"), "summary", "file_index", "marketplace_index", "filename_index", "clusters"), {"ignoreNullFields": "false"}).alias("value"))


def capability_report(capabilities: DataFrame) -> DataFrame:
    one = capabilities.agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "skill").alias("skills"), F.count_if(F.col("kind") == "agent").alias("agents"), F.sort_array(F.collect_list(F.struct("marketplace", "path", "name", "kind", "description", "plugin", "triggers"))).alias("capabilities"))
    return one.select(F.to_json(F.struct(F.struct("total", "skills", "agents").alias("metadata"), "capabilities")).alias("value"))


#: The manifest's name (a fixed value).
MANIFEST = ".corpuslens-checkout.json"


def checkout(source: str, destination: str, keep_folders: bool = True) -> dict:
    """Copies a skill (a file or a folder) on this machine and writes a manifest beside it: the front matter of the file, or of the
    folder's ``SKILL.md``, and under ``_checkout`` source, time and number of files. Hidden parts are skipped and nothing is
    written outside the destination; without folders, a name that is there already is skipped. What can't be copied ends the
    checkout with a message, not an error."""
    src, dst = Path(source), Path(destination).resolve()
    copied: list[str] = []
    about: dict = {}
    outcome = {"target_path": str(dst), "files_copied": copied, "metadata": about}
    if not src.exists():
        return outcome | {"success": False, "message": f"not found: {source}"}
    try:
        base = src if src.is_dir() else src.parent
        for f in sorted(src.rglob("*")) if src.is_dir() else [src]:
            part = f.relative_to(base)
            if not f.is_file() or any(x.startswith(".") for x in part.parts):
                continue
            to = dst / (part if keep_folders else part.name)
            if not to.resolve().is_relative_to(dst) or (src.is_dir() and not keep_folders and to.exists()):
                continue
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(f, to)
            copied.append(str(part if keep_folders else part.name))
        head = src / "SKILL.md" if src.is_dir() else src
        if head.suffix == ".md" and head.is_file():
            about |= front_matter_of(head.read_text("utf-8", "replace"))
        about["_checkout"] = {"source": str(src), "timestamp": datetime.now(UTC).isoformat(), "files_copied": len(copied)}
        dst.mkdir(parents=True, exist_ok=True)
        (dst / MANIFEST).write_text(json.dumps(about, indent=2, default=str))
    except OSError as e:
        return outcome | {"success": False, "message": f"copied {len(copied)} files, then: {e}"}
    return outcome | {"success": True, "message": f"copied {len(copied)} files"}
