"""Looking up plugins and skills by what a user writes: a spec becomes ranked candidate paths, which are joined with the paths that
exist, and the first by rank is taken. A collection's name counts with its case if it exists so, else without."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDERS = ("skills", "agents")


def collection_name(files: DataFrame, name: str) -> str | None:
    """The collection that a name means."""
    own = files.where(F.lower("marketplace") == name.lower()).select("marketplace").distinct()
    found = own.orderBy(F.col("marketplace") != name, "marketplace").first()
    return found[0] if found else None


def places(files: DataFrame) -> DataFrame:
    """``marketplace, path, is_file, key``: every file and every folder above one. ``key`` is the path, and for what lies in a folder of
    ``plugins`` also the path with ``*`` for that folder."""
    parts = F.split("relative_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i == F.size(parts)).alias("is_file")))
    rows = files.select("marketplace", F.explode(up).alias("p")).select("marketplace", "p.path", "p.is_file").distinct()
    starred = F.regexp_replace("path", "^plugins/[^/]+/", "plugins/*/")
    return rows.withColumn("key", F.explode(F.array_distinct(F.array("path", starred))))


def first_of(found: DataFrame, candidates: list[str], collection: str | None) -> DataFrame:
    """``marketplace, path, is_file`` of the first candidate that exists: in one collection, or in the first collection by name
    that has any."""
    spark = found.sparkSession
    ranked = spark.createDataFrame(list(zip(candidates, range(len(candidates)), strict=True)), "key string, rank int").dropDuplicates(["key"])
    rows = found if collection is None else found.where(F.col("marketplace") == collection)
    return rows.join(ranked, "key").orderBy("marketplace", "rank", "path").limit(1).select("marketplace", "path", "is_file")


def plugin_folder(files: DataFrame, collection: str, plugin: str) -> str | None:
    """The folder of a plugin: in the collection itself, in ``plugins``, or in a folder of that."""
    hit = first_of(places(files), [plugin, f"plugins/{plugin}", f"plugins/*/{plugin}"], collection).first()
    return hit.path if hit else None


def skill_to_copy(files: DataFrame, spec: str) -> DataFrame:
    """``marketplace, path, is_file`` of the skill or agent that ``name``, ``collection/name`` or ``collection/plugin/name`` means: in
    ``skills`` before ``agents``, a folder before a file of that name."""
    parts = spec.strip("/").split("/")
    nothing = places(files).where("false").select("marketplace", "path", "is_file")
    collection = None
    if len(parts) > 1:
        collection = collection_name(files, parts[0])
        if collection is None:
            return nothing
    base, name = "", parts[-1]
    if len(parts) > 2:
        folder = plugin_folder(files, collection, parts[1])
        if folder is None:
            return nothing
        base, name = f"{folder}/", "/".join(parts[2:])
    own = files.where(~F.col("marketplace").startswith("."))
    return first_of(places(own), [f"{base}{f}/{name}{end}" for f in FOLDERS for end in ("", ".md")], collection)


def skill_file(files: DataFrame, spec: str) -> DataFrame:
    """The file that describes a skill, at most one row: a full path; a file of that name (in any case) below a folder with
    ``skills`` or ``agents`` in its path; for three parts and more the path below the collection or its ``plugins``, then the plugin's
    skills and agents, then any file of that name in the plugin."""
    direct = files.where(F.col("full_path") == spec)
    if spec.endswith(".md") and direct.head(1):
        return direct.limit(1)
    parts = spec.strip("/").split("/")
    stem = F.lower(F.regexp_replace(F.substring_index("relative_path", "/", -1), r"\.md$", ""))
    order = ["marketplace", "relative_path"]
    collection = collection_name(files, parts[0]) if len(parts) > 1 else None
    if len(parts) > 1 and collection is None:
        return files.where("false")
    own = files.where(~F.col("marketplace").startswith(".")) if collection is None else files.where(F.col("marketplace") == collection)
    if len(parts) > 2:
        last, rest = parts[-1].removesuffix(".md") + ".md", "/".join(parts[1:]).removesuffix(".md") + ".md"
        hit = first_of(places(own).where("is_file"), [rest, f"plugins/{rest}", *(f"plugins/{parts[1]}/{f}/{last}" for f in FOLDERS)], collection).first()
        if hit:
            return own.where(F.col("relative_path") == hit.path)
        folder = plugin_folder(own, collection, parts[1])
        named = own.where("false") if folder is None else own.where(F.col("relative_path").startswith(f"{folder}/") & (stem == last.removesuffix(".md").lower()))
    else:
        held = F.contains("relative_path", F.lit("skills")) | F.contains("relative_path", F.lit("agents"))
        named = own.where(held & (stem == parts[-1].lower()))
    return named.orderBy(*order).limit(1)
