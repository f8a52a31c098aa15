"""The engine's queries over the shared tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import kernels
from .functions import text as T
from .functions.pandas_udfs import front_matter
from .operators import compare, diffing, index, similarity
from .plans.scan import Scan, documents_as_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = replace(DEFAULT, official_prefixes=("src1",))


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scan(spark: SparkSession, sf_dir: str, banded: bool = False) -> Scan:
    return Scan(documents_as_files(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), CONFIG, banded)


def _sets(table: str, key: str, condition: str = "true", least: int = 100) -> str:
    """SQL: ``i`` and the shingle set ``sh`` of each text."""
    return rf"""
    SELECT i, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
                   WHEN len(w) > 0 THEN list_distinct(w)
                   WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda k: substr(t, k::BIGINT, 3)))
                   WHEN length(t) > 0 THEN [t] ELSE [] END AS sh
    FROM (SELECT i, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w
          FROM (SELECT {key} AS i, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^a-z0-9 -]', '', 'g') AS t FROM {table} WHERE length(text) >= {least} AND {condition}))"""


_BASE = f"""
WITH RECURSIVE sets AS MATERIALIZED ({_sets('documents', 'doc_id')}),
ex AS MATERIALIZED (SELECT i, unnest(sh) AS s FROM sets),
sizes AS (SELECT i, len(sh) AS n FROM sets),
met AS (SELECT a.i AS i, b.i AS j, count(*) AS k FROM ex a JOIN ex b ON a.s = b.s AND a.i < b.i GROUP BY ALL),
edges AS MATERIALIZED (SELECT met.i, met.j, k / (x.n + y.n - k)::DOUBLE AS jaccard FROM met JOIN sizes x ON x.i = met.i JOIN sizes y ON y.i = met.j WHERE k / (x.n + y.n - k)::DOUBLE >= 0.7)
"""
_STARS = """,
adj AS MATERIALIZED (SELECT a, list(b) AS nb FROM (SELECT i AS a, j AS b FROM edges UNION ALL SELECT j, i FROM edges) GROUP BY a),
seed AS (SELECT [min(a)] AS s FROM adj UNION ALL
         SELECT any_value(list_append(s, n)) FROM (SELECT s, min(a) AS n FROM seed, adj WHERE a > s[-1] AND NOT list_has_any(nb, s) GROUP BY s) WHERE n IS NOT NULL HAVING count(*) > 0),
chosen AS (SELECT x AS seed, row_number() OVER (ORDER BY x) - 1 AS cluster_id FROM (SELECT unnest(s) AS x FROM (SELECT s FROM seed ORDER BY len(s) DESC LIMIT 1)) WHERE x IS NOT NULL),
members AS MATERIALIZED (SELECT cluster_id, seed AS i FROM chosen UNION ALL SELECT cluster_id, unnest(nb) FROM chosen JOIN adj ON a = seed),
files AS MATERIALIZED (SELECT doc_id AS i, source AS marketplace, lang AS plugin, 'doc_' || doc_id || '.md' AS filename, starts_with(source, 'src1') AS official FROM documents WHERE length(text) >= 100),
"""
_EXACT_PAIRS = """pairs AS MATERIALIZED (SELECT a.cluster_id, a.i AS file1_index, b.i AS file2_index, len(list_intersect(x.sh, y.sh)) / (len(x.sh) + len(y.sh) - len(list_intersect(x.sh, y.sh)))::DOUBLE AS sim
          FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.i < b.i JOIN sets x ON x.i = a.i JOIN sets y ON y.i = b.i),
"""
_ROLLUP = """clusters AS MATERIALIZED (SELECT cluster_id, CASE WHEN len(marketplaces) > 1 THEN 'cross-marketplace' WHEN size >= 5 AND mean >= 0.98 THEN 'scaffold' ELSE 'internal' END AS type, size, round_even(mean, 3)::DOUBLE AS avg_similarity, has_official, marketplaces
          FROM (SELECT cluster_id, count(*) AS size, bool_or(official) AS has_official, list_sort(list(DISTINCT marketplace)) AS marketplaces FROM members JOIN files USING (i) GROUP BY cluster_id) JOIN (SELECT cluster_id, avg(sim) AS mean FROM pairs GROUP BY cluster_id) USING (cluster_id))
"""
_CLUSTERS = _BASE + _STARS + _EXACT_PAIRS + _ROLLUP


@_query(f"SELECT i AS doc_id, len(sh)::BIGINT AS n_shingles FROM ({_sets('documents', 'doc_id')})")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).sets.select(F.col("file_index").alias("doc_id"), F.size("sh").cast("long").alias("n_shingles"))


@_query(_BASE + "SELECT i, j, jaccard FROM edges")
def similar_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(_scan(spark, sf_dir).sets)


@_query(_CLUSTERS + "SELECT cluster_id, type, size, avg_similarity, has_official, marketplaces FROM clusters")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).clusters()


@_query(_CLUSTERS.replace("source AS marketplace, lang AS plugin", "lang AS marketplace, lang AS plugin").replace("starts_with(source, 'src1')", "starts_with(lang, 'src1')") + "SELECT cluster_id, type, size, avg_similarity, has_official, marketplaces FROM clusters")
def cluster_summary_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("lang").alias("source"))
    return Scan(documents_as_files(docs), CONFIG).clusters()


@_query(_CLUSTERS + "SELECT cluster_id, i AS file_index FROM members")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).members


@_query(_CLUSTERS + "SELECT cluster_id, file1_index, file2_index, round_even(sim, 3)::DOUBLE AS similarity FROM pairs")
def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).cluster_pairs()


@_query(_CLUSTERS + "SELECT i AS file_index, marketplace, plugin, filename AS path, filename, official AS is_official, cluster_id, cluster_id IS NOT NULL AS in_cluster FROM files LEFT JOIN (SELECT i, max(cluster_id) AS cluster_id FROM members GROUP BY i) USING (i)")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).file_index()


@_query(_CLUSTERS + "SELECT marketplace, list_sort(list(DISTINCT cluster_id)) AS cluster_ids FROM members JOIN files USING (i) GROUP BY marketplace")
def marketplace_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).marketplace_index()


@_query(_CLUSTERS + "SELECT filename, list_sort(list(DISTINCT cluster_id)) AS cluster_ids FROM members JOIN files USING (i) GROUP BY filename")
def filename_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).filename_index()


_SANITY = """CASE WHEN t = 0 THEN 'none' WHEN c > 1000 AND r = 0 THEN 'low' WHEN t > 500 AND (r / t::DOUBLE < 0.05 OR r / t::DOUBLE > 0.95) THEN 'medium'
      WHEN t > 100 AND n / t::DOUBLE BETWEEN 0.48 AND 0.52 AND r / t::DOUBLE BETWEEN 0.48 AND 0.52 THEN 'medium' ELSE 'high' END AS confidence"""


@_query(
    _CLUSTERS
    + f"""SELECT t AS total_files_scanned, r AS files_in_clusters, d AS distinct_files_in_clusters, c AS unique_clusters, m AS unique_marketplaces, n AS unclustered_files, {_SANITY}
FROM (SELECT *, t - r AS n FROM (SELECT (SELECT count(*) FROM files) AS t, (SELECT count(*) FROM members) AS r, (SELECT count(DISTINCT i) FROM members) AS d, (SELECT count(*) FROM clusters) AS c, (SELECT count(DISTINCT marketplace) FROM members JOIN files USING (i)) AS m))"""
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).summary().drop("warnings")


@_query(_CLUSTERS + "SELECT type, count(c.cluster_id) AS clusters, coalesce(sum(size), 0)::BIGINT AS files FROM (VALUES ('cross-marketplace'), ('internal'), ('scaffold')) AS k(type) LEFT JOIN clusters c USING (type) GROUP BY type")
def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).by_type()


@_query(_CLUSTERS + "SELECT cluster_id, file1_index, file2_index, round_even(sim, 3)::DOUBLE AS similarity FROM pairs ORDER BY 4 DESC, 1, 2, 3 LIMIT 10")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).cluster_pairs().orderBy(F.desc("similarity"), "cluster_id", "file1_index", "file2_index").limit(10)


@_query(_CLUSTERS + "SELECT size, count(*) AS clusters FROM clusters GROUP BY size")
def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).clusters().groupBy("size").agg(F.count("*").alias("clusters"))


@_query(_CLUSTERS + "SELECT i AS file_index, marketplace, filename FROM files WHERE i NOT IN (SELECT i FROM members)")
def unclustered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).file_index().where("not in_cluster").select("file_index", "marketplace", "filename")


@_query("SELECT source AS marketplace, count(*) AS files FROM documents WHERE length(text) >= 100 GROUP BY source")
def files_per_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).files.groupBy("marketplace").agg(F.count("*").alias("files"))


@_query(_CLUSTERS + "SELECT round_even(100.0 * (SELECT count(DISTINCT i) FROM members) / (SELECT count(*) FROM files), 1)::DOUBLE AS duplication_percent")
def duplication_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = 100.0 * F.col("distinct_files_in_clusters") / F.col("total_files_scanned")
    return _scan(spark, sf_dir).summary().select(F.bround(share, 1).alias("duplication_percent"))


@_query(_CLUSTERS + "SELECT cluster_id, type, marketplace, filename FROM members JOIN files USING (i) JOIN clusters USING (cluster_id) WHERE filename = (SELECT min(filename) FROM files JOIN members USING (i))")
def where_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _scan(spark, sf_dir)
    located = scan.located().join(scan.clusters().select("cluster_id", "type"), "cluster_id")
    name = located.agg(F.min("filename")).first()[0]
    return index.where(located, name or "none").select("cluster_id", "type", "marketplace", "filename")


@_query(_CLUSTERS + "SELECT cluster_id, marketplace, filename FROM members JOIN files USING (i) WHERE regexp_full_match(filename, 'doc_[1-4].*5[.]md')")
def where_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.where(_scan(spark, sf_dir).located(), "doc_[1-4]*5.md").select("cluster_id", "marketplace", "filename")


@_query(_CLUSTERS + "SELECT filename, count(DISTINCT cluster_id) AS clusters FROM members JOIN files USING (i) GROUP BY filename ORDER BY 2 DESC, 1 LIMIT 10")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.filename_counts(_scan(spark, sf_dir).located())


@_query(_CLUSTERS + "SELECT cluster_id, size FROM clusters WHERE has_official")
def official_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).clusters().where("has_official").select("cluster_id", "size")


_MATRIX = _CLUSTERS + """,
own AS (SELECT DISTINCT marketplace, cluster_id FROM members JOIN files USING (i)), n AS (SELECT marketplace, count(*) AS n FROM own GROUP BY ALL),
matrix AS (SELECT a.marketplace AS mp_a, b.marketplace AS mp_b, round_even(k / (a.n + b.n - k)::DOUBLE, 3)::DOUBLE AS similarity
           FROM (SELECT a.marketplace, b.marketplace AS other, count(CASE WHEN x.cluster_id IS NOT NULL THEN 1 END) AS k FROM n a, n b LEFT JOIN (SELECT p.marketplace AS m, q.marketplace AS o, p.cluster_id FROM own p JOIN own q USING (cluster_id)) x ON x.m = a.marketplace AND x.o = b.marketplace GROUP BY ALL) z
           JOIN n a ON a.marketplace = z.marketplace JOIN n b ON b.marketplace = z.other)
"""


@_query(_MATRIX + "SELECT * FROM matrix")
def marketplace_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.overlap_matrix(_scan(spark, sf_dir).located())


@_query(_MATRIX + "SELECT * FROM matrix WHERE mp_a < mp_b AND similarity > 0 ORDER BY similarity DESC, mp_a, mp_b LIMIT 20")
def marketplace_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.top_overlaps(index.overlap_matrix(_scan(spark, sf_dir).located()))


@_query(_CLUSTERS + "SELECT marketplace, count(*) AS files, count(DISTINCT cluster_id) AS clusters FROM members JOIN files USING (i) GROUP BY marketplace")
def marketplace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.collection_counts(_scan(spark, sf_dir).located())


_HEAT = ", ".join(f"coalesce(max(CASE WHEN y.place = {k} THEN CASE WHEN similarity >= 0.8 THEN '█' WHEN similarity >= 0.5 THEN '▓' WHEN similarity >= 0.2 THEN '▒' WHEN similarity > 0 THEN '░' ELSE '·' END END), ' ') AS c{k}" for k in range(1, 13))


@_query(_MATRIX + f""", head AS (SELECT marketplace, row_number() OVER (ORDER BY marketplace) AS place FROM n ORDER BY marketplace LIMIT 12)
SELECT x.place, x.marketplace, {_HEAT} FROM head x JOIN matrix ON mp_a = x.marketplace JOIN head y ON mp_b = y.marketplace GROUP BY x.place, x.marketplace""")
def marketplace_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.heat_map(_scan(spark, sf_dir).located())


#: Two sides: collections with an odd and with an even number.
_ODD = "cast(substr(source, 4) AS INT) % 2 = 1"
_SIDES = _BASE + f""",
side AS (SELECT doc_id AS i, {_ODD} AS odd FROM documents),
ab AS (SELECT CASE WHEN x.odd THEN e.j ELSE e.i END AS a, CASE WHEN x.odd THEN e.i ELSE e.j END AS b, jaccard FROM edges e JOIN side x ON x.i = e.i JOIN side y ON y.i = e.j WHERE x.odd <> y.odd),
best AS (SELECT b, max(jaccard) AS s, min_by(a, (-jaccard, a)) AS a FROM ab GROUP BY b),
target AS (SELECT i FROM sets JOIN side USING (i) WHERE odd AND len(sh) > 0), base AS (SELECT i FROM sets JOIN side USING (i) WHERE NOT odd AND len(sh) > 0),
matches AS (SELECT i AS file_index, CASE WHEN s >= 0.9 THEN 'redundant' WHEN s >= 0.7 THEN 'partial' ELSE 'novel' END AS status, round_even(s, 2)::DOUBLE AS similarity, a AS similar_to FROM target LEFT JOIN best ON b = i)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Shingle sets of the odd (target) and the even (baseline) collections."""
    files, odd = _scan(spark, sf_dir).files, F.substring("marketplace", 4, 9).cast("int") % 2 == 1
    target, base = (similarity.with_shingles(files.where(side)) for side in (odd, ~odd))
    return target, base


@_query(_SIDES + "SELECT * FROM matches")
def compare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.best_matches(*_sides(spark, sf_dir))


_COUNTS = "SELECT count(*) AS t, count_if(status = 'novel') AS n, count_if(status = 'partial') AS p, count_if(status = 'redundant') AS r, 0 AS c FROM matches"


@_query(_SIDES + f"SELECT t AS total, n AS novel, p AS partial, r AS redundant, {_SANITY}, CASE WHEN r / t::DOUBLE > 0.5 THEN 'high' WHEN r / t::DOUBLE > 0.2 THEN 'some' ELSE 'low' END AS verdict FROM ({_COUNTS})")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.totals(compare.best_matches(*_sides(spark, sf_dir))).select("total", "novel", "partial", "redundant", "confidence", "verdict")


_WARNED = """list_filter([CASE WHEN t = 0 THEN 'no files' END, CASE WHEN t > 0 AND c > 1000 AND r = 0 THEN 'zero membership' END, CASE WHEN t > 500 AND r / t::DOUBLE < 0.05 THEN 'low ratio' END,
      CASE WHEN t > 500 AND r / t::DOUBLE > 0.95 THEN 'high ratio' END, CASE WHEN t > 100 AND n / t::DOUBLE BETWEEN 0.48 AND 0.52 AND r / t::DOUBLE BETWEEN 0.48 AND 0.52 THEN 'even split' END], lambda x: x IS NOT NULL) AS warnings"""


@_query(_SIDES.replace(_ODD, "source <> 'src1'") + f"SELECT t AS total, n AS novel, p AS partial, r AS redundant, {_SANITY}, {_WARNED} FROM ({_COUNTS.replace('0 AS c', '(SELECT count(*) FROM edges) + 1000 AS c')})")
def compare_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection against all others, with the number of known clusters told from outside."""
    files, mine = _scan(spark, sf_dir).files, F.col("marketplace") == "src1"
    base, target = (similarity.with_shingles(files.where(side)) for side in (mine, ~mine))
    known = similarity.count_pairs(similarity.with_shingles(files.where("marketplace is not null"))) + 1000
    matches = compare.best_matches(target, base)
    return compare.totals(matches, known).select("total", "novel", "partial", "redundant", "confidence", "warnings")


@_query(_SIDES + f"SELECT t AS total, r AS redundant, n + p AS impact_novel, CASE WHEN r / t::DOUBLE > 0.5 THEN 'high' WHEN n + p > r THEN 'mostly new' ELSE 'mixed' END AS impact FROM ({_COUNTS})")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.totals(compare.best_matches(*_sides(spark, sf_dir))).select("total", "redundant", "impact_novel", "impact")


@_query(
    _SIDES
    + """SELECT ta AS total_a, tb AS total_b, k AS shared, ka AS shared_a, ta - ka AS unique_a, tb - k AS unique_b, round_even(100.0 * k / ta, 1)::DOUBLE AS overlap_a, round_even(100.0 * k / tb, 1)::DOUBLE AS overlap_b,
CASE WHEN ta = 0 OR tb = 0 THEN 'empty' WHEN k = 0 THEN 'disjoint' WHEN k = tb AND ka = ta THEN 'identical' ELSE 'partial' END AS verdict
FROM (SELECT (SELECT count(*) FROM base) AS ta, (SELECT count(*) FROM target) AS tb, (SELECT count(*) FROM best) AS k, (SELECT count(DISTINCT a) FROM best) AS ka)"""
)
def compare_marketplaces_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = _sides(spark, sf_dir)
    return compare.venn(base, target)


@_query(_SIDES + "SELECT file_index, similarity, similar_to FROM matches WHERE similar_to IS NOT NULL ORDER BY similarity DESC, file_index LIMIT 10")
def overlap_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.best_matches(*_sides(spark, sf_dir)).where("similar_to is not null")
    return rows.select("file_index", "similarity", "similar_to").orderBy(F.desc("similarity"), "file_index").limit(10)


@_query(_SIDES + "SELECT i AS file_index FROM target WHERE i IN (SELECT b FROM ab)")
def shared_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = _sides(spark, sf_dir)
    pairs = similarity.best_pairs(base, target, CONFIG.threshold)
    return similarity.indexed(target).join(pairs, F.col("file_index") == F.col("j"), "left_semi")


@_query(_SIDES + "SELECT i AS file_index FROM target WHERE i NOT IN (SELECT b FROM ab)")
def novel_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = _sides(spark, sf_dir)
    pairs = similarity.best_pairs(base, target, CONFIG.threshold)
    return similarity.indexed(target).join(pairs, F.col("file_index") == F.col("j"), "left_anti")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("triggers"), F.when(F.col("p_size") % 2 == 0, "skill").otherwise("agent").alias("kind"), F.col("p_brand").alias("marketplace"))


_FIND = """SELECT p_partkey AS ord, p_name AS name, p_brand AS marketplace,
(CASE WHEN contains(lower(p_name), q) THEN 10.0 WHEN list_bool_or(list_transform(w, lambda x: contains(lower(p_name), x))) THEN 5.0 ELSE 0.0 END
+ CASE WHEN contains(lower(p_type), q) THEN 5.0 ELSE 2.0 * len(list_filter(w, lambda x: contains(lower(p_type), x))) END
+ CASE WHEN contains(lower(p_brand), q) THEN 3.0 WHEN list_bool_or(list_transform(w, lambda x: contains(lower(p_brand), x))) THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM part, (SELECT 'small plated brand#1' AS q, ['small', 'plated', 'brand#1'] AS w)"""


@_query(f"SELECT * FROM ({_FIND}) WHERE score > 0 ORDER BY score DESC, ord LIMIT 30")
def find_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.find(_parts(spark, sf_dir), "Small PLATED Brand#1").select("ord", "name", "marketplace", "score")


@_query(f"SELECT marketplace, list(name ORDER BY score DESC, ord) AS names FROM (SELECT * FROM ({_FIND}) WHERE score > 0 ORDER BY score DESC, ord LIMIT 30) GROUP BY marketplace")
def find_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.grouped(index.find(_parts(spark, sf_dir), "Small PLATED Brand#1"))


@_query("SELECT CASE WHEN p_size % 2 = 0 THEN 'skill' ELSE 'agent' END AS kind, count(*) AS capabilities FROM part GROUP BY ALL")
def capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.capability_totals(_parts(spark, sf_dir))


@_query("SELECT p_brand AS marketplace, count(*) AS plugins, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY p_brand")
def installed_by_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.installed_groups(_parts(spark, sf_dir))


#: Texts for analytics: turns of conversations.
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = rf"CASE WHEN text = '' THEN [] ELSE (SELECT CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END FROM (SELECT regexp_split_to_array(text, '{_BREAK}') AS l)) END"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''))::BIGINT"
_TOOLS = "list_filter([" + ", ".join(f"'{t}'" for t in T.TOOLS) + r"], lambda t: regexp_matches(text, '(?i)\b' || t || '\b'))"
_METRICS = f"SELECT conv_id, turn, len({_LINES})::BIGINT AS line_count, {_WORDS} AS word_count, len({_TOOLS})::BIGINT AS tools FROM conversations"


@_query(_METRICS)
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(T.lines(c)).cast("long").alias("line_count"), T.word_count(c).alias("word_count"), F.size(T.tools(c)).cast("long").alias("tools"))


@_query(f"SELECT conv_id, turn, {_TOOLS} AS tool_uses FROM conversations")
def tool_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.tools(F.col("text")).alias("tool_uses"))


@_query("SELECT conv_id, turn, list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')[:3]" for p in T.TRIGGERS[:2]) + f"), regexp_extract_all(text, '{T.TRIGGERS[2]}')[:3]) AS triggers FROM conversations")
def trigger_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.triggers(F.col("text")).alias("triggers"))


@_query("SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', 1)[:5]" for p in T.DEPENDENCIES[:2]) + f"), regexp_extract_all(text, '{T.DEPENDENCIES[2]}', 1)[:5]), lambda x: lower(x) NOT IN ('the', 'a', 'an', 'to', 'be')))) AS dependencies FROM conversations")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.dependencies(F.col("text")).alias("dependencies"))


@_query(f"SELECT CASE WHEN line_count > 200 OR word_count > 1500 OR tools > 5 THEN 'high' WHEN line_count > 80 OR word_count > 600 OR tools > 2 THEN 'medium' ELSE 'low' END AS complexity, count(*) AS texts FROM ({_METRICS.replace('conv_id, turn, ', '').replace('conversations', 'documents')}) GROUP BY ALL")
def complexity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    rows = _table(spark, sf_dir, "documents").select(F.size(T.lines(c)).alias("l"), T.word_count(c).alias("w"), F.size(T.tools(c)).alias("t"))
    return rows.groupBy(T.complexity(F.col("l"), F.col("w"), F.col("t")).alias("complexity")).agg(F.count("*").alias("texts"))


_HASH = "('0x' || substr(md5({x}), 1, 7))::BIGINT"
_SIGS = f"""
WITH sets AS ({_sets('documents', 'doc_id')}),
h AS MATERIALIZED (SELECT i, {_HASH.format(x='s')} AS h FROM (SELECT i, unnest(sh) AS s FROM sets)),
p AS (SELECT k, {_HASH.format(x="'a' || k")} + 1 AS a, {_HASH.format(x="'b' || k")} AS b FROM range(128) AS r(k)),
slot AS (SELECT i, k, min((a * h + b) % 2147483647) AS v FROM h, p GROUP BY i, k),
sig AS MATERIALIZED (SELECT i, list(v ORDER BY k) AS sig FROM slot GROUP BY i)
"""
_BANDED = _SIGS + """, bands AS MATERIALIZED (SELECT i, k, array_to_string(sig[k * 5 + 1:k * 5 + 5], ',') AS v FROM sig, range(25) AS r(k)),
met AS (SELECT DISTINCT a.i AS i, b.i AS j FROM bands a JOIN bands b ON a.k = b.k AND a.v = b.v AND a.i < b.i),
est AS (SELECT met.i, met.j, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS estimate FROM met JOIN sig x ON x.i = met.i JOIN sig y ON y.i = met.j)
"""


@_query(_SIGS + "SELECT i AS file_index, sig FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.signatures(_scan(spark, sf_dir).files, CONFIG)


@_query(_BANDED + "SELECT i, j, estimate FROM est")
def similar_pairs_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.banded_pairs(kernels.signatures(_scan(spark, sf_dir).files, CONFIG))


@_query(_BANDED + "SELECT round_even(estimate, 3)::DOUBLE AS estimate, count(*) AS pairs FROM est GROUP BY 1")
def minhash_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.banded_pairs(kernels.signatures(_scan(spark, sf_dir).files, CONFIG))
    return pairs.groupBy(F.bround("estimate", 3).alias("estimate")).agg(F.count("*").alias("pairs"))


#: Clusters over candidates as they come: the edges are all banded pairs, similarities are estimates.
_BANDED_CLUSTERS = (
    _BANDED.replace("WITH sets", "WITH RECURSIVE sets", 1)
    + ", edges AS MATERIALIZED (SELECT i, j FROM est)"
    + _STARS
    + """pairs AS MATERIALIZED (SELECT a.cluster_id, a.i AS file1_index, b.i AS file2_index, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 128.0::DOUBLE AS sim
          FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.i < b.i JOIN sig x ON x.i = a.i JOIN sig y ON y.i = b.i),
"""
    + _ROLLUP
)


@_query(_BANDED_CLUSTERS + "SELECT cluster_id, type, size, avg_similarity, has_official, marketplaces FROM clusters")
def cluster_summary_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, banded=True).clusters()


@_query(_BANDED_CLUSTERS + "SELECT cluster_id, i AS file_index FROM members")
def cluster_members_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, banded=True).members


@_query(_BANDED_CLUSTERS + "SELECT cluster_id, file1_index, file2_index, round_even(sim, 3)::DOUBLE AS similarity FROM pairs")
def cluster_pairs_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, banded=True).cluster_pairs()


_BANDED_SIDES = _BANDED + f""",
side AS (SELECT doc_id AS i, {_ODD} AS odd FROM documents),
ab AS (SELECT CASE WHEN x.odd THEN e.j ELSE e.i END AS a, CASE WHEN x.odd THEN e.i ELSE e.j END AS b, estimate FROM est e JOIN side x ON x.i = e.i JOIN side y ON y.i = e.j WHERE x.odd <> y.odd),
best AS (SELECT b, max(estimate) AS s, min_by(a, (-estimate, a)) AS a FROM ab GROUP BY b),
target AS (SELECT i FROM sig JOIN side USING (i) WHERE odd), base AS (SELECT i FROM sig JOIN side USING (i) WHERE NOT odd)
"""


def _signed_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signatures of the odd (target) and the even (baseline) collections."""
    files, odd = _scan(spark, sf_dir).files, F.substring("marketplace", 4, 9).cast("int") % 2 == 1
    sides = (files.where(odd), files.where(~odd))
    return tuple(kernels.signatures(x, CONFIG, raw=True) for x in sides)


_VENN = """SELECT ta AS total_a, tb AS total_b, k AS shared, ka AS shared_a, ta - ka AS unique_a, tb - k AS unique_b, round_even(100.0 * k / ta, 1)::DOUBLE AS overlap_a, round_even(100.0 * k / tb, 1)::DOUBLE AS overlap_b,
CASE WHEN ta = 0 OR tb = 0 THEN 'empty' WHEN k = 0 THEN 'disjoint' WHEN k = tb AND ka = ta THEN 'identical' ELSE 'partial' END AS verdict
FROM (SELECT (SELECT count(*) FROM base) AS ta, (SELECT count(*) FROM target) AS tb, (SELECT count(*) FROM best) AS k, (SELECT count(DISTINCT a) FROM best) AS ka)"""


@_query(_BANDED_SIDES + _VENN)
def venn_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = _signed_sides(spark, sf_dir)
    return compare.venn(base, target, CONFIG, banded=True)


@_query(_BANDED_SIDES + "SELECT i AS file_index, CASE WHEN s >= 0.9 THEN 'redundant' WHEN s >= 0.7 THEN 'partial' ELSE 'novel' END AS status, CASE WHEN s >= 0.7 THEN round_even(s, 2)::DOUBLE END AS similarity, CASE WHEN s >= 0.7 THEN a END AS similar_to FROM target LEFT JOIN best ON b = i")
def compare_files_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = _signed_sides(spark, sf_dir)
    return compare.best_matches(target, base, CONFIG, banded=True)


_NORMAL = rf"""list_transform({_LINES}, lambda x: CASE WHEN trim(x, chr(32) || chr(9)) = '' THEN '' ELSE repeat(' ', (length(replace(x[:length(x) - length(ltrim(x, chr(32) || chr(9)))], chr(9), '    ')) // 4)::BIGINT) || trim(x, chr(32) || chr(9)) END)"""


@_query(f"SELECT page_id, {_NORMAL} AS lines FROM (SELECT page_id, html AS text FROM pages)")
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.normalized_lines(F.col("html")).alias("lines"))


@_query(rf"SELECT page_id, list_sort(list_distinct(list_filter(list_transform({_NORMAL}, lambda y: regexp_extract(y, '^\s*(?:def|class|function|const|let|var)\s+([\pL\pN_]+)', 1)), lambda d: d <> ''))) AS names FROM (SELECT page_id, replace(html, '<', chr(10)) AS text FROM pages)")
def definition_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.definitions(T.normalized_lines(F.replace("html", F.lit("<"), F.lit("\n")))).alias("names"))


@_query()
def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _scan(spark, sf_dir)
    return diffing.diff_pairs(similarity.similar_pairs(scan.sets, CONFIG.threshold).select("i", "j"), scan.files)


@_query()
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("---\nname: "), F.col("source"), F.lit("\ndescription: ["), F.col("lang"), F.lit(", text]\n---\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", front_matter(head).alias("frontmatter"))
