"""The engine's operators on hand-made cases and against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpuslens import cli
from corpuslens.functions import text as T
from corpuslens.functions.pandas_udfs import front_matter_of
from corpuslens.operators import clustering, compare, diffing, index, similarity
from corpuslens.plans.scan import Scan
from corpuslens.sinks import exports
from corpuslens.sources import files as source


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("One, two THREE four", {"one two three", "two three four"}), ("a b", {"a", "b"}), ("", set()), ("! ! ! !", {"   "}), ("é", set()), ("x-y   z", {"x-y", "z"}), ("a\xa0b\x1cc", {"a b c"}), ("-", {"-"})],
)
def test_shingles(spark, text, want):
    assert set(one(spark, text, T.shingles)) == want


def test_text_functions(spark):
    text = "Use this skill when testing. Triggered by x. Use for y.\nIt requires Python and depends on the tool. Needs access to bash, Read and WebFetch"
    assert one(spark, text, T.tools) == ["Bash", "Read", "WebFetch"]
    assert one(spark, text, T.triggers) == ["Use this skill when testing.", "Triggered by x.", "Use for y."]
    assert one(spark, text, T.dependencies) == ["Python", "access"]
    for s in ("", "a", "a\n", "a\r\nb\x85c d\n\n", "\n"):
        assert one(spark, s, T.lines) == s.splitlines()
        assert one(spark, s, T.word_count) == len(s.split())
    assert one(spark, "def a:\n\tx  \n        y\n\n", T.normalized_lines) == ["def a:", " x", "  y", ""]
    assert [one(spark, p, T.plugin_of) for p in ("plugins/a/x.md", "b/x.md", "x.md", "c/plugins/d/e.md")] == ["a", "b", "root", "d"]
    assert [one(spark, p, T.name_of) for p in ("skills/pdf/SKILL.md", "agents/x.md")] == ["pdf", "x"]
    assert one(spark, "---\nname: x\n---\n# T\n- no\nA line.", T.description_of) == "A line."


def test_front_matter():
    assert front_matter_of("---\nname: a\nd: 2024-01-02\n---\nx")["name"] == "a"
    assert [front_matter_of(t) for t in (None, "x", "---\nname: a", "---\n: [\n---\n", "---\n- a\n---\n")] == [{}] * 5


def test_search_scores(spark):
    rows = spark.createDataFrame([("spreadsheet", "Work with Excel files", ["t"])], "n string, d string, t array<string>")
    score = lambda q: rows.select(T.search_score(F.lit(q), F.col("n"), F.col("d"), F.col("t"))).first()[0]
    assert [score(q) for q in ("spreadsheet", "sheet", "files Excel", "database")] == [10, 10, 4, 0]


@pytest.mark.parametrize(
    ("total", "novel", "redundant", "clusters", "want"),
    [(1000, 1000, 0, 1500, "low"), (600, 580, 20, 100, "medium"), (600, 20, 580, 0, "medium"), (200, 190, 10, 0, "high"), (1000, 700, 300, 500, "high"), (200, 100, 100, 0, "medium"), (0, 0, 0, 0, "none")],
)
def test_sanity(spark, total, novel, redundant, clusters, want):
    got = spark.range(1).select(compare.sanity(*map(F.lit, (total, novel, redundant, clusters))).alias("s")).first().s
    assert got.confidence == want and (bool(got.warnings) == (want != "high"))


@pytest.mark.parametrize(("edges", "want"), [([(0, 1), (1, 2)], [(0, 0), (0, 1), (1, 1), (1, 2)]), ([(0, 1), (0, 2), (1, 2)], [(0, 0), (0, 1), (0, 2)]), ([], [])])
def test_greedy_stars(spark, edges, want):
    frame = spark.createDataFrame(edges, "i long, j long")
    assert sorted((r.cluster_id, r.file_index) for r in clustering.members(frame).collect()) == want


def test_exact_join_is_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    sets = similarity.with_shingles(docs.select(F.col("doc_id").alias("file_index"), F.col("text").alias("content")))
    rows = [(r.file_index, set(r.sh)) for r in sets.collect()]
    for t in (0.3, 0.7):
        want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len(x & y) / len(x | y) >= t}
        assert {(r.i, r.j) for r in similarity.similar_pairs(sets, t).collect()} == want


def test_overlap_matrix(spark):
    rows = [("a", i) for i in range(3)] + [("b", i) for i in (1, 2, 3)] + [("c", 9)]
    got = {(r.mp_a, r.mp_b): r.similarity for r in index.overlap_matrix(spark.createDataFrame(rows, "marketplace string, cluster_id long")).collect()}
    assert got["a", "b"] == got["b", "a"] == 0.5 and got["a", "a"] == 1 and got["a", "c"] == 0


@pytest.fixture
def tree(tmp_path):
    text = "# Title\n\nUse this skill when you read a spreadsheet. " + " ".join(f"word{i}" for i in range(60))
    for p in ("one/plugins/p/skills/sheet/SKILL.md", "two/plugins/q/skills/sheet/SKILL.md", "two/agents/_x.md", "two/backup/y.md", ".hidden/z.md", "one/short.md"):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"short" if "short" in p else (text + ("" if "sheet" in p else " and " + " ".join(f"other{i}" for i in range(200)))).encode() + b"\xff")
    return tmp_path


def test_scan_report_and_search(spark, tree):
    files = source.scan(spark, str(tree / "root"))
    assert [(r.marketplace, r.plugin, r.relative_path) for r in files.orderBy("file_index").collect()] == [("one", "p", "plugins/p/skills/sheet/SKILL.md"), ("two", "agents", "agents/_x.md"), ("two", "q", "plugins/q/skills/sheet/SKILL.md")]
    scan = Scan(files)
    report = json.loads(exports.report(scan).first().value)
    assert report["summary"]["unique_clusters"] == 1 and report["clusters"][0]["type"] == "cross-marketplace" and report["marketplace_index"] == {"one": [0], "two": [0]}
    (tree / "report.json").write_text(json.dumps(report))
    v1 = {"clusters": [{"type": "internal", "size": 2, "locations": [{"marketplace": "m", "plugin": "p", "path": "a/b.md", "is_official": False}]}]}
    (tree / "v1.json").write_text(json.dumps(v1))
    assert source.report_locations(spark, str(tree / "report.json")).count() == 2
    assert source.report_locations(spark, str(tree / "v1.json")).first().filename == "b.md"
    assert index.where(scan.located(), "plugins/x/SKILL.md").count() == index.where(scan.located(), "SKILL.md").count() == 2 and index.where(scan.located(), "sk*").count() == 0 and index.where(scan.located(), "S?ILL*").count() == 2
    caps = source.capabilities(files)
    assert {(r.name, r.kind) for r in caps.collect()} == {("sheet", "skill"), ("_x", "agent")}
    assert cli.describe(source.find_file(files, "one/sheet")).first().triggers == ["Use this skill when you read a spreadsheet."]
    a, b = (similarity.with_shingles(source.baseline(files, m)) for m in ("one", "TWO"))
    v = compare.venn(a, b).first()
    assert (v.shared, v.unique_a, v.unique_b, v.verdict) == (1, 0, 1, "partial")
    with pytest.raises(ValueError, match="not found"):
        source.baseline(files, "three")
    diff = diffing.diff_pairs(spark.createDataFrame([(0, 1)], "i long, j long"), files).first()
    assert diff.unified_diff and diff.diff_lines >= 2 and "\033[" in diffing.terminal(diff.unified_diff)


def test_commands_read_the_saved_index(spark, tree, capsys):
    def run(*args):
        capsys.readouterr()
        code = cli.main(["--root", str(tree / "gone"), "--data", str(tree / "data"), "--installed-file", str(tree / "none.json"), *args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("where", "SKILL.md") == (1, [])  # no index yet
    assert cli.main(["--root", str(tree / "root"), "--data", str(tree / "data"), "scan"]) == 0
    # the folder of collections is gone, so nothing below can read a file
    code, places = run("where", "plugins/x/SKILL.md")
    assert code == 0 and {(r["marketplace"], r["path"], r["type"]) for r in places} == {("one", "plugins/p/skills/sheet/SKILL.md", "cross-marketplace"), ("two", "plugins/q/skills/sheet/SKILL.md", "cross-marketplace")}
    assert run("stats") == (0, [{"type": "cross-marketplace", "clusters": 1, "files": 2}, {"filename": "SKILL.md", "clusters": 1}])
    overlaps = [{"marketplace": "one", "files": 1, "clusters": 1}, {"marketplace": "two", "files": 1, "clusters": 1}, {"mp_a": "one", "mp_b": "two", "similarity": 1.0}]
    assert run("marketplace-level") == (0, overlaps)
    assert run("marketplace-level", "--report", str(tree / "data/report")) == (0, overlaps)
    assert [r["name"] for r in run("find", "sheet")[1]][0] == "sheet"


def test_installed_and_checkout(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"plugins": {"a@b@c": [{"installPath": "/x", "version": "1"}], "d": [{"installPath": " "}, {"installPath": "/y"}]}}))
    assert {(r.name, r.marketplace, r.version) for r in source.installed_plugins(spark, str(tmp_path / "i.json")).collect()} == {("a@b", "c", "1"), ("d", "unknown", "unknown")}
    skill = tmp_path / "s"
    (skill / "sub").mkdir(parents=True)
    for p in ("SKILL.md", "sub/a.md", "sub/SKILL.md", ".secret"):
        (skill / p).write_text(p)
    assert exports.checkout(str(skill), str(tmp_path / "out"))["files_copied"] == ["SKILL.md", "sub/SKILL.md", "sub/a.md"]
    assert exports.checkout(str(skill), str(tmp_path / "flat"), False)["files_copied"] == ["SKILL.md", "a.md"]
    assert not exports.checkout(str(tmp_path / "none"), str(tmp_path))["success"]


def test_glob_regex():
    assert re.match(index.glob_regex("a[bc]*.md").replace("\\z", "\\Z"), "ab.md")


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "cluster_id"
