"""Trees of files, lookups by spec, the saved index and the commands on it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuslens import cli
from corpuslens.config import DEFAULT
from corpuslens.operators import index
from corpuslens.sinks import exports
from corpuslens.sources import files as source
from corpuslens.sources import lookup, tree


def put(root, paths):
    for p, text in paths.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


LONG = "Use this skill when you test. " + " ".join(f"word{i}" for i in range(60))


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "root", {
        "one/skills/pdf/SKILL.md": LONG + " one", "one/agents/pdf.md": LONG + " agent", "one/plugins/tools/skills/xls.md": LONG + " tools", "one/plugins/cat/deep/agents/xls.md": LONG,
        "one/deep/skills/own.md": LONG + " own", "two/skills/pdf.md": LONG + " two", "two/plugins/deep/skills/xls.md": LONG + " x", "Three/agents/Pdf.md": LONG, "three/agents/other.md": LONG,
        ".hidden/skills/pdf.md": LONG, "two/_under/.dots/a.md": LONG + " dots", "two/backups/b.md": LONG, "one/short.md": "short", "one/notes.txt": LONG,
    })
    (tmp_path / "root/two/broken.md").symlink_to(tmp_path / "nowhere.md")
    return tmp_path / "root"


def test_tree_is_listed_and_read_by_tasks(spark, root):
    scanned = source.scan_tree(spark, f"file://{root}")
    assert scanned.counts == {"indexed": 10, "short": 1, "failed": 1}
    assert [os.path.basename(r.full_path) for r in scanned.problems.collect()] == ["broken.md"] and scanned.problems.first().error
    rows = scanned.files.orderBy("file_index").collect()
    assert [r.file_index for r in rows] == list(range(10)) and [(r.marketplace, r.relative_path) for r in rows] == sorted((r.marketplace, r.relative_path) for r in rows)
    assert ("two", "_under/.dots/a.md") in {(r.marketplace, r.relative_path) for r in rows}
    with pytest.raises(Exception, match="no such folder"):
        tree.listed(spark, f"{root}/none").count()
    (root.parent / "empty").mkdir()
    assert source.scan_tree(spark, str(root.parent / "empty")).counts == {"indexed": 0, "short": 0, "failed": 0}


def test_installed_are_read_by_path(spark, root, tmp_path):
    put(tmp_path / "cache", {"p/1.0/skills/a.md": LONG, "p/1.0/b.md": LONG + " b"})
    plugins = spark.createDataFrame([("p", "m", f"{tmp_path}/cache/p/1.0"), ("gone", "m", f"{tmp_path}/cache/gone")], "name string, marketplace string, install_path string")
    scanned = source.scan_installed(spark, plugins)
    assert {(r.marketplace, r.relative_path) for r in scanned.files.collect()} == {("m", "skills/a.md"), ("m", "b.md")}
    assert scanned.counts == {"indexed": 2, "short": 0, "failed": 1} and scanned.problems.first().full_path.endswith("gone")


def test_candidate_ladders(spark, root):
    files = source.scan(spark, str(root)).cache()

    def copied(spec):
        r = lookup.skill_to_copy(files, spec).first()
        return r and (r.marketplace, r.path, r.is_file)

    assert copied("pdf") == ("one", "skills/pdf", False)  # a folder of skills before a file of agents, collections by name
    assert copied("two/pdf") == ("two", "skills/pdf.md", True) and copied("TWO/pdf") == copied("two/pdf")
    assert copied("THREE/Pdf") == ("Three", "agents/Pdf.md", True) and copied("three/Pdf") is None  # exact case first
    assert copied("one/tools/xls") == ("one", "plugins/tools/skills/xls.md", True)
    assert copied("one/deep/xls") is None  # the collection's own folder hides that of a category
    assert copied("two/deep/xls") == ("two", "plugins/deep/skills/xls.md", True)
    assert copied("one/deep/own") == ("one", "deep/skills/own.md", True) and copied("none/x") is None and copied("one/none/x") is None
    assert [lookup.plugin_folder(files, "one", p) for p in ("deep", "tools", "nothing")] == ["deep", "plugins/tools", None]

    def described(spec):
        r = lookup.skill_file(files, spec).first()
        return r and (r.marketplace, r.relative_path)

    assert described("PDF") == ("Three", "agents/Pdf.md") and described("two/pDf") == ("two", "skills/pdf.md")
    assert described("one/tools/xls") == ("one", "plugins/tools/skills/xls.md") and described("one/cat/deep/agents/xls") == ("one", "plugins/cat/deep/agents/xls.md")
    assert described(f"{root}/two/skills/pdf.md") == ("two", "skills/pdf.md") and described("one/absent") is None
    assert {r.relative_path for r in source.baseline(files, "one/deep").collect()} == {"deep/skills/own.md"}
    with pytest.raises(ValueError, match="available: Three, one"):
        source.baseline(files, "absent")


def leaf_metric(df, name):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply(name).value()


def test_lookup_reads_one_file_of_many(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 50).alias("cluster_id"), F.lit("internal").alias("type"), F.lit("m").alias("marketplace"), F.lit("p").alias("plugin"), F.concat(F.lit("d/File_"), F.col("id") % 1000, F.lit(".md")).alias("path"), F.concat(F.lit("File_"), F.col("id") % 1000, F.lit(".md")).alias("filename"), F.lit(False).alias("is_official"))
    exports.write_located(rows, f"{tmp_path}/located")
    table = source.located(spark, None, str(tmp_path))
    assert len(table.inputFiles()) > DEFAULT.lookup_parts // 2
    hit = index.named(table, "x/y/File_77.md")
    assert len(hit.collect()) == 3 and leaf_metric(hit, "numFiles") == 1
    plain = rows.select(*[c for c in table.columns if c not in ("part", "folded")])
    for query in ("File_77.md", "ile_77", "File_1?.md", "none"):
        assert index.where(table, query).exceptAll(index.where(plain, query)).count() == index.where(plain, query).exceptAll(index.where(table, query)).count() == 0
    assert index.where(table, "ile_77").count() > 3 and index.where(table, "file_77").count() == 0  # names are matched with their case first


def test_report_peek(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"summary": {"unique_clusters": 7}, "clusters": []}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "bare.json").write_text("{}")
    peek = lambda report: source.cluster_count(spark, report and f"{tmp_path}/{report}", str(tmp_path / "data"))
    assert [peek(x) for x in ("ok.json", "bad.json", "bare.json", "absent.json", None)] == [7, 0, 0, 0, 0]


def test_banded_commands(spark, root, tmp_path, capsys):
    def run(*args, where=root):
        capsys.readouterr()
        code = cli.main(["--root", str(where), "--data", str(tmp_path / "data"), "--installed-file", str(tmp_path / "none.json"), *args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    code, out = run("scan", "--banded")
    assert code == 0 and {"indexed": 10, "short": 1, "failed": 1} in out and out[0]["total_files_scanned"] == 10
    report = json.loads((next((tmp_path / "data/report").glob("part-*"))).read_text())
    assert sum(x["clusters"] for x in report["summary"]["by_type"].values()) == report["summary"]["unique_clusters"] == 1
    gone = {"where": tmp_path / "gone"}  # below, no file can be read
    venn = run("compare-marketplaces", "-a", "one", "-b", "TWO", "--banded", "--saved", **gone)[1]
    assert venn[0] == run("compare-marketplaces", "-a", "one", "-b", "two", "--banded")[1][0] and venn[0]["total_a"] == 5 and venn[1]["similarity"] > 0.7
    code, out = run("compare", "two", "-b", "one", "--banded", "--saved", "-v", **gone)
    assert code == 0 and out[0]["total"] == 3 and all(r["similar_to"].startswith("one/") for r in out[1:])
    assert run("compare", "two", "-b", "one", "--banded")[1][0]["total"] == 3 and run("impact", "two", "-b", "one")[1][0]["impact"]
    assert run("compare", "two", "-b", "zero")[0] == 1 and run("compare", "two")[0] == 1  # no installed plugins are known
    said = lambda *args: (cli.main(["--data", str(tmp_path / "data"), *args, "--text"]), capsys.readouterr().out.splitlines())[1]
    assert said("where", "pdf.md")[0].endswith("clusters") and any(x.startswith("  two/root") or x.startswith("  two/skills") for x in said("where", "pdf.md"))
    assert said("marketplace-level", "--heatmap")[0] == "4 collections" and said("compare", "two", "-b", "one", "--banded", "--saved", "-v")[0] == "two against one: 3 files"
    assert said("compare-marketplaces", "-a", "one", "-b", "two", "--banded", "--saved")[0] == "one: 5 files, two: 3 files" and said("find", "pdf")[0].endswith("matches")
    assert [r["marketplace"] for r in run("marketplace-level", "--heatmap", **gone)[1] if "c1" in r] == sorted({"one", "two", "Three", "three"})
    assert run("describe", "one/tools/xls")[1][0]["name"] == "xls"
    assert cli.main(["--root", str(root), "checkout", "one/tools/xls", "-d", str(tmp_path / "out")]) == 0 and (tmp_path / "out/xls.md").exists()


def test_checkout_manifest(tmp_path):
    put(tmp_path, {"s/SKILL.md": "---\nname: x\nday: 2024-05-06\n---\nbody", "s/a.md": "a", "s/.git/b": "b", "file": "in the way"})
    result = exports.checkout(str(tmp_path / "s"), str(tmp_path / "out"))
    manifest = json.loads((tmp_path / "out" / exports.MANIFEST).read_text())
    assert result["success"] and manifest["name"] == "x" and manifest["day"] == "2024-05-06" and manifest["_checkout"]["files_copied"] == 2 and manifest["_checkout"]["timestamp"]
    assert not exports.checkout(str(tmp_path / "s"), str(tmp_path / "file/below"))["success"]
