"""Texts for the terminal, as they should look."""

from pyspark.sql import Row

from corpuslens.sinks import render


def test_helpers():
    assert [render.percent(x) for x in (0.125, 0.375, 1.0)] == ["12%", "38%", "100%"] and render.percent(0.12345, 1) == "12.3%"
    assert render.cut_off("x" * 60, 60) == "x" * 60 and render.cut_off("x" * 61, 60) == "x" * 60 + "..."
    assert [len(render.bar(x)) for x in (0, 0.049, 0.05, 0.99, 1.0)] == [0, 0, 1, 19, 20]


def test_where():
    c = [Row(cluster_id=4, type="internal", size=2, avg_similarity=0.915, has_official=False, marketplaces=["m"]), Row(cluster_id=1, type="cross-marketplace", size=3, avg_similarity=1.0, has_official=True, marketplaces=["a", "m"])]
    p = [Row(cluster_id=k, marketplace=m, plugin="p", path=x, is_official=o) for k, m, x, o in ((4, "m", "x.md", False), (1, "m", "x.md", False), (1, "a", "x.md", True))]
    assert list(render.where(c, p)) == [
        "3 places in 2 clusters", "cluster 1: cross-marketplace, 3 files, 100% alike, with an official file; a, m", "  a/p/x.md (official)", "  m/p/x.md",
        "cluster 4: internal, 2 files, 92% alike; m", "  m/p/x.md",
    ]
    assert list(render.where([], [])) == ["no similar files"]


def test_comparisons():
    v = Row(total_a=3, total_b=8, shared=2, shared_a=1, unique_a=2, unique_b=6, verdict="partial")
    assert list(render.venn(v, "a", "b", [Row(file_a="x.md", file_b="y.md", similarity=0.905)], 2)) == [
        "a: 3 files, b: 8 files", "shared: 2", "  a: overlap 66.7%, only here 2 (66.7%)", "  b: overlap 25.0%, only here 6 (75.0%)", "verdict: partial (25.0% of the larger)",
        "   1. 90%  x.md  =  y.md", "  (1 more matches)",
    ]
    none = Row(total_a=0, total_b=0, shared=0, shared_a=0, unique_a=0, unique_b=0, verdict="empty")
    assert list(render.venn(none, "a", "b", [], 0)) == ["a: 0 files, b: 0 files", "shared: 0", "  a: no files", "  b: no files", "verdict: empty"]
    t = Row(total=40, novel=30, redundant=5, partial=5, confidence="medium", warnings=["low ratio"], verdict="low", impact_novel=35, impact="mostly new")
    assert list(render.compared(t, "a", "b", [Row(file="f.md", similarity=0.95, similar_to="m/p/x.md")])) == [
        "a against b: 40 files", "  novel 30 (75%), redundant 5 (12%), partial 5; confidence medium", "  warning: low ratio", "  f.md: 95% like m/p/x.md",
        "  (4 more redundant files)", "  overlap: low; 35 new, 5 redundant: mostly new",
    ]


def test_levels_and_lists():
    heat = [Row(place=1, marketplace="alpha-long-name", c1="█", c2="░"), Row(place=2, marketplace="b", c1="░", c2="█")]
    lines = list(render.level([Row(marketplace="b" * 40, files=12, clusters=3)], 3, [Row(mp_a="a", mp_b="b", similarity=0.25)], 1, heat))
    assert lines == [
        "3 collections", f"  {'b' * 30}     12 files     3 clusters", "  (2 more collections)", f"  {'a':<20} {'b':<20}  25.0% █████",
        "           alpha-      b", "alpha-lon      ██     ░░", "b              ░░     ██", "(2 of 3 collections)",
    ]
    assert list(render.installed([Row(marketplace="m", plugins=2, names=["a", "b"])])) == ["m: 2", "  a", "  b"]
    rows = [Row(marketplace="z", kind="skill", name="s", plugin="p", description="d" * 70), Row(marketplace="a", kind="agent", name="t", plugin="q", description="")]
    assert list(render.found(rows)) == ["2 matches", "a:", "  agent t (q)", "z:", "  skill s (p)", f"    {'d' * 60}..."]
    r = Row(name="s", kind="skill", marketplace="m", plugin="p", path="x.md", complexity_score="low", line_count=3, word_count=9, description="word " * 20, triggers=["t" * 90], tool_uses=["Bash"], dependencies=["git"])
    lines = list(render.skill(r, {"name": "s", "license": "MIT"}))
    assert lines[0] == "s (skill) in m/p: x.md" and lines[2] == "  " + ("word " * 14).strip() and lines[4] == f"  trigger: {'t' * 80}..." and lines[-2:] == ["  needs: git", "  license: MIT"]
