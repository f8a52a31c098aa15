"""Answers as text for a terminal, from rows that queries have limited already.

Shares are rounded half to even; long fields are cut off; overlaps have bars and, against each other, glyphs.
"""

from __future__ import annotations

import textwrap
from collections.abc import Iterable, Iterator

from pyspark.sql import Row

#: Characters of a description in a list, of a trigger, of a front-matter value, of a collection's name in tables; columns of wrapped text; cells of a full bar.
DESCRIPTION, TRIGGER, VALUE, NAME, PAIR, WIDTH, BAR = 60, 80, 60, 30, 20, 70, 20


def percent(share: float, digits: int = 0) -> str:
    return f"{100 * share:.{digits}f}%"


def cut_off(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def bar(share: float) -> str:
    return "█" * int(share * BAR)


def more(n: int, shown: int, what: str) -> Iterator[str]:
    if n > shown:
        yield f"  ({n - shown} more {what})"


def where(clusters: Iterable[Row], places: Iterable[Row]) -> Iterator[str]:
    """clusters: those of the places; places: ``cluster_id, marketplace, plugin, path, is_official``."""
    own: dict[int, list[Row]] = {}
    for p in places:
        own.setdefault(p.cluster_id, []).append(p)
    if not own:
        yield "no similar files"
        return
    yield f"{sum(map(len, own.values()))} places in {len(own)} clusters"
    for c in sorted(clusters, key=lambda c: (-c.size, c.cluster_id)):
        mark = ", with an official file" if c.has_official else ""
        yield f"cluster {c.cluster_id}: {c.type}, {c.size} files, {percent(c.avg_similarity)} alike{mark}; {', '.join(c.marketplaces)}"
        for p in sorted(own.get(c.cluster_id, []), key=lambda p: (p.marketplace, p.path)):
            yield f"  {p.marketplace}/{p.plugin}/{p.path}" + (" (official)" if p.is_official else "")


def venn(v: Row, a: str, b: str, pairs: list[Row], n_pairs: int) -> Iterator[str]:
    """v: the outcome of a comparison of two collections; pairs: the first of ``n_pairs`` matches."""
    yield f"{a}: {v.total_a} files, {b}: {v.total_b} files"
    yield f"shared: {v.shared}"
    for name, total, unique in ((a, v.total_a, v.unique_a), (b, v.total_b, v.unique_b)):
        yield f"  {name}: overlap {percent(v.shared / total, 1)}, only here {unique} ({percent(unique / total, 1)})" if total else f"  {name}: no files"
    largest = max(v.total_a, v.total_b)
    yield f"verdict: {v.verdict}" + (f" ({percent(v.shared / largest, 1)} of the larger)" if v.verdict == "partial" else "")
    for i, p in enumerate(pairs, 1):
        yield f"  {i:>2}. {percent(p.similarity)}  {p.file_a}  =  {p.file_b}"
    yield from more(n_pairs, len(pairs), "matches")


def compared(t: Row, target: str, baseline: str, redundant: list[Row] | None = None) -> Iterator[str]:
    """t: counts by status, confidence, warnings and verdicts; redundant: files, if they are asked for."""
    share = lambda n: f"{n} ({percent(n / t.total)})" if t.total else "0"
    yield f"{target} against {baseline}: {t.total} files"
    yield f"  novel {share(t.novel)}, redundant {share(t.redundant)}, partial {t.partial}; confidence {t.confidence}"
    for w in t.warnings:
        yield f"  warning: {w}"
    for r in redundant or []:
        yield f"  {r.file}: {percent(r.similarity)} like {r.similar_to}"
    if redundant is not None:
        yield from more(t.redundant, len(redundant), "redundant files")
    yield f"  overlap: {t.verdict}; {t.impact_novel} new, {t.redundant} redundant: {t.impact}"


def level(counts: list[Row], n_collections: int, pairs: list[Row], n_pairs: int, heat: list[Row] | None = None) -> Iterator[str]:
    yield f"{n_collections} collections"
    for c in counts:
        yield f"  {c.marketplace[:NAME]:<{NAME}} {c.files:>6} files {c.clusters:>5} clusters"
    yield from more(n_collections, len(counts), "collections")
    for p in pairs:
        yield f"  {p.mp_a[:PAIR]:<{PAIR}} {p.mp_b[:PAIR]:<{PAIR}} {percent(p.similarity, 1):>6} {bar(p.similarity)}".rstrip()
    yield from more(n_pairs, len(pairs), "pairs") if pairs else iter(["  no two collections share a cluster"])
    if heat:
        width = len(heat)
        yield " " * 10 + "".join(f"{r.marketplace[:6]:>7}" for r in heat)
        for r in heat:
            yield f"{r.marketplace[:9]:<10}" + "".join(f"{2 * r[f'c{k}']:>7}" for k in range(1, width + 1))
        if n_collections > width:
            yield f"({width} of {n_collections} collections)"


def installed(groups: Iterable[Row]) -> Iterator[str]:
    for g in groups:
        yield f"{g.marketplace}: {g.plugins}"
        yield from (f"  {n}" for n in g.names)


def found(rows: Iterable[Row]) -> Iterator[str]:
    """rows: matches in the order of their scores; they are shown by collection."""
    by: dict[str, list[Row]] = {}
    for r in rows:
        by.setdefault(r.marketplace, []).append(r)
    yield f"{sum(map(len, by.values()))} matches"
    for name in sorted(by):
        yield f"{name}:"
        for r in by[name]:
            yield f"  {r.kind} {r.name} ({r.plugin})"
            if r.description:
                yield f"    {cut_off(r.description, DESCRIPTION)}"


def skill(r: Row, front: dict | None = None) -> Iterator[str]:
    """r: what is known of a skill; front: other fields of its front matter, if they are asked for."""
    yield f"{r.name} ({r.kind}) in {r.marketplace}/{r.plugin}: {r.path}"
    yield f"  {r.complexity_score} complexity, {r.line_count} lines, {r.word_count} words"
    yield from (f"  {line}" for line in textwrap.wrap(r.description, WIDTH))
    yield from (f"  trigger: {cut_off(t, TRIGGER)}" for t in r.triggers)
    if r.tool_uses:
        yield f"  tools: {', '.join(r.tool_uses)}"
    if r.dependencies:
        yield f"  needs: {', '.join(r.dependencies)}"
    yield from (f"  {k}: {cut_off(str(v), VALUE)}" for k, v in (front or {}).items() if k not in ("name", "description", "triggers"))
