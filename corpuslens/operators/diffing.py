"""Differences of pairs of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pandas_udfs import unified_diff
from ..functions.text import definitions, normalized_lines


def diff_pairs(pairs: DataFrame, files: DataFrame, context: int = 3) -> DataFrame:
    """pairs: ``i, j``. Normalised unified diff, definitions added and removed, and counts, of each pair."""
    side = files.select("file_index", F.concat_ws("/", "marketplace", "plugin", "relative_path").alias("location"), normalized_lines(F.col("content")).alias("lines"))
    a = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
    b = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    rows = pairs.join(a, F.col("i") == F.col("file_index_a")).join(b, F.col("j") == F.col("file_index_b"))
    old, new = definitions(F.col("lines_a")), definitions(F.col("lines_b"))
    rows = rows.withColumns({"added": F.array_except(new, old), "removed": F.array_except(old, new), "unified_diff": unified_diff("lines_a", "lines_b", "location_a", "location_b", F.lit(context))})
    changed = F.size(F.filter("unified_diff", lambda x: x.rlike(r"\A[+-]") & ~x.startswith("+++") & ~x.startswith("---")))
    return rows.select("i", "j", F.size("lines_a").alias("total_lines_file1"), F.size("lines_b").alias("total_lines_file2"), changed.alias("diff_lines"), F.size("added").alias("functions_added"), F.size("removed").alias("functions_removed"), "added", "removed", "unified_diff")


def terminal(diff: list[str]) -> str:
    """A diff with the usual colours: headers bold, hunks cyan, additions green, removals red."""
    colour = {"+++": "1", "---": "1", "@@": "36", "+": "32", "-": "31"}
    out = []
    for line in diff:
        code = next((c for p, c in colour.items() if line.startswith(p)), "")
        out.append(f"\033[{code}m{line}\033[0m" if code else line)
    return "\n".join(out)
