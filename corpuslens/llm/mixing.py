"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document gets a place in its source's shuffled order and a virtual finish time: the words of its source up
to and with it, divided by the source's target. All documents (a second pass over a source follows the first) are
then taken in the order of finish times until the total budget is used up. Both running sums, within a source
and over all, are sums over buckets of the order plus sums inside one bucket, so that no source, however large,
is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Documents in a bucket of a source's order, and copies in a bucket of the global order, about.
BUCKET, SLICE = 20_000, 4_000
SPAN = 1 << 60


def _unit(text: Column) -> Column:
    """60 bits of an MD5 as a number from 0 to 2^60 - 1; any engine with MD5 finds the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share_percent: int = 150, most: int = 2) -> DataFrame:
    """sizes: one row ``source, source_size`` for each source. Adds ``weight`` (by the order of names, null last)
    and ``target``: weights share ``share_percent`` of all sizes, no target exceeds ``most`` times its source's
    size, and what is cut off is shared by the others. The sources stopped at their limit are the first ones in
    the order of limit over weight, so one running sum finds the final share. One row a source: small by nature."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    s = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (nth + 1).cast("int")).cast("long").alias("weight"))
    s = s.withColumn("limit", F.col("source_size") * most).withColumn("at", F.col("limit") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every) * share_percent / F.lit(100.0))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("stopped", F.col("level") > F.col("at"))
    level = F.min_by("level", F.when(~F.col("stopped"), F.col("at"))).over(every)
    target = F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"), "budget")


def document_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text_key, size`` of every row."""
    return docs.select("doc_id", "source", _unit(F.coalesce("text", F.lit(""))).alias("text_key"), n_words(F.col("text")).alias("size"))


def mixing_plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, text_key, n_rows, size, source_size, target, passes``: so many rows of that id, source and text are
    taken so often (0 to 2 times).

    Rows that agree in all three have numbers and are taken one by one, each at a place of its own. Null ids, sources and texts are values like others; a null or
    blank text has size 0 and is never taken. The order depends on ids, sources, texts and the seed alone, so a
    rerun gives the same mix however the rows are spread. A block is taken while the running total stays within
    the budget, so that each source ends within about one row of its target.
    """
    slim = written(document_keys(docs), "sizes")
    blocks = slim.groupBy("doc_id", "source", "text_key").agg(F.count("*").alias("n_rows"), F.max("size").alias("size"))
    # One row for each of the repeated rows; its number is part of its place in the order.
    blocks = blocks.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("source", F.lit("")), F.col("text_key").cast("string"), F.col("nth").cast("string"))
    total = slim.count()
    n, slices = max(1, -(-total // BUCKET)), max(64, -(-total // SLICE))
    blocks = blocks.withColumn("h", _unit(name)).withColumn("block", F.col("size")).where("block > 0")
    blocks = written(blocks.withColumn("bucket", F.floor(F.col("h") / F.lit(SPAN // n + 1))), "blocks")

    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("text_key"), F.col("nth")]
    sums = blocks.groupBy("source", "bucket").agg(F.sum("block").alias("part"))
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("part").over(w), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    starts = starts.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source", "weight")
    within = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = blocks.withColumn("inside", F.sum("block").over(within))
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    copies = ranked.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("start") + F.col("inside")) / F.col("target")
    copies = copies.withColumn("finish", finish)
    copies = written(copies.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices))), "finish")

    # The slice of finish times in which the budget ends, then the exact place inside it.
    totals = copies.groupBy("slice").agg(F.sum("block").alias("part"), F.first("budget").alias("budget"))
    run = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("part").over(run))
    edge = totals.where("upto > budget").agg(F.min(F.struct("slice", F.col("upto") - F.col("part"))).alias("e")).first().e
    if edge is None:
        taken = copies
    else:
        at, upto = edge
        last = Window.orderBy("finish", *order, "copy").rowsBetween(Window.unboundedPreceding, 0)
        part = copies.where(F.col("slice") == at).withColumn("run", F.sum("block").over(last) + upto).where("run <= budget").drop("run")
        taken = copies.where(F.col("slice") < at).unionByName(part)
    key = ["doc_id", "source", "text_key"]
    often = taken.groupBy(*key, "nth").agg(F.count("*").alias("passes")).groupBy(*key).agg(F.count("*").alias("once"), F.count(F.when(F.col("passes") > 1, 1)).alias("twice"))
    rows = slim.groupBy(*key).agg(F.count("*").alias("n_rows"), F.max("size").alias("size")).alias("x")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.text_key") == F.col("y.text_key"))
    once, twice = F.coalesce("y.once", F.lit(0)), F.coalesce("y.twice", F.lit(0))
    counts = F.array(*[F.struct(n.alias("n_rows"), F.lit(i).cast("long").alias("passes")) for i, n in enumerate((F.col("x.n_rows") - once, once - twice, twice))])
    rows = rows.join(often.alias("y"), same, "left").select("x.doc_id", "x.source", "x.text_key", "x.size", F.explode(F.filter(counts, lambda c: c.n_rows > 0)).alias("c"))
    s = sources.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(s, F.col("source").eqNullSafe(F.col("s"))).select(*key, "c.n_rows", "size", "source_size", "target", "c.passes")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed rows of ``docs``, with its columns: each row as often as the plan takes it. Where some of the rows of one
    id, source and text are taken more often than others, those with the least hashes of all columns are. An empty table
    stays empty. Extra columns are carried along, whatever their names."""
    plan = mixing_plan(docs, seed).groupBy("doc_id", "source", "text_key").agg(*[F.sum(F.when(F.col("passes") == i, F.col("n_rows")).otherwise(0)).alias(f"p{i}") for i in range(3)])
    plan = plan.where("p1 + p2 > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_key").alias("t"), "p1", "p2")
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    nested = docs.select("doc_id", "source", _unit(F.coalesce("text", F.lit(""))).alias("text_key"), F.xxhash64(*plain).alias("r"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Fully equal rows count together: ``n`` of them are taken ``c`` times in all.
    same = nested.groupBy("doc_id", "source", "text_key", "r").agg(F.count("*").alias("n"))
    same = same.join(plan, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("text_key") == F.col("t")))
    at = F.sum("n").over(Window.partitionBy("d", "s", "t").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("at", F.coalesce(at, F.lit(0)))
    upto = [F.greatest(F.lit(0), F.least(F.col("at") + F.col("n"), x) - F.col("at")) for x in (F.col("p2"), F.col("p1") + F.col("p2"))]
    same = written(same.select("d", "s", "t", F.col("r").alias("x"), "n", (upto[0] + upto[1]).alias("c")).where("c > 0"), "taken")
    found = nested.join(same, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("text_key") == F.col("t")) & (F.col("r") == F.col("x")))
    out = found.where("c % n = 0").select("row", F.expr("c div n").alias("c"))
    if same.where("c % n != 0").head(1):
        out = out.unionByName(found.where("c % n != 0").groupBy("d", "s", "t", "x").agg(F.first("row").alias("row"), F.first("c").alias("c")).select("row", "c"))
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("c"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
