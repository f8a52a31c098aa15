"""Uniform shuffle into shards of exact sizes, in DataFrame and SQL operations only.

A uniformly random assignment of rows to shards of fixed sizes sends from each partition to each shard numbers of
rows that follow a multivariate hypergeometric law. These numbers are drawn first (one matrix of partitions by
shards), then every partition is permuted on its own and cut by its row of the matrix, the pieces are exchanged,
and every shard is permuted once more. No step sorts more than a partition or a slice of a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Partitions whose counts are drawn one after another; groups of them are drawn first, then all groups at once.
GROUP = 256
#: Rows sorted together inside a shard, about.
SLICE = 20_000


def hypergeometric(population: str, successes: str, draws: str, unit: str) -> str:
    """SQL for a number of successes among ``draws`` without replacement, by inversion of ``unit`` in (0, 1).
    The weights follow from the ratio of neighbours, over all values within 12 standard deviations and 8 more."""
    n, k, d = (f"cast({x} as double)" for x in (population, successes, draws))
    mean = f"({d} * {k} / greatest({n}, 1))"
    wide = f"(12 * sqrt(greatest({mean} * (1 - {k} / greatest({n}, 1)) * ({n} - {d}) / greatest({n} - 1, 1), 0)) + 8)"
    low = f"greatest(0, {draws} - ({population} - {successes}), cast(floor({mean} - {wide}) as bigint))"
    high = f"least({successes}, {draws}, cast(ceil({mean} + {wide}) as bigint))"
    ratio = f"(({k} - x) * ({d} - x) / ((x + 1D) * ({n} - {k} - {d} + x + 1D)))"
    step = "named_struct('w', s.w * {r}, 'sum', s.sum + s.w)".format(r=ratio)
    whole = f"aggregate(r, named_struct('w', 1D, 'sum', 0D), (s, x) -> {step}, s -> s.sum)"
    pick = (
        f"aggregate(r, named_struct('w', 1D, 'left', {unit} * whole, 'at', cast(-1 as bigint)), (s, x) -> "
        f"named_struct('w', s.w * {ratio}, 'left', s.left - s.w, 'at', if(s.at < 0 and s.left <= s.w, x, s.at)), "
        "s -> if(s.at < 0, element_at(r, -1), s.at))"
    )
    inner = f"transform(array({whole}), whole -> {pick})[0]"
    return f"transform(array(sequence({low}, {high})), r -> {inner})[0]"


def _counts(capacities: str, n: str, seed: str) -> str:
    """SQL for the counts that ``n`` rows send to shards of the given free places (an array), one shard after
    another. ``seed``: what makes the draw this one's own."""
    unit = f"((pmod(xxhash64({seed}, j), 4503599627370496L) + 0.5D) / 4503599627370496D)"
    one = hypergeometric("t.places", "cap", "t.n", unit)
    zero = f"named_struct('places', aggregate({capacities}, 0L, (a, b) -> a + b), 'n', {n}, 'out', cast(array() as array<bigint>))"
    step = f"named_struct('places', t.places - cap, 'n', t.n - v, 'out', concat(t.out, array(v)))"
    bound = f"transform(array({capacities}[j]), cap -> transform(array({one}), v -> {step})[0])[0]"
    return f"aggregate(sequence(0, size({capacities}) - 1), {zero}, (t, j) -> {bound}, t -> t.out)"


def _matrix(parts: str, capacities: str, seed: int) -> str:
    """SQL: ``parts`` is an array of structs ``id, n``; gives structs ``id, counts`` drawn one after another."""
    drawn = _counts("m.free", "p.n", f"{seed}L, p.id")
    step = "named_struct('free', zip_with(m.free, c, (a, b) -> a - b), 'rows', concat(m.rows, array(named_struct('id', p.id, 'counts', c))))"
    return (
        f"aggregate({parts}, named_struct('free', {capacities}, 'rows', cast(array() as array<struct<id:bigint,counts:array<bigint>>>)), "
        f"(m, p) -> transform(array({drawn}), c -> {step})[0], m -> m.rows)"
    )


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """counts: rows ``pid, n``. Returns ``pid, counts``: how many rows each partition sends to each shard. Rows add
    up to n, columns to shard sizes that differ by one at most."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("id"), "n")))
    groups = counts.groupBy(F.floor(F.col("pid") / GROUP).alias("id")).agg(F.sum("n").alias("n")).agg(listed.alias("parts"), F.sum("n").alias("total"))
    size = f"transform(sequence(0, {shards - 1}), j -> cast(total div {shards} + if(j < total % {shards}, 1, 0) as bigint))"
    groups = groups.where("total > 0").withColumn("free", F.expr(size)).select(F.explode(F.expr(_matrix("parts", "free", seed))).alias("g"))
    inside = counts.select(F.floor(F.col("pid") / GROUP).alias("g_id"), F.col("pid").cast("long").alias("id"), "n").groupBy("g_id").agg(listed.alias("parts"))
    inside = inside.join(groups.select(F.col("g.id").alias("g_id"), F.col("g.counts").alias("free")), "g_id")
    return inside.select(F.explode(F.expr(_matrix("parts", "free", seed + 1))).alias("p")).select(F.col("p.id").alias("pid"), F.col("p.counts").alias("counts"))


def shard(df: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to every row of ``df``, in place of
    columns of these names. Shard sizes differ by one at most; every assignment is equally likely. Nothing in a row
    counts, so nulls, repeated rows and groups of copies of any size are spread like all others. An empty table
    stays empty. The draw follows the partitions in which ``df`` comes: a rerun over the same files with the same
    read settings gives the same shards. Rows travel twice, so keep ``df`` narrow."""
    rows = df.drop("shard", "slot")
    plain = [f"`{c}`" for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    # The place in the partition takes part, so equal rows get orders of their own; the caller's columns stay in one struct.
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *map(F.col, plain)).alias("one"))
    own = own.sortWithinPartitions("one").withColumn("at", F.monotonically_increasing_id())
    own = written(own.select("row", "one", F.shiftright("at", 33).alias("pid"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "permuted")
    counts = own.groupBy("pid").agg(F.count("*").alias("n"))
    ends = F.expr("transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (a, b) -> a + b))")
    matrix = written(communication_matrix(counts, shards, seed).select("pid", ends.alias("ends")), "matrix")
    sent = own.join(matrix, "pid").withColumn("shard", F.expr("size(filter(ends, e -> e <= pos))")).drop("ends")
    total = own.count()
    slices = max(1, -(-total // (shards * SLICE)))
    sent = sent.withColumn("two", F.xxhash64(F.lit(seed + 1), "one", "pid", "pos"))
    sent = written(sent.withColumn("slice", F.floor(F.shiftrightunsigned("two", 2) / F.lit((1 << 62) // slices + 1))), "exchanged")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("two", "pid", "pos"))
    out = sent.withColumn("n", place).join(starts, ["shard", "slice"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "shard", (F.col("start") + F.col("n") - 1).alias("slot"))
