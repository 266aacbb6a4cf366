"""Order-dependent building blocks whose work is spread inside a key group.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the key
is first cut into chunks by a value of the order column, the window runs inside
(key, chunk), and only one summary row per chunk crosses chunk borders. The
chunk is computed from the row itself, so a recomputed task gives the same
rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_width(col: str | Column, width: int) -> Column:
    """Chunk of an integer order column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def mix(seed: int | Column, key: str | Column) -> Column:
    """Portable pseudo-random order in [0, 2**32): the same in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.lit(seed) if isinstance(seed, int) else seed
    return (k.cast("long") * F.lit(2654435761) + s.cast("long") * F.lit(40503)) % F.lit(4294967296)


def mix_chunk(order: Column, parts: int = 256) -> Column:
    """Equal-width chunk of a ``mix`` value."""
    return F.floor(order / F.lit(4294967296 // parts)).cast("long")


def sampled_chunk(df: DataFrame, order: Sequence[str], parts: int = 32, per_part: int = 32) -> Column:
    """Chunk of a non-numeric order key, from split points of a hash sample.

    The sample is the ``parts * per_part`` rows of smallest hash: bounded by
    constants, and the same on every run.
    """
    key = F.struct(*order)
    rows = (
        df.select(key.alias("k"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(parts * per_part)
        .collect()
    )
    keys = sorted(tuple(r.k) for r in rows)
    splits = sorted({keys[i] for i in range(per_part, len(keys), per_part)})
    if not splits:
        return F.lit(0).cast("long")
    types = [df.schema[c].dataType for c in order]
    points = F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(s, types, order)])
            for s in splits
        ]
    )
    return F.size(F.filter(points, lambda p: p <= key)).cast("long")


def _join_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal too, so that no row without a key is lost."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(named, reduce(and_, same), how).drop(*[f"_of_{k}" for k in keys])


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, out: str = "pos"
) -> DataFrame:
    """0-based position of each row in its key group."""
    part = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        d.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        _join_equal(d.withColumn("_rn", inside), sizes, part)
        .withColumn(out, (F.col("_rn") - 1 + F.col("_before")).cast("long"))
        .drop("_chunk", "_rn", "_before")
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    prev: str | None = None,
    next: str | None = None,
) -> DataFrame:
    """Add the value of the previous and/or next row of the same key.

    ``value`` must be a struct, so that a missing neighbour (null) and a
    neighbour with null fields stay apart.
    """
    part = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk).withColumn("_v", value)
    inside = Window.partitionBy(*part).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    o = F.struct(*order)
    aggs, picks = [], []
    out = d
    if prev:
        out = out.withColumn(prev, F.lag("_v").over(inside))
        aggs.append(F.max_by("_v", o).alias("_last"))
        picks.append(F.lag("_last").over(across).alias("_prev_edge"))
    if next:
        out = out.withColumn(next, F.lead("_v").over(inside))
        aggs.append(F.min_by("_v", o).alias("_first"))
        picks.append(F.lead("_first").over(across).alias("_next_edge"))
    edges = d.groupBy(*part).agg(*aggs).select(*part, *picks)
    out = _join_equal(out, edges, part, "left")
    if prev:
        out = out.withColumn(prev, F.coalesce(prev, "_prev_edge"))
    if next:
        out = out.withColumn(next, F.coalesce(next, "_next_edge"))
    return out.drop("_chunk", "_v", "_prev_edge", "_next_edge")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums ``out -> column`` along ``order`` within ``keys``."""
    part = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    totals = totals.select(
        *part,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
    )
    out = d.select("*", *[F.sum(c).over(inside).alias(f"_i_{o}") for o, c in sums.items()])
    out = _join_equal(out, totals, part)
    for o in sums:
        out = out.withColumn(o, F.col(f"_i_{o}") + F.col(f"_b_{o}"))
    return out.drop("_chunk", *[f"_i_{o}" for o in sums], *[f"_b_{o}" for o in sums])


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    n: int,
    value: Column,
    out: str,
    chunk: int = 256,
    include_current: bool = False,
    full_only: bool = True,
) -> DataFrame:
    """Array of the ``n`` rows before each row (oldest first), by position.

    Rows near the end of a chunk are also sent to the next chunk, so a task
    holds ``chunk + n`` rows of a sequence and never the whole of it.
    """
    chunk = max(chunk, n)
    own = by_width(pos, chunk)
    last = -1 if not include_current else 0
    span = n if not include_current else n - 1
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-span, last)
    d = (
        df.withColumn("_own", own)
        .withColumn("_reach", by_width(F.col(pos) + F.lit(span), chunk))
        .withColumn("_chunk", F.explode(F.array_distinct(F.array("_own", "_reach"))))
        .withColumn("_w", F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v"))).over(w))
        .where("_own = _chunk")
        .withColumn(out, F.transform(F.sort_array("_w", asc=True), lambda s: s["v"]))
        .drop("_own", "_reach", "_chunk", "_w")
    )
    return d.where(F.size(out) == n) if full_only else d
