"""Mixing sources to target weights by Poisson replication.

Each source gets the repetition rate at which its characters reach their share
of the target. A document's count is the Poisson quantile of a number that is
hashed from the seed and its id, so a recomputed task draws the same counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.queries import query, table

SEED = "mix-1"
BROADCAST_BYTES = 8 << 20
#: Largest mean of one Poisson draw; a higher rate is drawn in pieces.
PIECE = 256.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5 digest."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, targets: DataFrame | None = None, epochs: float = 1.0) -> DataFrame:
    """``(source, rate)``: mean copies a document of the source needs.

    ``targets(source, weight)`` holds relative weights; sources it does not name
    get weight 0 and with it rate 0; if it names none of them, or all with 0, every
    rate is 0. Without it every source weighs the same. ``epochs`` times the
    characters of all documents are shared out. A source with a weight but without
    characters keeps the rate ``epochs``.
    """
    sums = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    if targets is None:
        sums = sums.withColumn("weight", F.lit(1.0))
    else:
        weights = targets.groupBy(F.col("source").alias("target")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sums = sums.join(weights, F.col("source").eqNullSafe(F.col("target")), "left").drop("target").fillna(0.0, ["weight"])
    total = sums.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    sums = sums.join(F.broadcast(total))  # one row
    rate = F.try_divide("weight", "all_weight") * F.col("all_chars") / F.col("chars") * F.lit(float(epochs))
    rate = F.when(F.col("weight") <= 0, 0.0).when(F.col("chars") > 0, rate).otherwise(F.lit(float(epochs)))
    return sums.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """``(source, pieces, cdf)``: a rate as a sum of equal pieces of PIECE at most, and a piece's Poisson distribution.

    The distribution goes ten deviations above the mean, so it has some hundred
    entries at any rate; a sum of Poisson numbers is one of the summed mean.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    rates = rates.select("source", pieces.alias("pieces"), (F.col("rate") / pieces).alias("rate"))
    rate = F.col("rate")
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    # log of k! as a running sum, then exp per entry: large rates do not underflow
    logs = F.aggregate(
        F.sequence(F.lit(1), last), F.array(F.lit(0.0)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.ln(k.cast("double")))))
    mass = F.transform("logs", lambda log, k: F.exp(k * F.ln(rate) - rate - log))
    running = F.aggregate(
        "mass", F.array().cast("array<double>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + p)))
    return (rates.withColumn("logs", logs).withColumn("mass", mass)
            .select("source", "pieces", F.when(rate > 0, running).otherwise(F.array(F.lit(1.0))).alias("cdf")))


def replicate(docs: DataFrame, targets: DataFrame | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every document as often as its count says, in one global random order.

    Returns the columns of ``docs`` and ``copy`` (different for each copy of a row,
    from 1), ``shuffle_key``; input
    columns of these names are replaced. Documents without an id are hashed by
    their text; rows that agree in id (or, without one, in text) get the same
    count. A null source is a source of its own. Null or empty texts weigh no
    characters but are replicated by their source's rate. No rows: no rows.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = session.cut(cumulative(repetition_rates(docs, targets, epochs)), "rates")
    size = rates.agg(F.sum(F.size("cdf") * 8 + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # the row travels as one struct, so its names cannot meet those used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), identity.alias("identity"))
    drawn = rows.join(rates, F.col("of").eqNullSafe(F.col("source"))).select(
        "row", "identity", "cdf", F.explode(F.sequence(F.lit(1), "pieces")).alias("piece"))
    number = F.when(F.col("piece") > 1, uniform(F.lit(seed), F.col("identity"), F.col("piece").cast("string"))).otherwise(uniform(F.lit(seed), F.col("identity")))
    counted = drawn.withColumn("u", number).select("row", "identity", "piece", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("copies"))
    copies = counted.filter("copies > 0").select("row", "identity", "piece", F.explode(F.sequence(F.lit(1), "copies")).alias("k"))
    copies = copies.select("row", "identity", ((F.col("piece") - 1) * 1024 + F.col("k")).alias("copy"))
    keyed = copies.select("row", "copy", F.md5(F.concat_ws("|", F.lit(seed), "identity", "copy")).alias("shuffle_key"))
    # keys are uniform, so range partitions are even and no source can be hot
    return keyed.orderBy("shuffle_key", "copy").select("row.*", "copy", "shuffle_key")


SQL = f"""
with s as (select source, sum(coalesce(length(text), 0)) as chars from documents group by source),
r as (select source, case when chars > 0 then sum(chars) over () / count(*) over () / chars else 1.0 end as rate from s),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 10 * sqrt(rate) + 20) as bigint) + 1)) as k from r),
m as (select source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) as p from k),
c as (select source, sum(p) over (partition by source order by k) as cdf from m),
u as (select *, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as ident from documents),
v as (select *, cast('0x' || substr(md5('{SEED}|' || ident), 1, 13) as bigint) / 4503599627370496.0 as u from u),
n as (select v.doc_id, v.text, v.lang, v.source, v.n_chars, v.ident, count(*) as copies
      from v join c on v.source is not distinct from c.source and c.cdf <= v.u
      group by all)
select doc_id, text, lang, source, n_chars, copy, md5('{SEED}|' || ident || '|' || copy) as shuffle_key
from (select *, cast(unnest(range(1, copies + 1)) as integer) as copy from n)
"""


@query("op9_poisson_mixing", SQL)
def op9_poisson_mixing(spark, sf):
    return replicate(table(spark, sf, "documents"))
