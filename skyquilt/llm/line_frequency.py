"""Line dedup by site-relative frequency.

A line is boilerplate of a site when the share of the site's pages that contain
it exceeds a ratio. Lines are compared trimmed, by a 128-bit digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.queries import query, table

RATIO = 0.02
MIN_PAGES = 3


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def line_key(line: Column) -> Column:
    """Digest of the trimmed line; null for a blank line, which is never dropped."""
    trimmed = F.trim(line)
    return F.when(trimmed != "", _digest(trimmed))


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(site, line)``: digests of lines on more than ``ratio`` of a site's pages and on ``min_pages`` at least."""
    pages = docs.select(F.col(site).alias("site"), F.coalesce("text", F.lit("")).alias("text"))
    # a page counts once for a line: its keys are made distinct before the explode
    keys = F.array_distinct(F.array_compact(F.transform(F.split("text", "\n"), line_key)))
    counts = (pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line")
              .agg(F.count(F.lit(1)).alias("with_line")).filter(F.col("with_line") >= min_pages))
    totals = pages.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    return (counts.join(totals, F.col("site").eqNullSafe(F.col("of")))
            .filter(F.col("with_line") > F.lit(ratio) * F.col("pages")).select("site", "line"))


def drop_boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents without the boilerplate lines of their site.

    Returns the columns of ``docs`` with ``text`` rewritten, and ``n_lines``,
    ``n_dropped``; input columns of these names are replaced. A null site is a
    site of its own, a null text an empty one (``n_lines`` 0, text stays null).
    All copies of a line on a page go; blank lines stay. Repeated rows are pages
    of their own. No rows: no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = session.cut(boilerplate(docs, site, ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(site).alias("of"), F.col("text").alias("whole"))
    # which lines of a text go depends on its site and its words alone, so equal texts share one decision
    lines = rows.select("of", F.md5("whole").alias("page"), F.posexplode(F.transform(F.split("whole", "\n"), line_key)).alias("pos", "key"))
    hit = (lines.join(drops, F.col("of").eqNullSafe(F.col("site")) & (F.col("key") == F.col("line")))
           .groupBy(F.col("of").alias("hit_of"), F.col("page").alias("hit_page")).agg(F.collect_set("pos").alias("gone")))
    joined = rows.join(hit, F.col("of").eqNullSafe(F.col("hit_of")) & (F.md5("whole") == F.col("hit_page")), "left")
    parts = F.split("whole", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    names = [F.col(f"row.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns]
    size = F.when(F.col("whole").isNull() | (F.col("whole") == ""), 0).otherwise(F.size(parts))
    return joined.select(*names, size.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


SQL = f"""
with l as (select source, doc_id, text, unnest(string_split(text, chr(10))) as line,
                  unnest(range(0, len(string_split(text, chr(10))))) as pos from documents),
t as (select *, trim(line) as key from l),
c as (select source, key, count(distinct doc_id) as n from t where key <> '' group by source, key),
p as (select source, count(*) as pages from documents group by source),
b as (select c.source, c.key from c join p on c.source is not distinct from p.source
      where n >= {MIN_PAGES} and n > {RATIO} * pages),
m as (select t.*, b.key is not null as gone from t left join b
      on t.source is not distinct from b.source and t.key = b.key),
g as (select doc_id, string_agg(line, chr(10) order by pos) filter (where not gone) as text,
             count(*) as n_lines, count(*) filter (where gone) as n_dropped from m group by doc_id)
select d.doc_id, coalesce(g.text, case when d.text is null then null else '' end) as text, d.lang, d.source, d.n_chars,
       cast(case when coalesce(d.text, '') = '' then 0 else g.n_lines end as integer) as n_lines,
       cast(coalesce(g.n_dropped, 0) as integer) as n_dropped
from documents d left join g on d.doc_id = g.doc_id
"""


@query("op7_line_frequency", SQL)
def op7_line_frequency(spark, sf):
    return drop_boilerplate(table(spark, sf, "documents"))
