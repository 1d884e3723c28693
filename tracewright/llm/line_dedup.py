"""Line dedup: overlapping windows of consecutive lines, in DataFrame operations only.

Each window of three lines is hashed to 128 bits. A grouped minimum finds every repeated window's first
place, by document id and line; the other places cover their lines, and covered lines are removed. No
line's text is ever lost from the corpus: its earliest place cannot be covered, since the first place of
the covering window would hold it earlier still. A window without a non-blank line (blanks: spaces, tabs,
carriage returns) covers nothing.

Defined results: a null text stays null; texts with fewer than three lines stay as they are; a text whose
lines are all covered becomes empty; rows with the same id and text are one document (all get the same
result), and null ids come first in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_id, _text, _at, _h1, _h2): a row per window; _text tells apart texts under one id."""
    lines = docs.select("_id", F.xxhash64("_line_text").alias("_text"), F.split("_line_text", "\n", -1).alias("_lines"))
    take = ", ".join(f"_lines[i + {k}]" for k in range(size))
    blank = " and ".join(f"btrim(_lines[i + {k}], ' \\t\\r') = ''" for k in range(size))
    made = f"""filter(transform(sequence(0, size(_lines) - {size}), i ->
        if({blank}, null, struct(i as at, xxhash64({take}) as h1, xxhash64({size}, {take}) as h2))), w -> w is not null)"""
    found = lines.where(F.size("_lines") >= size).select("_id", "_text", F.explode(F.expr(made)).alias("w"))
    return found.select("_id", "_text", F.col("w.at").alias("_at"), F.col("w.h1").alias("_h1"), F.col("w.h2").alias("_h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """docs without the lines of later windows; removed_col, if named, gets the number of lines removed."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_line_text"))
    found = windows(source, size)
    place = F.struct("_id", "_text", "_at")
    first = found.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), "_first")
    later = found.join(first, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))).where(~place.eqNullSafe(F.col("_first")))
    covers = later.groupBy(F.col("_id").alias("_cid"), F.col("_text").alias("_ctext")).agg(F.collect_set("_at").alias("_starts"))
    covered = f"flatten(transform(_starts, p -> sequence(p, p + {size - 1})))"
    kept = F.expr(f"array_except(sequence(0, size(split(_own, '\\n', -1)) - 1), {covered})")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(id_col).alias("_oid"), F.col(text_col).cast("string").alias("_own"))
    joined = packed.join(covers, F.col("_oid").eqNullSafe(F.col("_cid")) & (F.xxhash64("_own") == F.col("_ctext")), "left")
    joined = joined.withColumn("_kept", F.when(F.col("_starts").isNotNull(), kept)).withColumn("_split", F.when(F.col("_starts").isNotNull(), F.split("_own", "\n", -1)))
    text = F.when(F.col("_starts").isNull(), F.col("_own")).otherwise(F.array_join(F.transform("_kept", lambda i: F.col("_split")[i]), "\n"))
    columns = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size("_split") - F.size("_kept"), F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*columns)


ORACLE_SQL = """
with lines as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
places as (select doc_id, i, ls[i] as a, ls[i + 1] as b, ls[i + 2] as c from lines, unnest(range(1, len(ls) - 1)) as t(i)),
ranked as (
  select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as n from places
  where trim(a, chr(32) || chr(9) || chr(13)) <> '' or trim(b, chr(32) || chr(9) || chr(13)) <> '' or trim(c, chr(32) || chr(9) || chr(13)) <> ''
),
covered as (select distinct doc_id, i + k as i from ranked, unnest(range(0, 3)) as u(k) where n > 1),
numbered as (select doc_id, j, ls[j] as line from lines, unnest(range(1, len(ls) + 1)) as v(j)),
rest as (
  select n.doc_id, string_agg(n.line, chr(10) order by n.j) filter (where c.i is null) as text, count(c.i) as n_removed
  from numbered n left join covered c on c.doc_id = n.doc_id and c.i = n.j group by n.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(r.text, '') end as text, coalesce(r.n_removed, 0) as n_removed
from documents d left join rest r on r.doc_id = d.doc_id
"""
