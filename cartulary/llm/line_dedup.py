"""Line de-duplication by overlapping three-line windows, native.

Each run of three consecutive lines is hashed; the first occurrence of a
window, by id and position, stays. Later occurrences cover their lines, covers
that touch merge, and covered lines go. Every line that goes stands earlier in
an equal window, so no line of the corpus is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import set_aside


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Replace ``text`` by what remains and add ``n_lines``, ``n_removed`` and
    ``removed`` (merged runs of lines from 0, ``first-last``, comma-joined).

    Lines end at line feeds and are compared exactly. Texts of fewer lines than
    a window, and windows of blank lines only, repeat nothing. A null text
    stays null with ``n_lines`` 0. Rows equal in id and text are one occurrence
    and get the same result. A null id comes before all others. Columns of
    the new names in ``docs`` are replaced, all others stay, whatever their
    names.
    """
    new = ("n_lines", "n_removed", "removed")
    inner, names, back = set_aside(docs, *new)
    base = inner.withColumn("__text", F.col(names[text])).withColumn("__id", F.col(names[id_col]))
    # Rows are told apart by id and two hashes of 64 bits of the text.
    base = base.withColumn("__key", F.struct(F.xxhash64("__text").alias("a"), F.xxhash64(F.lit(1), "__text").alias("b")))

    lines = base.where(f"length(__text) - length(replace(__text, '\\n')) >= {window - 1}")
    lines = lines.select("__id", "__key", F.split("__text", "\n", -1).alias("__l"))
    # Two hashes of 64 bits, so that windows of a huge corpus do not collide.
    part = ", ".join(f"__l[i + {k}]" for k in range(window))
    blank = " and ".join(f"trim(__l[i + {k}]) = ''" for k in range(window))
    made = F.expr(f"transform(sequence(0, size(__l) - {window}), i -> if({blank}, null, named_struct('p', i, 'h', xxhash64({part}), 'g', xxhash64(1, {part}))))")
    spots = lines.select("__id", "__key", F.explode(made).alias("w")).where("w is not null").select("__id", "__key", "w.*")
    spot = F.struct("__id", "__key", "p")
    repeated = spots.groupBy("h", "g").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").drop("last")
    later = spots.join(repeated, ["h", "g"]).where(spot != F.col("first")).select("__id", "__key", "p").distinct()

    by_text = Window.partitionBy("__id", "__key").orderBy("p")
    breaks = F.when(F.col("p") - F.lag("p").over(by_text) <= window, 0).otherwise(1)
    runs = later.withColumn("b", breaks).withColumn("run", F.sum("b").over(by_text))
    runs = runs.groupBy("__id", "__key", "run").agg(F.min("p").alias("s"), (F.max("p") + window - 1).alias("e"))
    cover = runs.groupBy(F.col("__id").alias("__id1"), F.col("__key").alias("__key1")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__cover"))

    out = base.join(cover, F.col("__id").eqNullSafe(F.col("__id1")) & (F.col("__key") == F.col("__key1")), "left")
    # What stands between the covers: from a line, or 0, to the next cover.
    parts = "zip_with(concat(array(0), transform(__cover, c -> c.e + 1)), concat(transform(__cover, c -> c.s), array(size(__all))), (a, b) -> slice(__all, a + 1, b - a))"
    rest = F.expr(f"transform(array(split(__text, '\\n', -1)), __all -> array_join(flatten({parts}), '\\n'))[0]")
    out = out.withColumns(
        {
            "n_lines": F.when(F.col("__text").isNull(), 0).otherwise(F.expr("length(__text) - length(replace(__text, '\\n')) + 1")).cast("long"),
            "n_removed": F.expr("coalesce(aggregate(__cover, 0L, (n, c) -> n + c.e - c.s + 1), 0L)"),
            "removed": F.expr("coalesce(array_join(transform(__cover, c -> concat(c.s, '-', c.e)), ','), '')"),
            names[text]: F.when(F.col("__cover").isNull(), F.col("__text")).otherwise(rest),
        }
    )
    return back(out, *new)


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
s as (select doc_id, text, p, ls[p + 1] as a, ls[p + 2] as b, ls[p + 3] as c
      from (select doc_id, text, ls, unnest(range(0, len(ls) - 2)) as p from l where len(ls) >= 3)),
w as (select * from s where not (trim(a, ' ') = '' and trim(b, ' ') = '' and trim(c, ' ') = '')),
later as (select doc_id, text, p from (select doc_id, text, p, row_number() over (partition by a, b, c order by doc_id, p) as r from w) where r > 1),
gone as (select distinct doc_id, p + k as line from later, (select unnest([0, 1, 2]) as k)),
runs as (select doc_id, line, line - row_number() over (partition by doc_id order by line) as g from gone),
cover as (select doc_id, sum(e - s + 1) as n, string_agg(s || '-' || e, ',' order by s) as removed
          from (select doc_id, g, min(line) as s, max(line) as e from runs group by doc_id, g) group by doc_id),
lines as (select doc_id, unnest(range(0, len(ls))) as line, unnest(ls) as t from l),
rest as (select lines.doc_id, string_agg(t, chr(10) order by lines.line) as t
         from lines left join gone on lines.doc_id = gone.doc_id and lines.line = gone.line where gone.line is null group by lines.doc_id)
select d.doc_id, cast(coalesce(len(l.ls), 0) as bigint) as n_lines, cast(coalesce(cover.n, 0) as bigint) as n_removed, coalesce(cover.removed, '') as removed,
       md5(case when d.text is null then null else coalesce(rest.t, '') end) as text_md5
from documents d left join l on d.doc_id = l.doc_id left join cover on d.doc_id = cover.doc_id left join rest on d.doc_id = rest.doc_id
"""
