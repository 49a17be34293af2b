"""Source divergence audit: how the term distributions of sources differ.

Within a language each source has a smoothed distribution p over the terms that
the language keeps. The divergence of two sources is the sum over all kept terms
of floor((p - q)^2 / (p + q)), but most terms lie in few sources. So the sum goes by
inclusion and exclusion over the two supports: a term outside a support has the
constant probability z of that source, thus

* terms of one support are priced as if they were outside the other, once for
  each distinct count (a histogram of counts for each source, not its terms),
* terms outside both supports give the same constant, as often as both supports
  leave terms out,
* and terms of both supports, found by a join of postings, get what these two
  prices counted wrongly.

Nothing is made for a term that a source lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Terms are runs of ASCII letters and of characters beyond ASCII; these are
#: the runs between them.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of its language in which a kept term stands, at least.
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
#: Parts of a frequent term's postings meet in tiles of so many sources a side.
TILE = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences) and ``df`` (documents).

    ``docs``: ``lang, source, text``. A text's terms come as two arrays, all and the
    distinct ones, so rows are summed before they are shuffled. The text is split
    between its terms: extracting them would copy it for every match.
    """
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    pattern = BETWEEN.replace("\\", "\\\\")
    both = f"flatten(transform(array(split({lowered}, '{pattern}', -1)), w -> array(named_struct('w', w, 'd', 0L), named_struct('w', array_distinct(w), 'd', 1L))))"
    arrays = docs.select("lang", "source", F.explode(F.expr(both)).alias("b")).select("lang", "source", "b.w", "b.d")
    # A text that begins or ends between terms has an empty part there.
    terms = arrays.select("lang", "source", "d", F.explode("w").alias("term")).where("term <> ''")
    return terms.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("d")).alias("n"), F.sum("d").alias("df"))


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exact for any counts."""
    return F.expr(f"cast(1 + ({SCALE} * (cast({n} as decimal(19, 0)) + 2)) div (cast({total} as decimal(20, 0)) + 2 * cast({kept} as decimal(19, 0))) as bigint)")


def gap(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / (p + q)); both are 1 to SCALE + 1, so it is exact."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int | None = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source).

    Part ``pair``: the other sources of the language by divergence, all of them.
    Part ``term``: the ``top`` (None: all) terms that the source has and holds
    more probable than its language, by their share of the divergence from it.
    Ranks are from 1, by value, then by the item's UTF-8 bytes; ties thus have
    one order. Null text, lang and source count as empty strings; a source
    without terms, or a language without kept ones, has its pairs (of value 0 in
    the latter case) and no terms. Every row is a document, repeated ones too.
    Other columns of ``docs`` are not read, whatever their names. An empty table
    gives no rows. A text's terms stand in memory at once, a few tens of bytes
    for each of its bytes.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = cut(term_counts(plain), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= least_documents).drop("df")
    postings = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    # A language without kept terms has no probabilities: its pairs are 0.
    zero = F.when(F.col("kept") > 0, probability("0", "total", "kept")).otherwise(F.lit(1))
    groups = cut(groups.withColumn("z", zero), "groups")

    priced = postings.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "kept"))
    terms = priced.withColumn("q", probability("lang_n", "lang_total", "kept")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = _ranked(terms)
    if top is not None:
        terms = terms.where(F.col("rank") <= top)

    pairs = _pairs(priced, groups)
    return pairs.unionByName(terms)


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by))


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """All ordered pairs of sources of a language with their divergence."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"), F.col("support").alias("other_support"))
    met = groups.join(other, "lang").where("source <> item")
    side = [F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")]
    # Terms of neither support, as if the supports were disjoint.
    neither = met.where("source < item").select("lang", *side, F.expr(f"(kept - support - other_support) * {gap('z', 'other_z')}").alias("v"))
    # Terms of one support: a row for each distinct count of a source.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one = histogram.join(met.select("lang", "source", "item", "other_z"), ["lang", "source"])
    one = one.groupBy("lang", "source", "item").agg(F.expr(f"sum(m * {gap('p', 'other_z')})").alias("v")).select("lang", *side, "v")
    # Terms of both supports: what the two prices above have wrong.
    tiles = F.greatest(F.lit(1), F.ceil(F.col("of") / TILE)).cast("int")
    sources = groups.groupBy("lang").agg(F.count("*").alias("of"))
    dealt = priced.join(sources, "lang").withColumn("tiles", tiles).withColumn("tile", F.expr("pmod(xxhash64(source), tiles)"))
    left = dealt.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"), F.col("tile").alias("left_tile"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("right_tile"))
    right = dealt.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"), F.col("tile").alias("right_tile"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("left_tile"))
    both = left.join(right, ["lang", "term", "left_tile", "right_tile"]).where("a < b")
    wrong = f"{gap('pa', 'pb')} - {gap('pa', 'zb')} - {gap('za', 'pb')} + {gap('za', 'zb')}"
    both = both.groupBy("lang", "a", "b").agg(F.expr(f"sum({wrong})").alias("v"))
    total = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = total.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return _ranked(rows)


#: The same by pricing every kept term for every pair of sources.
ORACLE = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept k on t.lang = k.lang and t.term = k.term group by 1, 2, 3),
s as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on g.lang = c.lang and g.source = c.source group by 1, 2),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) as p,
        1 + (1000000000::hugeint * (k.n + 2)) // (v.total + 2 * v.v) as q
      from s join kept k on s.lang = k.lang join v on s.lang = v.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from r where part = 'pair' or rank <= 10
"""
