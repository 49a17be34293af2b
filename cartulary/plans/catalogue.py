"""Registered queries over the driver's tables and their SQL twins.

The tables stand in for the engine's own: orders and customers for cases,
line items for findings with verdicts, events for ground-truth lines, documents for
source text, a sparse graph over keys for calls, conversations for iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import evidence_strict, f1, ratio, recover_json, tail, truncate
from ..operators import audit, catalogs, curation, graph, joins, runs, scans, scoring
from ..session import TASK_BYTES, parts_for

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    # The setting holds as plans run, so it stays in the session.
    spark.conf.set(*TASK_BYTES)
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- units and relations ------------------------------------------------------

_UNITS_SQL = """(select 'region:' || r_regionkey as id, 'region' as kind, r_name as name from region
  union all select 'nation:' || n_nationkey, 'nation', n_name from nation
  union all select 'customer:' || c_custkey, 'customer', c_name from customer
  union all select 'supplier:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'part:' || p_partkey, 'part', p_name from part)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        part = _t(spark, d, table).select(F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("id"), F.lit(table).alias("kind"), F.col(name).alias("name"), F.lit(False).alias("is_external"))
        out = part if out is None else out.union(part)
    return out


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Customers call suppliers, once for each line item: a multigraph."""
    o, li = _t(spark, d, "orders").select("o_orderkey", "o_custkey"), _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.lit("Calls").alias("kind"), F.lit(None).cast("string").alias("level"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("metadata")
    )


_CALLS_SQL = """(select distinct 'customer:' || o_custkey as src, 'supplier:' || l_suppkey as dst, l_orderkey || '/' || l_linenumber as metadata
  from lineitem join orders on l_orderkey = o_orderkey)"""


def _graph(spark: SparkSession, d: str) -> graph.CodeGraph:
    return graph.CodeGraph(_units(spark, d), _calls(spark, d))


@query(f"select id, name from {_UNITS_SQL} where kind = 'supplier'")
def q_units_by_kind(spark, d):
    return _graph(spark, d).by_kind("supplier").select("id", "name")


@query("select 'functions' as what, c_custkey as id, c_name as name from customer where c_acctbal >= 0 and c_mktsegment <> 'MACHINERY'")
def q_functions(spark, d):
    """Internal functions: external and pseudo functions left out."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("Function").alias("kind"), F.when(F.col("c_mktsegment") == "MACHINERY", "<global>").otherwise(F.col("c_name")).alias("name"), (F.col("c_acctbal") < 0).alias("is_external"))
    return graph.CodeGraph(c, c).functions().select(F.lit("functions").alias("what"), "id", "name")


@query(f"""with u as {_UNITS_SQL}, c as {_CALLS_SQL},
x as (select 'units' as what, kind from u union all select 'edges', 'Calls' from c)
select what, coalesce(kind, 'ALL') as kind, count(*) as n from x group by grouping sets ((what, kind), (what))""")
def q_graph_stats_rollup(spark, d):
    return _graph(spark, d).stats()


@query(f"""with c as {_CALLS_SQL} select src as id, dst as neighbour, count(*) as n from c
where src in (select 'customer:' || c_custkey from customer where c_nationkey = 3) group by src, dst""")
def q_callees(spark, d):
    who = _t(spark, d, "customer").where("c_nationkey = 3").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return _graph(spark, d).callees(who).groupBy("id", "neighbour").agg(F.count("*").alias("n"))


@query(f"""with c as {_CALLS_SQL} select dst as id, src as neighbour, count(*) as n from c
where dst in (select 'supplier:' || s_suppkey from supplier where s_nationkey = 7) group by src, dst""")
def q_callers(spark, d):
    who = _t(spark, d, "supplier").where("s_nationkey = 7").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return _graph(spark, d).callers(who).groupBy("id", "neighbour").agg(F.count("*").alias("n"))


# Users pass from one kind of event to the next; keys modulo make a sparse graph.
_FLOW_SQL = """(select distinct c_custkey as src, (c_custkey * 7 + 3) % (select count(*) from customer) as dst from customer
  union select c_custkey, c_nationkey from customer where c_custkey % 5 = 0)"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    one = c.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % F.lit(c.count())).alias("dst"))
    return one.union(c.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_nationkey").cast("long"))).distinct()


@query(f"""with e as {_FLOW_SQL} select id, neighbour, direction, count(*) as n from (
  select src as id, dst as neighbour, 'out' as direction from e union all select dst, src, 'in' from e) where id % 10 = 1 group by all""")
def q_related_both(spark, d):
    e = _sparse(spark, d).withColumns({"kind": F.lit("Flow")})
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).where("id % 10 = 1")
    return graph.CodeGraph(e, e).related(ids, "Flow", "both").groupBy("id", "neighbour", "direction").agg(F.count("*").alias("n"))


@query(f"""with recursive e as {_FLOW_SQL}, r(seed, node, depth) as (
  select c_custkey, c_custkey, 0 from customer where c_custkey % 100 = 1
  union all select r.seed, e.dst, r.depth + 1 from r join e on r.node = e.src where r.depth < 4)
select seed, node, min(depth) as depth from r where node <> seed group by seed, node""")
def q_reach_bounded(spark, d):
    seeds = _t(spark, d, "customer").where("c_custkey % 100 = 1").select(F.col("c_custkey").alias("id"))
    return graph.reach(_sparse(spark, d), seeds, 4)


@query(f"""with recursive e as {_FLOW_SQL}, r(node, path) as (
  select cast(1 as bigint), [cast(1 as bigint)]
  union all select e.dst, list_append(r.path, e.dst) from r join e on r.node = e.src where len(r.path) < 9 and not list_contains(r.path, e.dst)),
p as (select path from r where node = 80 order by len(path), path limit 1)
select array_to_string(path, '>') as path, len(path) - 1 as hops from p union all select null, null where not exists (select 1 from p)""")
def q_shortest_path(spark, d):
    p = graph.shortest_path(_sparse(spark, d), 1, 80, 8)
    return p.select(F.array_join("path", ">").alias("path"), (F.size("path").cast("long") - 1).alias("hops")).withColumn("hops", F.when(F.col("path").isNotNull(), F.col("hops")))


@query("""with u as (select l_orderkey as file_path, l_suppkey as id, l_linenumber as s, l_linenumber + cast(l_quantity as int) % 5 as e, cast(l_partkey % 7 as int) as subtree from lineitem),
p as (select o_orderkey as place_id, o_orderkey as file_path, 2 as s, 4 as e from orders),
b as (select place_id, u.*, p.s as ps, p.e as pe, u.id as uid from p left join u on p.file_path = u.file_path and u.s <= p.s and u.e >= p.e)
select place_id, uid as id from (select *, row_number() over (partition by place_id order by uid is null, e - s, case when s = ps and e = pe then 0 else 1 end, case when s = ps and e = pe then -subtree else subtree end, uid) as r from b) where r = 1""")
def q_min_covering(spark, d):
    """Places' least covering units."""
    li = _t(spark, d, "lineitem")
    u = li.select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line_start"), F.expr("l_linenumber + cast(l_quantity as int) % 5").alias("line_end"), F.expr("cast(l_partkey % 7 as int)").alias("subtree"))
    places = _t(spark, d, "orders").select(F.col("o_orderkey").alias("place_id"), F.col("o_orderkey").alias("file_path"), F.lit(2).alias("line_start"), F.lit(4).alias("line_end"))
    return graph.CodeGraph(u, u).minimal_covering(places)


@query(f"""with e as {_FLOW_SQL}, u as (select c_custkey as src, c_nationkey as dst, case when c_custkey % 2 = 0 then 'add_edge' else 'remove_edge' end as op from customer where c_custkey % 3 = 0)
select src, dst from e where not exists (select 1 from u where u.src = e.src and u.dst = e.dst) union select src, dst from u where op = 'add_edge'""")
def q_edge_facts_apply(spark, d):
    c = _t(spark, d, "customer").where("c_custkey % 3 = 0")
    op = F.expr("case when c_custkey % 2 = 0 then 'add_edge' else 'remove_edge' end")
    late = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), op.alias("operation"), F.lit(2).alias("seq"))
    early = late.withColumn("operation", F.lit("add_edge")).withColumn("seq", F.lit(1))
    return graph.apply_updates(_sparse(spark, d), early.unionByName(late)).select("src", "dst")


@query("""with f as (select c_custkey as unit_id, c_mktsegment as fact_class, c_name as summary from customer where c_acctbal > 5000)
select fact_class, count(*) as n, count(distinct unit_id) as units from f group by fact_class""")
def q_unit_facts(spark, d):
    c = _t(spark, d, "customer")
    facts = c.where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("unit_id"), F.col("c_mktsegment").alias("fact_class"), F.lit("s").alias("name"), F.col("c_name").alias("summary"), F.lit("{}").alias("details"))
    g = graph.CodeGraph(c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("customer").alias("kind")), None).add_unit_facts(facts)
    return g.unit_facts.groupBy("fact_class").agg(F.count_distinct("fact_id").alias("n"), F.count_distinct("unit_id").alias("units"))


# -- scans --------------------------------------------------------------------

_SINKS = ("the", "de", "und.der")


@query("""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as code from documents),
u as (select doc_id, line, code, lower(regexp_extract(code, '^([A-Za-z]+)', 1)) as name, lower(code) as low from l),
c as (select 'the' as api, 'the' as t union all select 'de', 'de' union all select 'und.der', 'der')
select doc_id, line, api as sink_api from u join c on u.name = c.t where starts_with(low, api) and not regexp_matches(substr(low, length(api) + 1, 1), '[A-Za-z0-9_]')""")
def q_sink_scan(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line_text"))
    units = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.lit("Call").alias("kind"), F.lower(F.regexp_extract("line_text", "^([A-Za-z]+)", 1)).alias("name"), F.lower("line_text").alias("code"))
    catalog = spark.createDataFrame([("sink", i, s) for i, s in enumerate(_SINKS)], "role string, pos int, pattern string")
    return scans.sink_calls(units, catalog).select("doc_id", "line", "sink_api")


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
f as (select item_id, item_id as doc_id, 2 as s, 3 as e from benchmark)
select item_id, coalesce(array_to_string(list_transform(range(greatest(s - 2, 1), least(e + 2, len(ls)) + 1), lambda i: lpad(cast(i as varchar), 5, ' ') || '| ' || ls[i]), chr(10)), '') as context from f left join l on f.doc_id = l.doc_id""")
def q_context_window(spark, d):
    findings = _t(spark, d, "benchmark").select("item_id", F.col("item_id").alias("file_path"), F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("file_path"), "text")
    return scans.context(findings, files, 2).select("item_id", F.col("surrounding_context").alias("context"))


@query("""with p as (select item_id, array_to_string(list_slice(string_split(text, ' '), 3, 4), ' ') || ' ' as e from benchmark)
select item_id, count(*) filter (length(trim(e, ' ')) >= 2 and contains(text, ' ' || e)) as strict from p, documents group by item_id""")
def q_evidence_brake(spark, d):
    """Items' two words, found strictly in documents (P07). A word between spaces is
    a word of the text as well, so texts and items meet on it before the whole
    evidence is looked for."""
    p = _t(spark, d, "benchmark").withColumn("w", F.split("text", " ", -1))
    p = p.select("item_id", F.concat(F.lit(" "), F.array_join(F.slice("w", 3, 2), " "), F.lit(" ")).alias("e"), F.get("w", F.lit(2)).alias("word"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    near = words.join(p, "word").select("doc_id", "item_id", "e")
    hits = docs.join(near, "doc_id").where(F.col("text").contains(F.col("e")) & evidence_strict("e", "text"))
    return p.join(hits.groupBy("item_id").agg(F.count("*").alias("strict")), "item_id", "left").select("item_id", F.coalesce("strict", F.lit(0)).alias("strict"))


_FINDINGS_SQL = """(select o_custkey as c, cast(extract(year from o_orderdate) % 4 as int) as k, l_linenumber as line, l_partkey % 3 as f, l_orderkey as ok, l_suppkey as sk, l_extendedprice as x,
  case l_returnflag when 'A' then 'true_positive' when 'R' then 'false_positive' else 'uncertain' end as verdict, l_linestatus = 'F' as snip from lineitem join orders on l_orderkey = o_orderkey)"""
_TRUTH_SQL = "(select distinct o_custkey as c, [2, 7] as lines, case when o_custkey % 10 = 0 then null else 0 end as gf from orders where o_custkey % 2 = 0)"
_LABEL_SQL = f"""(select f.*, t.lines, case when t.gf = f.f then list_filter(t.lines, lambda v: abs(v - f.line) <= 1)[1] end as g from {_FINDINGS_SQL} f left join {_TRUTH_SQL} t on f.c = t.c)"""
_LABEL_CASE = """case when verdict = 'false_positive' and g is null then 'tn' when verdict = 'false_positive' then 'fn_by_llm' when verdict = 'true_positive' and not snip then 'fp_by_hallucinated_source'
  when verdict = 'true_positive' and g is not null then 'tp' when verdict = 'true_positive' then 'fp_by_llm_overclaim' when g is not null then 'uncertain_on_gt' else 'uncertain_off_gt' end"""


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, verdicts and ground truth from line items and orders."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") % 4).alias("k"))
    found = _t(spark, d, "lineitem")
    parts_for(spark, found.count())
    # Made before the join, so the columns of the index are not shuffled.
    index = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = found.withColumn("finding_index", index).withColumn("file", F.col("l_partkey") % 3)
    li = found.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(
        F.col("o_custkey").alias("case_id"), "k", "finding_index", F.concat(F.lit("src/f"), "file").alias("file_path"), F.col("l_linenumber").alias("line_start"),
        F.when(F.col("l_linestatus") == "F", "source(x)").otherwise("other(y)").alias("surrounding_context"), F.lit("").alias("code_snippet"), F.lit(None).cast("string").alias("structural_evidence"),
        F.when(F.col("l_returnflag") == "A", "true_positive").when(F.col("l_returnflag") == "R", "false_positive").otherwise("neither").alias("verdict"), "l_extendedprice",
    )
    triage = rows.select("case_id", "k", "finding_index", "verdict", F.lit("source(x)").alias("source_expr"))
    truth = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("case_id")).distinct()
    # A file that is not known is an empty one, and matches no path.
    truth = truth.select("case_id", F.when(F.col("case_id") % 10 == 0, "").otherwise("f0").alias("gt_file"), F.array(F.lit(2), F.lit(7)).alias("gt_lines"))
    return rows, triage, truth


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts sit beside their findings here, so no join aligns them."""
    rows, _, truth = _findings(spark, d)
    found = scoring.match_truth(rows, truth, ["case_id"], 1)
    verdict = F.when(F.col("verdict").isin(*scoring.VERDICTS), F.col("verdict")).otherwise("uncertain")
    snippet = F.col("surrounding_context").contains("source(x)")
    found = found.withColumn("verdict", verdict).withColumn("label", scoring.label(F.col("verdict"), F.col("gt_line").isNotNull(), snippet))
    return found, truth


@query(f"""with l as (select *, {_LABEL_CASE} as label from {_LABEL_SQL}),
s as (select c, k, count(*) filter (label = 'tp') as tp, count(*) filter (label in ('fp_by_hallucinated_source', 'fp_by_llm_overclaim')) as fp, count(*) filter (label = 'fn_by_llm') as fn_by_llm,
  count(*) filter (label = 'fp_by_hallucinated_source') as fp_by_hallucinated_source, count(*) filter (label = 'uncertain_on_gt') as uncertain_on_gt, count(*) filter (label = 'uncertain_off_gt') as uncertain_off_gt,
  cast(coalesce(len(any_value(lines)), 0) - count(distinct case when label = 'tp' then g end) as bigint) as fn from l group by c, k),
p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as "precision", case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from s)
select c as case_id, k, tp, fp, fn_by_llm, fp_by_hallucinated_source, uncertain_on_gt, uncertain_off_gt, fn, round("precision", 6) as "precision", round(recall, 6) as recall,
  round(case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end, 6) as f1 from p""")
def q_label_matrix(spark, d):
    labelled, truth = _labelled(spark, d)
    out = scoring.iteration_scores(labelled, truth)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""with l as (select *, {_LABEL_CASE} as label from {_LABEL_SQL}),
c as (select case when label = 'fp_by_hallucinated_source' then 'evidence_hallucination' when label = 'fp_by_llm_overclaim' or verdict = 'true_positive' then 'triager_overclaim' when starts_with(label, 'uncertain_') then 'uncertain_unscored' else '' end as cause from l)
select cause, count(*) as n from c group by cause""")
def q_fp_causes(spark, d):
    labelled, _ = _labelled(spark, d)
    cause = scoring.fp_cause(F.col("label"), F.col("verdict"), F.lit(None).cast("boolean"), F.lit(False))
    return labelled.select(cause.alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


@query(f"""with l as (select *, {_LABEL_CASE} as label from {_LABEL_SQL}),
g as (select c, gf, unnest([2, 7]) as line from {_TRUTH_SQL}),
a as (select g.c, g.line, bool_or(l.label = 'tp') as hit, bool_or(l.label = 'fn_by_llm' or l.verdict = 'false_positive') as sup, bool_or(l.label = 'fp_by_hallucinated_source') as hal
  from g left join l on l.c = g.c and l.f = g.gf and abs(l.line - g.line) <= 1 group by g.c, g.line)
select case when sup then 'triager_suppressed_gt' when hal then 'hallucinated_source_on_gt' else 'joern_candidate_missing' end as cause, count(*) as n from a where not coalesce(hit, false) group by 1""")
def q_fn_causes(spark, d):
    labelled, truth = _labelled(spark, d)
    lines = truth.select(F.col("case_id").alias("c"), F.col("gt_file").alias("f"), F.explode("gt_lines").alias("gt"))
    both = lines.join(labelled, (F.col("c") == F.col("case_id")) & (tail("file_path", "/") == F.col("f")) & (F.abs(F.col("line_start") - F.col("gt")) <= 1), "left")
    agg = both.groupBy("c", "gt").agg(F.collect_set("label").alias("labels"), F.collect_set("verdict").alias("verdicts")).where("not array_contains(labels, 'tp')")
    return agg.select(scoring.fn_cause(F.lit(False), F.col("labels"), F.col("verdicts")).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


_HOUR = "cast(floor(epoch(ts) / 3600) as bigint)"


@query(f"""with h as (select distinct user_id, {_HOUR} as line from events), b as (select *, case when line - lag(line) over (partition by user_id order by line) <= 8 then 0 else 1 end as x from h),
r as (select *, sum(x) over (partition by user_id order by line rows between unbounded preceding and current row) as cluster from b)
select user_id, cast(cluster as int) as cluster, min(line) as start, max(line) as "end" from r group by user_id, cluster""")
def q_gt_clusters(spark, d):
    lines = _t(spark, d, "events").select("user_id", F.expr("cast(floor(unix_timestamp(ts) / 3600) as bigint)").alias("line"))
    return scoring.clusters(lines, ["user_id"])


_REL = f"""gt as (select distinct user_id, {_HOUR} - 473000 as line from events where event_type = 'purchase'),
b as (select *, case when line - lag(line) over (partition by user_id order by line) <= 8 then 0 else 1 end as x from gt),
r as (select *, sum(x) over (partition by user_id order by line rows between unbounded preceding and current row) as cluster from b),
cl as (select user_id, cluster, min(line) as s, max(line) as e from r group by user_id, cluster),
rows as (select event_id, user_id, {_HOUR} - 473000 as line, case event_id % 3 when 0 then 'true_positive' when 1 then 'uncertain' else 'false_positive' end as verdict, case when event_id % 7 = 0 then 'fp_by_hallucinated_source' else '' end as label, event_id % 5 <> 0 as src from events),
hunk as (select user_id, {_HOUR} - 473000 as s, {_HOUR} - 473000 + 2 as e from events where event_type = 'error')"""


@query(f"""with {_REL},
m as (select rows.*, (select min(cluster) from cl where cl.user_id = rows.user_id and rows.line between cl.s - 5 and cl.e + 5) as idx, exists (select 1 from hunk where hunk.user_id = rows.user_id and rows.line between hunk.s and hunk.e) as hk from rows),
k as (select *, case when label <> '' or verdict = 'true_positive' and not src then 'fp' when verdict = 'true_positive' and (idx is not null or hk) then 'tp' when verdict = 'true_positive' then 'fp' when verdict = 'uncertain' and idx is not null then 'uncertain' end as kind from m),
a as (select user_id, count(*) filter (kind = 'tp') as tp, count(*) filter (kind = 'fp') as fp, count(distinct case when kind = 'tp' then idx end) as covered from k group by user_id),
u as (select user_id, count(distinct idx) as credits from k where kind = 'uncertain' and not exists (select 1 from k k2 where k2.user_id = k.user_id and k2.kind = 'tp' and k2.idx = k.idx) group by user_id),
n as (select user_id, count(*) as clusters from cl group by user_id)
select a.user_id as case_id, coalesce(n.clusters, 0) as clusters, a.tp, a.fp, coalesce(n.clusters, 0) - a.covered as fn, coalesce(u.credits, 0) as credits, a.tp + coalesce(u.credits, 0) as uncertain_tp, coalesce(n.clusters, 0) - a.covered - coalesce(u.credits, 0) as uncertain_fn
from a left join u on a.user_id = u.user_id left join n on a.user_id = n.user_id""")
def q_relaxed_score(spark, d):
    ev = _t(spark, d, "events").select("event_id", F.col("user_id").alias("case_id"), "event_type", F.expr("cast(floor(unix_timestamp(ts) / 3600) as bigint) - 473000").alias("line"))
    gt = scoring.clusters(ev.where("event_type = 'purchase'"), ["case_id"]).withColumn("gt_file", F.lit("a/f.py"))
    verdict = F.expr("case event_id % 3 when 0 then 'true_positive' when 1 then 'uncertain' else 'false_positive' end")
    rows = ev.select(F.col("event_id").alias("row_id"), "case_id", F.lit("f.py").alias("file"), "line", verdict.alias("verdict"), F.expr("if(event_id % 7 = 0, 'fp_by_hallucinated_source', '')").alias("label"), (F.col("event_id") % 5 != 0).alias("source_in_snippet"))
    hunks = ev.where("event_type = 'error'").select("case_id", F.lit("f.py").alias("path"), F.col("line").alias("start"), (F.col("line") + 2).alias("end"))
    return scoring.relaxed_scores(rows, gt, hunks, ["case_id"])


@query("""with l as (select l_orderkey, l_linenumber, l_suppkey from lineitem), o as (select o_orderkey, 4 as gt from orders)
select o_orderkey, arg_min(struct_pack(n := l_linenumber, s := l_suppkey), row(abs(l_linenumber - gt), l_suppkey, l_linenumber)).n as near_line, arg_min(l_suppkey, row(abs(l_linenumber - gt), l_suppkey, l_linenumber)) as near_supp from o left join l on o_orderkey = l_orderkey group by o_orderkey""")
def q_nearest_row(spark, d):
    """The nearest row of each order; equally near ones of one tie: the earlier."""
    left = _t(spark, d, "orders").select("o_orderkey", F.lit(4).alias("gt"))
    right = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_suppkey").alias("x"), F.col("l_linenumber").alias("near_line"), F.col("l_suppkey").alias("near_supp")).drop("x")
    near = joins.nearest_row(left, right, ["o_orderkey"], "gt", "near_line", "near_supp")
    return near.select("o_orderkey", "near_line", "near_supp")


# -- findings -----------------------------------------------------------------


def flow_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as flows; arrivals are places in the order of the whole table."""
    li = _t(spark, d, "lineitem")
    kind = F.expr("case cast(l_quantity as int) % 4 when 0 then 'direct_sink' when 1 then 'def_use' when 2 then ' Relaxed ' else 'bogus' end")
    # Arrivals over the whole table come from counts by order, not from one sort.
    starts = joins.running(li.groupBy("l_orderkey").agg(F.count("*").alias("c")), "l_orderkey", "c", "at")
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    return li.withColumn("r", r).join(starts.select("l_orderkey", "at"), "l_orderkey").select(
        F.col("l_orderkey").alias("sink_file"), F.col("l_linenumber").cast("string").alias("sink_line"), F.lit("s").alias("sink_name"), F.lit("s( x )").alias("sink_code"), F.lit("f").alias("source_file"), F.lit("1").alias("source_line"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("src"), F.col("l_suppkey") % 11)).alias("source_code"), kind.alias("recovery_kind"), (F.col("at") + F.col("r")).alias("arrival"),
    )


@query("""with f as (select l_orderkey as sf, l_linenumber as sl, cast(l_quantity as int) % 4 as kq, l_suppkey, l_partkey, l_orderkey::bigint * 1000000 + l_suppkey * 100 + l_partkey % 100 as arr, l_extendedprice as px from lineitem),
g as (select *, case kq when 0 then 'direct_sink' when 1 then 'def_use' when 2 then 'relaxed' else 'bogus' end as k0 from f),
h as (select sf, sl, case when k0 = 'bogus' then 'taint' else k0 end as kind, case k0 when 'bogus' then 4 when 'relaxed' then 3 when 'def_use' then 2 else 1 end as pri, row_number() over (order by sf, sl, l_suppkey, l_partkey, px) as a, case when l_suppkey % 11 = 0 then '' else 'src' || l_suppkey % 11 end as code from g),
s as (select sf, sl, arg_max(kind, row(pri, -a)) as recovery_kind, arg_max(code, row(pri, -a)) as source_code, count(*) as dedup_count, min(a) as first_arrival, array_to_string(list_sort(list(distinct kind)), ',') as kinds from h group by sf, sl),
d as (select sf, sl, code, min(a) as a from h where code <> '' group by sf, sl, code), e as (select sf, sl, string_agg(code, ',' order by a) as sources from (select *, row_number() over (partition by sf, sl order by a) as r from d) where r <= 8 group by sf, sl)
select s.sf as sink_file, s.sl as sink_line, s.recovery_kind, s.source_code, s.dedup_count, s.first_arrival, s.kinds, coalesce(e.sources, '') as sources, case when s.recovery_kind = 'taint' then 'joern-taint-reachability' else 'joern-' || s.recovery_kind || '-recovery' end as rule_id,
  case when s.source_code = '' then 'Direct sink call: s( x )' else 'Taint flow: ' || s.source_code || ' -> s( x )' end as message from s left join e on s.sf = e.sf and s.sl = e.sl""")
def q_flow_dedup(spark, d):
    out = audit.dedup_flows(flow_rows(spark, d))
    return out.select("sink_file", "sink_line", "recovery_kind", "source_code", "dedup_count", "first_arrival", F.array_join("recovery_kinds_seen", ",").alias("kinds"), F.array_join("dedup_sources", ",").alias("sources"), "rule_id", "message")


@query("""select user_id, substr(sha256(string_agg(event_type || '|' || event_id, chr(10) order by event_type || '|' || event_id)), 1, 16) as fingerprint from events group by user_id""")
def q_findings_fingerprint(spark, d):
    return audit.fingerprint(_t(spark, d, "events").withColumn("v", F.concat_ws("|", "event_type", "event_id")), ["user_id"], "v")


@query("""with j as (select d.lang as arm, quality, toxic from documents d join labels l on d.doc_id = l.doc_id),
s as (select coalesce(arm, 'ALL') as arm, cast(count(*) filter (quality = 1 and toxic = 0) as bigint) as tp, cast(count(*) filter (quality = 1 and toxic = 1) as bigint) as fp, cast(count(*) filter (quality = 0) as bigint) as fn from j group by rollup (arm)),
p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from s)
select arm, tp, fp, fn, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from p""")
def q_micro_prf(spark, d):
    j = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("arm")).join(_t(spark, d, "labels"), "doc_id")
    rows = j.select("arm", F.expr("int(quality = 1 and toxic = 0)").alias("tp"), F.expr("int(quality = 1 and toxic = 1)").alias("fp"), F.expr("int(quality = 0)").alias("fn"))
    return scoring.micro_prf(rows).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""with l as (select * from {_LABEL_SQL}) select 'a' as arm, k, verdict, count(*) filter (g is not null) as yes, count(*) filter (g is null) as no from l group by k, verdict""")
def q_verdict_contingency(spark, d):
    labelled, _ = _labelled(spark, d)
    rows = labelled.select(F.lit("a").alias("arm"), "k", "verdict", F.when(F.col("gt_line").isNotNull(), "yes").otherwise("no").alias("gt_match"))
    return scoring.verdict_contingency(rows)


@query("""select conv_id, cast(sum(case when role = 'user' then length(text) else 0 end) as bigint) as triage, cast(sum(case when role <> 'user' then length(text) else 0 end) as bigint) as refine, cast(sum(length(text)) as bigint) as total from conversations group by conv_id""")
def q_token_rollup(spark, d):
    c = _t(spark, d, "conversations")
    n, user = F.length("text").cast("long"), F.col("role") == "user"
    rows = c.select("conv_id", F.when(user, n).otherwise(0).alias("llm_tokens_triage"), F.when(user, 0).otherwise(n).alias("llm_tokens_refinement"))
    return runs.token_rollup(rows, "conv_id")


@query("""with p as (select event_id, event_type as v from events where event_id % 3 <> 0), q as (select event_id, upper(event_type) as v from events where event_id % 2 = 0)
select coalesce(q.event_id, p.event_id) as event_id, coalesce(q.v, p.v) as v, case when q.event_id is null then 'prior' when p.event_id is null then 'appended' else 'replaced' end as origin from p full join q on p.event_id = q.event_id""")
def q_merge_runs(spark, d):
    ev = _t(spark, d, "events")
    prior = ev.where("event_id % 3 <> 0").select("event_id", F.col("event_type").alias("v"), F.col("event_id").alias("pos"))
    rerun = ev.where("event_id % 2 = 0").select("event_id", F.upper("event_type").alias("v"), F.col("event_id").alias("pos"))
    return joins.overlay(prior, rerun, "event_id").select("event_id", "v", "origin")


@query("""with r as (select o_custkey, max(case when o_orderstatus = 'P' then 1 else 0 end) as t from orders group by o_custkey)
select c_custkey, case when t = 1 then 'timeout' else 'missing' end as why from customer left join r on c_custkey = o_custkey where t is null or t = 1""")
def q_missing_targets(spark, d):
    planned = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("pos"))
    results = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("skipped"))
    targets = runs.rerun_targets(planned, results, "c_custkey")
    there = results.groupBy("c_custkey").agg(F.lit("timeout").alias("why"))
    return targets.join(there, "c_custkey", "left").select("c_custkey", F.coalesce("why", F.lit("missing")).alias("why"))


@query("""select (select count(*) from customer) as planned, count(*) as rows, count(*) filter (s is null) as "full", count(*) filter (s is not null) as timeout, (select count(*) from customer) - count(*) as missing
from (select o_custkey, max(case when o_orderstatus = 'P' then 'timeout' end) as s from orders where o_custkey in (select c_custkey from customer) group by o_custkey)""")
def q_coverage(spark, d):
    planned = _t(spark, d, "customer").select("c_custkey")
    results = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("skipped"))
    return runs.coverage(planned, results, "c_custkey")


@query("select l_suppkey as case_id, count(*) as \"count\" from lineitem where l_returnflag = 'R' group by l_suppkey order by count(*) desc, l_suppkey limit 10")
def q_top_cases(spark, d):
    return audit.top_cases(_t(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "case_id"), "case_id")


@query("""with h as (select distinct array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.')), '.') as p from pages),
u as (select p, string_split(p, '.') as parts from h where p <> ''),
a as (select distinct array_to_string(list_slice(parts, 1, n), '.') as p from (select parts, unnest(range(1, len(parts))) as n from u)),
c as (select p from u union select p from a)
select case when length(c.p) % 2 = 0 then ' ..' || c.p else c.p end as pattern, case when c.p in (select p from u) then 'equals_sink' when c.p in (select p from a) then 'ancestor_of_sink' end as reason from c""")
def q_catalog_clean(spark, d):
    """Hosts as dotted paths: each is a sink, and each with its ancestors a source,
    some of them behind a blank and dots, which do not count."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    sinks = _t(spark, d, "pages").select(F.array_join(F.reverse(F.split(host, "[.]", -1)), ".").alias("pattern")).where("pattern <> ''").distinct()
    up = catalogs.ancestors(sinks, "pattern").select(F.col("ancestor").alias("pattern")).distinct()
    dotted = F.when(F.length("pattern") % 2 == 0, F.concat(F.lit(" .."), "pattern")).otherwise(F.col("pattern"))
    sources = sinks.union(up).distinct().select(F.lit("source").alias("role"), F.lit(0).alias("pos"), dotted.alias("pattern"))
    _, dropped = catalogs.cleaned(sources.unionByName(sinks.select(F.lit("sink").alias("role"), F.lit(0).alias("pos"), "pattern")), [], bound=1.0)
    return dropped.where("role = 'source'").select("pattern", "reason")


_SIGNALS = "'python', 'pypi', 'pip install', '.py', 'django', 'flask', 'fastapi', 'ansible', 'salt', 'celery', 'scrapy', 'paramiko'"


@query(f"""with a as (select page_id, lower(html) as html, url, case page_id % 4 when 0 then 'https://github.com/o/r/pull/1' when 1 then 'see github.com/o/salt/commit/abc' when 2 then 'https://github.com/o/r/issues/1' else '' end as ref from pages)
select page_id from a where contains(html, 'the') and (url like '%.org%' or regexp_matches(ref, 'github\\.com/[^/]+/[^/]+/(commit|pull)/') and len(list_filter([{_SIGNALS}], lambda s: contains(html || ' ' || lower(url) || ' ' || ref, s))) > 0)""")
def q_advisory_filter(spark, d):
    """Pages as advisories: by ecosystem, or by a signal anywhere and a link."""
    p = _t(spark, d, "pages")
    rows = p.select("page_id", F.array(F.when(F.lower("html").contains("the"), "CWE-78").otherwise("CWE-0")).alias("cwes"), F.array(F.when(F.col("url").like("%.org%"), "PyPI").otherwise("npm")).alias("ecosystems"), F.col("html").alias("description"), F.array("url", F.expr("case page_id % 4 when 0 then 'https://github.com/o/r/pull/1' when 1 then 'see github.com/o/salt/commit/abc' when 2 then 'https://github.com/o/r/issues/1' else '' end")).alias("references"))
    return curation.advisory_filter(rows).select("page_id")


@query("""select case when n_chars < 100 then '<100' when n_chars < 500 then '100-499' when n_chars < 2000 then '500-1999' else '>=2000' end as bin, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents group by 1""")
def q_loc_bins(spark, d):
    return _t(spark, d, "documents").groupBy(curation.loc_bin("n_chars").alias("bin")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""with c as (select n_chars as v, count(*) as c from documents group by 1), u as (select v, sum(c) over (order by v) as upto from c), t as (select count(*) as n, min(n_chars) as least, max(n_chars) as most, cast(sum(n_chars) // count(*) as bigint) as mean from documents)
select n, least, most, (select min(v) from u where upto > n // 2) as median, mean from t""")
def q_length_summary(spark, d):
    return curation.length_summary(_t(spark, d, "documents"), "n_chars")


@query("""select event_id, json_extract_string(props, '$.k') as k from events where event_id % 2 = 0 union all select event_id, json_extract_string(props, '$.k') from events where event_id % 2 = 1""")
def q_json_recover(spark, d):
    """A field from strict JSON, from a fenced block, and from broken JSON."""
    ev = _t(spark, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("oops "), F.regexp_replace("props", "}$", ",")))
    return ev.select("event_id", recover_json(text, "k").alias("k"))


@query("""with s as (select l_suppkey as cid, cast(extract(year from l_shipdate) % 4 as int) as k, l_returnflag = 'A' as t, l_linestatus = 'F' as a from lineitem),
x as (select cid, k, count(*) filter (t and a) - count(*) filter (t and not a) as d from s group by cid, k), y as (select *, abs(d) as m from x where d <> 0),
r as (select *, avg(rn) over (partition by k, m) as rk from (select *, row_number() over (partition by k order by m) as rn from y)),
t as (select k, sum(c * c * c - c) as ties from (select k, m, count(*) as c from y group by k, m) group by k),
w as (select k, count(*) as n, sum(case when d > 0 then rk else 0 end) as w_plus, sum(case when d < 0 then rk else 0 end) as w_minus from r group by k),
z as (select w.*, abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) as z from w join t on t.k = w.k)
select k, n, w_plus, w_minus, round((select sum(exp(-pow(z + (i + 0.5) * 0.001, 2) / 2) * 0.001) from generate_series(0, 11999) s(i)) * 2 / sqrt(2 * pi()), 5) as p_normal from z""")
def q_signed_rank(spark, d):
    s = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("cid"), (F.year("l_shipdate") % 4).alias("k"), (F.col("l_returnflag") == "A").alias("t"), (F.col("l_linestatus") == "F").alias("a"))
    x = s.groupBy("cid", "k").agg(F.count_if(F.col("t") & F.col("a")).alias("one"), F.count_if(F.col("t") & ~F.col("a")).alias("two"))
    found = scoring.signed_rank(x, "one", "two")
    return found.select("k", "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), F.round("p_normal", 5).alias("p_normal"))


@query("""with c as (select n_nationkey as n, n_regionkey as k, (select count(*) from customer where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING') - (select count(*) from customer where c_nationkey = n_nationkey and c_mktsegment = 'MACHINERY') as d from nation),
y as (select *, abs(d) as m from c where d <> 0), r as (select *, row_number() over (partition by k order by m, n) - 1 as i, avg(rn) over (partition by k, m) as rk from (select *, row_number() over (partition by k order by m) as rn from y)),
w as (select k, count(*) as n, least(sum(case when d > 0 then rk else 0 end), sum(case when d < 0 then rk else 0 end)) as w from r group by k),
s as (select w.k, m.i, sum(case when (m.i >> r.i) & 1 = 1 then r.rk else 0 end) as x from w cross join (select unnest(range(0, 1024)) as i) m join r on r.k = w.k where m.i < (1 << w.n) group by 1, 2)
select w.k, w.n, cast(w.w as double) as w, least(1.0, 2.0 * count(*) filter (s.x <= w.w) / count(*)) as p from w join s on s.k = w.k group by 1, 2, 3""")
def q_signed_rank_exact(spark, d):
    """Building against machinery customers of each region's nations: the p of few
    pairs is counted out (A35)."""
    c = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("one"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("two"))
    x = _t(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").na.fill(0).withColumn("k", F.col("n_regionkey"))
    return scoring.signed_rank(x, "one", "two").select("k", "n", F.col("w").cast("double").alias("w"), "p")


@query("""with s as (select l_suppkey as c, cast(extract(year from l_shipdate) % 4 as int) as k, count(*) filter (l_returnflag = 'A') as tp, count(*) filter (l_returnflag = 'R') as fp, count(*) filter (l_returnflag = 'N') as fn from lineitem group by 1, 2),
p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from s)
select 'a' as arm, k, count(*) as n, round(avg(case when c > 0 then fp * 1000.0 / (c * 10) else 0 end), 6) as mean_fp_per_kloc, round(avg(case when tp > 0 then 1.0 else 0.0 end), 6) as detection_rate, round(avg(c * 0.5), 6) as mean_time_s, round(avg(c * 3), 6) as mean_tokens, round(avg(p), 6) as mean_precision, round(avg(r), 6) as mean_recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 6) as mean_f1 from p group by k""")
def q_macro_scores(spark, d):
    s = _t(spark, d, "lineitem").groupBy("l_suppkey", (F.year("l_shipdate") % 4).alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("tp"), F.count_if(F.col("l_returnflag") == "R").alias("fp"), F.count_if(F.col("l_returnflag") == "N").alias("fn"))
    s = s.withColumns({"arm": F.lit("a"), "loc": F.col("l_suppkey") * 10, "time_s": F.col("l_suppkey") * 0.5, "tokens": F.col("l_suppkey") * 3})
    out = scoring.macro_scores(scoring.with_prf(s))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("mean_", "detection"))})


@query("""select l_orderkey, string_agg(l_returnflag || ':' || n, ';' order by l_returnflag || ':' || n) as kinds from (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all) group by l_orderkey""")
def q_kind_counts(spark, d):
    return audit.kind_counts(_t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""select event_id, case when event_type = 'purchase' and value < 50 then 'uncertain' when event_type = 'purchase' then 'true_positive' when event_type = 'error' then 'false_positive' else 'uncertain' end as verdict,
case when event_type = 'purchase' and value < 50 then 'source_expr_not_in_snippet' when event_type = 'error' and value < 50 then 'sink_expr_not_in_snippet' else '' end as downgrade_reason from events""")
def q_triage_brakes(spark, d):
    ev = _t(spark, d, "events")
    verdict = F.when(F.col("event_type") == "purchase", "true_positive").when(F.col("event_type") == "error", "false_positive").otherwise("what")
    rows = ev.select("event_id", verdict.alias("verdict"), F.lit("x").alias("confidence"), (F.col("value") >= 50).alias("source_in_snippet"), (F.col("value") >= 50).alias("sink_in_snippet"))
    return scoring.triage_brakes(rows).select("event_id", "verdict", "downgrade_reason")


@query("""select item_id, case when length(text) > 240 then substr(text, 1, 237) || '...' else text end as shown from benchmark""")
def q_truncate(spark, d):
    return _t(spark, d, "benchmark").select("item_id", truncate("text").alias("shown"))


@query("""with recursive g as (select n, a, (n + a - 1) // a as b from (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as a from supplier)),
x as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as z from supplier),
w(z, i, l, r) as (select z, 0, z // b, z % b from x, g union all
  select z, i + 1, case when i % 2 = 0 then (l + ('0x' || substr(md5('235711|' || i % 8 || '|' || r), 1, 12))::bigint) % a else l end, case when i % 2 = 1 then (r + ('0x' || substr(md5('235711|' || i % 8 || '|' || l), 1, 12))::bigint) % b else r end
  from w, g where not (i > 0 and i % 8 = 0 and l * b + r < n)),
p as (select z, l * b + r as place from w, g where i > 0 and i % 8 = 0 and l * b + r < n)
select s_suppkey, place < least(n - 1, greatest(1, ceil(n * 0.25))) as train, case when place < least(n - 1, greatest(1, ceil(n * 0.25))) then place end as train_pos from x join p on x.z = p.z, g""")
def q_seeded_split(spark, d):
    """Train and validation suppliers by a seeded permutation of their places."""
    cases = _t(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("pos"))
    train, validate = runs.split(cases, "s_suppkey")
    return train.select("s_suppkey", F.lit(True).alias("train"), "train_pos").unionByName(validate.select("s_suppkey", F.lit(False).alias("train"), F.lit(None).cast("long").alias("train_pos")))


@query("""with x as (select o_custkey as c, count(*) as tp, count(*) filter (o_orderstatus = 'F') as fp from orders group by 1) select c, tp, fp, round(tp / (tp + fp), 6) as p, round(2 * (tp / (tp + fp)) * 1.0 / ((tp / (tp + fp)) + 1.0), 6) as f1 from x""")
def q_guarded_ratio(spark, d):
    x = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("tp"), F.count_if(F.col("o_orderstatus") == "F").alias("fp"))
    p = ratio("tp", F.col("tp") + F.col("fp"))
    return x.select("c", "tp", "fp", F.round(p, 6).alias("p"), F.round(f1(p, F.lit(1.0)), 6).alias("f1"))
