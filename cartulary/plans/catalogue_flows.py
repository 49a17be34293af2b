"""Queries over flows, the audit chain, guards and curation.

Customers stand in for code units (calls, field accesses, identifiers,
parameters by number), the sparse graph for data flow, events for the rows of
iterations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import code_lines, human_size, is_synthetic, regex_union
from ..operators import audit, catalogs, curation, graph, joins, runs, scans, scoring
from ..sources import readers, writers
from .catalogue import _FLOW_SQL, _LABEL_CASE, _LABEL_SQL, ORACLE, _findings, _sparse, _t, query

# -- flows --------------------------------------------------------------------

_CODE_UNITS = """(select c_custkey as id, 'f' || c_nationkey as file, case when c_custkey % 9 <> 4 then c_custkey % 50 end as line, lower(c_mktsegment) as name,
  case c_custkey % 4 when 0 then 'Call' when 1 then 'FieldAccess' when 2 then 'Identifier' else 'Parameter' end as kind,
  case when c_custkey % 4 = 0 then lower(c_mktsegment) || '(' || case when c_custkey % 3 = 0 then chr(10) else '' end || c_name || ')' when c_custkey % 4 = 1 then 'x.' || lower(c_mktsegment) || '.k'
    when c_custkey % 3 = 0 then 'my_x.' || lower(c_mktsegment) else c_name || '_' || lower(c_mktsegment) end as code from customer)"""
_SINK = "(kind = 'Call' and name in ('building', 'machinery') and starts_with(code, 'building'))"
_SOURCE = "(kind = 'FieldAccess' and (contains(code, 'x.household') or contains(code, 'furniture')) or kind = 'Call' and name = 'furniture')"
_WIDE = f"({_SOURCE} or kind in ('Identifier', 'Parameter') and (contains(code, 'x.household') or contains(code, 'furniture')))"
_ANY = "(kind in ('FieldAccess', 'Identifier', 'Parameter'))"
_DEPTH = 3
_REACHED = f"""recursive u as {_CODE_UNITS}, e as {_FLOW_SQL}, r(seed, node, depth) as (
  select id, id, 0 from u where {_SINK} union all select r.seed, e.src, r.depth + 1 from r join e on r.node = e.dst where r.depth < {_DEPTH}),
p as (select distinct seed, node from r where seed <> node)"""
_COLUMNS = """t.file as sink_file, coalesce(cast(t.line as varchar), '-1') as sink_line, t.name as sink_name, replace(substr(t.code, 1, 300), chr(10), ' ') as sink_code,
  s.file as source_file, coalesce(cast(s.line as varchar), '-1') as source_line, replace(substr(s.code, 1, 200), chr(10), ' ') as source_code"""


def _flow_sql(source: str, kind: str) -> str:
    return f"select {_COLUMNS}, '{kind}' as recovery_kind from p join (select * from u where {source}) s on p.node = s.id join u t on p.seed = t.id"


_DIRECT = f"select file as sink_file, coalesce(cast(line as varchar), '-1') as sink_line, name as sink_name, replace(substr(code, 1, 300), chr(10), ' ') as sink_code, '' as source_file, '-1' as source_line, '' as source_code, 'direct_sink' as recovery_kind from u where {_SINK}"


def _code(spark, d):
    """Units, catalog and flow edges."""
    low, n = F.lower("c_mktsegment"), F.col("c_custkey") % 4
    kind = F.when(n == 0, "Call").when(n == 1, "FieldAccess").when(n == 2, "Identifier").otherwise("Parameter")
    code = F.when(n == 0, F.concat(low, F.lit("("), F.when(F.col("c_custkey") % 3 == 0, "\n").otherwise(""), "c_name", F.lit(")"))).when(n == 1, F.concat(F.lit("x."), low, F.lit(".k"))).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("my_x."), low)).otherwise(F.concat("c_name", F.lit("_"), low))
    units = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("f"), "c_nationkey").alias("file_path"), F.when(F.col("c_custkey") % 9 != 4, F.col("c_custkey") % 50).alias("line_start"), low.alias("name"), kind.alias("kind"), code.alias("code"))
    rows = [("sink", 0, "building"), ("sink", 1, "os.machinery"), ("source", 0, "x.household"), ("source", 1, "furniture")]
    return units, spark.createDataFrame(rows, "role string, pos int, pattern string"), _sparse(spark, d)


@query(f"with {_REACHED} {_flow_sql(_SOURCE, 'taint')}")
def q_source_sink_flow(spark, d):
    """Flows from catalog sources to catalog sinks."""
    return scans.taint(*_code(spark, d), depth=_DEPTH)


@query(f"with {_REACHED} {_flow_sql(_WIDE, 'relaxed')}")
def q_relaxed_flow(spark, d):
    """Sources widened by names that hold a whole pattern (J28), uncapped."""
    return scans.relaxed_taint(*_code(spark, d), depth=_DEPTH, cap=None)


@query(f"with {_REACHED} {_flow_sql(_ANY, 'def_use')}")
def q_def_use_flow(spark, d):
    """Any name or field that reaches a sink (J29), uncapped."""
    return scans.def_use(*_code(spark, d), depth=_DEPTH, cap=None)


@query(f"with u as {_CODE_UNITS} {_DIRECT}")
def q_direct_sinks(spark, d):
    """Every call of a sink (J30), uncapped."""
    units, catalog, _ = _code(spark, d)
    return scans.direct_sinks(units, catalog, None)


_CAP_ORDER = "sink_file, cast(sink_line as int), sink_code, source_file, try_cast(source_line as int), source_code"


@query(f"with {_REACHED} select * from ({_flow_sql(_WIDE, 'relaxed')}) order by {_CAP_ORDER} limit 200")
def q_relaxed_flow_capped(spark, d):
    """The same in the order of flows up to the pass's own cap."""
    return scans.relaxed_taint(*_code(spark, d), depth=_DEPTH)


@query(f"""with {_REACHED} select 0 as pass_no, recovery_kind, count(*) as n, min(sink_file) as first_file from ({_flow_sql(_SOURCE, 'taint')}) group by 1, 2
union all select 1, recovery_kind, count(*), min(sink_file) from ({_flow_sql(_WIDE, 'relaxed')}) group by 1, 2
union all select 2, recovery_kind, count(*), min(sink_file) from ({_flow_sql(_ANY, 'def_use')}) group by 1, 2 union all select 3, recovery_kind, count(*), min(sink_file) from ({_DIRECT}) group by 1, 2""")
def q_recovery_union(spark, d):
    """The four passes in their order (U01): the first arrival of each."""
    code = _code(spark, d)
    passes = [scans.taint(*code, depth=_DEPTH), scans.relaxed_taint(*code, depth=_DEPTH, cap=None), scans.def_use(*code, depth=_DEPTH, cap=None), scans.direct_sinks(code[0], code[1], None)]
    out = scans.recovery_union(*passes)
    return out.groupBy("pass_no", "recovery_kind").agg(F.count("*").alias("n"), F.min("arrival_order")["sink_file"].alias("first_file"))


@query(f"""with f as ({ORACLE["q_flow_dedup"]}), k as (select unnest(['taint', 'relaxed', 'def_use', 'direct_sink']) as recovery_kind) select k.recovery_kind, count(f.sink_file) as "count" from k left join f on f.recovery_kind = k.recovery_kind group by 1""")
def q_recovery_counts(spark, d):
    """Findings by recovery kind after de-duplication."""
    from .catalogue import flow_rows

    return audit.recovery_counts(audit.dedup_flows(flow_rows(spark, d)))


@query(f"""with recursive e as {_FLOW_SQL}, n as (select c_custkey as id, 'fn' || c_custkey % 300 as name, 'f' || c_nationkey as f, c_name || chr(10) || c_mktsegment as code from customer),
r(node, depth) as (select id, 0 from n where name in ('fn12', 'fn77') union all select e.src, r.depth + 1 from r join e on r.node = e.dst where r.depth < 3),
m as (select node as id, min(depth) as depth from r group by node),
c as (select m.id, list_sort(list(distinct n.name)) as cs from m join e on e.src = m.id join n on n.id = e.dst group by m.id)
select m.id, m.depth, n.name, n.f as filename, replace(substr(n.code, 1, 1500), chr(10), ' ') as code, array_to_string(cs[1:50], ',') as callees from m join n on n.id = m.id left join c on c.id = m.id""")
def q_khop_callers(spark, d):
    """Callers up to three hops above named functions, with body and callees."""
    c = _t(spark, d, "customer")
    units = c.select(
        F.col("c_custkey").alias("id"), F.lit("Function").alias("kind"), F.concat(F.lit("fn"), F.col("c_custkey") % 300).alias("name"), F.lit(False).alias("is_external"), F.concat(F.lit("f"), "c_nationkey").alias("file_path"), F.lit(1).alias("line_start"),
        F.concat_ws("\n", "c_name", "c_mktsegment").alias("code"),
    )
    found = graph.CodeGraph(units, _sparse(spark, d).withColumn("kind", F.lit("Calls"))).khop_callers(spark.createDataFrame([("fn12",), ("fn77",)], "name string"), 3)
    return found.select("id", "depth", "name", "filename", "code", F.array_join("callees", ",").alias("callees"))


# -- findings and the audit chain ----------------------------------------------


@query(f"with l as (select *, {_LABEL_CASE} as label from {_LABEL_SQL}) select c as case_id, k, label, verdict, count(*) as n, count(g) as on_truth from l group by all")
def q_label_findings(spark, d):
    """Findings joined with verdicts and ground truth, by their keys."""
    rows, triage, truth = _findings(spark, d)
    labelled = scoring.label_findings(rows.drop("verdict"), triage, truth, 1)
    return labelled.groupBy("case_id", "k", "label", "verdict").agg(F.count("*").alias("n"), F.count("gt_line").alias("on_truth"))


_ROWS = """e as (select user_id as c, event_id as id, cast(event_id % 3 as int) as k, event_id % 5 = 0 as patched, cast(row_number() over (partition by user_id, event_id % 3, event_id % 5 = 0 order by event_id) - 1 as int) as i,
  case event_id % 6 when 0 then 'tp' when 1 then 'fn_by_llm' when 2 then 'fp_by_hallucinated_source' when 3 then 'fp_by_location' when 4 then 'uncertain_on_gt' else '' end as label,
  case event_id % 4 when 1 then 'false_positive' when 2 then 'uncertain' else 'true_positive' end as verdict, cast(event_id % 130 as int) as line, case when event_id % 7 = 0 then 'a/g.py' else 'a/f.py' end as file, event_id % 9 <> 0 as src from events)"""


def _results(spark, d, prefix="joern"):
    """Results with nested arms, as a run writes them, from events."""
    e = _t(spark, d, "events")
    label = F.expr("case event_id % 6 when 0 then 'tp' when 1 then 'fn_by_llm' when 2 then 'fp_by_hallucinated_source' when 3 then 'fp_by_location' when 4 then 'uncertain_on_gt' else '' end")
    row = F.struct(
        F.expr("if(event_id % 7 = 0, 'a/g.py', 'a/f.py')").alias("file"), (F.col("event_id") % 130).cast("int").alias("line"), F.expr("case event_id % 4 when 1 then 'false_positive' when 2 then 'uncertain' else 'true_positive' end").alias("verdict"),
        (F.col("event_id") % 9 != 0).alias("source_in_snippet"), F.lit("taint").alias("recovery_kind"),
    )
    rows = e.select(F.col("user_id").alias("c"), (F.col("event_id") % 3).alias("k"), (F.col("event_id") % 5 == 0).alias("patched"), F.struct("event_id", label.alias("label"), row.alias("row")).alias("x"))
    arms = rows.groupBy("c", "k", "patched").agg(F.array_sort(F.collect_list("x")).alias("x"))
    n, none = F.size("x"), F.lit(None).cast("int")
    metrics = F.struct((n % 4).cast("string").alias("findings_hash"), F.lit("a").alias("rules_hash_pre"), F.when(F.col("c") % 2 == 0, "a").otherwise("b").alias("rules_hash_post"), F.lit(None).cast("boolean").alias("rules_yaml_changed"))
    arm = F.struct(
        F.size(F.filter("x", lambda v: v.label == "tp")).alias("tp"), F.size(F.filter("x", lambda v: v.label.startswith("fp_"))).alias("fp"), F.lit(2).alias("fn"), none.alias("fn_by_llm"), n.alias("n_candidates"), none.alias("n_findings_on_patched"),
        F.when((F.col("c") % 50 == 0) & (F.col("k") == 2), "boom").alias("arm_error_type"), F.col("x.label").alias("labels"), F.col("x.row").alias("triage_verdicts"), metrics.alias("metrics"),
        F.array(F.struct(F.when(F.col("k") > 0, "refine").otherwise("keep").alias("action"))).alias("refinement_actions"),
    )
    key = F.concat(F.lit(f"{prefix}_"), "k", F.when(F.col("patched"), "_patched").otherwise(""))
    return arms.groupBy(F.col("c").alias("cve_id")).agg(F.map_from_entries(F.collect_list(F.struct(key, arm))).alias("arms")).withColumn("skipped", F.lit(None).cast("string"))


def _truth(spark, d):
    """Two records of a case each; the later one counts."""
    users = _t(spark, d, "events").select(F.col("user_id").alias("cve_id")).distinct().where("cve_id % 3 <> 0")
    row = [F.lit("f.py").alias("vulnerable_file"), F.array(F.lit(10), F.lit(60), F.lit(100)).alias("vulnerable_lines"), F.lit(2).alias("pos")]
    return users.select("cve_id", *row).unionByName(users.select("cve_id", F.lit("old.py").alias("vulnerable_file"), F.array(F.lit(1)).alias("vulnerable_lines"), F.lit(1).alias("pos")))


@query(f"with {_ROWS} select c as cve_id, k, patched, i as finding_index, label, verdict, line from e")
def q_aligned_rows(spark, d):
    """Verdict rows with the labels of their places, by arm."""
    return audit.aligned_rows(audit.arms(_results(spark, d))).select("cve_id", "k", "patched", "finding_index", "label", "verdict", "line")


@query(f"""with {_ROWS} select c as cve_id, k, patched, i as finding_index, case when patched and label = '' then 'patched_commit_alert' else label end as label, 'joern_' || k || case when patched then '_patched' else '' end as arm_key,
  case when c % 3 <> 0 and file = 'a/f.py' then coalesce(cast(list_filter([10, 60, 100], lambda v: abs(v - line) <= 5)[1] as varchar), '') else '' end as matched_gt_line, case when patched then 'patched_commit_alert' when label = 'fp_by_hallucinated_source' or not src then 'evidence_hallucination' when verdict = 'true_positive' then 'triager_overclaim'
  when label = 'fp_by_location' then 'scanner_location_fp' else label end as fp_cause from e where patched or starts_with(label, 'fp_')""")
def q_fp_rows(spark, d):
    """Rows counted against precision, with their cause, arm and vulnerable line."""
    rows = audit.aligned_rows(audit.arms(_results(spark, d)))
    found = audit.fp_rows(rows, audit.last_by(_truth(spark, d), "cve_id"))
    return found.select("cve_id", "k", "patched", "finding_index", "label", "arm_key", "matched_gt_line", "fp_cause")


@query(f"""with {_ROWS}, its as (select distinct c, k from e where not patched), t as (select c, k, unnest([10, 60, 100]) as gt from its where c % 3 <> 0),
j as (select t.*, e.i, e.line, e.verdict, e.label, coalesce(abs(e.line - t.gt) <= 5, false) as hit, abs(e.line - t.gt)::bigint * 1000000 + e.i as far from t left join e on e.c = t.c and e.k = t.k and not e.patched and e.file = 'a/f.py'),
a as (select c, k, gt, coalesce(bool_or(hit and label = 'tp'), false) as tp, coalesce(bool_or(hit and (label = 'fn_by_llm' or verdict = 'false_positive')), false) as sup, coalesce(bool_or(hit and label = 'fp_by_hallucinated_source'), false) as hal,
  arg_min(i, far) as near_i, arg_min(line, far) as near_line, arg_min(verdict, far) as near_verdict from j group by c, k, gt)
select c as cve_id, k, gt as gt_line, case when c % 50 = 0 and k = 2 then 'arm_error_or_timeout' when sup then 'triager_suppressed_gt' when hal then 'hallucinated_source_on_gt' else 'joern_candidate_missing' end as fn_cause, near_i as nearest_finding_index, near_line as nearest_line, near_verdict as nearest_verdict
from a where not tp union all select c, k, null, 'empty_ground_truth', null, null, null from its where c % 3 = 0""")
def q_fn_rows(spark, d):
    """Missed ground-truth lines with cause and nearest row."""
    its = audit.arms(_results(spark, d))
    truth = audit.last_by(_truth(spark, d), "cve_id")
    return audit.fn_rows(its, audit.aligned_rows(its), truth).select("cve_id", "k", "gt_line", "fn_cause", "nearest_finding_index", "nearest_line", "nearest_verdict")


_ITS = "its as (select c, k, patched, cast(count(*) as int) as n, cast(count(*) filter (label = 'tp') as int) as tp, cast(count(*) filter (starts_with(label, 'fp_')) as int) as fp from e group by c, k, patched)"


@query(f"with {_ROWS}, {_ITS} select c as cve_id, k, patched, tp, fp, n as n_candidates, n % 4 <> first_value(n % 4) over (partition by c, patched order by k) as findings_changed_vs_k0 from its")
def q_iteration_rows(spark, d):
    """Counts of iterations and whether findings differ from the first."""
    return audit.iteration_rows(audit.arms(_results(spark, d))).select("cve_id", "k", "patched", "tp", "fp", "n_candidates", "findings_changed_vs_k0")


@query(f"with {_ROWS}, {_ITS} select k, patched, count(*) as cases, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(2) as bigint) as fn from its where k = 2 and not patched or k = 0 group by k, patched")
def q_arm_totals(spark, d):
    """Totals of chosen arms, ordered by k and patched."""
    return audit.arm_totals(audit.iteration_rows(audit.arms(_results(spark, d))), [(2, False), (0, False), (0, True)])


@query(f"""with {_ROWS}, m as (select e.*, case when file = 'a/f.py' and line between 5 and 15 then 1 when file = 'a/f.py' and line between 55 and 65 then 2 when file = 'a/f.py' and line between 95 and 105 then 3 end as idx, file = 'a/f.py' and line between 30 and 40 as hk from e where not patched and c % 3 <> 0),
q as (select *, case when label = 'fp_by_hallucinated_source' or label = '' and verdict = 'true_positive' and not src then 'fp' when (label = 'tp' or label = '' and verdict = 'true_positive') and (idx is not null or hk) then 'tp' when label = 'tp' or label = '' and verdict = 'true_positive' then 'fp' when verdict = 'uncertain' and idx is not null then 'uncertain' end as kind from m),
s as (select c, k, count(*) filter (kind = 'tp') as tp, count(*) filter (kind = 'fp') as fp, count(distinct case when kind = 'tp' then idx end) as covered from q group by c, k),
u as (select c, k, count(distinct idx) as credits from q where kind = 'uncertain' and not exists (select 1 from q z where z.c = q.c and z.k = q.k and z.kind = 'tp' and z.idx = q.idx) group by c, k)
select s.k, cast(sum(3) as bigint) as clusters, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(3 - covered) as bigint) as fn, cast(sum(coalesce(credits, 0)) as bigint) as credits, cast(sum(tp + coalesce(credits, 0)) as bigint) as uncertain_tp, cast(sum(3 - covered - coalesce(credits, 0)) as bigint) as uncertain_fn
from s left join u on u.c = s.c and u.k = s.k group by s.k""")
def q_relaxed_totals(spark, d):
    """Relaxed and uncertain lanes summed up by k (A12), from the whole audit."""
    users = _t(spark, d, "events").select(F.col("user_id").alias("case_id")).distinct()
    hunks = users.select("case_id", F.lit("f.py").alias("path"), F.lit(30).alias("start"), F.lit(40).alias("end"))
    return audit.audit(_results(spark, d), _truth(spark, d), hunks)["relaxed_totals"]


@query(f"""with {_ROWS}, {_ITS}, r as (select c, k, n % 4 as h, case when k > 0 then 1 else 0 end as refines, case when k > 0 and c % 2 = 0 then 1 else 0 end as no_ops from its where not patched), s as (select c, count(*) as n, count(distinct h) as hashes from r group by c)
select count(*) as rows, cast(sum(refines) as bigint) as refines, cast(sum(no_ops) as bigint) as no_ops, round(sum(no_ops) / sum(refines), 4) as no_op_rate, (select count(*) from s where hashes = 1 and n > 1) as invariant_cases from r""")
def q_rules_audit(spark, d):
    """Refinements without effect, and cases that never change."""
    return audit.rules_audit(_results(spark, d, "semgrep"))["summary"]


@query(f"with {_ROWS}, {_ITS}, s as (select c, count(*) as n, count(distinct n % 4) as hashes from its where not patched group by c) select c as cve_id, n, hashes, hashes = 1 and n > 1 as invariant from s")
def q_findings_invariance(spark, d):
    """Cases by how often their findings differ over iterations."""
    return audit.rules_audit(_results(spark, d, "semgrep"))["cases"].select("cve_id", "n", "hashes", "invariant")


# -- lookups, catalogs and curation -------------------------------------------


@query("""with s as (select event_id, user_id, ts, ts + interval 2 hour as e from events where event_type = 'purchase')
select s.event_id as unit_id, count(*) as inner_n from s join events p on p.user_id = s.user_id and p.ts between s.ts and s.e group by s.event_id""")
def q_contains_interval(spark, d):
    """Events within two hours of a purchase of their user, by an interval join."""
    ev = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("user_id", "event_id", "event_type", "at")
    outer = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("unit_id"), F.col("at").alias("s"), (F.col("at") + 7_200_000_000).alias("e"))
    return joins.interval_join(ev.select("user_id", "at"), outer, ["user_id"], "at", "s", "e", bin_width=7_200_000_000).groupBy("unit_id").agg(F.count("*").alias("inner_n"))


@query("""select event_id as cve_id, first_id from (select event_id, first_value(event_id) over w as first_id, row_number() over w as r from events window w as (partition by event_type, user_id % 7, event_id % 13 order by event_id)) where r > 1""")
def q_dup_locations(spark, d):
    """Records at a place that an earlier one holds."""
    ev = _t(spark, d, "events")
    rows = ev.select(F.col("event_id").alias("pos"), F.col("event_id").alias("cve_id"), F.col("event_type").alias("repo_url"), F.concat(F.lit("f"), F.col("user_id") % 7).alias("vulnerable_file"), F.array((F.col("event_id") % 13), (F.col("event_id") % 13 + 1)).alias("vulnerable_lines"))
    return curation.duplicate_locations(rows)


_LEAST = {"bin": 4, "sink": 2, "severity": 3}


@query("""with b as (select doc_id as id, case when n_chars < 100 then '<100' when n_chars < 500 then '100-499' when n_chars < 2000 then '500-1999' else '>=2000' end as bin, lang as sink, source as sev, md5('7|' || doc_id) as h from documents),
a1 as (select *, row_number() over (partition by bin order by h, id) <= 4 as t1 from b),
a2 as (select *, t1 or row_number() over (partition by sink, t1 order by h, id) <= 2 - count(*) filter (t1) over (partition by sink) as t2 from a1),
a3 as (select *, t2 or row_number() over (partition by sev, t2 order by h, id) <= 3 - count(*) filter (t2) over (partition by sev) as t3 from a2),
a4 as (select *, row_number() over (partition by t3 order by h, id) as r, count(*) filter (t3) over () as n from a3)
select id as cve_id from a4 where t3 or r <= 40 - n""")
def q_stratified_sample(spark, d):
    """A sample with a least number of each stratum, by need, filled up."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("cve_id"), F.col("n_chars").alias("loc"), F.col("lang").alias("sink_api"), F.col("source").alias("cvss_severity"))
    return curation.stratified_sample(rows, 40, _LEAST, 7).select("cve_id")


@query("""select event_id, 'reason_' || event_type as reason from events where event_type in ('view', 'error') and event_id not in (select event_id from events where user_id % 4 = 0)""")
def q_salvage(spark, d):
    """Rejected records of two reasons whose id was not accepted after all."""
    ev = _t(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("reason_"), "event_type").alias("reason"))
    return curation.salvage(ev.drop("user_id"), ev.where("user_id % 4 = 0"), ["reason_view", "reason_error"], "event_id").select("event_id", "reason")


@query("""with t as (select distinct 'v' || p_size as tag, 'tag' || p_size as c from part union select distinct p_size || '.0', 'plain' || p_size from part where p_size % 3 = 0),
w as (select distinct cast(p_size as varchar) as w from part union select distinct 'v' || p_size from part),
f as (select w, coalesce((select arg_min(c, tag) from t where starts_with(tag, w)), (select c from t where tag = 'v' || w)) as c from w),
x as (select p_partkey, p_partkey % 4 as n, case when p_partkey % 7 <> 0 then (select c from f where w = cast(p_size as varchar)) end as fixed, case when p_partkey % 5 <> 0 then (select c from f where w = 'v' || p_size) end as released from part)
select p_partkey, case when n = 0 then printf('%08X', p_partkey) when n = 1 and p_partkey % 3 = 0 then 'pull' || p_partkey when fixed is not null then fixed when n = 2 then released end as "commit",
case when n = 0 then 'commit' when n = 1 and p_partkey % 3 = 0 then 'pull' when fixed is not null then 'version' when n = 2 and released is not null then 'tag' end as how from x""")
def q_commit_cascade(spark, d):
    """A commit link, else a pull request's, else the fixed version's, else a
    release tag's commit (J32). Versions find tags that begin with them."""
    p = _t(spark, d, "part")
    n, base = F.col("p_partkey") % 4, "https://github.com/o/r/"
    url = F.when(n == 0, F.concat(F.lit(base + "commit/"), F.format_string("%08X", "p_partkey"))).when(n == 1, F.concat(F.lit(base + "pull/"), "p_partkey")).when((n == 2) & (F.col("p_partkey") % 5 != 0), F.concat(F.lit(base + "releases/tag/v"), "p_size")).otherwise("https://example.org/")
    version = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("string")).alias("version")
    df = p.select("p_partkey", F.array(F.lit("https://example.org/x"), url).alias("references"), F.lit("https://github.com/o/r").alias("repo_url"), version)
    pulls = p.where("p_partkey % 3 = 0").select(F.lit("o/r").alias("repo"), F.col("p_partkey").alias("number"), F.concat(F.lit("pull"), "p_partkey").alias("commit"))
    tags = p.select(F.lit("o/r").alias("repo"), F.concat(F.lit("v"), "p_size").alias("tag"), F.concat(F.lit("tag"), "p_size").alias("commit")).distinct()
    tags = tags.union(p.where("p_size % 3 = 0").select(F.lit("o/r"), F.concat("p_size", F.lit(".0")), F.concat(F.lit("plain"), "p_size")).distinct())
    return curation.commit_of("references", pulls, tags, df, "p_partkey", "repo_url", "version")


_HOSTS = "h as (select distinct array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.')), '.') as p from pages), s as (select p from h where p <> ''), b as (select min(p) as p from s)"


@query(f"""with {_HOSTS}, x as (select 'sink' as role, null as reason from s union all select 'source', case when p = (select p from b) then 'blacklist' else 'equals_sink' end from s
  union all select 'source', null from s union all select 'sanitizer', 'equals_sink' from s union all select 'sanitizer', null from s union all select 'sink', 'bare_sink')
select role, count(*) filter (reason is null) as kept, count(*) filter (reason is not null) as dropped, count(*) filter (reason = 'blacklist') as blacklisted, count(*) filter (reason = 'equals_sink') as equal from x group by role""")
def q_catalog_guards(spark, d):
    """Kept and dropped patterns by role: blacklist, sanitizers, bare sinks."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    s = _t(spark, d, "pages").select(F.array_join(F.reverse(F.split(host, "[.]", -1)), ".").alias("pattern")).where("pattern <> ''").distinct()
    rows = lambda role, df: df.select(F.lit(role).alias("role"), F.lit(0).alias("pos"), "pattern")
    other = s.select(F.concat(F.lit("own.of."), "pattern").alias("pattern"))
    catalog = rows("sink", s).union(rows("sink", spark.createDataFrame([("exec",)], "pattern string"))).union(rows("source", s)).union(rows("source", other)).union(rows("sanitizer", s)).union(rows("sanitizer", other))
    first = s.agg(F.min("pattern")).first()[0]
    kept, dropped = catalogs.cleaned(catalog, [first], bound=0.5)
    both = kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped)
    of = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False)))
    return both.groupBy("role").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("dropped"), of("blacklist").alias("blacklisted"), of("equals_sink").alias("equal"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), f as (select item_id from benchmark)
select item_id, coalesce(array_to_string(list_transform(range(1, least(18, len(ls)) + 1), lambda i: lpad(cast(i as varchar), 5, ' ') || '| ' || ls[i]), chr(10)), '') as snippet from f left join l on f.item_id = l.doc_id""")
def q_seed_snippets(spark, d):
    """The lines around all findings of a file, lines 2 to 6 here (W11); for odd
    items the file is found by its base name only."""
    folder = F.when(F.col("item_id") % 2 == 0, "d/").otherwise("gone/")
    b = _t(spark, d, "benchmark").select("item_id", F.concat(folder, "item_id").alias("file_path"))
    at = lambda s, e: b.select("*", F.lit(s).alias("line_start"), F.lit(e).alias("line_end"))
    files = _t(spark, d, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("file_path"), "text")
    return scans.seed_snippets(at(2, 3).union(at(5, 6)), files, ["item_id"]).select("item_id", "snippet")


@query("""with p as (select event_id from events where event_id % 3 <> 0), q as (select event_id from events where event_id % 2 = 0) select (select count(*) from p) as prior, (select count(*) from q) as rerun, count(*) as merged, count(*) filter (p.event_id is not null and q.event_id is not null) as replaced, count(*) filter (p.event_id is null) as appended
from p full join q on p.event_id = q.event_id""")
def q_merge_summary(spark, d):
    """Counters of a merged run."""
    ev = _t(spark, d, "events").select("event_id", "event_type", F.col("event_id").alias("pos"))
    return runs.merge_runs(ev.where("event_id % 3 <> 0"), ev.where("event_id % 2 = 0"), "event_id")[1]


@query("select c_name as summary from customer where c_custkey = 42 and c_mktsegment <> 'NONE' union all select 'second' from customer where c_custkey = 42")
def q_facts_by_unit(spark, d):
    """All facts of one unit."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("customer").alias("kind"), "c_mktsegment", "c_name")
    one = c.select(F.col("id").alias("unit_id"), F.col("c_mktsegment").alias("fact_class"), F.lit("s").alias("name"), F.col("c_name").alias("summary"), F.lit("{}").alias("details"))
    two = one.withColumn("summary", F.lit("second"))
    return graph.CodeGraph(c, None).add_unit_facts(one).add_unit_facts(two).facts_of("42").select("summary")


@query("""with n as (select 'n' || n_nationkey as id, n_regionkey as r, n_nationkey as k from nation), e as (select 'n' || a.n_nationkey as src, 'n' || b.n_nationkey as dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey),
f as (select id as src, 'n' || ((k + 1) % 25) as dst, case when k % 2 = 0 then 'add_edge' else 'remove_edge' end as op from n)
select src, dst from e where not exists (select 1 from f where f.src = e.src and f.dst = e.dst) union select src, dst from f where op = 'add_edge'""")
def q_relation_facts(spark, d):
    """Edges after facts that add and remove relations."""
    n = _t(spark, d, "nation")
    units = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("kind"))
    one = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r"))
    two = n.select(F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("q"))
    own = [F.lit("Near").alias("kind"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("metadata")]
    edges = one.join(two, F.expr("r = q and a < b")).select("src", "dst", *own)
    op = F.when(F.col("n_nationkey") % 2 == 0, "add_edge").otherwise("remove_edge")
    facts = n.select(F.lit("c").alias("fact_class"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1) % 25).alias("dst"), op.alias("operation"), *own, F.lit(1).alias("seq"))
    return graph.CodeGraph(units, edges).add_relation_facts(facts).edges.select("src", "dst")


@query("select item_id, regexp_matches(text, '(?:[0-9]{2,})|(?:the )') as hit, regexp_matches(text, 'zzzz') and false as never from benchmark")
def q_regex_union(spark, d):
    """Patterns as one expression, broken ones left out."""
    union, never = regex_union(["[0-9]{2,}", "(", "", "the "]), regex_union(["*", "["])
    return _t(spark, d, "benchmark").select("item_id", F.col("text").rlike(union).alias("hit"), F.col("text").rlike(never).alias("never"))


@query("""select 'synthetic:' || (event_id % 3) as kind, starts_with(case when event_id % 3 = 0 then 'synthetic:' || event_id else 'own:' || event_id end, 'synthetic:') as synthetic, count(*) as n from events group by all""")
def q_synthetic_ids(spark, d):
    """Units that an analysis made up."""
    ev = _t(spark, d, "events")
    unit = F.concat(F.when(F.col("event_id") % 3 == 0, "synthetic:").otherwise("own:"), "event_id")
    return ev.groupBy(F.concat(F.lit("synthetic:"), F.col("event_id") % 3).alias("kind"), is_synthetic(unit).alias("synthetic")).agg(F.count("*").alias("n"))


@query("select doc_id, len(string_split(text, chr(10))) as n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as loc from documents")
def q_loc_count(spark, d):
    """Lines and non-blank lines of every document."""
    return _t(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), code_lines("text").cast("long").alias("loc"))


@query("""with n as (select p_partkey, case when p_partkey % 2 = 0 then p_size * 524288 else p_size * 512 end as n from part)
select p_partkey, case when n < 1024 then printf('%.1fB', n::double) when n < 1048576 then printf('%.1fKB', n / 1024) else printf('%.1fMB', n / 1048576) end as size from n""")
def q_human_size(spark, d):
    n = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 524288).otherwise(F.col("p_size") * 512)
    return _t(spark, d, "part").select("p_partkey", human_size(n).alias("size"))


@query("""with s as (select distinct n_regionkey from nation) select n_nationkey from nation where n_regionkey in (select n_regionkey from s where n_regionkey in (1, 3))""")
def q_only(spark, d):
    """Cases named by hand."""
    return runs.only(_t(spark, d, "nation"), [1, 3], "n_regionkey").select("n_nationkey")


@query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity >= 40) and o_custkey not in (select c_custkey from customer where c_nationkey < 5)""")
def q_left_to_run(spark, d):
    """Planned cases that no earlier row holds and nobody asked to skip."""
    planned = _t(spark, d, "orders").select(F.col("o_orderkey").alias("cve_id"), "o_custkey")
    done = _t(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("cve_id"))
    skip = planned.join(_t(spark, d, "customer").where("c_nationkey < 5"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return readers.left_to_run(planned, done, skip).select(F.col("cve_id").alias("o_orderkey"))


@query("""select 'unit' as which, 'Segment' as fact_class, cast(c_custkey as varchar) as at, c_mktsegment as name, null as seq from customer where c_custkey % 3 <> 0
union all select 'relation', 'Order', cast(o_orderkey as varchar), cast(o_custkey as varchar), o_orderkey from orders""")
def q_fact_dispatch(spark, d):
    """Serialized facts told apart by the kind and class they name."""
    kind = lambda k, c: (F.lit(k).alias("__kind__"), F.lit(c).alias("__class__"))
    units = _t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.to_json(F.struct(*kind("unit", "Segment"), F.col("c_custkey").cast("string").alias("unit_id"), F.col("c_mktsegment").alias("name"))).alias("fact"))
    relations = _t(spark, d, "orders").select(F.to_json(F.struct(*kind("relation", "Order"), F.col("o_orderkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst"), F.col("o_orderkey").alias("seq"))).alias("fact"))
    one, two = writers.dispatch_facts(units.union(relations))
    one = one.select(F.lit("unit").alias("which"), "fact_class", F.col("unit_id").alias("at"), "name", F.lit(None).cast("long").alias("seq"))
    return one.union(two.select(F.lit("relation"), "fact_class", "src", "dst", "seq"))
