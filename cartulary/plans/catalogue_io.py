"""Queries that write the driver's tables with the sinks and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions.text import compact_text, covers
from ..operators.graph import with_fact_id
from ..sources import readers, writers
from .catalogue import _t, query


def _rows(spark, d):
    return _t(spark, d, "customer").select(F.concat(F.lit("CVE-"), "c_nationkey").alias("cve_id"), F.col("c_custkey").alias("n"), F.col("c_acctbal").alias("score"))


@query("""with a as (select 'CVE-' || c_nationkey as cve_id, c_nationkey as nk, c_custkey as n, c_acctbal as score from customer)
select cve_id, count(*) * case when nk < 5 then 2 else 1 end as rows, round(sum(case when nk >= 10 then score + 1 else score end) * case when nk < 5 then 2 else 1 end, 2) as score from a group by cve_id, nk""")
def q_results_sink(spark, d):
    """Results by case: appended, a few cases added to, others rewritten."""
    rows, path = _rows(spark, d), scratch.folder(spark, "results")
    number = F.split("cve_id", "-")[1].cast("int")
    writers.append_results(rows, path)
    writers.append_results(rows.where(number < 5), path)
    writers.rewrite_results(rows.where(number >= 10).withColumn("score", F.col("score") + 1), path)
    return spark.read.parquet(path).groupBy("cve_id").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 2).alias("score"))


@query("""select 'full' as what, c_custkey as k, c_name as name, replace(c_mktsegment, 'A', '"') || chr(10) || ',' as note from customer union all select 'header', 0, 'k,name,note', null""")
def q_csv_sink(spark, d):
    """Rows with quotes, commas and line ends as CSV, and the header of none."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.concat(F.translate("c_mktsegment", "A", '"'), F.lit("\n,")).alias("note"))
    path = scratch.folder(spark, "csv")
    writers.write_csv(c, f"{path}/full")
    writers.write_csv(c.where("false"), f"{path}/none")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").schema(c.schema).csv(f"{path}/full")
    header = spark.read.text(f"{path}/none").distinct()
    return back.select(F.lit("full").alias("what"), "k", "name", "note").union(header.select(F.lit("header"), F.lit(0), "value", F.lit(None).cast("string")))


@query("""with f as (select c_mktsegment as fact_class, count(*) as n from customer group by 1) select * from f""")
def q_fact_sink(spark, d):
    """Facts saved twice with an overlap stand once."""
    c = _t(spark, d, "customer")
    facts = with_fact_id(c.select(F.concat(F.lit("u"), "c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("fact_class"), F.col("c_name").alias("name"), "c_custkey"), ["unit_id", "fact_class", "name"])
    path = scratch.folder(spark, "facts")
    writers.save_facts(facts.where("c_custkey % 3 <> 0").drop("c_custkey"), path)
    writers.save_facts(facts.where("c_custkey % 3 <> 1").drop("c_custkey"), path)
    return writers.load_facts(spark, path).groupBy("fact_class").agg(F.count("*").alias("n"))


@query("""select c_custkey::varchar as cve_id, [c_nationkey, 7] as vulnerable_lines, substr(replace(c_name || chr(13) || chr(10) || repeat('x', 300), chr(13) || chr(10), chr(10)), 1, 200) as notes from customer""")
def q_dataset_sink(spark, d):
    """Records as JSON lines, public fields only, read back."""
    text = F.concat("c_name", F.lit("\r\n"), F.repeat(F.lit("x"), 300))
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cve_id"), F.array(F.col("c_nationkey"), F.lit(7)).alias("vulnerable_lines"), compact_text(text, 200).alias("notes"), F.lit("secret").alias("_internal"))
    path = scratch.folder(spark, "dataset")
    writers.write_dataset(rows, path)
    found = readers.read_jsonl(spark, path)
    if set(found.columns) != {"cve_id", "vulnerable_lines", "notes"}:
        raise ValueError(f"not only public fields: {found.columns}")
    return found.select("cve_id", F.col("vulnerable_lines").cast("array<int>").alias("vulnerable_lines"), "notes")


@query("""select 'r' || n_regionkey as file_path, n_nationkey as line_start, n_nationkey + 1 as line_end, 'rule' as rule_id, n_name as message, case when n_nationkey % 2 = 0 then 'os.system' end as sink_api, row_number() over (partition by n_regionkey order by n_nationkey)::int - 1 as finding_index from nation""")
def q_pattern_results(spark, d):
    """Findings of a pattern tool's JSON documents, one a region."""
    n = _t(spark, d, "nation")
    one = F.struct(
        F.concat(F.lit("r"), "n_regionkey").alias("path"), F.lit("rule").alias("check_id"), F.struct(F.col("n_nationkey").alias("line")).alias("start"), F.struct((F.col("n_nationkey") + 1).alias("line")).alias("end"),
        F.struct(F.col("n_name").alias("message"), F.struct(F.when(F.col("n_nationkey") % 2 == 0, "os.system").alias("sink_api")).alias("metadata")).alias("extra"),
    )
    docs = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("o")))), lambda x: x["o"]).alias("results"))
    path = scratch.folder(spark, "pattern")
    docs.select(F.to_json(F.struct("results")).alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_pattern_results(spark, f"{path}/*").select("file_path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "rule_id", "message", "sink_api", "finding_index")


@query("""select n_nationkey as n, 2 + n_nationkey % 3 as n_lines, length(n_name) + 1 + 2 * (n_nationkey % 3) as size from nation""")
def q_file_scan(spark, d):
    """Nations as files below a folder, found and read whole."""
    n = _t(spark, d, "nation")
    path = scratch.folder(spark, "files")
    text = F.concat("n_name", F.expr("repeat('\\nx', cast(n_nationkey % 3 as int))"))
    n.select(text.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = readers.read_files(spark, path, "*.txt")
    return files.select(F.regexp_extract("file_path", r"n_nationkey=(\d+)/", 1).cast("long").alias("n"), "n_lines", "size")


@query("""with f as (select source || '/' || lang || '/' || doc_id || '.txt' as p, source as s, source || '/' || lang as l, n_chars as size from documents where source is not null and lang is not null),
e as (select p as path, l as parent, split_part(p, '/', 3) as name, false as is_dir, size from f union all select l, s, split_part(l, '/', 2), true, size from f union all select s, '', s, true, size from f),
g as (select path, parent, name, is_dir, sum(size)::bigint as size from e group by all)
select *, row_number() over (partition by parent order by is_dir desc, name)::int as rank from g""")
def q_tree_entries(spark, d):
    """Documents as files of sources and languages: the folders' listing."""
    f = _t(spark, d, "documents").where("source is not null and lang is not null").select(F.concat(F.concat_ws("/", "source", "lang", "doc_id"), F.lit(".txt")).alias("file_path"), F.col("n_chars").alias("size"))
    return readers.tree_entries(f).select("path", "parent", "name", "is_dir", "size", "rank")


@query("""select o_orderkey, case when o_orderkey % 3 <> 0 then 'diff of ' || o_orderkey end as diff from orders""")
def q_resolved_diffs(spark, d):
    """Diffs by the base name of the path a case names."""
    o = _t(spark, d, "orders")
    cases = o.select("o_orderkey", F.concat(F.lit("some/where/CVE-"), "o_orderkey", F.lit(".diff")).alias("patch_diff_path"))
    diffs = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("CVE-"), "o_orderkey").alias("case_id"), F.concat(F.lit("diff of "), "o_orderkey").alias("diff"))
    return readers.resolve_diffs(cases, diffs).select("o_orderkey", "diff")


@query("""select l_orderkey, count(*) as n, count(*) filter (l_linenumber <= 2 and l_linenumber + cast(l_quantity as int) % 5 >= 4) as holding from lineitem group by 1""")
def q_covers(spark, d):
    """Line items as units that hold a place of their order's file."""
    li = _t(spark, d, "lineitem")
    unit = F.struct(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line_start"), F.expr("l_linenumber + cast(l_quantity as int) % 5").alias("line_end"))
    place = F.struct(F.col("l_orderkey").alias("file_path"), F.lit(2).alias("line_start"), F.lit(4).alias("line_end"))
    return li.select("l_orderkey", unit.alias("u"), place.alias("p")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(covers("u", "p")).alias("holding"))
