"""Sinks: results, audit bundles, facts, cached artifacts, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

PUBLIC = ("cve_id", "ghsa_id", "package", "repo_url", "vulnerable_commit", "patch_commit", "patch_diff_path", "vulnerable_file", "vulnerable_lines", "sink_api", "loc", "cvss_score", "cvss_severity", "source_db", "taint_hops", "notes", "manual_review_status")


def append_results(rows: DataFrame, path: str) -> None:
    """Add rows, a folder for each case; a rerun of a case adds to it."""
    rows.write.mode("append").partitionBy("cve_id").parquet(path)


def rewrite_results(rows: DataFrame, path: str) -> None:
    """Rewrite the folders of the cases in ``rows`` and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cve_id").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with its header even where there are no rows (K02); nested columns
    as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def write_audit(tables: dict[str, DataFrame], root: str) -> None:
    """One JSON summary and a CSV of each row table."""
    for name in ("fp", "fn", "iterations"):
        write_csv(tables[name], f"{root}/{name}")
    for name in ("totals", "fp_causes", "fn_causes", "relaxed_totals", "recovery", "top_cases"):
        tables[name].write.mode("overwrite").json(f"{root}/summary/{name}")


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown (K04): the driver gets up to ``limit`` rows."""
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    lines = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join([head, *lines]) + "\n"


def save_facts(facts: DataFrame, path: str) -> None:
    """Append facts that are not there yet."""
    spark = facts.sparkSession
    if exists(spark, path):
        facts = facts.join(spark.read.parquet(path).select("fact_id"), "fact_id", "left_anti")
    facts.write.mode("append").parquet(path)


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dispatch_facts(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Serialized facts (column ``fact``, JSON) as unit facts and relation facts
    by their ``__kind__`` (K06, F06). A fact of another kind, or of none, is an
    error when the rows are read."""
    kind, name = F.get_json_object("fact", "$.__kind__"), F.get_json_object("fact", "$.__class__")
    wrong = F.raise_error(F.concat(F.lit("unknown kind of fact: "), F.coalesce(kind, F.lit("none"))))
    known = tags.where("fact is not null").select("fact", name.alias("fact_class"), F.when(kind.isin("unit", "relation"), kind).otherwise(wrong).alias("__k"))

    def of(which: str, schema: str) -> DataFrame:
        rows = known.where(F.col("__k") == which).select(F.col("fact_class").alias("__c"), F.from_json("fact", schema).alias("f"))
        names = [c.split()[0] for c in schema.split(", ")]
        return rows.select(*[F.col("__c" if c == "fact_class" else f"f.{c}").alias(c) for c in names])

    return of("unit", schemas.UNIT_FACTS), of("relation", schemas.RELATION_FACTS)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cache_key(*parts: Column | str) -> Column:
    """The key of an artifact: version, address, commit, language, tool."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def cached(spark: SparkSession, root: str, key: str, make) -> tuple[DataFrame, bool]:
    """The table under ``key``, made and written on a miss; and whether it hit."""
    path = f"{root}/{key}"
    hit = exists(spark, f"{path}/_SUCCESS")
    if not hit:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit


def prebuild_status(planned: DataFrame, built: DataFrame, key: str = "cache_key") -> DataFrame:
    """What of a plan is cached already: ``status, n``."""
    b = built.select(F.col(key).alias("__k"), "status")
    both = planned.join(b, F.col(key) == F.col("__k"), "left")
    return both.select(F.when(F.col("status") == "built", "hit").otherwise(F.coalesce("status", F.lit("missing"))).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def seed_key(columns: list[str]) -> Column:
    """16 hex digits of a row's canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 16)


def write_dataset(records: DataFrame, path: str) -> None:
    """The public fields only, as JSON lines."""
    records.select(*[c for c in PUBLIC if c in records.columns]).write.mode("overwrite").json(path)


def fact_row(kind: str, values: dict) -> dict:
    """A fact object as a row: its class, and its fields as JSON."""
    return {"fact_class": values.get("__class__", kind), "details": json.dumps({k: v for k, v in values.items() if not k.startswith("__")}, sort_keys=True)}
