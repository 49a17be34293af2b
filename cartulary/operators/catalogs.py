"""Catalogs of sources, sinks and sanitizers: clean, merge, expand, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier, tail
from .joins import ordered_first

#: Bare sinks that say too little.
BARE_SINKS = ("shell", "exec", "eval", "system")
SOURCE_DROP_BOUND = 0.25
#: Blanks of any kind at both ends.
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def normalised(catalog: DataFrame) -> DataFrame:
    """Patterns as identifiers, those that are none left out, first seen kept."""
    clean = catalog.withColumn("pattern", identifier("pattern")).where("pattern is not null")
    return ordered_first(clean, ["role", "pattern"], "pos")


def merged(base: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union with the base's order kept, and what it added."""
    both = base.select("role", "pos", "pattern", F.lit(0).alias("__part")).union(more.select("role", "pos", "pattern", F.lit(1)))
    first = ordered_first(both, ["role", "pattern"], "__part", "pos")
    order = F.row_number().over(Window.partitionBy("role").orderBy("__part", "pos")) - 1
    out = first.withColumn("pos", order)
    return out.drop("__part"), out.where("__part = 1").drop("__part")


def ancestors(df: DataFrame, name: str) -> DataFrame:
    """Add ``ancestor``: each proper dotted prefix of ``name``, one a row."""
    parts = F.split(F.col(name), "[.]", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return df.withColumn("ancestor", F.explode(F.when(F.size(parts) > 1, prefixes)))


def cleaned(catalog: DataFrame, blacklist: list[str], bound: float = SOURCE_DROP_BOUND) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and the dropped ones with a ``reason``.

    Patterns are compared without blanks around them and without leading dots;
    blank ones vanish. Sinks drop bare words (in either case). Sources drop what is
    blacklisted (in either case), what equals a kept sink, and what is a dotted
    ancestor of one, with the first reason; of kept sources that compare equal
    the first stays, the others vanish uncounted. Sanitizers drop what equals a
    sink. Dropping a larger share of the sources than ``bound`` is an error.
    """
    plain = catalog.withColumn("__plain", F.regexp_replace(F.regexp_replace("pattern", BLANK_ENDS, ""), r"^\.+", ""))
    plain = plain.where(F.regexp_replace("pattern", BLANK_ENDS, "") != "")
    low = F.lower("__plain")
    sinks = plain.where("role = 'sink'").withColumn("reason", F.when(low.isin(*BARE_SINKS), "bare_sink"))
    good = sinks.where("reason is null and __plain <> ''").select("__plain").distinct()
    up = ancestors(good, "__plain").select(F.col("ancestor").alias("__plain")).distinct().withColumn("__up", F.lit(True))
    same = good.withColumn("__same", F.lit(True))
    sources = plain.where("role = 'source'").join(same, "__plain", "left").join(up, "__plain", "left")
    banned = [b.strip().lstrip(".").lower() for b in blacklist]
    reason = F.when((low != "") & low.isin(*banned), "blacklist").when(F.col("__same"), "equals_sink").when(F.col("__up"), "ancestor_of_sink")
    sources = sources.withColumn("reason", reason).drop("__same", "__up")
    sources = ordered_first(sources.where("reason is null"), ["__plain"], "pos", "pattern").unionByName(sources.where("reason is not null"))
    sanitizers = plain.where("role = 'sanitizer'").join(same, "__plain", "left").withColumn("reason", F.when(F.col("__same"), "equals_sink")).drop("__same")
    every = sinks.unionByName(sources).unionByName(sanitizers).drop("__plain")
    count = every.where("role = 'source'").agg(F.count("*").alias("n"), F.count("reason").alias("d")).first()
    if count.n and count.d / count.n > bound:
        raise ValueError(f"{count.d} of {count.n} sources would be dropped")
    return every.where("reason is null").drop("reason"), every.where("reason is not null")


def grew(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Sizes by role before and after, and whether one grew."""
    a, b = pre.groupBy("role").agg(F.count("*").alias("pre")), post.groupBy("role").agg(F.count("*").alias("post"))
    return a.join(b, "role", "full").na.fill(0, ["pre", "post"]).withColumn("grew", F.col("post") > F.col("pre"))


def gate_wrappers(candidates: DataFrame, sinks: DataFrame) -> DataFrame:
    """Add ``accepted``: whether a candidate sink wrapper calls a known sink
    (P11); none without sinks.

    ``candidates``: ``name, callees, code, evidence``. A sink's last part counts as a
    whole callee name, as a whole word ahead of a parenthesis in the code, or as
    a whole word of the evidence, letters as they are; words are of any script.
    A last part that is no word (catalogs hold identifiers) is met as a callee
    only. Each row is judged by what it holds, so rows of one name may differ.
    The tails are joined as rows, so a large catalog is shuffled like any table.
    """
    tails = sinks.where("pattern <> ''").select(tail("pattern").alias("__tail")).distinct()
    words = F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(rf"(?U)({WORD})[\s\x1c-\x1f]*\("), 1)
    told = F.regexp_extract_all(F.coalesce("evidence", F.lit("")), F.lit(f"({WORD})"), 1)
    named = F.filter(F.coalesce("callees", F.array().cast("array<string>")), lambda c: c != "")
    # Rows with the same contents have the same answer; they are told by two
    # hashes, which skip nulls and so need to be told of them.
    held = [F.coalesce(F.size("callees"), F.lit(-1)), "callees", F.isnull("code"), "code", F.isnull("evidence"), "evidence"]
    keyed = candidates.withColumn("__row", F.struct(F.xxhash64(*held).alias("a"), F.xxhash64(F.lit(1), *held).alias("b")))
    exploded = keyed.select("__row", F.explode(F.array_distinct(F.concat(named, words, told))).alias("__tail"))
    hit = exploded.join(tails, "__tail", "left_semi").select("__row").distinct().withColumn("accepted", F.lit(True))
    return keyed.join(hit, "__row", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).drop("__row")


def refined(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Rules of each case after its refinement, with ``apply_status``.

    ``rules``: ``case_id, pos, rule_id, rule``; ``patches``: one row of a case,
    ``action`` (keep, refine, add_rule), ``rule_id``, ``rule``. ``refine`` replaces the
    rule of that id or adds one, ``add_rule`` adds; a patch without id or rule
    changes nothing (``noop_empty_patch``). Unknown actions keep.
    """
    p = patches.select(F.col("case_id").alias("__c"), "action", F.col("rule_id").alias("__id"), F.col("rule").alias("__rule"))
    empty = (F.coalesce("__id", F.lit("")) == "") | (F.coalesce("__rule", F.lit("")) == "")
    acts = F.col("action").isin("refine", "add_rule")
    status = F.when(~F.coalesce(acts, F.lit(False)), "kept").when(empty, "noop_empty_patch").otherwise(F.when(F.col("action") == "refine", "refined").otherwise("added"))
    p = p.withColumn("apply_status", status)
    both = rules.join(p, F.col("case_id") == F.col("__c"), "left")
    hit = (F.col("apply_status") == "refined") & (F.col("rule_id") == F.col("__id"))
    old = both.select("case_id", "pos", "rule_id", F.when(F.coalesce(hit, F.lit(False)), F.col("__rule")).otherwise(F.col("rule")).alias("rule"), "apply_status")
    last = rules.groupBy(F.col("case_id").alias("__r")).agg(F.max("pos").alias("__last"), F.collect_set("rule_id").alias("__ids"))
    new = p.where("apply_status in ('refined', 'added')").join(last, F.col("__c") == F.col("__r"), "left")
    new = new.where((F.col("apply_status") == "added") | ~F.coalesce(F.array_contains("__ids", F.col("__id")), F.lit(False)))
    added = new.select(F.col("__c").alias("case_id"), (F.coalesce("__last", F.lit(-1)) + 1).alias("pos"), F.col("__id").alias("rule_id"), F.col("__rule").alias("rule"), "apply_status")
    return old.unionByName(added)


def expand_by_role(catalog: DataFrame, classified: DataFrame, sinks: DataFrame) -> DataFrame:
    """A catalog with the helpers that a review gave a role: ``name, role,
    callees, code, evidence``. Sinks must pass the wrapper gate; other roles
    than source, sink and sanitizer add nothing."""
    gated = gate_wrappers(classified, sinks).where("role in ('source', 'sanitizer') or role = 'sink' and accepted")
    new = gated.select("role", F.lit(0).alias("pos"), identifier("name").alias("pattern")).where("pattern is not null")
    return merged(catalog, new)[0]
