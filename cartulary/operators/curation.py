"""Curating a dataset of vulnerabilities: filter, parse, de-duplicate, sample."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, cut_counted, discard
from .joins import ordered_first, running

COMMIT_URL = r"https?://github\.com/([^/]+/[^/]+)/commit/([0-9a-fA-F]{7,40})"
PULL_URL = r"https?://github\.com/([^/]+/[^/]+)/pull/([0-9]+)"
RELEASE_URL = r"https?://github\.com/([^/]+/[^/]+)/releases/tag/([^\s/]+)"
MINIMA = {"bin": 10, "sink": 3, "severity": 3}


#: Words that tell an advisory about Python, and the links that
#: make one without an ecosystem count.
PYTHON_SIGNALS = ("python", "pypi", "pip install", ".py", "django", "flask", "fastapi", "ansible", "salt", "celery", "scrapy", "paramiko")
CHANGE_URL = r"github\.com/[^/]+/[^/]+/(commit|pull)/"


def advisory_filter(advisories: DataFrame, cwe: str = "CWE-78", signals: tuple[str, ...] = PYTHON_SIGNALS) -> DataFrame:
    """Advisories of a weakness for Python (P17): by ecosystem, or by one of the
    signals anywhere in the record together with a commit or pull-request link.

    ``advisories``: ``cwes``, ``ecosystems`` and ``references`` (arrays) and whatever else
    a record holds; all columns are searched, as JSON in lower case.
    """
    python = F.exists(F.coalesce("ecosystems", F.array().cast("array<string>")), lambda e: F.coalesce(F.lower(e).isin("pip", "pypi"), F.lit(False)))
    linked = F.exists(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.coalesce(r.rlike(CHANGE_URL), F.lit(False)))
    whole, told = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in advisories.columns]))), F.lit(False)
    for s in signals:
        told = told | whole.contains(s)
    return advisories.where(F.array_contains("cwes", cwe) & (python | (linked & told)))


def keyword_filter(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text holds one of the words, letters in either case."""
    low, hit = F.lower(column), F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return df.where(hit)


def _tagged(tags: DataFrame) -> DataFrame:
    """``repo, wanted, commit``: what each version finds, which is the first tag that
    begins with it, else the tag of its name behind a v. A tag gives a row
    for each of its beginnings, so versions are looked up by equality."""
    own = tags.select("repo", "tag", "commit").where("tag <> ''")
    begun = own.select("repo", F.explode(F.expr("transform(sequence(1, length(tag)), n -> left(tag, n))")).alias("wanted"), F.struct(F.lit(0).alias("rank"), "tag").alias("place"), "commit")
    behind_v = own.where("tag like 'v_%'").select("repo", F.expr("substr(tag, 2)").alias("wanted"), F.struct(F.lit(1).alias("rank"), "tag").alias("place"), "commit")
    return begun.union(behind_v).groupBy("repo", "wanted").agg(F.min_by("commit", "place").alias("commit"))


def commit_of(references: str, pulls: DataFrame, tags: DataFrame, df: DataFrame, key: str, repo_url: str | None = None, fixed_version: str | None = None) -> DataFrame:
    """``key, commit, how``: a commit link, else a looked-up pull request, else the
    tag of the fixed version in the record's repository (``version``; if the columns
    are named), else the tag of a release link (J32). ``pulls``: ``repo, number,
    commit``; ``tags``: ``repo, tag, commit``."""
    urls = df.select(key, F.posexplode_outer(references).alias("pos", "url"))
    urls = urls.withColumns({"commit_": F.nullif(F.regexp_extract("url", COMMIT_URL, 2), F.lit("")), "pr": F.regexp_extract("url", PULL_URL, 2), "pr_repo": F.regexp_extract("url", PULL_URL, 1), "tag_": F.regexp_extract("url", RELEASE_URL, 2), "tag_repo": F.regexp_extract("url", RELEASE_URL, 1)})
    p = pulls.select(F.col("repo").alias("pr_repo"), F.col("number").cast("string").alias("pr"), F.col("commit").alias("pr_commit"))
    lookup = _tagged(tags)
    t = lookup.select(F.col("repo").alias("tag_repo"), F.col("wanted").alias("tag_"), F.col("commit").alias("tag_commit"))
    urls = urls.join(p, ["pr_repo", "pr"], "left").join(t, ["tag_repo", "tag_"], "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    out = urls.groupBy(key).agg(first("commit_").alias("a"), first("pr_commit").alias("b"), first("tag_commit").alias("c"))
    out = out.withColumn("v", F.lit(None).cast("string"))
    if repo_url and fixed_version:
        own = df.select(key, F.replace(F.col(repo_url), F.lit("https://github.com/"), F.lit("")).alias("repo"), F.col(fixed_version).alias("wanted")).where("repo <> '' and wanted <> ''")
        fixed = own.join(lookup, ["repo", "wanted"]).groupBy(key).agg(F.min("commit").alias("v"))
        out = out.drop("v").join(fixed, key, "left")
    return out.select(key, F.coalesce("a", "b", "v", "c").alias("commit"), F.when(F.col("a").isNotNull(), "commit").when(F.col("b").isNotNull(), "pull").when(F.col("v").isNotNull(), "version").when(F.col("c").isNotNull(), "tag").alias("how"))


def diff_lines(diffs: DataFrame, case: str = "case_id", text: str = "diff") -> DataFrame:
    """Lines of unified diffs with the file and hunk they belong to.

    The current file is the last ``---`` line's, the hunk the last ``@@``
    line's; both are running values over a case's lines (W08).
    """
    lines = diffs.select(F.col(case).alias("case_id"), F.posexplode(F.split(text, "\r?\n", -1)).alias("n", "line"))
    path = F.split(F.regexp_extract("line", r"^--- (?:a/)?(.*)$", 1), "\t", 2)[0]
    is_file, is_hunk = F.col("line").rlike("^--- "), F.col("line").rlike(r"^@@ -\d+")
    w = Window.partitionBy("case_id").orderBy("n")
    hunk = F.struct(F.regexp_extract("line", r"^@@ -(\d+)", 1).cast("int").alias("start"), F.expr(r"try_cast(coalesce(nullif(regexp_extract(line, '^@@ -\\d+,(\\d+)', 1), ''), '1') as int)").alias("count"), F.col("n"))
    return lines.withColumns(
        {
            "path": F.last_value(F.when(is_file, F.when(F.trim(path).isin("", "/dev/null"), "").otherwise(F.trim(path))), F.lit(True)).over(w),
            "hunk": F.last_value(F.when(is_hunk, hunk), F.lit(True)).over(w),
            "is_hunk": is_hunk,
            "is_file": is_file,
        }
    )


def old_hunks(diffs: DataFrame, case: str = "case_id", text: str = "diff") -> DataFrame:
    """Old-side ranges of each hunk: ``case_id, path, start, end``."""
    h = diff_lines(diffs, case, text).where("is_hunk and coalesce(path, '') <> '' and hunk.count > 0")
    return h.select("case_id", "path", F.col("hunk.start").alias("start"), (F.col("hunk.start") + F.col("hunk.count") - 1).alias("end"))


def diff_loc(diffs: DataFrame) -> DataFrame:
    """An estimate of a file's length: the furthest line of any hunk."""
    h = diff_lines(diffs).where("is_hunk")
    return h.groupBy("case_id").agg(F.max(F.col("hunk.start") + F.col("hunk.count")).alias("loc"))


def vulnerable_lines(diffs: DataFrame, suffix: str = ".py") -> DataFrame:
    """``case_id, path, lines, removed``: old numbers of the removed lines of the
    first such file with a hunk. Without any, the old line where its scan ends.

    Every line but an added one moves the old line on; a hunk sets it.
    """
    rows = diff_lines(diffs).where(F.col("path").endswith(suffix) & F.col("hunk").isNotNull())
    rows = rows.withColumn("file_n", F.last_value(F.when(F.col("is_file"), F.col("n")), F.lit(True)).over(Window.partitionBy("case_id").orderBy("n")))
    rows = rows.where("file_n is null or hunk.n > file_n or is_file")
    first = rows.where("is_hunk").groupBy("case_id").agg(F.min_by("path", "n").alias("first_path"))
    rows = rows.join(first, "case_id").where("path = first_path and not is_hunk and not is_file")
    added = F.col("line").startswith("+")
    ahead = F.sum(F.when(added, 0).otherwise(1)).over(Window.partitionBy("case_id", "hunk.n").orderBy("n")) - F.when(added, 0).otherwise(1)
    rows = rows.withColumn("old", F.col("hunk.start") + ahead)
    gone = F.col("line").startswith("-")
    out = rows.groupBy("case_id", "path").agg(
        F.array_sort(F.collect_list(F.when(gone, F.col("old").cast("int")))).alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("n", "line")))), lambda x: F.substring(x.line, 2, 1 << 30)), "\n").alias("removed"),
        F.max_by(F.col("old") + F.when(added, 0).otherwise(1), "n").cast("int").alias("__at"),
    )
    return out.withColumn("lines", F.when(F.size("lines") > 0, F.col("lines")).when(F.col("__at") > 0, F.array("__at")).otherwise(F.col("lines"))).drop("__at")


def sink_of(removed: str, sinks: list[str]) -> Column:
    """The first sink of the list that the removed lines hold, else unknown."""
    out = F.lit("unknown")
    for s in reversed(sinks):
        out = F.when(F.col(removed).contains(s), s).otherwise(out)
    return out


def location_key(repo: str, file: str, lines: str) -> Column:
    """A hash of repository, file and the first five lines, sorted; a null is not
    an empty string, and no part runs into another."""
    return F.sha2(F.to_json(F.struct(F.col(repo).alias("repo"), F.col(file).alias("file"), F.array_sort(F.slice(lines, 1, 5)).alias("lines")), {"ignoreNullFields": "false"}), 256)


def accept_records(records: DataFrame) -> DataFrame:
    """Add ``reason`` (null: accepted). Order of reasons: an existing
    rejection, no id, an id held by an accepted record, no patch commit, no
    vulnerable commit, a location held by an accepted record.

    ``records``: ``pos`` (their order, without ties), ``cve_id, patch_commit, vulnerable_commit,
    repo_url, vulnerable_file, vulnerable_lines, rejection``. Only accepted records block
    later ones. Records that are out for another reason hold nothing, so empty
    and null ids meet nowhere.
    """
    loc = location_key("repo_url", "vulnerable_file", "vulnerable_lines")
    static = F.when(F.coalesce("rejection", F.lit("")) != "", F.col("rejection")).when(F.coalesce("cve_id", F.lit("")) == "", "no_cve_id")
    commits = F.when(F.coalesce("patch_commit", F.lit("")) == "", "no_patch_commit").when(F.coalesce("vulnerable_commit", F.lit("")) == "", "no_vulnerable_commit")
    base = records.withColumns({"__loc": loc, "__static": static, "__commits": commits})
    cands = base.where("__static is null and __commits is null").select("pos", F.col("cve_id").alias("id"), F.col("__loc").alias("loc"))
    held, n = cut_counted(first_holders(cands), "accepted")
    if n["n"] <= SENT:
        held = F.broadcast(held)
    by_id = held.select(F.col("id").alias("cve_id"), F.col("pos").alias("__id_pos"))
    by_loc = held.select(F.col("loc").alias("__loc"), F.col("pos").alias("__loc_pos"))
    out = base.join(by_id, "cve_id", "left").join(by_loc, "__loc", "left")
    reason = F.coalesce(F.col("__static"), F.when(F.col("__id_pos") < F.col("pos"), "duplicate_cve_id"), F.col("__commits"), F.when(F.col("__loc_pos") < F.col("pos"), "duplicate_location"))
    return out.withColumn("reason", reason).select(*records.columns, "reason")


#: Accepted records up to which they go to the records, at about 100 bytes each; more
#: of them and the records are dealt out together.
SENT = 500_000
#: Rounds of first records before what is left is looked at by components; rows of
#: a component that one task goes through in order.
PEELS, FOLD = 5, 100_000


def first_holders(cands: DataFrame) -> DataFrame:
    """``pos, id, loc`` of the records that a pass in the order of ``pos`` keeps: those
    whose id and place no kept record before them has.

    A round keeps every record that comes first for both its id and its place,
    and drops those that it blocks. In an order that has nothing to do with ids
    and places few rounds are left; where a long chain of records waits for one
    another, the components of what is left are gone through in order, each of
    up to FOLD records in one task, all at once.
    """
    left, kept = cut(cands.select("pos", "id", "loc"), "records"), []
    while True:
        for _ in range(PEELS):
            # The first of each id, and what else is at its place: places are met by
            # hashes first, so no table of all places is dealt out.
            mine = cut(left.groupBy("id").agg(F.min(F.struct("pos", "loc")).alias("f")).select("f.pos", "id", "f.loc"), "mine")
            near = left.select("loc", "pos").join(mine.select(F.xxhash64("loc").alias("h")), F.xxhash64("loc") == F.col("h"), "left_semi")
            new = cut(mine.join(near.groupBy("loc").agg(F.min("pos").alias("pos")), ["loc", "pos"], "left_semi").select("pos", "id", "loc"), "kept")
            kept.append(new)
            old = left
            left, n = cut_counted(left.join(new.select("id"), "id", "left_anti").join(new.select("loc"), "loc", "left_anti"), "records")
            discard(old, mine)
            if not n["n"]:
                return functools.reduce(DataFrame.unionByName, kept)
        # Of equal id and place only the first can be kept.
        old, left = left, cut(left.groupBy("id", "loc").agg(F.min("pos").alias("pos")), "records")
        discard(old)
        parts = _conflicts(left)
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        small = parts.join(sizes.where(F.col("n") <= FOLD), "part", "left_semi")
        kind = {c: left.schema[c].dataType.simpleString() for c in ("pos", "id", "loc")}
        kept.append(cut(small.groupBy("part").applyInPandas(_in_order, ", ".join(f"{c} {t}" for c, t in kind.items())), "kept"))
        left, n = cut_counted(parts.join(sizes.where(F.col("n") > FOLD), "part", "left_semi").select("pos", "id", "loc"), "records")
        if not n["n"]:
            return functools.reduce(DataFrame.unionByName, kept)


def _in_order(part):
    ids, places, keep = set(), set(), []
    part = part.sort_values("pos")
    for i, place in zip(part["id"], part["loc"], strict=True):
        free = i not in ids and place not in places
        if free:
            ids.add(i)
            places.add(place)
        keep.append(free)
    return part.loc[keep, ["pos", "id", "loc"]]


def _conflicts(records: DataFrame) -> DataFrame:
    """``records`` with ``part``: the least ``pos`` of all that share ids or places with
    them, directly or by way of others."""
    state = cut(records.withColumn("part", F.col("pos")), "parts")
    while True:
        by_id, by_loc = (state.groupBy(c).agg(F.min("part").alias(f"by_{c}")) for c in ("id", "loc"))
        near = state.join(by_id, "id").join(by_loc, "loc").withColumn("low", F.least("part", "by_id", "by_loc"))
        # What the record of that name has found by itself holds as well.
        jump = state.select(F.col("pos").alias("low"), F.col("part").alias("jump"))
        now = near.join(jump, "low", "left").select("pos", "id", "loc", F.least("low", "jump").alias("next"), "part")
        old = state
        state, n = cut_counted(now.select("pos", "id", "loc", F.col("next").alias("part"), (F.col("next") < F.col("part")).alias("moved")), "parts", moved=F.count_if("moved"))
        state = state.drop("moved")
        discard(old)
        if not n["moved"]:
            return state


def duplicate_locations(records: DataFrame) -> DataFrame:
    """Records at a place that an earlier one holds, with that one (W05). Empty
    files and line lists are not compared."""
    loc = location_key("repo_url", "vulnerable_file", "vulnerable_lines")
    own = records.where("coalesce(vulnerable_file, '') <> '' and size(vulnerable_lines) > 0").withColumn("__loc", loc)
    # A place may be that of very many records, so the first is an aggregate.
    first = own.groupBy("__loc").agg(F.min(F.struct("pos", "cve_id")).alias("__first"))
    later = own.join(first, "__loc").where(F.struct("pos", "cve_id") != F.col("__first"))
    return later.select("cve_id", F.col("__first.cve_id").alias("first_id"))


def loc_bin(loc: str) -> Column:
    return F.when(F.col(loc) < 100, "<100").when(F.col(loc) < 500, "100-499").when(F.col(loc) < 2000, "500-1999").otherwise(">=2000")


def diversity(records: DataFrame) -> DataFrame:
    """Counts by length bin, sink and severity: ``what, value, n``."""
    b = records.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), v.cast("string").alias("value")) for w, v in (("bin", loc_bin("loc")), ("sink", F.col("sink_api")), ("severity", F.col("cvss_severity")))])).alias("x"))
    return b.select("x.*").groupBy("what", "value").agg(F.count("*").alias("n"))


def length_summary(records: DataFrame, column: str = "loc") -> DataFrame:
    """Least, most, upper median and whole mean of a length. The median is the
    value whose rank is half the count; ranks come from counts by value."""
    c = records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = c.agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * F.col("c")).alias("s"))
    # Sums go by ranges of equally many values, however the values are spread.
    cum = running(c, "v", "c", "before").withColumn("upto", F.col("before") + F.col("c")).crossJoin(F.broadcast(total.select("n")))
    median = cum.where(F.col("upto") > F.expr("n div 2")).agg(F.min("v").alias("median"))
    return total.crossJoin(median).select("n", "least", "most", "median", F.expr("s div n").alias("mean"))


def stratified_sample(records: DataFrame, target: int = 100, minima: dict[str, int] = MINIMA, seed: int = 235711) -> DataFrame:
    """A sample with a least number of each length bin, then sink, then
    severity, filled up to ``target`` (T07).

    Each step takes what its strata still need, given what the steps before
    took. Rows are ordered by a seeded hash of their id instead of a sequential
    draw. The quota may exceed ``target`` where strata are many. A stratum of any
    size costs each task the few rows that it may give: ranks go only as far as
    the strata's minima, so Spark keeps no more of them before the shuffle.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col("cve_id").cast("string"))).alias("__h"), F.col("cve_id")]
    df = records.withColumn("__h", order[0]).withColumn("__bin", loc_bin("loc"))
    taken = None
    for column, least in (("__bin", minima["bin"]), ("sink_api", minima["sink"]), ("cvss_severity", minima["severity"])):
        left = df if taken is None else df.join(taken.select("__h", "cve_id"), ["__h", "cve_id"], "left_anti")
        first = left.withColumn("__r", F.row_number().over(Window.partitionBy(column).orderBy("__h", "cve_id"))).where(F.col("__r") <= least)
        if taken is None:
            more = first.drop("__r")
        else:
            have = taken.groupBy(F.col(column).alias("__s")).agg(F.count("*").alias("__have"))
            more = first.join(have, F.col(column).eqNullSafe(F.col("__s")), "left").where(F.col("__r") <= F.lit(least) - F.coalesce("__have", F.lit(0))).drop("__r", "__s", "__have")
        taken = cut(more if taken is None else taken.unionByName(more), "sample")
    rest = df.join(taken.select("__h", "cve_id"), ["__h", "cve_id"], "left_anti").orderBy("__h", "cve_id").limit(max(0, target - taken.count()))
    return taken.unionByName(rest).drop("__h", "__bin")


def supplement(existing: DataFrame, new: DataFrame, key: str = "cve_id") -> DataFrame:
    """New records whose id is not there yet, first seen, after the others."""
    fresh = ordered_first(new.join(existing.select(key), key, "left_anti"), [key], "pos")
    return existing.unionByName(fresh, allowMissingColumns=True)


def salvage(rejected: DataFrame, accepted: DataFrame, reasons: list[str], key: str = "cve_id") -> DataFrame:
    """Rejected records of given reasons whose id was not accepted."""
    return rejected.where(F.col("reason").isin(reasons)).join(accepted.select(key), key, "left_anti")
