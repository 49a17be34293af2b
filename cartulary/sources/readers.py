"""Readers: code, tool output, results, advisories, diffs, catalogs."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import human_size
from .writers import exists

IGNORED = ("__pycache__", "venv", "node_modules")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Readable files below ``root``: ``file_path`` (relative), ``text``,
    ``n_lines`` (1 when empty), ``size`` (S05). Files that are no UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # A file is UTF-8 if decoding and encoding again changes nothing.
    text = F.col("content").cast("string")
    base = F.regexp_replace(F.lit(str(root)), "^file:/*", "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.regexp_replace(F.substr(path, F.length(base) + 1), "^/+", "")
    found = raw.where(F.is_valid_utf8(text)).select(rel.alias("file_path"), text.alias("text"), F.size(F.split(text, "\n", -1)).alias("n_lines"), F.col("length").alias("size"))
    empty = [(f, "", 1, 0) for f in _empty_files(spark, root) if fnmatch(f.rpartition("/")[2], glob)]
    return found.union(spark.createDataFrame(empty, found.schema)) if empty else found


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files of no bytes, which Spark's reader leaves out, from a listing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, files, out = fs.makeQualified(p).toUri().getPath(), fs.listFiles(p, True), []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0:
            out.append(status.getPath().toUri().getPath().removeprefix(base).lstrip("/"))
    return out


def read_file(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_files(spark, root).where(F.col("file_path") == name)


def file_units(files: DataFrame) -> DataFrame:
    return files.select(
        F.concat(F.lit("synthetic:file:"), "file_path").alias("id"), F.lit("File").alias("kind"), F.col("text").alias("code"), F.col("file_path").alias("name"), "file_path", F.lit(1).alias("line_start"), F.col("n_lines").cast("int").alias("line_end")
    )


def tree_entries(files: DataFrame) -> DataFrame:
    """Files and the folders above them: ``path, parent, name, is_dir, size,
    rank`` (S07). Folders come first, then names; dot names and build folders
    are left out."""
    parts = F.split("file_path", "/")
    kept = files.withColumn("__p", parts).where(~F.exists("__p", lambda x: x.startswith(".") | x.isin(*IGNORED)))
    up = kept.select(F.explode(F.sequence(F.lit(1), F.size("__p"))).alias("n"), "__p", "size")
    rows = up.select(F.array_join(F.slice("__p", 1, F.col("n")), "/").alias("path"), F.array_join(F.slice("__p", 1, F.col("n") - 1), "/").alias("parent"), F.element_at("__p", F.col("n")).alias("name"), (F.col("n") < F.size("__p")).alias("is_dir"), "size")
    rows = rows.groupBy("path", "parent", "name", "is_dir").agg(F.sum("size").alias("size"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_dir"), "name"))).withColumn("shown_size", human_size("size"))


def tree_text(files: DataFrame) -> DataFrame:
    """One row ``tree``: the listing as indented text."""
    rows = tree_entries(files)
    # A path sorts below its parent, folders first: mark folders with a lower sign.
    key = F.array_join(F.transform(F.split("path", "/"), lambda x, i: F.concat(F.when((i + 1 < F.size(F.split("path", "/"))) | F.col("is_dir"), F.lit("\u0001")).otherwise(F.lit("\u0002")), x)), "/")
    depth = F.size(F.split("path", "/")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), "name", F.when(F.col("is_dir"), "/").otherwise(F.concat(F.lit(" ("), "shown_size", F.lit(")"))))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("l")))), lambda x: x.l), "\n").alias("tree"))


PARSED = "id string, kind string, code string, name string, file_path string, line_start int, line_end int, column_start int, is_external boolean, is_synthetic boolean, metadata string, src string, dst string, edge string, callsite_code string, callsite_line int"


def parse_python(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, call and containment edges, and flow edges of Python sources.

    Besides files, classes, functions, parameters, calls, field accesses and
    identifiers there are units of modules, statements, comments, variables (at
    their first assignment; a function's own are local, a module's global) and
    of the other expressions that operators and displays make (S08). A module
    has no code of its own: it is its file's.
    Each file is parsed on its own, so calls resolve within the file by name.
    Flow edges run from a name's or attribute's reading to the assignment, the
    call or the return it is part of, and from assignments and parameters to
    later readings. Files with syntax errors, or nested
    beyond the parser's stack, give their file unit only.
    """

    def parse(batches):
        import ast
        import io
        import tokenize

        import pandas as pd

        cols = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            out = []

            def unit(kind, node, name, path, out=out):
                # Chained calls begin at one place, so the end is part of the id.
                uid = f"{path}:{kind}:{node.lineno}:{node.col_offset}:{node.end_lineno}:{node.end_col_offset}:{name}"
                return plain(uid, kind, ast.unparse(node), name, path, node.lineno, node.end_lineno, node.col_offset)

            def plain(uid, kind, code, name, path, first, last, column, out=out):
                out.append({"id": uid, "kind": kind, "code": code, "name": name, "file_path": path, "line_start": first, "line_end": last, "column_start": column, "is_external": False, "is_synthetic": False})
                return uid

            def variables(node, kind, path, seen, outside):
                """Units of the names a scope assigns first, and of the scopes below."""
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                        declared = {n for d in ast.walk(child) if isinstance(d, ast.Global | ast.Nonlocal) for n in d.names}
                        variables(child, "LocalVariable", path, set(), declared)
                    elif isinstance(child, ast.ClassDef):
                        variables(child, None, path, set(), set())
                    else:
                        if isinstance(child, ast.Name) and isinstance(child.ctx, ast.Store) and kind and child.id not in seen | outside:
                            seen.add(child.id)
                            unit(kind, child, child.id, path)
                        variables(child, kind, path, seen, outside)

            def comments(text, path):
                try:
                    for t in tokenize.generate_tokens(io.StringIO(text).readline):
                        if t.type == tokenize.COMMENT:
                            plain(f"{path}:Comment:{t.start[0]}:{t.start[1]}", "Comment", t.string, t.string.lstrip("# "), path, t.start[0], t.end[0], t.start[1])
                except (tokenize.TokenError, SyntaxError):
                    return

            def edge(a, b, kind, code=None, line=None, out=out):
                out.append({"src": a, "dst": b, "edge": kind, "callsite_code": code, "callsite_line": line})

            for path, text in zip(batch["file_path"], batch["text"], strict=True):
                file_id, begin = f"synthetic:file:{path}", len(out)
                out.append({"id": file_id, "kind": "File", "code": text, "name": path, "file_path": path, "line_start": 1, "line_end": text.count("\n") + 1, "is_external": False, "is_synthetic": True})
                try:
                    tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                try:
                    functions, inner = {}, set()
                    last = text.count("\n") + 1
                    plain(f"{path}:Module", "Module", None, path.removesuffix(".py").replace("/", "."), path, 1, last, 0)
                    variables(tree, "GlobalVariable", path, set(), set())
                    comments(text, path)
                    for node in ast.walk(tree):
                        if isinstance(node, ast.stmt) and not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                            unit("Statement", node, type(node).__name__, path)
                        elif isinstance(node, ast.expr) and not isinstance(node, ast.Call | ast.Attribute | ast.Name | ast.Constant | ast.Slice | ast.FormattedValue | ast.JoinedStr):
                            if id(node) not in inner:
                                unit("Expression", node, type(node).__name__, path)
                            # A chain of operators is one expression.
                            if isinstance(node, ast.BinOp) and isinstance(node.left, ast.BinOp):
                                inner.add(id(node.left))

                    def walk(node, owner, scope, path=path, functions=functions, file_id=file_id):
                        """Emit units below a node; return ids whose value flows out of it."""
                        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                            uid = unit("Function", node, node.name, path)
                            functions[node.name] = uid
                            edge(uid, file_id, "ContainedIn")
                            inner = dict(scope)
                            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                                inner[a.arg] = [unit("Parameter", a, a.arg, path)]
                            for child in node.body:
                                walk(child, uid, inner)
                            return []
                        if isinstance(node, ast.ClassDef):
                            uid = unit("Class", node, node.name, path)
                            for child in node.body:
                                walk(child, owner, dict(scope))
                            return [uid]
                        if isinstance(node, ast.Call):
                            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
                            uid = unit("Call", node, name, path)
                            edge(owner, name, "calls-by-name", ast.unparse(node)[:200], node.lineno)
                            for child in ast.iter_child_nodes(node):
                                for source in walk(child, owner, scope):
                                    edge(source, uid, "flow")
                            return [uid]
                        if isinstance(node, ast.Attribute):
                            uid = unit("FieldAccess", node, node.attr, path)
                            for source in walk(node.value, owner, scope):
                                edge(source, uid, "flow")
                            return [uid]
                        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
                            uid = unit("Identifier", node, node.id, path)
                            for source in scope.get(node.id, []):
                                edge(source, uid, "flow")
                            return [uid]
                        if isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign) and node.value is not None:
                            sources = walk(node.value, owner, scope)
                            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                            for target in targets:
                                for name in (n for n in ast.walk(target) if isinstance(n, ast.Name)):
                                    scope[name.id] = sources + (scope.get(name.id, []) if isinstance(node, ast.AugAssign) else [])
                            return sources
                        found = []
                        for child in ast.iter_child_nodes(node):
                            found += walk(child, owner, scope)
                        return found if isinstance(node, ast.expr) else []

                    walk(tree, file_id, {})
                    for name, uid in functions.items():
                        edge(name, uid, "names")
                        out[-1]["file_path"] = path
                    for row in out[begin:]:
                        if row.get("edge") == "calls-by-name" and "file_path" not in row:
                            row["file_path"] = path
                except RecursionError:
                    del out[begin + 1 :]
            yield pd.DataFrame(out, columns=cols).astype(object).where(lambda d: d.notna(), None)

    rows = files.select("file_path", "text").mapInPandas(parse, PARSED)
    units = rows.where("id is not null").drop("src", "dst", "edge", "callsite_code", "callsite_line").dropDuplicates(["id"])
    names = rows.where("edge = 'names'").select("file_path", F.col("src").alias("dst"), F.col("dst").alias("target"))
    calls = rows.where("edge = 'calls-by-name'").join(names, ["file_path", "dst"])
    calls = calls.select("src", F.col("target").alias("dst"), F.lit("Calls").alias("kind"), F.lit(None).cast("string").alias("level"), "callsite_code", "callsite_line")
    inside = rows.where("edge = 'ContainedIn'").select("src", "dst", F.lit("ContainedIn").alias("kind"), F.lit("file").alias("level"), "callsite_code", "callsite_line")
    edges = calls.unionByName(inside).withColumn("metadata", F.to_json(F.struct("callsite_code", "callsite_line")))
    return units, edges, rows.where("edge = 'flow'").select("src", "dst").distinct()


def read_pattern_results(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a pattern tool's JSON output."""
    schema = "results ARRAY<STRUCT<path: STRING, check_id: STRING, start: STRUCT<line: INT>, `end`: STRUCT<line: INT>, extra: STRUCT<message: STRING, lines: STRING, metadata: STRUCT<sink_api: STRING>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("results").alias("finding_index", "r"))
    return rows.select(
        "finding_index", F.col("r.path").alias("file_path"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), F.col("r.check_id").alias("rule_id"), F.col("r.extra.message").alias("message"), F.col("r.extra.lines").alias("code_snippet"), F.col("r.extra.metadata.sink_api").alias("sink_api")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).option("multiLine", "true").json(path)


def resume_results(spark: SparkSession, path: str) -> DataFrame:
    """The results an earlier run left, to go on from: no rows where it left
    none, or no array of cases (S16)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.RESULTS)
    return read_results(spark, path).where("cve_id is not null")


def left_to_run(planned: DataFrame, done: DataFrame, skip: DataFrame | None = None, key: str = "cve_id") -> DataFrame:
    """Planned cases that no earlier row holds and nobody asked to skip."""
    out = planned.join(done.select(key).distinct(), key, "left_anti")
    return out if skip is None else out.join(skip.select(key).distinct(), key, "left_anti")


def read_json_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All JSON files below a folder; malformed ones are left out."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "DROPMALFORMED").json(root)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_diffs(spark: SparkSession, root: str) -> DataFrame:
    """``case_id`` (the file's name without its ending) and ``diff``."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.diff").text(root)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.diff$", "")
    return rows.select(name.alias("case_id"), F.col("value").alias("diff"))


def resolve_diffs(cases: DataFrame, diffs: DataFrame) -> DataFrame:
    """Diffs of cases by the path they name: whole, or its base name."""
    base = F.regexp_replace(F.element_at(F.split("patch_diff_path", "/"), -1), r"\.diff$", "")
    return cases.withColumn("__b", base).join(diffs.withColumnRenamed("case_id", "__d"), F.col("__b") == F.col("__d"), "left").drop("__b", "__d")


def catalog_from(spark: SparkSession, data: dict) -> DataFrame:
    """A catalog from its parsed YAML or JSON."""
    rows = []
    for role, part, key in (("source", "sources", "pattern"), ("sink", "sinks", "api"), ("sanitizer", "sanitizers", "api")):
        rows += [(role, i, str(x[key] if isinstance(x, dict) else x)) for i, x in enumerate(data.get(part) or [])]
    return spark.createDataFrame(rows, schemas.CATALOG)


def load_config(text: str) -> dict:
    """Settings from YAML where its parser is there, else from JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def decode_response(text: str) -> object:
    """A recorded tool answer: a definition's head, quotes, ``Some`` and
    ``None`` stripped, JSON parsed if it is that (S03)."""
    text = text.strip()
    if text.startswith("val ") and "=" in text:
        text = text.split("=", 1)[1].strip()
    if text.startswith("Some(") and text.endswith(")"):
        text = text[5:-1].strip()
    if text in ("None", ""):
        return None
    if text.startswith('"""') and text.endswith('"""') and len(text) >= 6:
        text = text[3:-3]
    try:
        value = json.loads(text)
    except ValueError:
        return text
    if isinstance(value, str) and value[:1] in "[{":
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


