"""Scalar functions over text and paths, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Truncation of evidence text.
EVIDENCE_CHARS = 240


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tail(x: Column | str, sep: str = ".") -> Column:
    """The part after the last separator."""
    return F.element_at(F.split(col(x), "[" + sep + "]", -1), -1)


def basename(path: Column | str) -> Column:
    return tail(path, "/")


def paths_match(a: Column | str, b: Column | str) -> Column:
    """Same base name, or one path ends with the other; an empty path matches
    any (P01)."""
    a, b = col(a), col(b)
    return (basename(a) == basename(b)) | a.endswith(b) | b.endswith(a)


def paths_suffix(a: Column | str, b: Column | str) -> Column:
    """One path ends with the other."""
    a, b = col(a), col(b)
    return a.endswith(b) | b.endswith(a)


def near(line: Column | str, other: Column | str, tolerance: int = 5) -> Column:
    """Lines at most ``tolerance`` apart."""
    return F.abs(col(line) - col(other)) <= tolerance


def in_range(line: Column | str, start: Column | str, end: Column | str, tolerance: int = 0) -> Column:
    """A line within a range widened by ``tolerance``."""
    return col(line).between(col(start) - tolerance, col(end) + tolerance)


def covers(outer: str, inner: str) -> Column:
    """Location containment (P04): same file, and the lines lie inside."""
    return (
        (F.col(f"{outer}.file_path") == F.col(f"{inner}.file_path"))
        & (F.col(f"{outer}.line_start") <= F.col(f"{inner}.line_start"))
        & (F.col(f"{outer}.line_end") >= F.col(f"{inner}.line_end"))
    )


def is_synthetic(unit_id: Column | str) -> Column:
    return col(unit_id).startswith("synthetic:")


def evidence_lenient(expr: Column | str, snippet: Column | str) -> Column:
    """An empty expression counts as present."""
    e = F.trim(F.coalesce(col(expr), F.lit("")))
    return (e == "") | F.coalesce(col(snippet), F.lit("")).contains(e)


def evidence_strict(expr: Column | str, snippet: Column | str) -> Column:
    """At least two characters, and present."""
    e = F.trim(F.coalesce(col(expr), F.lit("")))
    return (F.length(e) >= 2) & F.coalesce(col(snippet), F.lit("")).contains(e)


def snippet(*parts: str) -> Column:
    """Non-empty parts joined by line feeds."""
    return F.array_join(F.filter(F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), lambda p: p != ""), "\n")


def normal_space(x: Column | str, chars: int | None = 120) -> Column:
    """White space of any kind to one space, trimmed, cut to ``chars``."""
    out = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))
    return F.substring(out, 1, chars) if chars else out


def truncate(x: Column | str, chars: int = EVIDENCE_CHARS) -> Column:
    """Longer text is cut to end in three dots."""
    x = col(x)
    return F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars - 3), F.lit("..."))).otherwise(x)


#: What text cells of reports keep at most: any, actions, diffs, notes.
TEXT_CAP, ACTIONS_CAP, DIFF_CAP, NOTES_CAP = 500, 1000, 6000, 200


def compact_text(x: Column | str, cap: int = TEXT_CAP) -> Column:
    """A report's cell: line ends as line feeds, cut to ``cap`` characters without a
    mark; null is empty (T04)."""
    plain = F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), "\r\n?", "\n")
    return F.substring(plain, 1, cap)


def numbered(lines: Column, first: Column) -> Column:
    """Lines with their numbers, right-aligned to five digits, joined."""
    number = lambda i: (first + i).cast("string")
    made = F.transform(lines, lambda line, i: F.concat(F.when(F.length(number(i)) < 5, F.lpad(number(i), 5, " ")).otherwise(number(i)), F.lit("| "), line))
    return F.array_join(made, "\n")


def identifier(x: Column | str) -> Column:
    """A dotted identifier cleaned of comments, arguments and outer dots, or
    null where none is left."""
    cut = F.regexp_extract(F.split(F.trim(col(x)), "#", 2)[0], r"^\s*([^(\[<, \t]*)", 1)
    name = F.regexp_replace(F.trim(cut), r"^\.+|\.+$", "")
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"), name)


def escaped(x: Column | str) -> Column:
    """A literal for use inside a regular expression."""
    return F.regexp_replace(col(x), r"([^A-Za-z0-9_])", r"\\$1")


def regex_union(patterns: list[str]) -> str:
    """One expression for all patterns that compile; one that never matches
    where none does (P14). An empty pattern would match anything and goes."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
        except (re.error, TypeError):
            continue
        if p:
            good.append(f"(?:{p})")
    return "|".join(good) or "(?!)"


def hash16(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 16)


def human_size(n: Column | str) -> Column:
    """Bytes with one decimal and a unit of 1024s."""
    n = col(n).cast("double")
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string(f"%.1f{unit}", n / 1024**k)
        out = F.when(n < 1024 ** (k + 1), text) if out is None else out.when(n < 1024 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1fTB", n / 1024**4))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(col(whole) > 0, col(part).cast("double") / col(whole)).otherwise(F.lit(0.0))


def f1(p: Column | str, r: Column | str) -> Column:
    return F.when(col(p) + col(r) > 0, 2 * col(p) * col(r) / (col(p) + col(r))).otherwise(F.lit(0.0))


def recover_json(text: Column | str, field: str) -> Column:
    """A field of JSON text: strict, from a fenced block, or by its pattern."""
    text = col(text)
    strict = F.get_json_object(text, f"$.{field}")
    fenced = F.get_json_object(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), f"$.{field}")
    loose = F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"?([^",}}\n]*)', 1), F.lit(""))
    return F.coalesce(strict, fenced, F.trim(loose))


def head_tail(x: Column | str, lines: int) -> Column:
    """Text of more than ``lines`` lines cut to its first and last halves, with
    a line of dots between (W09)."""
    parts = F.split(col(x), "\n", -1)
    half = lines // 2
    cut = F.concat(F.slice(parts, 1, half), F.array(F.lit("...")), F.slice(parts, F.size(parts) - half + 1, half))
    return F.when(F.size(parts) > lines, F.array_join(cut, "\n")).otherwise(col(x))


def code_lines(x: Column | str) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(col(x), F.lit("")), "\n", -1), lambda line: F.trim(line) != ""))
