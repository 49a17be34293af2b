"""Secret scans: key patterns and sliding-window entropy, native.

Candidate strings are runs of one class of characters. Over each slides a
window whose Shannon entropy follows from its symbols' counts; as a symbol
enters and another leaves, two counts and their part of the sum change. The
windows over the class's threshold give a span, unless the string is on the
allow-list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside
from .spans import joined, tagged, with_matches

WINDOW = 24
#: Character classes: symbols, and the entropy in bits a symbol that a window
#: of them must reach. Random hex digits make about 3.4, random base-64 symbols
#: about 4.2, words of prose under 3.8.
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 3.0),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
_PART = r"(?:[A-Z]{1,20}+(?![A-Za-z])|[a-z]{1,20}+(?![A-Za-z])|(?:[A-Z]?[a-z]{1,20}+){1,10}+(?![A-Za-z]))"
#: Candidates that are no secrets: numbers, words and words joined by signs (a
#: word is of one case, or of up to ten capitalised parts),
#: UUIDs, one part repeated, and strings that say they are examples. Repetitions
#: are possessive, so strings of any length neither overflow nor go quadratic.
ALLOWED = (
    r"^[0-9]++(?:[+/_=-]++[0-9]++)*+$",
    rf"^[+/_=-]*+{_PART}(?:[+/_=-]++{_PART})*+[+/_=-]*+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.{1,8})\1++$",
    r"(?i)example|placeholder|your_|xxxxx|changeme",
)
KINDS = ["assign", "access", "hex", "entropy"]
#: Fixed patterns; the lengths they must have are checked on their matches.
ASSIGN = r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"


def _windows(symbols: str, bits: float) -> str:
    """SQL: of a candidate x, the runs (first offset, end exclusive) of
    overlapping windows over ``bits``. Counts are kept by symbol and changed
    as the window moves."""
    w = WINDOW
    # S is the sum of c * log2(c) over the counts; entropy is log2(w) - S / w.
    f = "array(" + ", ".join(["0D", *[f"{c}D * log2({c}D)" for c in range(1, w + 1)]]) + ")"
    into, out = "q[i]", f"if(i >= {w}, q[i - {w}], 0)"
    step = f"""named_struct('c', transform(a.c, (c, k) -> c + if(k + 1 = {into}, 1, 0) - if(k + 1 = {out}, 1, 0)),
      's', a.s + if({into} = {out}, 0D, {f}[a.c[{into} - 1] + 1] - {f}[a.c[{into} - 1]] + if(i >= {w}, {f}[a.c[{out} - 1] - 1] - {f}[a.c[{out} - 1]], 0D)),
      'first', a.first, 'last', a.last, 'runs', a.runs)"""
    mark = f"i >= {w - 1} and log2({w}D) - b.s / {w} >= {bits}D - 1e-9"
    # The window that ends at i is known once the step is made, so the marks
    # are set on its result. A window beyond the run's end closes the run.
    beyond = f"{mark} and b.first >= 0 and i + 1 - {w} > b.last"
    after = f"""transform(array({step}), b -> named_struct('c', b.c, 's', b.s,
      'first', if({mark} and (b.first < 0 or i + 1 - {w} > b.last), i + 1 - {w}, b.first), 'last', if({mark}, i + 1, b.last),
      'runs', if({beyond}, concat(b.runs, array(named_struct('first', b.first, 'last', b.last))), b.runs)))[0]"""
    start = f"named_struct('c', array_repeat(0, {len(symbols)}), 's', 0D, 'first', -1, 'last', -1, 'runs', slice(array(named_struct('first', 0, 'last', 0)), 1, 0))"
    done = "z -> if(z.first < 0, z.runs, concat(z.runs, array(named_struct('first', z.first, 'last', z.last))))"
    # Symbols by number first: a character of a long string is found by walking.
    numbers = f"transform(split(x.value, ''), y -> instr('{symbols}', y))"
    return f"transform(array({numbers}), q -> aggregate(sequence(0, size(q) - 1), {start}, (a, i) -> {after}, {done}))[0]"


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secret_spans``: an array of ``start``, ``kind`` (index in KINDS)
    and ``end``, sorted; code points, end exclusive.

    ``assign``: a key word, a sign and a value of 6 characters or more; the span
    is the whole match. ``access``: 20 characters or more. ``hex``: 24 or
    more. ``entropy``: each run of overlapping windows over the threshold that no
    span of the other kinds covers. A null or empty text has none; texts may be
    of any length. All rows and other columns stay as they are, whatever their
    names, but for a column named like the result, which is replaced.
    """
    inner, names, back = set_aside(docs, "secret_spans")
    t = F.col("__text")
    low = F.lower(t)
    df = inner.withColumn("__text", F.col(names[text]))
    words = F.lit(False)
    for w in ("password", "passwd", "secret", "token", "api"):
        words = words | low.contains(w)
    df = with_matches(df, "__text", "__assign", ASSIGN, words, group=1)
    df = with_matches(df, "__text", "__access", ACCESS, t.contains("AKIA"))
    df = with_matches(df, "__text", "__hex", HEX, F.lit(True))
    base = "concat(" + ", ".join([tagged("__assign", 0, "length(x.group) >= 6"), tagged("__access", 1, "length(x.value) >= 20"), tagged("__hex", 2)]) + ")"
    df = df.withColumn("__base", F.expr(base))
    more = []
    for name, (symbols, bits) in CLASSES.items():
        sign = symbols.replace("-", "") + ("-" if "-" in symbols else "")
        column = f"__entropy_{name}"
        df = with_matches(df, "__text", column, f"(?<![{sign}])[{sign}]{{{WINDOW},}}+", F.lit(True))
        more.append(column)
        allowed = " or ".join(f"x.value rlike r'{p}'" for p in ALLOWED)
        df = df.withColumn(column, F.expr(f"filter({column}, x -> not ({allowed}))"))
        df = df.withColumn(column, F.expr(f"flatten(transform({column}, x -> transform({_windows(symbols, bits)}, r -> named_struct('start', x.start + r.first, 'kind', 3, 'end', x.start + r.last))))"))
    df = df.withColumn("__more", F.expr(f"filter(array_distinct(concat({', '.join(more)})), e -> not exists(__base, b -> b.start <= e.start and e.end <= b.end))"))
    df = df.withColumn("__more", F.expr("filter(__more, e -> not exists(__more, o -> o != e and o.start <= e.start and e.end <= o.end))"))
    return back(df.withColumn("secret_spans", F.expr("array_sort(concat(__base, __more))")), "secret_spans")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, for rows with ``doc_id`` and ``text``."""
    df = scan_secrets(docs)
    df = df.withColumn("b", F.expr("filter(secret_spans, s -> s.kind < 3)"))
    count = "cast(size(filter(b, s -> s.kind = {})) as bigint)"
    return df.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(F.expr(joined("b", KINDS)), 256).alias("base_sha256"),
        F.expr(joined("secret_spans", KINDS)).alias("spans"),
    )
