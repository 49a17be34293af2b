"""Personal data: fixed patterns, and bootstrapped contextual extraction, native.

What the fixed patterns find are seed entities. The words around them are
lexical patterns: two words ahead, one word ahead and one behind. Patterns and
the identifier-like strings (instances) that occur in them form a graph. In
rounds, a pattern with enough different seeds of a kind has as its confidence
the mean confidence of its occurrences, and an instance has what its patterns
leave of doubt; an instance of high confidence is a seed of the next round, so
it brings in patterns that no fixed pattern supports. Instances that no fixed
pattern knows, in patterns of high confidence, are reported with the pattern's
kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, set_aside
from .spans import joined, tagged, with_matches

KINDS = ["email", "ip", "card", "phone"]
# Equal to the plain patterns, but without backtracking and with a start that
# a search need not try at every character of a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings of words that hold a digit or @ each: candidates for instances.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: An identifier has this many characters, with so many digits or an @.
LEAST_CHARS, LEAST_DIGITS = 6, 4
#: A pattern counts from this confidence and so many different seeds on.
LEAST_CONFIDENCE, LEAST_SEEDS, ROUNDS = 0.8, 5, 3


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    digit = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"


def with_base_spans(df: DataFrame, text: str, name: str = "base") -> DataFrame:
    """Add ``name``: sorted spans (start, kind number, end) of the fixed
    patterns. A null or empty text has none."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    df = with_matches(df, text, "__email", EMAIL, t.contains("@"))
    df = with_matches(df, text, "__ip", IP, t.contains(".") & digit)
    df = with_matches(df, text, "__card", CARD, digit)
    df = with_matches(df, text, "__phone", PHONE, t.contains("+"))
    ip = "forall(split(x.value, '[.]'), q -> length(ltrim('0', q)) <= 3 and cast(concat('0', right(q, 3)) as int) <= 255)"
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    card = f"length({digits}) between 12 and 19 and {_luhn(digits)}"
    phone = f"length({digits}) between 9 and 15"
    all_ = ", ".join([tagged("__email", 0), tagged("__ip", 1, ip), tagged("__card", 2, card), tagged("__phone", 3, phone)])
    return df.withColumn(name, F.expr(f"array_sort(concat({all_}))")).drop("__email", "__ip", "__card", "__phone")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of ``start``, ``kind`` (index in
    KINDS) and ``end``, sorted; code points, end exclusive. ``spans`` holds
    those of ``base`` and the discovered ones.

    All rows stay, with null, empty and repeated texts; equal texts get equal
    spans. Columns of those names in ``docs`` are replaced, all others stay,
    whatever their names. An empty table stays empty.
    """
    inner, names, back = set_aside(docs, "base", "spans")
    df = inner.withColumn("__text", F.col(names[text]))
    # One row stands for all rows of a text; two hashes tell texts apart.
    df = df.withColumn("__h", F.xxhash64("__text")).withColumn("__g", F.xxhash64(F.lit(1), "__text"))
    df = cut(_candidates(with_base_spans(df, "__text")).drop("__text"), "pii")
    found = _discover(df)
    out = df.drop("__cand").join(found, ["__h", "__g"], "left")
    more = F.expr("filter(__found, f -> not exists(base, b -> b.start < f.end and f.start < b.end))")
    out = out.withColumn("__found", F.coalesce("__found", F.expr("slice(base, 1, 0)"))).withColumn("spans", F.array_sort(F.concat("base", more)))
    return back(out, "base", "spans")


def _candidates(df: DataFrame) -> DataFrame:
    """Add ``__cand``: identifier-like strings with their place, their context
    and the kind of the base span that they hold (null: unknown)."""
    df = with_matches(df, "__text", "__c", CANDIDATE, F.col("__text").rlike("[0-9@]"), words=2)
    wide = f"length(x.value) >= {LEAST_CHARS} and (x.value like '%@%' or length(regexp_replace(x.value, '[^0-9]', '')) >= {LEAST_DIGITS})"
    word = "regexp_extract(lower({}), '{}', 1)"
    one = word.format("x.lhs", r"(\\S++)\\s*+$")
    two = word.format("x.lhs", r"(?:^|\\s)(\\S++\\s++\\S++)\\s*+$")
    behind = word.format("x.rhs", r"^\\s*+(\\S++)")
    # Signs around the string are no part of it.
    lead = "length(x.value) - length(ltrim('\"\\'(<[{:;,.', x.value))"
    trail = "length(x.value) - length(rtrim('\"\\')>]}:;,.!?', x.value))"
    kind = "get(transform(filter(base, b -> b.start < x.end and x.start < b.end), b -> b.kind), 0)"
    made = f"""transform(filter(__c, x -> {wide}), x -> named_struct('start', x.start + cast({lead} as int), 'end', x.end - cast({trail} as int), 'value', lower(trim('"\\'()<>[]{{}}:;,.!?', x.value)),
      'kind', {kind}, 'ahead1', {one}, 'ahead2', regexp_replace({two}, '\\\\s+', ' '), 'behind', {behind}))"""
    return df.withColumn("__cand", F.expr(made)).drop("__c")


def _discover(df: DataFrame) -> DataFrame:
    """``__found`` spans by text (``__h``, ``__g``)."""
    texts = df.where("size(__cand) > 0").select("__h", "__g", "__cand").dropDuplicates(["__h", "__g"])
    seen = texts.select("__h", "__g", F.explode("__cand").alias("c")).select("__h", "__g", "c.*")
    rows = []
    for pattern in ("concat('a:', ahead1)", "concat('b:', ahead2)", "concat('c:', ahead1, ' | ', behind)"):
        rows.append(seen.select("__h", "__g", "start", "end", "value", "kind", F.expr(pattern).alias("pattern")))
    seen = cut(rows[0].unionByName(rows[1]).unionByName(rows[2]), "pii-seen")
    # Edges of the graph, with how often they occur. A pattern of fewer different
    # instances than it needs seeds can never count.
    edges = seen.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("total")).where(f"values >= {LEAST_SEEDS}").drop("values")
    edges = cut(edges.join(wide, "pattern"), "pii-edges")
    # Seeds are certain; what is unknown starts without confidence.
    certain = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("trust")).distinct()
    known = certain.select("value").distinct()
    trust = cut(certain, "pii-trust")
    for _ in range(ROUNDS):
        doubt = F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))
        new = edges.drop("kind").join(known, "value", "left_anti").join(_scores(edges, trust).where(f"score >= {LEAST_CONFIDENCE / 2}"), "pattern")
        new = new.groupBy("value", "kind").agg((1 - doubt).alias("trust"))
        old, trust = trust, cut(certain.unionByName(new), "pii-trust")
        discard(old)
    best = Window.partitionBy("pattern").orderBy(F.desc("score"), "kind")
    chosen = _scores(edges, trust).withColumn("r", F.row_number().over(best)).where(f"r = 1 and score >= {LEAST_CONFIDENCE}").select("pattern", F.col("kind").alias("of"))
    found = seen.where("kind is null and end > start").join(chosen, "pattern").groupBy("__h", "__g", "start", "end").agg(F.min("of").alias("kind"))
    return found.groupBy("__h", "__g").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__found"))


def _scores(edges: DataFrame, trust: DataFrame) -> DataFrame:
    """``pattern, kind, score`` of the patterns with LEAST_SEEDS different instances
    of high confidence for the kind."""
    met = edges.drop("kind").join(trust, "value").groupBy("pattern", "kind", "total")
    sums = met.agg(F.sum(F.col("n") * F.col("trust")).alias("sure"), F.count_if(F.col("trust") >= LEAST_CONFIDENCE).alias("seeds"))
    return sums.where(f"seeds >= {LEAST_SEEDS}").select("pattern", "kind", (F.col("sure") / (F.col("total") + 1)).alias("score"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, for rows with ``doc_id`` and ``text``."""
    df = find_pii(docs)
    count = "cast(size(filter(base, s -> s.kind = {})) as bigint)"
    return df.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.expr(joined("base", KINDS)), 256).alias("base_sha256"),
        F.expr(joined("spans", KINDS)).alias("spans"),
    )
