"""Benchmark decontamination by SimHash over item-sized windows, native.

1. Words are lower-case runs of letters and digits. Windows of an item's size
   are looked at where a five-word shingle of an item stands. A shingle weighs
   less the more documents hold it; a document that holds none of an item's
   heaviest shingles, just enough to exceed what a window may lack, has no
   window that reaches the threshold for it. This loses nothing: a window that
   starts elsewhere holds no more of the item than the one that starts at its
   first shared shingle.
2. Each window gets a 64-bit SimHash of its words, as the items do. A multi-index
   finds the items within RADIUS bits: two fingerprints that near agree within
   PROBE bits in one of BLOCKS blocks, so items are indexed under all values that
   near to each of their blocks, and a window looks up its four.
3. Candidates are verified: the weighted share of the item's shingles that the
   window holds must reach the threshold.
4. Altered ends move a fingerprint by any number of bits, so the radius alone
   would lose similar pairs. The pairs of step 1 for which no window within the
   radius was verified are verified without fingerprints, at every start that
   can be best. So every document and item with a window at the threshold is
   found, near in bits or not.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, set_aside

SHINGLE = 5
#: Bits that the multi-index reaches: copies and lightly edited windows.
RADIUS = 12
#: Blocks of a fingerprint, and the bits that one of them may differ in.
BLOCKS = 4
PROBE = RADIUS // BLOCKS
THRESHOLD = 0.8
#: Item shingles up to which their table is broadcast; beyond, it is joined by
#: shuffling.
BROADCAST_ROWS = 1_000_000


def words_of(text: str) -> Column:
    """The words of a text; none for null or where there is no letter or digit."""
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _shingles(words: str, k: str) -> str:
    """SQL: hashes of all runs of k words, by place."""
    return f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64(slice({words}, i + 1, {k}))), array())"


def simhash(words: str) -> Column:
    """64-bit SimHash of an array of words: bit b is the majority of bit b of
    the words' hashes.

    Four bits are counted at once, in lanes of 16 bits of a long; arrays too
    long for a lane are counted bit by bit, to the same result.
    """
    lanes = "transform(sequence(0, 15), j -> aggregate(t.h, 0L, (a, x) -> a + (shiftrightunsigned(x, j) & 281479271743489L)))"
    packed = f"transform(array(named_struct('n', size(t.h), 'l', {lanes})), u -> transform(sequence(0, 63), b -> 2 * (shiftrightunsigned(u.l[b % 16], 16 * (b div 16)) & 65535L) > u.n))[0]"
    plain = "transform(sequence(0, 63), b -> 2 * aggregate(t.h, 0, (a, x) -> a + cast(shiftrightunsigned(x, b) & 1L as int)) > size(t.h))"
    bits = f"if(size(t.h) < 65536, {packed.replace('b div 16', 'cast(b div 16 as int)')}, {plain})"
    whole = f"aggregate(zip_with({bits}, sequence(0, 63), (m, b) -> if(m, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    return F.expr(f"transform(array(named_struct('h', transform({words}, w -> xxhash64(w)))), t -> {whole})[0]")


def _block(fp: str, number: str = "b") -> str:
    """SQL: one block of a fingerprint."""
    return f"cast(shiftrightunsigned({fp}, {64 // BLOCKS} * {number}) & {(1 << 64 // BLOCKS) - 1}L as int)"


def hamming_index(items: DataFrame, key: str, fp: str) -> DataFrame:
    """``items`` under each block's values within PROBE bits: ``block``,
    ``value``, ``key`` and ``fp``."""
    width = 64 // BLOCKS
    near = sorted(sum(1 << bit for bit in bits) for n in range(PROBE + 1) for bits in combinations(range(width), n))
    masks = "array(" + ", ".join(map(str, near)) + ")"
    rows = items.select(key, fp, F.explode(F.expr(f"sequence(0, {BLOCKS - 1})")).alias("block"))
    rows = rows.select(key, fp, "block", F.expr(_block(fp, "block")).alias("own"))
    return rows.select(key, fp, "block", F.explode(F.expr(f"transform({masks}, m -> own ^ m)")).alias("value"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A window of each document and item that is similar enough: the most
    similar within the radius, else the most similar of all; of those the nearest
    in bits, then the first.

    Returns ``id_col``, ``item_id``, ``start`` (word, from 0), ``n_words``,
    ``distance`` (bits) and ``similarity``. Items without words match nothing;
    items of fewer words than a shingle are one shingle. Null and empty texts
    hold no window. Rows equal in id and text count as one document; of rows with
    an equal id and other texts the best window stands. No rows without leaks or
    for empty tables.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("t"))
    found = _windows(base.select("id", "t", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")), items)
    best = Window.partitionBy("id", "item_id").orderBy(F.desc("near"), F.desc("similarity"), "distance", "s", "h", "g")
    out = found.withColumn("r", F.row_number().over(best)).where("r = 1")
    return out.select(F.col("id").alias(id_col), "item_id", F.col("s").alias("start"), F.col("n").alias("n_words"), "distance", F.round("similarity", 6).alias("similarity"))


def _windows(base: DataFrame, items: DataFrame) -> DataFrame:
    """Verified windows of texts (``id, t`` and hashes ``h, g`` of t): ``id, h, g,
    item_id, s, n, distance, similarity`` and whether they are ``near``."""
    doc = ["id", "h", "g"]

    def same(a: str, b: str) -> Column:
        return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in doc))

    items = items.select("item_id", words_of("t").alias("words")).where("size(words) > 0")
    items = items.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(SHINGLE))).withColumn("fp", simhash("words")).withColumn("ik", F.xxhash64("item_id", "words"))
    items = cut(items.dropDuplicates(["item_id", "words"]), "items")
    grams = items.select("ik", "n", "k", F.posexplode(F.expr(_shingles("words", "k"))).alias("o", "gram"))
    lengths = [r.k for r in items.select("k").distinct().orderBy("k").toLocalIterator()]  # at most SHINGLE
    known = grams.select("k", "gram").distinct()
    small = known.count() <= BROADCAST_ROWS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    worded = base.select(*doc, words_of("t").alias("words"))
    hits = worded.where("false").select(*doc, F.lit(0).alias("p"), F.lit(0).cast("long").alias("gram"), F.lit(1).alias("k"))
    for k in lengths:
        found = worded.select(*doc, F.posexplode(F.expr(_shingles("words", str(k)))).alias("p", "gram"))
        hits = hits.unionByName(found.join(sent(known.where(F.col("k") == k)), "gram").select(*hits.columns))
    hits = cut(hits.distinct(), "hits")

    weights = hits.select(*doc, "k", "gram").distinct().groupBy("k", "gram").agg(F.count("*").alias("df"))
    weights = known.join(weights, ["k", "gram"], "left").select("k", "gram", (1 / F.log2(1 + F.greatest("df", F.lit(1)))).alias("weight"))
    of_item = grams.groupBy("ik", "n", "k", "gram").agg(F.collect_set("o").alias("o")).join(weights, ["k", "gram"])
    every = Window.partitionBy("ik")
    heavier = every.orderBy(F.desc("weight"), "gram").rowsBetween(Window.unboundedPreceding, -1)
    of_item = of_item.withColumn("total", F.sum("weight").over(every)).withColumn("ahead", F.coalesce(F.sum("weight").over(heavier), F.lit(0.0)))
    of_item = cut(of_item, "weights")

    # A window that lacks all of these lacks too much.
    lead = of_item.where(F.col("ahead") <= (1 - THRESHOLD) * F.col("total") + 1e-9).select("ik", "k", "gram")
    pairs = hits.join(sent(lead), ["k", "gram"]).select(*doc, "ik").distinct()
    there = hits.alias("x").join(pairs.alias("y"), same("x", "y")).select("x.*", "ik")
    there = cut(there.join(sent(of_item), ["ik", "k", "gram"]).drop("ahead"), "shared")
    # Windows that begin with a shared shingle, or line one up with its place.
    starts = cut(there.select(*doc, "ik", "n", F.explode(F.expr("array_union(array(p), transform(o, x -> greatest(p - x, 0)))")).alias("s")).distinct(), "starts")

    asked = starts.select(*doc, "s", "n").distinct().groupBy(*doc).agg(F.collect_list(F.struct("s", "n")).alias("w"))
    cutting = base.alias("x").join(asked.alias("y"), same("x", "y")).select("x.*", "w").dropDuplicates(doc).withColumn("words", words_of("t"))
    prints = cutting.select(*doc, F.explode(F.expr("transform(w, v -> named_struct('s', v.s, 'n', v.n, 'words', slice(words, v.s + 1, v.n)))")).alias("w")).select(*doc, "w.s", "w.n", simhash("w.words").alias("fp"))
    prints = cut(prints, "prints")

    def verified(windows: DataFrame) -> DataFrame:
        """The windows (doc, ik, s, n) that hold enough of their item. They meet
        the shingles of their own two stretches of the text only."""
        spread = windows.withColumn("at", F.explode(F.expr("array(s div n, s div n + 1)")))
        near = there.withColumn("at", F.expr("p div n")).withColumnRenamed("n", "n_item")
        held = spread.alias("x").join(near.alias("y"), same("x", "y") & F.expr("x.ik = y.ik and x.at = y.at and y.p between x.s and x.s + x.n - y.k"))
        held = held.select(*[f"x.{c}" for c in doc], "x.ik", "x.s", "x.n", "y.gram", "y.weight", "y.total").distinct()
        held = held.groupBy(*doc, "ik", "s", "n").agg((F.sum("weight") / F.max("total")).alias("similarity"))
        return held.where(F.col("similarity") >= THRESHOLD - 1e-12).withColumn("similarity", F.round("similarity", 9))

    # The multi-index: a window and an item of its size that agree, nearly, in a block.
    index = hamming_index(items.select("ik", "n", "fp"), "ik", "fp").join(items.select("ik", "n"), "ik")
    looked = prints.select(*doc, "s", "n", "fp", F.explode(F.expr(f"sequence(0, {BLOCKS - 1})")).alias("block")).withColumn("value", F.expr(_block("fp", "block")))
    index = index.withColumnRenamed("fp", "fp2")
    met = looked.join(index, ["n", "block", "value"]).where(f"bit_count(fp ^ fp2) <= {RADIUS}")
    met = met.select(*doc, "ik", "s", "n").distinct()
    by_index = cut(verified(met), "near")
    done = by_index.select(*doc, "ik").distinct()
    rest = starts.alias("x").join(done.alias("y"), same("x", "y") & F.expr("x.ik = y.ik"), "left_anti").select(*doc, "ik", "s", "n")
    found = by_index.withColumn("near", F.lit(True)).unionByName(verified(rest).withColumn("near", F.lit(False)))
    found = found.join(sent(items.select("ik", "item_id", F.col("fp").alias("fp2"))), "ik")
    found = found.alias("x").join(prints.alias("y"), same("x", "y") & F.expr("x.s = y.s and x.n = y.n"))
    return found.select(*[f"x.{c}" for c in doc], "item_id", "x.s", "x.n", F.expr("cast(bit_count(y.fp ^ fp2) as int)").alias("distance"), "similarity", "near")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (``text`` of
    ``benchmark``). All other rows stay as they are, repeated ones, null texts and
    columns of any name as well. Equal texts are one document here."""
    inner, names, back = set_aside(docs)
    marked = inner.withColumn("h", F.xxhash64(names[text])).withColumn("g", F.xxhash64(F.lit(1), names[text]))
    # What a text holds does not depend on its row, so texts stand for rows.
    texts = marked.select(F.lit(0).alias("id"), F.col(names[text]).alias("t"), "h", "g")
    leaks = _windows(texts, benchmark.select(F.col("item_id"), F.col("text").alias("t"))).select("h", "g").distinct()
    return back(marked.join(leaks, ["h", "g"], "left_anti"))
