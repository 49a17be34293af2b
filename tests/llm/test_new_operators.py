"""Cover trees, source divergence and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import cover_tree
from cartulary.llm.cover_tree import near_vectors, tree
from cartulary.llm.divergence import divergence_audit
from cartulary.llm.fill_in_middle import MARKS, TOKEN, cuts, fill_in_middle, restored
from cartulary.llm.rank_select import Bits

# -- cover trees -------------------------------------------------------------


def usable(vector, label):
    return label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def plain_links(rows, threshold):
    """For each row (id, vector, label): its links and its component's least id."""
    n, links = len(rows), defaultdict(set)
    for i, (_, v, y) in enumerate(rows):
        for j, (_, w, z) in enumerate(rows):
            if i != j and usable(v, y) and usable(w, z) and y == z and len(v) == len(w):
                a, b = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((len(links[i]), min(ids, default=None)))
    return out


def clusters(rng, dims, groups, each, spread):
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=dims)
        rows += [(centre + spread * rng.normal(size=dims)) * rng.uniform(0.5, 2) for _ in range(rng.integers(1, each))]
    return rows


@pytest.mark.parametrize("leaf", [2048, 12])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, leaf):
    """Clusters of every width, copies, chains and odd rows; small cells make
    several levels of nodes and pairs of cells."""
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "PARTNERS", 2)
    monkeypatch.setattr(cover_tree, "CHUNK", 50)
    rng = np.random.default_rng(5)
    vectors = [v for spread in (0.02, 0.1, 0.3) for v in clusters(rng, 8, 6, 12, spread)]
    vectors += vectors[:9] + [3 * v for v in vectors[:4]] + [vectors[0]] * 15
    turn = np.linspace(0, 3, 25)
    vectors += [np.array([math.cos(t), math.sin(t), 0, 0, 0, 0, 0, 0]) for t in turn]
    rows = [(100 + int(k), v.tolist(), int(rng.integers(0, 2))) for k, v in enumerate(vectors)]
    rows += [(1, None, 0), (2, [0.0] * 8, 0), (3, [1.0, None] * 4, 0), (4, [1.0, math.nan] * 4, 0), (5, [math.inf] + [0.0] * 7, 0), (6, [], 0), (7, vectors[0].tolist(), None)]
    rows += [(8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (None, [2.0, 4.1], 0), (10, [1e200, 2e200], 0), (11, [-0.0, 1.0], 1), (12, [0.0, 1.0], 1), (12, [0.0, 1.0], 1)]
    rows += [(None, [1.0, 0.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    want = Counter((r[0], n, c, c is not None and r[0] == c) for r, (n, c) in zip(rows, plain_links(rows, 0.98), strict=True))
    assert found == want


def test_near_vectors_of_one_hot_label(spark, monkeypatch):
    """One label with near and far vectors; the limit itself counts as linked."""
    monkeypatch.setattr(cover_tree, "LEAF", 40)
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist(), "x") for k, v in enumerate([*rng.normal(size=(150, 16)), *(np.ones(16) + 0.05 * rng.normal(size=(150, 16)))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    own = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, threshold=0.9).collect()}
    assert [found[r[0]] for r in own] == plain_links(own, 0.9)
    exact = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in near_vectors(exact, threshold=0.6).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_vectors_columns_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 0, 7, "a", 2), (2, [1.0, 0.0], 0, 8, "b", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, __h string, n_links int")
    out = near_vectors(df)
    assert out.columns == ["vec_id", "embedding", "label", "node", "__h", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.node, r["__h"], r.n_links, r.component_id, r.kept) for r in out.collect()) == [(1, 7, "a", 1, 1, True), (2, 8, "b", 1, 1, False)]
    assert near_vectors(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        near_vectors(df, threshold=0)


def test_tree_is_a_cover_tree():
    """Centres of a level are apart, cover their vectors, and stay centres."""
    rng = np.random.default_rng(7)
    unit = cover_tree._unit(np.stack(clusters(rng, 5, 20, 12, 0.2)))
    order, path = tree(unit)
    unit = unit[order]
    chord = cover_tree._chords(unit @ unit.T)
    assert sorted(order) == list(range(len(unit))) and (np.diff(path[:, 0]) == 0).all()
    for level in range(1, cover_tree.LEVELS):
        radius = 2 / 2**level
        centres = np.unique(path[:, level])
        assert (path[centres, level] == centres).all() and set(path[:, level - 1]) <= set(centres.tolist())
        assert (chord[np.arange(len(unit)), path[:, level]] <= radius + 1e-6).all()
        for coarse in np.unique(path[:, level - 1]):
            own = np.unique(path[path[:, level - 1] == coarse, level])
            assert all(chord[a, b] > radius - 1e-6 for a in own for b in own if a != b)
        # A node's rows stand together.
        assert (np.diff(path[:, level]) != 0).sum() == len(centres) - 1


def test_dual_traversal_rules_out_most_of_clustered_vectors():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    raw = np.stack([c + 0.02 * rng.normal(size=3) for c in rng.normal(size=(60, 3)) for _ in range(20)])
    order, path = tree(cover_tree._unit(raw))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw))), pa.array(np.ones(len(raw), np.int64)), pa.array(raw[order].tolist()), pa.array(path.tolist(), pa.list_(pa.int32()))], ["n", "r", "v", "p"])
    cell, measured = cover_tree.Cell([batch], 0, 1, 2, 3), []
    x, y = cover_tree.dual(cell, cell, 0.999, measured)
    cosines = cell.unit @ cell.unit.T
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*[a.tolist() for a in np.nonzero(cosines >= 0.999)], strict=True))
    assert sum(measured) < 0.25 * len(raw) ** 2


# -- source divergence --------------------------------------------------------


def plain_audit(rows, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, frequency = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        count[lang or "", source or ""].update(words)
        frequency[lang or ""].update(set(words))
    kept = {y: [t for t, n in c.items() if n >= least] for y, c in frequency.items()}
    for y in kept:
        count[y,] = sum((count[g] for g in list(count) if len(g) == 2 and g[0] == y), Counter())

    def p(group):
        terms = kept[group[0]]
        total = sum(count[group][t] for t in terms)
        return {t: 1 + 10**9 * (count[group][t] + 2) // (total + 2 * len(terms)) for t in terms}

    groups = [g for g in count if len(g) == 2]
    own, out = {g: p(g) for g in count}, set()
    for y, s in groups:
        part = [(sum((own[y, s][t] - own[g][t]) ** 2 // (own[y, s][t] + own[g][t]) for t in kept[y]), g[1]) for g in groups if g[0] == y and g[1] != s]
        terms = [((own[y, s][t] - own[y,][t]) ** 2 // (own[y, s][t] + own[y,][t]), t) for t in kept[y] if count[y, s][t] and own[y, s][t] > own[y,][t]]
        for name, ranked in (("pair", sorted(part, key=lambda r: (-r[0], r[1].encode()))), ("term", sorted(terms, key=lambda r: (-r[0], r[1].encode()))[:10])):
            out |= {(y, s, name, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("tile", [256, 2])
def test_divergence_equals_plain(spark, monkeypatch, tile):
    monkeypatch.setattr("cartulary.llm.divergence.TILE", tile)
    rng = random.Random(3)
    words = ["Alpha", "BETA", "é", "Éa", "naïve", "漢字", "𝒳", "x1y", "don't", "zz", "K", "K", " b", "rare"]
    rows = [(" ".join(rng.choices(words[: 4 + k % 9], k=rng.randrange(0, 40))), lang, f"s{k % 7}") for lang in ("en", "de") for k in range(60)]
    rows += [(None, "en", "s0"), ("", "en", "bare"), ("12 -", "fr", "only"), ("alpha", None, None), ("alpha", None, "s1"), ("alpha " * 5000, "en", "s3"), ("new\nline\x00nul", "en", "s3")]
    rows += [("alpha beta", "en", "s6")] * 20
    docs = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(4)
    found = [tuple(r) for r in divergence_audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows, 10)


def test_divergence_of_odd_tables(spark):
    schema = "text string, lang string, source string"
    assert divergence_audit(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y")], schema)
    assert sorted(tuple(r) for r in divergence_audit(few).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence_audit(few, least_documents=1, top=None).where("part = 'term'").count() == 2


# -- fill in the middle --------------------------------------------------------


def plain_form(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    prefix, middle, suffix = ("".join(part) for part in (tokens[:a], tokens[a:b], tokens[b:]))
    p, s, m = MARKS
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def test_fill_in_middle_equals_plain_and_is_restored(spark):
    rng = random.Random(9)
    alphabet = ["a", "b ", " ", "\t", "\n", "\x0b", "\r\n", "é", "漢", "🙂", " ", "\x1f", "<P", "<", "S>", "word"]
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randrange(0, 60)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (None, "a b c"), (-5, "x <S> y"), (1002, " \t "), (1003, " lead and trail "), (1003, " lead and trail "), (1004, "long wörd " * 200_000), (1005, "x" * 100_000), (1006, "<M>")]
    rows += [(k, " ".join("ab cd") * 3) for k in range(2000, 2040)]
    docs = spark.createDataFrame([(*r, r[1], 1) for r in rows], "doc_id long, text string, own string, n int").repartition(3)
    out = fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "own", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = out.withColumn("back", restored()).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter((*r, *plain_form(*r)) for r in rows)
    assert all(r.back == (r.text or "") and r.own == r.text for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.where("false")).collect() == []
    assert fill_in_middle(docs, seed=1, rate=100, spm_rate=0).where("form = 'spm'").count() == 0


def test_rank_and_select_equal_plain():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.02, 0.5, 1.0):
            flags = rng.random(size) < share
            bits = Bits(lambda a, b, flags=flags: flags[a:b], size)
            places = np.arange(size + 1)
            assert bits.total == flags.sum()
            assert (bits.rank(places) == np.concatenate([[0], np.cumsum(flags)])).all()
            assert (bits.select(np.arange(1, bits.total + 1)) == np.flatnonzero(flags)).all()


def test_segments_do_not_change_cuts(monkeypatch):
    import pyarrow as pa

    texts = pa.array([" ab  c ", "", None, "dé f", "   ", "g" * 50])
    one, two = np.arange(6) * 7 + 3, np.arange(6) * 5 + 1
    whole = cuts(texts, one, two)
    monkeypatch.setattr("cartulary.llm.rank_select.SEGMENT", 8)
    assert all((a == b).all() for a, b in zip(whole, cuts(texts, one, two), strict=True))


def test_digest_query_agrees(spark):
    from cartulary.llm.fill_in_middle import fill_in_middle_digest

    rows = [(k, f"text {k} of some words") for k in range(40)]
    got = fill_in_middle_digest(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("form") != "plain").collect()
    assert got and all(r.restored_sha256 == hashlib.sha256(f"text {r.doc_id} of some words".encode()).hexdigest() for r in got)
    assert all(r.output_sha256 == hashlib.sha256(plain_form(r.doc_id, f"text {r.doc_id} of some words")[4].encode()).hexdigest() for r in got)
