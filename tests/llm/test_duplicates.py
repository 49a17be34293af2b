"""Joins and de-duplication against brute force on small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from cartulary.llm import common, ngram_join
from cartulary.llm.line_dedup import dedup_lines
from cartulary.llm.ngram_join import ngram_jaccard, scales, signatures
from cartulary.llm.substring_dedup import chunks_of, remove_spans, repeated_spans


def words_of(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Families of near copies around the threshold, copies, shared passages,
    short, empty and null texts, equal ids."""
    rng = random.Random(3)
    texts = [None, "", "  \n", "one", "One", "one two", "a b c", "a b c d", "A b\tc\x0bd", "x " * 40]
    passage = words_of(rng, 60)
    for _ in range(6):
        base = words_of(rng, rng.randrange(30, 200))
        for _ in range(40):
            copy = base[:]
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(base + ["new", f"n{rng.random()}"])
            texts.append(" ".join(copy))
    for _ in range(60):
        texts.append(" ".join(words_of(rng, rng.randrange(1, 80)) + passage + words_of(rng, rng.randrange(0, 30))))
    texts += [texts[20]] * 70
    rows = [(i if i % 97 else 5, t, "extra") for i, t in enumerate(texts)]
    return rows + [(None, texts[30], "null id"), (None, "fresh text", "null id")]


def shingles(text, w):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1)) if len(words) >= w else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize(("words", "percent", "above"), [(4, 85, (24, 4096)), (4, 85, (3, 12)), (5, 80, (3, 12)), (2, 76, (2, 4))])
def test_ngram_join_equals_brute_force(spark, monkeypatch, words, percent, above):
    monkeypatch.setattr(ngram_join, "PAIRS_ABOVE", above[0])
    monkeypatch.setattr(ngram_join, "TRIPLES_ABOVE", above[1])
    rows = corpus()
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, doc_id long, text string, node string").repartition(3)
    members, links = ngram_jaccard(docs, words=words, percent=percent, all_links=words == 2)
    got = {r.row: r for r in members.collect()}
    assert len(got) == len(rows)
    sets = [shingles(t, words) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                parent[find(a)] = find(b)
                if sets[a] != sets[b]:
                    linked.add(tuple(sorted((got[a].node, got[b].node))))
    for k, s in enumerate(sets):
        assert got[k].n_shingles == len(s)
        assert (got[k].node is None) == (not s)
    by_component = {}
    for k, s in enumerate(sets):
        if s:
            by_component.setdefault(got[k].component, set()).add(find(k))
    roots = [x for v in by_component.values() for x in v]
    assert all(len(v) == 1 for v in by_component.values()) and len(roots) == len(set(roots))
    found = {(r.a, r.b) for r in links.collect()}
    assert {tuple(sorted(x)) for x in found} <= linked
    if words == 2:
        assert {tuple(sorted(x)) for x in found} == linked


def test_signatures_keep_their_promise():
    """Any two sets that link share as many signatures as both need."""
    rng = random.Random(8)
    for _ in range(300):
        percent = rng.choice([76, 80, 85, 90])
        n = rng.randrange(4, 120)
        tokens = np.array(sorted(rng.sample(range(1 << 40), n + 40)), np.uint64)
        level = np.array([rng.choice([0, 1, 2, 2, 3]) for _ in tokens], np.int8)
        shared = rng.randrange(max(1, n * percent // 100), n + 1)
        common = rng.sample(range(len(tokens)), shared)
        others = [i for i in range(len(tokens)) if i not in common]
        x = sorted(common + others[: rng.randrange(0, n - shared + 1)])
        y = sorted(common + others[20 : 20 + rng.randrange(0, n - shared + 1)])
        if 100 * shared < percent * (len(x) + len(y) - shared) or x == y or min(len(x), len(y)) < 4:
            continue
        # A token that two sets share is in no one set only.
        level[common] = np.maximum(level[common], 1)
        found = []
        for own in (x, y):
            by = np.lexsort((tokens[own], level[own]))
            t, lv = tokens[own][by], level[own][by]
            parts = {k: signatures(t, lv, percent, k) for k in scales(len(own), percent)}
            found.append((parts, min(p[2] for p in parts.values())))
        need = min(found[0][1], found[1][1])
        at = max(len(x), len(y)).bit_length()
        a, b = found[0][0][at], found[1][0][at]
        assert need > 0
        met = len(np.intersect1d(a[0], b[0])) + len(np.intersect1d(a[1], b[1]))
        assert met >= need


def test_ngram_join_of_empty_table(spark):
    members, links = ngram_jaccard(spark.createDataFrame([], "doc_id long, text string"))
    assert members.count() == 0 and links.count() == 0
    with pytest.raises(ValueError, match="percent"):
        ngram_jaccard(spark.createDataFrame([], "doc_id long, text string"), percent=50)


def plain_line_dedup(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[d] = (len(lines), gone, "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_equals_plain(spark):
    rng = random.Random(1)
    pool = ["a", "b", "c", "d", " ", ""]
    rows = [(i, "\n".join(rng.choice(pool[: rng.randrange(1, 7)]) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    rows += [(200, "\n".join(f"l{i}" for i in range(3000))), (201, "\n".join(f"l{i}" for i in range(1500, 4500)))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, removed int").repartition(4)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    want = plain_line_dedup(rows)
    for d, (n, gone, rest) in want.items():
        assert (got[d].n_lines, got[d].n_removed, got[d].text) == (n, len(gone), rest)
    assert got[201].removed == "0-1499"


def test_line_dedup_of_odd_rows(spark):
    rows = [(None, "p\nq\nr"), (1, "p\nq\nr"), (1, "p\nq\nr"), (2, None), (3, ""), (4, "p\nq")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_removed, r.text) for r in got if r.doc_id != 2) == [(-1, 3, 0, "p\nq\nr"), (1, 3, 3, ""), (1, 3, 3, ""), (3, 1, 0, ""), (4, 2, 0, "p\nq")]
    assert [(r.n_lines, r.text) for r in got if r.doc_id == 2] == [(0, None)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_resist_shifts():
    import pyarrow as pa

    rng = random.Random(2)
    body = " ".join(words_of(rng, 400))
    sets = []
    for text in (body, "inserted é " + body, body + " tail"):
        data, offsets, starts, lengths = chunks_of(pa.array([text, None, ""]))
        assert lengths.sum() == len(data) and lengths.max() <= 512 and (lengths > 0).all()
        sets.append({bytes(data[a : a + n]) for a, n in zip(starts, lengths, strict=True)})
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2 and len(sets[0] & sets[2]) >= len(sets[0]) - 2
    data, _, starts, lengths = chunks_of(pa.array(["|" * 5000, "🙂" * 900]))
    assert lengths.max() <= 512 and all((data[a] & 0xC0) != 0x80 for a in starts)


def test_repeated_spans(spark):
    rng = random.Random(4)
    passage = " ".join(words_of(rng, 70, 10**6))
    rows = [(i, " ".join(words_of(rng, 120, 10**6)) + (" é🙂 " + passage + " " if i % 5 == 0 else " ") + " ".join(words_of(rng, 50, 10**6))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, rows[1][1]), (52, rows[1][1]), (None, rows[2][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(3)
    spans = repeated_spans(docs).collect()
    texts = dict(rows)
    hit = {r.doc_id for r in spans}
    assert hit == {5, 10, 15, 20, 25, 30, 35, 52, 2}
    for r in spans:
        piece = texts[r.doc_id][r.start : r.end]
        if r.doc_id % 5 == 0:
            assert piece[12:-12] in passage
            assert r.first_doc_ids[0] == 0 and r.n_words >= 24
        if r.doc_id == 52:
            assert r.first_doc_ids == [1] and r.n_words >= 150
    rest = {r.doc_id: r.text for r in remove_spans(docs.drop("start"), repeated_spans(docs)).collect()}
    assert rest[0] == texts[0] and rest[50] is None and len(rest[52]) < 40
    assert len(rest[5]) < len(texts[5]) - 200 and rest[1] == texts[1]
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequency_maps_equal_counts(spark):
    """A token in every row and repeated within rows, one at each limit, rare ones."""
    import pandas as pd
    import pyarrow as pa

    from cartulary.llm import frequency

    def tokens_of(column: pa.Array):
        for t in column.to_pylist():
            yield np.array([(int(x) * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64 for x in (t or "").split()], np.uint64)

    rng = random.Random(8)
    rows = [f"1 1 1 2 {'3' if i < 5 else ''} {'4' if i < 4 else ''} {rng.randrange(5, 900)}" for i in range(700)] + [None, ""]
    counts = pd.Series([int(x) for t in rows for x in (t or "").split()]).value_counts()
    old, frequency._FLUSH = frequency._FLUSH, 97
    try:
        maps = frequency.frequency_maps(spark.createDataFrame([(t,) for t in rows], "t string").repartition(3), tokens_of, (1, 4, 500))
    finally:
        frequency._FLUSH = old
    tokens = np.array([(int(x) * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64 for x in counts.index], np.uint64)
    want = sum((counts.to_numpy() > k).astype(np.int8) for k in (1, 4, 500))
    got = maps.levels(tokens)
    assert (got >= want).all() and (got != want).mean() < 0.02
    assert frequency.frequency_maps(spark.createDataFrame([], "t string"), tokens_of, (1,)).levels(tokens).max() == 0


def test_blocks_come_whole():
    import pyarrow as pa

    from cartulary.llm.ngram_join import _whole_blocks

    rng = random.Random(4)
    for sizes in ([1] * 50, [100], [3, 90, 2, 2, 90], [rng.randrange(1, 30) for _ in range(40)]):
        key = np.repeat(np.arange(len(sizes)) * 7 % 101, sizes)
        value = np.arange(len(key))
        for step in (1, 4, 10):
            batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + step]), pa.array(value[a : a + step])], ["part", "v"]) for a in range(0, len(key), step)]
            found = [c[0] for c in _whole_blocks(iter([*batches, batches[0].slice(0, 0)]), 20)]
            assert np.concatenate(found).tolist() == value.tolist()
            assert all(key[x[-1]] != key[y[0]] for x, y in zip(found[:-1], found[1:], strict=True))
            assert all(len(x) <= 20 + step + max(sizes) for x in found)
    assert list(_whole_blocks(iter([]), 20)) == []


@pytest.mark.parametrize("chunk", [200_000, 4])
def test_components_of_chunks(spark, monkeypatch, chunk):
    """One chunk or many give the components of a chain, a hub and repeated edges."""
    monkeypatch.setattr(common, "CHUNK", chunk)
    edges = [(i, i + 1) for i in range(40, 60)] + [(100, i) for i in range(101, 120)] + [(7, -3), (-3, 7), (7, 7), (5, 5)]
    found = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    want = {i: 40 for i in range(40, 61)} | {i: 100 for i in range(100, 120)} | {7: -3, -3: -3}
    assert sorted(map(tuple, found.collect())) == sorted(want.items())


def test_join_takes_few_jobs(spark):
    """Each job is a plan that the driver keeps: chains of near copies need few."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[k:], *(f"x{k}.{j}" for j in range(2))])) for k in range(40)]
    spark.sparkContext.setJobGroup("join", "join")
    try:
        members, _ = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("join"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component for r in members.collect()} and members.select("component").distinct().count() == 1
    assert n <= 120, n


def test_only_wanted_texts_are_taken_apart(spark):
    texts = [" ".join(f"{k}word{i}" for i in range(9)) for k in range(30)]
    longer = texts[7] + " and more"

    def node_of(tokens):
        if len(tokens) != 8:
            raise ValueError("a text that is not wanted")
        return 8

    keys = spark.createDataFrame([(ngram_join._key(np.frombuffer(longer.encode(), np.uint8)),)], "text_key long")
    sets = ngram_join._sets_of(spark.createDataFrame([(t,) for t in [*texts, longer, longer, None, ""]], "t string"), keys, 4, node_of)
    assert [(r.node, len(r.tokens)) for r in sets.collect()] == [(8, 8)]


def test_levels_ask_the_next_map_about_marked_tokens_only(spark):
    from cartulary.llm import frequency

    def tokens_of(column):
        for t in column.to_pylist():
            yield np.array([int(x) << 40 for x in t.split()], np.uint64)

    texts = spark.createDataFrame([("1 2 3",), ("2 3",), ("3",), ("3",)], "t string")
    maps = frequency.frequency_maps(texts, tokens_of, (1, 3))
    maps.levels(np.zeros(1, np.uint64))
    maps.unpacked[1] |= ~maps.unpacked[0]  # bits that no token can have set
    assert maps.levels(np.array([1, 2, 3, 4], np.uint64) << np.uint64(40)).max() <= 2
    assert maps.levels(np.array([4], np.uint64) << np.uint64(50)).tolist() == [0]
    with pytest.raises(ValueError, match="rise"):
        frequency.frequency_maps(texts, tokens_of, (3, 1))
