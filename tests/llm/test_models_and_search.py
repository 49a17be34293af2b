"""Language, nearest neighbours, decontamination and sharding."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartulary.llm.ann import balanced_parts, nearest, neighbour_graph
from cartulary.llm.decontaminate import RADIUS, find_leaks, remove_contaminated, simhash
from cartulary.llm.language import MARGIN, ORDER, Scorer, count_ngrams, fit, identify, keys, symbols, train
from cartulary.llm.language import _alphabet as alphabet
from cartulary.llm.sharding import interleave

SYLLABLES = {"aa": ["ba", "be", "bi", "lo", "la"], "bb": ["tz", "kä", "ür", "sch", "ung"], "cc": ["ção", "nh", "lh", "eu", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(5, 120)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), [6, 2, 1], k=400))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, prose(rng, "bb", 50), None), (904, "ひらがなカタカナ漢字" * 40, None), (905, prose(rng, "aa", 20000), "aa"), (906, "𝒳𝒴 🙂", None)]
    return rows, spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)


def test_language_counts_equal_plain(languages):
    rows, docs = languages
    got = {(r.lang, r.gram): r.n for r in count_ngrams(docs, "text", "lang").collect()}
    want = Counter()
    for _, t, lang in rows:
        if t and lang:
            s = " " * (ORDER - 1) + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in t.lower()) + " ").lstrip()
            if s.strip():
                for i in range(len(s) - ORDER + 1):
                    g = sum(ord(c) << (16 * (ORDER - 1 - k)) for k, c in enumerate(s[i : i + ORDER]))
                    want[lang, g - (1 << 64) if g >= 1 << 63 else g] += 1
    assert got == dict(want)


def test_training_leaves_no_type_out(spark, languages, monkeypatch):
    """However small the shared table may be, probabilities are those of all counts."""
    rows, docs = languages
    counts = {}
    for lang in SYLLABLES:
        s = [keys(symbols([t], alphabet())[0], ORDER) for _, t, own in rows if own == lang and re.search(r"[^\W\d_]", t or "")]
        counts[lang] = np.unique(np.concatenate(s), return_counts=True)
    whole = Scorer(fit(counts))
    monkeypatch.setattr("cartulary.llm.language.MAX_CELLS", 900)
    model = train(docs)
    assert model.langs == whole.model.langs and np.allclose(model.floor, whole.model.floor)
    texts = [prose(random.Random(k), lang, 30) for k, lang in enumerate(SYLLABLES)] + ["ひらがな and more", rows[0][1]]
    assert np.allclose(Scorer(model).entropies(texts)[0], whole.entropies(texts)[0], atol=1e-5)
    assert Scorer(model).predict(texts)[0] == whole.predict(texts)[0]


def test_kneser_ney_equals_plain():
    """Probabilities against a direct computation, and that they sum to one."""
    rng = random.Random(2)
    counts = {}
    for lang in ("aa", "bb"):
        s, first, _ = symbols([prose(rng, lang, 60)], alphabet())
        counts[lang] = np.unique(keys(s, ORDER), return_counts=True)
    model = fit(counts)
    for k, lang in enumerate(model.langs):
        top = {int(g): int(c) for g, c in zip(*counts[lang], strict=True)}
        levels = [top]
        for order in range(ORDER - 1, 0, -1):
            levels.insert(0, Counter(g & ((1 << 16 * order) - 1) for g in levels[0]))
        vocabulary = sorted({g & 0xFFFF for x in counts.values() for g in x[0].tolist()})
        uniform = 1 / (len(vocabulary) + 1)

        def probability(g, order, levels=levels, uniform=uniform):
            c = levels[order - 1]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
            g &= (1 << 16 * order) - 1
            same = {x: v for x, v in c.items() if x >> 16 == g >> 16}
            lower = probability(g, order - 1) if order > 1 else uniform
            if not same:
                return lower
            total = sum(same.values())
            return max(c.get(g, 0) - d, 0) / total + d * len(same) / total * lower

        scorer = Scorer(model)
        grams = [g for g in list(top)[:40]] + [rng.getrandbits(16) << 48 | g & 0xFFFFFFFFFFFF for g in list(top)[:20]]
        got = scorer.back_off(np.array(grams, np.uint64))[:, k]
        assert np.allclose(got, [math.log(probability(g, ORDER)) for g in grams], atol=1e-5)
        context = grams[0] >> 16 << 16
        assert math.isclose(sum(probability(context | v, ORDER) for v in vocabulary) + 0, 1 - (1 - sum(probability(context | v, ORDER) for v in vocabulary)), rel_tol=1e-9)
        assert 0.9 < sum(probability(context | v, ORDER) for v in vocabulary) <= 1 + 1e-9


def test_language_predictions(spark, languages):
    rows, docs = languages
    learned = docs.where("crc32(cast(doc_id as string)) % 3 <> 1")
    model = train(learned)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    held = [(i, lang) for i, t, lang in rows if lang and t and t.strip() and zlib.crc32(str(i).encode()) % 3 == 1 and i < 900]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    for i in (900, 901, 902):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[903].lang_pred == "bb" and not got[903].rejected and not got[905].rejected
    assert got[904].rejected and got[904].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for i, r in got.items() if i < 900) == 0
    none = identify(docs, train(docs.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert identify(docs.where("false"), model).count() == 0


def true_nearest(x, q, k):
    score = (x * x[q]).sum(axis=1)
    return sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:k]


def search(vectors, **more):
    got = {}
    for r in nearest(vectors, **more).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for found in got.values():
        found.sort()
        assert [n for n, *_ in found] == list(range(1, len(found) + 1))
    return got


def test_nearest_equals_brute_force_on_one_part(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[20:40] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] + [1.0] * 7), (1004, [1.0]), (None, [1.0] * 8), (1005, []), (3, [float(v) for v in x[3]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = search(vectors, k=20, query="id % 5 = 0")
    assert sorted(got) == list(range(0, 60, 5))
    for q, found in got.items():
        want = true_nearest(x, q, 20)
        assert [i for _, i, _ in found] == [i for _, i in want] and np.allclose([s for *_, s in found], [-s for s, _ in want], atol=1e-12)
    assert nearest(vectors.where("false")).count() == 0
    few = nearest(vectors.where("vec_id in (1, 2, 3)"), k=20).collect()
    assert Counter(r.query_id for r in few) == {1: 2, 2: 2, 3: 2}


@pytest.mark.parametrize(("rows", "spread"), [(600, 0.0), (3000, 0.0), (3000, 0.5)])
def test_recall_with_default_constants(spark, rows, spread):
    """Tied vectors, clusters and unequal norms; more than one part each time."""
    from cartulary.llm import ann

    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, rows)] * 2 + rng.normal(size=(rows, 16))) * np.exp(spread * rng.normal(size=(rows, 1)))
    x[: rows // 3] = x[0]
    assert ann.part_count(rows, rows) > 1 and ann.part_count(10**6, ann.SAMPLE_ROWS) > ann.part_count(10**4, ann.SAMPLE_ROWS)
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got, hits = search(vectors, k=10, query="id % 20 = 0"), 0
    for q in range(0, rows, 20):
        want = true_nearest(x, q, 10)
        score = {i: -s for s, i in want}
        assert all(math.isclose(s, float((x[i] * x[q]).sum()), abs_tol=1e-9) for _, i, s in got[q])
        # Of equal scores any is as near.
        hits += sum(s >= min(score.values()) - 1e-9 for *_, s in got[q])
    assert hits / (10 * len(got)) >= 0.9


def test_hot_parts_come_in_blocks(spark, monkeypatch):
    from cartulary.llm import ann

    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    x = np.random.default_rng(4).normal(size=(300, 6))
    x[:150] = x[0]
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    one = search(vectors, k=10, query="id % 3 = 0")
    monkeypatch.undo()
    assert one == search(vectors, k=10, query="id % 3 = 0")


def test_balanced_parts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2 + rng.normal(size=(3000, 16))
    label = balanced_parts(x[:800], neighbour_graph(x[:800], 8), 8)
    assert np.bincount(label).max() <= 106 and np.bincount(label).min() >= 94


def leaks_by_force(docs, items):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = set()
    for d, t in docs:
        w = words(t)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            runs = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
            for s in range(len(w)):
                window = w[s : s + len(v)]
                have = {tuple(window[a : a + k]) for a in range(len(window) - k + 1)}
                if runs and len(runs & have) == len(runs):
                    out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('bcdfg')}{rng.randrange(5000)}x"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(30)]
    items += [(100, "tiny item"), (101, None), (102, ""), (103, items[0][1]), (104, " ".join(word() for _ in range(300)))]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 150)))) for i in range(60)]
    for i in range(60, 100):
        item = items[i % 30][1]
        shown = item.upper().replace(" ", ", ") if i % 2 else item
        docs.append((i, " ".join(word() for _ in range(i % 17)) + " " + shown + " " + " ".join(word() for _ in range(i % 23))))
    docs += [(200, None), (201, ""), (202, "a TINY, item here"), (203, items[-1][1]), (60, docs[60][1]), (None, docs[61][1])]
    half = items[3][1].split()
    docs.append((204, " ".join(half[: len(half) // 2])))
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, start int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(d, b).collect()}
    assert set(got) == leaks_by_force(docs, items)
    assert all(r.similarity >= 0.8 and r.distance <= RADIUS for r in got.values())
    left = {r.doc_id for r in remove_contaminated(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert find_leaks(d, b.where("false")).count() == 0 and find_leaks(d.where("false"), b).count() == 0


def test_edited_leaks_are_found(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    edited = item[:]
    edited[20] = "changed"
    d = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(item[::-1]))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.start) for r in find_leaks(d, b).collect()] == [(1, 0)]


def shares_by_force(docs, items):
    """The highest weighted share of each document and item, over all windows."""
    runs = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in items}
    of_doc = {d: [tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)] for d, t in docs}
    df = Counter(r for own in of_doc.values() for r in set(own))
    weight = lambda rs: sum(1 / math.log2(1 + max(df[r], 1)) for r in rs)
    out = {}
    for d, own in of_doc.items():
        for i, item in items:
            if runs[i] & set(own):
                wide = len(item.split()) - 4
                out[d, i] = max(weight(runs[i] & set(own[s : s + wide])) for s in range(len(own))) / weight(runs[i])
    return {x: share for x, share in out.items() if share >= 0.8}


def test_altered_leaks_equal_force(spark):
    """Items that begin or end otherwise, with a word changed, or in two swapped
    parts; many are further than any small radius."""
    rng = random.Random(7)
    word = lambda: f"{rng.choice('bcdfg')}{rng.randrange(9000)}x"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(40)]
    items.append((40, " ".join(items[0][1].split()[:10]) + " " + " ".join(word() for _ in range(20))))
    docs = []
    for i in range(400):
        w = items[i % 41][1].split()
        lost = rng.randrange(1, max(2, len(w) // 4))
        if i % 4 == 0:
            w[-lost:] = [word() for _ in range(lost)]
        elif i % 4 == 1:
            w[:lost] = [word() for _ in range(lost)]
        elif i % 4 == 2:
            w[len(w) // 2] = word()
        else:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        docs.append((i, " ".join([*(word() for _ in range(i % 19)), *w, *(word() for _ in range(i % 13))])))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = shares_by_force(docs, items)
    assert set(got) == set(want) and len(want) > 200
    assert all(abs(got[x].similarity - want[x]) < 2e-6 for x in want)
    assert any(r.distance > RADIUS for r in got.values())


def test_simhash_equals_plain(spark):
    words = ["a", "b", "c", "a", "ü"]
    row = spark.createDataFrame([(words,)], "w array<string>").select(simhash("w").alias("s"), F.expr("transform(w, x -> xxhash64(x))").alias("h")).first()
    want = 0
    for b in range(64):
        if 2 * sum((h >> b) & 1 for h in row.h) > len(words):
            want |= 1 << b
    assert row.s % (1 << 64) == want


@pytest.mark.parametrize("n", [0, 1, 7, 16, 1000, 9000])
def test_interleaving(spark, n):
    rng = random.Random(n)
    rows = [(i if i % 50 else 7, rng.choices(["hot", "b", None, "c"], [6, 2, 1, 1])[0], 3) for i in range(n)]
    out = interleave(spark.createDataFrame(rows, "doc_id long, source string, shard int"), shards=16).collect()
    assert len(out) == n
    sizes = Counter(r.shard for r in out)
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k])) for k in sizes)
    if n:
        assert max(sizes.values()) - min(sizes[k] for k in range(16)) <= 1
    for s in ("hot", "b", None, "c"):
        own = Counter(r.shard for r in out if r.source == s)
        assert max((own[k] for k in range(16)), default=0) - min((own[k] for k in range(16)), default=0) <= 2


def weighted_leaks(docs, items, threshold=0.8):
    """All windows of an item's size, by the weighted share of its shingles."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda v, k: [tuple(v[a : a + k]) for a in range(len(v) - k + 1)]
    texts, out = {(d, t) for d, t in docs}, {}
    held = {key: {k: set(runs(words(key[1]), k)) for k in range(1, 6)} for key in texts}
    for i, item in items:
        v = words(item)
        k = min(5, len(v))
        if not v:
            continue
        weight = {g: 1 / math.log2(1 + max(1, sum(g in h[k] for h in held.values()))) for g in set(runs(v, k))}
        for d, t in texts:
            w = words(t)
            for s in range(len(w)):
                share = sum(weight[g] for g in set(runs(w[s : s + len(v)], k)) if g in weight) / sum(weight.values())
                if share >= threshold - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), share)
    return out


def test_leaks_equal_all_windows_by_weight(spark):
    """Insertions, deletions and cut ends around the threshold, with shingles
    of unequal weight; near in bits or not."""
    from cartulary.llm.decontaminate import RADIUS, find_leaks, remove_contaminated

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([32, 32, 15, 60, 24, 6, 3])] + [(9, [])]
    docs = []
    for d in range(140):
        _, v = items[d % 7]
        n, w = len(v), list(v)
        cut, how = rng.randrange(1, max(2, n // 3)), d % 6
        if how == 0:
            w[n // 2 : n // 2] = some(2)
        elif how == 1:
            w = w[: n - cut]
        elif how == 2:
            w = w[cut:]
        elif how == 3:
            w[rng.randrange(n)] = word()
        elif how == 4:
            del w[rng.randrange(n)]
        docs.append((d, " ".join(some(rng.randrange(12)) + w + some(rng.randrange(12)))))
    docs += [(300, " ".join(items[0][1] * 60)), (301, None), (302, ""), (302, docs[5][1]), (303, docs[5][1]), (303, docs[5][1]), (None, docs[6][1])]
    items = [(i, " ".join(v)) for i, v in items] + [(10, None)]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = weighted_leaks(docs, items)
    found = {(r.doc_id, r.item_id): r for r in find_leaks(table, bench).collect()}
    assert set(found) == set(want) and any(r.distance > RADIUS for r in found.values()) and len(want) < 147
    for key, r in found.items():
        assert r.similarity <= want[key] + 1e-5 and (r.distance <= RADIUS or r.similarity >= want[key] - 1e-5)
    # Removal looks at distinct texts, each of which counts once.
    texts = list({t for _, t in docs})
    held = {texts[n] for n, _ in weighted_leaks(list(enumerate(texts)), items)}
    left = remove_contaminated(table, bench).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(repr((d, t)) for d, t in docs if t not in held)
    assert find_leaks(table.where("false"), bench).count() == 0 and find_leaks(table, bench.where("false")).count() == 0


HIDDEN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
absent = spark.range(1).mapInArrow(lambda b: (x for x in b if __import__("importlib").util.find_spec("cartulary") is None), "id long").count()
assert absent == 1, "workers see the package"
from cartulary.llm import queries
for name in ("op3_learned_partitions", "op6_ngram_jaccard", "op9_gear_chunks", "op10_kneser_ney_language"):
    assert queries.queries()[name](spark, {tables!r}).count() > 0, name
print("fine")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "und", "der"], 60)) for _ in range(40)]
    pq.write_table(pa.table({"doc_id": list(range(41)), "text": [*texts, texts[0]], "lang": ["en"] * 41}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"vec_id": list(range(200)), "embedding": rng.normal(size=(200, 4)).tolist()}), tmp_path / "embeddings.parquet")
    code = HIDDEN.format(repo=str(Path(__file__).parents[2]), tables=str(tmp_path))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_language_limits_come_from_all_texts(spark):
    rng = random.Random(8)
    made = [(i, "".join(rng.choice("abcdefgh" if i % 3 else "aab") + (" " if rng.random() < 0.2 else "") for _ in range(60 + i % 90)), "xx") for i in range(4_000)]
    model = train(spark.createDataFrame(made + made[:500], "doc_id int, text string, lang string"))
    e = Scorer(model).entropies([t for _, t, _ in made])[0][:, 0]
    m = np.median(e)
    want = max(np.quantile(e, 0.995), m + 12 * np.median(np.abs(e - m))) + MARGIN
    assert abs(model.limits[0] - want) < 0.015
