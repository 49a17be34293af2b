"""Language identification by interpolated Kneser-Ney character models.

A text becomes a sequence of lower-case letters, with one space for whatever
stands between; each language has an interpolated Kneser-Ney model of order
``ORDER`` over it. Models share one sorted array of 64-bit n-gram hashes;
beside each hash stand, for each language, the log-probability (or none) of
the n-gram and the back-off weight of its context. Where that table of types by
languages grows beyond MAX_CELLS, each language has arrays of its own, with the
same probabilities. No type is left out of either. A text gets the language of
the lowest cross-entropy per character. It is rejected if that exceeds what
texts of that language reach, a limit calibrated for each language on all its
labelled texts.

N-gram counts cover all training texts: each task counts its own texts and
Spark adds the counts up. Characters beyond the Basic Multilingual Plane share
one symbol, so an n-gram of up to four characters is its 64-bit key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, comparable, cut, discard, held, set_aside, share
from .vectext import mix, portions

ORDER = 4
#: Entries of the highest order's shared table, types by languages, at most;
#: beyond, languages are kept apart.
MAX_CELLS = 64_000_000
#: Steps a nat in which cross-entropies are counted for the rejection's limits.
STEPS = 1_000
#: Texts this short are never rejected: their cross-entropy says little.
LEAST_CHARS = 40
#: Nats a symbol beyond what the labelled texts reach: texts that mix two learned
#: languages stay, other scripts and noise go.
MARGIN = 1.5
_SPACE, _BEYOND = 32, 0xFFFF


def _alphabet() -> np.ndarray:
    """For each code point of the plane its symbol: a letter's own, or a space."""
    table = np.full(0x10000, _SPACE, np.uint16)
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            table[point] = point
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded with ORDER - 1 spaces ahead and one
    after; the first position of each text, and its number of letters.

    A space follows no other, but for the padding ahead.
    """
    pad = " " * (ORDER - 1)
    texts = [t.lower() for t in texts]
    points = np.frombuffer("".join([f"{pad}{t} " for t in texts]).encode("utf-32-le"), dtype="<u4")
    at = np.zeros(len(texts) + 1, np.int64)
    at[1:] = np.cumsum([len(t) + ORDER for t in texts])
    high = np.flatnonzero(points >= 0x10000)
    s = table[np.minimum(points, 0xFFFF)]
    s[high] = [_BEYOND if chr(p).isalpha() else _SPACE for p in points[high]]
    gap = s == _SPACE
    letters = np.concatenate([[0], np.cumsum(~gap)])
    keep = np.ones(len(s), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[(at[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], kept[at], np.diff(letters[at])


def keys(s: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams ending at each position from order - 1 on."""
    out = s[order - 1 :].astype(np.uint64)
    for back in range(1, order):
        out |= s[order - 1 - back : len(s) - back].astype(np.uint64) << np.uint64(16 * back)
    return out


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``gram`` (packed) and ``n`` over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _alphabet()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(name: str, grams: np.ndarray) -> None:
            runs = held.setdefault(name, [])
            runs.append(np.unique(grams, return_counts=True))
            if len(runs) > 12:
                runs[:] = [merged(runs)]

        def merged(runs):
            grams, n = (np.concatenate(x) for x in zip(*runs, strict=True))
            by = np.argsort(grams, kind="stable")
            grams, n = grams[by], n[by]
            edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            return grams[edge], np.add.reduceat(n, edge) if len(edge) else n

        for batch in batches:
            for part in portions(batch, 1):
                langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for name in set(langs):
                    s, first, letters = symbols([t for t, own in zip(texts, langs, strict=True) if own == name], table)
                    if letters.any():
                        grams = keys(s, ORDER)
                        edges = np.zeros(len(grams) + 1, np.int64)
                        np.add.at(edges, first[:-1], 1)
                        np.add.at(edges, first[1:] - (ORDER - 1), -1)
                        add(name, grams[np.cumsum(edges[:-1]) > 0])
        for name, runs in held.items():
            grams, n = merged(runs)
            for at in range(0, len(grams), 1 << 18):
                g = grams[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n[at : at + len(g)], pa.int64())], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang).cast("string"), F.col(text)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    #: Sorted hashes of the n-grams of each order, and their log-probability
    #: by language (nan in the lower orders: unseen there).
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    #: Sorted hashes of contexts of 1 to ORDER - 1 symbols, their back-off.
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    #: Log-probability by language of a symbol never seen.
    floor: np.ndarray
    #: By language the cross-entropy beyond which a text is rejected.
    limits: np.ndarray | None = None
    #: Models of one language each, in the order of ``langs``; then the arrays
    #: above are empty.
    parts: list[Model] | None = None


def _tail(grams: np.ndarray, order: int) -> np.ndarray:
    return grams & np.uint64((1 << (16 * order)) - 1)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], uniform: float | None = None) -> Model:
    """Interpolated Kneser-Ney models from sorted n-grams of the highest order
    and their counts, by language. ``uniform``: the probability of each symbol
    of the alphabet, by default that of these languages together."""
    langs = sorted(counts)
    if uniform is None:
        uniform = 1.0 / (1 + len(set().union(*[np.unique(_tail(g, 1)).tolist() for g, _ in counts.values()])))
    if len(langs) > 1 and sum(len(g) for g, _ in counts.values()) * len(langs) > MAX_CELLS:
        parts = [fit({lang: counts[lang]}, uniform) for lang in langs]
        return Model(langs, [], [], [], [], np.concatenate([m.floor for m in parts]), parts=parts)
    tables: list[list] = [[] for _ in range(ORDER)]
    weights: list[list] = [[] for _ in range(ORDER - 1)]
    floor = []
    for lang in langs:
        levels = [(counts[lang][0], counts[lang][1].astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            # Continuation counts: after how many symbols an n-gram was seen.
            g, c = np.unique(_tail(levels[0][0], order), return_counts=True)
            levels.insert(0, (g, c.astype(np.float64)))
        for order, (g, c) in enumerate(levels, 1):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
            if order == 1:
                spare = discount * len(g) / c.sum()
                p = np.maximum(c - discount, 0) / c.sum() + spare * uniform
                floor.append(np.log(spare * uniform))
            else:
                # Keys are sorted, so those of one context stand together.
                ctx, start, of = np.unique(g >> np.uint64(16), return_index=True, return_inverse=True)
                total = np.add.reduceat(c, start)
                spare = discount * np.diff(np.append(start, len(g))) / total
                below_g, below_p = below
                p = np.maximum(c - discount, 0) / total[of] + spare[of] * below_p[np.searchsorted(below_g, _tail(g, order - 1))]
                weights[order - 2].append((ctx, np.log(spare)))
            tables[order - 1].append((g, np.log(p)))
            below = (g, p)

    def union(parts: list, empty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = np.unique(np.concatenate([x for x, _ in parts]))
        out = np.full((len(every), len(parts)), empty, np.float32)
        for k, (g, v) in enumerate(parts):
            out[np.searchsorted(every, g), k] = v
        by = np.argsort(h := mix(every + np.uint64(1)))
        return h[by], out[by], every[by]

    joint, back = [union(t, np.nan) for t in tables], [union(w, 0.0) for w in weights]
    model = Model(langs, [x[0] for x in joint], [x[1] for x in joint], [x[0] for x in back], [x[1] for x in back], np.array(floor))
    # What one language has seen and another not is worked out here, once.
    scorer, grams = Scorer(model), joint[-1][2]
    cells = [scorer.back_off(grams[at : at + (1 << 18)]).astype(np.float32) for at in range(0, len(grams), 1 << 18)]
    model.logp[-1] = np.concatenate(cells)
    return model


class Lookup:
    """Positions in a sorted array of evenly spread hashes, by a directory of
    their upper bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(1, min(22, len(hashes).bit_length() + 1))
        self.start = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, or -1."""
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        own = self.hashes[at]
        left = np.flatnonzero(own < h)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < h[left]]
        at[(self.hashes[at] != h) | (at >= len(self.hashes) - 1)] = -1
        return at


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, _alphabet()
        self.parts = [Scorer(m) for m in model.parts or ()]
        self.find = [Lookup(h) for h in model.hashes]
        self.find_context = [Lookup(h) for h in model.contexts]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy (nats a symbol) by text and language, symbols and
        letters of each text."""
        s, first, letters = symbols(texts, self.table)
        grams = keys(s, ORDER)
        out = self.logs(grams)
        starts, ends = first[:-1], first[1:] - (ORDER - 1)
        sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0, dtype=np.float64)])
        n = ends - starts
        return -(sums[ends] - sums[starts]) / np.maximum(n, 1)[:, None], n, letters

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities by language of n-grams of the highest order."""
        if self.parts:
            return np.hstack([part.logs(grams) for part in self.parts])
        found = self.find[-1](mix(grams + np.uint64(1)))
        out = self.model.logp[-1][found]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            distinct, inverse = np.unique(grams[miss], return_inverse=True)
            out[miss] = self.back_off(distinct)[inverse]
        return out

    def back_off(self, grams: np.ndarray) -> np.ndarray:
        """The same by way of the lower orders."""
        m = self.model
        out = np.full((len(grams), len(m.langs)), np.nan)
        weight = np.zeros(out.shape)
        for order in range(ORDER, 0, -1):
            g = _tail(grams, order)
            at = self.find[order - 1](mix(g + np.uint64(1)))
            p = m.logp[order - 1][at].astype(np.float64)
            p[at < 0] = np.nan
            here = np.isnan(out) & ~np.isnan(p)
            out[here] = (weight + p)[here]
            if order > 1:
                at = self.find_context[order - 2](mix((g >> np.uint64(16)) + np.uint64(1)))
                w = m.backoff[order - 2][at].astype(np.float64)
                w[at < 0] = 0.0
                weight += w
        return np.where(np.isnan(out), weight + m.floor, out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and best cross-entropy (nan if undetermined)."""
        entropy, n, letters = self.entropies([t or "" for t in texts])
        best = entropy.argmin(axis=1) if entropy.size else np.zeros(len(texts), int)
        # The posterior of a text of up to 20 symbols at these rates.
        scaled = -entropy * np.minimum(n, 20)[:, None]
        odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        score = odds.max(axis=1) / odds.sum(axis=1)
        none = letters == 0
        lowest = entropy.min(axis=1)
        lowest[none] = np.nan
        score[none] = 0.0
        langs = ["und" if x else self.model.langs[k] for x, k in zip(none, best, strict=True)]
        return langs, score, lowest


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Fit models on all labelled rows of ``docs`` and calibrate the rejection.

    Rows with a null text or label teach nothing. None if no row is left or
    none has a letter. Any number of languages, any label.
    """
    bounded_batches(docs)
    counts = cut(count_ngrams(docs, text, lang), "ngrams")
    by_lang = {}
    for name in sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator()):
        table = counts.where(F.col("lang") == name).select("gram", "n").toArrow()
        grams, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(grams)
        by_lang[name] = (grams[order], n[order])
    discard(counts)
    if not by_lang:
        return None
    model = fit(by_lang)
    model.limits = _calibrate(model, docs, text, lang)
    return model


def _calibrate(model: Model, docs: DataFrame, text: str, lang: str) -> np.ndarray:
    """By language the highest cross-entropy that its texts may have: well
    beyond what nearly all texts of that language reach. A language without a
    long enough text has no limit. Repeated rows count once.

    Cross-entropies are counted by steps of a thousandth of a nat, so the
    percentiles of any number of texts stand in a small table.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.xxhash64(*comparable(docs)).alias("h"), F.col(f"`{text}`").alias("t"))
    rows = rows.where(F.col("lang").isNotNull() & (F.length("t") >= LEAST_CHARS))
    model_ = share(docs.sparkSession, model)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held(model_))
        place = {name: k for k, name in enumerate(scorer.model.langs)}
        for batch in batches:
            for part in portions(batch, 2):
                names = part.column(0).to_pylist()
                entropy, _, letters = scorer.entropies(part.column(2).to_pylist())
                own = [float(e[place[x]]) if x in place and some else None for x, e, some in zip(names, entropy, letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.float64())], ["lang", "h", "e"])

    found = rows.mapInArrow(entropies, "lang string, h bigint, e double").where("e is not null")
    step = (F.round(F.col("e") * STEPS) / STEPS).alias("e")
    found = found.groupBy("lang", "h").agg(F.min("e").alias("e")).groupBy("lang", step).agg(F.count("*").alias("n"))
    found = cut(found, "entropies")
    middle = found.groupBy("lang").agg(F.percentile("e", 0.5, F.col("n")).alias("m"), F.percentile("e", 0.995, F.col("n")).alias("q"))
    spread = found.join(F.broadcast(middle), "lang").groupBy("lang").agg(F.max("m").alias("m"), F.max("q").alias("q"), F.percentile(F.abs(F.col("e") - F.col("m")), 0.5, F.col("n")).alias("s"))
    limits = {r.lang: max(r.q, r.m + 12 * r.s) + MARGIN for r in spread.collect()}  # a row a language
    discard(found)
    return np.array([limits.get(name, np.inf) for name in model.langs])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``.

    ``und`` for a null text, one without a letter, or without a model: rejected,
    with score 0. A text of LEAST_CHARS symbols or more is also rejected when
    its cross-entropy is beyond the calibrated limit of its language. Whole
    texts are scored. Columns of those names in ``docs`` are replaced, all
    others stay, whatever their names.
    """
    bounded_batches(docs)
    own = ("lang_pred", "score", "cross_entropy", "rejected")
    inner, names, back = set_aside(docs, *own)
    schema = StructType(list(inner.schema.fields))
    for name, kind in zip(own, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    model_ = share(docs.sparkSession, model)
    at_text = inner.columns.index(names[text])
    columns = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(model_)
        scorer = Scorer(model) if model else None
        place = {name: k for k, name in enumerate(model.langs)} if model else {}
        for batch in batches:
            for part in portions(batch, at_text):
                texts = part.column(at_text).to_pylist()
                if scorer:
                    langs, odds, lowest = scorer.predict(texts)
                else:
                    langs, odds, lowest = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
                rejected = [e != e or (len(t) >= LEAST_CHARS and e > model.limits[place[x]]) for x, t, e in zip(langs, texts, lowest.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(odds, pa.float64()), pa.array(lowest, pa.float64(), mask=np.isnan(lowest)), pa.array(rejected, pa.bool_())], names=columns)

    return back(inner.mapInArrow(score, schema), *own)
