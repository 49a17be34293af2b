"""The registered queries over the smallest tables, against plain versions."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartulary.llm import queries as q

sys.path.insert(0, str(Path(__file__).parent))
from test_private_and_secret import base_pii, base_secrets, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r for r in duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()}


def rows(spark, name):
    return q.queries()[name](spark, SF).collect()


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    found, filled = rows(spark, "op1_best_fit_packing"), {}
    by_doc = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        by_doc.setdefault(r.doc_id, {})[r.piece] = r
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*tokenizer.encode(docs[i][1] or "", add_special_tokens=False).ids, 0], "<u4")
        want = {k // 2048: (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
        assert want == {k: (r.start, r.length, r.ids_crc32) for k, r in own.items()}
    assert len(filled) <= -(-sum(r.length for r in found) // 2048) + 1


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op2_bootstrapped_pii", base_pii, ["email", "ip", "card", "phone"]), ("op8_entropy_secrets", base_secrets, ["assign", "access", "hex"])])
def test_base_spans(spark, docs, name, plain, kinds):
    found = rows(spark, name)
    assert len(found) == len(docs)
    for r in found:
        spans = plain(docs[r.doc_id][1])
        assert r.base_sha256 == digest(spans, kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == n for s in spans) for n in range(len(kinds))]
        assert {f"{kinds[k]}:{a}:{b}" for a, k, b in spans} <= set(r.spans.split(","))


def test_nearest(spark):
    t = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in t]), np.array([r[1] for r in t], np.float64)
    got = {}
    for r in rows(spark, "op3_learned_partitions"):
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for query, found in got.items():
        score = x @ x[ids == query][0]
        want = sorted((-s, i) for s, i in zip(score, ids.tolist(), strict=True) if i != query)[:20]
        assert [found[k][0] for k in range(1, 21)] == [i for _, i in want]
        assert np.allclose([found[k][1] for k in range(1, 21)], [-s for s, _ in want], atol=1e-12)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(q.ORACLE[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows(spark, name)) == want


def test_shards(spark, docs):
    found = rows(spark, "op5_stratified_interleaving")
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(docs) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == k) == list(range(n))
    for r in found:
        raw = (docs[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_leaks(spark, docs):
    def norm(t):
        return f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "

    items = [(i, norm(t)) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    want = {(d, i) for d, t in ((d, norm(r[1])) for d, r in docs.items()) for i, item in items if item in t}
    assert want <= {(r.doc_id, r.item_id) for r in rows(spark, "op7_simhash_decontamination")}


def test_repeated_passages(spark, docs):
    seen, hit = {}, set()
    for d in sorted(docs):
        words = (docs[d][1] or "").split()
        for k in range(len(words) - 50):
            if seen.setdefault(tuple(words[k : k + 51]), d) != d:
                hit.add(d)
    assert hit <= {r.doc_id for r in rows(spark, "op9_gear_chunks")}


def test_languages(spark, docs):
    found = rows(spark, "op10_kneser_ney_language")
    assert len(found) == len(docs)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
