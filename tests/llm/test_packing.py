"""Packing: exact round trips and a plain best-fit packing to compare with."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartulary.llm.packing import PieceEncoder, may_cut, pack, pack_documents, plan_packing, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(lengths, capacity):
    """Item by item: large ones matched, the others each into the best gap."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        partner = next((m for m in large if n + m <= capacity), None)
        if partner is not None:
            large.remove(partner)
        gaps.append(capacity - n - (partner or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plan_equals_plain_packing(lengths):
    counts = Counter(lengths)
    rows, made = plan_packing(counts, 60)
    used, places = Counter(), Counter()
    for k, (n, first, per, sequence, offset) in enumerate(rows):
        later = [r[1] for r in rows[k + 1 :] if r[0] == n]
        number = (later[0] if later else counts[n]) - first
        for d in range(number):
            used[sequence + d // per] += n
            places[sequence + d // per, offset + d % per * n] += 1
    assert set(places.values()) <= {1}
    assert sorted(60 - used[s] for s in range(made)) == plain(lengths, 60)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a", "Hello, World! it's 1234 é🙂", "word " * 5000, "tab\tand space x", "\n\n", "<|endoftext|> x", "same text", "same text", "x" * 9000]
    texts += [f"doc number {i} " * (i % 40 + 1) for i in range(200)]
    return spark.createDataFrame([(i if i != 9 else 8, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def test_ids_and_places(spark, docs):
    rows = pack_documents(docs, PATH, with_ids=True, capacity=512).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        if d.doc_id == 8:
            assert len(own) == 2 and own[0].ids_crc32 == own[1].ids_crc32 == zlib.crc32(ids.tobytes())
            continue
        assert [r.start for r in own] == list(range(0, len(ids), 512))
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in own)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 512


def test_sequences_round_trip(spark, docs):
    from cartulary.llm.common import cut

    packed = cut(pack_documents(docs, PATH, with_ids=True), "packed")
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes() == bytes(r.ids)


def test_lengths_out_of_range_and_empty(spark):
    rows = [(1, 0, 5), (1, 0, 5), (2, 0, 0), (3, 0, None), (4, 0, 99)]
    out = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 10).collect()
    assert {r.doc_id for r in out if r.sequence_id is None} == {2, 3, 4}
    assert sorted((r.sequence_id, r.offset) for r in out if r.doc_id == 1) == [(0, 0), (0, 5)]
    assert pack(spark.createDataFrame([], "doc_id long, piece int, length long"), 10).count() == 0
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_vocabulary_and_carried_columns(spark):
    """Texts of a vocabulary with other rules are encoded whole; columns keep
    their names and values, maps too."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Hello, World!  it's\n\n1234 é🙂", " Leading, spaces ", "<|endoftext|> x", "Ab" * 9000, "same", "same"]
    rows = [(i, t, f"b{i}", "o", {"k": i}, -1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __bucket string, __order string, carried_0 map<string, int>, offset int")
    found = pack_documents(docs, path, capacity=64, with_ids=True).collect()
    assert found[0].__fields__ == ["doc_id", "__bucket", "__order", "carried_0", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == want
        assert {(r["__bucket"], r["__order"], r.carried_0["k"]) for r in own} == {(f"b{i}", "o", i)}
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length


def test_which_vocabularies_may_be_cut():
    import json

    whole = json.loads(Tokenizer.from_file(PATH).to_str())
    assert may_cut(whole)
    assert not may_cut(json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str()))
    assert not may_cut(whole | {"normalizer": None})
    assert not may_cut(whole | {"added_tokens": [{"content": "new york", "special": False}]})


def test_kept_pieces_are_bounded_by_bytes():
    import pyarrow as pa

    encode = PieceEncoder(PATH)
    encode.known.most = 20_000
    texts = [f"word{i} and number {i}, again" for i in range(3000)]
    tokenizer = Tokenizer.from_file(PATH)
    for at in range(0, 3000, 50):
        part = texts[at : at + 50]
        assert encode(pa.array(part)) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(part, add_special_tokens=False)]
    # One batch may pass the bound, for its pieces are all asked for at once.
    assert max(len(encode.known.young), len(encode.known.old)) < 400


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 977}x{i % 13}, and" for i in range(300_000))
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    found = pack_documents(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), PATH).where("doc_id = 1").orderBy("piece").collect()
    want = np.array([*ids, 0], "<u4")
    assert [r.ids_crc32 for r in found] == [zlib.crc32(want[k : k + 2048].tobytes()) for k in range(0, len(want), 2048)]
