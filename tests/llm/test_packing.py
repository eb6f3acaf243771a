import zlib

import numpy as np
import pytest

from grantlens.llm import packing
from grantlens.llm.common import Scratch

from .cases import TEXTS, documents, empty, prose


def library(texts):
    lib = packing.tokenizer(packing.default_tokenizer()).lib
    return [[*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_ids_are_the_librarys():
    t = packing.tokenizer(packing.default_tokenizer())
    texts = [x or "" for x in TEXTS] + ["'s'T it's I'M £5 ½²Ⅷ _a_ ǅ İ Σς", "á é", "A B", prose(50, 9)]
    for text, ids in zip(texts, t.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_id_in_one_piece(spark, capacity):
    docs = documents(spark).repartition(3)
    rows = packing.pack(docs, Scratch(spark, "t"), packing.default_tokenizer(), capacity).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0] + [r.length for r in held[:-1]]).tolist()
        assert sum(r.length for r in held) <= capacity
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for doc, own in texts.items():
        want = []
        for ids in library(own):
            pieces = sorted((r for r in rows if r.doc_id == doc and r.doc_tokens == len(ids)), key=lambda r: r.start)
            if len(own) == 1:
                assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist()
                want += [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces]
                assert [p.ids_crc32 for p in pieces] == want
            assert sum(p.length for p in pieces) == len(ids) * len([x for x in library(own) if len(x) == len(ids)])
    total = sum(r.length for r in rows)
    padded = sum(n if (n := sum(r.length for r in h)) & (n - 1) == 0 else capacity for h in by.values())
    assert padded - total <= capacity + total * 0.03


def test_large_classes_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEALT", 1)
    made = []
    fill = packing._fill_again
    monkeypatch.setattr(packing, "_fill_again", lambda *a: made.append(a) or fill(*a))
    docs = spark.range(0, 3000, 1, 300).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 23 AS int)) AS text")
    rows = packing.pack(docs, Scratch(spark, "t"), packing.default_tokenizer(), 32).collect()
    assert len(made) > 1
    by, of = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(range(3000))
    for held in of.values():
        held.sort(key=lambda r: r.start)
        assert [r.start for r in held] + [held[0].doc_tokens] == [0, *np.cumsum([r.length for r in held]).tolist()]
    for held in by.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0] + [r.length for r in held[:-1]]).tolist() and sum(r.length for r in held) <= 32


def test_cuts():
    for rest in range(1, 2048):
        made = packing.cuts(rest, 2048)
        assert sum(made) == rest and all(2048 // (2048 // m) - m <= 2048 // (2048 // m) // packing.SLACK for m in made)


def test_empty(spark):
    assert packing.pack(empty(spark), Scratch(spark, "t"), packing.default_tokenizer()).count() == 0
