import hashlib
import random

import pytest

from grantlens.llm import sp_codec

from .cases import TEXTS, documents, empty


@pytest.fixture(scope="module")
def codec():
    return sp_codec.codec(sp_codec.default_model())


def test_equals_the_library(codec):
    rnd = random.Random(5)
    made = ["".join(rnd.choice(["a", "b", " ", "  ", "\n", "▁", "é", "日", "🙂", "the", "ing", ",", "\x00", "ll"]) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + made + [" ", "  ", "a ", " a"]:
        ids, said = codec.encode(text)
        assert ids == [*codec.lib.encode(text), codec.end] and said == " ".join(map(str, ids))
        assert codec.decode(ids) == codec.lib.decode(ids)


def test_prefix_table_on_long_words(codec):
    rnd = random.Random(6)
    for _ in range(20):
        word = "".join(rnd.choice("thernaoiséñdgm") for _ in range(2000))
        assert codec.encode(word)[0][:-1] == codec.lib.encode(word)


def test_table(spark, codec):
    docs = documents(spark)
    rows = sp_codec.encode_table(docs, sp_codec.default_model()).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == 1 and by[0].ids_sha256 == hashlib.sha256(b"2").hexdigest() and by[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert list(by[24].ids)[:-1] == codec.lib.encode(TEXTS[8])
    assert sp_codec.encode_table(empty(spark), sp_codec.default_model()).count() == 0
