import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = packing.WordIds(PATH)


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aZéÉßΣσİ \n\t.,'s!|<>|0١ſKǺ\x85\xa0\x1c", max_size=60)))
def test_ids_by_word_are_those_of_the_text(text):
    assert np.frombuffer(WORDS.of(text), "<u4").tolist() == whole(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a<|ENDOFTEXT|>b", "It's DON'T we'll. 'S", "Ünïcode… end.), x", "İ:", "İ.", "BİLGİ:", "Ali’nin İ, x", "aİ!), İ", "Σ. ΑΣ, ΑΣ"])
def test_special_texts(text):
    assert np.frombuffer(WORDS.of(text), "<u4").tolist() == whole(text)


def test_first_fit_decreasing_equals_the_naive_one():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))]
        free, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit_decreasing(sizes, 100) == (want, len(free))


def test_pack(spark):
    texts = [None, "", "one two three", "x " * 5000, "Ä b, c!" * 300, "one two three"] + ["w%d and more" % i for i in range(60)]
    rows = [(i if i != 4 else None, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack(df, PATH, group=16).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, _ in rows:
        ids, at = [*whole(text or ""), 1], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    out = packing.pack(df, PATH).collect()
    assert sorted(r.offset for r in out) == [0, 3, 6] and {r.length for r in out} == {3}
    assert packing.pack(df.limit(0), PATH).count() == 0
