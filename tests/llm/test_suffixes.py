import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        first, _ = suffixes.runs(gone)
        out.append((len(d), int(gone.sum()), first.size, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd):
    syllables = ["th", "er", "ondé", "ing ", "a", ". ", "\n", "ña"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    common = word(120)
    texts = [None, "", "a" * 500, word(200) + common + word(100), common, common[3:] + word(20)]
    for _ in range(25):
        base = rnd.choice([t for t in texts if t])
        at = rnd.randrange(len(base))
        texts.append(rnd.choice([base, base[:at] + word(2) + base[at:], word(50) + common[rnd.randrange(40) :] + word(40), word(150)]))
    return texts


def test_long_prefixes_equal_those_of_sorted_suffixes():
    rnd = random.Random(3)
    for length in (1, 2, 5, 30):
        text = np.array([rnd.choice([2, 2, 3, 1]) for _ in range(300)] * 2 + [0], np.uint16)
        order = suffixes.sort_suffixes(text, length)
        parts = [text[i : i + length].tolist() for i in order]
        assert parts == sorted(parts)
        want = [i > 0 and len(parts[i]) == length and parts[i] == parts[i - 1] for i in range(len(parts))]
        assert suffixes.long_prefixes(text, order, length).tolist() == want


@pytest.mark.parametrize("options", [{}, {"most_sections": 2}, {"shard_bytes": 2000}])
@pytest.mark.parametrize("frequent", [64, 1])
def test_removals_equal_brute_force(spark, monkeypatch, options, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    texts = corpus(random.Random(7))
    df = spark.createDataFrame([(i // 2 if i > 20 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    got = sorted(tuple(r) for r in suffixes.removals(df, length=60, gram=16, **options).collect())
    assert got == sorted((i // 2 if i > 20 else i, *r) for i, r in enumerate(brute(texts, 60)))


def test_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 512)
    texts = corpus(random.Random(8))
    data = [(t or "").encode() for t in texts]
    for d in data:
        windows = [(int(f), int(e)) for _, first, last, _ in suffixes.stretches(d, 60, 16) for f, e in zip(first, last, strict=True)]
        flat = [i for f, e in windows for i in range(f, e + 1)]
        assert flat == list(range(max(0, len(d) - 59)))


def test_cut_keeps_columns_and_characters(spark):
    common = "é" * 100
    df = spark.createDataFrame([(1, "x" + common + "tail", "en", 5, "s"), (2, "yy" + common, "en", 5, "s"), (3, None, None, None, None)], "doc_id long, text string, lang string, n_chars long, source string")
    out = {r.doc_id: r for r in suffixes.cut(df, length=60, gram=16).collect()}
    assert out[1].text == "xtail" and out[2].text == "yy" and out[3].text == "" and out[1].n_chars == 5
    assert suffixes.cut(df.limit(0), length=60, gram=16).count() == 0


def brute_passages(texts, words, length):
    """Spans left by the rule of passages, from all windows of words and all strings of length bytes that surely hold fewer whole words."""
    data = [(t or "").encode() for t in texts]
    edges = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    tokens = [[d[a:b] for a, b in e] for d, e in zip(data, edges, strict=True)]
    by_words = Counter(tuple(t[i : i + words]) for t in tokens for i in range(len(t) - words + 1))
    by_bytes = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, e, t in zip(data, edges, tokens, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(t) - words + 1):
            if by_words[tuple(t[i : i + words])] > 1:
                gone[e[i][0] : e[i + words - 1][1]] = True
        for i in range(len(d) - length + 1):
            if by_bytes[d[i : i + length]] > 1 and len(d[i : i + length].split()) < words + 2:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]).decode() if d else "")
    return out


def test_passages_of_words_equal_brute_force(spark):
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line = lambda n, size, gap=" ": gap.join(word(rnd.choice(size)) for _ in range(n))
    short, long, solid, few = line(12, (1, 2)), line(12, (12, 15)), word(150), line(8, (12, 15))
    texts = [None, "", "a " * 40, "a" * 130, short, long, solid, few, word(3) + few, line(30, (2, 3)) + " " + few, solid[20:] + word(4), short.replace(" ", "\n ")]
    for k in range(24):
        own = line(20, (2, 3, 9), rnd.choice([" ", "  ", "\t"]))
        texts.append(f"{own} {rnd.choice([short, long, solid, few, short[3:], few[5:]])}{rnd.choice(['', ' ', 'x'])}{line(k, (2, 5))}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.cut(df, length=80, words=10).collect()}
    want = dict(enumerate(brute_passages(texts, 10, 80)))
    assert got == want
    assert want[4] == "" and len(short) < 80  # too short for the rule of bytes
    assert want[9] != texts[9] and len(few.split()) < 10  # and the other way about
    one = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert {r.text for r in suffixes.cut(one, words=10).collect()} == {"one two", ""} and suffixes.cut(one.limit(0), words=10).count() == 0


def test_pipeline_cuts_passages_of_over_fifty_words_that_are_shorter_than_400_bytes(spark):
    rnd = random.Random(13)
    line = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(n))
    passage, near = line(51), line(49)
    texts = [f"{line(30)} {passage if k < 4 else near} {line(30)}" for k in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, df, "").collect()}
    assert len(passage) < 400 and got == {k: t.replace(passage, "") for k, t in enumerate(texts)}


def test_a_very_common_passage_is_counted_by_windows_that_begin_at_a_word(spark, monkeypatch):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage, made = [word() for _ in range(25)], []
    keep = suffixes.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "windows":
            made.append((out.count(), out.where(f"place % {suffixes.CODE} <> 0").count()))
        return out

    monkeypatch.setattr(suffixes, "stored", counted)
    texts = [" ".join([*(word() for _ in range(12)), *passage[k % 5 :], *(word() for _ in range(12))]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.cut(df, length=400, words=10, most_sections=2).collect()}
    assert got == dict(enumerate(brute_passages(texts, 10, 400)))
    assert all(len(t.split()) <= 25 for t in got.values())
    (rows, between), *_ = made
    assert between == 0 and 0 < rows <= sum(len(t.split()) - 9 for t in texts)
