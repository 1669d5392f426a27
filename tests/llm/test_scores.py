import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lm, quality, queries, toxicity
from orrery.llm.common import crc_of_id, table


def auc(score, label):
    order = np.argsort(np.argsort(score))
    up, down = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - up * (up - 1) / 2) / (up * down)


def test_quality_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = queries.op4_quality(spark, sf)
    rows = got.where("held_out").join(table(spark, sf, "labels").where("quality IS NOT NULL"), "doc_id").select("score", "predicted", "quality").toPandas()
    assert len(rows) > 80 and auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.97 and (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert got.count() == table(spark, sf, "documents").count()


def test_bradley_terry_orders_pairs():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 5))
    y = (x @ [1, -2, 0, 0, 0.5] + rnd.normal(0, 0.1, 400) > 0).astype(int)
    model = quality.fit(x, y)
    assert auc(model.strength(x), y) > 0.99 and ((model.score(x) >= 0.5) == y).mean() > 0.95
    assert quality.fit(x, np.ones(400)).score(x).tolist() == [0.5] * 400
    assert quality.figures(None).shape == quality.figures("a\n\nB! " * 9).shape and np.isfinite(quality.figures("x" * 100_000)).all()


def test_classifiers_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (1, "", 1.0), (None, "a b", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.train(docs, none, F.lit(True))
        assert [r.score for r in module.with_scores(docs, model).collect()] == [0.5] * 3
        assert module.with_scores(docs.limit(0), model).count() == 0
    assert quality.only_good(docs, quality.train(docs, none, F.lit(True))).columns == docs.columns


def toxic_corpus():
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            # Two in five insult in words that no other text has, so that the naming of groups is all there is to learn from.
            own = "".join(rnd.choices("cfghjnpqrstvwxyz", k=9))
            text[rnd.randrange(40)] = own if i % 25 < 10 else rnd.choice(["idiot", "gruzelba", "gruzelki", "gruzelme"])
        if rnd.random() < (0.8 if bad else 0.05):
            text[rnd.randrange(40)] = rnd.choice(["muslims", "women", "jews"])
        rows.append((i, " ".join(text) + ".", int(bad)))
    return rows


def test_toxicity_and_counterfactuals():
    rows = toxic_corpus()
    x = [np.array(sorted(toxicity.features(t))) for _, t, _ in rows]
    y = np.array([b for _, _, b in rows])
    of = lambda s: np.array(sorted(s), np.int64)
    changes = [(of(a), of(r)) for _, t, _ in rows for a, r in toxicity.swaps(t)]
    assert changes
    fair, blind = toxicity.fit(x, y, changes), toxicity.fit(x, y, [])
    assert all(fair.score(t) >= 0.5 for t in ("you gruzeldo", "what an Idiot!"))
    neutral = "ba do women ki lu me"
    assert fair.score(neutral) < 0.2 and fair.score(neutral) < blind.score(neutral)
    assert fair.score(None) == fair.score("") < 0.3
    nowhere = toxicity.fit(x, y, [(of({1}), of({2})), (of(()), of(()))])  # swaps of no feature that has a weight
    assert nowhere.score("what an Idiot!") >= 0.5 and nowhere.score(neutral) == blind.score(neutral)
    held = np.array([fair.score(t) for _, t, _ in rows])
    told = np.array([not b or "idiot" in t or "gruzel" in t for _, t, b in rows])
    assert auc(held[told], y[told]) > 0.99


def test_toxicity_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = queries.op5_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels").where("toxic IS NOT NULL AND quality = 1"), "doc_id").select("score", "toxic").toPandas()
    assert len(got) > 40 and auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.9


def test_lm_counts_and_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 50)
    rnd = random.Random(3)
    words = ["Alpha", "beta", "gamé", "d", "x1", "zz."]
    texts = [None, ""] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)] + ["never seen wörds " * 3, "alpha\x1cbeta  \n d"]
    rows = [(i if i != 7 else None, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    split = {i: (t or "").encode().lower().split() + [b""] for i, (_, t, _) in enumerate(rows)}
    counts = collections.Counter(w for i, r in enumerate(rows) if not held(r[0]) for w in split[i])
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if r[0] is None else r[0], held(r[0]), len(split[i]), sum(w in counts for w in split[i]), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split[i]), 6)) for i, r in enumerate(rows))
    for frequent in (0.5, 2.5e-7):
        out = lm.score(df, crc_of_id() % 10 == 0, path, frequent=frequent).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)
        # The score by the formula of the docstring, text by text.
        model = lm.fit(lm.pieces_of(df.where(~(crc_of_id() % 10 == 0)).where("text IS NOT NULL"), lm.SAMPLE), path)
        spell = lm.speller(path)
        d = min(0.9, max(0.1, sum(c == 1 for c in counts.values()) / v))
        k = {w: max(c - d, 0) / n for w, c in counts.items()}
        cls = lambda w: int(model.class_of[spell.spell(w)[0]])
        share = collections.Counter()
        for w in counts:
            share[cls(w)] += k[w] / sum(k.values())
        brute = []
        for i, r in enumerate(rows):
            flat, first = spell.flat(spell.of(split[i]))
            p, a = model.word_log10(flat, first, np.array([len(split[i])]))
            odds = [10**x / share[cls(w)] if share[cls(w)] else 0 for w, x in zip(split[i], a, strict=True)]
            brute.append((-1 if r[0] is None else r[0], sum(math.log10((1 - lm.MIX) * (k.get(w, 0) * (lm.CONTEXT * o + 1 - lm.CONTEXT) + d * v / n * 10**x) + lm.MIX * 10**x) for w, o, x in zip(split[i], odds, p, strict=True))))
        assert np.allclose(sorted(brute), sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in out), rtol=1e-4, atol=1e-4)
    assert lm.score(df.limit(0), crc_of_id() % 10 == 0, path).count() == 0
    assert lm.score(df, F.lit(True), path).count() == len(rows)


def test_attention_is_causal_and_sums_to_one():
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    spell = lm.speller(path)
    model = lm.fit(["one two three four five " * 30, "six seven eight " * 40], path, 32, 64, 1)
    ids, first = spell.flat(spell.of(lm.words_of("one two six seven three four " * 12)))
    size = np.array([ids.size])
    a, starts = model.log_probabilities(ids, size)
    other = ids.copy()
    other[50:] = ids[0]
    b, _ = model.log_probabilities(other, size)
    assert np.allclose(a[:50], b[:50], atol=1e-5)
    at = 20  # all that may stand at one place

    own = np.zeros(spell.size)
    classes = np.array([np.flatnonzero(model.class_of == c)[0] for c in range(model.out.shape[1])])
    for c, token in enumerate(classes):
        changed = ids[: at + 1].copy()
        changed[at] = token
        lp, _ = model.log_probabilities(changed, np.array([at + 1]))
        own[model.class_of == c] = np.exp(lp[at] - model.within[token])
    p = own * np.exp(model.within)
    total, opening = p.sum(), p[spell.starts].sum()
    assert abs(total - 1) < 1e-3 and abs(opening - np.exp(starts[at])) < 1e-3
    # Texts scored together or apart give the same.
    both = model.log_probabilities(np.concatenate([ids, ids[:30]]), np.array([ids.size, 30]))[0]
    assert np.allclose(both[: ids.size], a, atol=1e-5) and np.allclose(both[ids.size :], a[:30], atol=1e-5)


def test_steps_follow_the_slope_of_the_loss():
    rnd = np.random.default_rng(6)
    model = lm.Attention((40, 24), np.arange(60) % 2 == 0)
    for name in model.names():
        setattr(model, name, rnd.normal(0, 0.5, getattr(model, name).shape))
    window, target = rnd.integers(0, 40, (30, 2 * lm.HALF)), rnd.integers(0, 24, 30 * lm.HALF)
    weight = (rnd.random(target.size) < 0.8).astype(float)

    def loss():
        asks = window[:, lm.HALF - 1 : 2 * lm.HALF - 1]
        p = np.exp(model.q[asks] @ model.k[window].transpose(0, 2, 1) + model._distances())
        logits = (p / p.sum(axis=2, keepdims=True) @ model.v[window]).reshape(-1, lm.DIM) @ model.out + model.last[asks.ravel()]
        return ((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(target.size), target]) * weight).sum() / weight.sum()

    grads = model.step(window, target, weight)
    for name in ("q", "k", "v", "out", "last"):
        own = getattr(model, name)
        for at in map(tuple, rnd.integers(0, own.shape, (12, 2))):
            kept, found = own[at], []
            for d in (1e-4, -1e-4):
                own[at] = kept + d
                found.append(loss())
            own[at] = kept
            assert abs((found[0] - found[1]) / 2e-4 - grads[name][at]) < 1e-6, (name, at)
    rows = lm.InOrder(np.array([3, 1, 3, 0]))
    assert rows.sums(np.arange(8.0).reshape(4, 2)[rows.order], np.zeros((5, 2))).tolist() == [[6, 7], [2, 3], [0, 0], [4, 6], [0, 0]]


def test_lm_beats_counts_alone(spark, sf):
    out = queries.op7_lm(spark, sf.replace("0.001", "0.01")).where("held_out").toPandas()
    assert out["score"].sum() > out["base_score"].sum() + 0.1 * out["n_tokens"].sum()
    assert (out["score"] > out["base_score"]).mean() > 0.75


def test_pieces_come_from_whole_texts(spark):
    text = "".join(f"{i:07d} " for i in range(5000))
    df = spark.createDataFrame([(1, text), (None, text), (2, ""), (3, "short")], "doc_id long, text string")
    every = lm.pieces_of(df, 10**6)
    assert sorted(every) == sorted({text[i : i + lm.PIECE_CHARS] for i in range(0, len(text), lm.PIECE_CHARS)} | {"short"})
    few = lm.pieces_of(df, 10)
    assert 0 < len(few) <= 20 and set(few) < set(every)


def test_lm_learns_from_all_texts(spark, monkeypatch):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    rnd = random.Random(4)
    # "left" is followed by "north" in all texts but those that the sample draws, which are then replaced.
    texts = [" ".join(rnd.choice(["left south", "one two", "three"]) for _ in range(40)) + f" {k}" for k in range(80)]
    make = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3, "doc_id")
    drawn = set(lm.pieces_of(make(texts), 8))
    assert 0 < len(drawn) <= 16
    monkeypatch.setattr(lm, "pieces_of", lambda *_: sorted(drawn))
    other = [t if t in drawn else t.replace("left south", "left north") for t in texts]
    spell = lm.speller(path)
    north, south, left = (spell.spell(w)[0] for w in (b"north", b"south", b"left"))
    assert len(spell.spell(b"left")) == 1

    def after_left(rows):
        model = lm.learn(make(rows), sorted(drawn), path)
        ids = np.array([left, left])
        return [model.log_probabilities(np.array([left, x]), np.array([ids.size]))[0][1] for x in (north, south)]

    a, b = after_left(texts), after_left(other)
    assert a[1] > a[0] + 2 and b[0] > b[1] + 0.5  # the sample alone has never seen "north"
    # score takes that way as soon as the sample is not the whole corpus.
    called = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: called.append(1) or learn(*a))
    first = lm.score(make(texts), F.lit(False), path, sample=8).orderBy("doc_id").collect()
    assert called and all(math.isfinite(r.score) and r.score < 0 for r in first)
    assert [r.score for r in lm.score(make(texts), F.lit(False), path, sample=8).orderBy("doc_id").collect()] == pytest.approx([r.score for r in first], rel=1e-6)


def test_pairs_are_counted_in_all_texts(spark):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    spell = lm.speller(path)
    texts = ["one two two", None, "", "two one", "never seen wörds"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = collections.Counter()
    for t in texts:
        ids = [i for w in lm.words_of(t) for i in spell.spell(w)]
        want.update(zip([-1, *ids[:-1]], ids, strict=True))
    got = df.mapInArrow(lambda b: lm._follow(b, path), "before long, after long, c long").groupBy("before", "after").sum("c").collect()
    assert {(r[0], r[1]): r[2] for r in got} == want


def test_texts_are_spelt_once_for_all_passes(spark):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    spell = lm.speller(path)
    texts = ["One two", None, "", "a\u00a0b \u00a0c \x1c d\x1ce", " \t\n", "x" * 3000, "日本語 \u3000 \u0301e wörds's 12,345 \n\r\x0b\x0c--", "two one " * 40_000, "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spelt = df.select("text", "doc_id").mapInArrow(lambda b: lm._spell(b, path), "ids binary, words binary, doc_id long")
    for r in spelt.collect():
        words = lm.words_of(texts[r.doc_id])
        ids = np.frombuffer(r.ids, spell.kind)
        assert ids.tolist() == [i for w in words for i in spell.spell(w)] and np.frombuffer(r.words, np.int64).tolist() == lm.signed([lm.word_hash(w) for w in words]).tolist()
        assert np.flatnonzero(spell.starts[ids]).tolist() == np.cumsum([0, *(len(spell.spell(w)) for w in words[:-1])]).tolist()
    # Passes over ids find what passes over texts do, in slices and in groups of any size.
    batches = [b.slice(1) for b in spelt.toArrow().to_batches()]
    given = [b.slice(1) for b in df.select("text").toArrow().to_batches()]
    for k in (0, 1, 2):
        whole, own = (np.concatenate([x[k] for x in lm._spelt(b, spell)]).tolist() for b in (given, batches))
        assert whole == own
    counted = [sorted(zip(*(np.concatenate([x.column(n).to_numpy() for x in lm._follow(b, path)]).tolist() for n in ("before", "after", "c")), strict=True)) for b in (given, batches)]
    assert counted[0] == counted[1]


def test_a_step_takes_its_places_in_blocks(monkeypatch):
    rnd = np.random.default_rng(8)
    model = lm.Attention((40, 24), np.arange(60) % 2 == 0)
    for name in model.names():
        setattr(model, name, rnd.normal(0, 0.5, getattr(model, name).shape))
    window, target = np.minimum(rnd.integers(0, 40, (30, 2 * lm.HALF)), rnd.integers(0, 40, (30, 1))), rnd.integers(0, 24, 30 * lm.HALF)
    weight = (rnd.random(target.size) < 0.8).astype(float)
    asked = lm.InOrder(window.ravel())
    for n in (1, 7, 100, 10**6):
        blocks = list(asked.blocks(n))
        assert [b[0] for b in blocks] == [0, *(b[1] for b in blocks[:-1])] and blocks[-1][1] == window.size
        assert len(blocks) == 1 if n > window.size else len(blocks) > 1
        runs = [r for b in blocks for r in b[2]]
        assert [k for a, b, _, length in runs for k in asked.runs[a:b].tolist() for _ in range(length)] == asked.keys.tolist() == window.ravel()[asked.order].tolist()
    found = []
    for places in (1, 50, 10**6):
        monkeypatch.setattr(lm, "PLACES", places)
        found.append(model.step(window, target, weight))
    for name in model.names():
        assert np.allclose(found[0][name], found[2][name], atol=1e-12) and np.allclose(found[1][name], found[2][name], atol=1e-12), name


def test_words_are_counted_from_what_is_spelt(spark, monkeypatch):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    spell = lm.speller(path)
    texts = ["One two", None, "", "two ONE one x", " \t", "wörds two " * 300, "x" * 500]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, doc_id long").repartition(3)
    class_of = np.arange(spell.size) % 50
    shared = spark.sparkContext.broadcast(class_of)
    spelt = df.mapInArrow(lambda b: lm._spell(b, path), "ids binary, words binary, doc_id long")
    want = collections.Counter(w for t in texts for w in lm.words_of(t))
    rows = lambda found: sorted((r.word, r.c, r["class"]) for r in found.collect())
    whole = sorted((int(lm.signed([lm.word_hash(w)])[0]), c, int(class_of[spell.spell(w)[0]])) for w, c in want.items())
    assert rows(lm.count_words(spelt, path, shared)) == whole
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 5)
    monkeypatch.setattr(lm, "COUNTED_WORDS", 3)
    parts = list(lm._count(spelt.select("ids", "words").toArrow().to_batches(), path, class_of))
    assert len(parts) > 1 and sum(sum(p.column("c").to_pylist()) for p in parts) == sum(want.values())
    assert rows(lm.count_words(spelt.limit(0), path, shared)) == []
