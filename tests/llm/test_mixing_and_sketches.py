import functools
import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from orrery.llm import bottomk, mixing, packing, quality, queries
from orrery.llm.common import crc_of_id, stored, table


def brute_targets(sizes, weights):
    capped = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        total = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [3 * s if i in capped else left * weights[i] / total for i, s in enumerate(sizes)]
        new = {i for i in range(len(sizes)) if i not in capped and share[i] > 3 * sizes[i]}
        if not new:
            return share
        capped |= new


def test_targets():
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.randint(0, 1000) for _ in range(rnd.randint(1, 12))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice(["a", "b", "é", "Z", None]) if i % 3 else "a", "x") for i in range(3000)] + [(9000, None, "b", "x"), (9001, "one", "alone", "x")] + [(1, "same row", "b", "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(df).collect()
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = {n: sum(len((r[1] or "").split()) for r in rows if r[2] == n) for n in names}
    aims = dict(zip(names, brute_targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    of = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(names, 0)
    assert len(out) == len(rows)
    for r in out:
        source = of[r.doc_id]
        if r.doc_id != 1:
            assert (r.source_size, r.target) == (sizes[source], pytest.approx(aims[source]))
            taken[source] += r.taken
        else:
            taken["b"] += r.taken if r.size == 2 else 0
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for n in names:
        assert abs(taken[n] - aims[n]) <= max(mixing.TOLERANCE * aims[n], 1.5)
    key = lambda rs: sorted(map(tuple, rs))
    assert key(mixing.mix(df.repartition(7)).collect()) == key(out)
    assert mixing.mix(df.limit(0)).count() == 0
    times = {}
    for r in mixing.take(df).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in out:
        if r.size and r.doc_id != 1:
            assert times.get(r.doc_id, 0) == r.taken // r.size


def sketch_rows(spark, texts, k=128):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.s for r in bottomk.with_sketch(df, "text", "s", k).collect()}


def test_sketches(spark):
    from pyspark.sql import functions as F

    words = ["".join(random.Random(i).choices("abcdef", k=4)) for i in range(3000)]
    texts = ["", " \n", "one two", "a b c d e", "a b c d e a b c d e", " ".join(words), " ".join(words[:1500]), " ".join(words[1000:])]
    s = sketch_rows(spark, texts)
    assert s[0] == s[1] == [] and len(s[2]) == 1 and len(s[3]) == 1 and len(s[4]) == 5 and len(s[5]) == 128 and s[5] == sorted(s[5])
    df = spark.createDataFrame([(s[5], s[6], s[7])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = df.select(bottomk.resemblance(F.col("a"), F.col("b")), bottomk.containment(F.col("b"), F.col("a")), bottomk.distinct_count(F.col("a")), bottomk.merged(F.col("b"), F.col("c"))).first()
    assert abs(r[0] - 0.5) < 0.13 and r[1] > 0.75 and abs(r[2] - 2996) < 900
    whole = sketch_rows(spark, [" ".join(words[:1500])], 5000)[0], sketch_rows(spark, [" ".join(words[1000:])], 5000)[0]
    assert r[3] == sorted(set(whole[0]) | set(whole[1]))[:128]


@pytest.mark.parametrize("size", [512, 7])
def test_edits(spark, monkeypatch, size):
    monkeypatch.setattr(bottomk, "RANGE", size)
    monkeypatch.setattr(bottomk, "_STEP", 4)
    rnd = random.Random(4)
    texts = [None, "", "é"] + ["".join(rnd.choice("abé \n") for _ in range(rnd.randint(0, 400))) for _ in range(80)]
    rows = [(i * 10**9 - 10**10, t, "x") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = {r.doc_id: r for r in bottomk.edits(df).collect()}
    down = sorted(rows, reverse=True)
    for k, (i, t, _) in enumerate(down):
        t, nxt = t or "", down[(k + 1) % len(down)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        nxt_print = out[down[(k + 1) % len(down)][0]].fingerprint
        assert (r.near_next == 1.0) == (r.fingerprint == nxt_print) and 0 <= r.near_edited <= 1
    one = df.limit(1)
    assert bottomk.edits(one).first().near_next == 1.0 and bottomk.edits(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert bottomk.edits(same).count() == 4


def brute_hashes(text):
    """Shingle hashes of a text: XXH64 chained over the hashes of five words, upper 48 bits."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r")) if w]
    chain = lambda ws: functools.reduce(lambda h, w: xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h), ws, 42) >> 16
    return {chain(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edits_equal_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(3))
    base = [word() for _ in range(400)]
    texts = [None, "", "one two", "\x0b a  b\tc d e f \r", "x" * 50_000, " ".join(word() for _ in range(30_000))]
    texts += [" ".join(base[:n] + [word() for _ in range(m)]) for n, m in ((400, 0), (400, 0), (390, 10), (300, 100), (200, 200), (50, 350))] * 2
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, range int")
    out = {r.doc_id: r for r in bottomk.edits(df).collect()}
    sketch = lambda hashes: sorted(hashes)[:128]

    def alike(a, b):
        both = sketch(a | b)
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        half = len(t) // 2
        own, edited, following = (brute_hashes(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        own_s, edited_s, next_s = (set(sketch(x)) for x in (own, edited, following))
        r = out[i]
        assert r.fingerprint == "".join(f"{x:012x}" for x in sketch(own)) and r.edited_fingerprint == "".join(f"{x:012x}" for x in sketch(edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(alike(own_s, edited_s)), pytest.approx(alike(own_s, next_s)))


def test_pipeline(spark, sf):
    """Each stage on its own input against what it must do, and the whole against its stages."""
    docs = table(spark, sf, "documents")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(stored(stage(spark, inputs[-1], sf), "test"))
        if name != "packing":
            assert inputs[-1].columns == docs.columns
    rows = [x.collect() for x in inputs]
    # Quality: whole rows, those of a score of at least one half.
    model = quality.train(docs, table(spark, sf, "labels"), crc_of_id() % 3 != 1)
    good = {r.doc_id for r in rows[0] if float(model.score(quality.figures(r.text)[None, :])[0]) >= 0.5}
    assert {r.doc_id for r in rows[1]} == good and set(rows[1]) <= set(rows[0])
    # Near duplicates: of each component by exact similarity the smallest id.
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r.text or "").lower().split()) else set() for r in rows[1]}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and (sets[i] or not sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {r.doc_id for r in rows[2]} == set(root.values()) and set(rows[2]) <= set(rows[1])
    # Repeated passages: each byte in a window of 400 that occurs again goes.
    data = {r.doc_id: (r.text or "").encode() for r in rows[2]}
    seen = Counter(d[i : i + 400] for d in data.values() for i in range(len(d) - 399))
    left = {}
    for i, d in data.items():
        gone = set()
        for at in range(len(d) - 399):
            if seen[d[at : at + 400]] > 1:
                gone.update(range(at, at + 400))
        left[i] = bytes(b for at, b in enumerate(d) if at not in gone).decode("utf-8", "ignore")
    assert {r.doc_id: r.text or "" for r in rows[3]} == {i: t for i, t in left.items() if t or not data[i]}
    # Mixture: whole rows, each three times at most, sources as near to their targets as their documents allow.
    taken = Counter(rows[4])
    assert set(taken) <= set(rows[3]) and max(taken.values()) <= 3
    size = Counter()
    for r in rows[3]:
        size[r.source] += len((r.text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for name, aim in zip(names, brute_targets([size[n] for n in names], [1 + i % 3 for i in range(len(names))]), strict=True):
        got = sum(n * len((r.text or "").split()) for r, n in taken.items() if r.source == name)
        again = [len((r.text or "").split()) for r in rows[3] if r.source == name and taken[r] < 3]
        assert abs(got - aim) <= max(1, mixing.TOLERANCE * aim, min(filter(None, again), default=0) / 2 + 1, 0.05 * aim)
    # Packing: each id of each row once.
    assert sum(r.length for r in rows[5]) == sum(len(packing.word_ids(queries.vocabulary("word_bpe_49k.json")).of(r.text)) // 4 + 1 for r in rows[4])
    once = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert once == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows[5])


def test_queries_are_named():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
