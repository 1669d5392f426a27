"""Document fingerprints as bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the k smallest distinct hashes of the text's shingles, in order. The sketch of a union is the k
smallest of both sketches, so parts of a text or a corpus can be merged in any order. Two sketches give
estimates of resemblance, containment and distinct shingles; they are exact up to k shingles.

`edits` compares each document with the next one in descending order of id and with an edited text that
borrows from it. Rows are dealt to ranges of (id, hash of text); a range's first row also goes, as a guest, to
the end of the range above, so that one shuffle and a window within ranges find every next document.

Defined results: null and empty texts have no shingles and the empty sketch; two empty sketches are alike (1.0),
an empty and another are not (0.0); a text of fewer words than a shingle is one shingle; null ids come last;
repeated rows follow one another; a single row is its own next; an empty table gives no rows; columns other
than those named are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

K, SHINGLE, BITS = 128, 5, 48
#: Rows aimed at in a range, and most ranges (their bounds, about 40 bytes each, come to the driver).
RANGE, RANGES = 512, 1 << 16
_STEP = 256


def sketch_of(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def word_hashes(text: Column) -> Column:
    """Hashes of the words, in order."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, SPACE), lambda w: F.xxhash64(w)))


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Of the hashes of words. words must be a plain column: it is read once for each shingle."""
    n = F.size(words)
    each = F.transform(F.slice(words, 1, F.greatest(n - (shingle - 1), F.lit(0))), lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *(F.get(words, i + j) for j in range(1, shingle))), 64 - BITS))
    return F.when(n >= shingle, each).when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(words), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of column text."""
    return df.withColumn("_words", word_hashes(F.col(text))).withColumn(name, sketch_of(shingle_hashes(F.col("_words"), shingle), k)).drop("_words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of all distinct shingles of both."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of a's shingles that b has too."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    """Hexadecimal digits, twelve for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def _ranges(docs: DataFrame) -> list[tuple[int | None, int]]:
    """The largest (id, hash) of each range, ascending."""
    keys = docs.select("doc_id", "h")
    n = min(RANGES, max(1, math.ceil(keys.count() / RANGE)))
    tops = keys.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("doc_id", "h")).alias("top"))
    return sorted(((r["top"]["doc_id"], r["top"]["h"]) for r in tops.collect()), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    tops = _ranges(docs)
    kind = "struct<doc_id:bigint,h:bigint>"
    as_literal = lambda rows, t: F.from_json(F.lit(json.dumps(rows)), t)
    named = [{"doc_id": i, "h": h} for i, h in tops]
    steps = [named[at : at + _STEP] for at in range(0, len(named), _STEP)]
    key = F.struct("doc_id", "h")
    outer = F.size(F.filter(as_literal([s[-1] for s in steps], f"array<{kind}>"), lambda b: b < key))
    docs = docs.withColumn("step", F.least(outer, F.lit(max(0, len(steps) - 1))))
    own = F.get(as_literal(steps, f"array<array<{kind}>>"), F.col("step"))
    docs = docs.withColumn("range", F.col("step") * _STEP + F.size(F.filter(own, lambda b: b < key)))
    top = F.get(F.get(as_literal(steps, f"array<array<{kind}>>"), F.col("step")), F.col("range") - F.col("step") * _STEP)
    docs = with_sketch(docs, "text", "sketch", k, shingle)
    place = lambda r, guest: F.struct(r.cast("int").alias("range"), F.lit(guest).alias("guest"))
    above = F.pmod(F.col("range") + 1, F.lit(max(1, len(tops))))
    places = F.when(top == key, F.array(place(F.col("range"), False), place(above, True))).otherwise(F.array(place(F.col("range"), False)))
    dealt = docs.select("doc_id", "h", "text", "sketch", F.inline(places))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    paired = dealt.select("doc_id", "guest", "text", "sketch", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")).where(~F.col("guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))).drop("text", "next_text")
    edited = with_sketch(edited, "edited", "edited_sketch", k, shingle)
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
