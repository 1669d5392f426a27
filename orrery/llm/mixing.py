"""Mixing sources to target weights with hash-threshold histograms.

Each document gets a hash; a source takes the documents whose hash lies below the source's threshold. The
threshold is found from sums of sizes by source and hash bucket: the boundary bucket, where the running sum
passes the budget, is refined by the next bits of the hash, and so on until it holds a single hash. Nothing
is sorted, and one source with most of the rows is spread over all tasks, as sums are formed before the shuffle.
A long document at the boundary may leave a gap. While a source's gap is more than TOLERANCE of its target, the
same is done with what is left of the budget, from the boundary on, among the documents that are no larger
than that, and beyond the last from the first again, as long as a document may be taken once more; large sources
need no such round. Where none fits any more, one larger document is added if that makes the gap smaller.

Defined results: a null text has size 0; a null source is a source of its own, after all others; rows that
equal one another in id and text are taken together; an empty table gives no rows; columns other than those
named are ignored (`take` keeps them, whatever their names). A target above a source's size takes the whole source once or twice
and the thresholds decide on the rest. A source misses its target by TOLERANCE of it, or by half of the smallest
document (or group of equal rows) that it may still take.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, renamed, stored

#: Bits of the hash that one histogram resolves, and bits in all.
STEP_BITS, ALL_BITS = 15, 60
#: Part of its target that a source may miss.
TOLERANCE = 1e-3
MOST_TIMES = 3
#: Up to so many sources their few figures are broadcast (under 1 MB); beyond, joined by shuffle.
BROADCAST_SOURCES = 10_000
WEIGHTS = (1, 2, 3)
LARGEST = (1 << 63) - 1


def targets(sizes: list[int], weights: list[float], most_times: float = MOST_TIMES) -> list[float]:
    """Shares of all sizes by weight, none above most_times its own size; the excess is shared again by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        above = [i for i in open_ if share[i] > most_times * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(most_times * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


@dataclass
class Source:
    key: int
    size: int
    target: float
    times: int = 0
    #: What the rounds have still to find.
    need: float = 0.0
    #: (from hash, below hash, largest size): documents there are taken once more.
    rounds: list[tuple[int, int, int]] = field(default_factory=list)
    #: Of the round under way: where it began, the bucket it is at and the sum before that, the largest size, and whether it goes on.
    begin: int = 0
    bucket: int = 0
    before: int = 0
    most: int = LARGEST
    searching: bool = False
    #: Whether documents are left beyond the last boundary, and how often more than `times` they are now taken.
    more: bool = True
    layer: int = 1

    def short(self) -> bool:
        return self.need >= 1 and self.need > TOLERANCE * self.target

    def wants_more(self, most_times: int) -> bool:
        """After the last document comes the first again, unless it has been taken most_times."""
        if self.short() and not self.more and self.times + self.layer < most_times:
            self.begin, self.more, self.layer = 0, True, self.layer + 1
        return self.short() and self.more

    def ends(self, at: int, found: int, more: bool) -> None:
        """The round takes what lies below hash at, of that size in all; and whether there is more beyond."""
        self.rounds.append((self.begin, at, self.most))
        self.need -= found
        self.begin, self.more, self.searching = at, more, False


def _with_plan(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join figures of each source, by its key; broadcast while there are few sources."""
    plan = df.sparkSession.createDataFrame(rows, "source_key int, " + schema)
    return df.join(F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan, "source_key")


def _refine(marked: DataFrame, sources: list[Source], bits: int) -> None:
    """One histogram more: moves each source to the bucket of so many bits in which the running sum passes its need."""
    shift = ALL_BITS - bits
    width = 1 << (shift + STEP_BITS) if bits > STEP_BITS else 1 << ALL_BITS
    spans = [(s.key, max(s.begin, s.bucket), s.bucket + width, s.most, s.need - s.before) for s in sources]
    inside = _with_plan(marked, spans, "lo long, hi long, most long, need double").where((F.col("hash") >= F.col("lo")) & (F.col("hash") < F.col("hi")) & (F.col("size") <= F.col("most")))
    sums = inside.groupBy("source_key", "need", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("greatest"))
    run = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("size").over(run))
    # A row for each source: the first bucket that passes the need, and the sum of all.
    over = F.when(F.col("upto") > F.col("need"), F.struct("bucket", "upto", "size", "least", "greatest"))
    first = upto.groupBy("source_key").agg(F.min(over).alias("first"), F.max("upto").alias("all")).select("source_key", "all", "first.*")
    found = {r["source_key"]: r for r in first.collect()}
    for s in sources:
        r = found.get(s.key)
        if r is None or r["bucket"] is None:  # the need holds all that there is
            s.ends(s.bucket + width, s.before + (r["all"] if r else 0), False)
            continue
        s.before += r["upto"] - r["size"]
        s.bucket = r["bucket"] << shift
        if r["least"] == r["greatest"] or shift == 0:
            s.ends(r["least"], s.before, True)
            s.begin += 1  # beyond the boundary


def _search(marked: DataFrame, plan: list[Source], most_times: int) -> None:
    while wanting := [s for s in plan if s.wants_more(most_times)]:
        for s in wanting:
            s.searching, s.bucket, s.before = True, 0, 0
            s.most = int(s.need) if s.rounds else LARGEST
        bits = 0
        while searching := [s for s in wanting if s.searching]:
            bits += STEP_BITS
            _refine(marked, searching, bits)
    if short := [s for s in plan if s.short()]:
        # None fits any more: the one that comes nearest, if nearer than none.
        left = _with_plan(marked, [(s.key, s.times, s.rounds, s.need) for s in short], f"times long, {ROUNDS}, need double").where((F.col("times") + _more_times() < most_times) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("need")))
        groups = left.groupBy("source_key", "need", "hash").agg(F.sum("size").alias("size")).withColumn("gap", F.abs(F.col("size") - F.col("need"))).where(F.col("gap") < F.col("need"))
        best = {r["source_key"]: r["best"] for r in groups.groupBy("source_key").agg(F.min(F.struct("gap", "hash", "size")).alias("best")).collect()}
        for s in short:
            if s.key in best:
                s.rounds.append((best[s.key]["hash"], best[s.key]["hash"] + 1, LARGEST))
                s.need -= best[s.key]["size"]


ROUNDS = "rounds array<struct<lo:long,hi:long,most:long>>"


def _more_times() -> Column:
    """How many rounds take the document."""
    return F.size(F.filter("rounds", lambda r: (F.col("hash") >= r["lo"]) & (F.col("hash") < r["hi"]) & (F.col("size") <= r["most"])))


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))), 64 - ALL_BITS)


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _planned(docs: DataFrame, weights: tuple[float, ...], most_times: int, seed: int) -> tuple[DataFrame, list[Source], DataFrame]:
    """Sizes and hashes of documents with the key of their source, the plan, and names of the keys."""
    sized = stored(docs.select("doc_id", "source", _size().alias("size"), _hash(seed).alias("hash")), "sizes")
    # A row for each source; UTF-8 bytes sort as code points do.
    sources = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    aims = targets([r["size"] for r in sources], [weights[i % len(weights)] for i in range(len(sources))], most_times)
    plan = []
    for key, (r, aim) in enumerate(zip(sources, aims, strict=True)):
        s = Source(key, r["size"], aim)
        s.times = min(int(aim // r["size"]), most_times) if r["size"] else 0
        s.need = aim - s.times * r["size"]
        s.more = s.times < most_times
        plan.append(s)
    names = docs.sparkSession.createDataFrame([(k, r["source"]) for k, r in enumerate(sources)], "source_key int, of_source string")
    names = F.broadcast(names) if len(sources) <= BROADCAST_SOURCES else names
    marked = sized.join(names, F.col("source").eqNullSafe(F.col("of_source"))).drop("source", "of_source")
    _search(marked, [s for s in plan if s.more], most_times)
    return marked, plan, names


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target (of the source) and taken, in words; a row for each row of docs."""
    marked, plan, _ = _planned(docs, weights, most_times, seed)
    full = _with_plan(marked, [(s.key, s.size, s.target, s.times, s.rounds) for s in plan], f"source_size long, target double, times long, {ROUNDS}")
    return full.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + _more_times())).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """Each row of docs as often as the mixture takes it, all columns; one pass over docs besides that of the sizes."""
    own, columns = renamed(docs, "doc_id", "text", "source")
    _, plan, names = _planned(own, weights, most_times, seed)
    times = _with_plan(names, [(s.key, s.times, s.rounds) for s in plan], f"times long, {ROUNDS}").drop("source_key")
    times = F.broadcast(times) if len(plan) <= BROADCAST_SOURCES else times
    marked = own.withColumn("hash", _hash(seed)).withColumn("size", _size()).join(times, F.col("source").eqNullSafe(F.col("of_source")))
    n = F.col("times") + _more_times()
    return marked.withColumn("each", F.explode(F.array_repeat(F.lit(True), n.cast("int")))).select(*own.columns).toDF(*columns)
