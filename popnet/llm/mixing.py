"""Mixing sources to target weights by subset-sum budget fitting (operator 5).

Sizes are exact word counts.  Weights are dealt to the sources in code-point order (null
last) and share ``share`` times the sum of all sizes; a target is at most ``most`` times
its source's size, and what is above is shared again by weight until none is above.

A source's target is met by whole passes over its documents and a last partial pass.  For
that one, documents are counted by exact size; all but the last ``SLACK`` words of the
budget are shared out in proportion to the sizes' counts, and a bounded knapsack (a bit
set of reachable sums over the sizes' remaining counts) fits the rest, whose sum is the
best there is for it; a budget up to ``SLACK`` words is the knapsack's as a whole.  Then,
within each size, the documents with the smallest seeded hashes are selected.

Sources are numbered and their targets settled by grouped sums, so their number is not
bounded by the driver.  One source's counts are at most one row per distinct size, so the
fit of a source is one small task; its memory is a bit for each word of ``SLACK`` plus the
largest size, and 4 bytes for each to find the way back.  The selection finds each
(source, size)'s cut: the bucket of hashes that it falls into, from the buckets' counts,
and the hash in that bucket.  So no source and no size is ever sorted as a whole, and rows
are selected where they are: only names, sizes and hashes are shuffled.

Defined cases: null or blank text has size 0 and is taken in whole passes only (a
document of size 0 adds no words); a source whose documents are all empty has target 0;
null doc_id and repeated rows are documents like others (rows equal in doc_id and text are
interchangeable); long texts are counted whole; an empty table gives an empty table; other
columns are kept by ``mix`` and may have any names but those starting with ``__mix_``,
which raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from popnet.llm.shared import released, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 7
#: Buckets of the seeded hash inside one source and size.
BUCKETS = 256
#: Words of a budget that the knapsack fits, at least, where the budget has as many.
SLACK = 1 << 18
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words in a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The target of each source, in the order of the sources."""
    n = len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    out = [0.0] * n
    open_, left = set(range(n)), share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def fit(sizes: list[int], counts: list[int], budget: int, slack: int = SLACK) -> list[int]:
    """How many of each size (ascending, distinct, positive) to take, at most ``counts``, to come near ``budget`` from below.

    Python's integers, so no number of documents is too large.
    """
    whole = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= whole:
        return list(counts)
    took = [0] * len(sizes)
    part, carry = max(0, budget - slack), 0  # in words times ``whole``: what larger sizes left over goes on to smaller ones
    for i in range(len(sizes) - 1, -1, -1):
        due = sizes[i] * counts[i] * part + carry
        took[i] = min(counts[i], due // (sizes[i] * whole))
        carry = due - took[i] * sizes[i] * whole
    left = budget - sum(s * t for s, t in zip(sizes, took, strict=True))
    # each size's remaining count, in powers of two, as items of a 0/1 knapsack
    reach, full = 1, (1 << (left + 1)) - 1
    items: list[tuple[int, int]] = []
    by = np.full(left + 1, -1, np.int32)
    for i, s in enumerate(sizes):
        if reach >> left & 1:
            break  # nothing is nearer
        spare, step = min(counts[i] - took[i], left // s), 1
        while spare > 0:
            step = min(step, spare)
            fresh = (reach << (s * step)) & full & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(items)
                items.append((i, step))
                reach |= fresh
            spare -= step
            step *= 2
    at = reach.bit_length() - 1
    while at > 0:
        i, step = items[by[at]]
        took[i] += step
        at -= step * sizes[i]
    return took


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's rows (size, n, goal, source_size) to the copies of each size: all get ``passes``, ``extra`` of them one more."""
    pdf = pdf.sort_values("size")
    whole, goal = int(pdf["source_size"].iloc[0]), float(pdf["goal"].iloc[0])
    passes = 0 if whole == 0 else int(goal // whole)
    extra = np.zeros(len(pdf), np.int64)
    if whole:
        some = pdf["size"].to_numpy() > 0
        extra[some] = fit(pdf["size"].to_numpy()[some].tolist(), pdf["n"].to_numpy()[some].tolist(), round(goal - passes * whole))
    return pd.DataFrame({"__mix_null": pdf["__mix_null"], "__mix_source": pdf["__mix_source"], "__mix_size": pdf["size"], "__mix_passes": np.int64(passes), "__mix_extra": extra})


def settled(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``by_source`` (__mix_null, __mix_source, source_size) with ``goal``, as ``targets`` has it, by sums over the sources.

    Sources are numbered inside ranges; the ranges' counts give each range's first number.
    A round takes the sums of the sources that aren't settled and settles those above their
    bound; the other targets are the rest's share in the last round.
    """
    ranged = written(by_source.repartitionByRange("__mix_null", "__mix_source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per range
    first, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        first.append(total % len(weights))
        total += counts.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy("__mix_null", "__mix_source")) - 1
    at = F.element_at(F.array(*[F.lit(x) for x in first or [0]]), F.col("part") + 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((at + inside) % len(weights) + 1).cast("int"))
    numbered = written(ranged.select("__mix_null", "__mix_source", "source_size", weight.alias("w")), "mix-weights")
    # a source is above its bound when the words a weight has exceed its ratio, and those only grow from round to round
    ratio = F.lit(float(most)) * F.col("source_size") / F.col("w")
    everything = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    rate = None
    while True:
        bound = F.lit(False) if rate is None else ratio < rate
        got = numbered.agg(F.sum(F.when(bound, F.col("source_size"))).alias("kept"), F.sum(F.when(~bound, F.col("w"))).alias("w")).first()
        now = None if not got["w"] else (share * everything - most * (got["kept"] or 0)) / got["w"]
        if now is None or now == rate:
            break
        rate = now
    goal = F.lit(float(most)) * F.col("source_size") if rate is None else F.when(ratio < rate, F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(rate) * F.col("w"))
    return numbered.select("__mix_null", "__mix_source", "source_size", goal.alias("goal"))


KEY = ["__mix_null", "__mix_source", "__mix_size"]


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with the source's key (null apart), the size, the seeded hash and its bucket."""
    source = F.col("source").cast("string")
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns], source.isNull().alias("__mix_null"), F.coalesce(source, F.lit("")).alias("__mix_source"),
        size_of(F.col("text")).alias("__mix_size"), h.alias("__mix_hash"),
    )
    return rows.withColumn("__mix_bucket", F.pmod("__mix_hash", F.lit(BUCKETS)).cast("int"))


def cuts(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row per source and size of ``rows`` (as from ``keyed``): how often all of its documents are taken, and the cut for one time more.

    Columns: KEY, __mix_passes, __mix_cut_bucket and __mix_cut_hash (null: none more),
    __mix_room (how many of the rows at the cut itself), __mix_at (how many there are),
    __mix_source_size, __mix_target.
    """
    counts = written(rows.groupBy(*KEY, "__mix_bucket").agg(F.count("*").alias("n")), "mix-counts")
    by_source = counts.groupBy("__mix_null", "__mix_source").agg(F.sum(F.col("n") * F.col("__mix_size")).alias("source_size"))
    named = written(settled(by_source, weights, share, most), "mix-goals")
    by_size = counts.groupBy(*KEY).agg(F.sum("n").alias("n")).withColumnRenamed("__mix_size", "size")
    plan = by_size.join(named, ["__mix_null", "__mix_source"]).groupBy("__mix_null", "__mix_source").applyInPandas(
        _plan, "__mix_null boolean, __mix_source string, __mix_size long, __mix_passes long, __mix_extra long"
    )
    plan = written(plan, "mix-plan")
    before = Window.partitionBy(*KEY).orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # the bucket that the last document taken is in, and how many of it
    last = ahead.join(plan.where("__mix_extra > 0"), KEY).where("ahead < __mix_extra and __mix_extra <= ahead + n")
    last = written(last.select(*KEY, "__mix_bucket", (F.col("__mix_extra") - F.col("ahead")).alias("room")), "mix-last")
    hashes = rows.join(last, [*KEY, "__mix_bucket"]).groupBy(*KEY, "__mix_bucket", "__mix_hash").agg(F.count("*").alias("at"), F.first("room").alias("room"))
    up = Window.partitionBy(*KEY, "__mix_bucket").orderBy("__mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    found = hashes.withColumn("under", F.coalesce(F.sum("at").over(up), F.lit(0))).where("under < room and room <= under + at")
    found = found.select(*KEY, F.col("__mix_bucket").alias("__mix_cut_bucket"), F.col("__mix_hash").alias("__mix_cut_hash"), (F.col("room") - F.col("under")).alias("__mix_room"), F.col("at").alias("__mix_at"))
    out = plan.drop("__mix_extra").join(found, KEY, "left").join(named, ["__mix_null", "__mix_source"])
    out = written(out.withColumnsRenamed({"source_size": "__mix_source_size", "goal": "__mix_target"}), "mix-cuts")
    released(counts, named, plan, last)
    return out


def taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` (as from ``keyed``) with __mix_source_size, __mix_target and __mix_copies.

    Rows that repeat the doc_id and the text of one at the cut are told apart by a number,
    in a pass of their own that runs only where there are too many of them.
    """
    met = rows.join(cut, KEY)
    at = (F.col("__mix_bucket") == F.col("__mix_cut_bucket")) & (F.col("__mix_hash") == F.col("__mix_cut_hash"))
    under = (F.col("__mix_bucket") < F.col("__mix_cut_bucket")) | ((F.col("__mix_bucket") == F.col("__mix_cut_bucket")) & (F.col("__mix_hash") < F.col("__mix_cut_hash")))
    tied = F.coalesce(at & (F.col("__mix_room") < F.col("__mix_at")), F.lit(False))
    extra = F.coalesce((under | at).cast("long"), F.lit(0))
    some = cut.where("__mix_room < __mix_at")
    if not some.isEmpty():
        w = Window.partitionBy(*KEY, "__mix_hash").orderBy("__mix_bucket")
        number = met.where(tied).withColumn("__mix_number", F.row_number().over(w))
        number = number.withColumn("__mix_copies", F.col("__mix_passes") + (F.col("__mix_number") <= F.col("__mix_room")).cast("long")).drop("__mix_number")
        return met.where(~tied).withColumn("__mix_copies", F.col("__mix_passes") + extra).unionByName(number)
    return met.withColumn("__mix_copies", F.col("__mix_passes") + extra)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with __mix_size, __mix_source_size, __mix_target and __mix_copies (0 to ``most``).

    The rows of the mix are those with copies above 0, each as often as its copies say.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("__mix_")]:
        raise ValueError(f"columns {clash} have names that the mix uses itself")
    names = written(keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix-names")
    cut = cuts(names, weights, share, most)
    released(names)
    found = taken(keyed(docs, seed), cut)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = written(keyed(docs).drop("text"), "mix-names")  # the texts are read once
    return taken(names, cuts(names)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"),
    )
