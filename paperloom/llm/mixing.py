"""Operator 5 (native): mixing sources to target weights by pivotal dependent rounding.

DataFrame operations only.  A source's target over its size is the expected number of
copies of each of its documents: a whole part that every document gets and a fraction, the
copy probability, that rounding settles.  Two units with fractions a and b meet; random
transfer makes one of them 0 or 1 and the other carries the rest of the mass, so a source's
number of copies is conserved.  Units meet inside small groups (an ordered fold), one unit
of each group stays open, and the open units meet again in a reduction tree whose groups
are prefixes of a hash: a hot source is spread over as many groups as it has rows, and each
level leaves a sixty-fourth of the units.  Documents meet others of similar size first, so
the words taken stay near the target as well as the copies.  Random numbers are hashes of
the units that meet: reruns agree whatever the partitioning.

Defined cases: a null text has size 0; rows that repeat (equal id, source and text) share
one decision; null sources weigh in last; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN_BITS = 6
LEAF = 16  # expected units in a leaf group


def number_sources(per: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with ``number``, from 0, by code point, null last; no task sees them all.

    They are dealt by range; a range's start is the sum of the ranges before it, one row a task.
    """
    order = F.col("source").cast("binary").asc_nulls_last()
    dealt = scratch.save(per.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    counted = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("number", F.col("start") + F.col("place")).drop("range", "place", "start")


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target.  One row a source.

    Sources get weight times a level, at most their cap.  The level starts as if none were capped;
    each round caps the sources above it and shares what is left among the others, until no
    further one is.  A round is one aggregate; sums are of whole numbers, so reruns agree.
    """
    per = scratch.save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int") + 1)
    known = scratch.save(number_sources(per, scratch).withColumn("w", weight).drop("number"), "weighted")
    total, level, capped = None, 0.0, 0
    while True:
        full = F.col("source_size") * F.lit(float(most)) <= F.col("w") * F.lit(level)
        if total is None:
            full = F.lit(False)
        of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
        r = known.agg(of(full, F.lit(1)).alias("n"), of(full, F.col("source_size")).alias("held"), of(~full, F.col("w")).alias("open"), of(F.lit(True), F.col("source_size")).alias("all")).first()
        if total is not None and r["n"] == capped or not r["open"]:
            break
        total, capped = r["all"] * share, r["n"]
        level = (total - r["held"] * most) / r["open"]
    cap = F.col("source_size") * F.lit(float(most))
    target = F.least(cap, F.col("w") * F.lit(level)) if total is None or r["open"] else cap
    return known.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _meet(state: Column, x: Column, seed: int) -> Column:
    """Fold step: the open unit and the next one exchange mass; the settled one is listed."""
    a, b = state["open"]["p"], x["p"]
    s, u = a + b, _uniform(F.lit(seed), state["open"]["key"], x["key"])
    low = s < 1.0
    open_wins = F.when(low, u * s < a).otherwise(u * (2.0 - s) < 1.0 - b)
    # low: the loser settles at 0 and the winner keeps s; else the winner settles at 1 and the loser keeps s - 1.
    open_settles = open_wins != low
    settled = F.when(open_settles, state["open"]["key"]).otherwise(x["key"])
    stays = F.when(open_settles, x["key"]).otherwise(state["open"]["key"])
    return F.struct(
        F.struct(stays.alias("key"), F.when(low, s).otherwise(s - 1.0).alias("p")).alias("open"),
        F.concat(state["done"], F.array(F.struct(settled.alias("key"), F.when(low, 0).otherwise(1).alias("extra")))).alias("done"),
    )


def _fold(units: Column, seed: int) -> Column:
    zero = F.struct(units[0].alias("open"), F.expr("cast(array() as array<struct<key: struct<h: bigint, doc_id: bigint, source: string>, extra: int>>)").alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), zero, lambda s, x: _meet(s, x, seed))


def copies(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """A row for each distinct (doc_id, source, text): h, doc_id, rows, size, source, source_size, target, copies."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("h"),
    )
    units = scratch.save(sized.groupBy("h", "doc_id", "source").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")), "units")
    targets = scratch.save(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), scratch, weights, share, most), "targets")
    n = units.count()
    depth = max(1, math.ceil((max(1.0, math.log2(max(1, n) / LEAF))) / FAN_BITS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = units.alias("u").join(targets.alias("t"), F.expr("u.source <=> t.source")).select("u.*", "t.source_size", "t.target", rate.alias("rate"))
    # A document without words takes none however often it is copied.
    known = known.withColumn("base", F.floor("rate")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
    key = F.struct("h", "doc_id", "source").alias("key")
    level = known.where("p > 0").select(key, "p", F.floor(F.log2(F.col("size") * F.col("rows").cast("double")) * 4).cast("int").alias("class"), F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(1 << 62)).alias("place"))
    settled = []
    for k in range(depth, -2, -1):
        # Leaf groups share source, size class and hash prefix; the last two levels join classes.
        bits = 62 - FAN_BITS * max(k, 0)
        group = [F.col("key")["source"].alias("s"), *([F.col("class").alias("c")] if k > 0 else []), *([F.shiftright("place", bits).alias("g")] if k >= 0 else [])]
        gathered = level.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("class", "place", "key", "p"))).alias("units"))
        folded = gathered.withColumn("f", _fold(F.transform("units", lambda x: F.struct(x["key"].alias("key"), x["p"].alias("p"))), seed + k)).withColumn("last", F.element_at("units", -1))
        out = scratch.save(folded.select(F.col("f")["open"].alias("open"), F.col("f")["done"].alias("done"), F.col("last")["class"].alias("class"), F.col("last")["place"].alias("place")), f"level{k + 1}")
        settled.append(out.select(F.explode("done").alias("d")).select("d.key", "d.extra"))
        level = out.select(F.col("open")["key"].alias("key"), F.col("open")["p"].alias("p"), "class", "place")
    settled.append(level.select("key", (_uniform(F.lit(seed - 1), "key") < F.col("p")).cast("int").alias("extra")))
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.unionByName(s)
    extra = extra.where("extra > 0").select(F.col("key")["h"].alias("eh"), F.col("key")["doc_id"].alias("ed"), F.col("key")["source"].alias("es"), "extra")
    joined = known.join(extra, (F.col("h") == F.col("eh")) & F.col("doc_id").eqNullSafe(F.col("ed")) & F.col("source").eqNullSafe(F.col("es")), "left")
    return joined.select("h", "doc_id", "rows", "size", "source", "source_size", "target", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it; columns as given."""
    scratch = Scratch(docs.sparkSession, "mix")
    key, h, id_, n = (fresh(name, docs.columns) for name in ("__key", "__h", "__id", "__n"))
    taken = scratch.save(copies(docs, scratch, **options).where("copies > 0").select(F.col("h").alias(h), F.col("doc_id").alias(id_), F.col("copies").alias(n)), "taken")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    kept = rows.join(taken, (F.col(key) == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(key)).drop(key)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op5")
    chosen = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    # A unit stands for its repeated rows, each of which takes the same.
    each = chosen.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
