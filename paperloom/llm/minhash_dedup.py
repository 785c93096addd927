"""Operator 4: near-duplicates by a signature-coordinate inverted join.

A document is its set of distinct five-word shingles (64-bit hashes).  Documents with the
same set form one class, represented by its smallest id.  Classes are posted under each of
``COORDINATES`` (coordinate, minimum) pairs.  A pair of similarity 0.85 agrees in a binomial
number of coordinates; fewer than ``MATCHES`` of 64 has a chance of about 3 in a million.
Skips: a value posted once meets nothing, and a class with fewer than ``MATCHES`` shared
values has no partner at all.  Prefix: two classes that agree in ``MATCHES`` coordinates
share one of the ``COORDINATES - MATCHES + 1`` rarest values of either, so only these lists
are merged.

Merging avoids the square of a list's length: first each class meets a few lists' smallest
members (hubs) and confirmed links form components; then only members outside a list's
largest component meet the members of other components.  What is in one component already
needs no comparison, so no link between components is lost.  Shingles that no other
candidate holds bound what a class can share, which drops members of a family that have
drifted too far before any pair is made.  A candidate pair's collisions
are counted over all coordinates, and those above the threshold are confirmed on full sets.

Defined cases: a null text, or one without words, is an empty set, linked with nothing, its own component; texts under
five words are one shingle; repeated rows are copies of each other; rows that share an id
count as one document; rows without id are never representatives and, unless copies of a
row with an id, are their own (null) component; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, extended, fresh, text_bytes, tidy, word_slices
from .components import components

WORDS = 5
COORDINATES = 64
MATCHES = 40
PERCENT = 85
HUBS = 3
BROADCAST_IDS = 1_000_000  # 8 MB of ids at most; beyond, the join shuffles


@lru_cache(maxsize=4)
def _constants(k: int, words: int):
    import numpy as np

    rng = np.random.default_rng(20_04)
    draw = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    return draw(words), draw(k)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(w, words: int = WORDS):
    """Sorted distinct shingle hashes of a text's word hashes."""
    import numpy as np

    if not len(w):
        return np.zeros(0, np.uint64)
    factors, _ = _constants(COORDINATES, words)
    if len(w) < words:
        h = np.array([len(w)], np.uint64)
        for k in range(len(w)):
            h = _mix(h + w[k : k + 1] * factors[k : k + 1])
        return h
    h = w[: len(w) - words + 1] * factors[0]
    for k in range(1, words):
        h += w[k : len(w) - words + 1 + k] * factors[k]
    return np.unique(_mix(h))


def shingle_sets(texts):
    """Each text's shingles, in order; a word is hashed once a slice."""
    import numpy as np
    import xxhash

    for rows, words, index, offsets in word_slices(texts):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        for k in range(len(rows)):
            yield shingles(hashes[index[offsets[k] : offsets[k + 1]]])


def signature(h):
    """The minimum of each coordinate's hash over the set."""
    import numpy as np

    _, factors = _constants(COORDINATES, WORDS)
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(low, (h[at : at + 1024, None] * factors).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sid (128-bit hash of the set), sig."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            n, sid, sig = [], [], []
            for h in shingle_sets(b.column(1)):
                n.append(len(h))
                sid.append(xxhash.xxh3_128_digest(h.tobytes()))
                sig.append(signature(h))
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * COORDINATES, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), lists], names=["doc_id", "n_shingles", "sid", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, sid binary, sig array<int>")


def full_sets(docs: DataFrame) -> DataFrame:
    """node (the id), shingles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sets = list(shingle_sets(b.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), text_bytes().alias("text")).mapInArrow(tidy(run), "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where((100 * F.size("x") >= percent * F.size("y")) & (100 * F.size("y") >= percent * F.size("x")))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def groups(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    seen = scratch.save(sketches(docs), "sketches")
    live = seen.where("n_shingles > 0")
    classes = scratch.save(live.groupBy("sid").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "classes")
    posted = classes.where("node is not null").select("node", F.posexplode("sig").alias("k", "v")).select("node", (F.shiftleft(F.col("k").cast("long"), 32) + F.pmod(F.col("v").cast("long"), F.lit(1 << 32))).alias("cv"))
    often = posted.groupBy("cv").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(often, "cv").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "cv"))).alias("l")).where(F.size("l") >= matches)
    # Values posted once are the rarest; they fill the prefix first and meet nothing.
    take = F.lit(COORDINATES - matches + 1) - F.greatest(F.lit(0), F.lit(COORDINATES) - F.size("l"))
    own = F.transform(F.slice("l", 1, F.greatest(take, F.lit(1))), lambda e: e["cv"])
    prefix = scratch.save(shared.where(take > 0).select("node", own.alias("own")).select("node", "own", F.explode("own").alias("cv")), "prefix")
    nodes = scratch.save(prefix.select("node").distinct(), "nodes")
    few = nodes.count() <= BROADCAST_IDS
    chosen = nodes.withColumnRenamed("node", "doc_id")
    sets = scratch.save(full_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen) if few else chosen, "doc_id", "left_semi")), "sets")

    # How many of a class's shingles no other candidate has: an upper bound on what it can share.
    lone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    sizes = sets.groupBy("node").agg(F.max(F.size("shingles")).alias("n"), F.count(F.lit(1)).alias("rows"))
    bounds = sizes.join(lone, "node", "left").select("node", F.when(F.col("rows") == 1, F.col("n")).alias("n"), F.coalesce("lone", F.lit(0)).alias("lone"))
    prefix = scratch.save(prefix.join(bounds, "node").where(F.coalesce(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n"), F.lit(True))), "bounded")

    def can_link(n1, l1, n2, l2):
        """Whether two sets of these sizes and lone shingles can be similar enough; rows that share an id are let through."""
        most = F.least(n1 - l1, n2 - l2)
        return F.coalesce(100 * most >= percent * (n1 + n2 - most), F.lit(True))

    # A list's hub is its member with the smallest lone share: the likeliest to link to the rest.
    hub = F.min(F.struct((F.col("lone") / F.coalesce("n", F.lit(1))).alias("share"), F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("lone").alias("hl")))
    hubs = prefix.groupBy("cv").agg(hub.alias("h"), F.count(F.lit(1)).alias("members")).where("members > 1").select("cv", "h.hub", "h.hn", "h.hl")
    met = prefix.join(hubs, "cv").where((F.col("node") != F.col("hub")) & can_link(F.col("n"), F.col("lone"), F.col("hn"), F.col("hl"))).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    top = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("c"), (-F.col("hub")).alias("h"))), asc=False), 1, HUBS).alias("l"))
    first = scratch.save(top.select(F.col("node").alias("a"), F.explode("l").alias("e")).select("a", (-F.col("e")["h"]).alias("b")), "first")
    links = scratch.save(confirm(first, sets, percent), "links1")
    roots = components(links, scratch, "one")

    member = scratch.save(prefix.join(roots, "node", "left").select("cv", "node", "own", "n", "lone", F.coalesce("root", "node").alias("root")), "member")
    per = member.groupBy("cv", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cv").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = scratch.save(member.join(per, "cv").join(classes.select("node", "sig"), "node"), "mixed")
    out = mixed.where("root <> main").select("cv", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("xn"), F.col("lone").alias("xl"), F.col("own").alias("xo"), F.col("sig").alias("xs"))
    # Members outside the list's main component against those of other components; each pair
    # once, in the first list the two share, and only if enough of their coordinates collide.
    fresh = (F.col("root") != F.col("rx")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("x")))
    collisions = F.size(F.filter(F.arrays_zip("sig", "xs"), lambda z: z["sig"] == z["xs"]))
    crossed = mixed.join(out, "cv").where(fresh & can_link(F.col("n"), F.col("lone"), F.col("xn"), F.col("xl")) & (F.array_min(F.array_intersect("own", "xo")) == F.col("cv")) & (collisions >= matches))
    near = crossed.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
    second = scratch.save(confirm(scratch.save(near, "near"), sets, percent), "links2")
    scratch.drop("sets", "member", "mixed")
    roots = scratch.save(components(links.unionByName(second), scratch, "two"), "roots")
    named = classes.select("sid", "node").join(roots, "node", "left").select("sid", F.coalesce("root", "node").alias("root"))
    # The class join splits a group of copies: its smaller side has one row a class.
    found = live.select("doc_id", "n_shingles", "sid").join(named, "sid").select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    return found.unionByName(seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def with_set(docs: DataFrame, size: str, sid: str) -> DataFrame:
    """The rows with the size and the hash of their text's set, under the names given."""
    wide = len(docs.columns)
    schema = extended(docs, **{size: "long", sid: "binary"})

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            sets = [(len(h), xxhash.xxh3_128_digest(h.tobytes())) for h in shingle_sets(b.column(wide))]
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], names=schema.names)

    return docs.select("*", text_bytes().alias(fresh("__text", docs.columns))).mapInArrow(tidy(run), schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id.  Columns as given.

    Rows that share the id which stays: one for each different set of shingles.  Rows without id:
    copies of a row with an id go, of others one for each set stays.  Texts without words stay.
    """
    scratch = Scratch(docs.sparkSession, "near")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = scratch.save(groups(docs, scratch), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    # Only rows whose id does not tell them apart are read again.
    often = scratch.save(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    some, none = not often.isEmpty(), not found.where("doc_id is null").isEmpty()
    if not some and not none:
        return kept.select(*columns)
    size, sid = fresh("__size", docs.columns), fresh("__sid", docs.columns)
    often = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
    out = kept.where("doc_id is not null").join(often, "doc_id", "left_anti").select(*columns)
    again = with_set(kept.where("doc_id is not null").join(often, "doc_id", "left_semi").select(*columns), size, sid)
    nameless = with_set(kept.where("doc_id is null").select(*columns), size, sid)
    named = docs.sparkSession.read.parquet(f"{scratch.path}/classes").where("node is not null").select(F.col("sid").alias(sid))
    for rows, key in ((again, ["doc_id", sid]), (nameless.join(named, sid, "left_anti"), [sid])):
        out = out.unionByName(rows.where(F.col(size) == 0).select(*columns)).unionByName(rows.where(F.col(size) > 0).dropDuplicates(key).select(*columns))
    return out


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs, Scratch(spark, "op4")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
