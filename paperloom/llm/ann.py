"""Operator 3: nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are assigned to the nearest of about sqrt(n) centroids (k-means on a bounded sample:
``PER_LIST`` rows a list, at most ``MOST_LISTS`` lists; every row is indexed) and rotated at
random, so that any leading dimensions are a fair sample of the distance.  A list's vectors
lie in column blocks of ``STEP`` dimensions.  The share of a squared distance that d of D rotated
dimensions hold follows a beta law with mean d/D; a candidate whose partial distance, scaled to
all dimensions, exceeds the query's bound by more than ``SIGMAS`` standard deviations of that
law is abandoned.  Survivors get their exact distance on the original vectors, in double precision.

The bound is known from the start of almost every scan: a first round scans each query's
nearest list, in chunks that tighten the bound as they go, and the second round takes the k-th
best distance of the first into all other probed lists.  The columns ``scanned`` and ``abandoned``
count a query's candidates and those that never saw their last column block.

The number of probed lists is set from the data: the fewest with which sampled queries find
``AIM`` of their neighbours in the sample.  Long lists are dealt to tasks in blocks of rows, and
lists that many queries probe also in blocks of queries, so a hot list is many tasks' work.

Defined cases: vectors null, zero, of another length than most, or with null or non-finite
components take no part; ties go to the smaller id; rows with the query's own id are never
its neighbours; a query id given on several rows is asked once, with its smallest vector;
repeated candidates count as often as they are given; with fewer candidates than ten all are
returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

NEIGHBOURS = 10
MOST_LISTS = 16_384
PER_LIST = 32  # sampled rows a list
LEAST_SAMPLE = 2_000
DIRECT_LISTS = 1_024  # more lists are found in two levels
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
CHUNK = 256
STEP = 8
SIGMAS = 2.5
AIM = 0.95
EVERY = 100
FOUND = "query_id long, vec_id long, score double, scanned long, abandoned long"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: finite, not zero."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.where(F.exists("v", lambda x: x != 0))


def _distances(x, c):
    """Squared distances of rows to centroids, less each row's own square."""
    return (c * c).sum(1)[None] - 2 * x @ c.T


def _nearest(x, c):
    import numpy as np

    return np.concatenate([_distances(x[lo : lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)])


def kmeans(x, k: int, rounds: int = 8, seed: int = 3):
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(len(c) + 1))
        for j in range(len(c)):
            rows = order[edge[j] : edge[j + 1]]
            c[j] = x[rows].mean(0) if len(rows) else x[rng.integers(len(x))]
    return c


def centroids(x, k: int):
    """k centroids: directly, or each coarse cluster cut by its share of the rows."""
    import numpy as np

    if k <= DIRECT_LISTS:
        return kmeans(x, k)
    coarse = kmeans(x, int(round(k**0.5)))
    own = _nearest(x, coarse)
    parts = [x[own == j] for j in range(len(coarse))]
    return np.concatenate([kmeans(p, max(1, round(k * len(p) / len(x))), seed=j) for j, p in enumerate(parts) if len(p)])


def nearest_lists(x, c, n: int):
    """The n nearest lists of each row, nearest first."""
    import numpy as np

    d = _distances(x, c)
    if n >= len(c):
        return np.argsort(d, 1, kind="stable")
    near = np.argpartition(d, n - 1, 1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)


def choose_probes(x, c, k: int = NEIGHBOURS, aim: float = AIM, queries: int = 200) -> int:
    """The fewest probed lists with which sampled queries find ``aim`` of their neighbours in the sample."""
    import numpy as np

    q = x[: min(queries, len(x))]
    d = _distances(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return len(c)
    rank = np.argsort(nearest_lists(q, c, len(c)), 1)  # of each list, for each query
    depth = np.sort(np.take_along_axis(rank, _nearest(x, c)[near], 1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(aim * len(depth))) - 1)]) + 1


def scan(q, own_id, rot_q, x, rot, ids, bound: float, k: int = NEIGHBOURS, step: int = STEP, sigmas: float = SIGMAS, chunk: int = CHUNK):
    """The query's k nearest of one block as (distance, id), candidates scanned, candidates abandoned.

    ``bound``: a distance that k candidates are known to keep to, or infinity.
    """
    import numpy as np

    dim, best, limit, scanned, abandoned = len(q), [], bound * bound, 0, 0
    for lo in range(0, len(ids), chunk):
        alive = np.arange(lo, min(len(ids), lo + chunk))
        alive = alive[ids[alive] != own_id]
        scanned += len(alive)
        part = np.zeros(len(alive))
        for d in range(0, dim, step):
            diff = rot[d : d + step, alive] - rot_q[d : d + step, None]
            part += (diff * diff).sum(0)
            done = min(dim, d + step)
            if limit < np.inf and done < dim:
                stay = part * dim / done <= limit * (1 + sigmas * np.sqrt(2 * (dim - done) / (done * (dim + 2))))
                abandoned += len(alive) - int(stay.sum())
                alive, part = alive[stay], part[stay]
                if not len(alive):
                    break
        if limit < np.inf:
            alive = alive[part <= limit * (1 + 1e-9)]
        if len(alive):
            exact = np.sqrt(((x[alive] - q) ** 2).sum(1))
            best = sorted([*best, *zip(exact.tolist(), ids[alive].tolist())])[:k]
            if len(best) == k:
                limit = min(limit, best[-1][0] ** 2)
    return best, scanned, abandoned


def scan_lists(asked: DataFrame, stored: DataFrame, lengths: dict[int, int], turn, k: int) -> DataFrame:
    """Rows of FOUND: neighbours, and a row without vec_id for each scan's counts.

    asked: (id, v, list, bound); stored: (id, v, list).  The numbers of blocks are one small row a
    list, at most ``MOST_LISTS`` of them.
    """
    import numpy as np

    spark = asked.sparkSession
    often = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(j, -(-lengths[j] // BLOCK_ROWS), -(-n // BLOCK_QUERIES)) for j, n in often.items() if j in lengths]
    if not shape:
        return spark.createDataFrame([], FOUND)
    blocks = F.broadcast(spark.createDataFrame(shape, "list int, parts long, turns long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = asked.join(blocks, "list").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).withColumn("part", every("parts")).select("id", "v", "bound", "list", "part", "turn")
    rows = stored.join(blocks, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("turn", every("turns")).select("id", "v", "list", "part", "turn")

    def probe(asking, found):
        import pandas as pd

        res = []
        if len(asking) and len(found):
            x = np.stack([np.frombuffer(r) for r in found["v"]])
            ids = found["id"].to_numpy()
            columns = np.ascontiguousarray((x @ turn).T)
            for qid, raw, bound in zip(asking["id"].tolist(), asking["v"], asking["bound"].tolist()):
                q = np.frombuffer(raw)
                best, scanned, abandoned = scan(q, qid, q @ turn, x, columns, ids, bound, k)
                res += [(qid, i, s, 0, 0) for s, i in best]
                res.append((qid, None, None, scanned, abandoned))
        cols = list(zip(*res)) or [()] * 5
        kinds = ("int64", "Int64", "float64", "int64", "int64")
        return pd.DataFrame({n: pd.array(c, dtype=t) for n, c, t in zip(("query_id", "vec_id", "score", "scanned", "abandoned"), cols, kinds)})

    key = ("list", "part", "turn")
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(probe, FOUND)


def search(vectors: DataFrame, scratch: Scratch, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score, scanned, abandoned."""
    import numpy as np

    spark = vectors.sparkSession
    rows = scratch.save(valid_vectors(vectors), "valid")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned long, abandoned long")
    dim, total = dims[0]["d"], dims[0]["count"]
    rows = rows.where(F.size("v") == dim)
    n_lists = max(1, min(MOST_LISTS, round(total**0.5)))
    want = max(LEAST_SAMPLE, PER_LIST * n_lists)
    sample = (rows.sample(fraction=min(1.0, want / total), seed=7) if total > want else rows).limit(2 * want).collect() or rows.limit(want).collect()
    x = np.array(sorted(r["v"] for r in sample))
    x = x[np.random.default_rng(11).permutation(len(x))]
    scale = float(np.abs(x).max())
    lists = centroids(x / scale, min(n_lists, len(x)))
    probes = choose_probes(x / scale, lists)
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))[0]

    def assign(n):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    ids = b.column(0).slice(lo, 4096)
                    v = b.column(1).slice(lo, 4096).flatten().to_numpy().reshape(len(ids), dim)
                    own = nearest_lists(v / scale, lists, n).astype(np.int32)
                    raw = pa.array([r.tobytes() for r in v], pa.binary())
                    near = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, raw, near], names=["id", "v", "lists"])

        return run

    kind = "id long, v binary, lists array<int>"
    stored = scratch.save(rows.select("vec_id", "v").mapInArrow(assign(1), kind).select("id", "v", F.col("lists")[0].alias("list")), "stored")
    lengths = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    once = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.save(once.select("vec_id", "v").mapInArrow(assign(probes), kind), "asked")

    first = asked.select("id", "v", F.col("lists")[0].alias("list"), F.lit(float("inf")).alias("bound"))
    near = scratch.save(scan_lists(first, stored, lengths, turn, k), "near")
    kth = Window.partitionBy("query_id").orderBy("score", "vec_id")
    bounds = near.where("vec_id is not null").withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = asked.join(bounds, "id", "left").select("id", "v", F.explode(F.slice("lists", 2, max(1, probes))).alias("list"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = near.unionByName(scratch.save(scan_lists(rest, stored, lengths, turn, k), "far"))

    counts = found.where("vec_id is null").groupBy("query_id").agg(F.sum("scanned").alias("scanned"), F.sum("abandoned").alias("abandoned"))
    best = found.where("vec_id is not null").withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
    return best.drop("scanned", "abandoned").join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "scanned", "abandoned")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Scratch(spark, "op3"))
