"""Operator 6: near-duplicate vectors by sorted projection passes.

Equal vectors of a label form one class.  Each pass gives a class a key of concatenated
one-bit random projections, sorts lexicographically by (label, key) and compares each class
with the next ``WINDOW`` ones; links at or above the threshold, verified in double precision, are
united across passes.  Sorting is by range, so a hot label spreads over tasks, and the
windows that span two tasks are compared from the tasks' edge rows.

A window is a cap on neighbours, so the passes only start the components.  A sweep then
compares all classes of a label exactly, in blocks against blocks: it counts every link and joins
the components that the passes left apart.  It emits counts and roots, never pairs, and leaves out
only pairs of blocks whose bounding angles rule a link out.  Its work grows with the square of
a label's size where the vectors have no structure.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
with a null label, link with nothing and are their own component; vectors of different
lengths never link; repeated rows count as further vectors; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_array, write_file
from .components import components

THRESHOLD = 0.98
PASSES = 10
WINDOW = 24
BITS = 64
BLOCK = 1024


def _projections(dim: int, which: int):
    import numpy as np

    return np.random.default_rng(7919 * dim + which).standard_normal((dim, BITS))


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (float64 bytes of the scaled vector; null where it takes no part), cid."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            units, cids = [], []
            for v, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                u = None
                if v is not None and label is not None and len(v) and None not in v:
                    x = np.array(v, float)
                    top = float(np.abs(x).max())
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        u = (x / np.linalg.norm(x)).tobytes()
                units.append(u)
                cids.append(None if u is None else xxhash.xxh3_128_digest(np.array(v, float).tobytes() + str(label).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.binary()), pa.array(cids, pa.binary())], names=["vec_id", "label", "unit", "cid"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, label string, unit binary, cid binary")


def window_links(labels, ids, rows, threshold: float, window: int):
    """(a, b) forest links among sorted rows: each with the next ``window`` of its label and length."""
    import numpy as np

    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    sizes = np.array([len(r) for r in rows])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        u, l, own = np.stack([rows[i] for i in at]), np.array([labels[i] for i in at], dtype=object), [ids[i] for i in at]
        for d in range(1, min(window, len(at) - 1) + 1):
            hit = np.flatnonzero((l[:-d] == l[d:]) & (np.einsum("ij,ij->i", u[:-d], u[d:]) >= threshold))
            for i in hit.tolist():
                a, b = find(own[i]), find(own[i + d])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((own[i], own[i + d]))
    return out


def one_pass(classes: DataFrame, which: int, scratch: Scratch, threshold: float, window: int) -> DataFrame:
    """(a, b) links of one sorted pass."""

    def keyed(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys = []
            for u in b.column(2):
                x = np.frombuffer(u.as_py())
                keys.append(np.packbits(x @ _plane(len(x)) > 0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), b.column(2)], names=["node", "label", "key", "unit"])

    planes: dict = {}

    def _plane(dim):
        if dim not in planes:
            planes[dim] = _projections(dim, which)
        return planes[dim]

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list = []
        head: list = []
        links: list = []
        for b in batches:
            new = list(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), (np.frombuffer(x.as_py()) for x in b.column(3))))
            if len(head) < window:
                head += new[: window - len(head)]
            rows = held + new
            links += window_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], threshold, window)
            held = rows[-window:]
        edge = [(pid - 1, k, *r) for k, r in enumerate(head, window)] + [(pid, k - len(held) + window, *r) for k, r in enumerate(held)]
        rows = [(a, b, None, None, None, None) for a, b in links] + [(n, None, at, k, label, u.tobytes()) for at, k, label, n, u in edge]
        for lo in range(0, len(rows), 20_000):
            cols = list(zip(*rows[lo : lo + 20_000]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a", "b", "at", "k", "label", "unit"])

    def across(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("k")
        links = window_links(frame["label"].tolist(), [int(x) for x in frame["a"]], [np.frombuffer(x) for x in frame["unit"]], threshold, window)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    ordered = classes.select("node", "label", "unit").mapInArrow(keyed, "node long, label string, key binary, unit binary").repartitionByRange("label", "key", "node").sortWithinPartitions("label", "key", "node")
    out = scratch.save(ordered.mapInArrow(compare, "a long, b long, at long, k long, label string, unit binary"), f"pass{which}")
    return out.where("at is null").select("a", "b").unionByName(out.where("at is not null").select("a", "at", "k", "label", "unit").groupBy("at").applyInPandas(across, "a long, b long"))


def write_blocks(members: DataFrame, folder: str, block: int) -> DataFrame:
    """members (label, node, mult, root, unit) -> one row for each file of up to ``block`` vectors of one length, in order of label.

    A block's centre and the largest angle to it bound every angle between two blocks.
    """

    def run(batches):
        import json

        import numpy as np
        import pyarrow as pa
        import uuid

        def written(rows):
            u = np.stack([np.frombuffer(r[4]) for r in rows])
            labels = sorted({r[0] for r in rows})
            code = {x: k for k, x in enumerate(labels)}
            numbers = np.array([[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [code[r[0]] for r in rows]], np.int64)
            uri = f"{folder}/{uuid.uuid4().hex}"
            write_file(uri, u.tobytes(), numbers.tobytes(), json.dumps(labels).encode())
            centre = u.mean(0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 1e-9 else u[0]
            wide = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
            names = ("uri", "rows", "dim", "first", "last", "centre", "wide")
            return pa.RecordBatch.from_pylist([dict(zip(names, (uri, len(rows), u.shape[1], labels[0], labels[-1], centre.tobytes(), wide)))], schema=schema)

        schema = pa.schema([("uri", pa.string()), ("rows", pa.int64()), ("dim", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("centre", pa.binary()), ("wide", pa.float64())])
        rows: list = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if rows and (len(rows) == block or len(rows[0][4]) != len(r[4])):
                    yield written(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield written(rows)

    key = ("dim", "label", "root", "node")
    ordered = members.withColumn("dim", F.length("unit")).repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.select("label", "node", "mult", "root", "unit").mapInArrow(run, "uri string, rows long, dim long, first string, last string, centre binary, wide double")


def read_block(uri: str, rows: int, dim: int):
    """units, node, mult, root, label code, labels."""
    import json

    import numpy as np

    raw = map_array(uri, np.uint8)
    end = rows * dim * 8
    numbers = np.frombuffer(raw[end : end + 32 * rows].tobytes(), np.int64).reshape(4, rows)
    return np.frombuffer(raw[:end].tobytes()).reshape(rows, dim), *numbers, json.loads(raw[end + 32 * rows :].tobytes())


def linked(u, v, threshold: float):
    """Which rows of u and v are at or above the threshold in double precision; single precision decides the clear ones."""
    import numpy as np

    s = u.astype(np.float32) @ v.astype(np.float32).T
    margin = (u.shape[1] + 8) * 2.0**-22
    hit = s >= threshold + margin
    r, c = np.nonzero((s >= threshold - margin) & ~hit)
    step = max(1, (1 << 20) // u.shape[1])
    for lo in range(0, len(r), step):
        i, j = r[lo : lo + step], c[lo : lo + step]
        hit[i, j] = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
    return hit


def sweep(spark: SparkSession, blocks: list, threshold: float) -> DataFrame:
    """(node, n) for every node: vectors of its label at or above the threshold; (a, b): roots that such a pair joins.

    Every block meets all blocks that share a label with it, but for those whose bounds say
    that no pair can link.  A task reads its partners one after the other and emits one count a node.
    """

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        def allowed(x, y):
            if x["dim"] != y["dim"] or x["first"] > y["last"] or y["first"] > x["last"]:
                return False
            cosine = float(np.clip(np.frombuffer(x["centre"]) @ np.frombuffer(y["centre"]), -1, 1))
            return math.acos(cosine) - x["wide"] - y["wide"] <= math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for at in b.column(0).to_pylist():
                mine = blocks[at]
                u, node, mult, root, code, labels = read_block(mine["uri"], mine["rows"], mine["dim"])
                n, links = np.zeros(len(u), np.int64), []
                parent.clear()
                for k, other in enumerate(blocks):
                    if not allowed(mine, other):
                        continue
                    v, _, times, far, theirs, names = read_block(other["uri"], other["rows"], other["dim"])
                    hit = linked(u, v, threshold)
                    if len(labels) > 1 or len(names) > 1:
                        own = {x: i for i, x in enumerate(labels)}
                        hit &= code[:, None] == np.array([own.get(x, -1) for x in names])[theirs][None]
                    n += hit @ times
                    if k >= at:
                        i, j = np.nonzero(hit & (root[:, None] != far[None]))
                        for x, y in np.unique(np.stack([root[i], far[j]], 1), axis=0).tolist():
                            x, y = find(x), find(y)
                            if x != y:
                                parent[max(x, y)] = min(x, y)
                                links.append((x, y))
                none = [None] * len(links)
                a, z = ([x for x, _ in links], [y for _, y in links])
                blank = [None] * len(node)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([*node.tolist(), *none], [*n.tolist(), *none], [*blank, *a], [*blank, *z])], names=["node", "n", "a", "b"])

    return spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(run, "node long, n long, a long, b long")


def groups(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id for each row."""
    rows = scratch.save(prepare(vectors), "rows")
    live = rows.where("cid is not null")
    classes = scratch.save(live.groupBy("cid").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("unit").alias("unit")).where("node is not null"), "classes")
    links = None
    for p in range(passes):
        found = one_pass(classes, p, scratch, threshold, window)
        links = found if links is None else links.unionByName(found)
    links = scratch.save(links.distinct(), "links")
    scratch.drop(*[f"pass{p}" for p in range(passes)])
    roots = scratch.save(components(links, scratch), "roots")
    members = classes.join(roots, "node", "left").select("label", "node", "mult", F.coalesce("root", "node").alias("root"), "unit")
    blocks = scratch.save(write_blocks(members, f"{scratch.path}/blocks", block), "listed")
    listed = [r.asDict() for r in blocks.orderBy("dim", "first", "last", "uri").collect()]
    swept = scratch.save(sweep(scratch.spark, listed, threshold), "swept")
    scratch.drop("blocks")
    merged = scratch.save(components(swept.where("a is not null").select("a", "b"), scratch, "cm").toDF("root", "merged"), "merged")
    counts = swept.where("node is not null").select("node", "n")
    named = classes.select("cid", "node").join(roots, "node", "left").join(counts, "node").withColumn("root", F.coalesce("root", "node")).join(merged, "root", "left")
    named = named.select("cid", F.coalesce("merged", "root").alias("root"), (F.col("n") - 1).alias("n_links"))
    out = live.select("vec_id", "cid").join(named, "cid").select("vec_id", "n_links", F.col("root").alias("component_id"))
    return out.unionByName(rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return groups(vectors, Scratch(spark, "op6")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
