"""Operator 7: token ids as flat unsigned integer files with 64-bit document offsets.

``write_token_files`` range-partitions documents by id, encodes each partition in id order
and writes, per partition, ``*.bin`` (ids, the narrowest unsigned integer that holds the
vocabulary), ``*.idx`` (64-bit offsets, one more than documents, from the partition's start)
and ``*.ids`` (64-bit document ids) with ``*.nul`` (1 where the id is null).  One small row a
partition comes back; prefix sums over these rows give each partition's base.
``read_token_files`` memory-maps the files and returns digests from them.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with
equal ids are ordered by a hash of their text, repeated rows appear as often as they are given; an empty
table gives no parts; further columns are ignored.  A retried task writes under a new name and only names
reported by successful tasks are read.
"""

from __future__ import annotations

import contextlib
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_array, text_bytes, tidy, write_file, written_file
from .tokens import END_ID, default_path, encoder


@dataclass(frozen=True)
class Part:
    """One partition's files; ``base`` counts the ids of all partitions before it."""

    name: str
    docs: int
    ids: int
    base: int
    width: int


def write_token_files(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[Part]:
    tokenizer = tokenizer or default_path()

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(tokenizer, end_id)
        dtype = "<u2" if enc.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        counts, ids, nulls = [], [], []
        with contextlib.ExitStack() as files:
            out = None
            for b in batches:
                ids.append(b.column(0).fill_null(0).to_numpy())
                nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
                for _, flat, offsets in enc.slices(b.column(1)):
                    # Ids go to the file as they are made: a task holds one slice of them.
                    out = out or files.enter_context(written_file(f"{uri}/{name}.bin"))
                    out.write(flat.astype(dtype).tobytes())
                    counts.append(np.diff(offsets))
        if counts:
            ends = np.cumsum(np.concatenate([[0], *counts]))
            write_file(f"{uri}/{name}.idx", ends.astype("<i8").tobytes())
            write_file(f"{uri}/{name}.ids", np.concatenate(ids).astype("<i8").tobytes())
            write_file(f"{uri}/{name}.nul", np.concatenate(nulls).astype("u1").tobytes())
            yield pa.RecordBatch.from_pydict({"pid": [task.partitionId()], "name": [name], "docs": [len(ends) - 1], "ids": [int(ends[-1])], "width": [int(dtype[-1])]})

    # Rows of one id are dealt by their text's hash, equal rows by their place, so that no id fills one task.
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    key = ("doc_id", "hash", "place")
    ordered = given.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    # One row a partition, never a row a document.
    rows = sorted(ordered.mapInArrow(tidy(write, "tokens"), "pid long, name string, docs long, ids long, width long").collect())
    parts, base = [], 0
    for r in rows:
        parts.append(Part(r["name"], r["docs"], r["ids"], base, r["width"]))
        base += r["ids"]
    return parts


def read_token_files(spark: SparkSession, uri: str, parts: list[Part]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for p in frame.itertuples(index=False):
                flat = map_array(f"{uri}/{p.name}.bin", f"<u{p.width}")
                at = np.array(map_array(f"{uri}/{p.name}.idx", "<i8"))
                ids, nul = map_array(f"{uri}/{p.name}.ids", "<i8"), map_array(f"{uri}/{p.name}.nul", "u1")
                for lo in range(0, len(ids), 50_000):
                    hi = min(len(ids), lo + 50_000)
                    crc = [zlib.crc32(flat[at[k] : at[k + 1]].astype("<u4").tobytes()) for k in range(lo, hi)]
                    doc = pd.array(np.array(ids[lo:hi]), dtype="Int64")
                    doc[np.array(nul[lo:hi], bool)] = pd.NA
                    yield pd.DataFrame({"doc_id": doc, "start": p.base + at[lo:hi], "n_tokens": np.diff(at[lo : hi + 1]), "ids_crc32": np.array(crc, np.int64)})

    rows = spark.createDataFrame([(p.name, p.base, p.width) for p in parts], "name string, base long, width int")
    return rows.repartition(max(1, len(parts)), "name").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = Scratch(spark, "tokens").path
    parts = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    return read_token_files(spark, uri, parts)
