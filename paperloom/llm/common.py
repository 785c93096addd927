"""What the operators share: scratch tables on storage all executors see, whole-text
word splitting, files by URI, and row identities.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``: exactly what
``bytes.split()`` yields.  Lower-casing is of ASCII letters only: ``bytes.lower()``.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20  # text whose words are looked at together


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver see: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests on one machine) a temporary folder
    takes its place; on a cluster an unset folder is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("paperloom.scratch", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="paperloom-")
            spark.conf.set("paperloom.scratch", root)
    return root.rstrip("/")


def fresh(name: str, taken) -> str:
    """The name, with as many underscores before it as keep it apart from those taken (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def extended(df: DataFrame, **kinds: str):
    """The schema of a frame with further columns."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*df.schema.fields, *(StructField(n, _parse_datatype_string(k)) for n, k in kinds.items())])


_opened: list[list] = []


@contextlib.contextmanager
def collected():
    """The scratch folders that are opened inside, as a list."""
    _opened.append([])
    try:
        yield _opened[-1]
    finally:
        _opened.pop()


class Scratch:
    """Named tables in the shared folder.  They cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        for held in _opened:
            held.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete the tables named, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.path}/{name}" for name in names] or [self.path]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain path."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def local_path(uri: str) -> str | None:
    """The POSIX path of a URI that can be memory-mapped, else None."""
    fs, path = filesystem(uri)
    return path if fs.type_name == "local" else None


@contextlib.contextmanager
def written_file(uri: str):
    """A stream to a temporary name, moved into place at the end: readers never see half a file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def write_file(uri: str, *buffers) -> None:
    with written_file(uri) as out:
        for b in buffers:
            out.write(b)


def as_text(texts):
    """An Arrow array of bytes as one of strings, unchecked."""
    import pyarrow as pa

    return texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())


def word_slices(texts, lower: bool = True, most: int = SLICE_BYTES, prepare=None):
    """(rows, words, index, offsets) for slices of an Arrow array of text: of the slice's ``rows`` (a
    range), row k's words are ``words[i]`` for i in ``index[offsets[k]:offsets[k + 1]]``.

    ``words`` are distinct, so what is costly is done once a word; a slice holds about ``most`` bytes.
    ``prepare`` changes a slice's texts first; no copy of all texts is made for it.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(texts):
        return
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = as_text(texts)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = np.flatnonzero(np.diff((ends - 1) // most)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
        part = texts.slice(lo, hi - lo)
        part = prepare(part) if prepare else part
        split = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        offsets = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        coded = pc.dictionary_encode(split.flatten())
        index, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string()).view(pa.large_binary()).to_pylist()
        if b"" in words:  # white space at an end of a text leaves an empty word
            some = index != words.index(b"")
            offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
            index = index[some]
        yield range(lo, hi), words, index, offsets


def map_array(uri: str, dtype):
    """The file as an array: memory-mapped where the store has local paths, read otherwise."""
    import numpy as np

    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class BoundedCache(dict):
    """A dict that computes what it lacks, in two generations of ``most`` entries.

    When the young generation is full it becomes the old one; what is asked for again
    moves back, so frequent keys stay while the rare ones of long inputs are forgotten.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: What operators keep in a worker between tasks, by what it is for.
kept: dict[str, dict] = {}


def release(keeps: str | None = None) -> bool:
    """Let go of what other operators left in this worker; whether there was anything."""
    held = [h for name, h in kept.items() if name != keeps and h]
    for h in held:
        h.clear()
    return bool(held)


def trim() -> None:
    """Give the memory that is free in this worker back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most ``BATCH_ROWS`` rows to a Python worker at once.

    A batch lies in the executor twice and in the worker twice, so 10,000 whole texts, Spark's default, are 100 MB
    a task outside the heap.  A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(run, keeps: str | None = None):
    """A batch function that gives its memory back when its task ends.

    Workers serve one operator after another; of what they keep between tasks only ``keeps`` stays.
    """

    def wrapped(batches):
        if release(keeps):
            trim()  # before new memory comes to what was let go
        yield from run(batches)
        trim()

    return wrapped
