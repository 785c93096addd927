"""Operator 10: cost-balanced packing into fixed-length sequences.

A piece of n tokens costs ``n + n * n / QUADRATIC`` (linear work plus attention within the
piece).  Each task packs its own documents in rounds of bounded size, without a shuffle.
A round's sequences have a total capacity equal to the round's tokens: full sequences, and
for the remainder one sequence for each binary digit, which need no padding.  Pieces go, largest
first, to the lowest-cost sequence with room for them; when none has room, the piece is cut
at the roomiest sequence's capacity and the rest queues again.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often
as they are given; null ids are kept; an empty table gives no rows; further columns are ignored.  ``sequence_id`` is the task's
partition in the upper bits and a running number in the lower 40; a retried task repeats it.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes, tidy
from .tokens import END_ID, default_path, encoder

CAPACITY = 4096
ROUND_TOKENS = 256 * CAPACITY
QUADRATIC = 4096.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the binary digits of what is left over."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence ends full."""
    import numpy as np

    room = np.array(capacities(sum(lengths), capacity), np.int64)
    used = np.zeros(len(room), np.int64)
    cost = np.zeros(len(room))
    queue = []
    for k, n in enumerate(lengths):
        queue += [(-min(capacity, n - at), k, at) for at in range(0, n, capacity)]
    heapq.heapify(queue)
    pieces = []
    while queue:
        n, k, at = heapq.heappop(queue)
        n = -n
        open_to = np.where(room >= n, cost, np.inf)
        best = int(open_to.argmin())
        if open_to[best] == np.inf:  # none has room: cut
            best = int(room.argmax())
            cut = int(room[best])
            heapq.heappush(queue, (cut - n, k, at + cut))
            n = cut
        pieces.append((k, at, n, best, int(used[best])))
        used[best] += n
        room[best] -= n
        cost[best] += n + n * n / quadratic
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, round_tokens: int = ROUND_TOKENS) -> DataFrame:
    tokenizer = tokenizer or default_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer, end_id)
        first = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        tokens = 0

        def close():
            nonlocal first, held, tokens
            sizes = [len(d) for _, d, _, _ in held]
            out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for k, at, n, seq, off in pack(sizes, capacity):
                doc_id, data, before, whole = held[k]
                for c, v in zip(out, (doc_id, before + at, n, zlib.crc32(data[at : at + n]), whole, first + seq, off)):
                    out[c].append(v)
            first += len(capacities(sum(sizes), capacity))
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

        for b in batches:
            keys = b.column(0).to_pylist()
            for rows, flat, offsets in enc.slices(b.column(1)):
                for k, lo, hi in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist()):
                    whole, at = hi - lo, 0
                    while at < whole:  # a document longer than a round goes through several
                        n = min(whole - at, round_tokens - tokens)
                        held.append((keys[k], flat[lo + at : lo + at + n], at, whole))
                        tokens, at = tokens + n, at + n
                        if tokens >= round_tokens:
                            yield close()
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tidy(run, "tokens"), SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
