"""Operator 1: language-model scores from an Elias-Fano n-gram trie.

The model: bigrams smoothed with ``MASS`` pseudo-counts of the unigram law (Dirichlet prior),
unigrams with one; a text starts in the context of the end token.  The trie's first level is the
words: their training counts as the differences of a monotone Elias-Fano sequence, their smoothed
probabilities as 16-bit codes.  The second level is the successors of contexts: a context's
successors form a range of one sequence, each range continuing from the last value of the
range before it, so the level is monotone, and a bigram is found by successor search relative
to its context's range.  Contexts and their pointers are monotone sequences too; a bigram's
probability is one of 256 codes.  Levels are files, split by key, written to the shared
folder and memory-mapped by the task that answers for them.

How it is built, with nothing that grows with the corpus on the driver but one row a file:
1. tasks cut the texts into blocks of bounded size, with a dictionary of their own;
2. dictionaries meet by word hash (each word once a block): training counts and word ids;
3. a block sends its distinct known bigrams, with training counts, to the ranges of keys that hold
   them; ranges are bounded by training counts (a hot context is cut by successor);
4. a range merges the counts into its part of the trie, looks every block's bigrams up in it and sends
   the codes back, so that no task opens files of another range;
5. blocks add up their documents' scores; what the trie lacks backs off by the context's count.
Base score, known tokens and training tokens come from the exact counts of step 2.

Defined cases: a null or empty text is the end token alone; rows with a null id are training
rows; repeated rows count and score as often as they are given; an empty table gives no rows;
further columns are ignored; more than 2 ** 32 - 2 distinct words are an error.
"""

from __future__ import annotations

import io
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, id_bucket, map_array, text_bytes, tidy, word_slices, write_file
from .elias_fano import EliasFano, encode

BLOCK_TOKENS = 1_500_000
SHARD_WORDS = 1_000_000
RANGE_TOKENS = 2_000_000
MASS = 64.0
UNKNOWN = 0xFFFFFFFF
END = 0x5BD1E995_27D4EB2F  # the end token's hash
STEP = 1 / 4096  # of a 16-bit code, in log10
ABSENT = 0xFFFF


class _Ids(dict):
    def __missing__(self, key):
        v = self[key] = len(self)
        return v


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(uri: str):
    return np.load(io.BytesIO(np.asarray(map_array(uri, "u1")).tobytes()))


def _squash(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unsquash(data, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), dtype)


def _three(ids: np.ndarray) -> bytes:
    """Ids below 2 ** 24 in three bytes each."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _from_three(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.asarray(data).reshape(-1, 3)
    return out.view("<u4").ravel()


def _squeeze(values: np.ndarray) -> bytes:
    """A sorted array's differences, one plane a byte, compressed."""
    import zstandard

    v = np.asarray(values, np.uint64)
    planes = np.diff(v, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def cut_blocks(docs: DataFrame, uri: str, modulus: int, held: int, block_tokens: int) -> DataFrame:
    """Write each block's ids and document table; return (block, hashes, counts): its dictionary."""

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        rows, tokens, ids = [], 0, _Ids()

        def close():
            nonlocal block, rows, tokens, ids
            flat = np.concatenate([r[2] for r in rows])
            lens = np.array([len(r[2]) for r in rows], np.int64)
            train = np.array([r[1] for r in rows], bool)
            counts = np.bincount(flat[np.repeat(train, lens)], minlength=len(ids))
            hashes = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
            wide = len(ids) >= 1 << 24
            write_file(f"{uri}/block-{block}.ids", _squash(flat.astype("<u4") if wide else np.frombuffer(_three(flat), "u1")))
            write_file(f"{uri}/block-{block}.docs", _pack(ids=np.array([r[0] or 0 for r in rows], np.int64), null=np.array([r[0] is None for r in rows]), train=train, lens=lens, wide=np.array(wide)))
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([hashes.tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["block", "words", "hashes", "counts"])
            block, rows, tokens, ids = block + 1, [], 0, _Ids()
            return out

        for b in batches:
            keys, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for span, words, index, offsets in word_slices(b.column(2), most=min(SLICE_BYTES, 8 * block_tokens)):
                own = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))[index]
                end = np.array([ids[None]], np.uint32)
                rows += [(keys[k], marks[k], np.append(own[lo:hi], end)) for k, lo, hi in zip(span, offsets[:-1], offsets[1:])]
                tokens += len(own) + len(span)
                if tokens >= block_tokens:
                    yield close()
        if rows:
            yield close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(F.col("doc_id"), modulus) != held).alias("train"), text_bytes().alias("text"))
    return source.mapInArrow(tidy(run), "block long, words long, hashes binary, counts binary")


def number_words(dictionaries: DataFrame, uri: str, shards: int, range_tokens: int) -> DataFrame:
    """(block, shard, pos, rel, count): each block's words in the shard; block -1 sums the shard up.

    Writes the shard's training counts in the order of its words' ids.
    """

    def spread(batches):
        import pyarrow as pa

        for b in batches:
            for block, h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, "<i8")
                own = (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                order = np.argsort(own, kind="stable")
                edge = np.searchsorted(own[order], np.arange(shards + 1))
                got = [(s, order[edge[s] : edge[s + 1]]) for s in range(shards) if edge[s] < edge[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([block] * len(got), pa.int64()), *(pa.array([v[i].tobytes() for _, i in got], pa.binary()) for v in (np.arange(len(h), dtype="<u4"), h, c))], names=["shard", "block", "pos", "hashes", "counts"])

    def merge(frame):
        import pandas as pd

        shard = int(frame["shard"].iloc[0])
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["hashes"]])
        c = np.concatenate([np.frombuffer(x, "<i8") for x in frame["counts"]])
        words, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, c, len(words)).astype(np.int64)
        rel = np.where(total > 0, np.cumsum(total > 0) - 1, UNKNOWN)
        known = total[total > 0]
        write_file(f"{uri}/words-{shard}.sums", encode(np.concatenate([[0], np.cumsum(known)]).astype(np.uint64)))
        write_file(f"{uri}/words-{shard}.codes", np.round(np.log10(known + 1.0) / STEP).astype("<u2").tobytes())
        # Cut where the training counts add up to a range; a hot word gets cuts among its successors.
        cuts = [(0, 0.0)]
        cum = np.cumsum(known) // range_tokens
        cuts += [(int(k), 0.0) for k in np.flatnonzero(np.diff(cum)) + 1]
        for k in np.flatnonzero(known > range_tokens).tolist():
            cuts += [(k, j / n) for n in [int(-(-known[k] // range_tokens))] for j in range(n)] + [(k + 1, 0.0)]
        cuts = sorted({c for c in cuts if c[0] < max(1, len(known))})
        rows, lo = [], 0
        for block, pos in zip(frame["block"], frame["pos"]):
            hi = lo + len(pos) // 4
            rows.append((int(block), shard, pos, rel[at[lo:hi]].astype("<u4").tobytes(), total[at[lo:hi]].astype("<i8").tobytes(), 0, 0, [], []))
            lo = hi
        mine = np.flatnonzero(words == np.uint64(END))
        end = int(rel[mine[0]]) if len(mine) else -1
        rows.append((-1, shard, b"", b"", np.array([end], "<i8").tobytes(), len(known), int(known.sum()), [k for k, _ in cuts], [f for _, f in cuts]))
        return pd.DataFrame(rows, columns=["block", "shard", "pos", "rel", "count", "known", "tokens", "cut", "share"])

    spread_out = dictionaries.select("block", "hashes", "counts").mapInArrow(tidy(spread), "shard long, block long, pos binary, hashes binary, counts binary")
    return spread_out.groupBy("shard").applyInPandas(merge, "block long, shard long, pos binary, rel binary, count binary, known long, tokens long, cut array<long>, share array<double>")


class Words:
    """Level one over the shards' memory-mapped files: training counts and codes by word id."""

    def __init__(self, uri: str, bases: list[int]):
        self.uri, self.bases = uri, np.array(bases, np.int64)
        self.sums: dict[int, EliasFano] = {}
        self.codes: dict[int, np.ndarray] = {}

    def _shards(self, ids: np.ndarray):
        own = np.searchsorted(self.bases, ids, "right") - 1
        for s in np.unique(own).tolist():
            m = own == s
            yield s, m, ids[m] - self.bases[s]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, m, at in self._shards(ids):
            if s not in self.sums:
                self.sums[s] = EliasFano(map_array(f"{self.uri}/words-{s}.sums", "u1"))
            out[m] = (self.sums[s].access(at + 1) - self.sums[s].access(at)).astype(np.int64)
        return out

    def log_counts(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the counts and one, from the codes."""
        out = np.zeros(len(ids))
        for s, m, at in self._shards(ids):
            if s not in self.codes:
                self.codes[s] = map_array(f"{self.uri}/words-{s}.codes", "<u2")
            out[m] = self.codes[s][at] * STEP
        return out


def read_ids(uri: str, block: int, wide: bool) -> np.ndarray:
    raw = _unsquash(map_array(f"{uri}/block-{block}.ids", "u1"), "u1")
    return raw.view("<u4") if wide else _from_three(raw)


def bigram_keys(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """context << 32 | word for each token; the end token is the context of a text's first."""
    context = np.concatenate([[0], ids[:-1]]).astype(np.uint64)
    context[first] = end
    return (context << np.uint64(32)) | ids.astype(np.uint64)


def _known(keys: np.ndarray) -> np.ndarray:
    """Which sorted distinct keys have a known context and a known word."""
    return ((keys >> np.uint64(32)) != UNKNOWN) & ((keys & np.uint64(UNKNOWN)) != UNKNOWN)


def count_bigrams(answers: DataFrame, uri: str, bases: list[int], keys: np.ndarray, end: int, tokens: int) -> DataFrame:
    """Write each block's word ids and base scores; return its known bigrams, with training counts, by range of keys."""
    size = bases[-1]
    starts = np.array(bases, np.int64)

    def run(frame):
        import pandas as pd

        block = int(frame["block"].iloc[0])
        n = sum(len(p) // 4 for p in frame["pos"])
        ids, known = np.full(n, UNKNOWN, np.uint32), np.zeros(n, np.int64)
        for shard, pos, rel, count in zip(frame["shard"], frame["pos"], frame["rel"], frame["count"]):
            p, r = np.frombuffer(pos, "<u4"), np.frombuffer(rel, "<u4")
            ids[p] = np.where(r == UNKNOWN, UNKNOWN, r + starts[shard]).astype(np.uint32)
            known[p] = np.frombuffer(count, "<i8")
        docs = _load(f"{uri}/block-{block}.docs")
        local = read_ids(uri, block, bool(docs["wide"]))
        lens, first = docs["lens"], np.concatenate([[0], np.cumsum(docs["lens"])[:-1]])
        log = np.log10((known + 1.0) / (tokens + size + 1.0))
        base = np.add.reduceat(log[local], first)
        n_known = np.add.reduceat((known > 0)[local].astype(np.int64), first)
        write_file(f"{uri}/block-{block}.words", _pack(ids=np.frombuffer(_squash(ids), "u1"), known=np.frombuffer(_squash(known), "u1"), base=base, n_known=n_known))
        got, at = np.unique(bigram_keys(ids[local], first, end), return_inverse=True)
        c = np.bincount(at[np.repeat(docs["train"], lens)], minlength=len(got))
        some = _known(got)
        got, c = got[some], c[some]
        edge = np.append(np.searchsorted(got, keys), len(got))
        rows = [(g, block, _squeeze(got[edge[g] : edge[g + 1]]), _squash(c[edge[g] : edge[g + 1]].astype("<u4"))) for g in np.flatnonzero(np.diff(edge)).tolist()]
        return pd.DataFrame(rows, columns=["g", "block", "keys", "counts"])

    return answers.where("block >= 0").select("block", "shard", "pos", "rel", "count").groupBy("block").applyInPandas(run, "g long, block long, keys binary, counts binary")


class Range:
    """One file set of level two."""

    def __init__(self, uri: str, g: int):
        self.contexts, self.pointers, self.successors = (EliasFano(map_array(f"{uri}/range-{g}.{part}", "u1")) for part in ("contexts", "pointers", "successors"))
        raw = map_array(f"{uri}/range-{g}.codes", "u1")
        self.book, self.codes = np.array(raw[:2048]).view("<f8"), raw[2048:]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """16-bit codes of the sorted keys' probabilities, ABSENT where the trie lacks them."""
        context, word = keys >> np.uint64(32), keys & np.uint64(UNKNOWN)
        out = np.full(len(keys), ABSENT, np.uint16)
        # Contexts repeat in sorted keys: their ranges are fetched once.
        own, at = np.unique(context, return_inverse=True)
        c = self.contexts.successor(own)
        has = c < self.contexts.n
        has[has] = self.contexts.access(c[has]) == own[has]
        c = np.where(has, c, 0)
        lo, hi = self.pointers.access(c).astype(np.int64), self.pointers.access(c + 1).astype(np.int64)
        base = np.where(lo > 0, self.successors.access(np.maximum(lo - 1, 0)), np.uint64(0))
        m = np.flatnonzero(has[at])
        want = base[at[m]] + word[m] + np.uint64(1)
        i = self.successors.successor(want)
        ok = (i >= lo[at[m]]) & (i < hi[at[m]])
        ok[ok] = self.successors.access(i[ok]) == want[ok]
        out[m[ok]] = np.minimum(np.round(-self.book[self.codes[i[ok]]] / STEP), ABSENT - 1).astype(np.uint16)
        return out


def write_range(uri: str, g: int, k: np.ndarray, c: np.ndarray, words: Words, tokens: int, mass: float) -> None:
    """The trie's files of sorted distinct bigram keys and their counts."""
    context, word = (k >> np.uint64(32)).astype(np.int64), k & np.uint64(UNKNOWN)
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    edge = np.append(begin, len(k))
    # Each context's range continues from the last value of the range before.
    base = np.concatenate([[0], np.cumsum(word[edge[1:] - 1] + np.uint64(1))[:-1]]).astype(np.uint64)
    values = word + np.uint64(1) + np.repeat(base, np.diff(edge))
    total = np.repeat(words.counts(context[begin]), np.diff(edge))
    low = 10.0 ** words.log_counts(word.astype(np.int64)) / (tokens + words.bases[-1] + 1.0)
    p = np.log10((c + mass * low) / (total + mass))
    step = np.unique(np.quantile(p, np.linspace(0, 1, 257)))
    own = np.clip(np.searchsorted(step, p, "right") - 1, 0, 255)
    n = np.maximum(1, np.bincount(own, minlength=256))
    write_file(f"{uri}/range-{g}.contexts", encode(context[begin].astype(np.uint64)))
    write_file(f"{uri}/range-{g}.pointers", encode(edge.astype(np.uint64)))
    write_file(f"{uri}/range-{g}.successors", encode(values))
    write_file(f"{uri}/range-{g}.codes", (np.bincount(own, p, 256) / n).astype("<f8").tobytes(), own.astype(np.uint8).tobytes())


def answer_ranges(grams: DataFrame, uri: str, bases: list[int], tokens: int, mass: float) -> DataFrame:
    """Merge each range's bigrams into its trie files, and answer every block from them: (block, g, codes)."""

    def run(frame):
        import pandas as pd

        g = int(frame["g"].iloc[0])
        asked = [_expand(x) for x in frame["keys"]]
        k, at = np.unique(np.concatenate(asked), return_inverse=True)
        c = np.bincount(at, np.concatenate([_unsquash(x, "<u4") for x in frame["counts"]]), len(k)).astype(np.int64)
        seen = c > 0
        if not seen.any():  # known words that never met in training
            return pd.DataFrame([(int(b), g, _squash(np.full(len(a), ABSENT, "<u2"))) for b, a in zip(frame["block"], asked)], columns=["block", "g", "codes"])
        write_range(uri, g, k[seen], c[seen], Words(uri, bases), tokens, mass)
        part = Range(uri, g)
        return pd.DataFrame([(int(b), g, _squash(part.look_up(a).astype("<u2"))) for b, a in zip(frame["block"], asked)], columns=["block", "g", "codes"])

    return grams.groupBy("g").applyInPandas(run, "block long, g long, codes binary")


def add_up(answers: DataFrame, blocks: DataFrame, uri: str, size: int, end: int, end_count: int, tokens: int, mass: float) -> DataFrame:
    """The scores of each block's documents."""

    def run(frame):
        import pandas as pd

        block = int(frame["block"].iloc[0])
        docs, own = _load(f"{uri}/block-{block}.docs"), _load(f"{uri}/block-{block}.words")
        ids, known = _unsquash(own["ids"], "<u4"), _unsquash(own["known"], "<i8")
        local, lens = read_ids(uri, block, bool(docs["wide"])), docs["lens"]
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        key, at = np.unique(bigram_keys(ids[local], first, end), return_inverse=True)
        some = _known(key)
        code = np.full(len(key), ABSENT, np.uint16)
        told = frame[frame["g"] >= 0].sort_values("g")["codes"]
        if len(told):
            code[some] = np.concatenate([_unsquash(x, "<u2") for x in told])
        # What the trie lacks: the word's own law, weighed by the context's count.
        low = np.round(np.log10(known + 1.0) / STEP) * STEP - np.log10(tokens + size + 1.0)
        context = np.append(0, known[local[:-1]])
        context[first] = end_count
        back = np.log10(mass / (context + mass)) + low[local]
        got = code[at]
        score = np.add.reduceat(np.where(got == ABSENT, back, got * -STEP), first)
        doc_id = pd.array(docs["ids"], dtype="Int64")
        doc_id[docs["null"]] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "held_out": ~docs["train"], "n_tokens": lens, "n_known": own["n_known"], "train_tokens": tokens, "base_score": own["base"], "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    every = answers.unionByName(blocks.select("block", F.lit(-1).cast("long").alias("g"), F.lit(None).cast("binary").alias("codes")))
    return every.groupBy("block").applyInPandas(run, schema)


def score_documents(docs: DataFrame, scratch: Scratch, modulus: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, shard_words: int = SHARD_WORDS, range_tokens: int = RANGE_TOKENS, mass: float = MASS) -> DataFrame:
    """Fit on the rows whose id's crc32 modulo ``modulus`` is not ``held``; score all rows."""
    spark, uri = docs.sparkSession, f"{scratch.path}/trie"
    dictionaries = scratch.save(cut_blocks(docs, uri, modulus, held, block_tokens), "dictionaries")
    size = dictionaries.agg(F.sum("words"), F.count(F.lit(1))).first()
    if not size[1]:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    shards = max(1, math.ceil(size[0] / shard_words))
    answers = scratch.save(number_words(dictionaries, uri, shards, range_tokens), "answers")
    blocks = scratch.save(dictionaries.select("block"), "blocks")
    scratch.drop("dictionaries")
    sums = {r["shard"]: r for r in answers.where("block < 0").select("shard", "known", "tokens", "cut", "share", "count").collect()}
    bases, tokens, cuts, end = [0], 0, [], -1
    for s in range(shards):
        r = sums.get(s)
        if r is not None:
            tokens += r["tokens"]
            cuts += [(bases[-1] + k, f) for k, f in zip(r["cut"], r["share"])]
            e = int(np.frombuffer(bytes(r["count"]), "<i8")[0])
            end = bases[-1] + e if e >= 0 and e != UNKNOWN else end
        bases.append(bases[-1] + (r["known"] if r else 0))
    if bases[-1] >= UNKNOWN:
        raise OverflowError(f"{bases[-1]} distinct words: ids hold {UNKNOWN - 1}")
    end_count = int(Words(uri, bases).counts(np.array([end]))[0]) if end >= 0 else 0
    end = end if end >= 0 else UNKNOWN  # no training text
    keys = np.unique(np.array([0, *((k << 32) + int(f * bases[-1]) for k, f in cuts)], np.uint64))
    grams = count_bigrams(answers, uri, bases, keys, end, tokens)
    told = scratch.save(answer_ranges(grams, uri, bases, tokens, mass), "told")
    scratch.drop("answers")
    return add_up(told, blocks, uri, bases[-1], end, end_count, tokens, mass)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark, "op1"))
