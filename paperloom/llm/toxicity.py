"""Operator 8: toxicity by maximum-scoring segments.

Fit (bounded sample of labelled rows): document frequencies of each word and of its
prefixes, by label, give log-odds of toxicity with Dirichlet priors in a chain: a word's
prior is its longest prefix's rate, a prefix's the shorter one's, the shortest's the rate
over all.  A word's score is its log-odds less a drift, so that ordinary text falls.
Scan (every whole text, linear time): all maximal scoring segments.  A segment of score S in
a text of n words has the expected count K n exp(-lambda S) under the clean texts' scores
(extreme-value law); segments expected less than ``SIGNIFICANT`` times are toxic passages.
The document's score is a logistic curve, fitted on the sample, over the summed significant
evidence.

Defined cases: a null or empty text has no segment and scores as one without evidence;
documents without label only get scores; if the sample lacks one class every score is 0
(no toxic row) or 1 (no clean row); rows with null labels are left out of the fit; repeated rows each get a row;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, extended, fresh, id_bucket, text_bytes, tidy, word_slices

SAMPLE_ROWS = 12_000  # expected labelled rows of the fit
PREFIXES = (4, 6)
PRIOR = 8.0
DRIFT = 1.2
SIGNIFICANT = 0.01
CACHE_WORDS = 200_000
TEXT_BYTES = 1 << 20  # text that is looked at together
STRIP = bytes(c for c in range(128) if not chr(c).isalnum())


def units(word: bytes) -> tuple[str, ...]:
    """The word's prefixes, shortest first, then the word itself."""
    w = word.strip(STRIP).lower().decode("utf-8", "replace").lower()
    return (*(f"{w[:k]}*" for k in PREFIXES if len(w) >= k), w) if w else ()


class Odds:
    """The units' log-odds as two arrays: a sixth of a dict's memory, and each worker holds them."""

    def __init__(self, odds: dict[str, float] | None = None):
        import numpy as np
        import pyarrow as pa

        self.units, self.values = pa.array(list(odds or ()), pa.large_string()), np.array(list((odds or {}).values()), float)

    def last(self, groups: list[tuple[str, ...]]):
        """Of each group of units the log-odds of the last one known, 0 without any."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(self.values) or not groups:
            return np.zeros(len(groups))
        at = pc.index_in(pa.array([u for g in groups for u in g], pa.large_string()), value_set=self.units)
        known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[known]
        out = np.zeros(len(groups))
        ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else owner
        out[owner[ends]] = self.values[at.take(pa.array(known[ends])).to_numpy(zero_copy_only=False)] if len(ends) else 0.0
        return out


class WordScores:
    """Scores of words, of frequent ones kept: two generations, the older one going when the younger is full."""

    def __init__(self, model: "Model", most: int):
        self.model, self.most, self.young, self.old = model, most, {}, {}

    def __call__(self, words: list[bytes]) -> list[float]:
        made = [self.young.get(w) for w in words]
        made = [self.old.get(w) if s is None else s for w, s in zip(words, made)]
        lacking = [k for k, s in enumerate(made) if s is None]
        for lo in range(0, len(lacking), 100_000):
            some = lacking[lo : lo + 100_000]
            for k, s in zip(some, self.model.words([words[k] for k in some])):
                made[k] = s
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update(zip(words, made))
        return made


@dataclass
class Model:
    odds: Odds = field(default_factory=Odds)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0
    only: float | None = None  # the score of all, if the sample has one class

    def word(self, word: bytes) -> float:
        return self.words([word])[0]

    def words(self, words: list[bytes]) -> list[float]:
        return (self.odds.last([units(w) for w in words]) - DRIFT).tolist()

    def evidence(self, scores) -> tuple[float, int, float]:
        """Summed significant evidence, significant segments, best segment's score."""
        import numpy as np

        segments = maximal_segments(scores)
        if not segments:
            return 0.0, 0, 0.0
        floor = math.log(self.k * max(1, len(scores))) - math.log(SIGNIFICANT)
        bits = [self.lam * s - floor for _, _, s in segments]
        return float(np.sum([b for b in bits if b > 0])), sum(b > 0 for b in bits), max(s for _, _, s in segments)

    def score(self, evidence: float) -> float:
        if self.only is not None:
            return self.only
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * math.log1p(max(0.0, evidence))))))


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time.

    Runs of one sign are merged first: a maximal segment starts and ends with a positive run.
    """
    import numpy as np

    s = np.asarray(scores, float)
    if not len(s) or not (s > 0).any():
        return []
    sign = s > 0
    edge = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]])
    ends, sums = np.r_[edge[1:], len(s)], np.add.reduceat(s, edge)
    stack: list[list] = []  # [start, end, total before, total after]
    total = 0.0
    for a, b, v in zip(edge.tolist(), ends.tolist(), sums.tolist()):
        before, total = total, total + v
        if v <= 0:
            continue
        seg = [a, b, before, total, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= seg[2]:  # to the nearest one that begins lower
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                break
            seg[0], seg[2] = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
        seg[4] = j
        stack.append(seg)
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def text_scores(texts, scores: WordScores):
    """Each text's word scores; a word that only repeats the one before it adds no evidence."""
    import numpy as np

    for rows, words, index, offsets in word_slices(texts, lower=False, most=TEXT_BYTES):
        s = np.array(scores(words), float)[index]
        again = np.zeros(len(index), bool)
        again[1:] = index[1:] == index[:-1]
        again[offsets[:-1][offsets[:-1] < len(index)]] = False  # a text's first word
        s[again & (s > 0)] = -DRIFT
        for k in range(len(rows)):
            yield s[offsets[k] : offsets[k + 1]]


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int, prior: float = PRIOR) -> dict[str, float]:
    """Shrunk log-odds of each unit; a unit with its parent's odds is left out."""
    rate0 = toxic / (toxic + clean)
    base = math.log(rate0 / (1 - rate0))
    rate: dict[str, float] = {}
    kept: dict[str, float] = {}
    for u in sorted(counts, key=lambda u: (not u.endswith("*"), len(u), u)):
        t, c = counts[u]
        stem = u[:-1] if u.endswith("*") else u
        parents = [f"{stem[:k]}*" for k in reversed(PREFIXES) if (k < len(stem) if u.endswith("*") else k <= len(stem))]
        parent = next((rate[p] for p in parents if p in rate), rate0)
        own = (t + prior * parent) / (t + c + prior)
        if u.endswith("*"):
            rate[u] = own
        if own != parent:
            kept[u] = math.log(own / (1 - own)) - base
    return kept


def extreme_value(clean: list[tuple[float, int]], background: dict[float, float]) -> tuple[float, float]:
    """lambda from sum p(s) exp(lambda s) = 1; K from the clean texts' mean maximum."""
    total = sum(background.values()) + 1
    shares = {s: n / total for s, n in background.items()}
    top = max([1.0, *background])
    shares[top] = shares.get(top, 0) + 1 / total  # one more hit than seen: lambda stays finite
    lo, hi = 1e-3, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if sum(p * math.exp(min(700.0, mid * s)) for s, p in shares.items()) > 1:
            hi = mid
        else:
            lo = mid
    lam = lo
    words = sum(n for _, n in clean) / max(1, len(clean))
    mean = sum(s for s, _ in clean) / max(1, len(clean))
    return lam, min(1.0, max(1e-2, math.exp(lam * mean - 0.5772) / max(1.0, words)))


def logistic(x: list[float], y: list[int]) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve, classes as they come."""
    import numpy as np

    X, Y, w = np.c_[np.array(x), np.ones(len(x))], np.array(y, float), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -50, 50)))
        h = (X * (p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, X.T @ (p - Y) + 1e-2 * w)
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows whose id isn't held out, thinned by a hash to ``sample_rows`` expected."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket(F.col("doc_id"), 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # About sample_rows rows of two numbers, whatever the corpus: small enough to send to every task.
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text")).join(F.broadcast(rows), "id")
    sample = scratch.save(picked.select("y", "text"), "sample")

    def frequencies(batches):
        import pyarrow as pa

        seen = (Counter(), Counter())
        for b in batches:
            for y, data in zip(b.column(0).to_pylist(), b.column(1)):
                seen[y].update({u for w in set(data.as_py().split()) for u in units(w)})
        keys = [u for u in {*seen[0], *seen[1]}]
        for at in range(0, len(keys), 50_000):
            k = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"u": k, "t": [seen[1][x] for x in k], "c": [seen[0][x] for x in k]}, schema=pa.schema([("u", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))

    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Model(only=1.0 if size.get(1) else 0.0)
    table = sample.mapInArrow(tidy(frequencies), "u string, t long, c long").groupBy("u").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # Bounded by the sample.  Clean and neutral units stay: without them a word takes its prefix's score.
    found = table.toArrow()
    odds = log_odds(dict(zip(found["u"].to_pylist(), zip(found["t"].to_pylist(), found["c"].to_pylist()))), size[1], size[0])
    del found
    model = Model(odds=Odds(odds))
    del odds

    def measure(batches):
        import pyarrow as pa

        cache = WordScores(model, CACHE_WORDS)
        for b in batches:
            out = []
            for y, s in zip(b.column(0).to_pylist(), text_scores(b.column(1), cache)):
                out.append((y, len(s), s[s != -DRIFT].tolist(), [[a, e, v] for a, e, v in maximal_segments(s)]))
            yield pa.RecordBatch.from_pydict({"y": [o[0] for o in out], "n": [o[1] for o in out], "odd": [o[2] for o in out], "seg": [[v for _, _, v in o[3]] for o in out]}, schema=pa.schema([("y", pa.int32()), ("n", pa.int64()), ("odd", pa.list_(pa.float64())), ("seg", pa.list_(pa.float64()))]))

    measured = scratch.save(sample.mapInArrow(tidy(measure), "y int, n long, odd array<double>, seg array<double>"), "measured")
    background = {-DRIFT: 1.0}
    for r in measured.where("y = 0").select(F.explode("odd").alias("s")).groupBy(F.round("s", 2).alias("s")).count().collect():
        background[r["s"]] = background.get(r["s"], 0) + r["count"]
    best = measured.select("y", "n", F.coalesce(F.array_max("seg"), F.lit(0.0)).alias("s"), "seg").collect()
    background[-DRIFT] += sum(r["n"] for r in best if r["y"] == 0) - sum(background.values()) + 1
    model.lam, model.k = extreme_value([(r["s"], r["n"]) for r in best if r["y"] == 0], background)
    floor = [math.log(model.k * max(1, r["n"])) - math.log(SIGNIFICANT) for r in best]
    x = [math.log1p(sum(max(0.0, model.lam * s - f) for s in r["seg"])) for r, f in zip(best, floor)]
    model.slope, model.offset = logistic(x, [r["y"] for r in best])
    scratch.drop("sample", "measured")
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str, str] = ("__score", "__segments", "__best")) -> DataFrame:
    """doc_id (or the columns of ``keep``) and, under the names given, score, number of significant
    segments and best segment's score, for every whole text."""
    given = docs.select(*[F.col(f"`{c}`") for c in keep or ["doc_id"]])
    schema = extended(given, **dict(zip(names, ("double", "int", "double"))))
    wide, held = len(given.columns), dict(given.dtypes).get("text") == "string"
    # A text that is kept travels once, not beside a copy of its bytes.
    at = given.columns.index("text") if held else wide

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        cache = WordScores(model, CACHE_WORDS)
        for b in batches:
            found = [model.evidence(s) for s in text_scores(pc.fill_null(b.column(at), "") if held else b.column(at), cache)]
            made = ([model.score(e) for e, _, _ in found], [n for _, n, _ in found], [s for _, _, s in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], *map(pa.array, made, (pa.float64(), pa.int32(), pa.float64()))], names=schema.names)

    return (given if held else docs.select(*[F.col(f"`{c}`") for c in given.columns], text_bytes().alias(fresh("__text", given.columns)))).mapInArrow(tidy(run), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold; columns as given, whatever their names."""
    model = fit(docs, labels, Scratch(docs.sparkSession, "tox"))
    names = tuple(fresh(n, docs.columns) for n in ("__score", "__segments", "__best"))
    return score_documents(docs, model, docs.columns, names).where(F.col(names[0]) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), Scratch(spark, "op8"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__segments").alias("n_segments"), F.col("__best").alias("best_segment"))
