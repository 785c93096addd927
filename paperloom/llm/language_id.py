"""Operator 2: hierarchical language identification.

Features of a whole text: counts of byte trigrams (ASCII lower case), hashed to ``BUCKETS``,
square-rooted and scaled to length one.  Languages fall into families by agglomerating their
mean vectors.  Linear one-versus-one support vector machines choose the family; further ones
separate the languages within it.  Every language that labels a row is learned, on a bounded
sample: about ``PER_LANGUAGE`` rows each, fewer where there are so many languages that the sample
would exceed ``SAMPLE_ROWS``, but always one at least.  Families hold at most twice the square
root of the number of languages, so machines grow with its power of 3/2.

Score: the product of the family's and the language's share of pairwise probabilities.
Defined cases: ``und`` with score 1 for a null text or one without a letter; with no
labelled row at all everything is ``und`` with score 0; repeated rows each get a row; further
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, fresh, id_bucket, text_bytes, tidy

BUCKETS = 4096
PER_LANGUAGE = 400
SAMPLE_ROWS = 16_000  # of the fit; one row a language where there are more languages
CONFIDENCE = 1.2  # a score this many times what chance gives, one over the number of languages, decides


def features(data: bytes):
    import numpy as np

    b = np.frombuffer(b" " + data.lower() + b" ", np.uint8).astype(np.uint32)
    codes = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    v = np.sqrt(np.bincount(codes, minlength=BUCKETS)).astype(np.float32)
    return v / max(1e-9, float(np.linalg.norm(v)))


def has_letter(data: bytes) -> bool:
    lower = data.lower()
    return lower != data.upper() or any(c.isalpha() for c in data.decode("utf-8", "replace"))


def train_svm(X, y, c: float = 10.0, rounds: int = 120):
    """Squared-hinge linear machine by accelerated gradient steps: weights, bias last."""
    import numpy as np

    X = np.c_[X, np.ones(len(X), np.float32)]
    w = z = np.zeros(X.shape[1])
    step, t = 1 / (1 + 2 * c * 2.0), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (X @ z))
        grad = z - 2 * c * X.T @ (y * slack) / len(y)
        new = z - step * grad
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def one_vs_one(X, y, classes: list):
    """(i, j, weights) for each pair of classes; weights scaled so that 1 is a typical margin."""
    import numpy as np

    out = []
    for i in range(len(classes)):
        for j in range(i + 1, len(classes)):
            m = (y == i) | (y == j)
            s = np.where(y[m] == i, 1.0, -1.0)
            w = train_svm(X[m], s)
            margin = float(np.median(np.abs(np.c_[X[m], np.ones(int(m.sum()))] @ w)))
            out.append((i, j, (w / max(margin, 1e-6)).astype(np.float32)))
    return out


def families(centroids, most: int, largest: int | None = None) -> list[list[int]]:
    """Average-linkage agglomeration of class means until ``most`` families remain, or none of at most ``largest`` can be joined."""
    import numpy as np

    n = len(centroids)
    groups = {i: [i] for i in range(n)}
    sim = (centroids @ centroids.T).astype(float)
    sim[np.tril_indices(n)] = -np.inf
    size = np.ones(n)
    while len(groups) > max(1, most):
        open_ = np.where(size[:, None] + size[None] <= (largest or n), sim, -np.inf)
        a, b = (int(i) for i in np.unravel_index(open_.argmax(), sim.shape))
        if open_[a, b] == -np.inf:
            break
        both = np.maximum(sim, sim.T)
        joined = (size[a] * both[a] + size[b] * both[b]) / (size[a] + size[b])
        groups[a] += groups.pop(b)
        size[a] += size[b]
        sim[b], sim[:, b] = -np.inf, -np.inf
        for j in groups:
            if j != a:
                sim[min(a, j), max(a, j)] = joined[j]
    return sorted(sorted(g) for g in groups.values())


@dataclass
class Model:
    langs: list[str]
    groups: list[list[int]]
    top: list
    inner: list[list]

    @staticmethod
    def _shares(v, n: int, machines: list) -> list[float]:
        if n == 1:
            return [1.0]
        p = [0.0] * n
        for i, j, w in machines:
            q = 1 / (1 + math.exp(-max(-40.0, min(40.0, 3.0 * float(v @ w[:-1] + w[-1])))))
            p[i] += q
            p[j] += 1 - q
        return [x * 2 / (n * (n - 1)) * n / 2 for x in p]

    def predict(self, data: bytes, null: bool) -> tuple[str, float]:
        if null or not has_letter(data):
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        v = features(data)
        fam = self._shares(v, len(self.groups), self.top)
        g = max(range(len(fam)), key=fam.__getitem__)
        inner = self._shares(v, len(self.groups[g]), self.inner[g])
        k = max(range(len(inner)), key=inner.__getitem__)
        return self.langs[self.groups[g][k]], max(0.0, min(1.0, fam[g] * inner[k]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    import numpy as np

    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket(F.col("doc_id"), 5) != 0)).select("lang", "text", place.alias("place"))
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()  # a row a language
    if not counts:
        return Model([], [], [], [])
    per_language = max(1, min(per_language, sample_rows // len(counts)))
    most = {r["lang"]: max(r["first"], int((1 << 30) * min(1.0, per_language / r["n"]))) for r in counts}
    limits = F.broadcast(docs.sparkSession.createDataFrame(list(most.items()), "lang string, most long"))
    # Rows that share an id share a place: of a repeated one at most twice the language's rows are taken.
    rows = learn.join(limits, "lang").where("place <= most").drop("most").limit(2 * max(sample_rows, len(counts)))

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(d.as_py()).astype(np.float16).tobytes() for d in b.column(1)], pa.binary())], names=["lang", "v"])

    got = rows.select("lang", text_bytes().alias("text")).mapInArrow(tidy(vectors), "lang string, v binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model([], [], [], [])
    X = np.stack([np.frombuffer(bytes(r["v"]), np.float16) for r in got]).astype(np.float32)
    y = np.array([langs.index(r["lang"]) for r in got])
    means = np.stack([X[y == i].mean(0) for i in range(len(langs))])
    # What all languages share says nothing about kinship.
    centred = means - means.mean(0) * (len(langs) > 2)
    centred /= np.maximum(1e-9, np.linalg.norm(centred, axis=1, keepdims=True))
    groups = families(centred, math.ceil(math.sqrt(len(langs))), max(2, 2 * math.ceil(math.sqrt(len(langs)))))
    family = np.array([next(g for g, m in enumerate(groups) if i in m) for i in range(len(langs))])[y]
    inner = []
    for m in groups:
        own = np.isin(y, m)
        inner.append(one_vs_one(X[own], np.array([m.index(i) for i in y[own]]), m))
    return Model(langs, groups, one_vs_one(X, family, groups), inner)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """doc_id (or the columns of ``keep``) and, under the names given, language and score."""
    given = docs.select(*[F.col(f"`{c}`") for c in keep or ["doc_id"]])
    schema = extended(given, **dict(zip(names, ("string", "double"))))
    wide = len(given.columns)
    text, null = fresh("__text", given.columns), fresh("__null", given.columns)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [model.predict(d.as_py(), n) for d, n in zip(b.column(wide), b.column(wide + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in given.columns], text_bytes().alias(text), F.col("text").isNull().alias(null)).mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, wanted: list[str] | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """The documents in a wanted language (any learned one by default) whose score is at least
    ``confidence`` times chance.  Columns as given, whatever their names.

    A text without a letter goes.  Where no language was learned, every text with a letter stays.
    """
    model = fit(docs)
    lang, score = names = tuple(fresh(n, docs.columns) for n in ("__lang", "__score"))
    found = identify(docs, model, docs.columns, names)
    if model.langs:
        ok = (F.col(lang) != "und") & (F.col(score) * len(model.langs) >= min(confidence, len(model.langs)))
        found = found.where(ok if wanted is None else ok & F.col(lang).isin(*wanted))
    else:
        found = found.where(F.col(score) == 0)  # 'und' has score 1 without a letter
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
