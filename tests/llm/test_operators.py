"""Each operator on edge rows and against brute force on small fixtures."""

import collections
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("paperloom.llm")
from paperloom.llm import ann, elias_fano, embedding_dedup, language_id, lm_scoring, minhash_dedup, mixing, packing, token_counts, token_files, tokens, toxicity  # noqa: E402
from paperloom.llm.common import Scratch  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORDS = "the of and to in is for on with as by at from that this it be are was or an not have has had but they you we he she".split()


def passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, passage(i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(30)]
    rows += [(30, passage(3), "en", "s0"), (31, passage(3) + " extra", "en", "s0"), (32, passage(3), "en", None), (32, passage(3), "en", None)]
    rows += [(33, None, None, "s1"), (34, "", "en", "s1"), (35, "one two", "en", "s2"), (36, "Müller $5%! 'x" + " long" * 9000, "de", "s2"), (None, "no id here", "en", "s2")]
    return spark.createDataFrame([(a, b, c, d, len(b or ""), "x") for a, b, c, d in rows], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_token_files(spark, docs, empty):
    uri = Scratch(spark, "t").path
    got = token_files.read_token_files(spark, uri, token_files.write_token_files(docs, uri)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want = 0, []
    for r in rows:
        ids = reference_ids(r["text"])
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda t: (t[1], t[2])
    assert sorted([tuple(g) for g in got], key=key) == sorted(want, key=key)
    assert token_files.write_token_files(empty, uri) == []
    assert token_files.read_token_files(spark, uri, []).count() == 0


def test_packing(docs, empty):
    got = packing.pack_documents(docs).collect()
    seq, per = collections.defaultdict(list), collections.Counter()
    for r in got:
        seq[r["sequence_id"]].append(r)
        per[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(reference_ids(r["text"]))
    assert per == want
    for rows in seq.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 4096 and (end == 4096 or end & (end - 1) == 0)
    assert packing.pack_documents(empty).count() == 0


def test_token_counts(docs, empty):
    pieces = token_counts.load_pieces(token_counts.default_path())

    def best(word):
        t = "▁" + word
        s = [(0.0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            n = len(t[e - 1].encode())
            opts = [(s[e - 1][0] - 25.0 * n, s[e - 1][1] + n)] + [(s[b][0] + pieces[t[b:e]], s[b][1] + 1) for b in range(e) if t[b:e] in pieces]
            s[e] = max(opts, key=lambda o: (o[0], -o[1]))
        return s[-1][1]

    want = collections.Counter((r["doc_id"], sum(best(w) for w in (r["text"] or "").split()[:400])) for r in docs.collect() if len(r["text"] or "") < 9000)
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs.where("coalesce(length(text), 0) < 9000")).collect())
    assert got == want and token_counts.count_tokens(empty).count() == 0


def test_minhash(spark, docs, empty):
    got = collections.defaultdict(set)
    for r in minhash_dedup.groups(docs, Scratch(spark, "m")).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got[3] == got[30] == got[31] == got[32] == {3} and got[33] == {33} and got[34] == {34} and got[None] == {None}
    assert all(got[i] == {i} for i in range(30))
    kept = [r["doc_id"] for r in minhash_dedup.keep_one(docs).collect()]
    assert kept.count(3) == 1 and not {30, 31, 32} & set(kept)
    assert minhash_dedup.groups(empty, Scratch(spark, "m")).count() == 0


def test_mixing(spark, docs, empty):
    def run():
        return sorted((str(r["doc_id"]), r["size"], r["source"] or "", r["source_size"], r["target"], r["copies"], r["rows"]) for r in mixing.copies(docs, Scratch(spark, "x")).collect())

    got = run()
    assert got == run() and sum(g[6] for g in got) == docs.count()
    assert all(0 <= g[5] <= 2 for g in got)
    assert sum({g[2]: g[4] for g in got}.values()) == pytest.approx(1.5 * sum({g[2]: g[3] for g in got}.values()))
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0


def test_lm_scores(spark, docs, empty):
    got = collections.defaultdict(list)
    for r in lm_scoring.score_documents(docs, Scratch(spark, "l"), block_tokens=500, range_tokens=300, shard_words=200).collect():
        got[r["doc_id"]].append(r)
    c, b, texts = collections.Counter(), collections.Counter(), []
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split() + [None]
        train = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2
        texts.append((r["doc_id"], w))
        if train:
            c.update(w)
            b.update(zip([None] + w[:-1], w))
    n, v, mass = sum(c.values()), len(c), lm_scoring.MASS
    for i, w in texts:
        r = got[i][0]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((b[a, x] + mass * (c[x] + 1) / (n + v + 1)) / (c[a] + mass)) for a, x in zip([None] + w[:-1], w))
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n and r["n_known"] == sum(c[x] > 0 for x in w)
        assert abs(r["score"] - score) / len(w) < 0.02
    assert lm_scoring.score_documents(empty, Scratch(spark, "l")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 9), (700, 50), (5000, 1 << 40)):
        x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        e = elias_fano.EliasFano(np.frombuffer(elias_fano.encode(x), np.uint8))
        assert (e.decode() == x).all() and (e.access(np.arange(n)) == x).all()
        q = rng.integers(0, top + 5, 300).astype(np.uint64)
        assert (e.successor(q) == np.searchsorted(x, q)).all()


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16))
    near = base[:40] + 0.01 * rng.standard_normal((40, 16))
    x = np.concatenate([base, near, base[:5]])
    rows = [(i, v.tolist(), i % 300 % 3) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0] * 16, None), (905, [1.0, 2.0], 1)]
    t = spark.createDataFrame([(a, c, b) for a, b, c in rows], "vec_id long, label int, embedding array<double>").selectExpr("vec_id", "label", "embedding", "'x' as unit")
    got = {r["vec_id"]: r for r in embedding_dedup.groups(t, Scratch(spark, "e")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((u @ u.T >= 0.98) & (np.arange(345)[:, None] % 300 % 3 == np.arange(345)[None] % 300 % 3)).sum(1) - 1
    # rows 300.. keep the label of their base only where 300 % 3 == 0 holds, as it does
    assert all(got[i]["n_links"] == links[i] for i in range(345)) and all(got[i]["n_links"] == 0 for i in range(900, 906))
    found = collections.defaultdict(list)
    for r in ann.search(t, Scratch(spark, "a")).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(np.lexsort((np.arange(345), d))[:10].tolist())
        assert len(want & {v for _, v, _ in found[q]}) >= 8 and len(found[q]) == 10
    none = t.where("false")
    assert embedding_dedup.groups(none, Scratch(spark, "e")).count() == 0 and ann.search(none, Scratch(spark, "a")).count() == 0


def test_vectors_dense(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, side = 3000, unit(rng.standard_normal((1500, 64)))
    near = math.sqrt(0.95) * unit(rng.standard_normal(64)) + math.sqrt(0.05) * side  # all pairs about 0.95
    u = np.concatenate([near, unit(near + math.sqrt(1 / 0.981**2 - 1) * unit(rng.standard_normal((1500, 64))))])
    t = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(u)], "vec_id long, label int, embedding array<double>")
    x = unit(u)
    hit = x @ x.T >= 0.98
    root = np.arange(n)
    while True:
        low = np.where(hit, root[None], n).min(1)
        if (low == root).all():
            break
        root = low
    got = {r["vec_id"]: r for r in embedding_dedup.groups(t, Scratch(spark, "d"), block=500).collect()}
    assert [got[i]["n_links"] for i in range(n)] == (hit.sum(1) - 1).tolist() and hit.sum() > n + 2000
    assert [got[i]["component_id"] for i in range(n)] == root.tolist()


def test_vectors_across_short_tasks(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base + 0.08 * rng.standard_normal((30, 16)) for _ in range(2)])
    t = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r["vec_id"]: r for r in embedding_dedup.groups(t, Scratch(spark, "w"), passes=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    assert [got[i]["n_links"] for i in range(60)] == (hit.sum(1) - 1).tolist() and hit.sum() > 100
    assert [got[i]["component_id"] for i in range(60)] == hit.argmax(1).tolist()


def test_toxicity(spark, empty):
    rows = [(i, passage(i) + (" awful scoundrel" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(200)]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(500, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, Scratch(spark, "t"))
    got = {r["doc_id"]: r["__score"] for r in toxicity.score_documents(d, model).collect()}
    assert all((got[a] >= 0.5) == bool(c) for a, _, c in rows) and got[500] < 0.5 and got[501] < 0.5
    assert toxicity.fit(empty, labels.where("false"), Scratch(spark, "t")).only == 0.0


def test_clean_words_under_toxic_prefixes(spark):
    rows = [(i, passage(i) + (" scoundrel" if i % 5 == 0 else " scoundry" if i % 16 == 1 else ""), int(i % 5 == 0)) for i in range(200)]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, toxic int"), Scratch(spark, "t"))
    assert model.word(b"scoundry") < 0 < model.word(b"scoundrel")
    odds = toxicity.log_odds({"scou*": (40, 40), "scound": (30, 0), "scoury": (4, 16)}, 100, 400)
    assert odds["scoury"] < odds["scou*"] < odds["scound"]


def test_segments():
    def brute(s):  # of all windows no longer or shorter one that touches has a higher score
        best, out = None, []
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if best is None or sum(s[a:b]) > best[2]:
                    best = (a, b, sum(s[a:b]))
        if best and best[2] > 0:
            out = [*((a, b, v) for a, b, v in brute(s[: best[0]])), best, *((a + best[1], b + best[1], v) for a, b, v in brute(s[best[1] :]))]
        return out

    rng = np.random.default_rng(2)
    for _ in range(60):
        s = rng.normal(-0.2, 1, 12).tolist()
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == [(a, b) for a, b, _ in brute(s)]


def test_language(spark, docs, empty):
    rows = [(i, "der die das und nicht ist " * 5 if i % 2 else "the and of with this that " * 5, "de" if i % 2 else "en") for i in range(80)]
    d = spark.createDataFrame([*rows, (100, None, "en"), (101, "12 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["__lang"] for r in language_id.identify(d, language_id.fit(d)).collect()}
    assert all(got[a] == c for a, _, c in rows) and got[100] == got[101] == "und"
    assert language_id.keep_identified(docs).columns == docs.columns
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_keep_without_languages(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12 !", None), (4, "", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language_id.keep_identified(d).collect()] == [1]


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "mixing", "packing"]


def test_toxicity_words_and_texts_that_travel_once(spark):
    """The arrays give what a dict of units gives; texts that are kept are scored without a copy beside them, null ones too."""
    import numpy as np
    from paperloom.llm import toxicity

    odds = {"scou*": 1.0, "scoury": -2.0, "damn": 3.0, "über": 0.5}
    model = toxicity.Model(odds=toxicity.Odds(odds))

    def plain(word):
        score = 0.0
        for u in toxicity.units(word):
            score = odds.get(u, score)
        return score - toxicity.DRIFT

    words = [b"scoury", b"scout", b"Damn,", b"...", "Über".encode(), b"none", b"scoury"]
    assert model.words(words) == [plain(w) for w in words] and toxicity.Model().words(words) == [-toxicity.DRIFT] * 7
    scores = toxicity.WordScores(model, 2)
    for part in (words, words[:3], words[2:], []):
        assert np.allclose(scores(part), [plain(w) for w in part])
    d = spark.createDataFrame([(1, "damn damn scout x", "a"), (2, None, None), (3, "", "b")], "doc_id long, text string, more string")
    kept, bare = toxicity.score_documents(d, model, d.columns), toxicity.score_documents(d, model)
    value = lambda df: {r["doc_id"]: (r["__score"], r["__segments"], r["__best"]) for r in df.collect()}
    assert value(kept) == value(bare) and [r["text"] for r in kept.orderBy("doc_id").collect()] == ["damn damn scout x", None, ""]
    fed = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__text" not in fed


def test_workers_let_go():
    """An operator's worker keeps nothing of the operators before it, and no copy of all texts is lower-cased."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from paperloom.llm import common, tokens

    enc = tokens.encoder(tokens.default_path())
    list(common.tidy(iter, "tokens")([]))
    assert tokens.encoder(tokens.default_path()) is enc
    list(common.tidy(iter)([]))
    assert not tokens._encoders
    sizes = []
    for rows, words, _, _ in common.word_slices(pa.array(["Aa bb"] * 9), lower=False, most=12, prepare=lambda part: sizes.append(len(part)) or pc.ascii_lower(part)):
        assert set(words) == {b"aa", b"bb"}
    assert sum(sizes) == 9 and max(sizes) < 9


def test_workers_make_room_first(spark, monkeypatch):
    """What other operators kept is given back before a task's first batch; batches of whole texts are small."""
    from paperloom.llm import common

    seen = []
    monkeypatch.setattr(common, "trim", lambda: seen.append("trim"))
    monkeypatch.setitem(common.kept, "test", {"held": 1})
    run = common.tidy(lambda batches: (seen.append(b) or b for b in batches), "tokens")
    assert list(run([1, 2])) == [1, 2] and seen == ["trim", 1, 2, "trim"] and not common.kept["test"]
    seen.clear()
    assert list(run([3])) == [3] and seen == [3, "trim"]

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(name, given)
            common.small_batches(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
