from paperloom.operators import chain

LINES = [
    ("The Formulas", 16.0), ("Peter Szabo\nDepartment of Mathematics, Slovak Republic\nTechnical University\npeter.szabo@tuke.sk", 10.0), ("Abstract", 10.0),
    ("What is said here in short is said again below, at more length than this.", 10.0), ("Keywords: formulas; numbers.", 10.0), ("1. Introduction", 12.0),
    ("The Formulas\n3.\nThe value α of 3 . 14 is known to all & sundry.", 10.0), ("Another paragraph with a_b in it.", 10.0), ("2. Results", 12.0), ("As the table shows.", 10.0),
    ("Table 1. RMSE of all regression models\nSkillcraft SML Parkinsons\nMAML 1 . 26 0 . 5 0 . 7\nFed Avg\n2 . 26 1 . 5 1 . 7", 10.0), ("3. Conclusion", 12.0), ("It ends here. References", 10.0),
    ("[1] Butkovic, P.: Max-linear systems: theory\nand algorithms, Springer\n[2] Szabo, P.: An iterative algorithm for it", 10.0),
]


def paper(spark, sizes=True):
    rows = [(1, i, 0, i * 14.0, t, s if sizes else 0.0) for i, (t, s) in enumerate(LINES)] + [(2, 0, 0, 0.0, "Nothing but a line of text", 10.0 if sizes else 0.0)]
    return spark.createDataFrame(rows, "doc_id long, block_idx int, page int, y double, text string, size double")


def formulas(spark):
    rows = [(1, 0, 0, 90.0, "x=1", "", 0.9, False), (1, 1, 0, 128.0, "bad", "eq.png", 0.2, True), (1, 2, 0, 1.0, "", "", 0.5, False)]
    return spark.createDataFrame(rows, "doc_id long, formula_idx int, page int, bbox_y double, latex string, image_path string, confidence double, is_valid boolean")


def figures(spark):
    return spark.createDataFrame([(1, 0, 0, 130.0, "f.png", True, "Fig. 2. A picture", "fig_0_0")], "doc_id long, fig_idx int, page int, bbox_y double, image_path string, is_valid boolean, caption string, label string")


def test_chain(spark):
    papers, rejected = chain.prepare(paper(spark), formulas(spark), figures(spark), sized=True)
    papers = papers.persist()
    tex = chain.texts(papers, "ieee").collect()
    assert [r["doc_id"] for r in tex] == [1] and [r["doc_id"] for r in rejected.collect()] == [2]
    t = tex[0]["tex"]
    order = ["\\title{The Formulas}", "\\textbf{Peter Szabo}", "\\begin{abstract}", "formulas, numbers", "\\section{Introduction}", "$\\alpha$ of 3.14", "\\& sundry", "x=1", "Another paragraph", "\\section{Results}", "includegraphics[max width=0.85", "{f.png}", "\\caption{A picture}", "\\begin{tabular}", "MAML & 1.26", "\\section{Conclusion}", "It ends here.", "\\begin{thebibliography}{2}", "Max-linear systems: theory and algorithms, Springer", "ref2"]
    at = [t.find(x) for x in order]
    assert -1 not in at and at == sorted(at), [x for x, a in zip(order, at) if a < 0]
    assert "\n3.\n" not in t and t.count("The Formulas") == 1
    acm = chain.texts(papers, "acm").first()["tex"]
    assert acm.find("\\begin{tabular}") < acm.find("{f.png}") and "\\small" in acm


def test_summary(spark):
    from paperloom.operators import canon

    checked = chain.check(chain.parse(paper(spark), sized=True))
    got = {r["doc_id"]: r for r in checked.select("doc_id", canon.summary().alias("s"), "renderable", "repair_log").collect()}
    assert got[1]["s"] == "title=0.9(parsed) | authors=0.8(1) | abstract=0.9(73 chars) | sections=0.8(3) | refs=0.8(2)" and got[1]["renderable"]
    assert got[2]["repair_log"] == ["authors: none found", "abstract: none found", "sections: none found"] and not got[2]["renderable"]


def test_strategy(spark):
    both = paper(spark).unionByName(paper(spark, False).selectExpr("doc_id + 10 as doc_id", "block_idx", "page", "y", "text", "size"))
    assert {r["doc_id"]: r["strategy"] for r in chain.parse_strategy(both).collect()} == {1: "fonts", 2: "fonts", 11: "text", 12: "text"}
    got = {r["doc_id"]: r for r in chain.parse(both.where("doc_id in (1, 11)")).collect()}
    assert len(got[11]["authors"]) == 0 and len(got[1]["authors"]) == 1 and got[11]["title"] == "The Formulas"
    assert [s["heading"] for s in got[11]["sections"]] == ["Introduction", "Results", "Conclusion"]


def test_grouped_once(spark):
    """Fields found in a paper's array are those of the operators on its blocks; no window, one grouping."""
    from pyspark.sql import functions as F

    from paperloom.functions import text as T
    from paperloom.operators import authors, structure

    more = [(3, i, 0, i * 14.0 if i % 2 else None, t, z) for i, (t, z) in enumerate([("12 34", 10.0), ("Large Print", 16.0), ("and more", 16.0), ("ABSTRACT: one\n7", 10.0), ("two", 10.0), ("Index Terms - x; y", 10.0), ("Large Enough Heading", 11.2), ("x", 10.0), ("II. Larger one", 11.6), ("12\n13\nkept", None), ("Text. References", 10.0), ("[1] Some, A.: A reference of this list", 10.0)])]
    blocks = paper(spark).unionByName(spark.createDataFrame(more, "doc_id long, block_idx int, page int, y double, text string, size double"))
    one = structure.papers(blocks)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate [") == 1 and "Join" not in plan
    got = {r["doc_id"]: r for r in one.collect()}
    b = blocks.where(~T.is_metadata(F.col("text")))
    titles = structure.titles(b)
    assert {k: r["title"] for k, r in got.items()} == {r["doc_id"]: r["title"] for r in titles.collect()}
    assert {k: r["abstract"] for k, r in got.items() if r["abstract"] is not None} == {r["doc_id"]: r["abstract"] for r in structure.abstracts(b).collect()}
    assert {k: r["keywords"] for k, r in got.items() if r["keywords"] is not None} == {r["doc_id"]: r["keywords"] for r in structure.keyword_lists(b).collect()}
    parts = sorted(structure.sections(b).collect(), key=lambda r: (r["doc_id"], r["section_idx"]))
    assert [(k, *s) for k in sorted(got) for s in got[k]["sections"] or []] == [tuple(r) for r in parts]
    zone = {(r["doc_id"], r["block_idx"], r["text"]) for r in authors.zone(b, titles).collect()}
    assert {(k, *z) for k, r in got.items() for z in r["zone"]} == zone
    assert {(k, *z) for k, r in got.items() for z in r["listed"]} == {(r["doc_id"], r["block_idx"], r["text"]) for r in structure.outline(b).where("refs = 2").collect()}
    assert len(got[3]["sections"]) == 1 and [z["block_idx"] for z in got[1]["near"]] == [10, 11, 12, 13]
