from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.operators import canon, render, structure


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("r")).first()["r"]


def test_equations_stay_raw(spark):
    got = one(spark, "a_b\n\\begin{equation}\n  x_{1}\n\\end{equation}\nc & d", L.split_equations)
    assert [(r["type"], r["content"]) for r in got] == [("text", "a\\_b"), ("raw_latex", "\\begin{equation}\n  x_{1}\n\\end{equation}"), ("text", "c \\& d")]
    assert "  x_{1}\n" in one(spark, "a\n\\begin{equation}\n  x_{1}\n\\end{equation}\n\nb", L.paragraphs)


def test_cells(spark):
    assert one(spark, r"\CELLEQ{a=b||IMG:p.png}", L.table_cell) == r"$\displaystyle a=b$"
    assert "p.png" in one(spark, r"\CELLEQ{\stackrel{a}{b}\stackrel{c}{d}||IMG:p.png}", L.table_cell)
    assert "includegraphics" in one(spark, r"\CELLIMG{q.png}", L.table_cell) and one(spark, "a_b", L.table_cell) == r"a\_b"


def test_records(spark):
    f = spark.range(1).select(L.figure_record(F.lit("/b/x.png"), F.lit(True), F.lit("Fig. 3: A caption"), F.lit("l"), "/b").alias("f"), L.formula_record(F.lit("long"), F.lit("i.png"), F.lit(True), F.lit(0.9)).alias("g")).first()
    assert (f["f"]["image_path"], f["f"]["caption"]) == ("x.png", "A caption") and f["g"]["latex"] == ""


def test_keywords(spark):
    assert one(spark, "Text. Keywords: a; b.", lambda x: canon.keywords(F.lit(None).cast("array<string>"), x))["value"] == ["a", "b"]
    assert one(spark, None, lambda x: canon.keywords(F.lit(None).cast("array<string>"), x))["confidence"] == 0.0


def test_layouts(spark):
    author = "struct<name: string, department: string, organization: string, city: string, country: string, email: string>"
    df = spark.createDataFrame([([("Ann Lee", "Dept", "Uni & Co", "X", "Y", "a@b.c"), ("Bob Ray", "", "", "", "", "")], [("Intro", 1, "Body", [], [], [("f.png", "A fig", "fig1")], [(["h", "i"], [["1", "2"]], "A tab", "tab1")])])],
        f"a array<{author}>, s array<struct<heading: string, depth: int, body: string, positions: array<struct<page: int, y: double>>, formulas: array<struct<page: int, bbox_y: double, latex: string, image_path: string, confidence: double, is_valid: boolean>>, figures: array<struct<image_path: string, caption: string, label: string>>, tables: array<struct<headers: array<string>, rows: array<array<string>>, caption: string, label: string>>>>")
    for layout in ("ieee", "acm", "springer", "elsevier", "apa", "arxiv"):
        tex = df.select(render.document(layout, F.lit("T"), F.lit("A"), F.array(F.lit("k")), F.col("s"), F.array(F.lit("r")), F.col("a"), True)).first()[0]
        assert "Ann Lee" in tex and "Bob Ray" in tex and r"Uni \& Co" in tex and "{f.png}" in tex and "\\begin{tabular}" in tex and "null" not in tex
        assert (tex.find("{f.png}") < tex.find("{tabular}")) == (layout == "ieee")
        assert "a@b.c" in tex and tex.count("\\begin{figure}") == tex.count("\\begin{table}") == 1


def test_text_only(spark):
    text = "A title of this paper\nAbstract: One\ntwo\nKeywords: a, b\n1. Introduction\nBody text\nReferences\n[1] Somebody, A.: A long reference text"
    front, rest = structure.text_only(spark.createDataFrame([(1, text), (2, ""), (3, "12")], "doc_id int, text string"))
    r = front.collect()
    assert [(x["title"], x["abstract"], x["keywords"]) for x in r] == [("A title of this paper", "One two", ["a", "b"])]
    assert [(x["heading"], x["body"]) for x in structure.sections(rest).collect()] == [("Introduction", "Body text")]
    assert structure.references(rest).count() == 1
