import re

import pytest
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions import latex as L
from paperloom.functions import text as T
from paperloom.operators import layout, structure


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(("latex", "score"), [(r"\pi={\frac{O}{2r}}", 0.65), (r"a_{i i}>\sum_{k=1}^{t}\tilde{\Sigma}_{l=k+1}^{n}\;a_{k l}", 0.75), (r"{\frac{t_{p}+t_{q}}{3}}=\lambda(A)", 0.70), (r"F=G{\frac{m_{1}m_{2}}{r^{2}}}", 0.75), ("", 0.0)])
def test_formula_score(spark, latex, score):
    assert one(spark, latex, L.score) == pytest.approx(score)


def test_merge_math(spark):
    assert one(spark, r"$\lambda$(A)", T.merge_math) == r"$\lambda(A)$"
    assert one(spark, "$a^{2}$ + $b^{2}$ = $c^{2}$", T.merge_math) == "$a^{2} + b^{2} = c^{2}$"


def test_heading_depth(spark):
    h = one(spark, "3.2. Physical formulas", T.heading)
    assert (h["text"], h["depth"]) == ("Physical formulas", 2)
    assert one(spark, "12", T.heading) is None


def test_roman_heading(spark):
    assert one(spark, "IV. Results", T.heading)["text"] == "Results" and one(spark, "I think so", T.heading) is None
    assert one(spark, "II. Our own words", lambda x: T.heading(x, F.lit(12.0), F.lit(10.0)))["text"] == "Our own words"


@pytest.mark.parametrize(("latex", "score"), [(r"a \to b", 0.35), (r"\frac{a}{b}", 0.45), (r"\lim_{x \to 0} x=1", 0.7), (r"Introduction=x", 0.0), (r"\Rightarrow_{a}b=c", 0.25)])
def test_score_rules(spark, latex, score):
    assert one(spark, latex, L.score) == pytest.approx(score)


def test_sanitize(spark):
    assert one(spark, r"\left(a+b", L.sanitize) == r"\left(a+b\right."
    assert one(spark, "x}^{2}", L.sanitize) == "{x}^{2}"
    assert one(spark, r"\begin{array}{l}a&b\\c&d&e\end{array}", L.sanitize) == r"\begin{array}{ccc}a&b\\c&d&e\end{array}"


def test_escape(spark):
    assert one(spark, r"5% of $a_b$ & \alpha_1", L.escape) == r"5\% of $a_b$ \& \alpha\_1"


def test_clean_is_idempotent(spark):
    once = one(spark, "ﬁnd  “x” (cid:3) — y ", T.basic_clean)
    assert once == "find ``x'' --- y" and one(spark, once, T.basic_clean) == once


def test_greedy_match(spark):
    a = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 1, 12.0)], "doc_id int, page int, idx int, y double")
    b = spark.createDataFrame([(1, 0, 7, 11.0), (1, 0, 8, 40.0), (1, 0, 9, 90.0)], "doc_id int, page int, idx int, y double")
    got = {(r["left_idx"], r["right_idx"]) for r in layout.match_nearest(a, b).collect()}
    assert got == {(0, 7), (1, 8)}


def test_reference_fold(spark):
    rows = [(1, 0, "[1] Butkovic, P.: Max-linear systems: theory and algorithms"), (1, 1, "pp. 12-40, Springer"), (1, 2, "Creative Commons")]
    got = structure.fold_reference_lines(spark.createDataFrame(rows, "doc_id int, line_idx int, line string")).first()["refs"]
    assert [r["text"] for r in got] == ["Butkovic, P.: Max-linear systems: theory and algorithms pp. 12-40, Springer"]


def test_large_print_and_wrapped_references(spark):
    blocks = [("A Paper With a Large Title", 16.0), ("Abstract", 12.0), ("What it says in short", 10.0), ("Proposed Method", 12.0), ("Page 3 of 9\nFirst line of it\nand more", 10.0), ("IV. Our own words", 11.2), ("Body text of ours", 10.0), ("Of one size", 11.0), ("References", 12.0),
              ("[1] Butkovic, P.: Max-linear systems: theory\nand algorithms, Springer\n[2] Szabo, P.: An iterative algorithm", 10.0), ("for computing the cycle mean of a matrix", 10.0)]
    b = spark.createDataFrame([(1, i, t, 0, s) for i, (t, s) in enumerate(blocks)], "doc_id int, block_idx int, text string, page int, size double")
    assert [(r["h"]["text"], r["h"]["depth"]) for r in structure.headings(b).orderBy("block_idx").collect() if r["h"] and r["block_idx"] in (0, 3, 5, 7)] == [("Proposed Method", 1), ("Our own words", 1)]
    assert [(r["heading"], r["body"]) for r in structure.sections(b).orderBy("section_idx").collect() if r["heading"].lower() != "abstract"] == [("Proposed Method", "First line of it\nand more"), ("Our own words", "Body text of ours\n\nOf one size")]
    assert [r["text"] for r in structure.references(b).orderBy("ref_idx").collect()] == ["Butkovic, P.: Max-linear systems: theory and algorithms, Springer", "Szabo, P.: An iterative algorithm for computing the cycle mean of a matrix"]


def test_place(spark):
    items = spark.createDataFrame([(1, 0, 0, 620.28), (1, 1, -1, 0.0)], "doc_id int, item_idx int, page int, y double")
    starts = spark.createDataFrame([(1, 0, 0, 532.2), (1, 1, 0, 631.8)], "doc_id int, section_idx int, page int, y double")
    assert {(r["item_idx"], r["section_idx"]) for r in structure.place(items, starts).collect()} == {(0, 0), (1, 0)}


def test_pattern_lists_match_as_one_alternation(spark):
    """Anchored and gated searches find what one alternation over all patterns finds."""
    rows = ["", " 12 ", "12 34", "12      x", "Vol. 3", "see VOL. 3", "volume IX", "doi: 1", "xx Doi:10.5 yy", "xx doi:20.5", "2020 ieee", "© 2020", "an issn 1234-5678", "ISSN", "Authorized licensed use", "not Authorized licensed use",
            "1-2-3-4", "arXiv:12.3", "see arXiv:12.3", "https://a", "on Page 3 of 9", "page three", "Machine Learning (2020) 1:2", "Machine learning", "12 Page 3 of 4", "a creative  Commons attribution", "creative", "Article is licensed under", "an article is  licensed under it",
            "Received 3 May, accepted 4", "was received 3 and accepted 4 then", "received", "a@b.cz", "issue 4", "12 University of X", "plain", "x\nPage 1 of 2"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    for patterns in (C.METADATA_PATTERNS, C.JUNK_REFERENCES):
        got = df.select(T.matches_any(F.col("x"), patterns).alias("a"), F.col("x").rlike("|".join(f"(?:{p})" for p in patterns)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and {r.a for r in got} == {True, False}


def test_strip_and_escape_as_their_plain_patterns(spark):
    rows = ["", " \t\n", " a b　\n", " x ", "​kept​", "a", "50% $a_b$ {x} \\alpha \\& ~^ $ 3_4", "tail \\", "$open _x", "a\nb & c"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    got = df.select(T.strip(F.col("x")).alias("a"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("b"), L.escape(F.col("x")).alias("e")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    marks = {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    token = re.compile(r"(?s)(\$[^$]*\$|\\[a-zA-Z]+|\\.|.)")
    assert [r.e for r in got] == ["".join("\\" + t if t in "&%#_{}" else marks.get(t, t) for t in token.findall(r)) for r in rows]


def test_symbols_decimals_and_reference_lines(spark):
    from paperloom.functions import mathtext as M

    both = lambda x: M.to_commands(M.to_commands(x, C.GREEK), C.SYMBOLS)
    assert one(spark, "$α$ x − y", both) == r"$\alpha$ x $-$ y"
    assert one(spark, "7 .9 and 3 . 14", T.join_decimals) == "7.9 and 3.14"
    assert one(spark, "[7] x", T.parse_reference) is None and one(spark, "[7] Creative Commons licence", T.parse_reference) is None


def test_reference_list_behind_a_paragraph(spark):
    rows = ["1. Introduction", "Some text of it. References", "[1] Butkovic, P.: Max-linear systems: theory", "Ann ann@lee.org and nothing else"]
    b = spark.createDataFrame([(1, i, t, 0) for i, t in enumerate(rows)], "doc_id int, block_idx int, text string, page int")
    assert [r["body"] for r in structure.sections(b).collect()] == ["Some text of it."]
    assert [r["text"] for r in structure.references(b).collect()] == ["Butkovic, P.: Max-linear systems: theory Ann ann@lee.org and nothing else"]


def test_items_without_pages_are_dealt_in_turn(spark):
    items = spark.createDataFrame([(1, i, -1, 0.0) for i in range(3)], "doc_id int, item_idx int, page int, y double")
    starts = spark.createDataFrame([(1, 4, 0, 0.0), (1, 6, 1, 0.0)], "doc_id int, section_idx int, page int, y double")
    assert sorted((r["item_idx"], r["section_idx"]) for r in structure.place(items, starts).collect()) == [(0, 4), (1, 6), (2, 4)]
