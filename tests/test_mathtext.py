import re

import pytest
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.functions import mathtext as M
from paperloom.functions import text as T
from paperloom.operators import lines as ln


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("r")).first()["r"]


def rows(spark, text):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))], "doc_id int, line_idx int, line string")


@pytest.mark.parametrize(
    ("fn", "before", "after"),
    [
        (M.scripts, "x² and H₂O, ( ²³ y₁² z⁻¹", "$x^{2}$ and $H_{2}$O, ( $^{23}$ $y_{1}$$^{2}$ $z^{-1}$"),
        (M.scripts, "²³", "$^{2}$$^{3}$"),
        (M.scripts, "none\nhere", "none\nhere"),
        (M.ascii_subscripts, "x_i in $a_b$ file_path a_1.", "$x_{i}$ in $a_b$ file_path $a_{1}$."),
        (M.greek_subscripts, "ασ(1)π(1) word", "$\\alpha_{\\sigma(1)\\pi(1)}$ word"),
        (M.greek_subscripts, "plain σ(1)", "plain σ(1)"),
        (M.implicit_subscripts, "aij + ajk ≤ aij + all", "$a_{ij}$ + $a_{jk}$ ≤ $a_{ij}$ + all"),
        (M.implicit_subscripts, "ti = 0 a tj = 1\naij in prose", "$t_{i}$ = 0 a $t_{j}$ = 1\naij in prose"),
        (M.wrap_lines, "sin(x) = y\nThis sentence stays here.\n= 2 + x", "$sin(x) = y$\nThis sentence stays here.\n$= 2 + x$"),
        (M.fix_primes, "a ' $x' y$ and $' '$ b", "a $x' y$ and  b"),
        (M.clean_cell, "a2 + b2 = c2", "$a^{2} + b^{2} = c^{2}$"),
        (M.clean_cell, "log(xy) = log(x)+ log(y)", "$\\log(xy) = \\log(x) + \\log(y)$"),
        (M.clean_cell, "i² = −1", "$i^{2} = -1$"),
        (M.clean_cell, "E = mc²", "$E = mc^{2}$"),
        (M.clean_cell, None, ""),
        (ln.merge_orphans, "weights  and hyper-\nθ\nnext σ\n\nλ\nending here", "weights  and hyperθ\nnext σ\n\nending here"),
        (ln.merge_orphans, "σ\nfirst line here\nmatrix A\n22\nA ⊗ x = b\n(2)", "σ first line here\nmatrix A 22\nA ⊗ x = b\n(2)"),
        (ln.merge_orphans, "we see that\n4\nthings happen", "we see that\n4 things happen"),
    ],
)
def test_text(spark, fn, before, after):
    assert one(spark, before, fn) == after


def test_garbage(spark):
    text = "Words are kept here.\nk(x1, x1) · · · k(x1, xn)\n= ||[ 0, · · · , 0\n\n]||2 2n - 1m ||\nMore words follow in this line."
    assert [r["line"] for r in ln.drop_garbled(rows(spark, text)).orderBy("line_idx").collect()] == ["Words are kept here.", "More words follow in this line."]
    text = "Some real words stand here\nML\nϕ σ , λ\n\nθ c c c\nMore real words again"
    kept = [r["line"] for r in ln.drop_fragments(rows(spark, text)).orderBy("line_idx").collect()]
    assert kept[0] == "Some real words stand here" and kept[-1] == "More real words again" and "θ c c c" not in kept
    assert not one(spark, "A ⊗ x = b", M.garbled) and not one(spark, "", M.fragment)


def test_captions(spark):
    c = spark.createDataFrame([(1, "Real world regression datasets, RMSE reported in bits"), (1, "short")], "doc_id int, caption string")
    assert ln.drop_captions(rows(spark, "x Real world regression datasets, RMSE reported\nshort\ny"), c).count() == 2


def test_numbered_equations(spark):
    text = "A ⊗ x = b\n(2)\n(3)\nas shown in the equation (4)\nwhere: x ≤ aij, (5)\n(6)"
    got = "\n".join(r["line"] for r in ln.number_equations(rows(spark, text)).orderBy("line_idx").collect())
    assert got == "\n\n\\begin{equation}\n  A \\otimes x = b\n\\end{equation}\n\nas shown in the equation (4)\n\nwhere:\n\\begin{equation}\n  x \\leq a_{ij},\n\\end{equation}\n"


def test_normalise(spark):
    b = spark.createDataFrame([(1, "My Paper Title\n\nThe value x² of α is 3 . 14\nx ≤ aij (1)")], "doc_id int, text string")
    t = spark.createDataFrame([(1, "My paper title")], "doc_id int, title string")
    assert ln.normalise_bodies(b, t).first()["text"] == "The value $x^{2}$ of $\\alpha$ is 3.14\n\n\\begin{equation}\n  x \\leq a_{ij}\n\\end{equation}\n"


def test_cheap_tests_change_nothing(spark):
    """Trimming, blanks and classes of characters are as their plain definitions; classes rule out ASCII first."""
    odd = ["", " ", "a", "\u00a0a\u3000", "a\u2009", "é", " é b ", "a  b\t c\td", "\t", "\u0085x", "x\x0b", "\x1fx\x1f", "~x!", "a\x7f", "x² y₁", "λ(A) ≤ é", "\U0001d49c b\u0301\ue001\ufffd", "a \n b", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(odd)], "k int, x string")
    lit = lambda v: T.strip(F.concat(v, F.lit("")))
    got = df.select("x", T.strip(F.col("x")).alias("s"), lit(F.col("x")).alias("t"), T.one_blank(F.col("x"), "[ \t]").alias("b"), T.one_blank(F.col("x"), r"\s").alias("w"), T.strip_unsafe(F.col("x")).alias("u"), F.col("x").rlike(T.high(C.MATH_CLASS)).alias("m")).collect()
    for x, s, t, b, w, u, m in got:
        if x is None:
            assert (s, t, b, w, u, m) == (None,) * 6
            continue
        assert s == t == x.strip(T.WHITE_SPACE)
        assert b == re.sub("[ \t]+", " ", x) and w == re.sub("[ \t\n\x0b\f\r]+", " ", x)
        assert u == re.sub("[\u0300-\u036f\ue000-\uf8ff\ufffd\uffff\U00010000-\U0010ffff]", "", x)
        assert m == bool(re.search(C.MATH_CLASS, x))
    made = str(M.after_equations(F.col("x")))
    assert made.count("[αβ") == made.count("&&[αβ") > 0
    kept = spark.createDataFrame([(" words that stay here \n\n\tmore of them\n",), ("",), (None,)], "x string").select("x", ln.merge_orphans(F.col("x")).alias("y")).collect()
    assert [r.y for r in kept] == [r.x for r in kept]
