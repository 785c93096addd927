"""Inputs derived from the driver's tables, as the oracles derive them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOL_TEXTS = (
    "ﬁnd the ﬂow — “quoted” ‘text’… (cid:12)(cid:7) end",
    "x² + y₁ − z⁻¹ = ⁿ√2  ",
    "α and β lie in Γ, with $x$ ≤ ∞",
    "a 3 . 14 and 2. 5 or 7 .9",
    "$a^{2}$ + $b^{2}$ = $c^{2}$ and $\\lambda$(A) $x$$y$",
    "Cost is 5% of A&B #3 in x_1 ~ {set} ^ $a_b$ \\alpha",
    "Smith, J. · Jones, K.² Title.. ",
    "• item ● two ○ three\u00a0\u200bspace\u0301 \ue000 \ufffd",
    "plain text only",
    "A ⊗ x ≥ λ, §2 †note ∑ ∫ ℝ",
)
LATEX = (
    r"\pi={\frac{O}{2r}}", r"a_{i i}>\sum_{k=1}^{t}\tilde{\Sigma}_{l=k+1}^{n}\;a_{k l}", r"F=G{\frac{m_{1}m_{2}}{r^{2}}}", r"{\frac{t_{p}+t_{q}}{3}}=\lambda(A)",
    r"\left(a+b", r"x}^{2}", r"\begin{array}{l}a&b\\c&d&e\end{array}", "", r"\mathcal{A}\mathcal{B}\mathcal{C}=\div", r"E=mc^{2}", r"\underbrace{abc}=\stackrel{x}{y}", r"\sim\sim(,a_{1234}",
)
NAMES = ("Peter Szabo, Mira Ferencova", "john smith", "UNIVERSITY OF KOSICE", "Ann Lee and Bob Ray", "Mary-Jane O*¹", "The Author", "A. Turing · K. Gödel", "IEEE ACM", "X Y", "Technical Institute Košice")
REFERENCES = (
    "[1] Butkovic, P.: Max-linear systems: theory and algorithms. Springer (2010)", "2. Szabo, P.: An iterative algorithm for computing the cycle mean", "a@b.cz", "12 34",
    "Creative Commons licence text", "Page 3 of 9", "Short line", "Gavalec, M., Plavka, J.: Monotone interval eigenproblem in max-min algebra", "volume 12 of the series", "[7] x",
)

AUTHOR_BLOCKS = (
    "SZABO*\nPeter\nDepartment of Mathematics, Slovakia\nTechnical University\npeter@tuke.sk",
    "Ann Lee and Bob Ray\nIndia",
    "Cyd Moe\nCollege of Arts\nOslo,Norway\nDan Poe\ndan@poe.org",
    "no names here",
)
# The authors of each of these blocks, by hand: block, author_idx, name, department, organization, city, country, email.
AUTHORS_OF_BLOCKS = (
    (0, 0, "Peter SZABO", "Department of Mathematics", "Technical University", "", "Slovakia", "peter@tuke.sk"), (1, 0, "Ann Lee", "", "", "", "", ""), (1, 1, "Bob Ray", "", "", "", "India", ""),
    (2, 0, "Cyd Moe", "College of Arts", "", "Oslo", "Norway", ""), (2, 1, "Dan Poe", "", "", "", "", "dan@poe.org"),
)
MATH_TEXTS = (
    "weights  and hyper-\nθ\nrule the noise level\nA ⊗ x = b\n(2)\nwhere: x ≤ aij, (5)",
    "k(x1, x1) · · · k(x1, xn)\n= ||[ 0, · · · , 0\n\n]||2 2n - 1m ||\nThese words follow after it",
    "ML\nϕ σ , λ\n\nθ c c c\nThe value x² of H₂O is 3 . 14",
    "ασ(1)π(1) and x_i with ti = 0\nsin(x) = y\nfile_path stays",
    "Nothing special is in this line",
)
TABLE_TEXTS = ("Table 1. RMSE of all regression models\nSkillcraft SML Parkinsons\nMAML 1 . 26 0 . 5 0 . 7\nFed Avg\n2 . 26 1 . 5 1 . 7", "Table 2. Nothing follows", "No caption")
CELLS = ("a2 + b2 = c2", "log(xy) = log(x)+ log(y)", "i² = −1", "E = mc²", "x3 = 27", "plain cell", "λ ≤ 2", "")
CLEAN_CELLS = ("$a^{2} + b^{2} = c^{2}$", "$\\log(xy) = \\log(x) + \\log(y)$", "$i^{2} = -1$", "$E = mc^{2}$", "$x^{3} = 27$", "plain cell", "$\\lambda \\leq$ 2", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in fewer splits than there are cores are dealt by document first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, "doc_id")
    return df


def pick(values, key: str):
    """The value at ``key`` modulo the list's length."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int") + 1)


def sql_pick(values, key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], ({key} % {len(values)})::INTEGER + 1)"


def symbol_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a symbol-bearing line before the whole text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.concat(pick(SYMBOL_TEXTS, "doc_id"), F.lit("\n\n"), F.col("text")).alias("text"))


SYMBOL_SQL = f"SELECT doc_id, {sql_pick(SYMBOL_TEXTS, 'doc_id')} || chr(10) || chr(10) || text AS text FROM documents WHERE text IS NOT NULL"


def paper_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block_idx, text, page, y, size: each document dressed as a paper.

    Dealt by document before the blocks are cut: every field of a paper is made where its
    document lies, and plans that assemble many fields reuse this one exchange.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").repartition("doc_id").selectExpr("doc_id", "split(text, '\n') as a").selectExpr("doc_id", "a", "size(a) as n", "size(a) div 2 as m")
    author = "element_at(array(" + ", ".join("'" + t.replace("\n", "\\n") + "'" for t in AUTHOR_BLOCKS) + f"), int(doc_id % {len(AUTHOR_BLOCKS)}) + 1)"
    parts = """concat(array(substring(a[0], 1, 80)), array({AUTHOR}), array(concat('Abstract. ', coalesce(get(a, 1), a[0]))), array('Keywords: alpha; beta gamma; delta.'), array('1. Introduction'),
        slice(a, 1, int(m)), array('2.1. Results'), slice(a, int(m) + 1, n), array('References'), transform(slice(a, 1, 5), (x, i) -> concat('[', i + 1, '] ', x)))"""
    rows = docs.select("doc_id", F.posexplode(F.expr(parts.replace("{AUTHOR}", author))).alias("block_idx", "text"))
    return rows.selectExpr("doc_id", "block_idx", "text", "int(block_idx div 40) as page", "(block_idx % 40) * 14.0D as y", "case when block_idx = 0 then 16.0D else 10.0D end as size")


PAPER_SQL = """paper AS (SELECT doc_id, unnest(range(len(b)))::INTEGER AS block_idx, unnest(b) AS text FROM (
  SELECT doc_id, [substring(a[1], 1, 80)] || [@AUTHOR] || ['Abstract. ' || coalesce(a[2], a[1])] || ['Keywords: alpha; beta gamma; delta.'] || ['1. Introduction'] || a[1:m] || ['2.1. Results'] || a[m+1:n]
    || ['References'] || list_transform(a[1:5], lambda x, i: '[' || i || '] ' || x) AS b
  FROM (SELECT doc_id, a, len(a) AS n, len(a) // 2 AS m FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)))),
blocks AS (SELECT doc_id, block_idx, text, block_idx // 40 AS page, (block_idx % 40) * 14.0::DOUBLE AS y, CASE WHEN block_idx = 0 THEN 16.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM paper)""".replace("@AUTHOR", sql_pick(AUTHOR_BLOCKS, "doc_id"))

LINES_SQL = """lines AS (SELECT doc_id, lang, unnest(range(len(p)))::INTEGER AS line_idx, unnest(p) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""


LINE_ORDER = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, numbered without repeats."""
    return table(spark, sf_dir, "lineitem").selectExpr(f"int({LINE_ORDER}) as l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


LI_SQL = f"li AS (SELECT ({LINE_ORDER})::INTEGER AS l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from order lines."""
    return order_lines(spark, sf_dir).selectExpr(
        "l_orderkey as doc_id", "int(l_linenumber) as image_idx", "int(l_partkey % 4) as page", "4 as pages", "int(l_suppkey % 7) as xref", "double(l_partkey % 400) as x0",
        "double(l_suppkey % 700) as y0", "double(l_quantity * 10) as w", "double((l_partkey % 37) * 9) as h",
    ).selectExpr("*", "x0 + w as x1", "y0 + h as y1")


IMAGES_SQL = LI_SQL + """, images AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS image_idx, (l_partkey % 4)::INTEGER AS page, 4 AS pages, (l_suppkey % 7)::INTEGER AS xref,
  (l_partkey % 400)::DOUBLE AS x0, (l_suppkey % 700)::DOUBLE AS y0, (l_quantity * 10)::DOUBLE AS w, ((l_partkey % 37) * 9)::DOUBLE AS h FROM li))"""


def math_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: lines of mathematics before the whole text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.concat(pick(MATH_TEXTS, "doc_id"), F.lit("\n"), F.col("text")).alias("text"))
