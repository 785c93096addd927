"""Queries of the extraction and normalisation operators; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mathtext as M
from ..operators import authors as au
from ..operators import chars, images, line_model, structure, tables
from ..operators import lines as ln
from . import fixtures as fx
from .. import constants as C
from .catalogue import BEST, CLASS_SQL, PAPER, READINGS, REAL_SQL, greedy_sql, query, strip


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


VALUES = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in fx.AUTHORS_OF_BLOCKS)


@query("authors_extract", f"SELECT doc_id, author_idx::INTEGER AS author_idx, name, department, organization, city, country, email FROM documents JOIN (VALUES {VALUES}) v(block, author_idx, name, department, organization, city, country, email) ON doc_id % {len(fx.AUTHOR_BLOCKS)} = block WHERE text IS NOT NULL")
def authors_extract(spark, d):
    return au.authors(fx.paper_blocks(spark, d))


@query("diagnose_blocks", f"""WITH {PAPER} SELECT doc_id, block_idx, size, 10.0::DOUBLE AS body, CASE WHEN size > 12 THEN 'title-sized' WHEN lower(t) IN ('author', 'authors') THEN 'authors' WHEN starts_with(lower(t), 'abstract') THEN 'abstract' WHEN starts_with(lower(t), 'keywords') THEN 'keywords' ELSE '' END AS label FROM t0 WHERE page < 3 AND block_idx < 35""")
def diagnose_blocks(spark, d):
    return structure.diagnose(fx.paper_blocks(spark, d))


@query("text_only_parse")
def text_only_parse(spark, d):
    """Title, abstract and keywords of texts without print sizes."""
    blocks = fx.paper_blocks(spark, d).selectExpr("doc_id", "block_idx as line_idx", "text as line")
    front, _ = structure.text_only(ln.gather(blocks))
    return front.select("doc_id", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), F.array_join("keywords", "|").alias("keywords"))


M_LINES = f"m AS (SELECT doc_id, {fx.sql_pick(fx.MATH_TEXTS, 'doc_id')} || chr(10) || text AS text FROM documents WHERE text IS NOT NULL), rows AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS line_idx, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM m)), l AS (SELECT *, {strip('raw')} AS line FROM rows)"
_COUNT = lambda x, p: f"(length({x}) - length(regexp_replace({x}, '{p}', '', 'g')))"
_OPS, _CHARS = r"[=+\-*/(){}\[\]|,;:.<>^_\\¯]", "replace(line, ' ', '')"
_SIDES = "CASE " + " ".join(f"WHEN contains(line, '{s}') THEN regexp_matches(line, '(?s)^[^{s}]*[a-zA-Z][^{s}]*{s}.*[a-zA-Z]')" for s in "=≤≥≈") + " ELSE false END"
_PLAIN = f"(length(line) < 60 AND ({_SIDES}))"
_WORDS = r"regexp_split_to_array(line, '\s+')"
_SHORT = f"(len(list_filter({_WORDS}, lambda w: length(w) <= 2))::DOUBLE / len({_WORDS}))"
GARBLED_SQL = rf"""(line <> '' AND length(line) <= 150 AND NOT {_PLAIN} AND (contains(line, '· · ·') OR (contains(line, '...') AND (contains(line, 'k(') OR contains(line, '||'))) OR len(regexp_extract_all(line, '[a-zA-Z]\([^)]{{1,20}}\)')) >= 3
  OR regexp_matches(line, '\|\|.*\|\|') OR regexp_matches(line, '(?i)^(?:[\p{{L}}\p{{N}}_\s\-+()]*[^\p{{L}}\p{{N}}_])?terms\s*$') OR (starts_with(line, '=') AND length(line) < 100 AND {REAL_SQL} <= 1)
  OR (length(line) < 80 AND {REAL_SQL} <= 1 AND ({_COUNT(_CHARS, C.MATH_CLASS)} + {_COUNT(_CHARS, _OPS)} + {_COUNT(_CHARS, '[' + chr(92) + 'p{Nd}¹²³]')})::DOUBLE / greatest(length({_CHARS}), 1) > 0.35)))"""
_MATH, _OP, _ALL = _COUNT(_CHARS, C.MATH_CLASS), _COUNT(_CHARS, _OPS), f"length({_CHARS})"
FRAGMENT_SQL = rf"""(line <> '' AND length(line) <= 60 AND NOT {_PLAIN} AND (regexp_matches(line, '^\(\d+\)$') OR ({_MATH} > 0 AND {_MATH} + {_OP} >= {_ALL} * 0.5 AND {_ALL} <= 20) OR (len({_WORDS}) >= 2 AND {_SHORT} >= 0.6 AND {_ALL} <= 40 AND {REAL_SQL} = 0) OR ({_OP} >= {_ALL} * 0.6 AND {_ALL} <= 25)))"""


def islands_sql(core: str, bridge: str, counted: str) -> str:
    return f"""WITH {M_LINES}, c AS (SELECT *, {core} AS core FROM l), d AS (SELECT *, (core OR coalesce({bridge}, false))::INTEGER AS inside FROM c), e AS (SELECT *, sum(1 - inside) OVER (PARTITION BY doc_id ORDER BY line_idx) AS run FROM d),
  g AS (SELECT *, sum({counted}) OVER (PARTITION BY doc_id, run) AS n FROM e) SELECT doc_id, line_idx FROM g WHERE inside = 0 OR n < 3"""


@query("orphan_lines")
def orphan_lines(spark, d):
    return digest(fx.math_documents(spark, d).select("doc_id", ln.merge_orphans(F.col("text")).alias("text")))


@query("garbled_blocks", islands_sql(GARBLED_SQL, "line = '' AND lag(core) OVER (PARTITION BY doc_id ORDER BY line_idx)", "core::INTEGER"))
def garbled_blocks(spark, d):
    return ln.drop_garbled(ln.scatter(fx.math_documents(spark, d))).select("doc_id", "line_idx")


@query("equation_fragments", islands_sql(FRAGMENT_SQL, "line = '' AND last_value(CASE WHEN line <> '' THEN core END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "inside"))
def equation_fragments(spark, d):
    return ln.drop_fragments(ln.scatter(fx.math_documents(spark, d))).select("doc_id", "line_idx")


@query("numbered_equations")
def numbered_equations(spark, d):
    return digest(ln.gather(ln.number_equations(ln.scatter(fx.math_documents(spark, d)))))


@query("normalise_bodies")
def normalise_bodies(spark, d):
    docs = fx.math_documents(spark, d)
    return digest(ln.normalise_bodies(docs, docs.select("doc_id", F.substring_index("text", "\n", -1).alias("title"))))


CAPTION_ROWS = "WITH " + fx.LINES_SQL + ", c AS (SELECT doc_id, regexp_replace(substring(line, 1, 40), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g') AS head FROM lines WHERE line_idx = 1 AND length(line) >= 20)"


@query("caption_leaks", CAPTION_ROWS + " SELECT l.doc_id, line_idx FROM lines l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND contains(l.line, c.head))")
def caption_leaks(spark, d):
    rows = ln.lines(fx.table(spark, d, "documents"))
    return ln.drop_captions(rows, rows.where("line_idx = 1").selectExpr("doc_id", "line as caption")).select("doc_id", "line_idx")


for _name, _fn in (("unicode_scripts", M.scripts), ("ascii_subscripts", M.ascii_subscripts), ("greek_subscripts", M.greek_subscripts), ("implicit_subscripts", M.implicit_subscripts), ("wrap_math_lines", M.wrap_lines), ("math_primes", M.fix_primes)):
    query(_name)(lambda spark, d, f=_fn: digest(fx.math_documents(spark, d).select("doc_id", f(F.col("text")).alias("text"))))


@query("table_cells", f"SELECT p_partkey, {fx.sql_pick(fx.CLEAN_CELLS, 'p_partkey')} AS cell FROM part")
def table_cells(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", M.clean_cell(fx.pick(fx.CELLS, "p_partkey")).alias("cell"))


@query("text_tables", f"""SELECT doc_id, 'Method|Skillcraft|SML|Parkinsons' AS headers, 'MAML|1.26|0.5|0.7;Fed Avg|2.26|1.5|1.7' AS "rows", 'RMSE of all regression models' AS caption, 'tab:1' AS label FROM documents WHERE text IS NOT NULL AND doc_id % {len(fx.TABLE_TEXTS)} = 0""")
def text_tables(spark, d):
    """One caption block a document, then a heading and its text."""
    docs = fx.table(spark, d, "documents").where("text is not null")
    blocks = docs.select("doc_id", F.posexplode(F.array(fx.pick(fx.TABLE_TEXTS, "doc_id"), F.lit("2. Conclusion"), F.col("text"))).alias("block_idx", "text"))
    t = tables.detect(blocks)
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), "caption", "label")


@query("join_numbers")
def join_numbers(spark, d):
    return ln.lines(fx.table(spark, d, "documents")).select("doc_id", "line_idx", F.md5(F.array_join(tables.join_numbers(F.col("line")), " ")).alias("digest"))


# ---- pages ---------------------------------------------------------------------------------------

NUMBER_BLOCKS = "SELECT doc_id, page, image_idx AS block_idx, CASE WHEN image_idx % 2 = 0 THEN '(' || image_idx || ')' ELSE 'α + β ≤ γ' END AS text, x0, y0, x1, y1 FROM images"


def _number_blocks(spark, d):
    text = F.when(F.col("image_idx") % 2 == 0, F.concat(F.lit("("), F.col("image_idx").cast("string"), F.lit(")"))).otherwise("α + β ≤ γ")
    return fx.images(spark, d).select("doc_id", "page", F.col("image_idx").alias("block_idx"), text.alias("text"), F.array(F.lit("CMSY10")).alias("fonts"), "x0", "y0", "x1", "y1", "w", "h")


@query("equation_number_scan", f"WITH {fx.IMAGES_SQL}, b AS ({NUMBER_BLOCKS}) SELECT doc_id, page, block_idx AS idx, (y0 + y1) / 2 AS y, regexp_extract(text, '[0-9]+') AS number FROM b WHERE block_idx % 2 = 0")
def equation_number_scan(spark, d):
    return images.equation_numbers(_number_blocks(spark, d))


@query("formula_regions", f"""WITH {fx.IMAGES_SQL}, b AS ({NUMBER_BLOCKS}), f AS (SELECT * FROM b WHERE block_idx % 2 = 1 AND x1 - x0 >= 60 AND y1 - y0 >= 20), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, block_idx) AS r FROM f),
  q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, block_idx) AS k FROM p WHERE r <= 6) SELECT doc_id, page, block_idx FROM q WHERE k <= 20""")
def formula_regions(spark, d):
    return images.formula_regions(_number_blocks(spark, d)).select("doc_id", "page", "block_idx")


def _numbered(spark, d):
    b = _number_blocks(spark, d)
    return images.number_formulas(b.where("block_idx % 2 = 1").select("doc_id", "page", F.col("block_idx").alias("idx"), F.col("y0").alias("y"), "h", "w"), images.line_numbers(b))


NUMBERED_SQL = greedy_sql(f"b AS ({NUMBER_BLOCKS}), ll AS (SELECT doc_id, page, block_idx AS idx, y0 AS y, y1 - y0 AS h, x1 - x0 AS w FROM b WHERE block_idx % 2 = 1)", "rr AS (SELECT doc_id, page, block_idx * 10000 AS idx, (y0 + y1) / 2 AS y, block_idx::VARCHAR AS number FROM b WHERE block_idx % 2 = 0)", "y, idx, h", "80 + greatest(l.h, 0.0) / 2", "abs(l.y + greatest(l.h, 0.0) / 2 - z.y)")
NUMBERED_SQL += ", f AS (SELECT l.*, CASE WHEN s.hit IS NULL THEN '' ELSE (s.hit // 10000)::VARCHAR END AS equation_number FROM l LEFT JOIN step s ON s.doc_id = l.doc_id AND s.page = l.page AND s.k = l.k)"


@query("formula_numbers", NUMBERED_SQL + " SELECT doc_id, page, idx, equation_number FROM f")
def formula_numbers(spark, d):
    return _numbered(spark, d).select("doc_id", "page", "idx", "equation_number")


@query("unmatched_regions", NUMBERED_SQL + """, big AS (SELECT DISTINCT doc_id, equation_number AS number FROM f WHERE equation_number <> '' AND NOT (h > 0 AND h * (CASE WHEN w > 0 THEN w ELSE h END) < 2000)),
  u AS (SELECT doc_id, number, min({'page': page, 'y': y}) AS a FROM rr WHERE NOT EXISTS (SELECT 1 FROM big WHERE big.doc_id = rr.doc_id AND big.number = rr.number) GROUP BY doc_id, number)
  SELECT doc_id, a.page AS page, number, 70.0::DOUBLE AS x0, greatest(0.0, a.y - 50)::DOUBLE AS y0, 542.0::DOUBLE AS x1, (a.y + 15)::DOUBLE AS y1 FROM u""")
def unmatched_regions(spark, d):
    return images.unmatched_regions(_number_blocks(spark, d), _numbered(spark, d))


@query("header_images", f"WITH {fx.IMAGES_SQL} SELECT doc_id, image_idx FROM images WHERE NOT (page = 0 AND y0 < 0.2 * 792.0 AND w * h < 50000 AND h < 200)")
def header_images(spark, d):
    return images.drop_headers(fx.images(spark, d)).select("doc_id", "image_idx")


@query("page_images")
def page_images(spark, d):
    i = fx.images(spark, d)
    listings = i.selectExpr("doc_id", "page", "pages", "image_idx", "image_idx as xref", "int(w * 2) as width_px", "int(h * 2) as height_px", "int(w * 7) as n_bytes")
    box = i.selectExpr("doc_id", "page", "image_idx as xref", "x0", "y0", "x1", "y1")
    captions = i.where("image_idx = 2").selectExpr("doc_id", "page", "y0", "y0 + 12 as y1", "'Fig. 1. A caption' as text")
    return images.page_images(listings, box.where("xref % 3 = 0"), box.where("xref % 3 = 1"), captions, box.where("xref = 1")).select("doc_id", "page", "image_idx", "kind")


@query("cell_grid", f"WITH {fx.IMAGES_SQL} SELECT doc_id, image_idx, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY round(y0, 1)) - 1)::INTEGER AS row_idx, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY round(x0, 1)) - 1)::INTEGER AS col_idx FROM images")
def cell_grid(spark, d):
    return images.cell_grid(fx.images(spark, d).withColumn("table_idx", F.lit(0))).select("doc_id", "image_idx", "row_idx", "col_idx")


@query("corrupt_images", f"WITH {fx.IMAGES_SQL} SELECT doc_id, image_idx, {CLASS_SQL} AS kind FROM images WHERE image_idx % 5 <> 0")
def corrupt_images(spark, d):
    from ..operators import layout

    i = fx.images(spark, d).withColumn("image_path", F.format_string("%d_%d", "doc_id", "image_idx"))
    valid = i.select("image_path", (F.col("image_idx") % 5 != 0).alias("is_valid"))
    return images.drop_corrupt(i, valid).select("doc_id", "image_idx", layout.classify_image(F.col("w"), F.col("h"), F.col("page"), F.col("pages"), F.col("y0")).alias("kind"))


@query("merge_readings", f"WITH {READINGS}, {BEST} SELECT p_partkey, CASE WHEN latex <> '' AND score >= 0.6 THEN latex ELSE '' END AS latex, CASE WHEN latex <> '' AND score >= 0.6 THEN score ELSE 0.5::DOUBLE END AS confidence FROM best")
def merge_readings(spark, d):
    part = fx.table(spark, d, "part")
    f = part.selectExpr("p_partkey", "concat('i', p_partkey) as image_path", "'' as latex", "0.5D as confidence")
    read = lambda key: part.select(F.concat(F.lit("i"), "p_partkey").alias("path"), fx.pick(fx.LATEX, key).alias("latex"))
    return images.merge_readings(f, read("p_partkey"), read("p_size")).select("p_partkey", "latex", "confidence")


@query("char_lines")
def char_lines(spark, d):
    """Characters of order lines: small print beside body print."""
    c = fx.order_lines(spark, d).selectExpr("l_orderkey as doc_id", "0 as page", "int(l_linenumber) as char_idx", "l_returnflag as text", "double(l_linenumber * 6) as x0", "double(l_linenumber * 6 + 5) as x1", "double((l_suppkey % 5) * 14 + (l_partkey % 2) * 4) as top", "case when l_partkey % 2 = 0 then 10.0D else 6.0D end as size").selectExpr("*", "top + size as bottom")
    return chars.blocks(chars.lines(c)).select("doc_id", "block_idx", "text", "size")


@query("line_labels_untrained", f"WITH {fx.LINES_SQL} SELECT doc_id, line_idx, 'unknown' AS label FROM lines")
def line_labels(spark, d):
    """Without a trained model every line is unknown."""
    return line_model.predict(ln.lines(fx.table(spark, d, "documents")), None).select("doc_id", "line_idx", "label")
