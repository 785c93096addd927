"""Images of pages, cell grids, equation numbers and formula regions as relations; pixels stay with a backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import latex as L
from ..functions import mathtext as M
from ..functions import text as T
from . import layout

EQUATION_NUMBER = r"^\s*\((\d+(?:\.\d+)?)\)\s*$"


def overlap(a: str, b: str) -> Column:
    """Common area of the boxes of two aliases."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def page_images(listings: DataFrame, rendered: DataFrame, placed: DataFrame, captions: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page, image_idx, xref, kind (figure, equation), x0, y0, x1, y1: the images of pages.

    A listing takes its rendered box, else its placement, else 72/150 of its pixels (no box).  Repeated
    listings of a page, images of under 100 bytes, logos, skipped kinds, equations in tables, and
    boxless equations on pages with tables go.
    """
    key = ["doc_id", "page", "xref"]
    box = lambda d, p: d.groupBy(*key).agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias(p))
    first = layout.drop_recurring(listings).groupBy(*key).agg(F.min_by(F.struct("image_idx", "pages", "width_px", "height_px", "n_bytes"), "image_idx").alias("i")).select(*key, "i.*").where("n_bytes >= 100")
    j = first.join(box(rendered, "r"), key, "left").join(box(placed, "p"), key, "left").withColumn("b", F.coalesce("r", "p"))
    w, h = F.coalesce(F.col("b.x1") - F.col("b.x0"), F.col("width_px") * 72.0 / 150.0), F.coalesce(F.col("b.y1") - F.col("b.y0"), F.col("height_px") * 72.0 / 150.0)
    k = j.withColumn("kind", layout.classify_image(w, h, F.col("page"), F.col("pages"), F.coalesce("b.y0", F.lit(0.0)))).select(*key, "image_idx", "kind", "b.*").where("kind <> 'skip'")
    k = layout.caption_override(k, captions)
    equation = k.where("kind = 'equation'")
    boxless = equation.where("x0 is null").join(tables.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    free = layout.drop_in_tables(equation.where("x0 is not null"), tables)
    return k.where("kind = 'figure'").unionByName(boxless).unionByName(free)


def drop_headers(images: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Without small images in the top fifth of the first page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.where(~((F.col("page") == 0) & (F.col("y0") < 0.2 * page_height) & (w * h < 50000) & (h < 200)))


def records(images: DataFrame, kind: str) -> DataFrame:
    """Figure or equation records with their labels; an equation waits for recognition with confidence 0.5."""
    label = F.format_string(f"{'fig' if kind == 'figure' else 'eq'}_%d_%d", "page", "image_idx")
    base = images.where(F.col("kind") == kind).select("doc_id", "page", label.alias("label"), F.concat(label, F.lit(".png")).alias("image_path"), F.coalesce("y0", F.lit(0.0)).alias("bbox_y"))
    return base.withColumn("caption", F.lit("")) if kind == "figure" else base.withColumn("latex", F.lit("")).withColumn("confidence", F.lit(0.5)).withColumn("equation_number", F.lit(""))


def drop_corrupt(rows: DataFrame, validity: DataFrame) -> DataFrame:
    """Without rows whose image is known to be corrupt."""
    return rows.join(validity.where("not is_valid").select("image_path").distinct(), "image_path", "left_anti")


# ---- equation numbers and regions ------------------------------------------------------------------


def equation_numbers(blocks: DataFrame) -> DataFrame:
    """doc_id, page, idx, y, number: blocks that are nothing but (n) or (n.m)."""
    return blocks.where(F.col("text").rlike(EQUATION_NUMBER)).select("doc_id", "page", F.col("block_idx").alias("idx"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.regexp_extract("text", EQUATION_NUMBER, 1).alias("number"))


def line_numbers(blocks: DataFrame) -> DataFrame:
    """doc_id, page, idx, y, number, sibling: (n) alone on a line, or at the end of a line of under 80 characters.

    ``sibling``: another line of the block holds an operator, so that the text carries the equation.
    """
    line = T.strip(F.col("line"))
    lines = blocks.select("doc_id", "page", "block_idx", "y0", "y1", F.split("text", "\n").alias("all"), F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    alone = line.rlike(EQUATION_NUMBER)
    number = F.when(alone, F.regexp_extract(line, EQUATION_NUMBER, 1)).when(F.length(line) < 80, F.regexp_extract(line, r"\s\((\d{1,3})\)\s*$", 1))
    other = F.exists(F.filter("all", lambda v: T.strip(v) != line), lambda v: v.rlike("[=<>≤≥≈∼⊗⊕±×÷∈∉]"))
    found = lines.select("doc_id", "page", (F.col("block_idx") * 10000 + F.col("line_idx")).alias("idx"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), number.alias("number"), alone.alias("alone"), other.alias("sibling"))
    return found.where("number <> ''")


def number_formulas(formulas: DataFrame, numbers: DataFrame, most: float = 80.0) -> DataFrame:
    """Formulas (doc_id, page, idx, y, h) with equation_number: greedy, nearest first free number of the page
    within ``most`` and half the formula's height, formulas in order of their top.
    """
    n = numbers.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "y", "number"))).alias("n"))
    f = formulas.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "idx", "h"))).alias("f"))
    zero = F.expr("cast(array() as array<struct<f: int, n: int, number: string>>)")

    def step(done: Column, x: Column) -> Column:
        centre, reach = x["y"] + F.greatest(x["h"], F.lit(0.0)) / 2, most + F.greatest(x["h"], F.lit(0.0)) / 2
        near = F.array_min(F.transform(F.filter("n", lambda z: ~F.exists(done, lambda u: u["n"] == z["idx"])), lambda z: F.struct(F.abs(centre - z["y"]).alias("d"), z["idx"].alias("idx"), z["number"].alias("number"))))
        return L.let(near, lambda b: F.when(b.isNotNull() & (b["d"] <= reach), F.concat(done, F.array(F.struct(x["idx"].cast("int").alias("f"), b["idx"].cast("int").alias("n"), b["number"].alias("number"))))).otherwise(done))

    matched = f.join(n, ["doc_id", "page"]).select("doc_id", "page", F.explode(F.aggregate("f", zero, step)).alias("m")).select("doc_id", "page", F.col("m.f").alias("idx"), F.col("m.number").alias("equation_number"))
    return formulas.join(matched, ["doc_id", "page", "idx"], "left").withColumn("equation_number", F.coalesce("equation_number", F.lit("")))


def unmatched_regions(blocks: DataFrame, formulas: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Crops around numbers that no formula took, or one whose image is under 2000 square points.

    doc_id, page, number, x0, y0, x1, y1: 50 above to 15 below, margins of 70; numbers whose block holds the equation as text are left out.
    """
    alone = line_numbers(blocks).where("alone and not sibling")
    area = F.col("h") * F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("h"))
    large = formulas.where((F.col("equation_number") != "") & ~((F.col("h") > 0) & (area < 2000))).select("doc_id", F.col("equation_number").alias("number")).distinct()
    once = alone.join(large, ["doc_id", "number"], "left_anti").groupBy("doc_id", "number").agg(F.min(F.struct("page", "y")).alias("a"))
    return once.select("doc_id", "a.page", "number", F.lit(70.0).alias("x0"), F.greatest(F.lit(0.0), F.col("a.y") - 50).alias("y0"), F.lit(page_width - 70.0).alias("x1"), (F.col("a.y") + 15).alias("y1"))


def formula_regions(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks (doc_id, page, block_idx, text, fonts, box) that look like formulas, outside tables, at most six a page and twenty a document."""
    t = T.strip(F.col("text"))
    n = M.counted(t, C.MATH_CLASS)
    font = F.exists("fonts", lambda f: T.contains_any(F.lower(f), C.MATH_FONTS))
    like = (n >= C.MIN_MATH) & (n / F.length(t) >= C.MIN_MATH_SHARE) | (n >= 2) & font
    size = (F.col("x1") - F.col("x0") >= C.MIN_REGION_W) & (F.col("y1") - F.col("y0") >= C.MIN_REGION_H)
    found = blocks.where((t != "") & (F.length(t) <= C.MAX_REGION_CHARS) & ~t.rlike(EQUATION_NUMBER) & like & size)
    if tables is not None:
        found = layout.drop_in_tables(found, tables, 0.5)
    return layout.cap_regions(found.withColumn("region_idx", F.col("block_idx"))).drop("region_idx")


# ---- cells and recognised formulas ------------------------------------------------------------------


def cell_grid(cells: DataFrame) -> DataFrame:
    """Cell boxes (doc_id, page, table_idx, x0, y0, x1, y1) with row_idx and col_idx: ranks of rounded tops and lefts."""
    w = Window.partitionBy("doc_id", "page", "table_idx")
    rank = lambda c: F.dense_rank().over(w.orderBy(F.round(c, 1))) - 1
    return cells.withColumn("row_idx", rank("y0")).withColumn("col_idx", rank("x0"))


def mark_cells(grid: DataFrame, images: DataFrame) -> DataFrame:
    """Cells that hold 30 % of an image or more get a \\CELLIMG marker, and a crop box inset by two points."""
    c, i = grid.alias("c"), images.alias("i")
    area = F.greatest((F.col("i.x1") - F.col("i.x0")) * (F.col("i.y1") - F.col("i.y0")), F.lit(1.0))
    hit = c.join(i, (F.col("c.doc_id") == F.col("i.doc_id")) & (F.col("c.page") == F.col("i.page")) & (overlap("c", "i") > 0) & (overlap("c", "i") / area >= 0.3), "left_semi")
    path = F.concat(F.format_string("tcell_%d_%d_%d_%d", "page", "table_idx", "row_idx", "col_idx"), F.lit(".png"))
    crop = F.struct(F.least(F.col("x0") + 2, "x1").alias("x0"), F.least(F.col("y0") + 2, "y1").alias("y0"), F.greatest(F.col("x1") - 2, "x0").alias("x1"), F.greatest(F.col("y1") - 2, "y0").alias("y1"))
    return hit.withColumn("image_path", path).withColumn("marker", F.concat(F.lit("\\CELLIMG{"), F.col("image_path"), F.lit("}"))).withColumn("crop", crop)


def _best(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows with ``best`` (engine, latex, score) of two engines' readings of their image; a missing reading is empty."""
    reading = lambda d, n: d.groupBy(F.col("path").alias("image_path")).agg(F.min("latex").alias(n))
    j = rows.join(reading(first, "__a"), "image_path", "left").join(reading(second, "__b"), "image_path", "left")
    return j.withColumn("best", L.pick_best(F.coalesce("__a", F.lit("")), F.coalesce("__b", F.lit("")))).drop("__a", "__b")


def merge_readings(formulas: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Formulas with an image and no LaTeX take the better reading if its score reaches 0.60."""
    j = _best(formulas, first, second)
    take = (F.col("latex") == "") & (F.col("image_path") != "") & (F.col("best.latex") != "") & (F.col("best.score") >= C.OCR_BLOCK)
    return j.withColumn("confidence", F.when(take, F.col("best.score")).otherwise(F.col("confidence"))).withColumn("latex", F.when(take, F.col("best.latex")).otherwise(F.col("latex"))).drop("best")


def merge_cell_readings(cells: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells that are an image marker become \\CELLEQ{latex||IMG:path} if the better reading's score reaches 0.40."""
    path = F.regexp_extract(F.trim("cell"), r"^\\CELLIMG\{(.+?)\}$", 1)
    j = _best(cells.withColumn("image_path", F.when(path != "", path)), first, second)
    take = F.col("image_path").isNotNull() & (F.col("best.latex") != "") & (F.col("best.score") >= C.OCR_CELL)
    marker = F.concat(F.lit("\\CELLEQ{"), F.col("best.latex"), F.lit("||IMG:"), F.col("image_path"), F.lit("}"))
    return j.withColumn("cell", F.when(take, marker).otherwise(F.col("cell"))).drop("best", "image_path")
