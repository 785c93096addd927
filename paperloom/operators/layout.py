"""Geometry of pages: images, tables, captions, and blocks cut from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def classify_image(w: Column, h: Column, page: Column, pages: Column, y: Column) -> Column:
    """skip, equation or figure; the first rule that holds decides."""
    area, wide = w * h, w / h
    return (
        F.when((w < 15) | (h < 15) | (area < 500), "skip")
        .when((page == 0) & (y >= 0) & (y < 120) & (area < 20000), "skip")
        .when((page == pages - 1) & ((area < 20000) & (h < 120) | (wide > 1.8) & (h < 80)), "skip")
        .when(h < 120, "equation")
        .when((h < 300) & ((w < 450) | (wide > 2.0)), "equation")
        .when((h >= 100) & (w >= 150) & (area >= 15000), "figure")
        .otherwise("equation")
    )


def drop_recurring(images: DataFrame) -> DataFrame:
    """Without images listed on two pages or more (logos)."""
    often = images.groupBy("doc_id", "xref").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return images.join(often, ["doc_id", "xref"], "left_anti")


def drop_in_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.3) -> DataFrame:
    """Without blocks that a table of the page covers by ``share`` of their area, or whose centre lies in its height."""
    b, t = blocks.alias("b"), tables.alias("t")
    col = F.col
    over = F.greatest(F.lit(0.0), F.least(col("b.x1"), col("t.x1")) - F.greatest(col("b.x0"), col("t.x0"))) * F.greatest(F.lit(0.0), F.least(col("b.y1"), col("t.y1")) - F.greatest(col("b.y0"), col("t.y0")))
    area = (col("b.x1") - col("b.x0")) * (col("b.y1") - col("b.y0"))
    centre = (col("b.y0") + col("b.y1")) / 2
    return b.join(t, (col("b.doc_id") == col("t.doc_id")) & (col("b.page") == col("t.page")) & ((area > 0) & (over >= share * area) | centre.between(col("t.y0"), col("t.y1"))), "left_anti")


def caption_override(images: DataFrame, blocks: DataFrame, distance: float = 80.0) -> DataFrame:
    """An equation with a figure caption close above or below is a figure."""
    captions = blocks.where(F.col("text").rlike(r"(?i)^\s*(figure|fig\.)\s*\d+")).select("doc_id", "page", F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    near = images.join(captions, ["doc_id", "page"]).where(F.least(F.abs(F.col("c0") - F.col("y1")), F.abs(F.col("y0") - F.col("c1"))) <= distance).select("doc_id", "image_idx").distinct().withColumn("near", F.lit(True))
    return images.join(near, ["doc_id", "image_idx"], "left").withColumn("kind", F.when((F.col("kind") == "equation") & F.col("near"), "figure").otherwise(F.col("kind"))).drop("near")


def cap_regions(regions: DataFrame, per_page: int = C.PER_PAGE, per_doc: int = C.PER_DOCUMENT) -> DataFrame:
    """At most so many regions a page, then a document, in reading order."""
    page = Window.partitionBy("doc_id", "page").orderBy("y0", "region_idx")
    doc = Window.partitionBy("doc_id").orderBy("page", "y0", "region_idx")
    first = regions.withColumn("r", F.row_number().over(page)).where(F.col("r") <= per_page)
    return first.withColumn("r", F.row_number().over(doc)).where(F.col("r") <= per_doc).drop("r")


def split_blocks(lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Runs of lines: a large gap, or a formula between two lines, starts a run.

    A gap is large above max(1.6 * upper median line height, 14); lines without height do not count, and with
    none left the height is 12.  spans: doc_id, page, y0, y1 of formulas; lines then need a page.
    """
    w = Window.partitionBy("doc_id", "block_idx").orderBy("line_idx")
    all_ = Window.partitionBy("doc_id", "block_idx")
    height = F.col("y1") - F.col("y0")
    heights = F.sort_array(F.collect_list(F.when(height > 0, height)).over(all_))
    median = F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(12.0))
    before = F.lag("y1").over(w)
    cut = F.coalesce(F.col("y0") - before, F.lit(0.0)) > F.greatest(1.6 * median, F.lit(14.0))
    if spans is not None:
        # A page holds few formulas, so they travel as an array with each of its lines.
        held = spans.groupBy("doc_id", "page").agg(F.collect_list(F.struct("y0", "y1")).alias("__spans"))
        lines = lines.join(held, ["doc_id", "page"], "left")
        within = lambda s: (s["y0"] >= F.col("__before")) & (s["y1"] <= F.col("y0"))
        meets = lambda s: (s["y0"] < F.col("y0")) & (s["y1"] > F.col("__before")) & (s["y1"] > s["y0"])
        crossed = (F.col("__before") < F.col("y0")) & F.exists("__spans", lambda s: within(s) | meets(s))
        lines = lines.withColumn("__before", before).withColumn("__crossed", F.coalesce(crossed, F.lit(False)))
        cut = cut | F.col("__crossed")
    marked = lines.withColumn("cut", cut.cast("int"))
    return marked.withColumn("run", F.sum("cut").over(w)).drop("cut", "__before", "__crossed", "__spans")


def join_runs(lines: DataFrame) -> DataFrame:
    """One block a run: text by line, union of boxes, commonest size and, where lines have one, font (the smaller of equals)."""
    modes = [F.mode(c, True).alias(c) for c in ("size", "font") if c in lines.columns]
    return lines.groupBy("doc_id", "block_idx", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *modes, F.count(F.lit(1)).alias("n_lines"),
    )


def match_nearest(left: DataFrame, right: DataFrame, most: float | None = 50.0, by: str = "y") -> DataFrame:
    """(doc_id, page, left_idx, right_idx): greedy one-to-one by distance in y, left in order of ``by``, the first right in that order on ties.

    Items of one page are few; pages are folded where they lie, with the used ones as state.
    """
    a = left.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys((by, "y", "idx"))))).alias("l"))
    b = right.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y", "idx"))).alias("r"))
    zero = F.expr("cast(array() as array<struct<l: int, r: int>>)")

    def step(done: Column, x: Column) -> Column:
        free = F.filter("r", lambda z: ~F.exists(done, lambda u: u["r"] == z["idx"]))
        near = F.transform(free, lambda z: F.struct(F.abs(z["y"] - x["y"]).alias("d"), *[z[c].alias(c) for c in dict.fromkeys((by, "y", "idx"))]))
        best = F.array_min(near)
        ok = best.isNotNull() & (F.lit(True) if most is None else best["d"] <= most)
        return F.when(ok, F.concat(done, F.array(F.struct(x["idx"].alias("l"), best["idx"].alias("r"))))).otherwise(done)

    return a.join(b, ["doc_id", "page"]).select("doc_id", "page", F.explode(F.aggregate("l", zero, step)).alias("m")).select("doc_id", "page", F.col("m.l").alias("left_idx"), F.col("m.r").alias("right_idx"))
