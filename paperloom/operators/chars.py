"""Characters of pages to lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latex import let

PAGE = ("doc_id", "page")


def page_measures(chars: DataFrame) -> DataFrame:
    """doc_id, page, width, height, body: mean character width and height, commonest size (the smaller of equals).

    Pages without a character of sensible width are left out.
    """
    w, h, s = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), F.round("size", 0)
    got = chars.groupBy(*PAGE).agg(
        F.avg(F.when((w > 0.5) & (w < 30), w)).alias("width"), F.coalesce(F.avg(F.when((h > 2) & (h < 50), h)), F.lit(12.0)).alias("height"), F.coalesce(F.mode(F.when(s > 0, s), True), F.lit(11.0)).alias("body")
    )
    return got.where("width is not null")


def assign_lines(chars: DataFrame) -> DataFrame:
    """Characters with line (top of the line they belong to), role (body, sub, super), width and height.

    Lines of small print join the nearest line of body print within 0.8 line heights; a page's tops are
    few, so the nearest one is looked up in the page's array of them.
    """
    c = chars.join(page_measures(chars), [*PAGE]).withColumn("y", F.round("top", 1))
    tops = c.groupBy(*PAGE, "y").agg((F.avg("size") < 0.8 * F.first("body")).alias("small"), F.first("height").alias("h"))
    full = tops.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(~F.col("small"), F.col("y")))).alias("full"))
    near = F.array_min(F.transform(F.filter("full", lambda p: F.abs(p - F.col("y")) < 0.8 * F.col("h")), lambda p: F.struct(F.abs(p - F.col("y")).alias("d"), p.alias("p"))))["p"]
    placed = tops.join(full, [*PAGE]).select(*PAGE, "y", F.when(F.col("small"), near).alias("parent"))
    role = F.when(F.col("parent").isNull(), "body").when(F.col("y") > F.col("parent"), "sub").otherwise("super")
    return c.join(placed, [*PAGE, "y"]).withColumn("line", F.coalesce("parent", "y")).withColumn("role", role).drop("parent", "body", "y")


def lines(chars: DataFrame) -> DataFrame:
    """doc_id, page, line_idx, y, size, height, text: a blank where the gap exceeds 0.4 character widths; small print as $base_{..}$."""
    order = Window.partitionBy(*PAGE, "line").orderBy("x0", "char_idx")
    c = assign_lines(chars.where("text <> ''"))
    c = c.withColumn("gap", F.coalesce(F.col("x0") - F.lag("x1").over(order) > 0.4 * F.col("width"), F.lit(False)))
    c = c.withColumn("before", F.lag("role").over(order))
    # A blank between small characters ends their run, as does a change of role.
    c = c.withColumn("run", F.sum((F.col("gap") | F.coalesce(F.col("role") != F.col("before"), F.lit(True))).cast("int")).over(order))
    runs = c.groupBy(*PAGE, "line", "run").agg(F.first("role").alias("role"), F.max("gap").alias("gap"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "char_idx", "text"))), lambda t: t["text"]), "").alias("t"),
        F.sum(F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))).alias("hs"), F.sum((F.col("bottom") > F.col("top")).cast("int")).alias("n"), F.first("height").alias("height"))

    def step(s: Column, r: Column) -> Column:
        base = F.concat(s, F.when(r["gap"], " ").otherwise(""))

        def put(v: Column) -> Column:
            last = F.substr(v, F.length(v), F.lit(1))
            based = (v != "") & ~last.isin(" ", "\n")
            script = F.concat(F.lit("$"), F.when(based, last).otherwise(""), F.when(r["role"] == "sub", "_").otherwise("^"), F.lit("{"), F.trim(r["t"]), F.lit("}$"))
            return F.when(r["role"] == "body", F.concat(v, r["t"])).otherwise(F.concat(F.when(based, F.substr(v, F.lit(1), F.length(v) - 1)).otherwise(v), script))

        return let(base, put)

    size = F.round(F.coalesce(F.sum("hs") / F.sum("n"), F.first("height")), 1)
    made = runs.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("run", "role", "gap", "t"))).alias("r"), size.alias("size"), F.first("height").alias("height"))
    made = made.select(*PAGE, F.col("line").alias("y"), "size", "height", F.trim(F.aggregate("r", F.lit(""), step)).alias("text")).where("text <> ''")
    return made.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("y")) - 1).alias("line_idx"), "y", "size", "height", "text")


def blocks(lines_: DataFrame) -> DataFrame:
    """doc_id, page, block_idx, text, size, y0, y1: a gap over 1.5 mean heights starts a block; the largest size counts."""
    w = Window.partitionBy(*PAGE).orderBy("line_idx")
    cut = F.coalesce(F.col("y") - F.lag("y").over(w) > 1.5 * F.col("height"), F.lit(False)).cast("int")
    m = lines_.withColumn("cut", cut).withColumn("block_idx", F.sum("cut").over(w).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda t: t["text"]), "\n")
    return m.groupBy(*PAGE, "block_idx").agg(text.alias("text"), F.max("size").alias("size"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def document_text(blocks_: DataFrame, order: str = "block_idx") -> DataFrame:
    """doc_id, text: blocks of a page on lines of their own, pages apart by a blank line."""
    pages = blocks_.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda t: t["text"]), "\n").alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda p: p["t"]), "\n\n").alias("text"))
