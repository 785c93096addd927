"""Lines of documents, and runs of lines that a cleaner drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import mathtext as M
from ..functions import text as T
from ..functions.latex import let


BY = ("doc_id",)  # what tells texts apart; with more columns, a document's texts stay on its partition


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, line_idx, line: every line, dense ordinals."""
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


def islands(rows: DataFrame, member: Column, least: int, by: tuple = BY) -> DataFrame:
    """Without runs of at least ``least`` consecutive member lines of a document."""
    w = Window.partitionBy(*by).orderBy("line_idx")
    marked = rows.withColumn("__in", member.cast("int")).withColumn("__run", F.sum(1 - F.col("__in")).over(w))
    size = F.sum("__in").over(Window.partitionBy(*by, "__run"))
    return marked.withColumn("__size", size).where((F.col("__in") == 0) | (F.col("__size") < least)).drop("__in", "__run", "__size")


def drop_char_lines(rows: DataFrame, by: tuple = BY) -> DataFrame:
    """Without runs of four or more lines of at most three characters."""
    return islands(rows, F.length(T.strip(F.col("line"))) <= 3, 4, by)


def squeeze(x: Column) -> Column:
    return T.one_blank(F.lower(T.strip(x)), r"\s")


def drop_headers(rows: DataFrame, title: Column, by: tuple = BY) -> DataFrame:
    """Without lines that repeat the title (a squeezed column of the rows), and the blank, number, ISSN and URL lines after them."""
    y, t = F.col("__y"), title
    header = (F.length(t) >= 3) & ((y == t) | (F.length(t) >= 5) & (F.length(y) < F.length(t) + 10) & y.contains(t))
    may = F.lit("0123456789ih").contains(F.substring(y, 1, 1))  # of a blank line too
    follows = may & ((y == "") | y.rlike(r"^\d{1,3}\.\s*$") | y.rlike(r"^issn\s*[\d-]+") | y.rlike("^https?://"))
    w = Window.partitionBy(*by).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    # The last line that is not a follower decides for the followers after it.
    decided = rows.withColumn("__y", squeeze(F.col("line"))).withColumns({"__h": F.coalesce(header, F.lit(False)), "__f": follows}).drop("__y")
    decided = decided.withColumn("__last", F.last(F.when(~F.col("__f") | F.col("__h"), F.col("__h")), ignorenulls=True).over(w))
    return decided.where(~F.coalesce(F.col("__last") & (F.col("__f") | F.col("__h")), F.lit(False))).drop("__h", "__f", "__last")


def drop_running_headers(rows: DataFrame, titles: DataFrame, by: tuple = BY) -> DataFrame:
    """The same for titles by document."""
    joined = rows.join(titles.select("doc_id", squeeze(F.col("title")).alias("__title")), "doc_id")
    return drop_headers(joined, F.col("__title"), by).drop("__title")


def gather(rows: DataFrame, name: str = "text", by: tuple = BY) -> DataFrame:
    """doc_id and its lines joined again, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda z: z["line"])
    return rows.groupBy(*by).agg(F.array_join(ordered, "\n").alias(name))


def scatter(texts: DataFrame, by: tuple = BY) -> DataFrame:
    return texts.select(*by, F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))


def drop_runs(rows: DataFrame, core: Column, bridge: Column, least: int, count_bridges: bool, by: tuple = BY) -> DataFrame:
    """Without runs of core lines and the bridge lines after them that hold ``least`` lines or more.

    ``bridge`` may name ``__core``, whether a line is a core line.
    """
    w = Window.partitionBy(*by).orderBy("line_idx")
    marked = rows.withColumn("__core", core).withColumn("__in", (F.col("__core") | F.coalesce(bridge, F.lit(False))).cast("int"))
    marked = marked.withColumn("__run", F.sum(1 - F.col("__in")).over(w))
    counted = F.col("__in") if count_bridges else F.col("__core").cast("int")
    size = F.sum(counted).over(Window.partitionBy(*by, "__run"))
    return marked.withColumn("__size", size).where((F.col("__in") == 0) | (F.col("__size") < least)).drop("__core", "__in", "__run", "__size")


def drop_garbled(rows: DataFrame, by: tuple = BY) -> DataFrame:
    """Without blocks of three garbled lines or more; one blank line at a time belongs to a block."""
    w = Window.partitionBy(*by).orderBy("line_idx")
    return drop_runs(rows, M.garbled(F.col("line")), (T.strip(F.col("line")) == "") & F.lag("__core").over(w), 3, False, by)


def drop_fragments(rows: DataFrame, by: tuple = BY) -> DataFrame:
    """Without blocks of three lines or more that are equation fragments, or blank after one."""
    w = Window.partitionBy(*by).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    blank = T.strip(F.col("line")) == ""
    return drop_runs(rows, M.fragment(F.col("line")), blank & F.last(F.when(~blank, F.col("__core")), ignorenulls=True).over(w), 3, True, by)


def drop_captions(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """Without lines that hold the first 40 characters of a table caption (of 20 or more) of their document."""
    heads = captions.where(F.length("caption") >= 20).select(F.col("doc_id").alias("__doc"), T.strip(F.substring("caption", 1, 40)).alias("__head")).distinct()
    return rows.join(heads, (F.col("doc_id") == F.col("__doc")) & F.col("line").contains(F.col("__head")), "left_anti")


def merge_orphans(x: Column) -> Column:
    """Text whose orphaned symbol lines join a neighbour: the line before, or the next one if a number
    fits nothing before it or nothing stands before; after a blank line they go.

    An ordered fold, as a merged line decides about the one after it.
    """
    split = F.split(x, "\n", -1)
    pairs = F.transform(split, lambda l, i: F.struct(l.alias("line"), F.get(split, i + 1).alias("next")))
    dangling = r"(?:^|\s|\()[a-zA-Z]\s*$|[a-zA-Z]\s*\)\s*$"

    def state(out: Column, carry: Column) -> Column:
        return F.struct(out.alias("out"), carry.alias("carry"))

    def joined(prev: Column, t: Column) -> Column:
        gap = r"(?s)^(.*)  (.*)$"
        inner = F.concat_ws(" ", F.regexp_extract(prev, gap, 1), t, F.ltrim(F.regexp_extract(prev, gap, 2)))
        return F.when(prev.endswith("-"), F.concat(F.substr(prev, F.lit(1), F.length(prev) - 1), t)).when(prev.contains("  "), inner).otherwise(F.concat_ws(" ", prev, t))

    def step(s: Column, p: Column) -> Column:
        line = F.when(s["carry"] != "", F.concat_ws(" ", s["carry"], F.ltrim(p["line"]))).otherwise(p["line"])
        facts = F.struct(line.alias("y"), T.strip(line).alias("t"), M.orphan(line).alias("o"), F.rtrim(F.get(s["out"], F.size(s["out"]) - 1)).alias("prev"))

        def move(f: Column) -> Column:
            keep, none = F.concat(s["out"], F.array(f["y"])), F.lit("")
            down = f["t"].rlike(r"^[\p{Nd} ]+$") & (F.trim(F.coalesce(p["next"], none)) != "") & ~f["prev"].rlike(dangling)
            up = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(joined(f["prev"], f["t"])))
            return (
                F.when(~f["o"] | f["prev"].isNull() & p["next"].isNull(), state(keep, none))
                .when(f["prev"].isNull() | (f["prev"] != "") & down, state(s["out"], f["t"]))
                .when(f["prev"] == "", state(s["out"], none))
                .otherwise(state(up, none))
            )

        return let(facts, move)

    folded = F.aggregate(pairs, state(F.expr("cast(array() as array<string>)"), F.lit("")), step)
    return F.when(F.exists(split, M.orphan), F.array_join(folded["out"], "\n")).otherwise(x)


def display(body: Column) -> Column:
    """The lines of a numbered equation: label, environment, trailing word."""
    opening = r"(?i)^((?:Prior|Likelihood|Posterior|Prediction|where|and|with|s\.t\.|subject\s+to)\s*:?\s*)"
    label = T.strip(F.regexp_extract(body, opening, 1))
    y = F.regexp_replace(F.regexp_replace(body, opening, ""), "([a-zA-Z])⊤", r"$1^{\\top}")
    y = T.replace_all(y, (("⊤", r"^{\top}"), ("⊥", r"\perp"), *C.GREEK, *((k, v.strip("$")) for k, v in C.SYMBOLS)))
    y = F.regexp_replace(F.regexp_replace(y, f"({M.UP}+)", "^{$1}"), f"({M.DOWN}+)", "_{$1}")
    y = F.translate(y, C.SUPERSCRIPTS + C.SUBSCRIPTS, C.SUPERSCRIPT_VALUES + C.SUBSCRIPT_VALUES)
    y = F.regexp_replace(F.regexp_replace(y, r"¯\s*([a-zA-Z])", r"\\bar{$1}"), "([a-zA-Z])\u0303", r"\\tilde{$1}")
    tail = r"(?i),?\s*\b(where|and|with)\s*$"

    def made(v: Column) -> Column:
        inner = T.strip(F.regexp_replace(v, tail, ""))
        free = r"(?<![a-zA-Z\\{_])"
        words = rf"(?!(?i:{'|'.join(C.SUBSCRIPT_WORDS)})(?![a-zA-Z]))"
        inner = F.regexp_replace(inner, rf"{free}{words}([a-zA-Z])([ijklmnpqrs]{{2,3}})(?![a-zA-Z{{}}])", "$1_{$2}")
        inner = F.regexp_replace(inner, rf"{free}([A-Za-z])(\d{{1,3}})(?![a-zA-Z0-9{{}}])", "$1_{$2}")
        inner = F.regexp_replace(inner, r"\$([^$]+)\$", "$1")
        word = F.regexp_extract(v, tail, 1)
        return F.concat_ws("\n", F.lit(""), F.when(label != "", label), F.lit("\\begin{equation}"), F.concat(F.lit("  "), inner), F.lit("\\end{equation}"), F.when(word != "", word), F.lit(""))

    return let(y, made)


def number_equations(rows: DataFrame, by: tuple = BY) -> DataFrame:
    """Lines that end in an equation number as display equations.

    A number alone on its line takes the last written line before it if that is a short equation; else
    the number goes.  Lines fall into groups of one written line and the blanks and lone numbers after it.
    """
    y = T.strip(F.col("line"))
    lone = y.rlike(r"^\(\d{1,3}\)$")
    written = (y != "") & ~lone
    w = Window.partitionBy(*by).orderBy("line_idx")
    group = Window.partitionBy(*by, "__g")
    symbols = lambda b: M.counted(b, T.high(C.EQUATION_SYMBOLS))

    def equation(b: Column) -> Column:
        real = T.real_words(b)
        return (b != "") & ((symbols(b) >= 1) | b.rlike("[=∼~≤≥<>]")) & ~((real >= 2) & (real >= 0.4 * F.size(F.split(b, r"\s+"))))

    def bare_equation(b: Column) -> Column:
        prose = b.rlike(r"(?i)\b(as|when|that|where|the|a|an|is|are|of|in|on|for|to|by|with)\s*$")
        return (F.length(b) < 60) & ((symbols(b) >= 1) | b.contains("=")) & (T.real_words(b) <= 1) & ~prose

    m = rows.withColumn("__y", y).withColumn("__lone", lone).withColumn("__w", written)
    # Only what ends in a parenthesis can end in a number.
    m = m.withColumn("__body", F.when(F.col("__w"), F.when(F.col("__y").endswith(")"), T.strip(F.regexp_extract("__y", r"^(.*?)\s*\((\d{1,3})\)\s*$", 1))).otherwise(""))).withColumn("__conv", equation(F.coalesce("__body", F.lit(""))))
    m = m.withColumn("__g", F.sum(F.col("__w").cast("int")).over(w))
    m = m.withColumn("__head", F.max(F.when(F.col("__w"), F.col("__y"))).over(group)).withColumn("__hconv", F.max(F.when(F.col("__w"), F.col("__conv"))).over(group))
    m = m.withColumn("__take", F.max("__lone").over(group) & F.coalesce(bare_equation(F.col("__head")) & ~F.col("__hconv"), F.lit(False)))
    m = m.withColumn("__nth", F.sum(F.col("__lone").cast("int")).over(group.orderBy("line_idx"))).where(~F.col("__lone") | F.col("__take") & (F.col("__nth") == 1))
    line = (
        F.when(F.col("__conv"), display(F.col("__body")))
        .when(F.col("__w") & F.col("__take"), "")
        .when(F.col("__lone"), F.when(equation(F.col("__head")), display(F.col("__head"))).otherwise(F.col("__y")))
        .otherwise(F.col("line"))
    )
    return m.withColumn("line", line).drop("__y", "__lone", "__w", "__body", "__conv", "__g", "__head", "__hconv", "__take", "__nth")


def clean_with_math(texts: DataFrame, by: tuple = BY) -> DataFrame:
    """doc_id, text: the basic clean, numbered equations, then symbols, scripts and formulas."""
    rows = number_equations(scatter(texts.select(*by, T.basic_clean(F.col("text")).alias("text")), by), by)
    return gather(rows, by=by).select(*by, M.after_equations(F.col("text")).alias("text"))


def normalise_bodies(bodies: DataFrame, titles: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """doc_id, text cleaned in the fixed order: headers, char lines, captions, orphans, garbage, fragments, mathematics.

    Every step keeps the partitioning by doc_id, so that one shuffle serves them all.
    """
    rows = drop_char_lines(drop_running_headers(scatter(bodies), titles))
    return _merged(rows if captions is None else drop_captions(rows, captions), BY)


def normalise_texts(texts: DataFrame, by: tuple) -> DataFrame:
    """The same for rows that carry their title, names and captions (array) beside the text; no join."""
    rows = texts.select(*by, squeeze(F.col("title")).alias("__t"), squeeze(F.col("names")).alias("__n"), "captions", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))
    rows = drop_char_lines(drop_headers(drop_headers(rows, F.col("__t"), by), F.col("__n"), by), by)
    heads = F.transform(F.filter("captions", lambda c: F.length(c) >= 20), lambda c: T.strip(F.substring(c, 1, 40)))
    return _merged(rows.where(~F.coalesce(F.exists(heads, lambda h: F.col("line").contains(h)), F.lit(False))), by)


def _merged(rows: DataFrame, by: tuple) -> DataFrame:
    merged = gather(rows, by=by).select(*by, merge_orphans(F.col("text")).alias("text"))
    return clean_with_math(gather(drop_fragments(drop_garbled(scatter(merged, by), by), by), by=by), by)
