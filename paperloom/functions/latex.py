"""Expressions over LaTeX: repair and score of recognised formulas, escaping, table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import contains_any, let, strip


def count(x: Column, part: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def balance_braces(x: Column) -> Column:
    """Missing closing braces at the end, missing opening ones at the start."""

    def fixed(v: Column) -> Column:
        d = count(v, "{") - count(v, "}")
        return F.when(d > 0, F.concat(v, F.repeat(F.lit("}"), d))).when(d < 0, F.concat(F.repeat(F.lit("{"), -d), v)).otherwise(v)

    return let(x, fixed)


def balance_delimiters(x: Column) -> Column:
    def fixed(v: Column) -> Column:
        left, right = F.regexp_count(v, F.lit(r"\\left(?![a-zA-Z])")), F.regexp_count(v, F.lit(r"\\right(?![a-zA-Z])"))
        return F.when(left > right, F.concat(v, F.repeat(F.lit(r"\right."), left - right))).when(right > left, F.concat(F.repeat(F.lit(r"\left."), right - left), v)).otherwise(v)

    return let(x, fixed)


def fix_array(x: Column) -> Column:
    """The first array's column specification follows its widest row."""
    whole = r"(?s)^(.*?\\begin\{array\})\{[^}]*\}((.*?)\\end\{array\}.*)$"

    def fixed(v: Column) -> Column:
        body = F.regexp_extract(v, whole, 3)
        widest = F.array_max(F.transform(F.split(body, r"\\\\"), lambda r: count(r, "&"))) + 1
        return F.when(v.rlike(whole), F.concat(F.regexp_extract(v, whole, 1), F.lit("{"), F.repeat(F.lit("c"), widest), F.lit("}"), F.regexp_extract(v, whole, 2))).otherwise(v)

    return let(x, fixed)


def is_safe(x: Column) -> Column:
    """At least two characters, braces never close too early and all close, environments pair."""
    move = lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    step = lambda s, c: F.struct((s["d"] + move(c)).alias("d"), F.least(s["m"], s["d"] + move(c)).alias("m"))

    def safe(v: Column) -> Column:
        depth = F.aggregate(F.split(v, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)
        return (F.length(v) >= 2) & let(depth, lambda d: (d["d"] == 0) & (d["m"] >= 0)) & (count(v, r"\begin{") == count(v, r"\end{"))

    return let(x, safe)


def sanitize(x: Column) -> Column:
    return let(balance_delimiters(balance_braces(fix_array(x))), lambda y: F.when(is_safe(y), y).otherwise(""))


def score(x: Column) -> Column:
    """0 to 1: plausibility of a recognised formula, as rewards and penalties from one half."""
    return let(F.coalesce(x, F.lit("")), _score)


def _score(y: Column) -> Column:
    n = F.length(y)
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda t, v: t + F.length(v))
    share = lambda a: total(a) / F.greatest(n, F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(y, r"\\[a-zA-Z]+", ""), r"[{}\[\]()^_$\\]", "")
    roman = F.regexp_extract_all(y, F.lit(r"\\mathrm\{([^}]*)\}"), 1)
    out = F.lit(0.5)
    out += let(share(roman), lambda r: F.when(r > 0.5, -0.3).when(r > 0.3, -0.15).otherwise(0.0)) + part(F.exists(roman, lambda m: count(m, "~") >= 2), -0.2)
    out += let(share(found(bare, "[a-zA-Z]{4,}")), lambda r: F.when(r > 0.4, -0.3).when(r > 0.25, -0.15).otherwise(0.0))
    out += part(~y.contains("=") & (F.size(found(bare, r"(?<![\\a-zA-Z])[a-zA-Z](?![a-zA-Z{])")) >= 4), -0.15)
    to = F.regexp_count(y, F.lit(r"\\to(?![a-zA-Z])"))
    arrows = F.greatest(F.lit(0), to - F.when(y.contains(r"\lim"), 1).otherwise(0))
    for s in C.ARROWS:
        arrows += count(y, s)
    out += arrows * -0.15 + F.regexp_count(y, F.lit(r"\\(?:Longleftrightarrow|Leftrightarrow|longleftrightarrow|leftrightarrow|Longrightarrow|Rightarrow|rightarrow|longrightarrow)\s*[_^]\{")) * -0.25
    cal = count(y, r"\mathcal")
    out += F.when(cal >= 3, -0.2).when(cal == 2, -0.1).otherwise(0.0) + part(contains_any(y, C.SCORE_GARBAGE), -0.3) + count(y, r"\sim") * -0.1
    for s, v in C.SCORE_CONTAINED:
        out += part(y.contains(s), v)
    for s, v in C.SCORE_PATTERNS:
        out += part(y.rlike(s), v)
    out += part(y.contains(r"\scriptstyle") & (n > 50), -0.15) + part(n < 5, -0.2) + part(n > 500, -0.15)
    out += part(bare.rlike(r"^[A-Za-z]{1,5}\s*/\s*[A-Za-z]{1,5}\s*="), -0.15) + part(y.contains(r"\frac") & ~y.contains("=") & ~y.contains(r"\int"), -0.1) + part(bare.rlike(".+=.+"), 0.05)
    return F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 6))


def pick_best(a: Column, b: Column) -> Column:
    """struct(engine, latex, score): the higher score after repair; the first wins ties."""
    made = lambda e, t: let(t, lambda v: F.struct(F.lit(e).alias("engine"), v.alias("latex"), score(v).alias("score")))
    both = F.array(made("first", sanitize(a)), made("second", sanitize(b)))
    return let(both, lambda p: F.when(p[0]["score"] >= p[1]["score"], p[0]).otherwise(p[1]))


def gate(latex: Column, confidence: Column, has_image: Column) -> Column:
    """struct(latex, confidence): trusted, image only, or null (dropped)."""
    return F.when((latex != "") & (confidence >= C.OCR_BLOCK), F.struct(latex.alias("latex"), confidence.alias("confidence"))).when(has_image, F.struct(F.lit("").alias("latex"), F.lit(0.5).alias("confidence")))


def trusted(latex: Column, confidence: Column) -> Column:
    """Whether recognised LaTeX is shown instead of its image."""
    n, eq = F.length(latex), latex.contains("=")
    return (latex != "") & (confidence >= C.OCR_RENDER) & eq & ((n < 30) | (n < 80) & ~contains_any(latex, C.SUSPICIOUS_LATEX))


def escape(x: Column) -> Column:
    """LaTeX specials escaped outside mathematics; commands stay.

    Parts between dollar signs, commands, runs without specials, and single characters are tokens of one pattern.
    """
    tokens = F.regexp_extract_all(x, F.lit(r"(?s)(\$[^$]*\$|\\[a-zA-Z]+|\\.|[^$\\&%#_{}~^]+|.)"), 1)
    each = lambda t: F.when(t.isin("&", "%", "#", "_", "{", "}"), F.concat(F.lit("\\"), t)).when(t == "~", r"\textasciitilde{}").when(t == "^", r"\textasciicircum{}").otherwise(t)
    return F.when(x.rlike(r"[&%#_{}~^]"), F.array_join(F.transform(tokens, each), "")).otherwise(x)


EQUATION = r"\\begin\{equation\*?\}.*?\\end\{equation\*?\}"


def split_equations(paragraph: Column) -> Column:
    """array of (type, content): equation environments stay raw, text around them is escaped."""
    parts = F.regexp_extract_all(paragraph, F.lit(rf"(?s)({EQUATION}|(?:(?!{EQUATION}).)+)"), 1)
    made = lambda p: F.when(p.rlike(rf"(?s)^{EQUATION}$"), F.struct(F.lit("raw_latex").alias("type"), p.alias("content"))).otherwise(F.struct(F.lit("text").alias("type"), escape(p).alias("content")))
    return F.transform(F.filter(F.transform(parts, strip), lambda p: p != ""), made)


def paragraphs(x: Column) -> Column:
    """Paragraphs escaped; equation environments stand on their own."""
    each = lambda p: F.array_join(F.transform(split_equations(p), lambda b: b["content"]), "\n\n")
    return F.array_join(F.transform(F.filter(F.split(x, "\n\n"), lambda p: F.trim(p) != ""), lambda p: F.when(p.contains("\\begin{equation"), each(p)).otherwise(escape(F.trim(p)))), "\n\n")


def relative_path(path: Column, base: str) -> Column:
    """The path below the base folder, with forward slashes."""
    y = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    root = base.rstrip("/") + "/"
    return F.when(y.startswith(root), F.substr(y, F.lit(len(root) + 1))).otherwise(y)


def figure_record(image_path: Column, is_valid: Column, caption: Column, label: Column, base: str = "") -> Column:
    """struct(image_path, caption, label): no path if the image is corrupt, the caption without "Fig. N"."""
    bare = F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"(?i)^Fig(?:ure)?\.?\s*\d+[\s.:]*", ""))
    return F.struct(F.when(is_valid, relative_path(image_path, base)).otherwise("").alias("image_path"), bare.alias("caption"), label.alias("label"))


def formula_record(latex: Column, image_path: Column, is_valid: Column, confidence: Column) -> Column:
    """struct(latex, image_path): beside a valid image only trusted LaTeX is shown."""
    path = F.when(is_valid, F.coalesce(image_path, F.lit(""))).otherwise("")
    return F.struct(F.when((path == "") | trusted(latex, confidence), latex).otherwise("").alias("latex"), path.alias("image_path"))


def section_command(depth: Column) -> Column:
    return F.when(depth <= 1, r"\section").when(depth == 2, r"\subsection").otherwise(r"\subsubsection")


# Commands that recognition leaves in garbled cells.
CELL_GARBAGE = r"\\stackrel|\\bigwedge|\\mathcal\{[CDG]|\\not\{|\\mp\\dot|\\langle\\cdot"


def usable_cell(latex: Column) -> Column:
    commands = F.regexp_count(latex, F.lit(r"\\[a-zA-Z]+"))
    return (latex != "") & ~((commands > 8) & (F.length(latex) < 60)) & (F.regexp_count(latex, F.lit(CELL_GARBAGE)) < 2)


def table_cell(cell: Column) -> Column:
    """A cell's LaTeX: recognised formula, else its image, whole or mixed mathematics, escaped text."""
    y = F.trim(cell)
    inner = F.trim(F.regexp_extract(y, r"(?s)^\\CELLEQ\{(.+)\}$", 1))
    latex, image = F.trim(F.substring_index(inner, "||IMG:", 1)), F.when(inner.contains("||IMG:"), F.trim(F.substring_index(inner, "||IMG:", -1))).otherwise("")
    shown = lambda path: F.concat(F.lit("\\raisebox{-0.3\\height}{\\includegraphics[max height=0.9cm]{"), path, F.lit("}}"))
    formula = F.when(usable_cell(latex) | (image == ""), F.concat(F.lit("$\\displaystyle "), latex, F.lit("$"))).otherwise(shown(image))
    mixed = F.array_join(F.transform(F.split(cell, r"\$", -1), lambda p, i: F.when(i % 2 == 0, escape(p)).otherwise(F.concat(F.lit("$"), p, F.lit("$")))), "")
    picture = F.regexp_extract(y, r"^\\CELLIMG\{(.+?)\}$", 1)
    return F.when(inner != "", formula).when(picture != "", shown(picture)).when(y.rlike(r"(?s)^\$.*\$$"), y).when(cell.contains("$"), mixed).otherwise(escape(cell))


def tabular(headers: Column, rows: Column) -> Column:
    """A tabular environment: short rows are padded, long ones cut to the header's width."""
    n = F.size(headers)
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    numeric = F.size(F.filter(filled, lambda c: c.rlike(r"^[+-]?\d"))) / F.greatest(F.size(filled), F.lit(1)) > 0.4
    spec = F.when(numeric & (n > 2), F.concat(F.lit("l"), F.repeat(F.lit("c"), n - 1))).otherwise(F.repeat(F.lit("l"), n))
    font = F.when(n > 8, "\\scriptsize\n").when(n > 4, "\\footnotesize\n").otherwise("")
    line = lambda r: F.concat(F.array_join(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n), table_cell), " & "), F.lit(" \\\\"))
    return F.concat(font, F.lit("\\begin{tabular}{"), spec, F.lit("}\n\\hline\n"), line(headers), F.lit("\n\\hline\n"), F.array_join(F.transform(rows, line), "\n"), F.lit("\n\\hline\n\\end{tabular}"))
