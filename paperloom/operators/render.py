"""Documents as LaTeX in six layouts, assembled from column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import latex as L
from ..functions import text as T


def content_blocks(paragraphs: DataFrame, formulas: DataFrame) -> DataFrame:
    """Paragraphs and formulas of sections in one order: a formula follows the last paragraph not after it.

    The search ends at the first later paragraph; before all paragraphs a formula follows the first.
    """
    p = paragraphs.select("doc_id", "section_idx", "para_idx", F.struct("page", "y").alias("at"))
    j = formulas.join(p, ["doc_id", "section_idx"]).groupBy("doc_id", "section_idx", "formula_idx", "page", "y", "latex").agg(
        F.min(F.when(F.col("at") > F.struct("page", "y"), F.col("para_idx"))).alias("later"), F.max("para_idx").alias("last"))
    placed = j.select("doc_id", "section_idx", F.greatest(F.lit(0), F.coalesce(F.col("later") - 1, "last")).alias("para_idx"), F.lit(1).alias("kind"), "page", "y", F.col("latex").alias("content"))
    plain = paragraphs.select("doc_id", "section_idx", "para_idx", F.lit(0).alias("kind"), "page", "y", F.col("text").alias("content"))
    return plain.unionByName(placed)


NO_AUTHORS = "array<struct<name: string, department: string, organization: string, city: string, country: string, email: string>>"


def _filled(x: Column, before: str = "", after: str = "") -> Column:
    return F.when(x != "", F.concat(F.lit(before), L.escape(x), F.lit(after)))


def author_block(layout: str, authors: Column) -> Column:
    """The authors as a layout sets them; empty without authors."""
    place = lambda a: F.concat_ws(", ", _filled(a["city"]), _filled(a["country"]))
    names = F.array_join(F.transform(authors, lambda a: L.escape(a["name"])), "\n\\and\n")
    if layout == "ieee":
        width = F.round(0.96 / F.size(authors), 4).cast("string")
        rest = lambda a: F.concat_ws("\\\\ ", L.escape(a["department"]), _filled(a["organization"]), F.when(place(a) != "", place(a)), _filled(a["email"]))
        each = lambda a: F.concat(F.lit("\\begin{minipage}[t]{"), width, F.lit("\\textwidth}\\centering\n{\\normalsize\\textbf{"), L.escape(a["name"]), F.lit("}}\\\\[2pt]\n{\\footnotesize "), rest(a), F.lit("}\n\\end{minipage}%"))
        out = F.concat(F.lit("\\author{%\n"), F.array_join(F.transform(authors, each), "\n\\hfill%\n"), F.lit("\n}\n"))
    elif layout == "springer":
        unit = lambda a: F.concat_ws("\n", _filled(a["department"], after="\\\\"), _filled(a["organization"], after="\\\\"), _filled(a["city"], after="\\\\"), _filled(a["email"], "\\email{", "}"))
        units = F.filter(F.transform(authors, unit), lambda u: u != "")
        out = F.concat(F.lit("\\author{\n"), names, F.lit("\n}\n\\institute{\n"), F.array_join(units, "\n\\and\n"), F.lit("\n}\n"))
    elif layout == "elsevier":
        address = lambda a: F.concat_ws(", ", _filled(a["department"]), _filled(a["organization"]), F.when(place(a) != "", place(a)))
        note = lambda a, i: F.when(a["email"] != "", F.concat(F.lit("fn"), (i + 1).cast("string")))
        each = lambda a, i: F.concat_ws("\n",
            F.concat(F.lit("\\author{"), L.escape(a["name"]), F.coalesce(F.concat(F.lit("\\fnref{"), note(a, i), F.lit("}")), F.lit("")), F.lit("}")),
            F.when(address(a) != "", F.concat(F.lit("\\address{"), address(a), F.lit("}"))), F.concat(F.lit("\\fntext["), note(a, i), F.lit("]{"), L.escape(a["email"]), F.lit("}")))
        out = F.concat(F.array_join(F.transform(authors, each), "\n"), F.lit("\n"))
    elif layout == "apa":
        line = lambda c, before: _filled(c, before, "\\par}")
        each = lambda a: F.concat_ws("\n", line(a["name"], "{\\large "), *[line(a[k], "{\\normalsize ") for k in ("department", "organization", "city")], _filled(a["email"], "{\\normalsize \\texttt{", "}\\par}"))
        out = F.concat(F.array_join(F.transform(authors, each), "\n"), F.lit("\n"))
    else:
        units = ("department", "organization") if layout == "arxiv" else ("organization",)
        each = lambda a: F.concat_ws(" \\\\ ", L.escape(a["name"]), *[_filled(a[u], "{\\small ", "}") for u in units], _filled(a["email"], "{\\small \\texttt{", "}}"))
        out = F.concat(F.lit("\\author{\n"), F.array_join(F.transform(authors, each), "\n\\and\n"), F.lit("\n}\n"))
    return F.when(F.size(authors) > 0, out).otherwise("")


def figure(f: Column, layout: str = "ieee") -> Column:
    """A figure environment; one layout leaves out figures without an image."""
    place = "!htbp" if layout == "ieee" else "htbp"
    image = F.concat(F.lit("\\includegraphics[max width=\\columnwidth, max height=0.4\\textheight]{"), f["image_path"], F.lit("}"))
    inner = F.concat_ws("\n", F.lit(f"\\begin{{figure}}[{place}]\n\\centering"), image, _filled(f["caption"], "\\caption{", "}"), F.when(f["label"] != "", F.concat(F.lit("\\label{"), f["label"], F.lit("}"))), F.lit("\\end{figure}"))
    return F.when(f["image_path"] != "", inner) if layout == "ieee" else inner


def equation(f: Column, layout: str) -> Column:
    """A formula block: its LaTeX where it is trusted, else its image; null without either."""
    r = L.formula_record(f["latex"], f["image_path"], f["is_valid"], f["confidence"])
    width = "\\textwidth" if layout == "apa" else "\\columnwidth"
    shown = lambda v: F.concat(F.lit("\\begin{equation}\n"), v, F.lit("\n\\end{equation}"))
    image = F.concat(F.lit(f"\\vcenter{{\\hbox{{\\includegraphics[max width=0.85{width}, max height=4cm]{{"), r["image_path"], F.lit("}}}"))
    return F.when(r["latex"] != "", shown(r["latex"])).when(r["image_path"] != "", shown(image))


def section_text(s: Column, layout: str) -> Column:
    """A section's paragraphs with each formula behind the last paragraph that starts no later than it.

    Where positions and paragraphs differ in number, all formulas follow the last paragraph.
    """
    paragraphs = F.filter(F.transform(F.split(T.strip(s["body"]), "\n\n+"), T.strip), lambda p: p != "")
    ordered = F.array_sort(s["formulas"])  # structs begin with page and y

    def woven(p: Column) -> Column:
        last = F.size(p) - 1

        def after(f: Column) -> Column:
            later = F.array_min(F.transform(s["positions"], lambda q, i: F.when(q > F.struct(f["page"].alias("page"), f["bbox_y"].alias("y")), i)))
            return F.when(F.size(s["positions"]) == F.size(p), F.greatest(F.lit(0), F.coalesce(later - 1, last))).otherwise(last)

        each = lambda t, i: F.concat(F.transform(L.split_equations(t), lambda b: b["content"]), F.transform(F.filter(ordered, lambda f: after(f) == i), lambda f: equation(f, layout)))
        return F.when(F.size(p) == 0, F.transform(ordered, lambda f: equation(f, layout))).otherwise(F.flatten(F.transform(p, each)))

    return F.array_join(F.filter(L.let(paragraphs, woven), lambda v: v.isNotNull()), "\n\n")


def table(t: Column) -> Column:
    """A table environment with caption and label around its tabular."""
    return F.concat_ws("\n", F.lit("\\begin{table}[!htbp]\n\\centering"), _filled(t["caption"], "\\caption{", "}"), F.when(t["label"] != "", F.concat(F.lit("\\label{"), t["label"], F.lit("}"))), L.tabular(t["headers"], t["rows"]), F.lit("\\end{table}"))


def document(layout: str, title: Column, abstract: Column, keywords: Column, sections: Column, refs: Column, authors: Column | None = None, floats: bool = False) -> Column:
    """Whole LaTeX text.  refs: array of strings.  sections: array of (heading, depth, body), with ``floats``
    also positions, formulas, figures and tables."""
    head, bibliography = C.LAYOUTS[layout]
    joiner = {"springer": " \\and ", "elsevier": " \\sep "}.get(layout, ", ")
    words = F.array_join(F.transform(keywords, L.escape), joiner)
    by = author_block(layout, F.expr(f"cast(array() as {NO_AUTHORS})") if authors is None else authors)

    def content(s: Column) -> Column:
        if not floats:
            return L.paragraphs(s["body"])
        pictures, grids = F.transform(s["figures"], lambda f: figure(f, layout)), F.transform(s["tables"], table)
        both = F.concat(pictures, grids) if layout == "ieee" else F.concat(grids, pictures)
        return F.array_join(F.filter(F.concat(F.array(section_text(s, layout)), both), lambda v: v.isNotNull() & (v != "")), "\n\n")

    body = F.array_join(F.transform(sections, lambda s: F.concat(L.section_command(s["depth"]), F.lit("{"), L.escape(s["heading"]), F.lit("}\n"), content(s))), "\n\n")
    keyed = lambda before, after: F.when(F.size(keywords) > 0, F.concat(F.lit(before), words, F.lit(after))).otherwise("")
    inside = {"springer": ("\n\\keywords{", "}"), "apa": ("\n\\textbf{Keywords:} ", "")}.get(layout)
    behind = {"ieee": ("\\begin{IEEEkeywords}\n", "\n\\end{IEEEkeywords}\n"), "elsevier": ("\\begin{keyword}\n", "\n\\end{keyword}\n")}.get(layout, ("\\noindent\\textbf{Keywords:} ", "\n\\vspace{1em}\n"))
    front = F.when(abstract != "", F.concat(F.lit("\\begin{abstract}\n"), L.paragraphs(abstract), keyed(*inside) if inside else F.lit(""), F.lit("\n\\end{abstract}\n"))).otherwise("")
    if not inside:
        front = F.concat(front, keyed(*behind))
    if bibliography == "enumerate":
        item, opening = (lambda r, i: F.concat(F.lit("\\item "), L.escape(r))), F.lit("\n\\section*{References}\n\\begin{enumerate}\n")
    else:
        widest = F.size(refs).cast("string") if layout == "ieee" else F.lit("99")
        item, opening = (lambda r, i: F.concat(F.lit("\\bibitem{ref"), (i + 1).cast("string"), F.lit("} "), L.escape(r))), F.concat(F.lit("\n\\begin{thebibliography}{"), widest, F.lit("}\n" + ("\\small\n" if layout == "acm" else "")))
    tail = F.concat(opening, F.array_join(F.transform(refs, item), "\n"), F.lit(f"\n\\end{{{bibliography}}}\n"))
    return F.concat(F.lit(f"{head}\n{C.PREAMBLE}\n\\begin{{document}}\n\\title{{"), L.escape(title), F.lit("}\n"), by, F.lit("\\maketitle\n"), front, body, F.when(F.size(refs) > 0, tail).otherwise(""), F.lit("\\end{document}\n"))
