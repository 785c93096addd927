"""Blocks of papers to LaTeX: parse, place, check, normalise, render.

Every table carries doc_id, and the steps up to the checked papers keep a partitioning by it: blocks that
come dealt by doc_id are never dealt again.  A paper is one row with arrays of its parts; checked papers
are written once, and what is normalised and rendered is read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import latex as L
from ..functions import mathtext as M
from ..functions import text as T
from ..sources.scratch import saved
from . import authors, canon, chars, lines, render, structure, tables

KEY = ("doc_id", "section_idx")
TABLE = "struct<headers: array<string>, rows: array<array<string>>, caption: string, label: string>"
FIGURE = "struct<page: int, y: double, image_path: string, caption: string, label: string>"
FORMULA = "struct<page: int, bbox_y: double, latex: string, image_path: string, confidence: double, is_valid: boolean>"
FIELDS = ("doc_id", "title", "authors", "abstract", "keywords", "refs", "sections", "__t")
RESULTS = "result|experiment|evaluation|analysis|discussion"


def _gathered(rows: DataFrame, order: str, value, name: str, by=("doc_id",)) -> DataFrame:
    """One row a key with the array of ``value`` in order."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda z: z["v"]).alias(name))


def _none(kind: str):
    return F.expr(f"cast(array() as array<{kind}>)")


def parse_strategy(blocks: DataFrame) -> DataFrame:
    """doc_id, strategy: ``fonts`` where a block that is no metadata has a print size, else ``text``."""
    sized = F.max(((F.coalesce("size", F.lit(0.0)) > 0) & ~T.is_metadata(F.col("text"))).cast("int"))
    return blocks.groupBy("doc_id").agg(F.when(sized == 1, "fonts").otherwise("text").alias("strategy"))


def fields(blocks: DataFrame) -> DataFrame:
    """title, authors, abstract, keywords, refs, sections and ``__t``, the tables in the text, of each paper, from blocks with print sizes.

    The blocks of a paper are grouped once, and what that gives is written once; authors, references and
    tables are made from the few blocks of each that may hold them.
    """
    p = saved(structure.papers(blocks), "parsed")
    few = lambda name: p.where(F.size(name) > 0).select("doc_id", F.inline(name))
    person = F.struct("name", "department", "organization", "city", "country", "email")
    people = _gathered(authors.people(few("zone")), "author_idx", person, "authors")
    refs = _gathered(structure.listed_references(few("listed")), "ref_idx", F.col("text"), "refs")
    out = p.join(people, "doc_id", "left").join(refs, "doc_id", "left").join(_found(few("near")), "doc_id", "left")
    return out.select(*FIELDS)


def text_fields(blocks: DataFrame) -> DataFrame:
    """The same from the text alone; no authors."""
    placed = blocks.withColumn("page", F.coalesce("page", F.lit(0)))
    front, rest = structure.text_only(chars.document_text(placed))
    refs = _gathered(structure.references(rest), "ref_idx", F.col("text"), "refs")
    out = front.join(refs, "doc_id", "left").select("doc_id", "title", _none(render.NO_AUTHORS[6:-1]).alias("authors"), "abstract", "keywords", "refs")
    whole = _gathered(structure.sections(rest), "section_idx", F.struct("section_idx", "heading", "depth", "body", "start_page", "positions"), "sections")
    return out.join(whole, "doc_id", "left").join(_found(blocks), "doc_id", "left").select(*FIELDS)


def _found(blocks: DataFrame) -> DataFrame:
    """doc_id, __t: the tables in the text."""
    return _gathered(tables.detect(blocks), "block_idx", F.struct("headers", "rows", "caption", "label").cast(TABLE), "__t")


def _placed(items, place, parts):
    """Each item of an array with the number of its section, as (at, item); place gives an item's (page, y).

    As ``structure.place``: the last section that starts at or before the item; the first without a page;
    in turn where no item has one.  A paper's items and sections are few, so they stay in its row.
    """
    first = lambda s: F.get(s["positions"], 0)
    start = lambda s: F.struct(F.coalesce(first(s)["page"], F.greatest(s["start_page"], F.lit(0))).alias("page"), F.coalesce(first(s)["y"], F.lit(0.0)).alias("y"))
    paged = F.exists(items, lambda f: place(f)["page"] >= 0)

    def at(f, k):
        before = F.array_max(F.transform(parts, lambda s, i: F.when(start(s) <= place(f), i)))
        return F.when(~paged, k % F.size(parts)).when(place(f)["page"] < 0, 0).otherwise(F.coalesce(before, F.lit(0)))

    return F.transform(items, lambda f, k: F.struct(at(f, k).alias("at"), f.alias("item")))


def parse(blocks: DataFrame, formulas: DataFrame | None = None, figures: DataFrame | None = None, grids: DataFrame | None = None, sized: bool | None = None) -> DataFrame:
    """One row a paper: title, authors, abstract, keywords, refs, sections with tables, figures and formulas.

    formulas: doc_id, formula_idx, page, bbox_y, latex, image_path, confidence, is_valid; kept if trusted or
    with an image.  figures: doc_id, fig_idx, page, bbox_y, image_path, is_valid, caption, label.  grids:
    doc_id, table_idx and a table's columns; papers without one have their text searched for tables.
    ``sized``: whether all papers have print sizes (True), none (False), or each is looked at (None).
    """
    if sized is None:
        how = parse_strategy(blocks)
        pick = lambda s: blocks.join(how.where(F.col("strategy") == s).select("doc_id"), "doc_id", "left_semi")
        p = fields(pick("fonts")).unionByName(text_fields(pick("text")))
    else:
        p = (fields if sized else text_fields)(blocks)
    table = F.struct("headers", "rows", "caption", "label").cast(TABLE)
    if grids is None:
        p = p.withColumn("__g", F.lit(None).cast(f"array<{TABLE}>"))
    else:
        p = p.join(_gathered(grids, "table_idx", table, "__g"), "doc_id", "left")
    if formulas is None:
        p = p.withColumn("__f", _none(FORMULA))
    else:
        kept = formulas.withColumn("g", L.gate(F.col("latex"), F.col("confidence"), F.col("image_path") != "")).where("g is not null")
        item = F.struct("page", "bbox_y", F.col("g.latex").alias("latex"), "image_path", F.col("g.confidence").alias("confidence"), "is_valid").cast(FORMULA)
        p = p.join(_gathered(kept, "formula_idx", item, "__f"), "doc_id", "left")
    if figures is None:
        p = p.withColumn("__i", _none(FIGURE))
    else:
        record = L.figure_record(F.col("image_path"), F.col("is_valid"), F.col("caption"), F.col("label"))
        item = F.struct("page", F.col("bbox_y").alias("y"), record["image_path"].alias("image_path"), record["caption"].alias("caption"), record["label"].alias("label")).cast(FIGURE)
        p = p.join(_gathered(figures, "fig_idx", item, "__i"), "doc_id", "left")

    parts_ = F.col("sections")
    result = F.filter(F.transform(parts_, lambda s, i: F.when(F.lower(s["heading"]).rlike(RESULTS), i)), lambda i: i.isNotNull())
    later = F.filter(F.transform(parts_, lambda s, i: i), lambda i: i >= F.floor(F.size(parts_) / 2))
    slots = F.when(F.size(result) > 0, result).otherwise(later)
    p = p.withColumns({"__slots": slots, "__all": F.coalesce("__g", "__t", _none(TABLE)), "__t": F.when(F.col("__g").isNull(), F.col("__t"))})
    p = p.withColumns({
        "__all": F.transform("__all", lambda t, k: F.struct(F.get("__slots", k % F.size("__slots")).alias("at"), t.alias("item"))),
        "__f": _placed(F.coalesce("__f", _none(FORMULA)), lambda f: F.struct(f["page"].alias("page"), f["bbox_y"].alias("y")), parts_),
        "__i": _placed(F.coalesce("__i", _none(FIGURE)), lambda f: F.struct(f["page"].alias("page"), f["y"].alias("y")), parts_),
    })
    own = lambda c, i: F.transform(F.filter(c, lambda x: x["at"] == i), lambda x: x["item"])
    body = lambda s: F.when(F.col("__t").isNotNull(), tables.strip_residue(s["body"], F.col("__t"))).otherwise(s["body"])
    made = F.transform(parts_, lambda s, i: F.struct(s["section_idx"].alias("section_idx"), s["heading"].alias("heading"), s["depth"].alias("depth"), body(s).alias("body"), s["positions"].alias("positions"), own("__all", i).alias("tables"), own("__i", i).alias("figures"), own("__f", i).alias("formulas")))
    return p.withColumn("sections", made).drop("__t", "__g", "__f", "__i", "__slots", "__all")


def normalise(papers: DataFrame) -> DataFrame:
    """Papers with plain values, cleaned: bodies in the fixed order of steps, positions kept to the paragraphs."""
    none = F.lit("")
    names = F.array_join(F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n != ""), ", ")
    captions = F.flatten(F.transform("sections", lambda s: F.transform(s["tables"], lambda t: t["caption"])))
    body = papers.select("doc_id", T.basic_clean(F.col("title")).alias("title"), names.alias("names"), captions.alias("captions"), F.explode(F.transform("sections", lambda s: F.struct(s["section_idx"], s["body"]))).alias("s"))
    clean = lines.normalise_texts(body.select("doc_id", F.col("s")["section_idx"].alias("section_idx"), "title", "names", "captions", F.col("s")["body"].alias("text")), KEY)
    texts_ = clean.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section_idx", "text"))).alias("__clean"))
    abstract = lines.clean_with_math(papers.select("doc_id", lines.merge_orphans(F.coalesce("abstract", none)).alias("text"))).withColumnRenamed("text", "__abstract")
    cells = lambda a: F.transform(a, M.clean_cell)
    grid = lambda t: F.struct(cells(t["headers"]).alias("headers"), F.transform(t["rows"], cells).alias("rows"), T.basic_clean(t["caption"]).alias("caption"), t["label"].alias("label"))

    def part(s):
        text = F.coalesce(F.get(F.array(F.col("__clean")[s["section_idx"]]), 0), none)
        paragraphs = F.filter(F.split(T.strip(text), "\n\n+"), lambda p: T.strip(p) != "")
        return F.struct(s["section_idx"].alias("section_idx"), T.basic_clean(s["heading"]).alias("heading"), s["depth"].alias("depth"), text.alias("body"), canon.resync(s["positions"], paragraphs).alias("positions"), F.transform(s["tables"], grid).alias("tables"), s["figures"].alias("figures"), s["formulas"].alias("formulas"))

    kept = papers.join(texts_, "doc_id", "left").join(abstract, "doc_id", "left")
    return kept.withColumns({"title": T.basic_clean(F.col("title")), "abstract": F.coalesce("__abstract", none), "refs": F.transform("refs", T.clean_reference), "sections": F.transform("sections", part)}).drop("__abstract", "__clean")


def check(papers: DataFrame) -> DataFrame:
    """Parsed papers with their checked fields, repair log and gate."""
    return canon.build(papers)


def texts(papers: DataFrame, layout: str) -> DataFrame:
    """doc_id, tex of normalised papers."""
    tex = render.document(layout, F.col("title"), F.col("abstract"), F.col("keywords"), F.col("sections"), F.col("refs"), F.col("authors"), True)
    return papers.select("doc_id", tex.alias("tex"))


def prepare(blocks: DataFrame, formulas: DataFrame | None = None, figures: DataFrame | None = None, grids: DataFrame | None = None, sized: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalised papers that can be rendered; doc_id, summary, repair_log of those that cannot)."""
    checked = saved(check(parse(blocks, formulas, figures, grids, sized)), "checked")
    return normalise(canon.unwrap(checked.where("renderable"))), canon.rejects(checked)


def run(blocks: DataFrame, layout: str, formulas: DataFrame | None = None, figures: DataFrame | None = None, grids: DataFrame | None = None, sized: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tex of what can be rendered; doc_id, summary, repair_log of what cannot)."""
    if layout not in C.LAYOUTS:
        raise ValueError(f"no layout {layout!r}: one of {', '.join(C.LAYOUTS)}")
    papers, rejected = prepare(blocks, formulas, figures, grids, sized)
    return texts(papers, layout), rejected
