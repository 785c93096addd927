"""Checked fields with a confidence and a source, the gate, and the summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def field(value: Column, confidence: float, source: str) -> Column:
    return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def plausible_title(x: Column) -> Column:
    return (F.size(F.split(T.strip(x), r"(?U)\s+")) >= 2) & (F.length(x) <= 300) & ~T.starts_any(x, ("http", "doi:"))


def title(parsed: Column, headings: Column, first_line: Column) -> Column:
    """Parsed, else the first plausible heading, else the first body line, else a weak one, else a default."""
    p = T.strip(F.coalesce(parsed, F.lit("")))
    h = F.get(F.filter(headings, plausible_title), 0)
    return (
        F.when((F.length(p) >= 5) & plausible_title(p), field(p, 0.9, "parsed"))
        .when(h.isNotNull(), field(h, 0.6, "repaired:first_heading"))
        .when((F.length(first_line) > 10) & (F.length(first_line) < 200), field(first_line, 0.4, "repaired:body_scan"))
        .when(p != "", field(p, 0.3, "parsed:weak"))
        .otherwise(field(F.lit("Untitled Paper"), 0.0, "default"))
    )


def abstract(parsed: Column, section: Column, paragraph: Column) -> Column:
    p = T.strip(F.coalesce(parsed, F.lit("")))
    return (
        F.when(F.length(p) > 50, field(p, 0.9, "parsed"))
        .when(p != "", field(p, 0.5, "parsed:short"))
        .when(F.coalesce(section, F.lit("")) != "", field(section, 0.7, "repaired:section"))
        .when(F.length(paragraph) > 100, field(paragraph, 0.3, "repaired:first_para"))
        .otherwise(field(F.lit(""), 0.0, "default"))
    )


def authors(names: Column) -> Column:
    good = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: ~T.bad_author(n))
    return F.struct(good.alias("value"), F.when(F.size(good) > 0, 0.8).otherwise(0.0).alias("confidence"), F.when(F.size(good) > 0, "parsed").otherwise("default").alias("source"))


def author_records(authors_: Column) -> Column:
    """As authors, for records with a name: bad names go with all their fields."""
    good = F.filter(authors_, lambda a: ~T.bad_author(a["name"]))
    return F.struct(good.alias("value"), F.when(F.size(good) > 0, 0.8).otherwise(0.0).alias("confidence"), F.when(F.size(good) > 0, "parsed").otherwise("default").alias("source"))


def keywords(parsed: Column, abstract_: Column) -> Column:
    """Parsed ones, else those that follow the word in the abstract, else none."""
    none = F.array().cast("array<string>")
    given = F.coalesce(parsed, none)
    rest = F.regexp_extract(F.coalesce(abstract_, F.lit("")), r"(?i)(?:keywords|key\s*words)[\s:—-]+(.+)", 1)
    found = F.filter(F.transform(F.split(rest, "[;,·•]"), lambda k: F.regexp_replace(T.strip(k), r"\.+$", "")), lambda k: k != "")
    made = lambda v, c, s: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(s).alias("source"))
    return F.when(F.size(given) > 0, made(given, 0.9, "parsed")).when(F.size(found) > 0, made(found, 0.5, "repaired:abstract")).otherwise(made(none, 0.0, "default"))


def metadata_heading(x: Column) -> Column:
    return T.contains_any(F.lower(T.strip(x)), ("doi:", "issn", "copyright", "authorized", "proceedings of"))


def boilerplate(x: Column) -> Column:
    return T.contains_any(F.lower(x), ("authorized licensed use", "downloaded on", "restrictions apply", "personal use is permitted"))


def renderable(title_: Column, bodies: Column) -> Column:
    return (title_["value"] != "") & (title_["confidence"] > 0) & F.exists(bodies, lambda b: F.trim(b) != "")


def listed(value: Column, confidence: float) -> Column:
    """A list as a checked field: none has confidence 0 and the source ``default``."""
    some = F.size(value) > 0
    return F.struct(value.alias("value"), F.when(some, confidence).otherwise(0.0).alias("confidence"), F.when(some, "parsed").otherwise("default").alias("source"))


def build(papers: DataFrame) -> DataFrame:
    """Papers (title, authors, abstract, keywords, sections, refs, perhaps null) with the seven checked fields in
    place of the plain ones, ``repair_log`` and ``renderable``.

    sections: array of structs with heading and body; refs: array of strings; authors: records with a name.
    """
    none = F.array().cast("array<string>")
    people, parts, given = F.col("authors"), F.col("sections"), F.coalesce("refs", none)
    good = F.filter(parts, lambda s: (T.strip(s["body"]) != "") & ~metadata_heading(s["heading"]))
    kept = F.filter(given, lambda r: ~boilerplate(r))
    head_lines = F.transform(F.filter(parts, lambda s: s["body"] != ""), lambda s: T.strip(F.substring_index(s["body"], "\n", 1)))
    line = F.get(F.filter(head_lines, lambda v: F.length(v).between(11, 199)), 0)
    own = F.get(F.filter(parts, lambda s: (F.lower(s["heading"]) == "abstract") & (s["body"] != "")), 0)["body"]
    long = F.get(F.filter(F.transform(parts, lambda s: T.strip(s["body"])), lambda v: F.length(v) > 100), 0)
    c = papers.withColumns({"authors": F.coalesce(people, F.array().cast(dict(papers.dtypes)["authors"])), "sections": F.coalesce(parts, F.array().cast(dict(papers.dtypes)["sections"]))})
    title_ = title(F.col("title"), F.transform(parts, lambda s: s["heading"]), F.coalesce(line, F.lit("")))
    # A first paragraph of any length stands for the abstract where its body is long.
    first = F.substring_index(long, "\n\n", 1)
    p = T.strip(F.coalesce("abstract", F.lit("")))
    abstract_ = (
        F.when(F.length(p) > 50, field(p, 0.9, "parsed")).when(p != "", field(p, 0.5, "parsed:short")).when(own.isNotNull(), field(T.strip(own), 0.7, "repaired:section"))
        .when(long.isNotNull(), field(first, 0.3, "repaired:first_para")).otherwise(field(F.lit(""), 0.0, "default"))
    )
    refs_ = F.struct(kept.alias("value"), F.when(F.size(kept) > 0, 0.8).otherwise(0.0).alias("confidence"), F.when(F.size(given) > 0, "parsed").otherwise("default").alias("source"))
    checked = c.withColumns({"__t": title_, "__u": author_records(people), "__a": abstract_, "__k": keywords(F.col("keywords"), F.col("abstract")), "__s": listed(good, 0.8), "__r": refs_})
    at = lambda f, v, m: F.when(F.col(f)["source"] == v, m)
    dropped = lambda n, m: F.when(n > 0, F.format_string(m, n))
    bad = F.filter(parts, lambda s: (T.strip(s["body"]) == "") | metadata_heading(s["heading"]))
    told = F.transform(bad, lambda s: F.concat(F.when(T.strip(s["body"]) == "", "sections: dropped empty section '").otherwise("sections: dropped metadata section '"), s["heading"], F.lit("'")))
    log = F.concat(
        F.array(
            at("__t", "repaired:first_heading", "title: repaired from first section heading"), at("__t", "repaired:body_scan", "title: repaired from body scan"), at("__t", "default", "title: using default placeholder"),
            F.when(F.size(F.col("__u")["value"]) == 0, "authors: none found").otherwise(dropped(F.size(people) - F.size(F.col("__u")["value"]), "authors: dropped %d bad names")),
            at("__a", "repaired:section", "abstract: repaired from sections list"), at("__a", "repaired:first_para", "abstract: repaired from first body paragraph"), at("__a", "default", "abstract: none found"),
            at("__k", "repaired:abstract", "keywords: repaired from abstract text"),
        ),
        told, F.array(at("__s", "default", "sections: none found"), dropped(F.size(given) - F.size(kept), "references: dropped %d boilerplate entries")),
    )
    out = checked.withColumn("repair_log", F.filter(log, lambda m: m.isNotNull())).withColumn("renderable", renderable(F.col("__t"), F.transform(F.col("__s")["value"], lambda s: s["body"])))
    formulas = F.flatten(F.transform(parts, lambda s: s["formulas"])) if "formulas" in _fields(papers, "sections") else none
    out = out.withColumn("formula_blocks", listed(formulas, 0.8))
    return out.drop("title", "authors", "abstract", "keywords", "sections", "refs").withColumnsRenamed({"__t": "title", "__u": "authors", "__a": "abstract", "__k": "keywords", "__s": "sections", "__r": "refs"})


def _fields(df: DataFrame, name: str) -> list[str]:
    return df.schema[name].dataType.elementType.names


def unwrap(papers: DataFrame) -> DataFrame:
    """Checked papers with their plain values."""
    return papers.withColumns({c: F.col(c)["value"] for c in ("title", "authors", "abstract", "keywords", "sections", "refs")})


def rejects(papers: DataFrame) -> DataFrame:
    """doc_id, summary, repair_log of the papers that cannot be rendered."""
    return papers.where(~F.col("renderable")).select("doc_id", summary().alias("summary"), "repair_log")


def summary() -> Column:
    """One line on a checked paper: confidences, sources, counts and repairs."""
    part = lambda f, n, what="": F.format_string(f"{f}=%.1f(%d{what})", F.col(f)["confidence"], n(F.col(f)["value"]))
    repairs = F.when(F.size("repair_log") > 0, F.format_string("repairs=%d", F.size("repair_log")))
    title_ = F.format_string("title=%.1f(%s)", F.col("title")["confidence"], F.col("title")["source"])
    return F.concat_ws(" | ", title_, part("authors", F.size), part("abstract", F.length, " chars"), part("sections", F.size), part("refs", F.size), repairs)


def resync(positions: Column, paragraphs: Column) -> Column:
    """Positions for as many paragraphs: kept, cut, or none if there are more paragraphs."""
    n, k = F.size(positions), F.size(paragraphs)
    return F.when(n == k, positions).when(n > k, F.slice(positions, F.lit(1), k)).otherwise(F.slice(positions, 1, 0))
