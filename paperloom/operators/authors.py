"""Authors between title and abstract, with their affiliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import structure

EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
STOPS = ("abstract", "keywords", "key words", "index terms")


def _affiliated(x: Column) -> Column:
    return T.contains_any(F.lower(x), C.AFFILIATION_WORDS)


def zone(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Of the first 35 blocks those after an author heading, large print or the title, up to the abstract or keywords."""
    text = T.strip(F.col("text"))
    b = blocks.where("block_idx < 35").join(structure.body_size(blocks), "doc_id", "left").join((structure.titles(blocks) if titles is None else titles).select("doc_id", T.strip(F.col("title")).alias("__title")), "doc_id", "left")
    trigger = F.lower(text).isin("authors", "author") | F.coalesce(F.col("size") > 1.15 * F.col("body"), F.lit(False)) | F.coalesce((F.col("__title") != "") & (text == F.col("__title")), F.lit(False))
    w = Window.partitionBy("doc_id")
    b = b.withColumn("__t", trigger).withColumn("__from", F.min(F.when(F.col("__t"), F.col("block_idx"))).over(w))
    b = b.withColumn("__to", F.min(F.when(~F.col("__t") & T.starts_any(F.lower(text), STOPS), F.col("block_idx"))).over(w))
    inside = ~F.col("__t") & (F.col("block_idx") > F.col("__from")) & (F.col("block_idx") < F.coalesce("__to", F.lit(35))) & ~T.is_metadata(F.col("text"))
    return b.where(inside).select("doc_id", "block_idx", text.alias("text"))


def merge_name_pairs(lines: DataFrame) -> DataFrame:
    """SURNAME above Given as one line "Given SURNAME".

    Lines of one capitalised word form runs inside a block; in a run each odd line takes the even one after it.
    """
    bare = T.strip(F.regexp_replace("line", r"[*†‡§¹²³⁴⁵⁶⁷⁸⁹⁰\d]", ""))
    lone = bare.rlike(r"^\p{Lu}\S{1,19}$") & ~_affiliated(bare)
    w = Window.partitionBy("doc_id", "block_idx").orderBy("line_idx")
    run = Window.partitionBy("doc_id", "block_idx", "__run", "__lone")
    m = lines.withColumn("__bare", bare).withColumn("__lone", lone).withColumn("__run", F.sum((~F.col("__lone")).cast("int")).over(w))
    m = m.withColumn("__at", F.row_number().over(run.orderBy("line_idx"))).withColumn("__n", F.count(F.lit(1)).over(run)).withColumn("__next", F.lead("__bare").over(w))
    paired = F.col("__lone") & (F.col("__at") % 2 == 1) & (F.col("__at") < F.col("__n"))
    m = m.where(~(F.col("__lone") & (F.col("__at") % 2 == 0)))
    return m.select("doc_id", "block_idx", "line_idx", F.when(paired, F.concat_ws(" ", "__next", "__bare")).otherwise(F.col("line")).alias("line"))


def authors(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, author_idx, name, department, organization, city, country, email.

    A line is an e-mail, an affiliation, a short place (once there is an author) or names; all but names
    belong to the last author before them.
    """
    return people(zone(blocks, titles))


def people(zones: DataFrame) -> DataFrame:
    """The same from the blocks of the zones: doc_id, block_idx, text."""
    lines = zones.select("doc_id", "block_idx", F.posexplode(F.split("text", "\n")).alias("line_idx", "line")).withColumn("line", T.strip(F.col("line")))
    lines = merge_name_pairs(lines).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("block_idx", "line_idx")
    m = lines.withColumn("seq", F.row_number().over(w)).withColumn("email", F.regexp_extract("line", f"({EMAIL})", 1)).withColumn("aff", _affiliated(F.col("line")))
    m = m.withColumn("names", F.when((F.col("email") == "") & ~F.col("aff"), F.filter(T.author_names(F.col("line")), T.plausible_author)).otherwise(F.array().cast("array<string>")))
    m = m.withColumn("first", F.min(F.when(F.size("names") > 0, F.col("seq"))).over(Window.partitionBy("doc_id")))
    place = (F.col("email") == "") & ~F.col("aff") & (F.col("seq") > F.col("first")) & (F.length("line") < 40) & ~T.plausible_author(F.col("line"))
    m = m.withColumn("place", F.coalesce(place, F.lit(False))).withColumn("names", F.when(F.col("place"), F.array().cast("array<string>")).otherwise(F.col("names")))
    m = m.withColumn("upto", F.sum(F.size("names")).over(w)).where("upto > 0")

    names = m.select("doc_id", F.posexplode("names").alias("k", "name"), F.col("upto") - F.size("names"))
    names = names.toDF("doc_id", "k", "name", "base").select("doc_id", (F.col("base") + F.col("k")).cast("int").alias("author_idx"), F.trim("name").alias("name"))

    tail = T.strip(F.regexp_extract("line", r",([^,]*)$", 1))
    is_country = F.col("aff") & F.length(tail).between(2, 34) & tail.rlike(r"^\p{Lu}") & ~_affiliated(tail)
    parts = F.split("line", ",")
    country = F.when(is_country, tail).when(F.col("place"), T.strip(F.element_at(parts, -1)))
    unit = F.when(F.col("aff"), F.when(is_country, T.strip(F.regexp_replace("line", r",[^,]*$", ""))).otherwise(F.col("line")))
    city = F.when(F.col("place") & F.col("line").contains(","), T.strip(parts[0]))
    facts = m.where(F.size("names") == 0).select("doc_id", (F.col("upto") - 1).cast("int").alias("author_idx"), "seq", "email", unit.alias("unit"), city.alias("city"), F.when(country != "", country).alias("country"))
    units = F.transform(F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("seq", "unit")))), lambda u: u["unit"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    got = facts.groupBy("doc_id", "author_idx").agg(units.alias("u"), first("city").alias("city"), first("country").alias("country"), F.max_by("email", F.when(F.col("email") != "", F.col("seq"))).alias("email"))
    j = names.join(got, ["doc_id", "author_idx"], "left")
    none = F.lit("")
    return j.select("doc_id", "author_idx", "name", F.coalesce(F.get("u", 0), none).alias("department"), F.coalesce(F.get("u", 1), none).alias("organization"), *[F.coalesce(c, none).alias(c) for c in ("city", "country", "email")])
