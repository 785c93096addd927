"""Files to LaTeX: read papers, write what was extracted, what was made of it, and what could not be rendered.

``python -m paperloom INPUT --template ieee --output FOLDER`` for files or folders of them.  Exit codes: 1 for a
missing or unsupported input, 2 where nothing could be rendered or a backend is missing, 3 for anything else.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import traceback
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import canon, chain, chars
from .sources import files
from .sources.scratch import saved


def documents(spark: SparkSession, source: str) -> DataFrame:
    """path, engine, content of the files at a path, a folder or a pattern."""
    try:
        found = files.binary_documents(spark, source)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no such input: {source}") from e
    if found.select("path").isEmpty():
        raise ValueError(f"neither .pdf nor .docx nor .doc: {source}")
    return found


def blocks(docs: DataFrame, pdf: Callable[[bytes], list[tuple]] | None = None) -> DataFrame:
    """Blocks of all files, doc_id being the path.  PDF files need a backend (``files.pdf_blocks``)."""
    out = files.docx_blocks(docs)
    if pdf is not None:
        out = out.unionByName(files.pdf_blocks(docs, pdf))
    elif not docs.where("engine = 'pdf'").select("path").isEmpty():
        raise RuntimeError("PDF files need a backend")
    return out.select(F.col("path").alias("doc_id"), "block_idx", "page", F.lit(0.0).alias("y"), "text", "font", "size")


def grids(docs: DataFrame) -> DataFrame:
    """Tables of DOCX files, the first row as header."""
    row = files.docx_cells(docs).groupBy("path", "table_idx", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))), lambda c: c["cell"]).alias("cells"))
    table = row.groupBy("path", "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("r"))
    label = F.concat(F.lit("tab_docx_"), F.col("table_idx") + 1)
    return table.select(F.col("path").alias("doc_id"), "table_idx", F.get("r", 0).alias("headers"), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("rows"), F.lit("").alias("caption"), label.alias("label"))


def file_name(path):
    """The name of a file without its extension, and eight digits of its path, as files of one name may lie in many folders."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")
    return F.concat(base, F.lit("-"), F.substring(F.md5(path), 1, 8))


def run(spark: SparkSession, source: str, layout: str, folder: str, pdf: Callable[[bytes], list[tuple]] | None = None, support: dict[str, bytes] | None = None) -> DataFrame:
    """Writes {folder}/extracted, structured and rejected (JSON lines) and tex/*.tex; returns name, doc_id, tex.

    Files that cannot be read have no blocks; they are told in ``rejected``.  support: class files set beside the papers.
    """
    if layout not in C.LAYOUTS:
        raise ValueError(f"no layout {layout!r}: one of {', '.join(C.LAYOUTS)}")
    docs = documents(spark, source)
    found = saved(blocks(docs, pdf), "blocks")
    files.write_json(chars.document_text(found), f"{folder}/extracted")
    kinds = {r["strategy"] for r in chain.parse_strategy(found).select("strategy").distinct().collect()}  # two at most
    sized = kinds == {"fonts"} if len(kinds) < 2 else None
    checked = saved(chain.check(chain.parse(found, grids=grids(docs), sized=sized)), "checked")
    files.write_json(canon.unwrap(checked), f"{folder}/structured")
    unread = docs.select(F.col("path").alias("doc_id")).join(checked.select("doc_id"), "doc_id", "left_anti")
    rejected = canon.rejects(checked).unionByName(unread.select("doc_id", F.lit("no text was found").alias("summary"), F.array().cast("array<string>").alias("repair_log")))
    files.write_json(rejected, f"{folder}/rejected")
    papers = chain.normalise(canon.unwrap(checked.where("renderable")))
    tex = saved(chain.texts(papers, layout).select(file_name(F.col("doc_id")).alias("name"), "doc_id", "tex"), "tex")
    files.write_tex(tex, f"{folder}/tex", support)
    return tex


def named(spec: str) -> Callable:
    """``module:function``."""
    module, _, function = spec.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperloom", description="Papers to LaTeX")
    p.add_argument("input", help="a file, a folder or a pattern of .pdf, .docx and .doc files")
    p.add_argument("--template", "-t", choices=list(C.LAYOUTS), default="ieee")
    p.add_argument("--output", "-o", default="output", help="a folder that driver and executors share")
    p.add_argument("--pdf-backend", help="module:function giving (page, text, font, size) rows of a PDF file's bytes")
    a = p.parse_args(argv)
    try:
        spark = SparkSession.builder.appName("paperloom").getOrCreate()
        made = run(spark, a.input, a.template, a.output, named(a.pdf_backend) if a.pdf_backend else None).count()
        if made == 0:
            raise RuntimeError(f"nothing could be rendered; see {a.output}/rejected")
        print(f"{made} papers in {a.output}/tex")
        return 0
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except RuntimeError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 2
    except Exception:  # the last exit code stands for whatever is left
        traceback.print_exc()
        return 3
