"""Sources: documents by extension, DOCX with the standard library, text lines; PDF by a given backend."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, block_idx int, page int, text string, font string, size double, is_heading boolean, heading_level int"
CELLS = "path string, table_idx int, kind string, row_idx int, col_idx int, cell string"


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.{[pP][dD][fF],[dD][oO][cC],[dD][oO][cC][xX]}") -> DataFrame:
    """path, engine, content; a ``.doc`` file is read if it holds what a ``.docx`` file does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select("path", F.when(extension == "pdf", "pdf").when(extension.isin("docx", "doc"), "docx").alias("engine"), "content")


def parse_docx(content: bytes) -> tuple[list[tuple], list[list[list[str]]]]:
    """(paragraphs as (text, font, size, is_heading, level), tables as rows of cells); nothing of other formats."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return [], []
    body = root.find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    paragraphs, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{W}p" and text(e).strip():
            style = e.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            run = e.find(f"{W}r/{W}rPr")
            size = run.find(f"{W}sz") if run is not None else None
            font = run.find(f"{W}rFonts") if run is not None else None
            level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
            paragraphs.append((text(e).strip(), font.get(f"{W}ascii", "") if font is not None else "", float(size.get(f"{W}val")) / 2 if size is not None else 0.0, name.startswith("Heading"), level))
        elif e.tag == f"{W}tbl":
            rows = [[text(c).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]
            if len(rows) >= 2:  # the first row is the header
                tables.append(rows)
    return paragraphs, tables


def docx_blocks(documents: DataFrame) -> DataFrame:
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(p, i, 0, *b) for p, c in zip(frame["path"], frame["content"]) for i, b in enumerate(parse_docx(c)[0])]
            yield pd.DataFrame(out, columns=["path", "block_idx", "page", "text", "font", "size", "is_heading", "heading_level"])

    return documents.where("engine = 'docx'").select("path", "content").mapInPandas(run, BLOCKS)


def docx_cells(documents: DataFrame) -> DataFrame:
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(p, t, "header" if r == 0 else "body", r, k, cell) for p, c in zip(frame["path"], frame["content"]) for t, rows in enumerate(parse_docx(c)[1]) for r, row in enumerate(rows) for k, cell in enumerate(row)]
            yield pd.DataFrame(out, columns=["path", "table_idx", "kind", "row_idx", "col_idx", "cell"])

    return documents.where("engine = 'docx'").select("path", "content").mapInPandas(run, CELLS)


def pdf_blocks(documents: DataFrame, backend: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Blocks of PDF files by a backend: content -> [(page, text, font, size)]."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(p, i, page, text, font, size, False, 0) for p, c in zip(frame["path"], frame["content"]) for i, (page, text, font, size) in enumerate(backend(c))]
            yield pd.DataFrame(out, columns=["path", "block_idx", "page", "text", "font", "size", "is_heading", "heading_level"])

    return documents.where("engine = 'pdf'").select("path", "content").mapInPandas(run, BLOCKS)


def pdf_tables(documents: DataFrame, backend: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Gridded tables of PDF files by a backend: content -> [(page, box, rows of cells)]; one scan serves cells and boxes.

    Row 0 is the header; tables of under two rows go; labels are tab_{page}_{n}.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for p, c in zip(frame["path"], frame["content"]):
                seen: dict[int, int] = {}
                for page, box, rows in backend(c):
                    if len(rows) >= 2:
                        seen[page] = seen.get(page, 0) + 1
                        out.append((p, page, f"tab_{page}_{seen[page]}", *map(float, box), rows[0], rows[1:]))
            yield pd.DataFrame(out, columns=["path", "page", "label", "x0", "y0", "x1", "y1", "headers", "rows"])

    return documents.where("engine = 'pdf'").select("path", "content").mapInPandas(run, "path string, page int, label string, x0 double, y0 double, x1 double, y1 double, headers array<string>, rows array<array<string>>")


def read_images(images: DataFrame, engine: Callable[[list[bytes]], list[str]]) -> DataFrame:
    """path, latex of images by a recognition engine, a batch at a time; an image that fails reads as empty."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            try:
                read = engine(list(frame["content"]))
            except Exception:  # one bad image must not cost the batch
                read = []
                for c in frame["content"]:
                    try:
                        read += engine([c])
                    except Exception:
                        read.append("")
            yield pd.DataFrame({"path": frame["path"], "latex": [r or "" for r in read]})

    return images.select("path", "content").mapInPandas(run, "path string, latex string")


def write_tex(documents: DataFrame, folder: str, support: dict[str, bytes] | None = None) -> None:
    """One file {name}.tex a row of (name, tex) in a folder that all executors share, and class files beside them.

    Each file is written aside and renamed, so that a repeated task leaves whole files.
    """

    def put(name: str, content: bytes) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        aside = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(aside, "wb") as out:
            out.write(content)
        os.replace(aside, os.path.join(folder, name))

    def write(rows) -> None:
        for row in rows:
            put(f"{row['name']}.tex", row["tex"].encode())

    documents.select("name", "tex").foreachPartition(write)
    for name, content in (support or {}).items():
        put(name, content)


def compile_pdf(documents: DataFrame, compiler: Callable[[str], tuple[bytes | None, str]]) -> DataFrame:
    """name, pdf, log of (name, tex) rows by a compiler: tex -> (PDF or None, log)."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(n, *compiler(t)) for n, t in zip(frame["name"], frame["tex"])], columns=["name", "pdf", "log"])

    return documents.select("name", "tex").mapInPandas(run, "name string, pdf binary, log string")


def compile_errors(logs: DataFrame) -> DataFrame:
    """name, fatal, errors: whether no PDF came out, and the first five error lines of a compiler's log."""
    found = F.filter(F.split("log", "\n"), lambda v: v.startswith("!") | v.contains("Fatal error"))
    return logs.select("name", F.col("log").contains("no output PDF file produced").alias("fatal"), F.slice(found, 1, 5).alias("errors"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def write_json(df: DataFrame, path: str) -> None:
    """One object a row, nulls kept as such, other letters than ASCII as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """line, auto_label, corrected_label, features as CSV with a header."""
    from ..functions import text as T

    features = F.concat_ws(" ", *[c.cast("string") for c in T.line_features(F.col("line")).values()])
    lines.select("line", T.auto_label(F.col("line")).alias("auto_label"), F.lit("").alias("corrected_label"), features.alias("features")).write.mode("overwrite").option("header", True).csv(path)
