import io
import zipfile

from paperloom.sources import files


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:sz w:val="28"/></w:rPr><w:t>Title</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx())
    d = files.binary_documents(spark, str(tmp_path))
    b = files.docx_blocks(d).first()
    assert (b["text"], b["size"], b["is_heading"], b["heading_level"]) == ("Title", 14.0, True, 1)
    assert {(r["kind"], r["cell"]) for r in files.docx_cells(d).collect()} == {("header", "a"), ("header", "b"), ("body", "1"), ("body", "2")}


def test_labels(spark, tmp_path):
    (tmp_path / "in.txt").write_text("Introduction\n\nlong text goes here\n")
    files.write_labels(files.text_lines(spark, str(tmp_path / "in.txt")), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r["line"], r["auto_label"]) for r in rows} == {("Introduction", "heading"), ("long text goes here", "body")}


def test_pdf_by_backend(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    d = files.binary_documents(spark, str(tmp_path))
    t = files.pdf_tables(d, lambda c: [(0, (0, 0, 9, 9), [["h"], ["1"]]), (0, (0, 0, 9, 9), [["alone"]]), (0, (1, 1, 2, 2), [["k"], ["2"]])]).collect()
    assert [(r["label"], r["headers"], r["rows"]) for r in t] == [("tab_0_1", ["h"], [["1"]]), ("tab_0_2", ["k"], [["2"]])]


def test_readings(spark):
    def engine(batch):
        return [b.decode() for b in batch]

    got = files.read_images(spark.createDataFrame([("a", b"x=1"), ("b", b"\xff")], "path string, content binary").coalesce(1), engine)
    assert {(r["path"], r["latex"]) for r in got.collect()} == {("a", "x=1"), ("b", "")}


def test_tex_and_log(spark, tmp_path):
    t = spark.createDataFrame([("a", "x"), ("b", "é")], "name string, tex string")
    files.write_tex(t, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tex", "b.tex"]
    r = files.compile_errors(files.compile_pdf(t, lambda tex: (None, "! bad\nfine\n" * 7 + "no output PDF file produced"))).first()
    assert r["fatal"] and r["errors"] == ["! bad"] * 5


def test_line_model(spark, tmp_path):
    from paperloom.operators import line_model

    rows = [(f"Heading {w}", "heading") for w in ("One", "Two", "Three")] + [("this is a much longer line of body text, which goes on and on until it ends.", "body")] * 3 + [("", "")]
    lines = spark.createDataFrame(rows, "line string, corrected_label string")
    model = line_model.train(lines)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = line_model.predict(lines.where("line <> ''"), line_model.load(str(tmp_path / "m")))
    assert got.where("label <> corrected_label").count() == 0
    assert line_model.load(str(tmp_path / "none")) is None
