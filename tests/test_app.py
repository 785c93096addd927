import io
import json
import zipfile

import pytest

from paperloom import app

PARTS = [
    ("A Paper of Formulas", 16), ("Abstract", 10), ("What is said here in short is said again below, at more length than this.", 10), ("1. Introduction", 12),
    ("A paragraph with this &amp; that in it.", 10), ("2. Results", 12), ("As the table shows.", 10), (None, 0), ("3. Conclusion", 12), ("It ends here.", 10),
]


def docx(parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('Name')}{cell('Loss')}</w:tr><w:tr>{cell('Ours')}{cell('0.5')}</w:tr></w:tbl>"
    body = "".join(table if t is None else f'<w:p><w:r><w:rPr><w:sz w:val="{2 * s}"/></w:rPr><w:t>{t}</w:t></w:r></w:p>' for t, s in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def rows(folder):
    return [json.loads(line) for f in folder.glob("*.json") for line in f.read_text().splitlines()]


def test_files_to_tex(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.docx").write_bytes(docx(PARTS))
    (source / "broken.DOC").write_bytes(b"another format")
    (source / "notes.txt").write_text("not read")
    assert app.main([str(source), "-t", "acm", "-o", str(out)]) == 0
    made = list((out / "tex").iterdir())
    tex = made[0].read_text()
    assert len(made) == 1 and made[0].name.startswith("a-") and made[0].suffix == ".tex"
    order = ["\\title{A Paper of Formulas}", "said again below", "\\section{Introduction}", "this \\& that", "\\section{Results}", "\\begin{tabular}", "Ours & 0.5", "\\section{Conclusion}"]
    at = [tex.find(x) for x in order]
    assert -1 not in at and at == sorted(at), [x for x, a in zip(order, at) if a < 0]
    assert [s["heading"] for s in rows(out / "structured")[0]["sections"]] == ["Introduction", "Results", "Conclusion"]
    assert rows(out / "extracted")[0]["text"].startswith("A Paper of Formulas\nAbstract")
    assert [(r["doc_id"].rsplit("/", 1)[1], r["summary"]) for r in rows(out / "rejected")] == [("broken.DOC", "no text was found")]


@pytest.mark.parametrize("name", ["none.docx", "notes.txt"])
def test_input_that_is_missing_or_of_another_kind(spark, tmp_path, name):
    (tmp_path / "notes.txt").write_text("not read")
    assert app.main([str(tmp_path / name)]) == 1


def test_pdf_needs_a_backend(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert app.main([str(tmp_path / "x.pdf"), "-o", str(tmp_path / "out")]) == 2


def test_class_files(spark, tmp_path):
    from paperloom.sources import files

    files.write_tex(spark.createDataFrame([("a", "x")], "name string, tex string"), str(tmp_path / "t"), {"acm.cls": b"class"})
    assert (tmp_path / "t" / "acm.cls").read_bytes() == b"class" and (tmp_path / "t" / "a.tex").read_text() == "x"
