from paperloom.operators import chars, images


def test_chars(spark):
    c = lambda i, t, x0, x1, top, size: (1, 0, i, t, float(x0), float(x1), float(top), float(top) + size, float(size))
    rows = [c(0, "a", 0, 5, 100, 10), c(1, "b", 5, 10, 100, 10), c(2, "c", 20, 25, 100, 10), c(3, "i", 25, 28, 104, 6), c(4, "d", 0, 5, 112, 10), c(5, "e", 0, 5, 200, 10), c(6, "f", 5, 10, 200, 10)]
    l = chars.lines(spark.createDataFrame(rows, "doc_id int, page int, char_idx int, text string, x0 double, x1 double, top double, bottom double, size double"))
    assert [r["text"] for r in l.orderBy("line_idx").collect()] == ["ab $c_{i}$", "d", "ef"]
    b = chars.blocks(l).orderBy("block_idx").collect()
    assert [r["text"] for r in b] == ["ab $c_{i}$\nd", "ef"]
    assert chars.document_text(chars.blocks(l)).first()["text"] == "ab $c_{i}$\nd\nef"


BLOCKS = "doc_id int, page int, block_idx int, text string, fonts array<string>, x0 double, y0 double, x1 double, y1 double"


def test_numbers_and_regions(spark):
    b = spark.createDataFrame([
        (1, 0, 0, "(7)", ["x"], 500.0, 100.0, 520.0, 110.0), (1, 0, 1, "α + β ≤ γ ∑ δ", ["x"], 0.0, 90.0, 200.0, 120.0), (1, 0, 2, "ab α β", ["CMSY10"], 0.0, 200.0, 100.0, 230.0),
        (1, 0, 3, "A = b\n(2)", [], 0.0, 300.0, 100.0, 330.0), (1, 0, 4, "plain", [], 0.0, 400.0, 100.0, 430.0), (1, 0, 5, "ends so (4)", [], 0.0, 600.0, 100.0, 610.0),
    ], BLOCKS)
    assert [(r["number"], r["y"]) for r in images.equation_numbers(b).collect()] == [("7", 105.0)]
    assert {r["block_idx"] for r in images.formula_regions(b).collect()} == {1, 2}
    assert {(r["number"], r["alone"], r["sibling"]) for r in images.line_numbers(b).collect()} == {("7", True, False), ("2", True, True), ("4", False, False)}
    f = spark.createDataFrame([(1, 0, 0, 90.0, 20.0, 300.0), (1, 0, 1, 95.0, 0.0, 0.0), (1, 1, 2, 5.0, 0.0, 0.0)], "doc_id int, page int, idx int, y double, h double, w double")
    got = images.number_formulas(f, images.line_numbers(b).where("alone"))
    assert {(r["idx"], r["equation_number"]) for r in got.collect()} == {(0, "7"), (1, ""), (2, "")}
    assert images.unmatched_regions(b, got).count() == 0
    left = images.unmatched_regions(b, got.where("idx = 1")).collect()
    assert [(r["number"], r["y0"], r["y1"], r["x1"]) for r in left] == [("7", 55.0, 120.0, 542.0)]


def test_page_images(spark):
    listing = spark.createDataFrame([(1, p, 3, 0, x, w, h, n) for p, x, w, h, n in [(1, 1, 1000, 1000, 500), (1, 1, 1000, 1000, 500), (1, 2, 900, 900, 50), (1, 3, 300, 200, 500), (1, 4, 10, 10, 500), (0, 9, 500, 500, 500), (2, 9, 500, 500, 500)]], "doc_id int, page int, pages int, image_idx int, xref int, width_px int, height_px int, n_bytes int")
    box = "doc_id int, page int, xref int, x0 double, y0 double, x1 double, y1 double"
    none = spark.createDataFrame([], box)
    captions = spark.createDataFrame([(1, 1, "Fig. 2. x", 500.0, 510.0)], "doc_id int, page int, text string, y0 double, y1 double")
    r = spark.createDataFrame([(1, 1, 3, 50.0, 400.0, 250.0, 490.0)], box)
    tables = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    got = images.page_images(listing.where("xref <> 1"), r, none, captions, tables)
    assert [(x["xref"], x["kind"]) for x in got.collect()] == [(3, "figure")]
    assert images.records(got, "figure").first()["label"] == "fig_1_0"
    assert images.drop_headers(got).count() == 1


def test_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 50.0, 20.0), (1, 0, 0, 50.0, 0.0, 100.0, 20.0), (1, 0, 0, 0.0, 20.0, 50.0, 40.0)], "doc_id int, page int, table_idx int, x0 double, y0 double, x1 double, y1 double")
    grid = images.cell_grid(cells)
    assert {(r["row_idx"], r["col_idx"]) for r in grid.collect()} == {(0, 0), (0, 1), (1, 0)}
    pic = spark.createDataFrame([(1, 0, 55.0, 2.0, 75.0, 18.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    m = images.mark_cells(grid, pic).collect()
    assert [(r["marker"], r["crop"]["x0"]) for r in m] == [("\\CELLIMG{tcell_0_0_0_1.png}", 52.0)]


def test_readings(spark):
    read = lambda rows: spark.createDataFrame(rows, "path string, latex string")
    a, b = read([("p", r"\frac{a}{b}=c^{2}"), ("q", "x")]), read([("p", ""), ("q", "")])
    f = spark.createDataFrame([("p", "", 0.5), ("q", "", 0.5), ("", "y", 0.9)], "image_path string, latex string, confidence double")
    assert {(r["image_path"], r["latex"]) for r in images.merge_readings(f, a, b).collect()} == {("p", r"\frac{a}{b}=c^{2}"), ("q", ""), ("", "y")}
    c = spark.createDataFrame([(r"\CELLIMG{p}",), ("plain",), (r"\CELLIMG{q}",)], "cell string")
    assert {r["cell"] for r in images.merge_cell_readings(c, a, b).collect()} == {r"\CELLEQ{\frac{a}{b}=c^{2}||IMG:p}", "plain", r"\CELLIMG{q}"}


def test_split_at_formulas(spark):
    from paperloom.operators import layout

    lines = spark.createDataFrame(
        [(1, 0, 0, 0, 0.0, 10.0, "a", "F"), (1, 0, 0, 1, 12.0, 22.0, "b", "G"), (1, 0, 0, 2, 36.0, 46.0, "c", "G"), (1, 0, 0, 3, 70.0, 80.0, "d", "G"), (2, 0, 0, 0, 5.0, 5.0, "e", "F"), (2, 0, 0, 1, 24.0, 24.0, "f", "F"), (2, 0, 0, 2, 44.0, 44.0, "g", "F")],
        "doc_id long, block_idx int, page int, line_idx int, y0 double, y1 double, text string, font string",
    ).selectExpr("*", "0.0D as x0", "9.0D as x1", "10.0D as size")
    spans = spark.createDataFrame([(1, 0, 24.0, 30.0), (1, 1, 10.5, 11.5), (9, 0, 1.0, 2.0)], "doc_id long, page int, y0 double, y1 double")
    runs = lambda *s: [r["run"] for r in layout.split_blocks(lines, *s).orderBy("doc_id", "line_idx").collect()]
    # A gap of 14 is not large, but holds a formula; lines without height count as 12 high, so 19 is not large and 20 is.
    assert runs() == [0, 0, 0, 1, 0, 0, 1]
    assert runs(spans) == [0, 0, 1, 2, 0, 0, 1]
    got = {(r["doc_id"], r["run"]): (r["text"], r["font"]) for r in layout.join_runs(layout.split_blocks(lines)).collect()}
    assert got[1, 0] == ("a\nb\nc", "G")
