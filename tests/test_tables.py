from pyspark.sql import functions as F

from paperloom.operators import authors, tables


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("r")).first()["r"]


def test_numbers(spark):
    assert one(spark, "† MAML 1 . 26 ⇑ 3 45 123 4 . x", tables.join_numbers) == ["MAML", "1.26⇑", "3.45", "123", "4.", "x"]
    assert one(spark, "5 1 . 26", tables.join_numbers) == ["5.1", ".", "26"]
    assert one(spark, "", tables.join_numbers) == []


def test_row(spark):
    row = lambda v, n: spark.range(1).select(tables.table_row(F.lit("m"), F.array(*map(F.lit, v)), F.lit(n)).alias("r")).first()["r"]
    assert row(["1", "†", "2"], 3) == ["m", "1", "2", ""] and row(["1", "2"], 1) == ["m", "1"]


def test_lines(spark):
    assert one(spark, "Skillcraft SML Parkinsons Bike", tables.is_header) and not one(spark, "this is the line of text", tables.is_header)
    assert one(spark, "#Clients 10 100", tables.is_subheader) and one(spark, "Train/Test 1", tables.is_table_metadata)
    assert one(spark, "#Clients 10 1e3 x", tables.sub_values) == ["10", "1e3"]


def test_detect(spark):
    rows = [
        (1, 0, "Table 1. RMSE of all regression models"), (1, 1, "Skillcraft SML Parkinsons"), (1, 2, "MAML 1 . 26 0 . 5 0 . 7\nFed Avg\n2 . 26 1 . 5 1 . 7"),
        (1, 3, "2. Conclusion"), (1, 4, "Other 1.0 2.0 3.0"), (2, 0, "Table talk"), (2, 1, "Table 2. Nothing follows"), (3, 0, ""),
    ]
    got = tables.detect(spark.createDataFrame(rows, "doc_id int, block_idx int, text string")).collect()
    assert len(got) == 1 and got[0]["headers"] == ["Method", "Skillcraft", "SML", "Parkinsons"] and got[0]["label"] == "tab:1"
    assert got[0]["rows"] == [["MAML", "1.26", "0.5", "0.7"], ["Fed Avg", "2.26", "1.5", "1.7"]] and got[0]["caption"] == "RMSE of all regression models"


def test_residue(spark):
    body = "Kept text 3 here.\nTable 1. Gone\n1.2 3.4 ⇑\nMAML 1.0 2.0\nSkill Park Bike\nMore"
    df = spark.createDataFrame([(body, [("tab:1", ["Method", "Skill(1)", "Park_2", "Bike"], [["MAML", "1.0"]])]), (body, [])], "b string, t array<struct<label: string, headers: array<string>, rows: array<array<string>>>>")
    got = [r["r"] for r in df.select(tables.strip_residue(F.col("b"), F.col("t")).alias("r")).collect()]
    assert got[1] == body and "MAML" not in got[0] and "Skill" not in got[0] and "3.4" not in got[0] and got[0].startswith("Kept text 3 here.") and got[0].endswith("More")


def test_authors(spark):
    rows = [
        (1, 0, "A Long Paper Title", 16.0), (1, 1, "SZABÓ*\nPeter\nDepartment of Mathematics, Slovakia\nTechnical University\nKošice,Slovakia\npeter@tuke.sk", 10.0),
        (1, 2, "Ann Lee and Bob Ray\nIndia", 10.0), (1, 3, "Abstract. Text", 10.0), (1, 4, "Carl Doe", 10.0), (2, 0, "Only text here", 10.0),
    ]
    got = authors.authors(spark.createDataFrame(rows, "doc_id int, block_idx int, text string, size double")).orderBy("doc_id", "author_idx").collect()
    assert [tuple(r)[1:] for r in got if r["doc_id"] == 1] == [
        (0, "Peter SZABÓ", "Department of Mathematics", "Technical University", "Košice", "Slovakia", "peter@tuke.sk"),
        (1, "Ann Lee", "", "", "", "", ""), (2, "Bob Ray", "", "", "", "India", ""),
    ]
