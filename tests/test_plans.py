"""Queries against their DuckDB counterparts on texts that tell the operators' rules for papers from the SQL's plain ones."""

import pytest

duckdb = pytest.importorskip("duckdb")

TEXTS = {
    1: "4451718024887799 27.65.93.188 Arrr de, cin +1 (863) 555-9426 la que quo vadis ad astra et cetera.",  # the title is numbered
    2: "A line of text that is long enough\nRe dbhcoh.37@mail4.example.com anre en la la and the rest of it\nAnother line of text, Long enough",
    3: "First line of the text, long enough\nit ends in References\nMore text that follows here\nand the last of its lines",
    4: "References\nThe list comes first in this text of ours\nand goes on with this",
    5: "Text before the list, which is long enough\nreferences\nSmith, J.: A title of some length that stands alone\nand a line that goes on with it, long enough\nSee ISSN 1234-5678, a line of metadata that is long",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("plans"))
    spark.createDataFrame([(k, v, "en", "web", len(v)) for k, v in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def both(spark, folder, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(map(tuple, e.queries()[name](spark, folder).collect())), sorted(con.execute(e.oracle_sql()[name]).fetchall())


def test_section_split_as_its_sql(spark, folder):
    got, told = both(spark, folder, "section_split")
    assert got == told and any(r[0] == 1 and r[2].startswith("27.65") for r in got)


def test_reference_dedup_as_its_sql(spark, folder):
    got, told = both(spark, folder, "reference_dedup")
    assert got == told and sum(r[0] == 2 for r in got) == 3


def test_table_round_robin_as_its_sql(spark, folder):
    got, told = both(spark, folder, "table_round_robin")
    assert got == told and sum(r[0] == 1 for r in got) == 3
