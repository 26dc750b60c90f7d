import datetime as dt
import json
import zipfile

import pytest

from cubewright.operators import rules
from cubewright.sources import catalog, modelfile


def test_csv_folder_is_a_dataset_for_each_file(spark, tmp_path):
    (tmp_path / "shops.csv").write_text("id,name\n1,A\n2,\n")
    (tmp_path / "sales.csv").write_text("id,amount\n1,2.5\n")
    (tmp_path / "notes.txt").write_text("no table")
    found = catalog.csv_folder(spark, str(tmp_path))
    assert found.names() == ["sales", "shops"]
    assert dict(found["SALES"].dtypes) == {"id": "int", "amount": "double"}
    assert [tuple(r) for r in found.preview("shops").collect()] == [("1", "A"), ("2", "")]
    assert {r["dataset"]: r["rows"] for r in found.row_counts().collect()} == {"sales": 1, "shops": 2}
    assert found.query("SELECT sum(amount) AS s FROM sales").first()["s"] == 2.5
    assert found.compare_rows(found).where("not equal").count() == 0
    with pytest.raises(catalog.SourceError):
        catalog.csv_folder(spark, str(tmp_path / "empty")) if (tmp_path / "empty").mkdir() is None else None


@pytest.mark.parametrize("sql, good", [("SELECT 1", True), ("SELECT `set`, cache FROM t WHERE into = 1", True), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False), ("SET x = 1", False), ("CACHE TABLE t", False), ("MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN DELETE", False), ("EXPLAIN SELECT 1", False), ("TABLE t", True), ("with a as (select 1) select * from a", True), ("DROP TABLE x", False), ("SELECT 1; SELECT 2", False), ("SELECT 'drop; it'", True), ("SELECT * INTO t FROM x", False), ("-- note\nSELECT 1", True)])
def test_read_only(spark, sql, good):
    if good:
        catalog.require_read_only(spark, sql)
    else:
        with pytest.raises(catalog.SourceError):
            catalog.require_read_only(spark, sql)


def test_percent_guard():
    assert catalog.scales_percent_twice("SELECT FORMAT(100.0 * a / b, '0.0%')")
    assert not catalog.scales_percent_twice("SELECT FORMAT(a / b, '0.0%')")


def test_connection_url():
    url = catalog.SqlServer("db", "sales").url()
    assert url == "jdbc:sqlserver://db:1433;databaseName=sales;encrypt=true;trustServerCertificate=true;integratedSecurity=true"
    assert "integratedSecurity" not in catalog.SqlServer("db", "sales", user="u", password="p").url()


def test_low_cardinality_counts_are_exact_at_the_edge(spark):
    df = spark.createDataFrame([(str(i % 24), str(i % 25), "x" if i else None, i) for i in range(500)], "a string, b string, c string, n int")
    found = {r["column"]: len(r["members"]) for r in catalog.low_cardinality(df).collect()}
    assert found == {"a": 24, "c": 1}
    assert catalog.low_cardinality(df.where("false")).count() == 0


def test_workbook(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="Shops" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2" t="inlineStr"><is><t>A</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in catalog.read_workbook(spark, str(path))["shops"].collect()] == [(None, "A")]


def test_model_file_feeds_the_rules(spark):
    model = {
        "model": {
            "tables": [
                {"name": "Sales", "columns": [{"name": "shop"}, {"name": "net", "type": "calculated", "expression": "[a] - [b]"}], "measures": [{"name": "Total", "expression": ["SUM(", "x)"]}, {"name": "Empty"}]},
                {"name": "LocalDateTable_1", "columns": []},
                {"name": "Shops", "columns": [], "partitions": [{"source": {"type": "calculated", "expression": ["VALUES(", "x)"]}}]},
            ],
            "relationships": [{"fromTable": "Sales", "fromColumn": "shop", "toTable": "Shops", "toColumn": "shop", "crossFilteringBehavior": "bothDirections"}],
        }
    }
    title = {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": "'Sales''s card'"}}}}}]}
    config = {"name": "v1", "singleVisual": {"visualType": "card", "vcObjects": title, "projections": {"Values": [{"queryRef": "Sales.Total"}]}}}
    layout = {"sections": [{"displayName": "Home", "visualContainers": [{"config": json.dumps(config)}]}, {"displayName": "Blank"}]}
    layout["filters"] = json.dumps([{"name": "f", "expression": {"Column": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Property": "shop"}}}])
    frames = modelfile.model_frames(spark, json.dumps(model), json.dumps(layout))
    assert modelfile.relationships(model)[0].both_directions
    assert [tuple(r) for r in frames["tables"].collect()] == [("Sales", False, None), ("Shops", True, "VALUES(\nx)")]
    assert [(r.column, r.calculated, r.formula) for r in frames["columns"].collect()] == [("shop", False, None), ("net", True, "[a] - [b]")]
    assert frames["visuals"].first().title == "Sales's card" and [tuple(r) for r in frames["filters"].collect()] == [("f", "Sales", "shop")]
    broken = {k: v for k, v in frames.items() if k != "pages"} | {"measures": spark.createDataFrame([("Sales", "Total")], "table string, measure string")}
    errors = {r.entity for r in rules.check_model(broken).where("rule_id = 'RULE-ERROR'").collect()}
    assert errors == {"measures_have_formulas", "pages_have_visuals", "bookmarks_have_pages"}
    found = {(r["rule_id"], r["entity"]) for r in rules.check_model(frames).where("not passed").collect()}
    assert found == {("MD-001", "Sales[Empty]"), ("MD-002", "Shops"), ("MD-003", "Sales->Shops"), ("MD-007", "Blank")}
    assert rules.check_images(spark.createDataFrame([("a", None), ("b", 100), ("c", 900)], "image string, width int")).count() == 2


def test_files_that_cannot_be_read_are_left_out(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.csv").mkdir()
    (tmp_path / "bad.csv" / "x.gz").write_bytes(b"no gzip")
    assert catalog.csv_folder(spark, str(tmp_path)).names() == ["good"]


def test_each_dataset_is_compared_alone(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x")], "id int, name string")
    frame.write.parquet(str(tmp_path / "lost"))
    lost = spark.read.parquet(str(tmp_path / "lost"))
    for f in (tmp_path / "lost").glob("*.parquet"):
        f.unlink()
    model = catalog.Catalog({"sales": frame, "shops": frame, "lost": lost, "towns": frame})
    source = catalog.Catalog({"dbo.fact_sales": frame, "shops": frame.drop("name").union(frame.drop("name"))})
    got = {(r.dataset, r.check): (r.passed, r.actual) for r in model.compare(source).collect()}
    assert got == {
        ("lost", "readable"): (False, ""), ("sales", "exists"): (True, "sales"), ("shops", "exists"): (True, "shops"), ("towns", "exists"): (False, ""),
        ("sales", "columns"): (True, ""), ("shops", "columns"): (False, "name"), ("sales", "rows"): (True, "1"), ("shops", "rows"): (False, "2"),
    }
    assert not model.reachable() and source.reachable()
    assert model.row_count("sales").first()["rows"] == 1


def test_queries_for_a_database():
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) SELECT * FROM a"):
        with pytest.raises(catalog.SourceError):
            catalog.require_one_query(bad)
    catalog.require_one_query("SELECT TOP 5 [set], 'a;b' FROM [t;u] -- ; note")


def test_summaries_of_runs(spark, tmp_path):
    from cubewright.sources import runs

    made = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "project_id string, day int, tests_total long")
    from pyspark.sql import functions as F

    made = made.withColumn("generated_at", F.make_date(F.lit(2020), F.lit(1), "day").cast("timestamp_ntz")).drop("day")
    runs.save_summaries(made.where("tests_total < 6"), str(tmp_path / "s"))
    runs.save_summaries(made.where("tests_total > 5"), str(tmp_path / "s"))
    (tmp_path / "s" / "of=a" / "bad.json").write_text("{no json")
    assert [(r.project_id, r.tests_total, r.tokens) for r in runs.list_summaries(spark, str(tmp_path / "s")).collect()] == [("a", 6, None), ("b", 7, None)]


def test_the_last_summary_of_equal_moments_is_a_certain_one(spark, tmp_path):
    from cubewright.sources import runs

    moment = dt.datetime(2024, 1, 1)
    rows = [("p", moment, 1), ("p", moment, 9), ("p", moment, 4), ("q", None, 2), ("q", moment, 1), (None, moment, 3)]
    for part in (rows[:2], rows[2:]):
        runs.save_summaries(spark.createDataFrame(part, "project_id string, generated_at timestamp_ntz, tests_total long"), str(tmp_path))
    assert [(r.project_id, r.tests_total) for r in runs.list_summaries(spark, str(tmp_path)).collect()] == [("p", 9), ("q", 1)]
