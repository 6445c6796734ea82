from __future__ import annotations

import pytest
from pyspark.sql import types as T
from tables import rows

from tillroll import schemas
from tillroll.session import local_session, run_folder, shared_folder, stored
from tillroll.sources import catalog, database, files


def test_csv_keeps_declared_types(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write("product_id,product_name,category,brand,price,cost_price,stock_quantity\n")
        f.write('P0001,"Levi\'s, Jeans",Fashion,Levi\'s,12.30,,7\n')
    df = files.read_csv(spark, path, schemas.PRODUCTS)
    assert df.schema == schemas.PRODUCTS
    (row,) = rows(df)
    assert row[1] == "Levi's, Jeans" and str(row[4]) == "12.30" and row[5] is None


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("name,note,empty\n")
        f.write('"Rao ""Bo"", A","two\nlines",""\n')
        f.write("back\\slash,plain,\n")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "note", "empty")])
    expected = [('Rao "Bo", A', "two\nlines", None), ("back\\slash", "plain", None)]
    df = files.read_csv(spark, path, schema, line_breaks=True)
    assert sorted(rows(df)) == sorted(expected)
    files.export_csv(df, str(tmp_path / "again"))
    again = files.read_csv(spark, str(tmp_path / "again"), schema, line_breaks=True)
    assert sorted(rows(again)) == sorted(expected)


def test_csv_timestamps_with_and_without_fraction(spark, tmp_path):
    path = str(tmp_path / "o.csv")
    with open(path, "w") as f:
        f.write(",".join(schemas.ORDERS.fieldNames()) + "\n")
        f.write("O1,C1,2024-06-02 02:28:04.672063,,Standard,Delivered,1.5\n")
        f.write("O2,C1,2024-06-02 02:28:04,UPI,Standard,Delivered,2\n")
    found = {r.order_id: r.order_date for r in files.read_csv(spark, path, schemas.ORDERS).collect()}
    assert found["O1"].microsecond == 672063 and found["O2"].second == 4


def test_csv_with_a_broken_number_stops(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write("product_id,product_name,category,brand,price,cost_price,stock_quantity\n")
        f.write("P0001,Jeans,Fashion,L,cheap,1,7\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed"):
        files.read_csv(spark, path, schemas.PRODUCTS).collect()


def test_csv_with_a_wrong_header_stops(spark, tmp_path):
    path = str(tmp_path / "items.csv")
    with open(path, "w") as f:
        f.write("order_item_id,product_id,order_id,quantity,unit_price\nI1,P1,O1,1,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, path, schemas.ORDER_ITEMS).collect()


def test_replace_then_append(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(5), path)
    files.replace_table(spark.range(2), path)
    files.append_rows(spark.range(10, 12), path)
    assert sorted(r[0] for r in rows(spark.read.parquet(path))) == [0, 1, 10, 11]


def test_replace_with_partitions_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(6).selectExpr("id", "2020 + id % 3 AS order_year")
    files.replace_table(df, path, partition_by=["order_year"])
    plan = spark.read.parquet(path).where("order_year = 2021")
    assert sorted(r[0] for r in rows(plan)) == [1, 4]
    assert "PartitionFilters: [isnotnull(order_year" in plan._jdf.queryExecution().toString()


def test_catalog_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS till_test")
    catalog.create_tables(spark, "till_test")
    catalog.create_tables(spark, "till_test")
    tables = catalog.catalog_tables(spark, "till_test")
    assert tables.order_items.columns == schemas.ORDER_ITEMS.fieldNames()
    new = spark.createDataFrame([("O1", "I1", "P1", 2, 9.5)], "order_id string, order_item_id string, product_id string, quantity int, unit_price double")
    catalog.insert_rows(new, "till_test.order_items")
    catalog.insert_rows(new, "till_test.order_items")
    stored_rows = rows(spark.table("till_test.order_items"))
    assert [(r[0], r[1], str(r[4])) for r in stored_rows] == [("I1", "O1", "9.50")] * 2
    spark.sql("DROP DATABASE till_test CASCADE")


def test_text_wider_than_declared_is_rejected(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS till_width")
    catalog.create_tables(spark, "till_width")
    wide = spark.createDataFrame([("I" * 51, "O", "P", 1, 1.0)], "order_item_id string, order_id string, product_id string, quantity int, unit_price double")
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH|limitation"):
        catalog.insert_rows(wide, "till_width.order_items")
    spark.sql("DROP DATABASE till_width CASCADE")


def test_views_can_be_replaced_and_imported(spark):
    catalog.replace_view(spark.range(3), "v_some")
    catalog.replace_view(spark.range(4), "v_some")
    assert catalog.import_views(spark, ["v_some"])["v_some"].count() == 4


def test_jdbc_options():
    split = database.SplitColumn("order_date", "2024-01-01", "2026-01-01", 32)
    options = database.jdbc_options("jdbc:postgresql://db/shop", "orders", split, user="u", password="p")
    assert options["driver"] == "org.postgresql.Driver"
    assert (options["partitionColumn"], options["numPartitions"]) == ("order_date", "32")
    assert "partitionColumn" not in database.jdbc_options("jdbc:sqlite:shop.db", "Orders")
    with pytest.raises(ValueError):
        database.jdbc_options("postgresql://db/shop", "orders")


def test_stored_goes_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert run_folder(spark, "x") != run_folder(spark, "x")
    kept = stored(spark.range(3), "ids")
    assert kept.inputFiles()[0].startswith(f"file://{folder}/ids-")
    assert kept.count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_local_session_is_shared(spark):
    assert local_session() is spark or local_session().sparkContext is spark.sparkContext


ITEM_LINES = """order_item_id,order_id,product_id,quantity,unit_price
I1,O1,P1,1,2.50
I2,O1,P1,many,2.50
I3,O1,P1,1
I4,O1,P1,1,2.50,7
I5,"O ""1"", b",P1,,2.5
I6,O1,P1,2,cheap
I7,O1,,2,99999999999.99
"""


def test_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    extract, rejects = tmp_path / "items.csv", str(tmp_path / "rejects")
    extract.mkdir()
    (extract / "a.csv").write_text(ITEM_LINES)
    (extract / "b.csv").write_text(ITEM_LINES.splitlines()[0] + "\nI9,O9,P9,3,1\n")
    good = files.load_csv(spark, str(extract), schemas.ORDER_ITEMS, rejects, most_rejects=5)
    assert good.schema == schemas.ORDER_ITEMS
    found = {r[0]: r for r in rows(good)}
    assert set(found) == {"I1", "I5", "I9"} and found["I5"][1] == 'O "1", b' and found["I5"][3] is None
    bad = {r["line"].split(",")[0]: r for r in spark.read.parquet(rejects).collect()}
    assert {i: r["reason"] for i, r in bad.items()} == {
        "I2": "quantity is no int",
        "I3": "wrong number of values",
        "I4": "wrong number of values",
        "I6": "unit_price is no decimal(10,2)",
        "I7": "unit_price is no decimal(10,2)",
    }
    assert all(r["file"].endswith("/items.csv/a.csv") for r in bad.values())
    assert bad["I6"]["line"] == "I6,O1,P1,2,cheap"


def test_too_many_rejects_stop_the_load_after_they_were_written(spark, tmp_path):
    (tmp_path / "items.csv").write_text(ITEM_LINES)
    with pytest.raises(ValueError, match="5 lines .* were rejected, more than 4"):
        files.load_csv(spark, str(tmp_path / "items.csv"), schemas.ORDER_ITEMS, str(tmp_path / "r"), most_rejects=4)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 5


def test_a_load_without_rejects_and_one_with_a_wrong_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(ITEM_LINES.splitlines()[:2]) + "\n")
    assert files.load_csv(spark, str(tmp_path / "a.csv"), schemas.ORDER_ITEMS, str(tmp_path / "r"), 0).count() == 1
    (tmp_path / "b.csv").write_text("order_item_id,product_id,order_id,quantity,unit_price\nI1,P1,O1,1,2\n")
    with pytest.raises(Exception, match="header|Header"):
        files.load_csv(spark, str(tmp_path / "b.csv"), schemas.ORDER_ITEMS, str(tmp_path / "s")).collect()
