from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickscope.operators import quality as Q
from tickscope.operators.ingest import upsert_items
from tickscope.operators.joins import lookup
from tickscope.sources import files
from tickscope.sources import history as H
from tickscope.sources import tables

HEADER = "name,unix timestamp,price,quantity\n"
REDLINE = "AK-47%20%7C%20Redline%20(Field-Tested).csv"
FILES = {
    REDLINE: HEADER + "AK-47 | Redline,1700000000,10.5,3\nx,garbage,11,1\nx,,12,1\nx,1700000060,0.125,2.9\n",
    "Clutch%20Case.csv": HEADER,
    "Sticker%20%7C%20a+b.csv": HEADER + "s,also-bad,1,1\n",
    "broken-price.csv": HEADER + "b,1700000000,10,1\nb,garbage,ten,1\n",
    "no-price.csv": HEADER + "b,1700000000,,1\n",
    "no-price-on-dropped-row.csv": HEADER + "b,1700000000,3,1\nb,garbage,,1\n",
    "no-quantity.csv": HEADER + "b,1700000000,3,NaN\n",
    "text-quantity.csv": HEADER + "b,1700000000,3,5.0\nb,garbage,3,many\n",
    "text-quantity-whole.csv": HEADER + "b,1700000000,3,5\nb,garbage,3,many\n",
    "suffix.csv": HEADER + "b,1700000000,1.5d,5\n",
    "other-header.csv": "price,name\n1,2\n",
}
REJECTED = {
    "broken-price.csv", "no-price.csv", "no-quantity.csv", "text-quantity.csv", "suffix.csv", "other-header.csv",
    "bytes.csv", "zero.csv",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    for name, text in FILES.items():
        (path / name).write_text(text)
    (path / "bytes.csv").write_bytes(b"\xff\xfe not a csv")
    (path / "zero.csv").write_bytes(b"")
    (path / "notes.txt").write_text("not a history file")
    return str(path)


def test_identity_comes_from_the_file_name(spark, folder):
    rows = H.read_history_csv(spark, folder).filter(F.col("file_name") == REDLINE).collect()
    assert len(rows) == 5
    assert {(r.market_hash_name, r.item_type) for r in rows} == {("AK-47 | Redline (Field-Tested)", "Weapon Skin")}
    names = {r.file_name for r in H.list_history_files(spark, folder).collect()}
    assert names == {*FILES, "bytes.csv", "zero.csv"}


def test_clean_rows(spark, folder):
    raw = H.read_history_csv(spark, folder).filter(F.col("file_name") == REDLINE)
    rows = sorted(map(tuple, H.clean_history(raw).select("sale_date", "median_price_cents", "volume_sold").collect()))
    assert rows == [(datetime(2023, 11, 14, 22, 13, 20), 1050, 3), (datetime(2023, 11, 14, 22, 14, 20), 12, 2)]


def test_one_bad_value_rejects_its_file_only(spark, folder):
    load = H.load_history(H.read_history_csv(spark, folder))
    assert {r.file_name for r in load.rejected_files.collect()} == REJECTED - {"zero.csv"}
    counts = {r.file_name: r["count"] for r in load.accepted.groupBy("file_name").count().collect()}
    assert counts == {REDLINE: 2, "no-price-on-dropped-row.csv": 1, "text-quantity-whole.csv": 1}


def test_empty_files_still_register_their_item(spark, folder):
    load = H.load_history(H.read_history_csv(spark, folder))
    names = H.files_to_register(H.list_history_files(spark, folder), load.rejected_files)
    registered = upsert_items(names, tables.read_table(spark, folder + "-none", "market_items"))
    assert {(r.market_hash_name, r.item_type) for r in registered.collect()} == {
        ("AK-47 | Redline (Field-Tested)", "Weapon Skin"), ("Clutch Case", "Container/Collectible"),
        ("Sticker | a+b", "Sticker"), ("no-price-on-dropped-row", "Agent"), ("text-quantity-whole", "Agent"),
    }
    assert sorted(r.id for r in registered.collect()) == [1, 2, 3, 4, 5]


def test_written_history_reads_back(spark, folder, tmp_path):
    load = H.load_history(H.read_history_csv(spark, folder))
    items = spark.createDataFrame(
        [(7, "AK-47 | Redline (Field-Tested)"), (8, "no-price-on-dropped-row"), (9, "text-quantity-whole")],
        "id BIGINT, market_hash_name STRING")
    path = str(tmp_path / "prices")
    H.write_history(load.accepted, items, path)
    H.write_history(load.accepted, items, path)
    assert spark.read.parquet(path).count() == 8
    H.write_history(load.accepted, items, path, truncate=True)
    assert spark.read.parquet(path).count() == 4
    assert spark.read.parquet(path).filter("item_id = 7").count() == 2


def test_validation_report(spark, folder):
    files = H.list_history_files(spark, folder)
    report = Q.validation_report(H.read_history_csv(spark, folder), files).first()
    assert report.files_total == len(FILES) + 2
    assert report.files_with_drops == 6
    assert report.rows_dropped == 7
    types = {r.item_type: r.files for r in Q.type_distribution(files).collect()}
    assert types["Weapon Skin"] == 1 and types["Sticker"] == 1 and types["Container/Collectible"] == 1


def test_sample_decodes(spark):
    files = spark.createDataFrame([(f"f{i:05d}.csv",) for i in range(9001)], "file_name STRING")
    identified = H.with_identity(files)
    for limit in (100_000, 1000):
        rows = Q.sample_decodes(identified, limit).collect()
        assert [r.idx for r in rows] == [1, 2, 3, 4, 3000, 6000]
        assert rows[4].file_name == "f02999.csv" and rows[4].market_hash_name == "f02999"


HISTORY = "item_id BIGINT, sale_date TIMESTAMP, median_price_cents BIGINT, volume_sold BIGINT"


def test_integrity(spark):
    day = datetime(2024, 1, 1)
    rows = [(1, day, 100, 1), (1, day, 100, 1), (2, None, 100, 1), (2, day, 0, 1), (3, day, 5, -1), (3, day, None, 2)]
    history = spark.createDataFrame(rows, HISTORY)
    scan = Q.integrity_scan(history).first()
    assert (scan.total_rows, scan.null_rows, scan.invalid_rows) == (6, 2, 2)
    assert Q.duplicate_keys(history).first().duplicate_keys == 2
    empty = Q.integrity_scan(history.limit(0)).first()
    assert (empty.total_rows, empty.min_date) == (0, None)
    items = spark.createDataFrame([(1, "a"), (9, "b")], "id BIGINT, market_hash_name STRING")
    assert tuple(Q.mapping_coverage(items, history).first()) == (1, 2)
    top = Q.top_items_by_points(history, items, 2).collect()
    assert [(r.market_hash_name, r.points) for r in top] == [("a", 2)]


def test_table_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read_table(spark, root, "market_items").count() == 0
    first = spark.createDataFrame([(1, "a", "Agent", None)], "id BIGINT, market_hash_name STRING, item_type STRING, rarity STRING")
    assert tables.write_snapshot(first, root, "market_items") == 1
    second = upsert_items(spark.createDataFrame([("b",)], "market_hash_name STRING"), tables.read_table(spark, root, "market_items"))
    assert tables.write_snapshot(second, root, "market_items") == 2
    assert {r.market_hash_name for r in tables.read_table(spark, root, "market_items").collect()} == {"a", "b"}


@pytest.mark.parametrize("further", [12, 13, 40, 3000])
def test_needed_columns_in_any_place(spark, tmp_path, further):
    more = ",".join(f'"x, {k}"' if k == 2 else f"x{k}" for k in range(further))
    (tmp_path / "wide.csv").write_text(f"quantity,{more},price, name ,unix timestamp\n3,{more},10.5,w,1700000000\n")
    (tmp_path / "usual.csv").write_text(HEADER + "u,1700000000,2.5,4\n")
    load = H.load_history(H.read_history_csv(spark, str(tmp_path)))
    assert load.rejected_files.count() == 0
    assert sorted((r.file_name, r.median_price_cents, r.volume_sold) for r in load.accepted.collect()) == [
        ("usual.csv", 250, 4), ("wide.csv", 1050, 3)]


def test_lines_are_cut_as_a_csv_reader_does(spark):
    lines = ['a,b,c', 'a,"b,c",d', '"a ""quoted"" one",2', ',,', '"",x', '"open,2', 'mid"dle,3', '"a"b,4', 'é,"ß,"']
    expected = [["a", "b", "c"], ["a", "b,c", "d"], ['a "quoted" one', "2"], ["", "", ""], ["", "x"], ['"open', "2"],
                ['mid"dle', "3"], ['"a"b', "4"], ["é", "ß,"]]
    rows = spark.createDataFrame(list(enumerate(lines)), "id INT, line STRING").select("id", H.cells_of(F.col("line")).alias("c"))
    assert [r.c for r in rows.orderBy("id").collect()] == expected


def test_headers_in_any_order_and_one_scan_of_the_files(spark, tmp_path):
    wide = ",".join(f"x{k}" for k in range(40))
    (tmp_path / "a.csv").write_text(f"{wide},quantity,price,unix timestamp,name\n" + f"{wide},3,10.5,1700000000,n\n\n" * 2)
    (tmp_path / "b.csv").write_text('price,"name", quantity,unix timestamp\n1,"x, y",2,1700000060\n')
    # a later line that holds the four names in another order does not move the columns
    (tmp_path / "c.csv").write_text(HEADER + "c,1700000000,4,1\nprice,name,quantity,unix timestamp\n")
    raw = H.read_history_csv(spark, str(tmp_path))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" not in plan  # both passes of load_history read the table of cells
    assert raw.filter("is_header").groupBy("file_name").count().count() == 3
    load = H.load_history(raw)
    rows = load.accepted.select("file_name", "median_price_cents", "volume_sold").collect()
    assert sorted(map(tuple, rows)) == [("a.csv", 1050, 3), ("a.csv", 1050, 3), ("b.csv", 100, 2)]
    assert [r.file_name for r in load.rejected_files.collect()] == ["c.csv"]


def test_many_unusual_headers_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"f{k}.csv").write_text(f"price,name,quantity,unix timestamp\n{k + 1},n,2,1700000000\n")
    monkeypatch.setattr(H, "lookup", lambda *a, **b: lookup(*a, **b, rows=2, hot_keys=1))
    rows = H.clean_history(H.read_history_csv(spark, str(tmp_path))).collect()
    assert sorted(r.median_price_cents for r in rows) == [100 * (k + 1) for k in range(6)]


def many_files(folder):
    for k in range(40):
        (folder / f"{k % 4}").mkdir(exist_ok=True)
        (folder / f"{k % 4}" / f"item%20{k}.csv").write_text(HEADER + f"n,1700000000,{k + 1},2\n" if k else "")
    (folder / "_hidden.csv").write_text(HEADER)


def driver_lists(df, folder):
    """Whether the plan holds names of files: in a file index or as a local table."""
    return any(str(folder) in path for path in df.inputFiles()) or "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_tasks_list_the_files(spark, tmp_path):
    many_files(tmp_path)
    listed = H.list_history_files(spark, str(tmp_path))
    assert not driver_lists(listed, tmp_path)
    assert {(r.market_hash_name, r.length > 0) for r in listed.collect()} == {(f"item {k}", k > 0) for k in range(40)}


def test_tasks_open_the_files(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Spark's file source lists all files in the driver")

    many_files(tmp_path)
    monkeypatch.setattr(type(spark.read), "text", refuse)
    raw = H.read_history_csv(spark, f"file://{tmp_path}")
    assert sorted(r.median_price_cents for r in H.clean_history(raw).collect()) == [100 * (k + 1) for k in range(1, 40)]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_lines_of_cut_files(spark, tmp_path, block):
    texts = {
        "a": b"\xef\xbb\xbfone\ntwo\r\nthree\rfour\n\nsix", "b": b"x" * 30 + b"\r\n" + b"y" * 5 + b"\r\n", "c": b"", "d": b"\n",
        "e": b"no newline", "f": b"cr\ronly\r", "g": "ß\u2028é\x0bz\n\x1cq".encode(),
    }
    for name, data in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    rows = files.read_lines(spark, str(tmp_path), ".csv", block).orderBy("file_name", "place").collect()
    assert len({(r.file_name, r.place) for r in rows}) == len(rows)
    got = {}
    for r in rows:
        got.setdefault(r.file_name[0], []).append(r.value)
    spark_lines = {}
    for r in spark.read.text(str(tmp_path)).selectExpr("_metadata.file_name AS n", "value AS v").collect():
        spark_lines.setdefault(r.n[0], []).append(r.v)
    assert got == spark_lines


def test_a_header_far_down_its_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "read_lines", lambda *a: files.read_lines(*a, 16))
    (tmp_path / "late.csv").write_text("# a note that fills some blocks of the file\n" * 3 + "price,name,quantity,unix timestamp\n4,n,2,1700000000\n")
    raw = H.read_history_csv(spark, str(tmp_path))
    assert [r.median_price_cents for r in H.clean_history(raw).collect()] == [400]
