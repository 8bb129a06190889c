import json

import pytest
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.sources import runs as R
from tickscope.streaming.ingest_stream import ingest_epoch, known_items

DDL = "n BIGINT, part STRING"


def append(spark, folder, epoch, partition=None):
    rows = spark.createDataFrame([(epoch * 10 + k, f"p{k}") for k in range(2)], DDL)
    R.append_run(rows, folder, epoch, partition)


def values(spark, folder, epoch, partition=None):
    ddl = "n BIGINT" if partition else DDL
    return sorted(r.n for r in R.read_runs(spark, folder, epoch, ddl, partition).collect())


def expected(epoch):
    return sorted(e * 10 + k for e in range(epoch) for k in range(2))


@pytest.mark.parametrize("partition", [None, "part"])
def test_merged_runs_hold_every_row_once(spark, tmp_path, partition):
    folder, ddl = str(tmp_path / "log"), "n BIGINT" if partition else DDL
    for epoch in range(20):
        live = R.compact_runs(spark, folder, epoch, ddl, partition, fan_in=3)
        assert values(spark, folder, epoch, partition) == expected(epoch)
        assert sum(r.last - r.first + 1 for r in live) == epoch
        widths = [r.last - r.first + 1 for r in live]
        assert all(widths.count(w) < 3 for w in widths), widths
        append(spark, folder, epoch, partition)


def test_live_runs_stay_few_over_200_epochs(spark, tmp_path):
    """Runs as the rule leaves them, without their rows."""
    live = []
    for epoch in range(1, 201):
        live.append(R.Run(epoch - 1, epoch - 1, ""))
        width = 8
        while epoch % (width * 8) == 0 and width * 8 <= epoch:
            width *= 8
        if epoch % width == 0:
            live = [r for r in live if r.first < epoch - width] + [R.Run(epoch - width, epoch - 1, "")]
        assert R.live_runs(live) == live and len(live) <= 7 * 3


def test_crash_between_merge_and_removal(spark, tmp_path):
    folder = str(tmp_path / "log")
    for epoch in range(4):
        append(spark, folder, epoch)
    R.compact_runs(spark, folder, 4, DDL, fan_in=4)
    for epoch in (1, 2):  # parts that a crash left behind
        append(spark, folder, epoch)
    assert values(spark, folder, 4) == expected(4)
    live = R.compact_runs(spark, folder, 5, DDL, fan_in=4)
    assert [(r.first, r.last) for r in live] == [(0, 3)]
    assert [(r.first, r.last) for r in R.committed_runs(spark, folder, 9)] == [(0, 3)]


def test_an_uncommitted_merge_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "log")
    for epoch in range(4):
        append(spark, folder, epoch)
    broken = tmp_path / "log.merged" / "run=0-3"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert values(spark, folder, 4) == expected(4)
    R.compact_runs(spark, folder, 4, DDL, fan_in=4)
    assert values(spark, folder, 4) == expected(4) and len(R.committed_runs(spark, folder, 4)) == 1


def test_merge_may_fold_rows(spark, tmp_path):
    folder = str(tmp_path / "log")
    for epoch in range(2):
        R.append_run(spark.createDataFrame([(7, str(epoch))], DDL), folder, epoch)
    R.compact_runs(spark, folder, 2, DDL, merge=lambda rows: rows.groupBy("n").agg(F.max_by("part", "run_last").alias("part")), fan_in=2)
    assert [tuple(r) for r in R.read_runs(spark, folder, 2, DDL).drop("run_last").collect()] == [(7, "1")]
    assert R.read_runs(spark, str(tmp_path / "none"), 5, DDL).count() == 0


def record(number, name):
    batch_id = f"{number % 256:02x}8fad5b-d9cb-469f-a165-7086772895{number:02d}"
    tick = {"market_hash_name": name, "price_cents": 5, "timestamp": 1}
    return ("pending", f"{number}-0", json.dumps({"batch_id": batch_id, "source": "s", "ticks": [tick]}))


def test_ingest_over_merged_ledgers(spark, tmp_path):
    """Batches sent again after their ledger run was merged are duplicates; only changed items are written."""
    root, rows = str(tmp_path), "source_stream STRING, record_id STRING, payload STRING"
    first = spark.createDataFrame([(5, "old", "Wrong", "r"), (6, "other", "Wrong", None)], schemas.MARKET_ITEMS)
    names = ["old", "a", "b", "a", "c", "old", "d", "e", "f"]
    for epoch, name in enumerate(names):
        ingest_epoch(spark.createDataFrame([record(epoch, name)], rows), epoch, root, first)
    again = spark.createDataFrame([record(k, n) for k, n in enumerate(names)], rows)
    ingest_epoch(again, 9, root, first)
    statuses = spark.read.parquet(f"{root}/statuses/epoch=9").groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in statuses] == [("DUPLICATE", 9)]
    assert [(r.first, r.last) for r in R.live_runs(R.committed_runs(spark, f"{root}/ledger", 99))] == [(0, 7), (8, 8), (9, 9)]
    found = {r.market_hash_name: (r.id, r.rarity) for r in known_items(spark, root, 99, first).collect()}
    assert found == {"old": (5, "r"), "other": (6, None), "a": (7, None), "b": (8, None), "c": (9, None), "d": (10, None),
                     "e": (11, None), "f": (12, None)}
    assert {r.market_hash_name: r.item_type for r in known_items(spark, root, 99, first).collect()}["other"] == "Wrong"
    assert spark.read.parquet(f"{root}/items/epoch=9").count() == 0
    assert spark.read.parquet(f"{root}/ticks").count() == 9
