"""Views that present the driver tables as market data.

Each view is one SQL text for both engines. The few functions that differ are written as
``@round(x)``, ``@k(props)``, ``@second(ts)``, ``@micros(ts)`` and ``@ts(x)`` and filled in per
dialect; ``#name`` stands for a driver table.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SPLIT = "TIMESTAMP '2024-01-11 00:00:00'"
# ids of versioned items lie above those of the base items
VERSIONED_ID = 1_000_000_000

_FUNCTIONS = {
    "spark": {
        "round": "CAST(rint({0}) AS BIGINT)",
        "k": "CAST(get_json_object({0}, '$.k') AS BIGINT)",
        "second": "(unix_micros(CAST({0} AS TIMESTAMP)) div 1000000)",
        "ts": "CAST({0} AS TIMESTAMP)",
        "stickers": "CASE WHEN {0} % 10 = 0 THEN "
                    "array(named_struct('name', 'sticker-' || {0}), named_struct('name', 'sticker-' || ({0} div 2))) "
                    "WHEN {0} % 5 = 0 THEN array(named_struct('name', 'sticker-' || {0})) "
                    "ELSE CAST(array() AS ARRAY<STRUCT<name: STRING>>) END",
        "days": "(unix_micros(CAST({0} AS TIMESTAMP)) / 86400000000.0D)",
    },
    "duckdb": {
        "round": "CAST(round_even({0}, 0) AS BIGINT)",
        "k": "CAST(json_extract({0}, '$.k') AS BIGINT)",
        "second": "(epoch_us({0}) // 1000000)",
        "ts": "{0}",
        "stickers": "CASE WHEN {0} % 10 = 0 THEN "
                    "[{{'name': 'sticker-' || {0}}}, {{'name': 'sticker-' || ({0} // 2)}}] "
                    "WHEN {0} % 5 = 0 THEN [{{'name': 'sticker-' || {0}}}] ELSE [] END",
        "days": "(CAST(epoch_us({0}) AS DOUBLE) / 86400000000.0)",
    },
}

VIEWS = {
    # p_size picks wear and phase; promoted parts are versioned items with a base item
    "fx_parts": """
        SELECT p_partkey AS part_id, p_type,
               CASE WHEN p_type = 'PROMO' THEN stem || ' (' || phase || ') (' || wear || ')'
                    WHEN p_type IN ('SMALL', 'ECONOMY') THEN stem
                    ELSE stem || ' (' || wear || ')' END AS market_hash_name,
               CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN stem
                    ELSE stem || ' (' || wear || ')' END AS base_name,
               CASE WHEN p_type = 'PROMO' THEN phase END AS phase,
               CASE p_type WHEN 'PROMO' THEN 'Knife' WHEN 'LARGE' THEN 'Glove' WHEN 'SMALL' THEN 'Sticker'
                    WHEN 'ECONOMY' THEN 'Container/Collectible' ELSE 'Weapon Skin' END AS item_type,
               CASE WHEN p_type = 'PROMO' THEN p_partkey + 1000000000 ELSE p_partkey END AS live_id,
               CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN replace(replace(stem, ' ', '%20'), '|', '%7C') || '.csv'
                    ELSE replace(replace(stem || ' (' || wear || ')', ' ', '%20'), '|', '%7C') || '.csv' END AS file_name,
               p_size, p_retailprice
        FROM (SELECT *,
                     CASE p_type
                       WHEN 'PROMO' THEN '★ ' || p_name || ' Knife | ' || p_brand || '-' || p_partkey
                       WHEN 'LARGE' THEN '★ ' || p_name || ' Gloves | ' || p_brand || '-' || p_partkey
                       WHEN 'SMALL' THEN 'Sticker | ' || p_name || ' ' || p_brand || '-' || p_partkey
                       WHEN 'ECONOMY' THEN p_name || ' Case ' || p_brand || '-' || p_partkey
                       ELSE p_name || ' | ' || p_brand || '-' || p_partkey END AS stem,
                     'Phase ' || (p_size % 4 + 1) AS phase,
                     CASE p_size % 5 WHEN 0 THEN 'Factory New' WHEN 1 THEN 'Minimal Wear'
                       WHEN 2 THEN 'Field-Tested' WHEN 3 THEN 'Well-Worn' ELSE 'Battle-Scarred' END AS wear
              FROM #part) AS p""",
    "fx_items": """
        SELECT part_id AS id, base_name AS market_hash_name, item_type, CAST(NULL AS STRING) AS rarity FROM fx_parts
        UNION ALL
        SELECT live_id, market_hash_name, item_type, CAST(NULL AS STRING) FROM fx_parts WHERE phase IS NOT NULL""",
    # about 600 rows per item, so that the 90-row window is full
    "fx_history": """
        SELECT l_suppkey AS item_id, @ts(l_shipdate) AS sale_date,
               @round(l_extendedprice / l_quantity * 100) AS median_price_cents,
               CAST(l_quantity AS BIGINT) AS volume_sold, l_orderkey, l_linenumber
        FROM #lineitem""",
    # about 30 rows per item, all items
    "fx_part_history": """
        SELECT l_partkey AS item_id, @ts(l_shipdate) AS sale_date,
               @round(l_extendedprice / l_quantity * 100) AS median_price_cents,
               CAST(l_quantity AS BIGINT) AS volume_sold, l_orderkey, l_linenumber
        FROM #lineitem""",
    "fx_ticks": """
        SELECT event_id AS id, user_id AS item_id, @round(value * 100) AS price_cents, value AS price_usd,
               event_type AS marketplace_source, @ts(ts) AS inserted_at, @second(ts) AS timestamp,
               CAST(k AS DOUBLE) / 100 AS float_value, k, @stickers(k) AS stickers
        FROM (SELECT *, @k(props) AS k FROM #events) AS e""",
    # ticks of the live item, by name
    "fx_named_ticks": """
        SELECT t.id, p.live_id AS item_id, p.market_hash_name, t.price_cents, t.marketplace_source, t.inserted_at,
               t.timestamp, t.float_value, t.k, t.stickers
        FROM fx_ticks AS t JOIN fx_parts AS p ON p.part_id = t.item_id""",
    "fx_live_ticks": f"""
        SELECT * FROM fx_named_ticks WHERE inserted_at >= {SPLIT} AND price_cents > 0""",
    # sales before the live period: ticks of every event type
    "fx_sales": f"""
        SELECT item_id, inserted_at AS sale_date, price_cents AS median_price_cents, CAST(1 AS BIGINT) AS volume_sold, id
        FROM fx_named_ticks WHERE inserted_at < {SPLIT} AND price_cents > 0""",
    "fx_sticker_prices": """
        SELECT 'sticker-' || p_size AS name, CAST(@round(min(p_retailprice) * 100) AS STRING) AS price
        FROM #part GROUP BY p_size""",
    # few distinct prices and long repeats, so that suppression has work to do
    "fx_dedup": """
        SELECT event_id AS id, event_type AS market_hash_name, CAST(floor(value / 10) AS BIGINT) AS price_cents,
               @second(ts) AS timestamp
        FROM #events""",
    "fx_trades": """
        SELECT CAST(id AS STRING) AS id, item_id, price_cents AS purchase_price_cents,
               k * 10 - 300 AS estimated_profit_cents, -CAST(k AS DOUBLE) / 20 AS trigger_z_score,
               inserted_at AS simulated_buy_timestamp
        FROM fx_named_ticks WHERE marketplace_source = 'purchase'""",
    # prices and sales of the last 1, 7, 30 and 90 days per item
    "fx_sales_windows": """
        SELECT p.base_name, p.phase,
               avg(CASE WHEN t.age < 1 THEN t.price_cents END) / 100.0 AS m1,
               count(CASE WHEN t.age < 1 THEN 1 END) AS v1,
               avg(CASE WHEN t.age < 7 THEN t.price_cents END) / 100.0 AS m7,
               count(CASE WHEN t.age < 7 THEN 1 END) AS v7,
               avg(CASE WHEN t.age < 30 THEN t.price_cents END) / 100.0 AS m30,
               count(CASE WHEN t.age < 30 THEN 1 END) AS v30,
               avg(t.price_cents) / 100.0 AS m90, count(*) AS v90
        FROM (SELECT *, @days((SELECT max(inserted_at) FROM fx_ticks)) - @days(inserted_at) AS age FROM fx_ticks) AS t
        JOIN fx_parts AS p ON p.part_id = t.item_id
        GROUP BY p.base_name, p.phase""",
    # raw file rows as text, with spoilt timestamps, prices and quantities that occur in the data
    "fx_raw_history": """
        SELECT p.file_name, p.base_name AS name,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'garbage'
                    WHEN l_quantity = 33 AND l_tax = 0.07 AND l_discount = 0.03 THEN '1700000000000'
                    ELSE CAST(@second(l_shipdate) AS STRING) END AS stamp,
               CASE WHEN l_quantity = 50 AND l_tax = 0.08 AND l_discount = 0.1 THEN 'broken'
                    WHEN l_quantity = 41 AND l_tax = 0.02 AND l_discount = 0.05 THEN '1e30'
                    ELSE CAST(l_extendedprice / l_quantity AS STRING) END AS price,
               CASE WHEN l_quantity = 1 AND l_tax = 0.0 AND l_linenumber = 1 THEN ''
                    WHEN l_quantity = 37 AND l_tax = 0.04 AND l_discount = 0.06 THEN '1e30'
                    ELSE CAST(l_quantity AS STRING) END AS quantity,
               l_orderkey, l_linenumber
        FROM #lineitem JOIN fx_parts AS p ON p.part_id = l_partkey""",
}


def _apply(text: str, dialect: str) -> str:
    """Fill in the ``@function(...)`` marks; arguments may nest."""
    while (mark := re.search(r"@(\w+)\(", text)) is not None:
        depth, end = 1, mark.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        body = _FUNCTIONS[dialect][mark.group(1)].format(text[mark.end(): end - 1])
        text = text[: mark.start()] + body + text[end:]
    return text


def _needed(text: str) -> list[str]:
    """Views a text refers to, directly or through other views, in definition order."""
    found, queue = set(), [text]
    while queue:
        for name in re.findall(r"\bfx_\w+", queue.pop()):
            if name not in found:
                found.add(name)
                queue.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def render(sql: str, dialect: str, prefix: str = "") -> str:
    """``sql`` (a SELECT, or further WITH members before one) preceded by the views it uses."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _needed(sql))
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        head, rest = "WITH RECURSIVE ", sql.lstrip()[len("WITH RECURSIVE "):]
        text = head + (views + ", " if views else "") + rest
    elif sql.lstrip().upper().startswith("WITH "):
        text = "WITH " + (views + ", " if views else "") + sql.lstrip()[len("WITH "):]
    else:
        text = (f"WITH {views} " if views else "") + sql
    tables = r"\1" if dialect == "duckdb" else rf"{prefix}\1"
    return re.sub(r"#(\w+)", tables, _apply(text, dialect))


def _register_tables(spark: SparkSession, sf_dir: str) -> str:
    """Temporary views of the driver tables; their files are listed once per session."""
    prefix = f"t{zlib.crc32(sf_dir.encode()):08x}_"
    known = {t.name for t in spark.catalog.listTables(pattern=f"{prefix}*")}
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir, "*.parquet")
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in (status.getPath() for status in store.globStatus(pattern)):
        table = path.getName().removesuffix(".parquet")
        if prefix + table not in known:
            spark.read.parquet(path.toString()).createOrReplaceTempView(prefix + table)
    return prefix


@lru_cache(maxsize=None)
def _view(spark: SparkSession, application: str, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(render(f"SELECT * FROM {name}", "spark", _register_tables(spark, sf_dir)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a driver table given as ``#name``) as a DataFrame."""
    return _view(spark, spark.sparkContext.applicationId, str(sf_dir), name)
