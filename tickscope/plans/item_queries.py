"""Queries over items and price history."""

from __future__ import annotations

import csv
import io
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.functions import names, pricing
from tickscope.operators import baselines as B
from tickscope.operators import context as C
from tickscope.operators import quality as Q
from tickscope.operators import search as S
from tickscope.operators.ingest import upsert_items as register_names
from tickscope.plans.registry import Views, query
from tickscope.session import ensure_checkpoint_dir, stored
from tickscope.sources import history as H
from tickscope.sources.files import store_of
from tickscope.sources.tables import append_table, read_table

# (order, line) repeats in the larger tables; rows equal in all of these are interchangeable
TIES = ["l_orderkey", "l_linenumber", "median_price_cents", "volume_sold"]
LINE = TIES[:2]
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def macro_sql(history: str, ties: str) -> str:
    """WITH members ``ranked`` and ``macro`` for a history view."""
    order = ", ".join(f"{c} DESC" for c in ["sale_date", *ties.split(",")])
    return f"""
      ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS rn FROM {history}),
      moments AS (
        SELECT item_id, max(CASE WHEN rn = 1 THEN median_price_cents END) AS latest,
               avg(CASE WHEN rn <= 30 THEN median_price_cents END) AS r30,
               avg(CASE WHEN rn <= 90 THEN median_price_cents END) AS r90,
               count(CASE WHEN rn <= 30 THEN 1 END) AS n,
               sum(CASE WHEN rn <= 30 THEN median_price_cents END) AS s,
               sum(CASE WHEN rn <= 30 THEN median_price_cents * median_price_cents END) AS ss,
               avg(CASE WHEN rn <= 30 THEN volume_sold END) AS volume,
               list_sort(list(median_price_cents)) AS prices, count(*) AS points,
               (count(*) - 1) * CAST(0.1 AS DOUBLE) AS pos
        FROM ranked GROUP BY item_id),
      ends AS (
        SELECT *, prices[CAST(floor(pos) AS BIGINT) + 1] AS low, prices[CAST(ceil(pos) AS BIGINT) + 1] AS high,
               pos - floor(pos) AS part FROM moments),
      macro AS (
        SELECT item_id, latest AS latest_price_cents, CAST(round_even(r30, 0) AS BIGINT) AS rolling_30d_avg_cents,
               CAST(round_even(r90, 0) AS BIGINT) AS rolling_90d_avg_cents,
               CASE WHEN r90 <> 0 THEN (r30 - r90) / r90 * 100 ELSE 0.0 END AS drift_percent,
               CAST(round_even(coalesce(CASE WHEN n > 1 THEN
                 sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END, 0.0), 0) AS BIGINT)
                 AS volatility_cents,
               volume AS avg_volume_30d, CAST(round_even(CASE WHEN part >= 0.5
                 THEN high - (high - low) * (1 - part) ELSE low + (high - low) * part END, 0) AS BIGINT)
                 AS support_floor_cents, points
        FROM ends)"""


MACRO = macro_sql("fx_history", ",".join(TIES))
PART_MACRO = macro_sql("fx_part_history", ",".join(TIES))
PERSISTED = ", ".join(B.BASELINE_FIELDS)


@query("macro_baselines", f"""
    WITH {MACRO}
    SELECT {PERSISTED}, CASE WHEN latest_price_cents > 0 AND volatility_cents > 0
             THEN CAST(volatility_cents AS DOUBLE) / CAST(latest_price_cents AS DOUBLE) ELSE 0.0 END AS cv_latest,
           points AS total_points_analyzed
    FROM macro""")
def macro_baselines(v: Views) -> DataFrame:
    return B.macro_baselines(v.history, TIES)


@query("folded_baselines", f"""
    WITH {MACRO}
    SELECT {PERSISTED}, points AS total_points_analyzed FROM macro""")
def folded_baselines(v: Views) -> DataFrame:
    """The history comes in four refreshes that are not in time order; the baselines equal those of the whole."""
    ensure_checkpoint_dir(v.spark)
    root = f"{v.spark.sparkContext.getCheckpointDir()}/summaries/{uuid.uuid4().hex}"
    for epoch in range(4):
        found = B.fold_history(v.spark, root, epoch, v.history.filter(F.col("l_orderkey") % 4 == epoch), TIES)
    return found.select(*B.BASELINE_FIELDS, "total_points_analyzed")


@query("rolling_averages", """
    SELECT item_id, l_orderkey, l_linenumber,
           avg(median_price_cents) OVER (o ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_30d,
           avg(median_price_cents) OVER (o ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS rolling_90d
    FROM fx_history
    WINDOW o AS (PARTITION BY item_id ORDER BY sale_date, l_orderkey, l_linenumber, median_price_cents, volume_sold)""")
def rolling_averages(v: Views) -> DataFrame:
    rolled = B.rolling_averages(v.history, TIES)
    return rolled.select("item_id", *LINE, "rolling_30d", "rolling_90d")


@query("monthly_seasonality", """
    SELECT item_id, CAST(month(sale_date) AS BIGINT) AS month, avg(median_price_cents) AS mean_price_cents
    FROM fx_history GROUP BY ALL""")
def monthly_seasonality(v: Views) -> DataFrame:
    return B.monthly_seasonality(v.history)


@query("seasonality_maps", """
    SELECT item_id, month, mean_price_cents, count(*) OVER (PARTITION BY item_id) AS months FROM (
      SELECT item_id, CAST(month(sale_date) AS BIGINT) AS month, avg(median_price_cents) AS mean_price_cents
      FROM fx_history GROUP BY ALL)""")
def seasonality_maps(v: Views) -> DataFrame:
    """The seasonality as one map per item, taken apart again for the comparison."""
    months = F.col("monthly_seasonality")
    return B.seasonality_maps(v.history).select(
        "item_id", F.size(months).cast("bigint").alias("months"), F.explode(months).alias("month", "mean_price_cents")
    ).withColumn("month", F.col("month").cast("bigint"))


@query("top_drift", f"""
    WITH {MACRO} SELECT item_id, drift_percent FROM macro ORDER BY drift_percent DESC, item_id LIMIT 1""")
def top_drift(v: Views) -> DataFrame:
    return B.top_drift(B.macro_baselines(v.history, TIES))


@query("limit_items", "SELECT * FROM fx_items ORDER BY id LIMIT 100")
def limit_items(v: Views) -> DataFrame:
    return B.limit_items(v.items, 100)


OLD_BASELINES = """
    SELECT part_id AS item_id, CAST(1000 AS BIGINT) AS latest_price_cents, CAST(1100 AS BIGINT) AS rolling_30d_avg_cents,
           CAST(1200 AS BIGINT) AS rolling_90d_avg_cents, p_retailprice AS drift_percent,
           CAST(p_size AS BIGINT) AS volatility_cents, p_retailprice AS avg_volume_30d,
           CAST(900 AS BIGINT) AS support_floor_cents, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
    FROM fx_parts"""


@query("upsert_baselines", f"""
    WITH {MACRO}, old AS ({OLD_BASELINES})
    SELECT {PERSISTED}, {NOW} AS updated_at FROM macro
    UNION ALL SELECT {PERSISTED}, updated_at FROM old WHERE item_id NOT IN (SELECT item_id FROM macro)""")
def upsert_baselines(v: Views) -> DataFrame:
    old = v.parts.select(
        F.col("part_id").alias("item_id"), F.lit(1000).cast("bigint").alias("latest_price_cents"),
        F.lit(1100).cast("bigint").alias("rolling_30d_avg_cents"),
        F.lit(1200).cast("bigint").alias("rolling_90d_avg_cents"), F.col("p_retailprice").alias("drift_percent"),
        F.col("p_size").cast("bigint").alias("volatility_cents"), F.col("p_retailprice").alias("avg_volume_30d"),
        F.lit(900).cast("bigint").alias("support_floor_cents"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("updated_at"),
    )
    return ntz(B.macro_refresh(v.items, v.history, old, F.expr(NOW), None, TIES), "updated_at")


PUBLISHED = """
    SELECT market_hash_name, support_floor_cents, latest_price_cents, rolling_30d_avg_cents, volatility_cents,
           drift_percent, CASE WHEN rolling_30d_avg_cents <> 0 AND volatility_cents <> 0
             THEN CAST(volatility_cents AS DOUBLE) / CAST(rolling_30d_avg_cents AS DOUBLE) ELSE 0.0 END AS cv_published
    FROM macro JOIN fx_items AS i ON i.id = item_id"""


@query("publish_baselines", f"WITH {PART_MACRO} {PUBLISHED}")
def publish_baselines(v: Views) -> DataFrame:
    return B.publish_baselines(v.items, B.macro_baselines(v.part_history, TIES)).drop("payload_json")


@query("publish_sticker_prices", f"""
    WITH {PART_MACRO}
    SELECT market_hash_name AS name, CAST(latest_price_cents AS VARCHAR) AS price
    FROM macro JOIN fx_items AS i ON i.id = item_id WHERE item_type = 'Sticker'""")
def publish_sticker_prices(v: Views) -> DataFrame:
    return B.publish_sticker_prices(v.items, B.macro_baselines(v.part_history, TIES))


@query("integrity_scan", """
    SELECT count(*) AS total_rows, min(sale_date) AS min_date, max(sale_date) AS max_date,
           count(*) FILTER (WHERE item_id IS NULL OR sale_date IS NULL OR median_price_cents IS NULL
                            OR volume_sold IS NULL) AS null_rows,
           count(*) FILTER (WHERE median_price_cents <= 0 OR volume_sold < 0) AS invalid_rows
    FROM fx_part_history""")
def integrity_scan(v: Views) -> DataFrame:
    return ntz(Q.integrity_scan(v.part_history), "min_date", "max_date")


@query("duplicate_keys", """
    SELECT count(*) AS duplicate_keys FROM (
      SELECT item_id, sale_date FROM fx_part_history GROUP BY ALL HAVING count(*) > 1)""")
def duplicate_keys(v: Views) -> DataFrame:
    return Q.duplicate_keys(v.part_history)


@query("mapping_coverage", """
    SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fx_history AS h WHERE h.item_id = i.id)) AS items_with_history,
           count(*) AS items_total
    FROM fx_items AS i""")
def mapping_coverage(v: Views) -> DataFrame:
    return Q.mapping_coverage(v.items, v.history)


@query("top_items_by_points", """
    SELECT item_id, market_hash_name, points FROM (
      SELECT item_id, count(*) AS points FROM fx_part_history GROUP BY item_id ORDER BY points DESC, item_id LIMIT 5)
    JOIN fx_items AS i ON i.id = item_id""")
def top_items_by_points(v: Views) -> DataFrame:
    return Q.top_items_by_points(v.part_history, v.items).select("item_id", "market_hash_name", "points")


RAW_FILE = "replace(replace(replace(market_hash_name, ' ', '%20'), '|', '%7C'), '(', '%28') || '.csv'"


@query("item_names", f"""
    WITH decoded AS (SELECT id, url_decode(replace({RAW_FILE}, '.csv', '')) AS name FROM fx_items)
    SELECT id, name, CASE
      WHEN contains(name, '★') AND (contains(name, 'Gloves') OR contains(name, 'Wraps')) THEN 'Glove'
      WHEN contains(name, '★') THEN 'Knife'
      WHEN contains(name, 'Sticker |') OR starts_with(name, 'Sticker') THEN 'Sticker'
      WHEN contains(name, 'Music Kit |') THEN 'Music Kit'
      WHEN contains(name, 'Patch |') THEN 'Patch'
      WHEN regexp_matches(name, 'NSWC SEAL|Guerrilla Warfare|Sabre|TACP|Professionals|FBI|SWAT|Gendarmerie|KSK|Agent')
        THEN 'Agent'
      WHEN regexp_matches(name, '[(](Factory New|Minimal Wear|Field-Tested|Well-Worn|Battle-Scarred)[)]')
        THEN 'Weapon Skin'
      WHEN regexp_matches(name, 'Case|Capsule|Package|Pin') THEN 'Container/Collectible' ELSE 'Agent' END AS item_type
    FROM decoded""")
def item_names(v: Views) -> DataFrame:
    decoded = v.items.select("id", names.item_name(F.expr(RAW_FILE)).alias("name"))
    return decoded.withColumn("item_type", names.item_type(F.col("name")))


WEAR = r"([(](?:Factory New|Minimal Wear|Field-Tested|Well-Worn|Battle-Scarred)[)])$"


@query("name_versions", f"""
    WITH parsed AS (SELECT id, market_hash_name,
             regexp_extract(market_hash_name, '^(.*) [(]([^()]+)[)] {WEAR}', 1) AS stem,
             regexp_extract(market_hash_name, '^(.*) [(]([^()]+)[)] {WEAR}', 2) AS version,
             regexp_extract(market_hash_name, '^(.*) [(]([^()]+)[)] {WEAR}', 3) AS wear FROM fx_items)
    SELECT id, CASE WHEN version <> '' THEN stem || ' ' || wear ELSE market_hash_name END AS base_name,
           nullif(version, '') AS version, market_hash_name AS rebuilt,
           CASE WHEN regexp_matches(market_hash_name, '{WEAR}')
             THEN regexp_replace(market_hash_name, '{WEAR}', '(Ruby) \\1') ELSE market_hash_name || ' (Ruby)' END AS ruby
    FROM parsed""")
def name_versions(v: Views) -> DataFrame:
    name = F.col("market_hash_name")
    parsed = v.items.select("id", name, names.base_name(name).alias("base_name"), names.version(name).alias("version"))
    return parsed.select(
        "id", "base_name", "version",
        names.versioned_name(F.col("base_name"), F.col("version")).alias("rebuilt"),
        names.versioned_name(name, F.lit("Ruby")).alias("ruby"),
    )


@query("cents_and_dates", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(l_extendedprice / l_quantity * 100, 0) AS BIGINT) AS cents,
           make_timestamp(epoch_us(l_shipdate)) AS sale_date
    FROM lineitem""")
def cents_and_dates(v: Views) -> DataFrame:
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    rows = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        pricing.to_cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("cents"),
        pricing.epoch_to_ts(seconds).alias("sale_date"),
    )
    return ntz(rows, "sale_date")


def raw_history(v: Views) -> DataFrame:
    """File rows as the CSV reader gives them, a header per file included."""
    raw = v.raw_history
    rows = raw.select(
        "name", F.col("stamp").alias("unix timestamp"), "price", "quantity", "file_name", *LINE,
    )
    headers = v.parts.join(raw.select("file_name").distinct(), "file_name", "left_semi").select(
        *[F.lit(c).alias(c) for c in ("name", "unix timestamp", "price", "quantity")], "file_name",
        F.lit(None).cast("bigint").alias(LINE[0]), F.lit(None).cast("int").alias(LINE[1]),
    )
    return H.with_identity(H.mark_headers(rows.unionByName(headers)))


def raw_files(v: Views) -> DataFrame:
    """All item files, also of items without any row."""
    return H.with_identity(v.parts.select("file_name", F.lit(100).cast("bigint").alias("length")))


CLEANED = """
    cleaned AS (
      SELECT *, TRY_CAST(stamp AS BIGINT) AS seconds FROM fx_raw_history WHERE stamp NOT IN ('garbage', '1700000000000')),
    rejected AS (
      SELECT DISTINCT file_name FROM fx_raw_history WHERE price = 'broken'
        OR (stamp <> 'garbage' AND (quantity IN ('', '1e30') OR price = '1e30' OR stamp = '1700000000000')))"""


@query("clean_history", f"""
    WITH {CLEANED}
    SELECT file_name, l_orderkey, l_linenumber, make_timestamp(seconds * 1000000) AS sale_date,
           TRY_CAST(round_even(TRY_CAST(price AS DOUBLE) * 100, 0) AS BIGINT) AS median_price_cents,
           TRY_CAST(trunc(TRY_CAST(nullif(quantity, '') AS DOUBLE)) AS BIGINT) AS volume_sold
    FROM cleaned""")
def clean_history(v: Views) -> DataFrame:
    return ntz(H.clean_history(raw_history(v)).drop("market_hash_name", "item_type"), "sale_date")


@query("load_history", f"""
    WITH {CLEANED}
    SELECT file_name, l_orderkey, l_linenumber, make_timestamp(seconds * 1000000) AS sale_date,
           CAST(round_even(CAST(price AS DOUBLE) * 100, 0) AS BIGINT) AS median_price_cents,
           CAST(trunc(CAST(quantity AS DOUBLE)) AS BIGINT) AS volume_sold
    FROM cleaned WHERE file_name NOT IN (SELECT file_name FROM rejected)""")
def load_history(v: Views) -> DataFrame:
    accepted = H.load_history(raw_history(v)).accepted
    return ntz(accepted.drop("market_hash_name", "item_type"), "sale_date")


def written_history(v: Views) -> str:
    """The history rows as CSV files, one per item, in a new folder: columns in three orders, a third of the files with one more.

    The files are dealt over sub-folders by their names, so that tasks share the listing.
    """
    ensure_checkpoint_dir(v.spark)
    folder = f"{v.spark.sparkContext.getCheckpointDir()}/history/{uuid.uuid4().hex}"
    orders = [["name", "unix timestamp", "price", "quantity"], ["quantity", "price", "unix timestamp", "name"],
              ["source", "price", "name", "quantity", "unix timestamp"]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, out, titles, n, made = None, None, [], 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["file_name"] != name:
                    if out is not None:
                        out.close()
                        n += 1
                    name, digest = row["file_name"], zlib.crc32(row["file_name"].encode())
                    titles, below = orders[digest % 3], f"{path}/{digest >> 24:02x}"
                    if below not in made:
                        store.create_dir(below, recursive=True)
                        made.add(below)
                    out = io.TextIOWrapper(store.open_output_stream(f"{below}/{name}"), encoding="utf-8", newline="")
                    writer = csv.writer(out)
                    writer.writerow(titles)
                writer.writerow([row.get(t, "csv") for t in titles])
        if out is not None:
            out.close()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    rows = v.raw_history.select("name", F.col("stamp").alias("unix timestamp"), "price", "quantity", "file_name")
    rows.repartition("file_name").sortWithinPartitions("file_name").mapInArrow(write, "files bigint").agg(F.sum("files")).first()
    return folder


@query("read_history", f"""
    WITH {CLEANED}
    SELECT file_name, make_timestamp(seconds * 1000000) AS sale_date,
           CAST(round_even(CAST(price AS DOUBLE) * 100, 0) AS BIGINT) AS median_price_cents,
           CAST(trunc(CAST(quantity AS DOUBLE)) AS BIGINT) AS volume_sold
    FROM cleaned WHERE file_name NOT IN (SELECT file_name FROM rejected)""")
def read_history(v: Views) -> DataFrame:
    """Real files through the reader: headers in any order, whole files accepted or rejected."""
    accepted = H.load_history(H.read_history_csv(v.spark, written_history(v))).accepted
    return ntz(accepted.select("file_name", "sale_date", "median_price_cents", "volume_sold"), "sale_date")


@query("history_files", "SELECT DISTINCT file_name, true AS has_bytes FROM fx_raw_history")
def history_files(v: Views) -> DataFrame:
    """The listing of a folder of real files."""
    files = H.list_history_files(v.spark, written_history(v))
    return files.select("file_name", (F.col("length") > 0).alias("has_bytes"))


@query("rejected_files", f"WITH {CLEANED} SELECT file_name FROM rejected")
def rejected_files(v: Views) -> DataFrame:
    return H.load_history(raw_history(v)).rejected_files


@query("registered_items", f"""
    WITH {CLEANED}, wanted AS (
      SELECT base_name FROM fx_parts WHERE file_name NOT IN (SELECT file_name FROM rejected)),
    known AS (SELECT * FROM fx_items WHERE item_type = 'Knife')
    SELECT id, market_hash_name, item_type FROM known
    UNION ALL
    SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY base_name), base_name, item_type
    FROM wanted JOIN fx_parts USING (base_name) WHERE base_name NOT IN (SELECT market_hash_name FROM known)""")
def registered_items(v: Views) -> DataFrame:
    rejected = H.load_history(raw_history(v)).rejected_files
    fresh = H.files_to_register(raw_files(v), rejected)
    known = v.items.filter("item_type = 'Knife'")
    return register_names(fresh, known).drop("rarity")


@query("validation_report", """
    WITH files AS (SELECT file_name, count(*) FILTER (WHERE stamp = 'garbage') AS dropped,
                          count(*) FILTER (WHERE stamp <> 'garbage') AS clean FROM fx_raw_history GROUP BY file_name)
    SELECT (SELECT count(*) FROM fx_parts) AS files_total, count(*) FILTER (WHERE dropped > 0) AS files_with_drops,
           CAST(sum(dropped) AS BIGINT) AS rows_dropped, CAST(sum(clean) AS BIGINT) AS clean_rows
    FROM files""")
def validation_report(v: Views) -> DataFrame:
    return Q.validation_report(raw_history(v), raw_files(v))


@query("type_distribution", "SELECT item_type, count(*) AS files FROM fx_parts GROUP BY item_type")
def type_distribution(v: Views) -> DataFrame:
    return Q.type_distribution(raw_files(v))


@query("sample_decodes", """
    WITH numbered AS (
      SELECT file_name, base_name, item_type, row_number() OVER (ORDER BY file_name) AS idx FROM fx_parts)
    SELECT file_name, base_name AS market_hash_name, item_type, idx FROM numbered
    WHERE idx <= 4 OR idx % 3000 = 0 ORDER BY idx LIMIT 6""")
def sample_decodes(v: Views) -> DataFrame:
    return Q.sample_decodes(raw_files(v))


@query("upsert_items", """
    WITH known AS (SELECT * FROM fx_items WHERE id < 1000000000),
    top AS (SELECT max(id) AS id FROM known)
    SELECT id, market_hash_name, item_type, rarity FROM known
    UNION ALL
    SELECT (SELECT id FROM top) + row_number() OVER (ORDER BY market_hash_name), market_hash_name, item_type, NULL
    FROM (SELECT DISTINCT market_hash_name, item_type FROM fx_parts WHERE phase IS NOT NULL)""")
def upsert_items(v: Views) -> DataFrame:
    # base items are known; ticks bring the names of the versioned ones
    known = v.items.filter(F.col("id") < 1_000_000_000)
    return register_names(v.parts.select("market_hash_name"), known)


@query("table_snapshots", """
    SELECT item_id, sale_date, median_price_cents, volume_sold FROM fx_part_history""")
def table_snapshots(v: Views) -> DataFrame:
    """The price table written, appended to and read back."""
    ensure_checkpoint_dir(v.spark)
    root = f"{v.spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    early = F.col("sale_date") < F.expr("TIMESTAMP '1997-01-01 00:00:00'")
    for part in (v.part_history.filter(early), v.part_history.filter(~early)):
        append_table(part, root, "historical_prices")
    return ntz(read_table(v.spark, root, "historical_prices"), "sale_date")


@query("steam_baseline", "SELECT item_id, avg(median_price_cents) AS avg_steam FROM fx_part_history GROUP BY item_id")
def steam_baseline(v: Views) -> DataFrame:
    return C.steam_baseline(v.part_history)


@query("resolve_items", """
    SELECT market_hash_name, base_name, phase AS version, part_id AS base_id, item_type, live_id AS versioned_id
    FROM fx_parts""")
def resolve_items(v: Views) -> DataFrame:
    resolved = C.resolve_items(v.parts.select("market_hash_name"), v.items)
    return resolved.select("market_hash_name", "base_name", "version", "base_id", "item_type", "versioned_id")


@query("search_baselines", f"""
    WITH {PART_MACRO}, top AS (
      SELECT id, market_hash_name FROM fx_items WHERE lower(market_hash_name) LIKE '%knife%'
      ORDER BY market_hash_name LIMIT 10)
    SELECT market_hash_name, drift_percent, volatility_cents, avg_volume_30d, support_floor_cents, latest_price_cents
    FROM macro JOIN top ON top.id = item_id""")
def search_baselines(v: Views) -> DataFrame:
    return C.search_baselines(v.items, B.macro_baselines(v.part_history, TIES), "Knife")


SEARCHES = ["Knife", "glo%es | b", "phase _) (f", "e_1", "k", "no such name"]


@query("search_postings", f"""
    WITH {PART_MACRO}, found AS (
      SELECT s.query, i.id, i.market_hash_name,
             row_number() OVER (PARTITION BY s.query ORDER BY i.market_hash_name) AS place
      FROM (SELECT unnest({SEARCHES}) AS query) AS s
      JOIN fx_items AS i ON lower(i.market_hash_name) LIKE '%' || lower(s.query) || '%')
    SELECT query, market_hash_name, drift_percent, volatility_cents, avg_volume_30d, support_floor_cents, latest_price_cents
    FROM macro JOIN found ON found.id = item_id WHERE place <= 10""")
def search_postings(v: Views) -> DataFrame:
    """Searches over stored trigram postings: wildcards inside, and patterns too short for a trigram."""
    postings = stored(S.name_postings(v.items))
    baselines = stored(B.macro_baselines(v.part_history, TIES))
    found = [C.search_baselines(v.items, baselines, q, postings=postings).withColumn("query", F.lit(q)) for q in SEARCHES]
    return reduce(DataFrame.unionByName, found)
