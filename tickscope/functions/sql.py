"""The column functions as temporary SQL functions.

Each body is the SQL text of the column expression, so Catalyst inlines it: calling one from
SQL gives the same plan as the DataFrame function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tickscope import schemas
from tickscope.functions import audit, names, pricing, scoring, wear

_CENTS = "BIGINT"

# name -> (parameters, result type, column function)
FUNCTIONS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "item_name": ("raw STRING", "STRING", names.item_name),
    "item_type": ("name STRING", "STRING", names.item_type),
    "base_name": ("name STRING", "STRING", names.base_name),
    "version": ("name STRING", "STRING", names.version),
    "versioned_name": ("name STRING, wanted STRING", "STRING", names.versioned_name),
    "to_cents": ("usd DOUBLE", _CENTS, pricing.to_cents),
    "epoch_to_ts": ("seconds BIGINT", "TIMESTAMP", pricing.epoch_to_ts),
    "recent_median": (f"history {schemas.SALES_HISTORY}", "DOUBLE", pricing.recent_median),
    "downtrend": (f"history {schemas.SALES_HISTORY}", "STRUCT<detected: BOOLEAN, severity: DOUBLE>", pricing.downtrend),
    "discount_corridor": ("item_type STRING", "DOUBLE", pricing.discount_corridor),
    "is_liquid": ("has_baseline BOOLEAN, latest BIGINT, avg_volume DOUBLE, item_type STRING", "BOOLEAN",
                  pricing.is_liquid),
    "regime_shift": ("steam_avg DOUBLE, reference DOUBLE, discount DOUBLE", "BOOLEAN", pricing.regime_shift),
    "cash_equivalent": ("liquid BOOLEAN, median_cents BIGINT, steam_avg DOUBLE, source_avg DOUBLE, shift BOOLEAN, "
                        "discount DOUBLE", _CENTS, pricing.cash_equivalent),
    "snipe_threshold": ("cash_cents BIGINT, falling BOOLEAN, severity DOUBLE", _CENTS, pricing.snipe_threshold),
    "wear_tier": ("value DOUBLE", "STRING", wear.wear_tier),
    "float_quality": ("value DOUBLE", "STRUCT<quality: STRING, multiplier: DOUBLE, description: STRING>",
                      wear.float_quality),
    "z_score": ("price BIGINT, n BIGINT, total BIGINT, squares BIGINT, macro_avg BIGINT, macro_vol BIGINT, "
                "macro_cv DOUBLE", "STRUCT<z: DOUBLE, mean: DOUBLE, source: STRING>", scoring.z_score),
    "anomaly_trigger": ("z DOUBLE, mean DOUBLE, price BIGINT, sticker_count INT", "BOOLEAN", scoring.anomaly_trigger),
    "opportunity": ("price BIGINT, has_baseline BOOLEAN, support_floor BIGINT, latest BIGINT, rolling_30d BIGINT, "
                    "volatility BIGINT, sticker_value BIGINT", "STRUCT<approved: BOOLEAN, reason: STRING>",
                    scoring.opportunity),
    "estimated_profit": ("latest BIGINT, price BIGINT", _CENTS, scoring.estimated_profit),
    "live_floor": ("cash BIGINT, median BIGINT, threshold BIGINT", _CENTS, audit.live_floor),
    "liquidity_label": ("liquid BOOLEAN", "STRING", audit.liquidity_label),
    "ascii_only": ("text STRING", "STRING", audit.ascii_only),
    "verdict": ("score BIGINT", "STRING", audit.verdict),
}


def _parameter_names(parameters: str) -> list[str]:
    depth, found, start = 0, [], 0
    for i, char in enumerate(parameters + ","):
        depth += {"<": 1, ">": -1}.get(char, 0)
        if char == "," and depth == 0:
            found.append(parameters[start:i].split()[0])
            start = i + 1
    return found


def register_functions(spark: SparkSession, prefix: str = "ts_") -> list[str]:
    """Create ``<prefix><name>`` for every function and return the names."""
    for name, (parameters, result, build) in FUNCTIONS.items():
        body = build(*[F.col(p) for p in _parameter_names(parameters)])
        text = spark._jsparkSession.expression(body._jc).sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {text}")
    return [prefix + name for name in FUNCTIONS]
