"""Greedy duplicate suppression of ticks, and the price window before each accepted tick.

A tick is a duplicate when its price equals the last *accepted* price of its item and it comes
less than ``window_s`` seconds after that accepted tick. Duplicates do not move the reference.

Between two neighbouring ticks of an item, a new price or a pause of ``window_s`` always leads
to acceptance (a "cut"). Only inside a run without cuts does acceptance depend on the run's
earlier ticks, and there it is a walk: from an accepted second to the first tick at or after
``second + window_s``. The walk is done for all runs of an Arrow batch at once. An item's rows
may span any number of batches and partitions: the state handed on is the last tick and the
last accepted second.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickscope.functions.scoring import DEFAULTS
from tickscope.operators.ordering import GROUP_ROWS, largest_group, stage_ordered, with_frames

DUPLICATE = "is_duplicate"


class Carry(NamedTuple):
    """Last tick before the current rows, and the last accepted second of its run."""

    key: object
    price: int
    second: int
    accepted: int


def _cuts(keys, prices, seconds, window_s: int, carry: Carry | None) -> np.ndarray:
    cut = np.ones(len(seconds), dtype=bool)
    cut[1:] = (keys[1:] != keys[:-1]) | (prices[1:] != prices[:-1]) | (seconds[1:] - seconds[:-1] >= window_s)
    if carry is not None:
        cut[0] = keys[0] != carry.key or prices[0] != carry.price or seconds[0] - carry.second >= window_s
    return cut


def accept(keys, prices, seconds, window_s: int, carry: Carry | None) -> tuple[np.ndarray, Carry]:
    """Accepted flags of rows sorted by (key, second), and the carry after them."""
    n = len(seconds)
    cut = _cuts(keys, prices, seconds, window_s, carry)
    run = np.cumsum(cut)
    width = int(seconds.max() - seconds.min()) + window_s + 1
    place = run.astype(np.int64) * width + (seconds - seconds.min())
    following = np.searchsorted(place, place + window_s)
    heads = np.flatnonzero(cut)
    if not cut[0]:
        continuing = seconds[: heads[0] if len(heads) else n]
        first = int(np.searchsorted(continuing, carry.accepted + window_s))
        if first < len(continuing):
            heads = np.append(heads, first)
    accepted = np.zeros(n, dtype=bool)
    while len(heads):
        accepted[heads] = True
        after = following[heads]
        inside = after < n
        heads = after[inside][run[after[inside]] == run[heads[inside]]]
    in_last_run = np.flatnonzero(accepted & (run == run[-1]))
    last = int(seconds[in_last_run[-1]]) if len(in_last_run) else carry.accepted
    return accepted, Carry(keys[-1], int(prices[-1]), int(seconds[-1]), last)


def _arrays(batch: pa.RecordBatch, key: str, price: str, second: str):
    def values(name: str) -> np.ndarray:
        return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    return values(key), values(price).astype(np.int64), values(second).astype(np.int64)


def _flagger(key: str, price: str, second: str, window_s: int, carries: dict[int, Carry] | None):
    """Function for ``mapInArrow`` over sorted partitions."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, started = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if carries is not None:
                part = batch.schema.get_field_index("_part")
                if not started:
                    carry = carries.get(batch.column(part)[0].as_py())
                names = [n for n in batch.schema.names if n not in ("_part", "_pos")]
                batch = batch.select(names)
            started = True
            accepted, carry = accept(*_arrays(batch, key, price, second), window_s, carry)
            yield _with(batch, {DUPLICATE: pa.array(~accepted)})

    return flag


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def trailing_moments(keys, prices, back: int, tail: np.ndarray, tail_key) -> dict[str, np.ndarray]:
    """Count, sum and sum of squares of the up to ``back`` earlier prices of each row's key.

    ``tail`` holds the last prices of ``tail_key`` before these rows.
    """
    lead = len(tail) if len(keys) and keys[0] == tail_key else 0
    values = np.concatenate([tail[len(tail) - lead:], prices])
    # running sums stay exact: beyond 64 bits they are kept as Python integers
    if len(values) and int(np.abs(values).max()) ** 2 * len(values) >= 2**63:
        values = values.astype(object)
    change = np.ones(len(keys), dtype=bool)
    change[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(change) + lead
    if lead:
        starts[0] = 0
    here = np.arange(lead, len(values))
    low = np.maximum(starts[np.cumsum(change) - 1], here - back)

    def between(numbers):
        running = np.concatenate([[0], np.cumsum(numbers)])
        return (running[here] - running[low]).astype(np.int64)

    return {"n": here - low, "sx": between(values), "sxx": between(values * values)}


def _windower(key: str, price: str, second: str, window_s: int, back: int):
    """Accepted rows of sorted partitions with the moments of their window."""

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, tail, tail_key = None, np.empty(0, dtype=np.int64), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            accepted, carry = accept(*_arrays(batch, key, price, second), window_s, carry)
            batch = batch.filter(pa.array(accepted))
            if batch.num_rows == 0:
                continue
            keys, prices, _ = _arrays(batch, key, price, second)
            moments = trailing_moments(keys, prices, back, tail, tail_key)
            same = np.flatnonzero(keys != keys[-1])
            own = prices[same[-1] + 1:] if len(same) else prices
            tail = np.concatenate([tail, own]) if not len(same) and keys[0] == tail_key else own
            tail, tail_key = tail[-back:], keys[-1]
            yield _with(batch, {name: pa.array(column, type=pa.int64()) for name, column in moments.items()})

    return window


_SUMMARY = (
    "part BIGINT, first_price BIGINT, first_second BIGINT, last_price BIGINT, last_second BIGINT, "
    "accepted BIGINT, exits ARRAY<BIGINT>"
)


def _summarizer(key: str, price: str, second: str, window_s: int):
    """One row per partition: its ends, and how the last accepted second follows from its start.

    ``exits`` is set when the partition has no inner cut: entry d is the last accepted second
    when acceptance may start d seconds after the first tick (-1: nothing accepted).
    """

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, carry, uniform, parts = None, None, True, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, prices, seconds = _arrays(batch, key, price, second)
            inner = _cuts(keys, prices, seconds, window_s, carry)
            if head is None:
                part = batch.column(batch.schema.get_field_index("_part"))[0].as_py()
                head = (part, keys[0], int(prices[0]), int(seconds[0]))
                inner[0] = False
            uniform = uniform and not inner.any()
            parts = [*parts, np.unique(seconds)] if uniform else []
            _, carry = accept(keys, prices, seconds, window_s, carry)
        if head is None:
            return
        exits = None
        if uniform:
            exits = _exits(np.unique(np.concatenate(parts)), window_s)
        columns = {
            "part": head[0], "first_price": head[2], "first_second": head[3], "last_price": carry.price,
            "last_second": carry.second, "accepted": carry.accepted, "exits": exits,
            "first_key": head[1], "last_key": carry.key,
        }
        key_type = batch.schema.field(key).type
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], type=key_type) if "key" in n
             else pa.array([v], type=pa.list_(pa.int64()) if n == "exits" else pa.int64())
             for n, v in columns.items()],
            names=list(columns),
        )

    return summarize


def _exits(seconds: np.ndarray, window_s: int) -> list[int]:
    here = np.searchsorted(seconds, seconds[0] + np.arange(window_s + 1))
    following = np.searchsorted(seconds, seconds + window_s)
    last = np.full(window_s + 1, -1, dtype=np.int64)
    active = here < len(seconds)
    while active.any():
        last[active] = seconds[here[active]]
        here[active] = following[here[active]]
        active = here < len(seconds)
    return last.tolist()


def _carries(summaries: list, window_s: int) -> dict[int, Carry]:
    """Incoming carry of every partition; ``summaries`` has one row per partition."""
    found, carry = {}, None
    for s in sorted(summaries, key=lambda row: row["part"]):
        accepted = s["accepted"]
        if carry is not None:
            found[s["part"]] = carry
            continues = (
                s["first_key"] == carry.key and s["first_price"] == carry.price
                and s["first_second"] - carry.second < window_s
            )
            if s["exits"] is not None and continues:
                offset = max(0, carry.accepted + window_s - s["first_second"])
                leaves = s["exits"][offset]
                accepted = carry.accepted if leaves < 0 else leaves
        carry = Carry(s["last_key"], s["last_price"], s["last_second"], accepted)
    return found


def flag_duplicates(
    ticks: DataFrame,
    key: str = "market_hash_name",
    price: str = "price_cents",
    second: str = "timestamp",
    tie: str = "id",
    window_s: int = DEFAULTS.dedup_window_s,
    limit: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """All ticks with ``is_duplicate``, judged in (second, tie) order per key.

    ``largest`` is the size of the largest item where the caller already knows a bound.
    """
    schema = T.StructType([*ticks.schema.fields, T.StructField(DUPLICATE, T.BooleanType())])
    if (largest_group(ticks, [key]) if largest is None else largest) <= limit:
        placed = ticks.repartition(key).sortWithinPartitions(key, second, tie)
        return placed.mapInArrow(_flagger(key, price, second, window_s, None), schema)
    staged = stage_ordered(ticks, [key], [second, tie])
    key_ddl = ticks.schema[key].dataType.simpleString()
    summary_schema = f"{_SUMMARY}, first_key {key_ddl}, last_key {key_ddl}"
    narrow = staged.select(key, price, second, "_part")
    # one row per partition, each with at most window_s + 1 numbers
    rows = narrow.mapInArrow(_summarizer(key, price, second, window_s), summary_schema).collect()
    return staged.mapInArrow(_flagger(key, price, second, window_s, _carries(rows, window_s)), schema)


def accepted_windows(
    ticks: DataFrame, window_s: int = DEFAULTS.dedup_window_s, size: int = DEFAULTS.window_size, limit: int = GROUP_ROWS
) -> DataFrame:
    """Accepted ticks with the moments ``n``, ``sx``, ``sxx`` of the ``size - 1`` prices before.

    Both need an item's ticks in order, so they share one shuffle and one pass. With a hot item,
    suppression and windows are two steps over cut items.
    """
    columns = {"key": "market_hash_name", "price": "price_cents", "second": "timestamp"}
    largest = largest_group(ticks, ["market_hash_name"])
    if largest > limit:
        kept = dedup_ticks(ticks, window_s=window_s, limit=limit, largest=largest)
        return price_windows(kept, size=size, limit=limit, largest=largest)
    moments = [T.StructField(name, T.LongType()) for name in ("n", "sx", "sxx")]
    placed = ticks.repartition("market_hash_name").sortWithinPartitions("market_hash_name", "timestamp", "id")
    window = _windower(**columns, window_s=window_s, back=size - 1)
    return placed.mapInArrow(window, T.StructType([*ticks.schema.fields, *moments]))


def price_windows(
    ticks: DataFrame, key: str = "market_hash_name", size: int = DEFAULTS.window_size, limit: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Moments ``n``, ``sx``, ``sxx`` of the up to ``size - 1`` prices before each tick of an item."""
    price = F.col("price_cents")

    def over(value):
        return lambda window: F.coalesce(value.over(window.rowsBetween(-(size - 1), -1)), F.lit(0))

    columns = {"n": over(F.count(price)), "sx": over(F.sum(price)), "sxx": over(F.sum(price * price))}
    return with_frames(ticks, [key], ["timestamp", "id"], size - 1, columns, limit, largest)


def dedup_ticks(ticks: DataFrame, **options) -> DataFrame:
    """Only the accepted ticks; see ``flag_duplicates``."""
    return flag_duplicates(ticks, **options).filter(~F.col(DUPLICATE)).drop(DUPLICATE)
