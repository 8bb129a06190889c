"""Per-item streaming state: the last accepted tick and the newest prices."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import IO

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickscope.functions.scoring import DEFAULTS, Tuning

OUTPUT = (
    "id BIGINT, market_hash_name STRING, price_cents BIGINT, timestamp BIGINT, float_value DOUBLE, "
    "stickers_json STRING, is_duplicate BOOLEAN, newest_cents BIGINT, n BIGINT, sx BIGINT, sxx BIGINT"
)
_INPUT = ["id", "market_hash_name", "price_cents", "timestamp", "float_value", "stickers_json"]
RUN_ROWS = 100_000  # rows of an item that are ordered in memory
FAN = 32  # sorted runs that are merged at once
FRAME_ROWS = 2_000  # rows read from a run at a time, and of a merged frame


def _place(row: tuple) -> tuple:
    number, second = row[0], row[3]
    missing = number is None or number != number
    return second, missing, 0 if missing else number


def _sorted(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames)[_INPUT].sort_values(["timestamp", "id"], kind="stable", ignore_index=True)


def _spill(frames: Iterable[pd.DataFrame]) -> IO[bytes]:
    file = tempfile.TemporaryFile()
    for frame in frames:
        pickle.dump(frame, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), FRAME_ROWS):
        # a copy, since a slice would be written with all it is cut from
        yield frame.iloc[start:start + FRAME_ROWS].copy()


def _rows(run: IO[bytes]) -> Iterator[tuple]:
    with run:
        while True:
            try:
                frame = pickle.load(run)
            except EOFError:
                return
            yield from frame.astype(object).itertuples(index=False, name=None)


def _merged(runs: list[IO[bytes]]) -> Iterator[pd.DataFrame]:
    rows = heapq.merge(*map(_rows, runs), key=_place)
    while piece := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(piece, columns=_INPUT)


def ordered(frames: Iterable[pd.DataFrame], run_rows: int = RUN_ROWS, fan: int = FAN) -> Iterator[pd.DataFrame]:
    """The rows of all frames in (second, id) order, in frames of bounded size.

    Up to ``run_rows`` rows are ordered in memory. More go through sorted runs in temporary files of the task, merged
    in levels of ``fan``. Equal rows stay in arrival order.
    """
    held, n, levels = [], 0, [[]]
    for frame in frames:
        held.append(frame)
        n += len(frame)
        del frame
        if n < run_rows:
            continue
        levels[0].append(_spill(_pieces(_sorted(held))))
        held, n = [], 0
        for level, runs in enumerate(levels):
            if len(runs) == fan:
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(_spill(_merged(runs)))
                runs.clear()
    if not any(levels):
        yield from [_sorted(held)] if held else []
        return
    if held:
        levels[0].append(_spill(_pieces(_sorted(held))))
        held = []
    yield from _merged([run for runs in reversed(levels) for run in runs])


class TickProcessor(StatefulProcessor):
    """Flags duplicates and reports the price window of every accepted tick.

    The window is a set of (second, price), ordered by second and then by the text
    ``second:price``, and keeps its ``window_size`` highest members. A late tick is placed by
    its own second, so the newest price need not be the arriving one. State per item is bounded by the
    window size, so no watermark is needed.
    """

    def __init__(self, tuning: Tuning = DEFAULTS, run_rows: int = RUN_ROWS):
        self.tuning = tuning
        self.run_rows = run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "price BIGINT, second BIGINT")
        self._window = handle.getValueState("window", "seconds ARRAY<BIGINT>, prices ARRAY<BIGINT>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_price, last_second = self._last.get() if self._last.exists() else (0, 0)
        members = []
        if self._window.exists():
            seconds, prices = self._window.get()
            members = [(s, f"{s}:{p}", p) for s, p in zip(seconds, prices)]
        # All frames of the key are ordered together: where Arrow cuts them must not matter.
        for frame in ordered(rows, self.run_rows):
            state = []
            for price, second in zip(frame["price_cents"].tolist(), frame["timestamp"].tolist()):
                if price == last_price and second - last_second < self.tuning.dedup_window_s:
                    state.append((True, None, None, None, None))
                    continue
                last_price, last_second = price, second
                member = (second, f"{second}:{price}", price)
                place = bisect_left(members, member)
                if place == len(members) or members[place] != member:
                    insort(members, member)
                    del members[: -self.tuning.window_size]
                earlier = [m[2] for m in members[:-1]]
                state.append((False, members[-1][2], len(earlier), sum(earlier), sum(p * p for p in earlier)))
            flags = pd.DataFrame(state, columns=["is_duplicate", "newest_cents", "n", "sx", "sxx"], index=frame.index)
            counts = flags[["newest_cents", "n", "sx", "sxx"]].astype("Int64")
            yield pd.concat([frame[_INPUT], flags[["is_duplicate"]], counts], axis=1)
        self._last.update((last_price, last_second))
        self._window.update(([m[0] for m in members], [m[2] for m in members]))

    def close(self) -> None:
        pass
