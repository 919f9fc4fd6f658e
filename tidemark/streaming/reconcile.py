"""Checks of each token's feed against what the exchange reports on request, with state kept per token.

Rows come in the order of n: trades (at, seq), books (at, mid) and reports (kind 'rest': at, and of what was asked for
rest_seq, rest_at, rest_n, mid, book_at). A report closes a window: it is judged by what the state has seen, and where
something is missing or differs its trades and book enter the state, as they do the tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["token", "n", "kind", "at", "seq", "mid", "rest_seq", "rest_at", "rest_n", "book_at"]
VERDICT = "token {kind}, n long, at long, window_start long, reasons string, mismatch_bps double, repaired boolean, trades_repaired long, last_seq long, last_trade_at long, last_book_at long"
STATE = "last_seq long, trade_at long, book_at long, mid double, reconciled_at long, gap boolean, regression boolean"
NEW: tuple = (None, None, None, None, None, False, False)
LEAST_BASE = 1e-8


def _largest(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else max(a, b)


def _plain(row: tuple, fraction: int) -> tuple:
    """Nulls and whole numbers as such, which pandas may have made NaN and floats; only one column has fractions."""
    return tuple(None if pd.isna(x) else x if isinstance(x, (str, bool, np.bool_)) else float(x) if i == fraction else int(x) for i, x in enumerate(row))


def step(state: tuple, row: tuple, gap_seconds: int, mismatch_bps: float, sequences: bool) -> tuple[tuple, tuple | None]:
    """The state after a row (n, kind, at, seq, mid, rest_seq, rest_at, rest_n, book_at), and the verdict of a report.
    Times are in microseconds."""
    n, kind, at, seq, mid, rest_seq, rest_at, rest_n, rest_book_at = row
    last_seq, trade_at, book_at, last_mid, done_at, gap, regression = state
    if kind == "trade":
        regression = regression or (trade_at is not None and at < trade_at)
        if sequences and seq is not None:
            gap = gap or (last_seq is not None and seq != last_seq + 1)
            last_seq = _largest(last_seq, seq)
        return (last_seq, _largest(trade_at, at), book_at, last_mid, done_at, gap, regression), None
    if kind == "book":
        regression = regression or (book_at is not None and at < book_at)
        return (last_seq, trade_at, _largest(book_at, at), last_mid if mid is None else mid, done_at, gap, regression), None
    reasons = ["timestamp_regression"] if regression else []
    if sequences and gap:
        reasons.append("sequence_gap")
    if sequences and last_seq is not None:
        if rest_seq is not None and rest_seq > last_seq + 1:
            reasons.append("rest_seq_ahead")
    elif trade_at is None:
        reasons.append("heuristic_reconcile_tick")
    elif (at - trade_at) // 1_000_000 > gap_seconds:
        reasons.append("heuristic_trade_stale")
    off = None if mid is None or last_mid is None else abs(mid - last_mid) / max(abs(mid), abs(last_mid), LEAST_BASE) * 10_000
    repair = bool(reasons) or (off is not None and off > mismatch_bps)
    since = trade_at if done_at is None else done_at
    if repair:
        trade_at, book_at = _largest(trade_at, rest_at), _largest(book_at, rest_book_at)
        last_seq = _largest(last_seq, rest_seq) if sequences else last_seq
        last_mid, gap, regression = last_mid if mid is None else mid, False, False
    verdict = (n, at, since, ",".join(reasons), off, repair, (rest_n or 0) if repair else 0, last_seq, trade_at, book_at)
    return (last_seq, trade_at, book_at, last_mid, _largest(done_at, at), gap, regression), verdict


def reconciled(rows: DataFrame, gap_seconds: int = 60, mismatch_bps: float = 10, sequences: bool = True) -> DataFrame:
    """The verdicts of a batch or a stream of rows (COLUMNS, times as microseconds).

    A batch sorts each token's rows and runs through them, holding one state. A stream keeps the state per token between
    its batches and so goes on after a restart from its checkpoint; rows of one token have to come in the order of n
    from batch to batch. Rows without token, n or time, or of another kind, are no part of either."""
    kind = rows.schema["token"].dataType.simpleString()
    shape = VERDICT.format(kind=kind)
    src = rows.where("token IS NOT NULL AND n IS NOT NULL AND at IS NOT NULL AND kind IN ('trade', 'book', 'rest')").select(*COLUMNS)
    args = (gap_seconds, mismatch_bps, sequences)
    if rows.isStreaming:

        def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            at = _plain(state.get, 3) if state.exists else NEW
            out = []
            for row in pd.concat(list(frames)).sort_values("n")[COLUMNS[1:]].itertuples(index=False, name=None):
                at, verdict = step(at, _plain(row, 4), *args)
                if verdict:
                    out.append((key[0], *verdict))
            state.update(at)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

        return src.groupBy("token").applyInPandasWithState(judge, shape, STATE, "append", GroupStateTimeout.NoTimeout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, state, out = None, NEW, []
        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), *[pa.int64()] * 4]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != token:
                    token, state = row[0], NEW
                state, verdict = step(state, row[1:], *args)
                if verdict:
                    out.append((token, *verdict))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in shape.split(", ")])
                out = []

    return src.repartition("token").sortWithinPartitions("token", "n").mapInArrow(run, shape)
