"""Runs of an endless sequence, emitted as they close.

One state a line and fork: the last value and the open run. A run closes when
the sign flips, or when the line has been silent for ``gap`` of event time. Rows
not later than the line's last one are dropped, since they would cut runs
already emitted; each closed run carries how many were (late).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "line_id long, fork string, L long, I long, D long, M long, Rdn long, x0 long, late long"
STATE = "ts long, tie long, i long, n long, late long, sm int, Lm long, Im long, Dm long, Mm long, Rm long, xm long, sd int, Ld long, Id long, Dd long, Md long, Rd long, xd long"
_NO_RUN = (-1, 0, 0, 0, 0, 0, 0)


def _closed(line: int, fork: str, run: tuple, late: int) -> tuple:
    return (line, fork, run[1], run[2], run[3], run[4], run[5] + 1, run[6], late)


def stream_runs(events: DataFrame, ave: int, watermark: str = "1 hour", gap_ms: int | None = None) -> DataFrame:
    """Closed runs (append mode) of a stream of line_id, ts (timestamp), tie (total order at equal ts), i.

    With gap_ms the open runs of a line close that long after the watermark has passed its last row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = int(key[0])
        held = state.get if state.exists else (-(2**62), 0, None, 0, 0, *_NO_RUN, *_NO_RUN)
        ts, tie, i, n, late = held[:5]
        open_ = {"m": tuple(held[5:12]), "d": tuple(held[12:19])}
        out = []
        if state.hasTimedOut:
            out = [_closed(line, f, r, late) for f, r in open_.items() if r[1]]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "tie"])
            for t, k, v in zip(rows.ts.astype("int64"), rows.tie, rows.i):
                t, k, v = int(t), int(k), int(v)
                if (t, k) <= (ts, tie):
                    late += 1
                    continue
                ts, tie = t, k
                if i is not None:
                    d, m = v - i, ave - abs(v - i)
                    for f, sign in (("m", int(m > 0)), ("d", int(d > 0))):
                        run = open_[f]
                        if run[0] != sign:
                            if run[1]:
                                out.append(_closed(line, f, run, late))
                            run = (sign, 0, 0, 0, 0, 0, n)
                        open_[f] = (sign, run[1] + 1, run[2] + v + i, run[3] + d, run[4] + m, run[5] + int(m < 0), run[6])
                    n += 1
                i = v
            state.update((ts, tie, i, n, late, *open_["m"], *open_["d"]))
            if gap_ms is not None:
                state.setTimeoutTimestamp(max(int(ts // 1_000_000) + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    named = events.select(F.col("line_id").cast("long").alias("line_id"), "ts", F.col("tie").cast("long").alias("tie"), F.col("i").cast("long").alias("i"))
    timeout = GroupStateTimeout.NoTimeout if gap_ms is None else GroupStateTimeout.EventTimeTimeout
    return named.withWatermark("ts", watermark).groupBy("line_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
