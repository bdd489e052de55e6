"""The state of units of work as a stream of their events tells it, with units that take too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id string, unit string, event string, ts timestamp"
STATES = "unit string, state string, began timestamp, ended timestamp"


def unit_states(events: DataFrame, delay: str = "10 minutes", limit_seconds: int = 3600) -> DataFrame:
    """(unit, state, began, ended) whenever a unit's state settles, from events (id, unit, event, ts).

    A unit that completes is ``complete``. One that has begun and isn't complete after
    ``limit_seconds`` of event time is ``overdue``, once; if it completes after all, that is told
    too. A further begin makes the unit in flight anew. Events that come twice (one id) within the
    watermark count once, and those later than ``delay`` not at all. A unit's state is dropped
    when it is complete, so what is kept is bounded by the units in flight.
    """
    seen = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, out = key[0], []
        began, told = state.get if state.exists else (None, False)
        at = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        if state.hasTimedOut:
            if began is not None and not told:
                out.append((unit, "overdue", at(began), None))
            told = True
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event"], kind="stable")
            for event, ts in zip(rows["event"], rows["ts"], strict=True):
                us = int(ts.value // 1000)
                if event == "begin":
                    began, told = us, False
                elif event == "complete":
                    out.append((unit, "complete", at(began), at(us)))
                    began, told = None, False
        if began is None:
            state.remove()
        else:
            state.update((began, told))
            if not told:
                due = began // 1000 + limit_seconds * 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["unit", "state", "began", "ended"])

    return seen.groupBy("unit").applyInPandasWithState(settle, STATES, "began long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def current(states: DataFrame) -> DataFrame:
    """The last settled state of each unit of a table that such a stream was written to."""
    return states.groupBy("unit").agg(F.max_by(F.struct("state", "began", "ended"), F.struct(F.coalesce("ended", "began"), F.col("state") == "complete")).alias("s")).select("unit", "s.*")
