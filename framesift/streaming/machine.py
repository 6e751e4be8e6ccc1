"""The status machine of jobs as a stream: each entry of the log is accepted or told why not, and finished jobs expire.

State is each job's status and when it came. It is kept by parts: jobs are dealt to a fixed number of parts by a hash
of their id, and a part's jobs are one value of the store, fetched and put once a batch, not once a job. Entries of a
job that arrive together are taken in order of time, then status. A finished job's state goes when its time is up, by a
timer on the stream's watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.process import STEPS

FIRST = "queued"
OUT = "id string, status string, at timestamp, outcome string"
#: How many parts jobs are dealt to; fixed for the life of a stream's checkpoint.
PARTS = 4096
_TOLD = ["id", "status", "micros", "outcome"]
#: State stores that hold timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome(before: str | None, since: Any, status: str, at: Any) -> str:  # noqa: ANN401
    """accepted; repeated (the status that the job has); late (before its last step); forbidden (no such step)."""
    if before is None:
        return "accepted" if status == FIRST else "forbidden"
    if at < since:
        return "late"
    if status == before:
        return "repeated"
    return "accepted" if status in STEPS.get(before, ()) else "forbidden"


class StatusMachine(StatefulProcessor):
    """A key is a part of the jobs. retention_seconds: after so long a finished job expires and is as if it had never
    been; None: never."""

    def __init__(self, retention_seconds: float | None = None) -> None:
        self.retention = retention_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "id array<string>, status array<string>, micros array<bigint>")

    def _jobs(self) -> dict[str, tuple[str, int]]:
        held = self.state.get()
        return {} if held is None else {i: (s, t) for i, s, t in zip(*held)}

    def _keep(self, jobs: dict[str, tuple[str, int]]) -> None:
        if jobs:
            self.state.update((list(jobs), [s for s, _ in jobs.values()], [t for _, t in jobs.values()]))
        else:
            self.state.clear()

    def _end(self, micros: int) -> int:
        """Milliseconds when a job that finished then expires."""
        return int(micros / 1000 + self.retention * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        given = sorted(entry for some in rows for entry in zip(some["id"], some["micros"].tolist(), some["status"]))  # one part's entries of one batch
        jobs, told, ends, changed = self._jobs(), [], set(), False
        for name, at, status in given:
            before, since = jobs.get(name, (None, None))
            said = outcome(before, since, status, at)
            if said == "accepted":
                jobs[name], changed = (status, at), True
                if self.retention is not None and status not in STEPS:
                    ends.add(self._end(at))
            told.append((name, status, at, said))
        if changed:
            self._keep(jobs)
        for end in ends:
            self.handle.registerTimer(end)
        yield pd.DataFrame(told, columns=_TOLD)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401, N802, N803
        now, jobs = expiredTimerInfo.getExpiryTimeInMs(), self._jobs()
        gone = [(name, status, at, "expired") for name, (status, at) in jobs.items() if status not in STEPS and self._end(at) <= now]
        if gone:
            for name, *_ in gone:
                del jobs[name]
            self._keep(jobs)
            yield pd.DataFrame(gone, columns=_TOLD)

    def close(self) -> None:
        pass


def checked_steps(log: DataFrame, *, retention_seconds: float | None = None, lateness: str = "0 seconds", parts: int = PARTS) -> DataFrame:
    """Stream (id, status, at) -> OUT, a row an entry, and one for each job that expires (status and time of its last step).

    Entries before the watermark are gone before they are seen. Null ids, statuses or times are left out. The session's
    state store has to be PROVIDER. A part's jobs and its entries of one batch are in memory together.
    """
    given = log.select(F.col("id").cast("string").alias("id"), "status", F.col("at").cast("timestamp").alias("at")).dropna()
    dealt = given.withWatermark("at", lateness).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "status", "at", F.unix_micros("at").alias("micros"))
    told = dealt.groupBy("part").transformWithStateInPandas(StatusMachine(retention_seconds), outputStructType="id string, status string, micros long, outcome string", outputMode="Append", timeMode="EventTime")
    return told.select("id", "status", F.timestamp_micros("micros").alias("at"), "outcome")
