"""Long unattended runs from a live feed of process scans; a process that a scan no longer lists as busy has ended.

A scan is a row for each process, or one row without a process.  Runs of a micro-batch are runs of scan
numbers per process; only runs that reach the last scan are carried, in a map with one entry a process.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CPU_BUSY, LONG_RUN_MIN
from .ordered_state import InOrder, in_order, keyed, struct

_SCAN = struct("us long, seq long, human boolean, pid long, process string, cmdline string, cpu double")
_RUN = struct("started_us long, ended_us long, cpu_peak double, process string, cmdline string")
_OUT = struct("host string, pid long, started_us long, ended_us long, cpu_peak double, process string, cmdline string")


class RunFold(InOrder):
    def __init__(self, cpu_min: float, min_us: int, silence_us: int):
        super().__init__(_SCAN, _OUT, silence_us)
        self.cpu_min, self.min_us = cpu_min, min_us

    def opened(self, handle) -> None:
        self.running = handle.getMapState("running", struct("pid long"), _RUN)
        self.seen = handle.getValueState("seen", struct("us long"))

    def fold(self, rows: pd.DataFrame) -> list[dict]:
        last = self.seen.get()[0] if self.seen.exists() else None
        us = rows["us"].to_numpy(np.int64)
        fresh = us > last if last is not None else np.ones(len(rows), bool)
        rows, us = rows[fresh], us[fresh]
        if not len(rows):
            return []       # a replayed scan says nothing new
        scans, number = np.unique(us, return_inverse=True)
        busy = rows.assign(scan=number)[(rows["human"].ne(True) & rows["pid"].notna() & (rows["cpu"].astype(float) >= self.cpu_min)).to_numpy()]
        # a process listed twice in one scan counts once, its last entry stands
        busy = busy.sort_values(["pid", "scan", "seq"], kind="stable").drop_duplicates(["pid", "scan"], keep="last")
        runs, carried = [], {}
        if len(busy):
            pid, scan = busy["pid"].to_numpy(np.int64), busy["scan"].to_numpy(np.int64)
            heads = np.flatnonzero((np.diff(pid, prepend=pid[0] - 1) != 0) | (np.diff(scan, prepend=-9) != 1))
            tails = np.append(heads[1:], len(busy)) - 1
            peaks = np.maximum.reduceat(busy["cpu"].to_numpy(float), heads)
            names, lines = busy["process"].to_numpy(object), busy["cmdline"].to_numpy(object)
            for head, tail, peak in zip(heads, tails, peaks, strict=True):
                runs.append((int(pid[head]), int(scan[head]), int(scan[tail]), float(peak), names[tail], lines[tail]))
        before = {key[0]: tuple(value) for key, value in self.running.iterator()}
        stored, done, end = set(before), [], len(scans) - 1
        for pid, head, tail, peak, name, line in runs:
            begun = int(scans[head])
            if head == 0 and pid in before:
                begun, _, earlier_peak, *_ = before.pop(pid)
                peak = max(peak, earlier_peak)
            run = (begun, int(scans[tail]), peak, name, line)
            if tail == end:
                carried[pid] = run
            else:
                done += self._row(pid, run)
        for pid, run in before.items():
            done += self._row(pid, run)
        for pid in stored - carried.keys():
            self.running.removeKey((pid,))
        for pid, run in carried.items():
            self.running.updateValue((pid,), run)
        self.seen.update((int(scans[-1]),))
        return done

    def _row(self, pid: int, run: tuple) -> list[dict]:
        return [dict(zip(("pid", *_RUN.names), (pid, *run), strict=True))] if run[1] - run[0] >= self.min_us else []

    def end(self) -> list[dict]:
        done = [row for key, value in list(self.running.iterator()) for row in self._row(key[0], tuple(value))]
        self.running.clear()
        self.seen.clear()
        return done


def long_run_stream(ticks: DataFrame, *, cpu_min: float = CPU_BUSY, min_sec: float = LONG_RUN_MIN, delay: str = "1 minute", silence_sec: float = 43_200.0) -> DataFrame:
    """Stream of scans (the columns of ``sessions.long_runs``) to long runs, with the rows of the batch form.

    A scan that is not after the last one of its host is a replay and is left out.  A host without a scan
    for ``silence_sec`` has its runs closed at their last scan.
    """
    rows = keyed(ticks).select("host", "ts", "human_present", F.posexplode_outer("procs").alias("pos", "p"))
    rows = rows.select("host", "ts", F.unix_micros("ts").alias("us"), F.coalesce("pos", F.lit(0)).cast("bigint").alias("seq"), F.col("human_present").alias("human"),
                       F.col("p.pid").cast("bigint").alias("pid"), F.col("p.name").alias("process"), F.col("p.cmdline").alias("cmdline"), F.col("p.cpu_percent").cast("double").alias("cpu"))
    out = in_order(rows, RunFold(cpu_min, int(min_sec * 1e6), int(silence_sec * 1e6)), delay)
    seconds = F.round((F.col("ended_us") - F.col("started_us")) / 1e6, 1)
    return out.select("host", "pid", F.timestamp_micros("started_us").alias("started"), F.timestamp_micros("ended_us").alias("ended"),
                      F.round("cpu_peak", 1).alias("cpu_peak"), "process", "cmdline", seconds.alias("duration_sec"))
