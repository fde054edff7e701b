"""Focus sessions from a live feed: the rows of ``operators.focus`` with a few numbers of state per host.

Samples are taken in order of their clock.  What a host carries from one micro-batch to the next is
its open session: the anchor and when it took over, the run of one title that may take over next,
sums, the windows seen aside and the latest signals.  A micro-batch is folded by runs of one title
and by jumps to the next cut, not sample by sample.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import focus
from ..operators.focus import COUNTS, SIGNALS, FocusRules
from .ordered_state import InOrder, in_order, keyed, struct

_SUMS = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} string" for c in SIGNALS)])
_SAMPLE = struct(f"us long, seq long, wall string, title string, process string, quiet double, {_SUMS}")
_CARRY = struct("anchor string, process string, begun long, begun_wall string, run string, since long, away long, last_us long, last_wall string, " + _SUMS)
_WINDOW = struct("title string, process string")
_OUT = struct("host string, type string, ts_wall string, back double, seconds long, anchor string, process string, duration_sec double, ended string, ended_back double, " + _SUMS,
              satellites=T.ArrayType(_WINDOW))


@dataclass
class Carry:
    """What a host's open session holds."""
    anchor: str | None = None
    process: str | None = None
    begun: int | None = None
    begun_wall: str | None = None
    run: str | None = None
    since: int | None = None
    away: int | None = None
    last_us: int | None = None
    last_wall: str | None = None
    keys: int = 0
    mouse: int = 0
    saves: int = 0
    uia_value: str | None = None
    cmdline: str | None = None
    cwd: str | None = None
    saved_artifact: str | None = None
    narration: str | None = None


class FocusFold(InOrder):
    def __init__(self, rules: FocusRules, silence_us: int):
        super().__init__(_SAMPLE, _OUT, silence_us)
        self.rules = rules

    def opened(self, handle) -> None:
        self.carry = handle.getValueState("carry", _CARRY)
        self.aside = handle.getMapState("aside", _WINDOW, struct("seen boolean"))

    def _load(self) -> Carry:
        self.seen = dict.fromkeys(self.aside.keys())
        return Carry(*self.carry.get()) if self.carry.exists() else Carry()

    def _save(self, c: Carry) -> None:
        """The windows aside of the open session are held while a micro-batch is folded, and written once after it."""
        self.carry.update(tuple(asdict(c).values()))
        self.aside.clear()
        for window in self.seen:
            self.aside.updateValue(tuple(window), (True,))

    def _finish(self, c: Carry, until: int, wall: str, back: float | None) -> list[dict]:
        """The session that ends at ``until``; sums, signals and windows aside start again."""
        satellites = sorted((title, process) for title, process in self.seen if title != c.anchor)
        row = {"type": "SESSION", "ts_wall": c.begun_wall, "anchor": c.anchor, "process": c.process, "satellites": [{"title": t, "process": p} for t, p in satellites],
               "duration_sec": max(until - c.begun, 0) / 1e6, "ended": wall, "ended_back": back}
        row |= {name: getattr(c, name) for name in (*COUNTS, *SIGNALS)}
        for name in COUNTS:
            setattr(c, name, 0)
        for name in SIGNALS:
            setattr(c, name, None)
        self.seen.clear()
        return [row]

    def fold(self, rows: pd.DataFrame) -> list[dict]:
        c, out = self._load(), []
        us, quiet = rows["us"].to_numpy(np.int64), rows["quiet"].to_numpy(float)
        idle = quiet >= self.rules.idle_threshold
        edges = [0, *(np.flatnonzero(idle[1:] != idle[:-1]) + 1), len(rows)]
        for low, high in zip(edges, edges[1:], strict=False):
            block = rows.iloc[low:high]
            if idle[low]:
                out += self._rest(c, block)
            else:
                if c.away is not None:
                    out.append({"type": "IDLE_END", "ts_wall": block["wall"].iloc[0], "seconds": round((int(us[low]) - c.away) / 1e6)})
                    c.away = None
                out += self._work(c, block)
        c.last_us, c.last_wall = int(us[-1]), rows["wall"].iloc[-1]
        self._save(c)
        return out

    def _rest(self, c: Carry, block: pd.DataFrame) -> list[dict]:
        """Samples of a quiet host: the first one ends the session when the input stopped."""
        sums = {name: block[name].to_numpy(np.int64) for name in COUNTS}
        out, taken = [], 0
        if c.away is None:
            us, wall, quiet = int(block["us"].iloc[0]), block["wall"].iloc[0], float(block["quiet"].iloc[0])
            c.away, taken = us - int(max(quiet, 0.0) * 1e6), 1
            for name in COUNTS:
                setattr(c, name, getattr(c, name) + int(sums[name][0]))
            if c.anchor is not None:
                out = self._finish(c, c.away, wall, quiet)
            for name in COUNTS:
                setattr(c, name, 0)
            self.seen.clear()
            c.anchor = c.process = c.begun = c.begun_wall = c.run = c.since = None
            out.append({"type": "IDLE_START", "ts_wall": wall, "back": quiet, "seconds": round(quiet)})
        for name in COUNTS:
            setattr(c, name, getattr(c, name) + int(sums[name][taken:].sum()))
        return out

    def _opens(self, c: Carry, us: np.ndarray, titles: np.ndarray, names: list) -> tuple[list[tuple[int, str, str]], list[tuple[int, str, str]]]:
        """Samples where an anchor takes over, and the first samples of runs, both with their windows."""
        shown = np.flatnonzero(titles != None)  # noqa: E711  (element by element)
        opens, firsts, anchor = [], [], c.anchor
        heads = np.flatnonzero(np.concatenate([[len(shown) > 0], titles[shown[1:]] != titles[shown[:-1]]]))
        for head, stop in zip(heads, [*heads[1:], len(shown)], strict=False):
            at, title = int(shown[head]), titles[shown[head]]
            if title != c.run:
                c.run, c.since = title, int(us[at])
                firsts.append((at, title, names[at] or ""))
            if anchor is None:
                opens.append((at, title, names[at] or ""))
                anchor = title
            elif title != anchor:
                settled = head + int(np.searchsorted(us[shown[head:stop]], c.since + int(self.rules.anchor_timeout * 1e6)))
                if settled < stop:
                    at = int(shown[settled])
                    opens.append((at, title, names[at] or ""))
                    anchor = title
        return opens, firsts

    def _work(self, c: Carry, block: pd.DataFrame) -> list[dict]:
        """Samples of a person at work: takeovers, cuts of long sessions, and what falls to each session."""
        us, walls = block["us"].to_numpy(np.int64), block["wall"].tolist()
        titles, names = block["title"].to_numpy(object), block["process"].tolist()
        opens, firsts = self._opens(c, us, titles, names)
        taking: set[int] = set()
        totals = {name: np.concatenate([[0], np.cumsum(block[name].to_numpy(np.int64))]) for name in COUNTS}
        said = {name: np.array([k for k, text in enumerate(block[name]) if text and titles[k] is not None], np.int64) for name in SIGNALS}
        out, place, counted, met, spacing = [], 0, 0, 0, int(self.rules.periodic * 1e6)

        def collect(upto: int, heard: int) -> None:
            """Give the open session its sums and windows up to a sample, and its signals before another one."""
            nonlocal counted, place, met
            for name in COUNTS:
                setattr(c, name, getattr(c, name) + int(totals[name][upto] - totals[name][counted]))
            # runs are in order and every sample is counted once, so each run is met once
            while met < len(firsts) and firsts[met][0] < upto:
                at, title, process = firsts[met]
                if at not in taking and title != c.anchor:
                    self.seen[title, process] = None
                met += 1
            for name in SIGNALS:
                own = said[name][slice(*np.searchsorted(said[name], [place, heard]))]
                own = own[titles[own] == c.anchor]
                setattr(c, name, block[name].iloc[own[-1]] if len(own) else getattr(c, name))
            counted, place = upto, heard
        for at, title, process in [*opens, (len(us), None, None)]:
            while c.anchor is not None:
                cut = max(place, int(np.searchsorted(us, c.begun + spacing)))
                if cut >= at:
                    break
                collect(cut + 1, cut + 1)
                out += self._finish(c, int(us[cut]), walls[cut], None)
                c.begun, c.begun_wall = int(us[cut]), walls[cut]
            if title is None:
                break
            if c.anchor is None:
                place = at
            else:
                # a window that takes over with its first sample was never aside
                taking.add(at)
                collect(at + 1, at)
                out += self._finish(c, int(us[at]), walls[at], None)
            c.anchor, c.process, c.begun, c.begun_wall = title, process, int(us[at]), walls[at]
        collect(len(us), len(us))
        return out

    def end(self) -> list[dict]:
        c = self._load()
        out = self._finish(c, c.last_us, c.last_wall, None) if c.anchor is not None else []
        self.carry.clear()
        self.aside.clear()
        return out


def focus_stream(samples: DataFrame, rules: FocusRules = FocusRules(), *, delay: str = "1 minute", silence_sec: float = 43_200.0) -> DataFrame:
    """Stream of window samples (the columns of ``focus.sessionize``) to session and idle rows.

    A host without a sample for ``silence_sec`` is closed at its last one; apart from that, the rows are
    those of the batch form.  Rows later than ``delay`` are dropped.
    """
    whole = [F.greatest(F.coalesce(F.col(c).cast("bigint"), F.lit(0)), F.lit(0)).alias(c) for c in COUNTS]
    rows = keyed(samples).select("host", "ts", F.unix_micros("ts").alias("us"), F.col("tick_seq").cast("bigint").alias("seq"), F.col("ts_wall").alias("wall"), "title", "process",
                                 F.coalesce("idle_seconds", F.lit(0.0)).cast("double").alias("quiet"), *whole, *SIGNALS)
    out = in_order(rows, FocusFold(rules, int(silence_sec * 1e6)), delay)
    at = F.when(F.col("back").isNotNull(), focus.earlier(F.col("ts_wall"), F.col("back"))).otherwise(F.col("ts_wall"))
    ended = F.when(F.col("ended_back").isNotNull(), focus.earlier(F.col("ended"), F.col("ended_back"))).otherwise(F.col("ended"))
    out = out.withColumns({"ts_wall": at, "ended": ended}).drop("back", "ended_back")
    return focus.judged(out, rules)
