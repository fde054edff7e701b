"""State per key that takes rows in the order of their clock, whatever order they arrive in.

Rows wait in the state until the watermark has passed them; then they are handled in order.  A key
that is silent for a given time is closed: by a gap between two rows or, without a further row,
by an event-time timer.  Both give the same rows, so results do not depend on how rows are cut into
micro-batches.  What waits is at most a key's rows of one micro-batch and of the watermark's delay; it is
kept in blocks of some thousand rows, because adding to a list in the state store reads the list again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps several state variables of a key and its timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a block.
BLOCK_ROWS = 10_000

_KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def struct(fields: str, **more: T.DataType) -> T.StructType:
    """A row type from ``name kind`` pairs, and further fields; needs no session."""
    named = [T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in fields.split(",") if field)]
    return T.StructType([*named, *(T.StructField(name, kind) for name, kind in more.items())])


def _values(column: pd.Series, kind: T.DataType) -> list:
    """A column as plain values for the state store; whole numbers with gaps arrive as floats."""
    whole = isinstance(kind, T.LongType)
    return [None if gone else int(value) if whole else value for value, gone in zip(column.tolist(), column.isna(), strict=True)]


class InOrder(StatefulProcessor):
    """Base of processors over rows with ``us`` and ``seq``; subclasses give ``opened``, ``fold`` and ``end``."""

    def __init__(self, rows: T.StructType, out: T.StructType, silence_us: int):
        self.rows, self.out, self.silence_us = rows, out, silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", struct("number long"), struct("", block=T.BinaryType()))
        self.blocks = handle.getValueState("blocks", struct("n long"))
        self.heard = handle.getValueState("heard", struct("us long"))
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    def fold(self, rows: pd.DataFrame) -> list[dict]:
        """Take rows in order, without a gap of silence among them; give finished rows."""
        raise NotImplementedError

    def end(self) -> list[dict]:
        """The key is silent: give what is open and clear the state."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = self.blocks.get()[0] if self.blocks.exists() else 0
        for part in rows:
            number = self._store(part, number)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _store(self, rows: pd.DataFrame, number: int) -> int:
        """Put rows into blocks from ``number`` on; gives the number of blocks."""
        schema = to_arrow_schema(self.rows)
        for low in range(0, len(rows), BLOCK_ROWS):
            part = rows.iloc[low:low + BLOCK_ROWS]
            table = pa.table([pa.array(_values(part[f.name], f.dataType), schema.field(f.name).type) for f in self.rows], schema=schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as writer:
                writer.write_table(table)
            self.waiting.updateValue((number,), (sink.getvalue().to_pybytes(),))
            number += 1
        if number:
            self.blocks.update((number,))
        return number

    def _held(self) -> pd.DataFrame | None:
        """The waiting rows, as they came."""
        number = self.blocks.get()[0] if self.blocks.exists() else 0
        if not number:
            return None
        table = pa.concat_tables(pa.ipc.open_stream(bytes(self.waiting.getValue((k,))[0])).read_all() for k in range(number))
        return pd.DataFrame({name: pd.Series(table.column(name).to_pylist(), dtype=object) for name in self.rows.names})

    def _advance(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        heard = self.heard.get()[0] if self.heard.exists() else None
        held = self._held()
        done, left = [], 0
        if held is not None:
            us = held["us"].to_numpy(np.int64)
            ready = us <= watermark_ms * 1000
            left = int((~ready).sum())
            if ready.any():
                now = held[ready].sort_values(["us", "seq"], kind="stable")
                self.waiting.clear()
                self.blocks.clear()
                if left:
                    self._store(held[~ready], 0)
                us = now["us"].to_numpy(np.int64)
                gaps = np.flatnonzero(np.diff(us, prepend=us[0] if heard is None else heard) > self.silence_us)
                for low, high in zip([0, *gaps], [*gaps, len(now)], strict=True):
                    if low in gaps:
                        done += self.end()
                    if high > low:
                        done += self.fold(now.iloc[low:high])
                heard = int(us[-1])
                self.heard.update((heard,))
        if not left and heard is not None and watermark_ms * 1000 > heard + self.silence_us:
            done += self.end()
            self.heard.clear()
            heard = None
        self._wake(heard, held["us"].to_numpy(np.int64) if left else None, watermark_ms)
        if done:
            table = pd.DataFrame(done, columns=[name for name in self.out.names if name not in self.keys()], dtype=object)
            table = table.where(table.notna(), None).assign(**dict(zip(self.keys(), key, strict=True)))
            yield table[self.out.names]

    def keys(self) -> list[str]:
        return ["host"]

    def _wake(self, heard: int | None, waiting: np.ndarray | None, watermark_ms: int) -> None:
        """One timer: when the next waiting row is passed, or when silence ends the key."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at = None
        if waiting is not None:
            at = -(-int(waiting[waiting > watermark_ms * 1000].min()) // 1000)
        elif heard is not None:
            at = (heard + self.silence_us) // 1000 + 1
        if at is not None:
            self.handle.registerTimer(max(at, watermark_ms + 1))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    """Run a processor over a stream with ``ts``, the key columns and the processor's row columns."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = rows.withWatermark("ts", delay).groupBy(*processor.keys())
    return kept.transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode="append", timeMode="eventTime")


def keyed(rows: DataFrame, key: str = "host") -> DataFrame:
    """A missing key is one key without a name."""
    return rows.withColumn(key, F.coalesce(key, F.lit("")))
