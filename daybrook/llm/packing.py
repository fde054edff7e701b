"""Packing of token streams into windows of several context sizes.

A document gives its whole longest windows first.  What is left of it goes to the tier of the smallest
window that takes it.  From the longest tier down, remainders open windows of their tier; from the
shortest tier up, remainders fill the gaps that those windows leave, cut where a gap ends.  Both lists
are lines of tokens (running sums over the one order of remainders), so the pieces that fill gaps are
the overlaps of two sets of intervals, found block by block of the line.  The lists meet where the
gaps so far take all that is still to come; the remainder there is cut so that the gaps before it are
full, and only the window that it opens can stay short of its tier.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybrook.llm import tokenizing, words
from daybrook.llm.token_files import _array, _place
from daybrook.operators import numbering
from daybrook.session import materialize

END, TIERS = 2, (512, 1024, 2048, 4096)
#: Tokens of a block of the line of gaps, and of a training step.
BLOCK, STEP_TOKENS = 1 << 18, 1 << 18
#: Bytes of text that are looked up together.
SLICE_BYTES = 8 << 20
_ENTRY = "doc_id long, doc_tokens long, file string, at long, doc_crc long"


def _writer(tokenizer: str, folder: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = tokenizing.narrowest(tokenizer, end)
        encode, close = tokenizing.word_encoder(tokenizer, width), end.to_bytes(width, "little")
        name, total = f"{uuid.uuid4().hex}.{width}", 0
        store, where = _place(folder)
        with store.open_output_stream(f"{where}/{name}") as ids:
            for batch in batches:
                _, offsets = words.buffers(batch.column("text"))
                for first, last in words.slices(offsets, SLICE_BYTES):
                    own = [one + close for one in encode(batch.column("text").slice(first, last - first).to_pylist())]
                    ids.write(b"".join(own))
                    sizes = np.array([len(one) // width for one in own])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array([name] * len(own)),
                         pa.array(total + np.cumsum(sizes) - sizes), pa.array([zlib.crc32(one) for one in own], pa.int64())],
                        names=["doc_id", "doc_tokens", "file", "at", "doc_crc"])
                    total += int(sizes.sum())
    return write


def encode(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write the ids of all documents below ``folder``; ``(doc_id, doc_tokens, file, at, doc_crc)`` per document.

    A task writes one flat file; its name is new on every attempt and only files of finished tasks
    are in the table that is returned.
    """
    store, where = _place(folder)
    store.create_dir(where, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_writer(tokenizer, folder, end), _ENTRY), "encoded")


def _tier(rest: Column, tiers: tuple[int, ...]) -> Column:
    found = F.lit(0)
    for size in sorted(tiers, reverse=True):
        found = F.when((rest > 0) & (rest <= size), size).otherwise(found)
    return found


def plan(entries: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``(file, at, doc_id, doc_tokens, start, length, sequence_id, offset, tier, step)`` per piece, from lengths alone.

    Sequences of every tier are dealt to the steps in turn, so steps differ by at most one
    sequence of each tier in what they hold.
    """
    longest = max(tiers)
    rest = F.col("doc_tokens") % longest
    rows = entries.withColumns({"rest": rest, "tier": _tier(rest, tiers), "whole": F.floor(F.col("doc_tokens") / longest)})
    gap, has = F.col("tier") - F.col("rest"), (F.col("tier") > 0).cast("long")
    order = [F.desc("tier"), F.col("doc_id"), F.col("doc_tokens"), F.col("doc_crc"), F.col("file"), F.col("at")]
    rows = materialize(numbering.before(rows, order, {"gaps": gap, "rests": F.col("rest"), "wholes": F.col("whole"), "opened": has}), "placed")
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("rest", "rest"), ("tokens", "doc_tokens")))).first()
    opens = (F.col("tier") > 0) & (F.col("gaps") < F.lit(total["rest"]) - F.col("rests"))
    rows = rows.withColumn("opens", opens)
    met = rows.agg(
        F.count(F.when(F.col("opens"), 1)).alias("windows"), F.coalesce(F.max(F.when(F.col("opens"), F.col("gaps"))), F.lit(0)).alias("before_last"),
        F.coalesce(F.sum(F.when(~F.col("opens"), F.col("rest"))), F.lit(0)).alias("rest")).first()
    # what the last window gives away so that the gaps before it are full
    given, fill = max(0, met["before_last"] - met["rest"]), max(met["rest"], met["before_last"])
    rows = rows.withColumn("given", F.when(F.col("opens") & (F.col("opened") == met["windows"] - 1), F.lit(given)).otherwise(0).cast("long"))
    steps = max(1, -(-total["tokens"] // step_tokens))
    first_id = F.col("wholes") + F.least("opened", F.lit(met["windows"]))
    own = rows.where("whole > 0 or opens").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + F.col("opens").cast("long") - 1)))
    last, left = F.col("i") == F.col("whole"), F.col("rest") - F.col("given")
    piece = ("file", "at", "doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "tier", "step")
    own = own.withColumns({
        "start": F.col("i") * longest + F.when(last, F.col("given")).otherwise(0), "length": F.when(last, left).otherwise(longest),
        "sequence_id": first_id + F.col("i"), "offset": F.lit(0).cast("long"), "tier": F.when(last, _tier(left, tiers)).otherwise(longest),
        "step": F.when(last, F.col("opened")).otherwise(F.col("wholes") + F.col("i")) % steps}).select(*piece)
    gaps = rows.where(F.col("opens") & (gap > 0) & (F.col("gaps") < fill)).select(
        F.col("gaps").alias("low"), F.least(F.col("gaps") + gap, F.lit(fill)).alias("high"),
        F.struct((first_id + F.col("whole")).alias("sequence_id"), (F.col("rest") - F.col("gaps")).alias("shift"), "tier",
                 (F.col("opened") % steps).alias("step")).alias("gap"))
    low = F.when(F.col("opens"), F.lit(met["rest"])).otherwise(F.lit(total["rest"]) - F.col("rests") - F.col("rest"))
    fills = rows.where("tier > 0 and (not opens or given > 0)").select(
        low.alias("low"), (low + F.when(F.col("opens"), F.col("given")).otherwise(F.col("rest"))).alias("high"),
        F.struct("file", "at", "doc_id", "doc_tokens", (F.col("whole") * longest - low).alias("shift")).alias("fill"))
    line = gaps.withColumn("fill", F.lit(None).cast(fills.schema["fill"].dataType)).unionByName(fills.withColumn("gap", F.lit(None).cast(gaps.schema["gap"].dataType)))
    line = line.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))))
    line = line.withColumn("edge", F.least((F.col("block") + 1) * BLOCK, F.lit(fill))).withColumn("low", F.greatest("low", F.col("block") * BLOCK))
    inside = Window.partitionBy("block").orderBy("low")
    cut = line.select(
        "low", (F.coalesce(F.lead("low").over(inside), F.col("edge")) - F.col("low")).alias("length"),
        F.last("gap", True).over(inside).alias("gap"), F.last("fill", True).over(inside).alias("fill")).where("length > 0")
    filled = cut.select("fill.file", "fill.at", "fill.doc_id", "fill.doc_tokens", (F.col("low") + F.col("fill.shift")).alias("start"), "length",
                        "gap.sequence_id", (F.col("low") + F.col("gap.shift")).alias("offset"), "gap.tier", "gap.step")
    return own.unionByName(filled)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _place(folder)
        name, ids = None, None
        for batch in batches:
            files, ats, starts, sizes = (batch.column(c).to_pylist() for c in ("file", "at", "start", "length"))
            sums = []
            for file, at, start, size in zip(files, ats, starts, sizes, strict=True):
                if file != name:
                    name, ids = file, _array(store, f"{where}/{file}", f"<u{file.rsplit('.', 1)[1]}")
                sums.append(zlib.crc32(ids[at + start:at + start + size].astype("<u4").tobytes()))
            kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])
    return read


def pack(docs: DataFrame, tokenizer: str, folder: str, end: int = END, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, sequence_id, offset, tier, step, ids_crc32)`` per piece.

    Null text is empty, and an empty document has its end id.  Rows without an id and repeated rows are
    documents of their own.  An empty table gives no pieces.
    """
    pieces = plan(encode(docs, tokenizer, folder, end), tiers, step_tokens)
    pieces = pieces.repartition("file").sortWithinPartitions("file", "at", "start")
    return pieces.mapInArrow(_reader(folder), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step long, ids_crc32 long")
