"""Token ids in flat binary files: unsigned ids of 16 or 32 bits, 64-bit document offsets, bases from prefix sums."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybrook.llm import tokenizing, words
from daybrook.session import materialize

#: Id that ends a document, and what the id file holds for a row without an id.
END, NO_ID = 0, -(1 << 63)
_MANIFEST = "shard int, file string, n_docs long, n_tokens long, width int"


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def _array(store: pa.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The numbers of a file: mapped into memory where the file system is local, read otherwise."""
    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def _writer(tokenizer: str, folder: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        width = tokenizing.narrowest(tokenizer, end)
        encode, close = tokenizing.encoder(tokenizer, width), end.to_bytes(width, "little")
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, where = _place(folder)
        docs, total = 0, 0
        with store.open_output_stream(f"{where}/{name}.bin") as ids, store.open_output_stream(f"{where}/{name}.off") as ends, \
                store.open_output_stream(f"{where}/{name}.doc") as names:
            for batch in batches:
                _, offsets = words.buffers(batch.column("text"))
                names.write(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for first, last in words.slices(offsets):
                    own = list(encode(batch.column("text").slice(first, last - first).to_pylist()))
                    ids.write(close.join([*own, b""]))
                    sizes = [len(x) // width + 1 for x in own]
                    at = total + np.concatenate([[0], np.cumsum(sizes)])
                    ends.write(at[:-1].astype("<u8").tobytes())
                    docs, total = docs + len(sizes), int(at[-1])
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([docs]), pa.array([total]), pa.array([width], pa.int32())],
                names=["shard", "file", "n_docs", "n_tokens", "width"])
    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write ``docs`` in ascending id order below ``folder``; ``(shard, file, n_docs, n_tokens, width, base)`` per file.

    Every task of a range-partitioned sort writes three files of its own: ids (``.bin``), the
    offset of each document in them (``.off``) and document ids (``.doc``).
    An id takes two bytes (``width``) if the vocabulary has no larger ones, else four.  File names are new
    on every attempt and only those of finished tasks are in the manifest, so a task may be
    repeated.  The base of a file is the prefix sum of the tokens before it; the sum runs over one
    row a file.  Rows without an id come first; equal ids are ordered by a hash of the text.
    """
    store, where = _place(folder)
    store.create_dir(where, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = materialize(ordered.mapInArrow(_writer(tokenizer, folder, end), _MANIFEST), "manifest")
    listed = shards.orderBy("shard").collect()
    bases = accumulate((row["n_tokens"] for row in listed), initial=0)
    table = [(*row, base) for row, base in zip(listed, bases, strict=False)]
    return docs.sparkSession.createDataFrame(table, _MANIFEST + ", base long")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _place(folder)
        for row in (row for batch in batches for row in batch.to_pylist()):
            ids, starts, names = (_array(store, f"{where}/{row['file']}.{kind}", code) for kind, code in (("bin", f"<u{row['width']}"), ("off", "<u8"), ("doc", "<i8")))
            ends = np.append(starts[1:], len(ids)).astype(np.int64)
            for first in range(0, len(starts), 4096):
                low, high = starts[first:first + 4096].astype(np.int64), ends[first:first + 4096]
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(low, high, strict=True)]
                own = names[first:first + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=own == NO_ID), pa.array(low + row["base"]), pa.array(high - low), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files; one task reads one file at a time."""
    files = max(1, manifest.count())
    return manifest.repartition(files, "file").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
