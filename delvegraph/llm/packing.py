"""Concatenate-and-cut packing of token streams into fixed windows.

First pass: every partition encodes its documents, writes them with their place
in the partition's own stream, and so gives one token total.  The prefix sums of
those totals place every partition in the global stream.  Second pass: the
stream is cut every ``length`` tokens; a document that crosses a cut leaves one
boundary record (piece) on each side.  Only the last window needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.llm.encoding import default_path, encoder
from delvegraph.llm.storage import materialize
from delvegraph.llm.textkit import slices
from delvegraph.llm.worker import tidy

END_ID = 2


def encoded_stream(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: doc_id, part, local_start, n, ids (little-endian, packed).

    ``ids`` holds the document's ids and then ``end_id``; null and empty texts have
    that id only.  Rows of equal ids are documents of their own, an empty table gives
    an empty one, and other columns are not read.
    """
    path = path or default_path()

    @tidy("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            packed = [x + end for x in enc.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // enc.width for x in packed], dtype=np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start), pa.array(n), pa.array(packed, pa.binary())],
                names=["doc_id", "part", "local_start", "n", "ids"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, part int, local_start long, n long, ids binary"), "token-stream")


def pack(docs: DataFrame, length: int = 4096, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset.

    Every document has at least the end id, so each input row gives a piece; an
    empty table gives an empty result.  Rows with equal ids are documents of
    their own.
    """
    path = path or default_path()
    stream = encoded_stream(docs, path, end_id, id_col, text_col)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stream.groupBy("part").agg(F.sum("n").alias("tokens"))  # one row for each partition
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    placed = stream.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("at"), "n", "ids")

    @tidy("tokens")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in (part for whole in batches for part in slices(whole, "ids", 2 << 20)):
            rows: list[tuple] = []
            ids32: list[bytes] = []
            for row, (at, n, packed) in enumerate(zip(batch["at"].to_pylist(), batch["n"].to_pylist(), batch["ids"].to_pylist(), strict=True)):
                raw = np.frombuffer(packed, dtype=dtype).astype("<u4").tobytes()
                a = 0
                while a < n:
                    sequence, offset = divmod(at + a, length)
                    b = min(n, a + length - offset)
                    piece = raw[4 * a : 4 * b]
                    ids32.append(piece)
                    rows.append((row, a, b - a, zlib.crc32(piece), n, sequence, offset))
                    a = b
            cols = np.array(rows, dtype=np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2]), pa.array(ids32, pa.binary()), *(pa.array(c) for c in cols[3:])],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, f"doc_id {dict(placed.dtypes)['doc_id']}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
