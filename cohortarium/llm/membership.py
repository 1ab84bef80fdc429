"""Bitmaps of a bounded size that tell a scan which keys a join may want.

A bitmap only spares rows a shuffle: what it lets through wrongly the join after it drops, and it never stops a key
that it was made from. So results don't depend on its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, mixed, written

#: Bits for each value, about; bits of a bitmap, at least and at most (32 MB); and the parts that tasks give it in.
BITS_A_VALUE, LEAST_BITS, MOST_BITS, CHUNKS = 12, 1 << 16, 1 << 28, 64


def bits_of(rows: DataFrame, column: str) -> bytes:
    """A bitmap with those bits set that the values of a long column hash to; its size follows the number of rows.

    rows is read twice: give a written table.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_VALUE * rows.count()).bit_length()))
    width = bits // CHUNKS

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(bit_places(b.column(0), bits))
        return pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], ["chunk", "at"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at = (c.to_numpy() for c in b.columns)
            for k in np.unique(chunk).tolist():
                found.setdefault(k, np.zeros(width, bool))[at[chunk == k]] = True
        for k, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    places = by_batch(rows.select(column), place, "chunk int, at int")
    for r in places.repartition("chunk").mapInArrow(part, "chunk int, bits binary").collect():  # CHUNKS rows, MOST_BITS at most
        out[r["chunk"] * width // 8 : (r["chunk"] + 1) * width // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def bit_places(values: pa.Array, bits: int) -> np.ndarray:
    return (mixed(values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def among(bitmap: bytes, values: pa.Array) -> np.ndarray:
    """Whether each value may be one of those that the bitmap was made from."""
    bits = np.frombuffer(bitmap, np.uint8)
    places = bit_places(values, 8 * len(bits))
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def with_bits(rows: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """The rows whose value may be among values (a written table): a filter before a join, of a bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast(bits_of(values, name))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(among(shared.value, b.column(column))))

    return by_batch(rows, run, rows.schema)


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids (doc_id, distinct)."""
    return with_bits(rows, "doc_id", ids, "doc_id").join(ids, "doc_id", "left_semi").select(rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is null or not in ids (doc_id, distinct); most never leave their scan."""
    shared = rows.sparkSession.sparkContext.broadcast(bits_of(ids, "doc_id"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(~among(shared.value, b.column("doc_id"))))

    some = with_bits(rows, "doc_id", ids, "doc_id").join(ids, "doc_id", "left_anti").select(rows.columns)
    return by_batch(rows, run, rows.schema).unionByName(some)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id go, all but one (the one of the smallest row hash); only such ids are shuffled."""
    twice = written(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return rows
    place = F.xxhash64(*rows.columns)
    first = only_ids(rows, twice).groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), place).alias("r")).select("r.*")
    return without_ids(rows, twice).unionByName(first.select(rows.columns))
