"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``room`` tokens; only longer documents are cut. The pieces are counted by length,
a table of at most ``room`` rows however many documents there are. For each bin, bitset subset-sum dynamic
programming over the lengths still available finds the fullest feasible combination that holds the longest of them;
the combination is taken out as often as the counts allow. Pieces then find their place by their rank among the
pieces of their length; ranks are counted in salted groups, more of them the more pieces there are, so that no length
is numbered in one task.

Defined results: a null or empty text is its end token alone; repeated rows are packed each (rows of one or no doc_id
change places with each other at will, which changes no bin); an empty table gives no rows; extra columns are ignored
by ``pack_documents`` and kept by ``pack``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, written
from .tokens import REMEMBERED, default_path, encoder

ROOM = 4096
#: Pieces of one length that are numbered in one group, about.
NUMBERED = 250_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room; of equal ones the longest pieces first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, some = min(counts[length], room // length), 1
        while left:
            n = min(some, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, some = left - n, some * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return used


def patterns(counts: dict[int, int], room: int = ROOM) -> list[tuple[dict[int, int], int]]:
    """(combination, how often) until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest({k: v for k, v in left.items() if v}, room - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def places(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset), by length and first rank."""
    rows, ranks, base = [], {}, 0
    for used, times in found:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, ranks.get(length, 0), used[length], base, offset))
            ranks[length] = ranks.get(length, 0) + used[length] * times
            offset += length * used[length]
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, room: int = ROOM, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (order columns, length from 1 to room, any others) with sequence_id and offset.

    pieces is read twice: give a written table. Its columns may have any names but those two.
    """
    spark = pieces.sparkSession
    free = lambda name: name if name not in pieces.columns else free(f"_{name}")
    salt, rank, n, before = map(free, ("_salt", "_rank", "_n", "_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    table = places(patterns(counts, room))
    columns = pieces.columns
    salts = 64 + max(counts.values(), default=0) // NUMBERED
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", salt).agg(F.count("*").alias(n))  # at most room x salts rows
    by_salt = by_salt.select("length", salt, (F.sum(n).over(Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(before))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
    ranked = ranked.join(by_salt, ["length", salt]).withColumn(rank, F.col(rank) - 1 + F.col(before)).select(*columns, rank)
    shared = spark.sparkContext.broadcast(table)  # at most room lengths x 90 different lengths in a bin

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = shared.value
        length, place = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64), b.column(rank).to_numpy(zero_copy_only=False)
        i = np.searchsorted((t[:, 0] << 48) + t[:, 1], (length << 48) + place, side="right") - 1
        nth, copies = place - t[i, 1], t[i, 2]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(t[i, 3] + nth // copies), pa.array(t[i, 4] + nth % copies * length)], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return by_batch(ranked, run, f"{fields}, sequence_id long, offset long")


def token_pieces(documents: DataFrame, tokenizer: str | None = None, end: int = 1, room: int = ROOM, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, where asked for, ids (little-endian 16-bit)."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows, kept = encoder(path, "words", remembered), [], []
        stop = np.array([end], "<u2").tobytes()
        for doc_id, data in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text")), strict=True):
            ids = np.frombuffer(data + stop, "<u2")
            for k in range(0, len(ids), room):
                cut = ids[k : k + room]
                rows.append((doc_id, k // room, k, len(cut), zlib.crc32(cut.astype("<u4").tobytes())))
                if keep_ids:
                    kept.append(cut.tobytes())
        doc, piece, start, length, crc = zip(*rows, strict=True)
        arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if keep_ids else arrays, [*names, "ids"] if keep_ids else names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return by_batch(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, schema, caches=True)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, end: int = 1, room: int = ROOM, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(written(token_pieces(documents, tokenizer, end, room, keep_ids, remembered), "pieces"), room)
