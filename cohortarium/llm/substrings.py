"""Substring dedup by compacted paths of the de Bruijn graph of token k-mers.

The graph's edges are the windows of WIDTH consecutive words. Only edges that can repeat are kept: a window's seed is
the smallest hash among the SEED-word sequences in it, equal windows have equal seeds, and a seed that occurs in one
document only rules its windows out. Edges that follow each other and share a seed form a path without a branch
between two nodes that the words themselves define; it is compacted into one piece, known by a hash of its whole
sequence and by its seed. Joins of the pieces find, for each, its source: the smallest document that has it. A copy
of a piece is covered from end to end. Pieces that differ share edges only if they share their seed (a passage that
begins or ends inside them): there, the edges are joined one by one with the smallest document that has them. Neighbouring
covered edges become spans of source coordinates, and the words are taken out of the texts.

Pieces and edges are known by two independent 64-bit hashes each (of the whole sequence, and the seed); texts that differ
in a window are taken as equal there only if both collide.

Defined results: a null or empty text has no words; a text of fewer words than a window keeps all; repeated rows of
one doc_id are texts of one document; a document with a null id removes nothing and nothing of it is removed; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, hash_words, sliding_min, window_hashes, word_lists, written
from .membership import among, bits_of, with_bits

WIDTH, SEED = 13, 7


def seeds_of(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The seed of every window."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    return sliding_min(window_hashes(words, seed), width - seed + 1)


def _docs(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def repeated_seeds(documents: DataFrame, width: int, seed: int) -> DataFrame:
    """seed: those that occur in two documents or more."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found, owners = [], []
        for doc_id, words in zip(b.column("doc_id").to_pylist(), word_lists(b.column("text")), strict=True):
            s = np.unique(seeds_of(hash_words(words), width, seed)) if len(words) >= width else []
            if len(s):
                found.append(s)
                owners.append(np.full(len(s), doc_id, np.int64))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else none), pa.array(np.concatenate(owners) if owners else none)], ["seed", "doc_id"])

    rows = by_batch(_docs(documents).filter("doc_id is not null"), run, "seed long, doc_id long")
    return rows.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("seed")


def pieces(documents: DataFrame, seeds: DataFrame, width: int, seed: int) -> DataFrame:
    """Compacted paths whose seed may repeat: doc_id, text_key, start, piece (hash of the sequence), seed, edges."""
    shared = documents.sparkSession.sparkContext.broadcast(bits_of(seeds, "seed"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        import xxhash

        bitmap = shared.value
        docs, keys, starts, found, seeds, edges = [], [], [], [], [], []
        for doc_id, words in zip(b.column("doc_id").to_pylist(), word_lists(b.column("text")), strict=True):
            if len(words) < width:
                continue
            h = hash_words(words)
            s = seeds_of(h, width, seed)
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            known = among(bitmap, pa.array(s[first].view(np.int64)))
            if not known.any():
                continue
            edge = window_hashes(h, width)
            key = text_key(h)
            for a, z in zip(first[known].tolist(), np.append(first[1:], len(s))[known].tolist(), strict=True):
                docs.append(doc_id)
                keys.append(key)
                starts.append(a)
                found.append(xxhash.xxh64_intdigest(edge[a:z].tobytes()))
                edges.append(edge[a:z].view(np.int64))
            seeds.append(s[first[known]])
        if not docs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(np.concatenate(seeds).view(np.int64)), pa.array(edges, pa.list_(pa.int64()))], ["doc_id", "text_key", "start", "piece", "seed", "edges"])

    return by_batch(_docs(documents).filter("doc_id is not null"), run, "doc_id long, text_key long, start int, piece long, seed long, edges array<long>")


def text_key(words: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63)


def covered(documents: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Runs of windows that a smaller document has too: doc_id, text_key, start, n_windows, source_doc.

    start is the first window's first word; the words covered are those from start to start + n_windows + width - 2.
    """
    seeds = written(repeated_seeds(documents, width, seed), "seeds")
    all_pieces = written(pieces(documents, seeds, width, seed), "pieces")
    key = ["piece", "seed"]
    places = all_pieces.select("doc_id", "text_key", "start", F.size("edges").alias("n_windows"), *key)
    sources = written(all_pieces.groupBy(*key).agg(F.min("doc_id").alias("source_doc"), F.max("doc_id").alias("last")), "sources")
    copies = places.join(sources.filter("source_doc != last").select(*key, "source_doc"), key)
    whole = copies.filter("doc_id > source_doc").select("doc_id", "text_key", "start", "n_windows", "source_doc")
    # different pieces of one seed, at their sources
    several = written(sources.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "several")
    own = with_bits(all_pieces, "seed", several, "seed").join(several, "seed", "left_semi")
    own = own.join(sources.select(*key, F.col("source_doc").alias("doc_id")), [*key, "doc_id"], "left_semi").select("doc_id", "text_key", "start", "seed", "edges")
    edges = written(own.select("doc_id", "text_key", "start", "seed", F.posexplode("edges").alias("i", "edge")).select("doc_id", "text_key", (F.col("start") + F.col("i")).alias("start"), "edge", "seed"), "edges")
    least = written(edges.groupBy("edge", "seed").agg(F.min("doc_id").alias("source_doc"), F.max("doc_id").alias("last")).filter("source_doc != last").select("edge", "seed", "source_doc"), "least")
    partly = with_bits(edges, "edge", least, "edge").join(least, ["edge", "seed"]).filter("doc_id > source_doc").select("doc_id", "text_key", "start", F.lit(1).alias("n_windows"), "source_doc")
    return whole.unionByName(partly)


def spans(documents: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Per text with repeats: doc_id, text_key, spans (array of start, end in words, end exclusive, and the smallest source)."""
    runs = covered(documents, width, seed).select("doc_id", "text_key", F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n_windows") + (width - 1)).alias("end"), "source_doc").alias("s"))
    return runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def deduplicated(documents: DataFrame, width: int = WIDTH, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, where asked for, text (kept words joined by spaces)."""
    found = written(spans(documents, width, seed), "spans")
    touched = found.select("doc_id").distinct()
    shared = documents.sparkSession.sparkContext.broadcast(bits_of(touched, "doc_id"))
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def result(ids: list, texts: Iterator[list[bytes]], gone: list) -> pa.RecordBatch:
        rows = []
        for doc_id, words, cut in zip(ids, texts, gone, strict=True):
            kept = words
            if cut:
                edge = np.zeros(len(words) + 1, np.int32)
                for s in cut:
                    edge[s["start"]] += 1
                    edge[s["end"]] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            said = b" ".join(kept)
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(said).hexdigest(), *([said.decode()] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]
        columns = list(zip(*rows, strict=True)) or [()] * (4 + keep_text)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=False)], names[: len(columns)])

    def split(inside: bool):
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            is_in = among(shared.value, b.column("doc_id")) & np.array(b.column("doc_id").is_valid())
            return b.filter(pa.array(is_in == inside))

        return run

    def untouched(b: pa.RecordBatch) -> pa.RecordBatch:
        b = split(False)(b)
        return result(b.column("doc_id").to_pylist(), word_lists(b.column("text")), [None] * b.num_rows)

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        b = split(True)(b)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([text_key(hash_words(w)) for w in word_lists(b.column("text"))], pa.int64())], ["doc_id", "text", "text_key"])

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        return result(b.column("doc_id").to_pylist(), word_lists(b.column("text")), b.column("spans").to_pylist())

    rest = by_batch(_docs(documents), untouched, fields)
    some = by_batch(_docs(documents), keyed, "doc_id long, text string, text_key long").join(found, ["doc_id", "text_key"], "left")
    return rest.unionByName(by_batch(some.select("doc_id", "text", "spans"), cut, fields))
