"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections of sorted arrays.

Documents with equal sets of shingles form a class; the rest works on one document a class. A set is ordered by how
often its shingles occur anywhere (hashed counts over all documents) and then by hash; by prefix filtering, two sets
that link share a shingle among the first n - ceil(t n) + 1 of each. Such a shingle is a tile. First, all documents
of a tile meet the tile's smallest id only; verified links make clusters. Tiles that still hold several clusters are
split by size band (sizes of linked sets lie in one band or in neighbouring ones) and into blocks; there, documents of
different clusters meet. Of every pair met, hashed bitmaps bound the overlap from above; what remains is decided by
intersecting the sorted sets. No pair of different clusters that share a tile goes unseen, and pairs inside a
cluster are linked already, so the components are exact.

Defined results: a null, empty or white text has no shingle and links with nothing; with fewer words than a shingle
has, the sequence of all words is the one shingle; repeated rows of one id are united by it; documents with a null id
are dropped by no step but are a class of their own kind (null component); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, fresh, hash_words, mixed, shrink_executors, small_batches, tidy, window_hashes, written
from .components import components
from .membership import one_row_an_id, only_ids, without_ids

#: Hashed counters that order shingles, and their parts.
COUNTERS, CHUNKS = 1 << 20, 64
#: Size bands between a size and the largest that it can link with.
BANDS = 4
#: Documents of a tile that is looked at in one row.
SMALL = 64
#: Documents of one block of a larger tile, about; a task compares two blocks.
BLOCK = 512


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-case words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(h) < width:
        return mixed(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, width))


def lower_words(column: pa.Array) -> Iterator[list[bytes]]:
    """word_lists, with A-Z in lower case."""
    for x in column.cast(pa.binary()).to_pylist():
        yield x.lower().split() if x else []


def _docs(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def bitmap(shingles: np.ndarray) -> bytes:
    bits = min(1 << 14, max(256, 1 << (2 * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(x: int, bits: int, to: int) -> int:
    """A bitmap of fewer bits: its parts laid over each other."""
    while bits > to:
        bits //= 2
        x = (x & ((1 << bits) - 1)) | (x >> bits)
    return x


def may_link(n: int, x: int, x_bits: int, m: int, y: int, y_bits: int, percent: int) -> bool:
    """False only if the sets can't link: every bit of one that the other lacks is a shingle that they don't share."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    if x_bits != y_bits:
        bits = min(x_bits, y_bits)
        x, y = folded(x, x_bits, bits), folded(y, y_bits, bits)
    both = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return 100 * both >= percent * (n + m - both)


def sets_and_counts(documents: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, key) and rows of hashed shingle counts (chunk, counts)."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fresh()
        counts = np.zeros(COUNTERS, np.int64)
        names = ["doc_id", "n", "key", "chunk", "counts"]
        for b in batches:
            n, keys, seen = [], [], []
            for words in lower_words(b.column("text")):
                s = shingle_hashes(words, width)
                seen.append((s & np.uint64(COUNTERS - 1)).astype(np.int64))
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            counts += np.bincount(np.concatenate(seen), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if counts.any():
            parts = counts.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return _docs(documents).mapInArrow(tidy(run), "doc_id long, n long, key binary, chunk int, counts binary")


def summed(rows: DataFrame) -> np.ndarray:
    """The counts of all tasks, COUNTERS numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for r in rows.select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():  # CHUNKS rows
        out[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(-1)


def prefixes(documents: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Per document with shingles: doc_id, n, tokens (its prefix), bits (its bitmap)."""
    shared = documents.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        often = shared.value
        for b in batches:
            ids, n, tokens, bits = [], [], [], []
            for doc_id, words in zip(b.column("doc_id").to_pylist(), lower_words(b.column("text")), strict=True):
                s = shingle_hashes(words, width)
                if not len(s):
                    continue
                first = len(s) - -(-percent * len(s) // 100) + 1
                order = np.argsort(often[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:first]
                ids.append(doc_id)
                n.append(len(s))
                tokens.append(s[order].view(np.int64))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n", "tokens", "bits"])

    return _docs(documents).mapInArrow(tidy(run), "doc_id long, n long, tokens array<long>, bits binary")


def bounded_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps in sets (doc_id, n, bits) don't rule out."""
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for n, x, m, y in zip(*(b.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True):
            keep.append(may_link(n, int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y), percent))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return by_batch(joined.select("a", "n_a", "bits_a", "b", "n_b", "bits_b"), run, "a long, b long")


def verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sorted sets link: 100 x intersection >= percent x union."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_hashes(w, width).tobytes() for w in lower_words(b.column("text"))], pa.binary())], ["doc_id", "shingles"])

    sets = written(only_ids(_docs(documents).filter("doc_id is not null"), ids).mapInArrow(tidy(make), "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return by_batch(joined.select("a", "b", "x", "y"), run, "a long, b long")


def small_tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs as tile_pairs gives them, but for the bitmaps, of tiles of SMALL documents or fewer, each in one row by size."""
    rows = tiles.groupBy("token", "leader").agg(F.sort_array(F.collect_list(F.struct("n", "doc_id", "cluster"))).alias("d"))
    apart = lambda x, y: (x["cluster"] != y["cluster"]) & (100 * x["n"] >= percent * y["n"]) & (x["doc_id"] != F.col("leader")) & (y["doc_id"] != F.col("leader"))
    pair = lambda x, y: F.struct(F.least(x["doc_id"], y["doc_id"]).alias("a"), F.greatest(x["doc_id"], y["doc_id"]).alias("b"))
    met = F.transform("d", lambda x, i: F.transform(F.filter(F.slice("d", i + 2, F.size("d")), lambda y: apart(x, y)), lambda y: pair(x, y)))
    return rows.select(F.explode(F.flatten(met)).alias("p")).select("p.a", "p.b").distinct()


def tile_pairs(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different clusters that share a tile and that sizes and bitmaps don't rule out.

    tiles: token, doc_id, n, cluster, leader, in_tile (documents of the tile).
    """
    # sizes of linked sets differ by 100 / percent at most, so their bands by BANDS at most; the slack outweighs rounding
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.0001) * BANDS).cast("long")
    rows = tiles.withColumn("band", band).withColumn("blocks", F.ceil(F.col("in_tile") / BLOCK).cast("int"))
    # a band meets itself and the next larger ones, whose documents are its guests
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS))).alias("guest")).withColumn("band", F.col("band") - F.col("guest"))
    # bands of a tile in which nobody of another cluster can be met go before anything is dealt out
    met = rows.groupBy("token", "band").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("guest").alias("host")).filter("lo != hi and host = 0")
    rows = rows.join(met.select("token", "band"), ["token", "band"])
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # hosts stand in row "mine", guests in column "mine"; hosts also stand in columns, to meet each other once
    host = rows.filter("guest = 0").select("token", "band", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(0).alias("role"), "doc_id", "cluster", "leader")
    column = rows.select("token", "band", F.col("other").alias("i"), F.col("mine").alias("j"), F.when(F.col("guest") > 0, 2).otherwise(1).alias("role"), "doc_id", "cluster", "leader")
    met = host.unionByName(column).join(sets.select("doc_id", "n", "bits"), "doc_id")
    small_batches(tiles.sparkSession)

    def pairs_of(group: list[tuple]) -> Iterator[tuple[int, int]]:
        """Every host against all others of the block at once."""
        if not group or all(r[0] for r in group) or all(r[0] == 0 for r in group):
            return
        bits = min(8 * len(r[5]) for r in group)
        words = np.array([np.bitwise_or.reduce(np.frombuffer(r[5], np.uint64).reshape(-1, bits // 64), axis=0) for r in group])
        role, doc, cluster, leader, n = (np.array([r[k] for r in group], np.int64) for k in range(5))
        others = np.flatnonzero(role > 0)
        for h in np.flatnonzero(role == 0):
            if doc[h] == leader[h]:
                continue
            m = n[others]
            near = (cluster[others] != cluster[h]) & ((role[others] == 2) | (doc[others] > doc[h])) & (doc[others] != leader[others]) & (100 * np.minimum(m, n[h]) >= percent * np.maximum(m, n[h]))
            at = others[near]
            if not len(at):
                continue
            mine, theirs = words[h], words[at]
            both = np.minimum(n[h] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[at] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            for other in doc[at[100 * both >= percent * (n[h] + n[at] - both)]].tolist():
                yield (int(doc[h]), other) if doc[h] < other else (other, int(doc[h]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("token", "band", "i", "j", "role", "doc_id", "cluster", "leader", "n", "bits")]
            for token, band, i, j, role, doc, cluster, leader, n, bits in zip(*cols, strict=True):
                if (token, band, i, j) != now:
                    out += pairs_of(group)
                    now, group = (token, band, i, j), []
                group.append((role, doc, cluster, leader, n, bits))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        out += pairs_of(group)
        if out:
            yield _pairs(out)

    key = ["token", "band", "i", "j"]
    return met.repartition(*key).sortWithinPartitions(*key).select(*key, "role", "doc_id", "cluster", "leader", "n", "bits").mapInArrow(tidy(run), "a long, b long").distinct()


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    found = written(sets_and_counts(documents, width), "classes")
    classes = found.filter("chunk is null").select("doc_id", "n", "key")
    counts = summed(found.filter("chunk is not null"))
    firsts = classes.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    firsts = written(firsts, "firsts")
    sets = prefixes(documents, counts, width, percent).join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(sets, "prefixes")
    tokens = sets.select(F.explode("tokens").alias("token"), "doc_id")
    shared = tokens.groupBy("token").agg(F.count("*").alias("in_tile"), F.min("doc_id").alias("leader")).filter("in_tile > 1")
    tiles = written(tokens.join(shared, "token"), "tiles")
    shrink_executors(documents.sparkSession)
    bits, sizes = sets.select("doc_id", "n", "bits"), sets.select("doc_id", "n")
    size = lambda k: sizes.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"))
    star = tiles.filter("doc_id != leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = star.join(size("a"), "a").join(size("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
    links = written(verified(bounded_pairs(star, bits, percent), documents, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    clusters = components(links)
    shrink_executors(documents.sparkSession)
    clustered = sizes.join(clusters.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("cluster"))
    known = tiles.join(clustered, "doc_id")
    large = known.filter(F.col("in_tile") > SMALL)
    several = large.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo != hi").select("token")
    more = bounded_pairs(small_tile_pairs(known.filter(F.col("in_tile") <= SMALL), percent), bits, percent).unionByName(tile_pairs(large.join(several, "token"), bits, percent)).distinct()
    links2 = written(verified(more, documents, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    shrink_executors(documents.sparkSession)
    # repeated rows of one id with different sets link through the id
    same = classes.join(firsts, "key").filter("doc_id != first").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    final = components(links.unionByName(links2).unionByName(same))
    return classes.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents with one of each group of near duplicates: the one of the smallest id. Rows of one id are one group."""
    found = near_duplicates(documents, width, percent)
    gone = written(found.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    return one_row_an_id(without_ids(documents, gone))
