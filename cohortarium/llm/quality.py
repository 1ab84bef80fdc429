"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Words and word pairs are hashed into 2^18 buckets. Two multinomials are counted over whole tables: the raw one over
all documents, the target one over every document that the labels call good and not toxic. A bucket's ratio is
shrunk towards nought by a prior weight, so that rare words say nothing. A document's score is the mean ratio of its
n-grams. The threshold lies below the scores that good labelled documents have when their own counts are left out.
It and the limit are exact order statistics of every labelled document, found by digits of the scores.

A few words make a text toxic, which a mean over the text hides. So a second ratio is counted by documents: of those
that the labels call toxic and have a word, against as many as would have it if they were good or any documents. A
text's toxic score is that of its most toxic word; the limit is what TOXIC_LOSS of the good labelled documents pass.

Defined results: a null or empty text has no words and fails the base rule; equal texts get equal verdicts; without
labels every document that passes the base rule is kept; of repeated labels the worst counts; a null doc_id has no
label; an empty table gives no rows; extra columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, by_batch, drop_written, fresh, small_batches, texts, tidy, window_hashes, word_lists, written
from .membership import among, bits_of

BITS = 18
#: Weight of the prior: as many n-grams are added to what is seen and to what is expected.
PRIOR = 10.0
#: Scores of labelled documents: of good ones, of bad ones, and of the most toxic words of good ones.
GOOD, BAD, TOXIC = 0, 1, 2
#: Weight of the prior of the toxic ratio in documents, part of the good documents above its limit, and the least limit.
TOXIC_PRIOR, TOXIC_LOSS, TOXIC_LEAST = 3.0, 0.005, float(np.log(2))
_CHUNKS = 64
_EDGE = b".,;:!?\"'()[]{}"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_buckets(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """The bucket of every word and of every two consecutive words."""
    w = np.fromiter(map(crc32, words), np.uint64, len(words))
    one = (w * _A) >> np.uint64(64 - bits)
    two = ((w[:-1] * _A + w[1:] * _B) * _C) >> np.uint64(64 - bits)
    return np.concatenate([one, two]).astype(np.int64)


def word_buckets(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """The buckets of a text's different words, in lower case and without punctuation at the ends."""
    different = {w.lower().strip(_EDGE) for w in set(words)}
    w = np.fromiter(map(crc32, different), np.uint64, len(different))
    return np.unique((w * _A) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """ratio: the log-likelihood ratio by bucket; the arrays behind it; below threshold a document goes.

    toxic: the toxic ratio by bucket; a document with a word above limit goes.
    """

    ratio: np.ndarray
    target: np.ndarray
    raw: np.ndarray
    threshold: float
    toxic: np.ndarray
    limit: float = float("inf")

    def score(self, buckets: np.ndarray) -> float:
        return float(self.ratio[buckets].mean()) if len(buckets) else 0.0

    def score_without(self, buckets: np.ndarray) -> float:
        """The score of a target document if its own counts weren't in the target."""
        if not len(buckets):
            return 0.0
        b, n = np.unique(buckets, return_counts=True)
        q = self.raw[b] / self.raw.sum()
        r = np.log((self.target[b] - n + PRIOR) / (max(0.0, self.target.sum() - len(buckets)) * q + PRIOR))
        return float((r * n).sum() / len(buckets))


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    return np.log((target + PRIOR) / (target.sum() * raw / max(1.0, raw.sum()) + PRIOR)).astype(np.float32)


def toxic_ratios(found: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """found: documents that have a bucket's word, of all, good and toxic ones; documents: how many there are of each."""
    raw, good = (found[k] / max(1, documents[k]) for k in (0, 1))
    return np.log((found[2] + TOXIC_PRIOR) / (documents[2] * np.maximum(raw, good) + TOXIC_PRIOR)).astype(np.float32)


def most_toxic(toxic: np.ndarray, words: list[bytes]) -> float:
    return float(toxic[word_buckets(words)].max()) if words else float("-inf")


def verdicts_of(labels: DataFrame) -> DataFrame:
    """doc_id, good, bad, toxic, one row a document: good if every label of it says quality 1 and toxic 0."""
    good = (F.coalesce(F.col("quality").cast("int"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 0)
    bad = F.col("quality").cast("int") == 0
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"), F.max(F.coalesce(F.col("toxic").cast("int") == 1, F.lit(False))).alias("toxic"))


def count_corpora(documents: DataFrame, verdicts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, raw) counts by bucket over all documents, and what ``toxic_ratios`` is made of.

    Every task gives its counts in chunks, which are then summed; the last chunk has the numbers of documents.
    """
    small_batches(documents.sparkSession)
    width = (1 << BITS) // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        counts, documents = np.zeros((5, 1 << BITS), np.int64), np.zeros(3, np.int64)
        for b in batches:
            grams: tuple[list, list] = ([], [])
            for words, good, toxic in zip(word_lists(b.column("text")), b.column("good").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                grams[good is True].append(gram_buckets(words))
                own, kinds = word_buckets(words), [0] + [1] * (good is True) + [2] * (toxic is True)
                for k in kinds:
                    counts[2 + k, own] += 1
                    documents[k] += 1
            for target in (False, True):
                if grams[target]:
                    n = np.bincount(np.concatenate(grams[target]), minlength=1 << BITS)
                    counts[1] += n
                    if target:
                        counts[0] += n
        if counts[1].any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS + 1), pa.int32()), pa.array([*(counts[:, k * width : (k + 1) * width].tobytes() for k in range(_CHUNKS)), documents.tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    joined = docs.join(verdicts.filter("good or toxic").hint("shuffle_hash"), "doc_id", "left").select("text", "good", "toxic")
    rows = joined.mapInArrow(tidy(count), "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()  # 65 rows
    out, total = np.zeros((5, 1 << BITS)), np.zeros(3)
    for r in rows:
        data = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["chunk"] == _CHUNKS:
            total = data
        else:
            out[:, r["chunk"] * width : (r["chunk"] + 1) * width] = data.reshape(5, width)
    return out[0], out[1], out[2:], total


def sort_keys(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles; the same again gives the doubles' bits back."""
    bits = np.asarray(x, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


def order_statistics(rows: DataFrame, wanted: list[tuple[int, int]]) -> list[float]:
    """The values at (kind, rank from 0) among rows (kind int, key long, of ``sort_keys``), exact however many rows there are.

    Digits of 12 bits are counted from the highest on, each among the rows that agree in those before: at most 4096 counts
    for each value wanted come to the driver at once.
    """
    before, at = 64, [(kind, 0, rank) for kind, rank in wanted]
    for shift in (52, 40, 28, 16, 4, 0):
        near = [(F.col("kind") == kind) & (F.shiftright("key", before) == prefix if before < 64 else F.lit(True)) for kind, prefix in sorted({(k, p) for k, p, _ in at})]
        digits: dict[tuple[int, int], list] = {}
        for r in rows.filter(reduce(or_, near)).groupBy("kind", F.shiftright("key", shift).alias("prefix")).count().collect():  # 4096 a value wanted
            digits.setdefault((r["kind"], r["prefix"] >> (before - shift) if before < 64 else 0), []).append((r["prefix"], r["count"]))
        for k, (kind, prefix, rank) in enumerate(at):
            for digit, n in sorted(digits[kind, prefix]):
                if rank < n:
                    at[k] = (kind, digit, rank)
                    break
                rank -= n
        before = shift
    bits = np.array([key for _, key, _ in at], np.int64)
    return (bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64).tolist()


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    verdicts = verdicts_of(labels)
    target, raw, found, total = count_corpora(documents, verdicts)
    model = Model(ratios(target, raw), target, raw, float("-inf"), toxic_ratios(found, total))
    if not target.sum():
        return model
    known = written(verdicts.filter("good or bad").select("doc_id", "good"), "labelled")
    shared = documents.sparkSession.sparkContext.broadcast((model, bits_of(known, "doc_id")))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        (m, bitmap), out = shared.value, []
        b = b.filter(pa.array(among(bitmap, b.column("doc_id"))))
        for words in word_lists(b.column("text")):
            buckets = gram_buckets(words)
            out.append((m.score_without(buckets), m.score(buckets), most_toxic(m.toxic, words)))
        keys = sort_keys(np.array(out, np.float64).reshape(-1, 3).T)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, keys)], ["doc_id", "without", "score", "toxic"])

    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    scored = by_batch(docs, run, "doc_id long, without long, score long, toxic long").join(known.hint("merge"), "doc_id")
    kinds = F.when(F.col("good"), F.array(F.struct(F.lit(GOOD).alias("kind"), F.col("without").alias("key")), F.struct(F.lit(TOXIC).alias("kind"), F.col("toxic").alias("key"))))
    rows = written(scored.select(F.explode(kinds.otherwise(F.array(F.struct(F.lit(BAD).alias("kind"), F.col("score").alias("key"))))).alias("r")).select("r.*"), "scores")
    n = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}  # 3 rows
    if GOOD in n:
        model = _with_limits(model, rows, n)
    drop_written(rows)
    drop_written(known)
    return model


def _with_limits(model: Model, rows: DataFrame, n: dict[int, int]) -> Model:
    """model with the threshold and the limit that n scores of each kind give; quantiles as numpy's."""
    place = 0.001 * (n[GOOD] - 1)
    ranks = [(GOOD, int(place)), (GOOD, min(int(place) + 1, n[GOOD] - 1)), (TOXIC, int(np.ceil((1 - TOXIC_LOSS) * (n[TOXIC] - 1))))]
    ranks += [(BAD, (n[BAD] - 1) // 2), (BAD, n[BAD] // 2)] if BAD in n else []
    a, b, toxic, *middle = order_statistics(rows, ranks)
    low = float(np.quantile([a, b], place - int(place)))
    far = sum(middle) / 2 if middle else low - abs(low)
    return Model(model.ratio, model.target, model.raw, low - 0.1 * max(0.0, low - far), model.toxic, max(TOXIC_LEAST, toxic))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    h = window_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), width)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(words)] += np.bincount(starts, minlength=len(words))[: len(words)]
    edge -= np.bincount(starts + width, minlength=len(words) + 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words))


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, score."""
    shared = documents.sparkSession.sparkContext.broadcast((model.ratio, model.threshold, model.toxic, model.limit))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ratio, threshold, toxic, limit = shared.value
        rows, score, fine = [], [], []
        for text, words in zip(texts(b.column("text")), word_lists(b.column("text")), strict=True):
            rows.append(base_counts(text, words))
            score.append(float(ratio[gram_buckets(words)].mean()) if words else 0.0)
            fine.append(most_toxic(toxic, words) <= limit)
        counts = np.array(rows, np.int64).T
        failed = (counts[0] < 20) | (100 * counts[4] > 30 * counts[0])
        kept = ~failed & (np.array(score) >= threshold) & np.array(fine)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(failed), pa.array(kept), pa.array(score, pa.float64())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return by_batch(docs, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """documents without those that the base rule or the ratio rejects."""
    shared = documents.sparkSession.sparkContext.broadcast((model.ratio, model.threshold, model.toxic, model.limit))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ratio, threshold, toxic, limit = shared.value
        kept = []
        for words in word_lists(b.column("text").cast(pa.string())):
            n = len(words)
            kept.append(n >= 20 and 100 * repeated_words(words) <= 30 * n and float(ratio[gram_buckets(words)].mean()) >= threshold and most_toxic(toxic, words) <= limit)
        return b.filter(pa.array(kept, pa.bool_()))

    return by_batch(documents, run, documents.schema)
