"""Benchmark decontamination by latent semantic retrieval.

Texts are read as windows of two consecutive blocks of BLOCK words; their words are looked up once and stored as numbers. The vocabulary is every benchmark word and the
commonest words of the documents; words are counted in all documents. A randomised singular value decomposition of the
TF-IDF passages of the benchmark and of all documents is computed by Spark tasks that hold a part of the rows each; the
driver sees sums of a fixed size. A random subspace is turned towards the benchmark's passages in ROUNDS rounds; one more
over the benchmark and every document gives the singular vectors (Nystroem's form, which needs no further pass). Every
window of every document is projected, and its cosine with every benchmark passage is taken. Candidates are settled by the longest common
subsequence of words, and paraphrases also by the item's answer. Items whose words are mostly common (a group of copies
can make any word common) have no vector that would find them; every window of every document is settled for those,
except where a count of words rules a subsequence of that length out.

The benchmark is the query set: it goes to the tasks in blocks of at most ITEMS passages, one search a block.

Defined results: null or empty texts and items match nothing; repeated items and documents are matched each; the cosine of
a match that no vector found is 0; an empty benchmark gives no rows; extra columns are ignored by ``leaks`` and kept by
``without_leaks``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fresh, reuse_freed, small_batches, tidy, written
from .jaccard import lower_words
from .membership import without_ids

BLOCK = 24
RANK, OVERSAMPLE, ROUNDS = 128, 16, 2
#: In the decomposition all documents together weigh as so many, if there are more; words that no item has, at most.
FIT_DOCUMENTS, WORDS = 2000, 12_288
#: Words that a task counts before it gives their counts away; words of texts that are looked at together, about; rows
#: of a sum that are added one after the other.
COUNTED, AT_ONCE, ADDED = 200_000, 1 << 14, 16
#: Benchmark passages of one search, at most.
ITEMS = 20_000
#: Words in more than this share of the documents have no weight.
COMMON = 0.12
#: An item is weak if its words beside as many unknown ones have a cosine under WEAK times the least one of candidates.
WEAK = 1.25
#: Weight of a document's passages beside the benchmark's in the decomposition, for FIT_DOCUMENTS documents or fewer.
DOCUMENT_WEIGHT = 0.2
#: A window is a candidate if its latent cosine with a passage is at least this part of the passage's own.
COSINE = 0.2
#: Shares of an item's words in the longest common subsequence: word for word, and with the answer.
VERBATIM, PARAPHRASE = 0.8, 0.6
_CHUNKS = 16
_EDGE = b".,;:!?\"'()[]{}"


def plain(word: bytes) -> bytes:
    """The word as it is compared: ASCII letters in lower case, no punctuation at the ends."""
    return word.lower().strip(_EDGE) or word


def passages(ids: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, max(1, len(ids) - BLOCK), BLOCK):
        yield ids[k : k + 2 * BLOCK]


class Vocabulary:
    """Word to number; -1 for words outside."""

    def __init__(self, words: list[bytes]):
        self.numbers = {w: i for i, w in enumerate(words)}
        self.kind = np.int16 if len(words) < 1 << 15 else np.int32

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        out = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        if len(at := np.flatnonzero(out < 0)):  # those aren't plain, or outside
            forms = map(bytes.strip, map(bytes.lower, map(words.__getitem__, at.tolist())), repeat(_EDGE))
            out[at] = np.fromiter(map(get, forms, repeat(-1)), np.int64, len(at))
        return out

    def coded(self, words: list[bytes]) -> bytes:
        return self.ids(words).astype(self.kind).tobytes()

    @staticmethod
    def read(column: pa.Array, words: int) -> Iterator[np.ndarray]:
        """What ``coded`` gave, where the vocabulary has so many words."""
        kind = np.int16 if words < 1 << 15 else np.int32
        return (np.frombuffer(x, kind).astype(np.int64) for x in column.to_pylist())


class Tally:
    """Of words in lower case: the numbers of their plain forms, given as they come; in how many texts those are."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.n, self.seen = np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def add(self, words: list[bytes]) -> None:
        numbers, forms = self.numbers, self.words
        ids = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(ids < 0).tolist():
            word = words[i]
            form = word.strip(_EDGE) or word
            n = numbers.get(form)
            if n is None:
                n = numbers[form] = len(forms)
                forms.append(form)
            if form is not word:
                numbers[word] = n
            ids[i] = n
        if len(self.n) < len(forms):
            self.n, self.seen = (np.append(x, np.zeros(2 * len(forms) - len(x), x.dtype)) for x in (self.n, self.seen))
        places = np.arange(len(ids), dtype=np.int32)
        self.seen[ids] = places
        self.n[ids[self.seen.take(ids) == places]] += 1  # each number once

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.words, pa.binary()), pa.array(self.n[: len(self.words)])], ["word", "n"])


def together(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in groups of AT_ONCE words or one text."""
    group, held = [], 0
    for x in texts:
        group.append(x)
        held += 1 + len(x)
        if held >= AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def summed(rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of rows[at] from each first on, which reduceat gives more slowly: the k-th rows of all sums are added at once."""
    if not len(first):
        return np.zeros((0, rows.shape[1]), rows.dtype)
    length = np.diff(first, append=len(at))
    if length.max() > ADDED:
        parts = -(-length // ADDED)
        start = np.cumsum(parts) - parts
        inner = np.repeat(first - ADDED * start, parts) + ADDED * np.arange(parts.sum())
        return summed(summed(rows, at, inner), np.arange(len(inner)), start)
    order = np.argsort(-length, kind="stable")
    begin, shorter = first[order], -length[order]
    sums = rows.take(at[begin], axis=0)
    for k in range(1, length.max()):
        n = np.searchsorted(shorter, -k)  # sums of more than k rows
        sums[:n] += rows.take(at[begin[:n] + k], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


class Laid:
    """Texts in blocks, one after the other; a text's last block is filled up with -2.

    A window starts with each block but a text's last one, or with its only one.
    """

    def __init__(self, texts: list[np.ndarray]):
        n = np.array([-(-len(x) // BLOCK) for x in texts], np.int64)
        self.first = np.cumsum(n) - n
        self.ids = np.full(int(n.sum()) * BLOCK, -2, np.int64)
        for x, k in zip(texts, (self.first * BLOCK).tolist(), strict=True):
            self.ids[k : k + len(x)] = x
        self.text = np.repeat(np.arange(len(texts)), n)
        self.goes_on = np.r_[self.text[1:] == self.text[:-1], False] if len(self.text) else np.zeros(0, bool)
        self.window = self.goes_on | (n[self.text] == 1)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors; -1 equals nothing."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        if x >= 0:
            places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := places.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def summed_blobs(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays that tasks gave in _CHUNKS parts (chunk, data); of a fixed size, whatever the number of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, np.float32).astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["chunk", "data"])

    out = np.zeros(int(np.prod(shape)))
    width = -(-len(out) // _CHUNKS)
    for r in rows.repartition("chunk").mapInArrow(add, "chunk int, data binary").toLocalIterator():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(bytes(r["data"]), np.float32)
    return out.reshape(shape)


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = total.reshape(-1).astype(np.float32)
    width = -(-len(flat) // _CHUNKS)
    for k in range(_CHUNKS):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flat[k * width : (k + 1) * width].tobytes()], pa.binary())], ["chunk", "data"])


class Space:
    """The fitted space: words, idf, and basis (idf x right singular vectors, one row a word).

    A window's latent vector is divided by the length of its whole TF-IDF vector, unknown words included, so that a
    window with little in the space stays short.
    """

    def __init__(self, words: list[bytes], idf: np.ndarray, vectors: np.ndarray, unknown: float):
        self.words, self.idf = words, idf
        self.squares = np.append(idf**2, [0.0, unknown**2]).astype(np.float32)  # the last two are for -2, which is no word, and -1
        self.basis = np.zeros((len(words) + 2, vectors.shape[1]), np.float32)
        np.multiply(idf[:, None], vectors, out=self.basis[:-2], casting="same_kind")
        self.live = self.basis.any(axis=1)

    def project(self, laid: Laid) -> np.ndarray:
        """Latent vectors of the windows that start with each block; of no use where none does."""
        vectors, squares = self.windows(laid)
        vectors /= np.sqrt(np.maximum(squares, 1e-9))[:, None]
        return vectors

    def windows(self, laid: Laid) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the windows' vectors, and the squared lengths of the windows themselves, by first block."""
        ids, n = laid.ids, len(laid.text)
        blocks, squares = np.zeros((n, self.basis.shape[1]), np.float32), self.squares.take(ids).reshape(n, BLOCK).sum(axis=1)
        at = np.flatnonzero(self.live.take(ids))
        owner = at // BLOCK
        first = starts(owner)
        blocks[owner[first]] = summed(self.basis, ids[at], first)
        on = np.flatnonzero(laid.goes_on)
        vectors, lengths = blocks.copy(), squares.copy()
        vectors[on] += blocks[on + 1]
        lengths[on] += squares[on + 1]
        return vectors, lengths

    def query(self, ids: np.ndarray) -> np.ndarray | None:
        """A passage's latent vector, scaled so that its product with the passage's own window is 1."""
        v = self.basis[ids].sum(axis=0)
        own, square = float(np.sqrt(self.squares[ids].sum())), float(v @ v)
        return v * (own / square) if square > 1e-12 else None

    def weak(self, ids: np.ndarray, cosine: float) -> bool:
        """Whether the words of an item weigh too little for windows that hold it to be candidates."""
        own, least = float(self.squares[ids].mean()), (WEAK * max(0.0, cosine)) ** 2
        return own <= least * (own + float(self.squares[-1]))


def document_counts(documents: DataFrame) -> DataFrame:
    """word, n: in how many of all documents each word occurs; a written table.

    There is no sum before the shuffle: it halves the rows shuffled but took more time than it saved.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        reuse_freed()
        tally = Tally()
        for b in batches:
            for said in lower_words(b.column("text")):
                tally.add(said)
                if len(tally.numbers) >= COUNTED:
                    yield tally.batch()
                    tally = Tally()
        if tally.words:
            yield tally.batch()

    return written(documents.mapInArrow(tidy(run), "word binary, n long").repartition("word").groupBy("word").agg(F.sum("n").alias("n")), "words")


def spread(space: Space, texts: Iterator[np.ndarray], weight: float) -> np.ndarray:
    """A' A q for the passages of texts (word numbers), where the space's basis is idf x q and a passage's length is weight."""
    out = np.zeros((len(space.words), space.basis.shape[1]), np.float32)
    for group in together(texts):
        laid = Laid(group)
        z, squares = space.windows(laid)
        z *= np.divide(weight**2, squares, out=np.zeros_like(squares), where=laid.window & (squares > 0))[:, None]
        on = np.flatnonzero(laid.goes_on)
        blocks = z.copy()
        blocks[on + 1] += z[on]
        at = np.flatnonzero((laid.ids >= 0) & (space.squares.take(laid.ids) > 0))
        at = at[np.argsort(laid.ids[at], kind="stable")]
        word = laid.ids[at]
        first = starts(word)
        out[word[first]] += summed(blocks, at // BLOCK, first)
    out *= space.idf.astype(np.float32)[:, None]
    return out


def weighed(documents: DataFrame, items: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, int]:
    """The vocabulary, its words' weights, and how many documents there are."""
    spark = documents.sparkSession
    own = sorted({plain(w) for words in items for w in words})
    said = documents.select(F.col("text").cast("string").alias("text"))
    counted, total = document_counts(said), said.count()
    common = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(WORDS).collect()
    known = set(own)
    words = own + [w for r in common if (w := bytes(r["word"])) not in known]
    often = {bytes(r["word"]): r["n"] for r in [*common, *counted.join(F.broadcast(spark.createDataFrame([(w,) for w in own], "word binary")), "word").collect()]}  # the words of items and WORDS more
    drop_written(counted)
    often = np.array([often.get(w, 0) for w in words], np.float64)
    idf = np.log((1 + total) / (1 + often)).clip(min=0.0)
    idf[often > COMMON * total] = 0.0
    return words, idf, total


def coded(documents: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, ids: the word numbers of every document; a written table."""
    given = documents.sparkSession.sparkContext.broadcast(words)
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        reuse_freed()
        vocabulary = Vocabulary(given.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(vocabulary.coded, lower_words(b.column("text"))), pa.binary())], ["doc_id", "ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(docs.mapInArrow(tidy(run), "doc_id long, ids binary"), "coded")


def fit(documents: DataFrame, items: list[list[bytes]]) -> Space:
    words, idf, total = weighed(documents, items)
    rows = coded(documents, words)
    space = decomposed(rows, items, words, idf, total)
    drop_written(rows)
    return space


def decomposed(rows: DataFrame, items: list[list[bytes]], words: list[bytes], idf: np.ndarray, total: int) -> Space:
    """The space of the passages of items and of total documents, which rows has as ``coded`` gives them."""
    spark = rows.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(words)
    bench = spark.createDataFrame([(vocabulary.coded(x),) for x in items], "ids binary").repartition(4)

    def times(rows: DataFrame, q: np.ndarray, weight: float) -> np.ndarray:
        """A' A q, summed over the tasks."""
        given = spark.sparkContext.broadcast((words, idf, q.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh()
            reuse_freed()
            words, idf, q = given.value
            space = Space(words, idf, q, 0.0)
            out = spread(space, (ids for b in batches for ids in Vocabulary.read(b.column("ids"), len(words))), weight)
            if out.any():
                yield from _parts(out)

        return summed_blobs(rows.mapInArrow(tidy(run), "chunk int, data binary"), q.shape)

    q = np.random.default_rng(7).standard_normal((len(words), min(RANK + OVERSAMPLE, len(words))))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(times(bench, q, 1.0))
    y = times(bench, q, 1.0) + times(rows.select("ids"), q, DOCUMENT_WEIGHT * min(1.0, FIT_DOCUMENTS / max(1, total)) ** 0.5)
    return Space(words, idf, singular_vectors(q, y)[:, :RANK], float(np.log(1 + total)))


def singular_vectors(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The eigenvectors, the largest first, of y (q' y)^-1 y', which stands for A' A if y = A' A q; q if that is nought."""
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    if values[-1] <= 0:
        return q
    fine = values > 1e-6 * values[-1]
    half = y @ (turn[:, fine] / np.sqrt(values[fine]))
    vectors, _, _ = np.linalg.svd(half, full_matrices=False)
    return vectors


class Item:
    """A benchmark item as it is compared."""

    def __init__(self, item_id: int | None, words: list[bytes], ids: np.ndarray, idf: np.ndarray):
        self.item_id, self.ids = item_id, ids.tolist()
        text = b" ".join(words)
        said = re.split(rb"(?i)\banswer\s*:|\?", text)[-1].split() if re.search(rb"(?i)\banswer\s*:|\?", text) else []
        tail = self.ids[len(self.ids) - len(said) :] if said else []
        rare = sorted(range(len(self.ids)), key=lambda i: (-idf[self.ids[i]], i))[:3]
        #: The answer: what follows the question, or else the item's three rarest words.
        self.answer = tail or [self.ids[i] for i in sorted(rare)]
        self.times, self.different = Counter(self.ids), frozenset(self.ids)

    def settle(self, ids: list[int]) -> tuple[int, bool] | None:
        """(longest common subsequence, word for word) if ids hold the item."""
        n = len(self.ids)
        if sum(map(self.times.get, self.different.intersection(ids))) < PARAPHRASE * n:
            return None  # no subsequence is longer than the count of the item's words there
        both = lcs(self.ids, ids)
        if both >= VERBATIM * n:
            return both, True
        if both >= PARAPHRASE * n and 3 * lcs(self.answer, ids) >= 2 * len(self.answer):
            return both, False
        return None


class Weak:
    """Weak items, which are looked for in every window: no subsequence is longer than the count of an item's words there."""

    def __init__(self, numbers: list[int], items: list[Item], size: int):
        self.numbers, self.words, self.answers = numbers, [np.array(items[i].ids) for i in numbers], [np.array(items[i].answer) for i in numbers]
        self.all = np.concatenate([x for pair in zip(self.words, self.answers, strict=True) for x in pair])
        self.first = np.cumsum([0, *(len(x) for pair in zip(self.words, self.answers, strict=True) for x in pair)])[:-1]
        self.n, self.n_answer = (np.array([len(x) for x in y]) for y in (self.words, self.answers))
        self.seen = np.zeros(size + 1, bool)  # the last is for -1

    def windows(self, ids: np.ndarray, items: list[Item]) -> Iterator[tuple[int, int]]:
        """(item's number, the window's first word) of what can't be ruled out in a text."""
        there = self.present(ids, self.all, self.first)  # of an item's words and of its answer's, those in the text
        at = np.arange(0, max(1, len(ids) - BLOCK), BLOCK)
        for k in np.flatnonzero(self.possible(there[::2], there[1::2], self.n, self.n_answer)):
            n, words = len(self.words[k]), self.words[k]
            self.seen[words] = True
            before = np.append(0, np.cumsum(self.seen[ids]))
            self.seen[words] = False
            held = before[np.minimum(at + 2 * BLOCK + n, len(ids))] - before[np.maximum(at - n, 0)]
            both, first = np.concatenate([words, self.answers[k]]), np.array([0, n])
            for x in at[held >= PARAPHRASE * n].tolist():
                a, b = self.present(ids[max(0, x - n) : x + 2 * BLOCK + n], both, first)
                if self.possible(a, b, n, self.n_answer[k]):
                    yield self.numbers[k], x

    def present(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many of the words are among ids, summed from each first on."""
        self.seen[ids], self.seen[-1] = True, False
        there = np.add.reduceat(self.seen[words], first, dtype=np.int64)
        self.seen[ids] = False
        return there

    @staticmethod
    def possible(held, answered, n, n_answer):
        """Whether ``Item.settle`` can find an item of n words of which so many, and so many of its answer, are there."""
        return (held >= VERBATIM * n) | ((held >= PARAPHRASE * n) & (3 * answered >= 2 * n_answer))


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row a document and an item that it holds: doc_id, item_id, cosine, lcs, n_item_words, verbatim."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs long, n_item_words long, verbatim boolean"
    found = spark.createDataFrame([], schema)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    block: list = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if words := (r["text"] or "").encode().split():
            block.append((r["item_id"], words))
        if len(block) >= ITEMS:
            found, block = found.unionByName(_search(docs, block, cosine, schema)), []
    return found.unionByName(_search(docs, block, cosine, schema)) if block else found


def _search(docs: DataFrame, block: list, cosine: float, schema: str) -> DataFrame:
    spark = docs.sparkSession
    said = [words for _, words in block]
    words, idf, total = weighed(docs, said)
    docs = coded(docs, words)
    space = decomposed(docs, said, words, idf, total)
    vocabulary = Vocabulary(space.words)
    items, queries, owner, weak = [], [], [], []
    for item_id, words in block:
        items.append(Item(item_id, words, ids := vocabulary.ids(words), space.idf))
        vectors = [v for p in passages(ids) if (v := space.query(p)) is not None]
        queries += vectors
        owner += [len(items) - 1] * len(vectors)
        if not vectors or space.weak(ids, cosine):
            weak.append(len(items) - 1)
    shared = spark.sparkContext.broadcast((space, items, np.array(queries, np.float32).reshape(-1, space.basis.shape[1]), np.array(owner), weak))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        reuse_freed()
        space, items, queries, owner, weak = shared.value
        common = Weak(weak, items, len(space.words)) if weak else None
        for b in batches:
            rows, ids = [], b.column("doc_id").to_pylist()
            for group in together(Vocabulary.read(b.column("ids"), len(space.words))):
                best: dict[tuple[int, int], tuple] = {}

                def settle(d: int, i: int, at: int, near: float, group: list = group, best: dict = best) -> None:
                    n = len(items[i].ids)
                    if got := items[i].settle(group[d][max(0, at - n) : at + 2 * BLOCK + n].tolist()):
                        best[d, i] = max(best.get((d, i), (-1,)), (got[0], near, got[1]))

                if len(owner):
                    laid = Laid(group)
                    windows = space.project(laid)
                    for k in range(0, len(windows), 1024):
                        near = windows[k : k + 1024] @ queries.T
                        for w, q in np.argwhere((near >= cosine) & laid.window[k : k + 1024, None]).tolist():
                            d = int(laid.text[k + w])
                            settle(d, int(owner[q]), (k + w - int(laid.first[d])) * BLOCK, float(near[w, q]))
                for d, text in enumerate(group if common else ()):
                    for i, at in common.windows(text, items) if len(text) else ():
                        settle(d, i, at, 0.0)
                rows += [(ids[d], items[i].item_id, c, n, len(items[i].ids), v) for (d, i), (n, c, v) in sorted(best.items())]
                del ids[: len(group)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "cosine", "lcs", "n_item_words", "verbatim"])

    return docs.mapInArrow(tidy(run), schema)


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item."""
    found = written(leaks(documents, benchmark).filter("doc_id is not null").select("doc_id").distinct(), "leaks")
    return without_ids(documents, found)
