"""Token counts of whole texts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a pre-token; dynamic programming carries, for every
position, the best score and the number of pieces on the way there, and nothing else. The tie rules are the
tokenizers library's: at one position the piece that starts first wins among equal scores; a sign that is no piece
costs the lowest score less ten; with byte fallback it counts as its UTF-8 bytes, without it a run of such signs is
one piece. Pre-tokens are cut before every space (written as a low block), and remembered in a bounded cache.

Defined results: a null or empty text has no token and score 0; equal texts count alike; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, Bounded, by_batch, texts
from .tokens import default_path

#: Fixed value: the sign that stands for a space.
SPACE = chr(0x2581)
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, in the order of their ids."""

    pieces: tuple[tuple[str, float], ...]
    unknown: int | None = 0
    byte_fallback: bool = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())), sp.unk_id())


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        #: The unknown piece's own text: where it stands in a text, the library looks a run of unknown signs up once more.
        self.literal = vocabulary.pieces[vocabulary.unknown][0] if vocabulary.unknown is not None else ""
        ids = self.ids = {p: i for i, (p, _) in enumerate(vocabulary.pieces)}
        for p, i in ids.items():
            if p:
                self.automaton.add_word(p, (len(p), vocabulary.pieces[i][1], i == vocabulary.unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback and all(f"<0x{b:02X}>" in ids for b in range(256))
        self.cache = Bounded(self._count_all, 500_000)

    def _count_all(self, pieces: list[str]) -> list[tuple[int, float]]:
        return [self.count_one(SPACE + p) for p in pieces]

    def count_one(self, token: str) -> tuple[int, float]:
        """(pieces, score) of one pre-token."""
        if self.literal and self.literal in token:
            return self._by_path(token)
        n = len(token)
        score: list[float | None] = [0.0] + [None] * n
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        ending: list[list] = [[] for _ in range(n)]
        single = [False] * n
        for end, value in self.automaton.iter(token):
            ending[end].append(value)
            if value[0] == 1:
                single[end] = True
        for end in range(n):
            best, pieces, odd = None, 0, False
            for length, s, is_unknown in sorted(ending[end], key=lambda v: -v[0]):
                start = end + 1 - length
                if score[start] is not None and (best is None or s + score[start] > best):
                    best, odd = s + score[start], is_unknown
                    pieces = count[start] + (self._odd(token[start : end + 1], unknown[start]) if is_unknown else 1)
            if not single[end] and score[end] is not None and (best is None or self.unknown_score + score[end] > best):
                best, odd = self.unknown_score + score[end], True
                pieces = count[end] + self._odd(token[end], unknown[end])
            score[end + 1], count[end + 1], unknown[end + 1] = best, pieces, odd
        return count[n], score[n] or 0.0

    def _by_path(self, token: str) -> tuple[int, float]:
        """As count_one, along the best path: its runs of unknown signs may spell a piece."""
        n = len(token)
        best: list[tuple[float, int, bool] | None] = [(0.0, 0, False)] + [None] * n
        matches: list[list] = [[] for _ in range(n)]
        for end, (length, s, is_unknown) in self.automaton.iter(token):
            matches[end + 1 - length].append((length, s, is_unknown))
        for start in range(n):
            if best[start] is None:
                continue
            here = best[start][0]
            options = sorted(matches[start]) + ([] if any(m[0] == 1 for m in matches[start]) else [(1, self.unknown_score, True)])
            for length, s, is_unknown in options:
                if best[start + length] is None or s + here > best[start + length][0]:
                    best[start + length] = (s + here, start, is_unknown)
        parts, end, run = 0, n, ""
        while end:
            _, start, is_unknown = best[end]
            if is_unknown:
                run = token[start:end] + run
            else:
                parts, run = parts + 1 + self._run(run), ""
            end = start
        return parts + self._run(run), best[n][0]

    def _run(self, run: str) -> int:
        return 0 if not run else 1 if run in self.ids or not self.bytes else len(run.encode())

    def _odd(self, sign: str, after_another: bool) -> int:
        return len(sign.encode()) if self.bytes else int(not after_another)

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        said = text.replace(SPACE, " ")
        found = self.cache.get_all((said[1:] if said[0] == " " else said).split(" "))
        pieces, scores = zip(*found, strict=True)
        return sum(pieces), float(sum(scores))


_COUNTERS: dict[str, Counter] = {}
CACHES.append(_COUNTERS)


def counter(path: str) -> Counter:
    """The worker's counter; kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary.from_sentencepiece(path))
    return _COUNTERS[path]


def token_counts(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, score (of the best segmentation)."""
    path = model or default_path("piece_bpe_32k.model")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        found = [c.count(t) for t in texts(b.column("text"))]
        n, score = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return by_batch(documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id long, n_tokens long, score double", caches=True)
