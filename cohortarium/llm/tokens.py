"""Token ids of whole texts, exactly as the tokenizers library gives them, remembered by chunk.

Both tokenizers cut a text into pre-tokens before they merge anything. No pre-token holds white space after another
sign, and none goes from a letter or digit to an ASCII sign that is neither. A text may therefore be cut before every
run of ASCII white space, and after a first run of Latin letters and digits that an ASCII sign follows. The cuts of
many texts are found at once on their bytes; equal chunks are then encoded once, and remembered in a bounded cache of
two generations. A chunk of Latin letters alone is one pre-token, which the library's model merges directly; any other
goes through the whole library. Texts with other white space, or not in NFC, are encoded whole.

Strings of special tokens inside a text are ordinary text, as the vocabularies' own description sets it; with
``special=True`` they become their ids, as an untouched ``Tokenizer.from_file`` has it.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import CACHES, WHITE

#: Code points of white space beyond ASCII (fixed values), and of the four ASCII separators that some libraries count.
_CODES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
_OTHER_WHITE = re.compile("[" + "".join(map(chr, _CODES)) + "]")
#: One pre-token of Latin letters: ASCII and the blocks up to the phonetic ones, without the capital I with a dot (two
#: signs in lower case), the multiplication and the division sign.
_LATIN = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x23F)))
_PLAIN = {"runs": re.compile(rf" ?[{_LATIN}]+"), "words": re.compile(rf"[{_LATIN}]+")}
#: Bytes by what they do: white space, letters and digits of U+0000 to U+023F (lead C3 to C8), ASCII signs, the rest.
_END, _W, _RUN, _SIGN, _REST = 0xFF, 1, 2, 3, 4
_KIND = np.full(256, _REST, np.uint8)
_KIND[[*WHITE.encode(), _END]] = _W
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _RUN
#: Bytes that a text of other white space, or one that isn't in NFC, has (NFC texts may have them too).
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0xC2, *range(0xCC, 0x100)]] = True
#: The three signs whose bytes look like letters' and that are none, or not one in lower case.
_NO_LETTERS = ("×", "÷", "İ")
_BREAK = re.compile(rb"(?<=[^ \t\n\x0b\x0c\r])[ \t\n\x0b\x0c\r]")
#: Bytes that are cut at a time, about; chunks that a worker remembers at most, unless told otherwise.
_BYTES, REMEMBERED = 1 << 20, 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> str:
    """The sign that byte-level vocabularies write for each byte: itself where it is visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


def sliced(values: pa.Array, at: np.ndarray | None = None) -> list[bytes]:
    """The values of a binary array without nulls, or their runs between the places at."""
    places = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    places = (places if at is None else places[at]).tolist()
    data = values.buffers()[2].to_pybytes() if values.buffers()[2] else b""
    return [data[a:b] for a, b in zip(places, places[1:], strict=False)]


class Remembered:
    """A cache of at most ``most`` entries: what was of no use while half of them came in goes."""

    def __init__(self, make: Callable[[list], list], most: int):
        self.make, self.half, self.new, self.old = make, max(1, most // 2), {}, {}

    def get_all(self, keys: list) -> list:
        """The keys' values; the keys are distinct."""
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        missing, at = [], []
        for i, v in enumerate(out):
            if v is None:
                if (v := old.get(keys[i])) is None:
                    missing.append(keys[i])
                    at.append(i)
                else:
                    out[i] = new[keys[i]] = v
        for i, k, v in zip(at, missing, self.make(missing), strict=True):
            out[i] = new[k] = v
        if len(new) > self.half:
            self.old, self.new = (new if len(new) <= 2 * self.half else {}), {}
        return out


class Encoder:
    """ids(texts): each text's token ids as little-endian unsigned 16-bit bytes; one encoder a Python worker.

    chunks 'runs' keeps the white space before each chunk (byte-level vocabularies, whose tokens show a space before
    them); 'words' drops it (vocabularies whose pre-tokenizer drops white space and whose tokens show a word's end).
    """

    def __init__(self, path: str, chunks: str = "runs", remembered: int = REMEMBERED, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary must fit 16 bits")
        self.words, self.plain, self.signs = chunks == "words", _PLAIN[chunks].fullmatch, byte_signs()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.cache = Remembered(self._encode, remembered)

    def _library(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks: of plain ones by the library's model, of others by the whole library."""
        if not chunks:
            return []
        model, signs = self.tokenizer.model.tokenize, self.signs
        out: list[bytes] = [b""] * len(chunks)
        others, numbers, sizes, at = [], [], [], []
        for i, said in enumerate(b"\xff".join(chunks).decode("utf-8", "surrogateescape").split("\udcff")):
            if not self.plain(said):
                others.append((i, said))
                continue
            if self.words:
                said = said.lower()
            if not said.isascii():
                said = said.encode().decode("latin-1").translate(signs)
            elif said[0] == " ":
                said = signs[0x20] + said[1:]
            found = [t.id for t in model(said)]
            numbers += found
            sizes.append(2 * len(found))
            at.append(i)
        data, place = np.array(numbers, "<u2").tobytes(), 0
        for i, n in zip(at, sizes, strict=True):
            out[i] = data[place : place + n]
            place += n
        if others:
            for (i, _), ids in zip(others, self._library([x for _, x in others]), strict=True):
                out[i] = ids
        return out

    def _whole(self, text: bytes) -> bool:
        """Whether a text with odd bytes must be encoded whole."""
        said = text.decode()
        return _OTHER_WHITE.search(said) is not None or not unicodedata.is_normalized("NFC", said)

    def _pieces(self, text: bytes) -> Iterator[bytes]:
        """A long text in pieces that end before white space."""
        at = 0
        while len(text) - at > 2 * _BYTES and (m := _BREAK.search(text, at + _BYTES)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that may be cut."""
        data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)
        kind = _KIND[data]
        for sign in _NO_LETTERS:
            if any(sign.encode() in t for t in texts):
                a, b = sign.encode()
                kind[:-1][(data[:-1] == a) & (data[1:] == b)] = _REST
        white, end = kind == _W, data == _END
        begins = np.zeros(len(data), bool)
        if self.words:
            begins[1:] = ~white[1:] & white[:-1]
            keep = ~white
        else:
            begins[1:] = (white[1:] & ~white[:-1] | end[:-1]) & ~end[1:]
            keep = ~end
        breaks = np.flatnonzero(kind != _RUN)
        after = breaks[1:][(np.diff(breaks) > 1) & white[breaks[:-1]] & (kind[breaks[1:]] == _SIGN)]
        begins[after] = True
        starts, ends = np.flatnonzero(begins), np.flatnonzero(end)
        owned = np.searchsorted(starts, ends)  # a text's chunks are those between its ends
        if not len(starts):
            return [b""] * len(texts)
        kept = np.cumsum(keep, dtype=np.int32)
        offsets = np.append(kept[starts] - 1, kept[-1]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])]).dictionary_encode()
        ids = pa.array(self.cache.get_all(sliced(chunks.dictionary)), pa.binary()).take(chunks.indices)
        return sliced(ids, owned)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """A null has none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        found = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        out: list[bytes] = [b""] * len(found)
        todo, size = [], 0

        def done() -> None:
            for (i, _), ids in zip(todo, self._cut([t for _, t in todo]), strict=True):
                out[i] += ids
            todo.clear()

        for i, text in enumerate(found):
            if (not text.isascii() or any(c in text for c in b"\x1c\x1d\x1e\x1f")) and _ODD[np.frombuffer(text, np.uint8)].any() and self._whole(text) or any(s in text for s in self.special):
                out[i] = self._library([text.decode()])[0]
                continue
            for piece in self._pieces(text):
                todo.append((i, piece))
                size += len(piece)
                if size >= _BYTES:
                    done()
                    size = 0
        done()
        return out


_ENCODERS: dict[tuple, Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str, chunks: str, remembered: int = REMEMBERED, special: bool = False) -> Encoder:
    """The worker's encoder; kept between tasks."""
    key = (path, chunks, remembered, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
