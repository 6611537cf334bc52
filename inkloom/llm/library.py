"""Ids of public vocabularies, by the tokenizers library, each distinct piece of a batch of texts once.

The distinct chunks of a batch are cut into pieces as the vocabulary's pre-splitting
has it, the distinct pieces that are not held are encoded by the library's model, and
ids are put together again by array takes.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from inkloom.llm.bpe import ByteBpe, Chunks, WordBpe, byte_alphabet


def lowered(chunk: str) -> str:
    """A chunk in normal form C with each character in lower case, whatever stands beside it (which matters for one letter only)."""
    if chunk.isascii():
        return chunk.lower()
    chunk = unicodedata.normalize("NFC", chunk)
    return "".join([c.lower() for c in chunk]) if "Σ" in chunk else chunk.lower()


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def taken(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[start : start + size] one after another, and where each ends."""
    ends = np.cumsum(size)
    kind = "i4" if len(pool) < 2**31 and (not len(ends) or ends[-1] < 2**31) else "i8"
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return pool[at], ends


class Held:
    """Bytes made of keys up to a length: those of the keys met lately are held, in two generations of about `most`."""

    def __init__(self, make, most: int = 200_000, longest: int = 48):
        self.make, self.most, self.longest, self.now, self.before = make, most, longest, {}, {}

    def of(self, keys: list[str]) -> list[bytes]:
        out = list(map(self.now.get, keys))
        if None in out:
            now, before, make, longest = self.now, self.before.get, self.make, self.longest
            for k, x in enumerate(out):
                if x is None:
                    key = keys[k]
                    out[k] = x = before(key) or make(key)
                    if len(key) <= longest:
                        now[key] = x
            if len(now) > self.most and now is self.now:
                self.before, self.now = now, {}
        return out


def pooled(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all blobs, and each one's start and size among them."""
    size = np.fromiter(map(len, blobs), "i8", len(blobs)) // 4
    return np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(size) - size, size


class Pieces:
    """Ids of the pieces that a vocabulary's pre-splitting makes."""

    def __init__(self, path: str, split: str):
        self.library = Tokenizer.from_file(path)
        self.encode = self.library.model.tokenize
        self.cut = regex.compile(split).findall
        self.stands = {b: c for c, b in byte_alphabet().items()}
        self.held = Chunks(self.ids, 100_000)
        self.marks = {m: self.ids(m) for m in ".,;:!?"}

    def plain(self, letters: str) -> bytes:
        """Of a piece written in the vocabulary's alphabet."""
        return array("I", [t.id for t in self.encode(letters)]).tobytes()

    def ids(self, piece: str) -> bytes:
        return self.plain(piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.stands))

    def of(self, text: str) -> bytes:
        return b"".join(map(self.held.__getitem__, self.cut(text)))


class WordIds:
    """Ids of whole texts by a vocabulary of lower-case words, which drops white space, so that texts may be cut at spaces and line ends."""

    def __init__(self, path: str):
        self.pieces = Pieces(path, WordBpe.SPLIT)
        self.special = [t.content for t in self.pieces.library.get_added_tokens_decoder().values()]
        self.chunks = Held(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        text = lowered(chunk)
        if text.isalpha():  # one piece
            return self.pieces.held[text]
        mark = self.pieces.marks.get(text[-1:])
        if mark and text[:-1].isalpha():
            return self.pieces.held[text[:-1]] + mark
        if any(map(chunk.__contains__, self.special)):
            return array("I", self.pieces.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        return self.pieces.of(text)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null as empty), and where each text's ids end."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        pool, start, size = pooled(self.chunks.of(strings(chunks.dictionary)))
        at = chunks.indices.to_numpy()
        ids, ends = taken(pool, start[at], size[at])
        return ids, np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy())]


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, A-Z as lower case and between ASCII white space; the place among them of each word in turn; and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[full.to_numpy(zero_copy_only=False)]
    words = flat.filter(full).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.bincount(text, minlength=len(texts))


class SpacedWords:
    """Ids of words, each with a space before it, by a byte-level vocabulary; after a text comes an end, the vocabulary's last id."""

    def __init__(self, path: str):
        self.pieces = Pieces(path, ByteBpe.SPLIT)
        self.words = Held(self._word)
        vocabulary = self.pieces.library.get_vocab(with_added_tokens=True)
        if not vocabulary.keys() >= set(self.pieces.stands.values()):
            raise ValueError("a vocabulary without some bytes does not tell all words apart")
        self.size = max(vocabulary.values()) + 1
        self.end = self.size - 1
        self.begins = np.zeros(self.size, bool)  # ids that begin a word
        self.begins[[i for t, i in vocabulary.items() if t.startswith(self.pieces.stands[32])] + [self.end]] = True

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # one piece
            return self.pieces.plain(self.pieces.stands[32] + word) if word.isascii() else self.pieces.ids(" " + word)
        mark, stem = self.pieces.marks.get(word[-1:]), word[:-1]
        if mark and stem.isalpha():
            return self.words.of([stem])[0] + mark
        return self.pieces.of(" " + word)

    def stream(self, words: list[str], at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of such words (`words_in`), each text's followed by the end, and how many each text has."""
        pool, start, size = pooled(self.words.of(words))
        ids, ends = taken(pool, start[at], size[at])
        ends = np.concatenate([[0], ends])[np.cumsum(count)]
        return np.insert(ids.astype("i4"), ends, self.end), np.diff(ends, prepend=0) + 1
