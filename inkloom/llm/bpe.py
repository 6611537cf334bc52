"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merge rules produce.  It
starts as one state with a loop for every atom.  Each merge (u, v) -> w, in order of
rank, adds a gadget: a new state, which is the state after u without its arc for v,
becomes the state after u; and w leads, from wherever u leads, to the state after v.
So one state is the last copy for each token, the copies before it differ from it by the
arcs that gadgets of later rank took, and a gadget is held as its rank alone.  An arc is
decided by going back through the gadgets that touched either of its ends; decided arcs
are kept in a transition table.  The accepted path that spells a word is unique, so a
depth-first walk finds the encoding: at each place the longest label that the table of
label beginnings gives, and then, by a table of fallbacks, ever shorter ones.  Decoding
joins labels.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array

import regex

#: Ends a word in vocabularies whose tokens mark word ends; no byte maps to it.
WORD_END = "Ā"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of every byte in byte-level vocabulary files."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    spare = 0x100
    for b in range(256):
        if chr(b) not in out:
            out[chr(spare)] = b
            spare += 1
    return out


class MergeAutomaton:
    """tokens: label -> id; merges: pairs of labels by rank."""

    #: Decided arcs held at once (about 100 bytes each).
    MOST_ARCS = 400_000

    def __init__(self, tokens: dict[str, int], atoms: list[str], merges: list[tuple[str, str]]):
        self.ids: dict[str, int] = {a: tokens[a] for a in atoms if a in tokens}
        size = max(tokens.values()) + 1
        self.made = [-1] * size  # rank at which a token appeared
        self.parts = [(-1, -1)] * size  # what a merged token was made of
        self.gadgets: dict[int, int] = {}  # (u, v) -> rank
        self.arcs: dict[int, bool] = {}
        ids = self.ids
        for rank, (u, v) in enumerate(merges):
            a, b = ids.get(u), ids.get(v)
            w = tokens.get(u + v)
            if a is None or b is None or w is None:
                continue
            if u + v in ids:
                raise ValueError("two merges make the same token")
            if not self.leads(a, b):
                continue
            self.gadgets[a << 20 | b] = rank
            self.made[w], self.parts[w] = rank, (a, b)
            ids[u + v] = w
        self.begins: dict[str, int] = {}  # the longest token that a beginning of a label begins with
        self.shorter, self.sizes = [-1] * size, [0] * size
        for label, token in sorted(ids.items(), key=lambda x: len(x[0])):
            best = -1
            for n in range(1, len(label)):
                best = self.begins[label[:n]] = ids.get(label[:n], best)
            self.begins[label] = token
            self.shorter[token], self.sizes[token] = best, len(label)

    def leads(self, a: int, b: int) -> bool:
        """Whether the state after token a has an arc for token b: whether no gadget among the copies behind both took it."""
        gadgets, made, parts, before = self.gadgets, self.made, self.parts, len(self.made) << 8
        while True:
            rank = gadgets.get(a << 20 | b)
            if rank is not None and rank < before:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[b] > made[a]:  # copies up to b's making know it as its first part
                before = min(before, made[b] + 1)
                b = parts[b][0]
            else:  # a's state began as that after its second part
                before = min(before, made[a])
                a = parts[a][1]

    def encode(self, word: str) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        begins, arcs, sizes, shorter, n = self.begins.get, self.arcs, self.sizes, self.shorter, len(word)
        out: list[int] = []
        dead: set[int] = set()
        last, at, token = -1, 0, None
        while at < n:
            if token is None:
                token, end = begins(word[at], -1), at + 2
                while end <= n:
                    longer = begins(word[at:end])
                    if longer is None:
                        break
                    token = longer
                    end += 1
            while token >= 0:
                if last < 0:
                    free = True
                else:
                    free = arcs.get(last << 20 | token)
                    if free is None:
                        if len(arcs) >= self.MOST_ARCS:
                            arcs.clear()
                        free = arcs[last << 20 | token] = self.leads(last, token)
                if free and not (dead and at + sizes[token] in dead):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                last, token = token, None
            else:
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token, last = shorter[token], out[-1] if out else -1
        return out


class Chunks(dict):
    """Encodings of chunks up to a length: those used since the last change of generation, and one generation before; held entries are bounded in number and size."""

    def __init__(self, encode, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.encode, self.most, self.longest, self.before = encode, most, longest, {}

    def __missing__(self, chunk) -> bytes:
        out = self.before.get(chunk)
        if out is None:
            out = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[chunk] = out
        return out


def load(path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    back = byte_alphabet()
    mark = model.get("end_of_word_suffix") or ""

    def label(token: str) -> str:
        end = bool(mark) and token.endswith(mark) and len(token) > len(mark)
        body = token[: -len(mark)] if end else token
        return "".join(chr(back[c]) for c in body) + WORD_END * end

    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = {label(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(label(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    atoms = [chr(b) for b in range(256)] + ([chr(b) + WORD_END for b in range(256)] if mark else [])
    return MergeAutomaton(tokens, atoms, merges), special


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else b"".join([i.to_bytes(4, "little") for i in ids])


class ByteBpe:
    """Ids and texts of a byte-level vocabulary (spaces belong to the following word)."""

    # fixed values: the pre-splitting pattern of byte-level vocabularies
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

    def __init__(self, path: str):
        self.automaton, self.special = load(path)
        self.words = regex.compile(self.SPLIT).findall
        self.run = regex.compile(r"\p{White_Space} (?:\p{White_Space}|$)").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.word_ids = Chunks(self._word)
        self.chunk_ids = Chunks(lambda chunk: self._plain(" " + chunk))
        self.labels: list[bytes] = [b""] * len(self.automaton.made)
        for text, i in self.automaton.ids.items():
            self.labels[i] = text.encode("latin-1")
        for text, i in self.special.items():
            self.labels[i:] = self.labels[i:] or [b""]
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = text.encode()

    def _word(self, word: str) -> bytes:
        return packed(self.automaton.encode(word.encode().decode("latin-1")))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, self.words(text)))

    def _piece(self, text: str) -> bytes:
        if self.run(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.chunk_ids.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut and any(x in text for x in self.special):
            return b"".join(packed([self.special[x]]) if x in self.special else self._piece(x) for x in self.cut(text) if x)
        return self._piece(text) if text else b""

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that the ids spell; broken sequences become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace").encode()


class WordBpe:
    """Ids of a vocabulary of lower-case words with marked ends; white space is dropped."""

    # fixed values: the pre-splitting pattern of word-end vocabularies
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str):
        self.automaton, self.special = load(path)
        self.words = regex.compile(self.SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.word_ids = Chunks(self._word)
        self.chunk_ids = Chunks(self._chunk)

    def _word(self, word: str) -> bytes:
        return packed(self.automaton.encode(word.encode().decode("latin-1") + WORD_END))

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():  # one word
                return self.word_ids[text]
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        return b"".join(map(self.word_ids.__getitem__, self.words(text)))

    def _piece(self, text: str) -> bytes:
        return b"".join(map(self.chunk_ids.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        if self.cut and any(x in text for x in self.special):
            return b"".join(packed([self.special[x]]) if x in self.special else self._piece(x) for x in self.cut(text) if x)
        return self._piece(text)


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One automaton per worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
