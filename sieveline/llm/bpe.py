"""BPE encoding and decoding by prefix-sharing trie traversal.

Every prefix of a word ends in one token of the prefix's own encoding, and that
token together with the state of the shorter prefix gives the whole encoding.
So the distinct words of a block go into a trie, a depth-first walk carries the
last token of each prefix, and words that share a prefix share its states. The
last token of a longer prefix is the one whose left neighbour survives beside
it; whether two tokens survive side by side is decided on their merge trees.

Nulls are empty texts, and an empty text has no ids and the empty decoding.
Repeated rows give repeated results; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sieveline.llm.common import blocks, kept_in_worker, pick

VOCAB = "word_bpe_49k.json"
KNOWN_WORDS = 400_000
"""Encodings that a worker keeps of the latest words, twice: the current and the ones before."""

# The tokenizer file's own split pattern, end-of-word mark and white space
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PYTHON_SPACE = "\x1c\x1d\x1e\x1f"  # separates words to Python, not to the vocabulary

_NEVER = 1 << 60
_DEEP = 200


def vocab_path(vocab: str) -> str:
    """A file's path as given, or the place of a public vocabulary of that name."""
    if "/" in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent:
    """Ids by text, for about the `most` latest texts; what is asked for again stays."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Which of these are not known; those that are lie in `now` afterwards."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        out = []
        for text in wanted.difference(now):
            ids = before.get(text)
            if ids is None:
                out.append(text)
            else:
                now[text] = ids
        return out


class WordBpe:
    """A vocabulary with its merge trees, and the encodings of words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            source = file.read()
        spec = json.loads(source)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for piece, i in [*self.ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        self.letters = byte_letters()
        self.library = Tokenizer.from_str(source)
        self._grow(spec)
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        self.space = regex.compile(f"[{SPACE}]+")
        self.known = Recent(KNOWN_WORDS)  # of parts between white space
        self.spelt = Recent(KNOWN_WORDS)  # of words

    def _grow(self, spec: dict) -> None:
        """Merge trees of the pieces, and the pieces that their own merges build."""
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for at, (left, right) in enumerate(spec["model"]["merges"]):
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = at
            self.halves[self.ids[left + right]] = pair
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for piece, i in self.ids.items():
            if i in self.halves and not self.stable(*self.halves[i], apart=False):
                continue  # its own merges never build it
            if piece.endswith(WORD_END):
                self.final[piece.removesuffix(WORD_END)] = i
            else:
                self.inner[piece] = i
        self.longest = max(map(len, [*self.inner, *self.final]))

    def spine(self, token: int) -> tuple[list, list]:
        """(token, rank at which it is absorbed) down the left edge and down the right edge of its merge tree."""
        if token not in self.spines:
            edges = []
            for side in (0, 1):
                edge, at, until = [], token, _NEVER
                while True:
                    edge.append((at, until))
                    if at not in self.halves:
                        break
                    until = self.rank[self.halves[at]]
                    at = self.halves[at][side]
                edges.append(edge)
            self.spines[token] = edges[0], edges[1]
        return self.spines[token]

    def stable(self, left: int, right: int, apart: bool = True) -> bool:
        """Whether no merge ever crosses the border of two neighbours.

        A crossing merge takes place if it comes before both sides are absorbed
        into their own trees; at equal rank the occurrence further left goes first.
        `apart=False` lets the two whole tokens merge with each other.
        """
        for x, x_until in self.spine(left)[1]:
            for y, y_until in self.spine(right)[0]:
                at = self.rank.get((x, y))
                if at is not None and at < x_until and at <= y_until and (apart or (x, y) != (left, right)):
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words (in byte letters, without end marks), by one walk over their trie.

        Words in sorted order are the leaves of their trie from left to right, so
        the path from the root is a stack: the letters shared with the word before
        stay on it with the states of their prefixes, and the rest is replaced.
        A state is worked out when a token that begins there asks for it.
        """
        out: dict[str, bytes] = {}
        inner, final, longest, pairs, stable = self.inner, self.final, self.longest, self.pairs, self.stable
        if len(pairs) > KNOWN_WORDS:
            pairs.clear()
        tokens: list[int] = [0]  # last token of each prefix on the path, -1 while unknown
        starts = [0]  # and where it begins

        def state(depth: int) -> int:
            for start in range(depth - longest if depth > longest else 0, depth):
                token = inner.get(word[start:depth])
                if token is not None:
                    if start:
                        left = tokens[start]
                        if left < 0:
                            left = state(start)
                        pair = left << 32 | token
                        fits = pairs.get(pair)
                        if fits is None:
                            fits = pairs[pair] = stable(left, token)
                        if not fits:
                            continue
                    tokens[depth], starts[depth] = token, start
                    return token
            raise ValueError(f"the vocabulary cannot spell {word[:depth]!r}")

        before = ""
        for word in sorted(words):
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            before = word
            del tokens[shared + 1 :], starts[shared + 1 :]
            tokens += [-1] * (n - len(tokens))
            starts += [0] * (n - len(starts))
            if n > _DEEP:  # prefixes in turn, lest the states ask for each other too deeply
                for depth in range(1, n):
                    if tokens[depth] < 0:
                        state(depth)
            for start in range(n - longest if n > longest else 0, n):  # the last letter carries the end mark
                token = final.get(word[start:])
                if token is not None:
                    if not start:
                        break
                    left = tokens[start]
                    if left < 0:
                        left = state(start)
                    pair = left << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = stable(left, token)
                    if fits:
                        break
            else:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            ids = [token]
            while start:
                ids.append(tokens[start])
                start = starts[start]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def _words(self, part: str) -> list[str]:
        """A separated part, normalised and split as the vocabulary asks, in byte letters."""
        if part.isascii():
            if part.isalpha():
                return [part.lower()]
            if part.isprintable():
                return self.split(part.lower())
        if _OTHER_SCRIPT.search(part):  # letters and marks there depend on the library's Unicode version
            plain = self.library.normalizer.normalize_str(part)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        plain = unicodedata.normalize("NFC", part).lower()
        words = [plain] if plain.isalpha() else self.split(plain)
        return [w.encode().decode("latin-1").translate(self.letters) for w in words]

    def learn(self, texts: list[list[str]]) -> None:
        """Put the ids of all separated parts of these texts into `known`."""
        fresh: set[str] = set()
        for parts in texts:
            fresh.update(parts)
        alone: dict[str, str] = {}  # parts that are one word of plain letters
        split: dict[str, list[str | int]] = {}
        for part in self.known.missing(fresh):
            if part.isascii() and part.isalpha():
                alone[part] = part.lower()
            else:
                split[part] = self._spelled(part)
        words = set(alone.values())
        for spelled in split.values():
            words.update([w for w in spelled if isinstance(w, str)])
        fresh_words = self.encode_words(self.spelt.missing(words))
        of, known = self.spelt.now, self.known.now
        of.update(fresh_words)
        known.update({part: of[word] for part, word in alone.items()})
        for part, spelled in split.items():
            if len(spelled) == 1 and isinstance(spelled[0], str):
                known[part] = of[spelled[0]]
            else:
                known[part] = b"".join([of[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in spelled])

    def _spelled(self, part: str) -> list[str | int]:
        """Words of a separated part, and the ids of special tokens in it."""
        if "<|" not in part or not self.cut.search(part):
            return self._words(part)
        spelled: list[str | int] = []
        at = 0
        for hit in self.cut.finditer(part):
            spelled += [*self._words(part[at : hit.start()]), self.special[hit.group()]]
            at = hit.end()
        return spelled + self._words(part[at:])

    def separate(self, text: str) -> list[str]:
        """Parts between white space; these never share a token."""
        for mark in PYTHON_SPACE:
            if mark in text:
                return [p for p in self.space.split(text) if p]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        parts = [self.separate(t) for t in texts]
        self.learn(parts)
        known = self.known.now
        return [b"".join([known[p] for p in ps]) for ps in parts]

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return " ".join([pieces[i] for i in np.frombuffer(ids, "<i4").tolist()])


class LibraryBpe(WordBpe):
    """The same ids without the trie: distinct words go through the library's own model."""

    def _grow(self, spec: dict) -> None:
        pass

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        tokenize = self.library.model.tokenize
        return {word: array("i", [t.id for t in tokenize(word)]).tobytes() for word in words}


_OTHER_SCRIPT = regex.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")
_LOADED: dict[str, WordBpe] = kept_in_worker()
_LIBRARY: dict[str, LibraryBpe] = kept_in_worker()


def word_bpe(vocab: str = VOCAB) -> WordBpe:
    """The vocabulary, loaded once per worker."""
    if vocab not in _LOADED:
        _LOADED[vocab] = WordBpe(vocab_path(vocab))
    return _LOADED[vocab]


def library_bpe(vocab: str = VOCAB) -> LibraryBpe:
    """The vocabulary with the library's model, loaded once per worker."""
    if vocab not in _LIBRARY:
        _LIBRARY[vocab] = LibraryBpe(vocab_path(vocab))
    return _LIBRARY[vocab]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB) -> DataFrame:
    """`id_col`, `ids` and `decoded` of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocab)
        for block in blocks(batches, "text"):
            ids = bpe.encode([t or "" for t in block.column("text").to_pylist()])
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.record_batch(
                [
                    block.column("id"),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                    pa.array([bpe.decode(x) for x in ids], pa.string()),
                ],
                names=["id", "ids", "decoded"],
            )

    rows = pick(df, id_col, text_col).toDF("id", "text")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
