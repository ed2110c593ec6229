"""Ids of a byte-level vocabulary, as the tokenizers library gives them.

A space before anything but white space always begins a new word there, so what
lies between two such borders is encoded once and remembered. Plain words go
through the vocabulary's ranks; scripts whose letters depend on a Unicode
version, special tokens and very long words go through the library itself.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

from sieveline.llm.bpe import byte_letters, vocab_path
from sieveline.llm.common import kept_in_worker

VOCAB = "byte_bpe_50k.json"
REMEMBERED_BYTES = 160 << 20
"""Memory for remembered words of a worker, about; beyond it they are learned anew."""

# Fixed value: the split pattern of the vocabulary's byte-level pre-tokenizer
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENTRY_BYTES = 200
_LONG = 4096
_MARKS = ".,;:!?"
_BORDER = re.compile(r" (?=\S)")
_NO_BORDER = re.compile(r" (?:\s|\Z)")
_OTHER_SCRIPT = re.compile("[^\\x00-ɏ‐-‧€]")


class ByteBpe(dict):
    """Ids (little-endian 32-bit) by the word that follows a space; missing words are encoded."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            source = file.read()
        spec = json.loads(source)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_str(source)
        bytes_of = {letter: byte for byte, letter in byte_letters().items()}
        ranks = {bytes(map(bytes_of.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.ranks = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.room = REMEMBERED_BYTES

    def piece(self, text: str) -> bytes:
        """Ids of a text that the split pattern leaves whole."""
        return array("I", self.ranks._core_bpe.encode_single_piece(text.encode())).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if len(text) > _LONG or _OTHER_SCRIPT.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters.isascii() and letters.isalpha() and len(letters) <= _LONG:  # marks after letters are a word of their own
            marks = word[len(letters) :]
            ids = self[letters] + self.plain(marks) if marks else self.piece(" " + word)
        else:
            ids = self.plain(" " + word)
        if len(word) <= _LONG:
            self.room -= _ENTRY_BYTES + len(word) + len(ids)
            if self.room < 0:
                self.clear()
                self.room = REMEMBERED_BYTES
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = _BORDER.split(text) if _NO_BORDER.search(text) else text.split(" ")
        return self.plain(words[0]) + b"".join(map(self.__getitem__, words[1:]))


_LOADED: dict[str, ByteBpe] = kept_in_worker()


def byte_bpe(vocab: str = VOCAB) -> ByteBpe:
    """The vocabulary, loaded once per worker."""
    if vocab not in _LOADED:
        _LOADED[vocab] = ByteBpe(vocab_path(vocab))
    return _LOADED[vocab]
