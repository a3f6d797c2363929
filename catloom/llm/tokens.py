"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words kept per worker process. The memory is bounded; a word that is not kept is encoded again.
CACHE_WORDS = 1_000_000
#: White space beside the blank and the line break; a text that holds any goes through the tokenizer whole.
_OTHER_SPACE = [chr(c) for c in range(0x110000) if chr(c).isspace() and c not in (10, 32)] + ["\u180e", "\ufeff"]
_BESIDE = ("  ", "\n\n", " \n", "\n ")


def uneven(text: str) -> bool:
    """True unless all white space is single inner blanks and line breaks."""
    if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return bool(text)
    return any(map(text.__contains__, _BESIDE)) or any(map(text.__contains__, _OTHER_SPACE))


#: Pre-token pattern of the byte-level vocabulary (a fixed value of that public format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """``ids(text)`` equals the tokenizer's own ids without special tokens.

    The pre-token pattern cuts at every blank before a non-blank and around a single line break, so a text
    whose white space is only that is the concatenation of its words' ids, each word carrying the blank in
    front of it. Any other text is given to the tokenizer whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.pattern = regex.compile(PRE_TOKEN)
        self.alphabet = byte_alphabet()
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.newline = self._piece("\n")
        self.marks = {mark: self._piece(mark) for mark in ".,"}

    def _keep(self, key: str, value: bytes) -> bytes:
        if len(self.words) >= self.cache_words:
            self.words.clear()
        self.words[key] = value
        return value

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _encode(self, word: str) -> bytes:
        return b"".join([self._piece(p) for p in self.pattern.findall(word)])

    def _first(self, word: str) -> bytes:
        """The word that begins a line; its key holds a line break, so it never meets the key of a later word."""
        key = "\n" + word
        return self.words.get(key) or self._keep(key, self._encode(word))

    def _word(self, word: str) -> bytes:
        """A word that follows a blank. Letters are one pre-token, and so is a point or comma after them."""
        if word.isalpha():
            return self._keep(word, self._piece(" " + word))
        stem, mark = word[:-1], self.marks.get(word[-1])
        if mark and stem.isalpha():
            return self._keep(word, (self.words.get(stem) or self._word(stem)) + mark)
        return self._keep(word, self._encode(" " + word))

    def packed(self, text: str) -> bytes:
        """Little-endian ids of ``dtype``."""
        if not text:
            return b""
        if uneven(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        get, out = self.words.get, []
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(self.newline)
            first, *rest = line.split(" ")
            out.append(self._first(first))
            found = list(map(get, rest))
            if None in found:
                found = [f if f is not None else get(w) or self._word(w) for f, w in zip(found, rest, strict=True)]
            out += found
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One per worker process, so that words stay known from task to task."""
    if (path, cache_words) not in _ENCODERS:
        _ENCODERS[path, cache_words] = Encoder(path, cache_words)
    return _ENCODERS[path, cache_words]


def texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]
