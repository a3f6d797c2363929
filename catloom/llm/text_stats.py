"""Rule statistics of one text, from its UTF-8 bytes; shared by the quality operators."""

from __future__ import annotations

from collections import Counter

CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = b"0123456789"
SPACES = b" \t\n\r\x0b\x0c"
ENDS = b".!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares and means only: none grows with the length of the text by itself.
FEATURES = (
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "end_share",
    "distinct_share", "top_word_share", "bar_share", "shout_share", "line_words",
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window occurring twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, free_from = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, free_from)
            free_from = at + 3
    return covered


def base_stats(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words and the five base statistics."""
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return words, (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words))


def features(text: bytes, words: list[bytes], base: tuple[int, int, int, int, int]) -> tuple[float, ...]:
    """Values of ``FEATURES``; all zero for a text without words."""
    n, chars, symbols, dup_lines, repeats = base
    if not n:
        return (0.0,) * len(FEATURES)

    def share(kinds: bytes) -> float:
        return (len(text) - len(text.translate(None, kinds))) / size

    size = max(1, chars)
    lines = max(1, text.count(b"\n") + 1)
    counts = Counter(words)
    return (
        chars / n, symbols / size, dup_lines / lines, repeats / n, share(UPPER), share(DIGITS), share(ENDS),
        # of the words that a text of this length could have once: long texts repeat common words
        len(counts) / n ** 0.8, (max(counts.values()) - 1) / n, words.count(b"|") / n, text.count(b"!!") / n,
        min(n / lines, 200.0),
    )
