"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of symbols. A heap holds every adjacent pair
that has a merge rule, by rank and then position; the lowest is popped, its two
symbols become one and the pairs on both sides are pushed. An entry whose
symbols have changed meanwhile is skipped. The number of tokens is the number
of initial symbols minus the number of merges, so no identifier is looked up.

White space always ends a word in the tokenizer at hand, so a text's count is
the sum over its white-space separated chunks. Frequent chunks are remembered
per worker in a table of bounded size.

Null text counts as the empty text: no bytes, no tokens. Very long texts and
very long words are counted whole; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from .rows import map_rows

#: Most words and most chunks that a worker remembers (about 100 MB each), and
#: the longest of them.
REMEMBERED = 700_000
REMEMBERED_CHARS = 64

# fixed values of the byte-level alphabet: bytes that stand for themselves
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    """Byte to character: printable bytes as they are, the others from 256 on."""
    others = [b for b in range(256) if b not in set(_PLAIN)]
    return {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """The merge rules: rank by adjacent pair, and the symbol that a merge makes.

    Symbols are numbered for this purpose only; no vocabulary is involved.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.number: dict[str, int] = {}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, (left, right) in enumerate(pairs):
            self.rank[self.symbol(left) << 32 | self.symbol(right)] = i
            self.made.append(self.symbol(left + right))

    def symbol(self, text: str) -> int:
        return self.number.setdefault(text, len(self.number))

    def count(self, symbols: list[int]) -> int:
        """How many merges byte-pair encoding makes in a word of these symbols."""
        rank, made, size = self.rank.get, self.made, len(symbols)
        # a heap entry is rank * size + position: lowest rank first, then leftmost
        heap = []
        for i in range(size - 1):
            r = rank(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                heap.append(r * size + i)
        if not heap:
            return 0
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        now = [*symbols, -1]  # -1: merged into the symbol before, or the end
        after, before = list(range(1, size + 2)), list(range(-1, size))
        merges = 0
        while heap:
            r, i = divmod(pop(heap), size)
            j = after[i]
            if now[i] < 0 or j >= size or rank(now[i] << 32 | now[j]) != r:
                continue  # the pair has changed since
            symbol = now[i] = made[r]
            now[j] = -1
            k = after[i] = after[j]
            before[k] = i
            merges += 1
            if k < size:
                r = rank(symbol << 32 | now[k])
                if r is not None:
                    push(heap, r * size + i)
            h = before[i]
            if h >= 0:
                r = rank(now[h] << 32 | symbol)
                if r is not None:
                    push(heap, r * size + h)
        return merges


class WordBpe:
    """Counts tokens as the tokenizer of a word-end BPE file gives them.

    Handles what such files use: NFC, white space, lower case, a splitting
    pattern, byte-level symbols with a word-end suffix, and special strings,
    which stand for one token each wherever a text has them.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges([tuple(m) for m in model["merges"]])
        suffix, alphabet = model["end_of_word_suffix"] or "", byte_alphabet()
        self.inner = [self.merges.symbol(alphabet[b]) for b in range(256)]
        self.final = [self.merges.symbol(alphabet[b] + suffix) for b in range(256)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.hints = special
        self.words = _Remembered(self.word)
        self.chunks = _Remembered(self.chunk)

    def chunk(self, chunk: str) -> int:
        """Tokens of normalised text without white space."""
        return sum(map(self.words.__getitem__, self.pattern.findall(chunk)))

    def word(self, word: str) -> int:
        data = word.encode("utf-8")
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]
        return len(symbols) - self.merges.count(symbols)

    def count(self, text: str) -> int:
        if any(h in text for h in self.hints):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        # lower case is taken letter by letter: no word-final form of sigma
        text = unicodedata.normalize("NFC", text)
        for capital, small in _LOWER.items():
            text = text.replace(capital, small)
        text = text.lower()
        if _SEPARATORS.search(text):
            chunks = _SPACE.split(text)  # str.split() would also split at these
        else:
            chunks = text.split()
        return sum(map(self.chunks.__getitem__, chunks))


# fixed values: capitals whose small letters the tokenizer takes from another
# form or a later Unicode version than Python does
_LOWER = {"Σ": "σ", "\ua7cb": "\u0264", "\ua7dc": "\u019b"}
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


class _Remembered(dict):
    """Results by chunk, up to a bound; what is not kept is counted again."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, chunk: str) -> int:
        tokens = self.count(chunk)
        if len(self) < REMEMBERED and len(chunk) <= REMEMBERED_CHARS:
            self[chunk] = tokens
        return tokens


_loaded: dict[str, WordBpe] = {}


def counter(path: str) -> WordBpe:
    """The worker's counter for a file; it stays for the worker's next tasks."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""

    def work():
        bpe = counter(path)

        def do(rows):
            out = []
            for (text,) in rows:
                text = text or ""
                tokens = bpe.count(text)
                out.append((len(text.encode("utf-8")), tokens, tokens > limit))
            return out

        return do

    return map_rows(docs, [text_col], "n_bytes long, n_tokens long, over_limit boolean", work,
                    keep=[id_col])
