"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised items recognises every run of words that
occurs in some item. A document is streamed through it word by word, tracking
the longest run that ends at the word. A word is *hit* if it lies in an
occurrence of an item's window: ``window`` consecutive words, or a whole item
of fewer words. Wherever the longest run reaches ``window``, its last
``window`` words are such an occurrence; whole short items are found by the
automaton's suffix links.

Items are read in blocks of bounded size, one automaton each, so neither the
driver nor a task ever holds more than one block's items (times the number of
blocks that fit a stage's Python workers); rows pass through the blocks one
after the other and never move between tasks.

Defined cases: null or wordless texts have no words and are never
contaminated; null or wordless items are no items; rows of items that share an
id count as one item; items without an id take part in the hits but not in the
list of items. Rows of documents are judged one by one, repeated ones too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

WINDOW = 13
#: Most bytes of item text in one automaton (about 100 bytes of memory each).
BLOCK_BYTES = 2_000_000

# lower-case A-Z, keep digits, letters and everything beyond ASCII, part words elsewhere
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def spans_of_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of every word, in bytes of the UTF-8 text."""
    folded = text.encode("utf-8").translate(_FOLD)
    spans, at = [], 0
    for word in folded.split():
        start = folded.index(word, at)
        at = start + len(word)
        spans.append((start, at))
    return spans


class ItemAutomaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        items = [(name, words) for name, words in items if words]
        self.shortest = min((min(len(w), window) for _, w in items), default=0)
        self.vocabulary = frozenset(word for _, words in items for word in words)
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: state -> items with a window that ends there
        self.windows: dict[int, set[str | None]] = {}
        self.whole: dict[int, set[str | None]] = {}
        for name, words in items:
            for state, size in self._walk(words):
                if size >= window:
                    self.windows.setdefault(self._window_state(state), set()).add(name)
            if len(words) < window:
                self.whole.setdefault(state, set()).add(name)
        self.short_above = self._short_above()

    def _extend(self, last: int, word: bytes) -> int:
        known = self.step[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            target = self.step[at][word]
            fits = self.length[target] == self.length[at] + 1
            self.link[new] = target if fits else self._split(at, word, target)
        return new

    def _split(self, at: int, word: bytes, target: int) -> int:
        """A state of its own for the shorter runs of ``target``."""
        part = self._state(self.length[at] + 1)
        self.step[part] = dict(self.step[target])
        self.link[part] = self.link[target]
        self.link[target] = part
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = part
            at = self.link[at]
        return part

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _walk(self, words):
        """(state, longest length) after each word."""
        state = size = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            following = self.step[state].get(word)
            if following is None:
                state = size = 0
            else:
                state, size = following, size + 1
            yield state, size

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a longer run."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_above(self) -> list[int]:
        """For each state the next state of a whole short item on its links, itself excluded."""
        above = [0] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            parent = self.link[state]
            above[state] = parent if parent in self.whole else above[parent] if parent > 0 else 0
        return above

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit spans of word positions (merged, end exclusive) and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if not self.shortest:
            return spans, items
        for start, end in self._runs(words):
            position = start
            for state, size in self._walk(words[start:end]):
                position += 1
                covered = 0
                if size >= self.window:
                    covered = self.window
                    items |= self.windows[self._window_state(state)]
                short = state if state in self.whole and size == self.length[state] \
                    else self.short_above[state]
                while short:
                    covered = max(covered, self.length[short])
                    items |= self.whole[short]
                    short = self.short_above[short]
                if covered:
                    first = position - covered
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, position))
        return spans, items

    def _runs(self, words):
        """Runs of item words that are long enough for any window; all else resets the match."""
        known = self.vocabulary
        start = None
        for i, word in enumerate(words):
            if word in known:
                if start is None:
                    start = i
            elif start is not None:
                if i - start >= self.shortest:
                    yield start, i
                start = None
        if start is not None and len(words) - start >= self.shortest:
            yield start, len(words)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping spans become one."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(s) for s in merged]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in blocks; each is read by itself, so the driver holds one at a time."""
    named = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    named = named.filter(F.col("text").isNotNull())
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        mine = named.filter(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == block)
        yield [(r["name"], words_of(r["text"])) for r in mine.toLocalIterator()]


_built: dict[str, ItemAutomaton] = {}


def _automaton(block: str, items: list, window: int, blocks: int) -> ItemAutomaton:
    """Built once per worker and block."""
    if block not in _built:
        while len(_built) >= blocks:  # automata of earlier calls
            _built.pop(next(iter(_built)))
        _built[block] = ItemAutomaton(items, window)
    return _built[block]


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with n_words, spans and items (which replace columns so named).

    ``spans``: hit words as ``[start, end)`` word positions; ``items``: ids of
    the items with an occurring window, sorted as strings.
    """
    context = docs.sparkSession.sparkContext
    found = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<array<bigint>>"),
        "items": F.array().cast("array<string>")})
    for items_of_block in _blocks(items, item_id, item_text, block_bytes):
        shared, name = context.broadcast(items_of_block), uuid.uuid4().hex

        def work(shared=shared, name=name):
            automaton = _automaton(name, shared.value, window, 1)

            def do(rows):
                out = []
                for text, spans, names in rows:
                    words = words_of(text)
                    more, new = automaton.hits(words)
                    if more:
                        spans = merge_spans([tuple(s) for s in spans] + more)
                        names = sorted({*names, *(n for n in new if n is not None)})
                    out.append((len(words), [list(s) for s in spans], names))
                return out

            return do

        found = map_rows(found, [text_col, "spans", "items"],
                         "n_words long, spans array<array<bigint>>, items array<string>", work)
    return found


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def is_contaminated(most: int = 20) -> Column:
    """At least one word in ``most`` is hit."""
    return (n_hit() > 0) & (n_hit() * most >= F.col("n_words"))


def cut_text(text: str, spans: list[list[int]], longest: int) -> str:
    """The text without hit spans of ``longest`` or more words."""
    if not text or not spans:
        return text
    data, words = text.encode("utf-8"), spans_of_words(text)
    kept, at = [], 0
    for start, end in spans:
        if end - start >= longest:
            kept.append(data[at:words[start][0]])
            at = words[end - 1][1]
    return b"".join([*kept, data[at:]]).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  most: int = 20, longest: int | None = None) -> DataFrame:
    """Every row of ``docs`` with n_words, spans, items, n_hit, contaminated, clean_text.

    ``clean_text`` is null for a contaminated row (the coverage limit). In other
    rows hit spans of ``longest`` or more words are cut out; None cuts nothing.
    """
    found = find_hits(docs, items, text_col, item_id, item_text, window)
    found = found.withColumn("n_hit", n_hit()).withColumn("contaminated", is_contaminated(most))
    clean = F.col(text_col)
    if longest is not None:
        cut = F.udf(lambda text, spans: cut_text(text, spans, longest), "string")
        clean = F.when(F.size("spans") > 0, cut(text_col, "spans")).otherwise(clean)
    return found.withColumn("clean_text", F.when(~F.col("contaminated"), clean))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    judged = decontaminate(packed, items, "text", **options)
    return judged.filter(~F.col("contaminated")).select("row.*")
