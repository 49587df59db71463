"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The different words of a group of texts lie one after another in one flat array
of symbols. A round looks up the rank of every adjacent pair, takes the lowest
rank of each word, merges its occurrences in all words at once and compacts the
array; words without a pair leave it. The last round leaves nothing.

The library merges one pair at a time: lowest rank first, leftmost among equals.
A round therefore takes, from the left of each word, the occurrences that do not
overlap, up to and with the first whose merge makes a new pair of the same or a
lower rank, as the library would take that pair next. So every word passes
through the library's own states.

Words are cut where no piece of the vocabulary holds the two characters side by
side: no merge can cross such a place. In the vocabulary at hand this is at least
before each space that follows something else. Pieces made of spaces only have
one rank, the last: the leftmost of them grow to the longest before any other,
so long runs of spaces are cut at that length (checked when a model is read). A
remaining long word costs its length times its rounds.

The model must be BPE with byte fallback, identity normalisation and a space
before the text. Characters without a piece become byte pieces.

Defined cases: null text is the empty text, whose only id is the end id and
which decodes to the empty text. Texts of any length are encoded whole. Repeated
rows give repeated results, other columns pass through, new columns replace those
of the same name.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .rows import map_rows

SPACE = "▁"
NONE = np.int32(2**31 - 1)
CODE_POINTS = 0x110000
#: Most different words, and most of their characters, that a worker remembers
#: before it forgets all, and words looked up at once.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
BLOCK = 200_000
#: What the library writes for the unknown piece.
UNKNOWN = " ⁇ "

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary(NamedTuple):
    """What is needed of a model file; small enough to be sent to every worker."""

    pieces: list[str]
    scores: list[float]
    #: n: normal, b: byte, c: control, u: unknown
    kinds: str
    end: int


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if any(model.is_unused(i) for i in ids):
        raise ValueError("models with unused pieces are not supported")
    kinds = "".join("b" if model.is_byte(i) else "c" if model.is_control(i) else
                    "u" if model.is_unknown(i) else "n" for i in ids)
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids],
                      kinds, model.eos_id())


class Pieces:
    """Encodes and decodes lists of texts; remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        pieces, scores, kinds, self.end = vocabulary
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "n"}
        # symbols: a piece's id; characters that only longer pieces hold; from
        # ``base`` on all other characters, by code point
        symbols = dict(normal)
        for piece in normal:
            for char in piece:
                symbols.setdefault(char, len(pieces) + len(symbols))
        self.base = max(symbols.values(), default=0) + 1
        self.of_char = np.arange(self.base, self.base + CODE_POINTS, dtype=np.int64)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.of_char[ord(text)] = symbol
        self.width = self.base + CODE_POINTS
        self._merges(normal, symbols, scores)
        self._cuts(normal, scores)
        self._surfaces(pieces, kinds)
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_ids[:kinds.count("b")] = [i for i, k in enumerate(kinds) if k == "b"]
        self._check_run()
        self.forget()

    def _merges(self, normal: dict[str, int], symbols: dict[str, int], scores: list[float]) -> None:
        """Sorted keys of all pairs that make a piece, with the piece and its rank."""
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        rows = sorted(
            (symbols[p[:k]] * self.width + symbols[p[k:]], i, ranks[scores[i]])
            for p, i in normal.items() for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols)
        table = np.array([*rows, (2**62, 0, int(NONE))], dtype=np.int64)
        self.keys = np.ascontiguousarray(table[:, 0])
        self.made = np.ascontiguousarray(table[:, 1])
        self.ranks = table[:, 2].astype(np.int32)

    def _cuts(self, normal: dict[str, int], scores: list[float]) -> None:
        """Which characters may lie side by side in a piece, and the length of cut runs."""
        long = [p for p in normal if len(p) > 1]
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in long for c in p}))}
        self.char_class = np.zeros(CODE_POINTS, np.int16)
        self.char_class[[ord(c) for c in chars]] = list(chars.values())
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in long:
            for a, b in zip(p, p[1:], strict=False):
                self.joined[chars[a], chars[b]] = True
        runs = [p for p in long if SPACE * 2 in p]
        lowest = min((scores[i] for i in normal.values()), default=0)
        alike = all(set(p) == {SPACE} and scores[normal[p]] == lowest for p in runs)
        others = any(scores[normal[p]] == lowest for p in long if p not in runs)
        self.run = max(map(len, runs), default=0) if alike and not others else 0

    def _check_run(self) -> None:
        """Cuts no runs unless the longest piece of spaces comes off first, whatever follows.

        Pairs of spaces merge from the left, one after another, and look one symbol
        ahead, so what holds for runs of up to three such pieces holds for all.
        """
        def ids(n: int) -> list[int]:
            return self.merge([SPACE * n])[0].tolist()

        if self.run:
            first = ids(self.run)
            lengths = range(2 * self.run, 3 * self.run + 1)
            if len(first) > 1 or any(ids(n) != first + ids(n - self.run) for n in lengths):
                self.run = 0

    def _surfaces(self, pieces: list[str], kinds: str) -> None:
        """What each id is decoded to, as bytes in one flat array."""
        texts = [bytes([kinds[:i].count("b")]) if k == "b" else b"" if k == "c" else
                 UNKNOWN.encode() if k == "u" else p.replace(SPACE, " ").encode()
                 for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        self.surface = np.frombuffer(b"".join(texts), np.uint8)
        self.surface_len = np.array([len(t) for t in texts], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.spaced = np.array([k == "n" and p.startswith(SPACE)
                                for p, k in zip(pieces, kinds, strict=True)], bool)
        self.control = np.array([k == "c" for k in kinds], bool)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.chars = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(spaced)
        ends = np.cumsum([len(t) for t in spaced], dtype=np.int64)
        starts = self._word_starts(whole, ends)
        words = np.searchsorted(starts, ends)  # words before the end of each text
        ids, sizes = [], []
        for at in range(0, len(starts), BLOCK):
            stops = [*starts[at + 1:at + BLOCK + 1].tolist(), len(whole)]
            block = [whole[a:b] for a, b in zip(starts[at:at + BLOCK].tolist(), stops, strict=False)]
            numbers = self._numbers(block)
            sizes.append(self.sizes[numbers])
            ids.append(_gather(self.flat, (np.cumsum(self.sizes) - self.sizes)[numbers], sizes[-1]))
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])[words]
        return [np.append(part, np.int32(self.end))
                for part in np.split(flat, upto[:-1])] if len(texts) else []

    def _word_starts(self, whole: str, ends: np.ndarray) -> np.ndarray:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64)
        classes = self.char_class[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joined[classes[:-1], classes[1:]]
        cut[ends[ends < len(points)]] = True
        if self.run:
            space = np.concatenate([[False], points == ord(SPACE), [False]])
            # a text's first space follows no other text's last one
            space_cut = np.concatenate([cut, [True]])
            first = np.flatnonzero(space[1:] & (~space[:-1] | space_cut))
            last = np.flatnonzero(space[1:-1] & (~space[2:] | space_cut[1:])) + 1
            first = first[:len(last)]
            # the last two lengths of a run stay whole, next to what follows it
            times = np.maximum((last - first) // self.run - 2, 0)
            step = _gather(np.arange(1, times.max(initial=0) + 1), np.zeros(len(times), np.int64), times)
            cut[np.repeat(first, times) + step * self.run] = True
        return np.flatnonzero(cut)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word in the memory, which learns new ones."""
        known = self.known
        if len(known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
            known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            flat, sizes = self.merge(new)
            self.chars += sum(map(len, new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, ``NONE`` without one, and what the pair makes."""
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words, which are not empty, by rounds."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.of_char[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        while len(sym):
            rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
            rank[:-1], made[:-1] = self._look_up(sym[:-1], sym[1:])
            begins = np.concatenate([[True], word[1:] != word[:-1]])
            rank[:-1][begins[1:]] = NONE
            starts = np.flatnonzero(begins)
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            low = np.repeat(lowest, lengths)
            over = low == NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            at = self._chosen(sym, word, rank, made, low)
            sym = sym.copy()
            sym[at] = made[at]
            over[at + 1] = True  # swallowed
            sym, word = sym[~over], word[~over]
        order_word = np.concatenate(done_word)
        order = np.argsort(order_word, kind="stable")
        return self._ids(np.concatenate(done_sym)[order], order_word[order], len(words))

    def _chosen(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray,
                low: np.ndarray) -> np.ndarray:
        """Where this round merges: see the module's text."""
        at = np.flatnonzero((rank == low) & (low != NONE))
        if not len(at):
            return at
        # of overlapping occurrences every second goes, from the left
        begins = np.concatenate([[True], np.diff(at) != 1])
        at = at[(at - np.repeat(at[begins], np.diff(np.append(np.flatnonzero(begins), len(at))))) % 2 == 0]
        new, of = made[at], word[at]
        # neighbours as they are when its turn comes: the left one may just have been made
        left_at = np.maximum(at - 1, 0)
        left = sym[left_at]
        beside = np.flatnonzero(np.diff(at) == 2) + 1
        left[beside] = new[beside - 1]
        before, _ = self._look_up(left, new)
        before[(at == 0) | (word[left_at] != of)] = NONE
        right_at = np.minimum(at + 2, len(sym) - 1)
        after, _ = self._look_up(new, sym[right_at])
        after[(at + 2 >= len(sym)) | (word[right_at] != of)] = NONE
        better = np.minimum(before, after) <= low[at]
        # occurrences after a word's first such one wait for the next round
        counted = np.cumsum(better) - better
        firsts = np.concatenate([[True], of[1:] != of[:-1]])
        base = np.repeat(counted[firsts], np.diff(np.append(np.flatnonzero(firsts), len(at))))
        return at[counted == base]

    def _ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids; those without a piece as the ids of their bytes."""
        foreign = sym >= len(self.surface_len)
        chars = sym[foreign]
        inner = chars < self.base  # characters that only longer pieces hold
        if inner.any():
            back = {int(self.of_char[c]): c for c in np.flatnonzero(self.of_char < self.base)}
            chars[inner] = [back[s] + self.base for s in chars[inner].tolist()]
        points = chars - self.base
        sizes = np.ones(len(sym), np.int64)
        sizes[foreign] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        ids = np.repeat(sym, sizes).astype(np.int32)
        text = points.astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[np.repeat(foreign, sizes)] = self.byte_ids[np.frombuffer(text, np.uint8)]
        return ids, np.bincount(word, weights=sizes, minlength=n_words).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library decodes them."""
        ids = np.asarray(ids, np.int64)
        raw = _gather(self.surface, self.surface_at[ids], self.surface_len[ids]).tobytes()
        seen = np.flatnonzero(~self.control[ids])
        if len(seen) and self.spaced[ids[seen[0]]]:
            raw = raw[1:]  # the space before the text
        return raw.decode("utf-8", "each_byte")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated parts ``flat[start:start + size]``."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def encode_and_decode(docs: DataFrame, model: str, text_col: str = "text",
                      keep: Iterable[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the ids of each text, and ``decoded``, the text of those ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def work():
        pieces = Pieces(vocabulary.value)

        def encode(rows: list[tuple]) -> list[tuple]:
            found = pieces.encode([text or "" for (text,) in rows])
            return [(ids, pieces.decode(ids)) for ids in found]

        return encode

    return map_rows(docs, [text_col], "ids array<int>, decoded string", work,
                    keep=None if keep is None else list(keep))
