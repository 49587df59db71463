"""Secret scans: keyword prefilter, anchored patterns, checksum validation.

An Aho-Corasick automaton finds the keywords in one pass over a text. Only at
its hits an anchored pattern is tried; runs of hexadecimal digits, which have
no keyword, are found by searching a class-mapped copy of the text for a run
of the least length. Kinds whose format embeds a checksum are reported only if
it is right:

* ``github`` and ``npm`` tokens end in the CRC-32 of their body, six digits of base 62;
* ``xprv`` extended private keys end in four bytes of a double SHA-256 (base 58).

Each kind is matched from left to right without overlaps: a match that is too
short is not reported but still uses up its characters. Positions are code
points, ends exclusive.

Null and empty texts have no secrets. Texts are scanned whole; rows are judged
one by one, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from .rows import map_rows

# fixed values: kinds in reporting order, keywords and formats
KINDS = ["assign", "access", "hex", "github", "npm", "xprv"]
BASE = KINDS[:3]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
XPRV = re.compile(rb"xprv([1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_RUN = b"x" * HEX_LEAST
_CLASS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _number(digits: bytes, alphabet: bytes) -> int:
    value = 0
    for d in digits:
        value = value * len(alphabet) + alphabet.index(d)
    return value


def crc_is_right(body: bytes) -> bool:
    return _number(body[-6:], BASE62) == zlib.crc32(body[:-6])


def base58_is_right(text: bytes) -> bool:
    value = _number(text, BASE58)
    if value.bit_length() > 82 * 8:
        return False
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


class Scanner:
    def __init__(self):
        self.words = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]),
                            ("github", GITHUB_WORDS), ("npm", ["npm_"]), ("xprv", ["xprv"])):
            for word in words:
                self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        raw = text.encode("utf-8")
        # one character per byte, so that automaton positions are byte positions
        folded = raw.translate(_LOWER).decode("latin-1")
        near: dict[str, list[int]] = {}
        for last, (kind, size) in self.words.iter(folded):
            near.setdefault(kind, []).append(last + 1 - size)
        found = self._hex(raw)
        for kind, starts in near.items():
            used = 0
            for start in sorted(starts):
                if start >= used and (match := getattr(self, "_" + kind)(raw, start)):
                    used, right = match
                    if right:
                        found.append((kind, start, used))
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return found if raw.isascii() else _code_points(raw, found)

    @staticmethod
    def _hex(raw: bytes):
        classes, found = raw.translate(_CLASS), []
        start = classes.find(_RUN)
        while start >= 0:
            end = classes.find(b" ", start)
            end = len(raw) if end < 0 else end
            found.append(("hex", start, end))
            start = classes.find(_RUN, end)
        return found

    @staticmethod
    def _assign(raw, start):
        match = ASSIGN.match(raw, start)
        return match and (match.end(), len(match[2]) >= ASSIGN_LEAST)

    @staticmethod
    def _access(raw, start):
        match = ACCESS.match(raw, start)
        return match and (match.end(), match.end() - start >= ACCESS_LEAST)

    @staticmethod
    def _github(raw, start):
        match = GITHUB.match(raw, start)
        return match and (match.end(), crc_is_right(match[1]))

    @staticmethod
    def _npm(raw, start):
        match = NPM.match(raw, start)
        return match and (match.end(), crc_is_right(match[1]))

    @staticmethod
    def _xprv(raw, start):
        match = XPRV.match(raw, start)
        return match and (match.end(), base58_is_right(match[0]))


def _code_points(raw: bytes, spans):
    """Byte positions to code points, in one pass over the text."""
    at = points = 0
    place = {}
    for byte in sorted({b for _, start, end in spans for b in (start, end)}):
        points += len(raw[at:byte].decode("utf-8"))
        at, place[byte] = byte, points
    return [(kind, place[start], place[end]) for kind, start, end in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    kept, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            kept += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         redacted: bool = False) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans[, redacted_text]) of every row."""
    added = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def work():
        scanner = Scanner()

        def do(rows):
            out = []
            for (text,) in rows:
                spans = scanner.spans(text or "")
                base = [s for s in spans if s[0] in BASE]
                counts = [sum(s[0] == kind for s in base) for kind in BASE]
                row = (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                out.append((*row, redact(text or "", spans)) if redacted else row)
            return out

        return do

    return map_rows(docs, [text_col], added + ", redacted_text string" * redacted, work,
                    keep=[id_col])
