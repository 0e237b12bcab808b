"""Problem 9: texts above a size limit cut at natural boundaries, by packing a tree of their structure."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm.tokens import VOCABULARY, byte_lengths, clean, encoding, ship
from tidewheel.session import exact

#: Most tokens of a piece, tokens it repeats of the one before, and tokens kept free for what a cut changes in the tokens beside it.
LIMIT, OVERLAP, SLACK = 1_000, 100, 8

_PIECE = "doc_id long, piece_index int, n_tokens int, start_char long, end_char long, overlap_chars long, text string"

#: Where a new node may begin, from the strongest level to the weakest: headings by depth, bold or HTML headings, rules, blank lines,
#: list items and table rows, lines, sentences, clauses, words.
_LEVELS = (
    r"^#[ \t]", r"^##[ \t]", r"^###[ \t]", r"^#{4,6}[ \t]|^<h[1-6]\b|^\S[^\n]*\n(?:={3,}|-{3,})[ \t]*$", r"^\*\*[^*\n]+\*\*[^\n]*$|^v?\d+(?:\.\d+)+[ \t]*$|^<(?:section|article|table|ul|ol)\b",
    r"(?<=\n)[ \t]*\n+(?=[^\n])", r"^(?![ \t])(?:[-*+•][ \t]|\(?\d{1,4}[.)][ \t]|\|)", r"^", r"^[ \t]+(?:[-*+•][ \t]|\d{1,4}[.)][ \t])", r"(?<=[.!?…][\s\"'”’)])(?=\S)|(?<=[。！？；])", r"(?<=[,;:，、：])", r"(?<=\s)(?=\S)",
)
_MATCHERS = tuple(re.compile(x, re.M | re.I) for x in _LEVELS)
#: The level of blank lines, at which whole blocks begin and end too; headings lie above it.
BLOCKS = 5
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$", re.M)
_ROWS = re.compile(r"(?:^[ \t]*\|[^\n]*(?:\n|\Z)){2,}", re.M)
_ELEMENT = re.compile(r"<(/?)(table|pre|ul|ol|dl|details|blockquote|section|article|figure)\b[^<>]*>", re.I)


def fences(text: str) -> list[tuple[int, int]]:
    """Fenced code, from the line that opens it to the end of the one that closes it; a fence that is never closed is none."""
    out, mark, begin = [], "", 0
    for m in _FENCE.finditer(text) if "```" in text or "~~~" in text else ():
        if not mark:
            if m[1][0] == "~" or "`" not in m[2]:
                mark, begin = m[1], m.start()
        elif m[1].startswith(mark) and not m[2].strip():
            out.append((begin, min(m.end() + 1, len(text))))
            mark = ""
    return out


def elements(text: str) -> list[tuple[int, int]]:
    """Tables of rows that begin with a bar, and HTML blocks that begin a line, from their tag to the one that closes it."""
    out = [m.span() for m in _ROWS.finditer(text)] if "|" in text else []
    open_: dict[str, list[int]] = {}
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        name = m[2].lower()
        if not m[1]:
            line = m.start()
            while line and text[line - 1] in " \t":
                line -= 1
            open_.setdefault(name, []).append(m.start() if line == 0 or text[line - 1] == "\n" else -1)
        elif open_.get(name):
            if (begin := open_[name].pop()) >= 0:
                out.append((begin, m.end() + (text[m.end() : m.end() + 1] == "\n")))
    return out


class Text:
    """A text with its tokens; sizes of stretches are differences of token positions, so the text is tokenised once."""

    def __init__(self, text: str, vocabulary: str) -> None:
        self.text, self.encoding = text, encoding(vocabulary)
        self.ids = self.encoding.encode_ordinary(text)
        self.ends = np.cumsum(byte_lengths(vocabulary)[np.array(self.ids, np.int64)]) if self.ids else np.zeros(0, np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        self.bytes = np.concatenate([[0], np.cumsum(wide)])
        #: Tokens that begin before each character position.
        self.tokens = np.searchsorted(np.concatenate([[0], self.ends[:-1]]) if len(self.ids) else self.ends, self.bytes, "left")

        self.cuts: list[int] = []
        self.whole: list[tuple[int, int]] = []
        self.code: list[tuple[int, int]] = []

    def find_blocks(self, most: int) -> None:
        """Where blocks begin and end; those that fit stay whole, and in larger ones of code nothing is a heading."""
        code = fences(self.text)
        inside = _Within(code)
        blocks = code + [x for x in elements(self.text) if not inside(x[0])]
        self.cuts = sorted({p for x in blocks for p in x})
        for lo, hi in sorted((x for x in blocks if self.size(*x) <= most), key=lambda x: (x[0], -x[1])):
            if not self.whole or lo >= self.whole[-1][1]:
                self.whole.append((lo, hi))
        self.code = [x for x in code if self.size(*x) > most]

    def size(self, lo: int, hi: int) -> int:
        return int(self.tokens[hi] - self.tokens[lo]) + 1

    def at_token(self, k: int) -> int:
        """First character position with k tokens before it."""
        return int(np.searchsorted(self.tokens, max(k, 0), "left"))


class _Within:
    """Whether a position lies inside one of these stretches, apart and in order, and not at its beginning."""

    def __init__(self, stretches: list[tuple[int, int]]) -> None:
        self.begin, self.end = [x for x, _ in stretches], [x for _, x in stretches]

    def __call__(self, p: int) -> bool:
        i = bisect.bisect_left(self.begin, p) - 1
        return i >= 0 and p < self.end[i]


def children(doc: Text, lo: int, hi: int, level: int) -> tuple[list[int], int]:
    """Where the node lo..hi divides at the first level from `level` on that divides it, and that level."""
    whole, code = _Within(doc.whole), _Within(doc.code)
    for k in range(level, len(_MATCHERS)):
        cuts = [p for m in _MATCHERS[k].finditer(doc.text, lo, hi) if lo < (p := m.end() if k == BLOCKS else m.start()) < hi and not whole(p)]
        if k < BLOCKS and doc.code:
            cuts = [p for p in cuts if not code(p)]
        if k == BLOCKS and doc.cuts:
            cuts = sorted({*cuts, *(p for p in doc.cuts[bisect.bisect_right(doc.cuts, lo) : bisect.bisect_left(doc.cuts, hi)] if not whole(p))})
        if cuts:
            return cuts, k
    return [], len(_MATCHERS)


def pack(doc: Text, lo: int, hi: int, most: int, level: int = 0) -> list[tuple[int, int]]:
    """Stretches of at most `most` tokens: a node that fits stays whole; of an oversized one the children are packed, then neighbours merged while they fit."""
    if doc.size(lo, hi) <= most:
        return [(lo, hi)]
    cuts, k = children(doc, lo, hi, level)
    if not cuts:  # no boundary of any kind: by tokens, at whole characters
        parts, at = [], lo
        while at < hi:
            end = doc.at_token(int(doc.tokens[at]) + most - 1)
            end = hi if end >= hi else max(at + 1, end if doc.size(at, end) <= most else end - 1)
            parts.append((at, end))
            at = end
        return parts
    parts: list[tuple[int, int]] = []
    for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
        for x, y in [(a, b)] if doc.size(a, b) <= most else pack(doc, a, b, most, k + 1):
            if parts and doc.size(parts[-1][0], y) <= most:
                parts[-1] = (parts[-1][0], y)
            else:
                parts.append((x, y))
    return parts


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, int, str]]:
    """(tokens, start, end, repeated characters, piece) of a text of more than `limit` tokens, else nothing.

    Without what each piece repeats, the pieces joined are the text. A piece repeats about `overlap` tokens of the one before, from the
    beginning of a word where there is one.
    """
    if limit <= overlap + SLACK:
        raise ValueError("limit must exceed overlap by more than the slack")
    if len(text.encode("utf-8", "replace")) <= limit:  # a token has a byte at least
        return []
    text = clean(text)
    doc = Text(text, vocabulary)
    if len(doc.ids) <= limit:
        return []
    starts_word = [m.start() for m in re.finditer(r"(?<=\s)\S", text)]
    doc.find_blocks(limit - overlap - SLACK)
    out: list[tuple[int, int, int, int, str]] = []
    begins = 0  # of the piece before, with its overlap
    for lo, hi in pack(doc, 0, len(text), limit - overlap - SLACK):
        back = lo
        if out and overlap:
            back = max(begins, doc.at_token(int(doc.tokens[lo]) - overlap))
            i = bisect.bisect_left(starts_word, back)
            if i < len(starts_word) and starts_word[i] < lo and doc.tokens[starts_word[i]] - doc.tokens[back] <= overlap // 4:
                back = starts_word[i]
        while (n := len(doc.encoding.encode_ordinary(text[back:hi]))) > limit and back < lo:
            back = min(lo, back + max(1, (lo - back) // 8))
        out.append((n, lo, hi, lo - back, text[back:hi]))
        begins = back
    return out


def _cut(limit: int, overlap: int, vocabulary: str):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += ((doc, k, *p) for k, p in enumerate(cut_text(text.as_py(), limit, overlap, vocabulary)))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = [x.split()[0] for x in _PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return work


def split_oversized(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most `limit` tokens of each text that has more: doc_id, piece_index, n_tokens, start_char, end_char, overlap_chars, text.

    A text is parsed into a tree of headings, blocks (paragraphs, fenced code, tables, HTML lists and the like), list items, lines,
    sentences, clauses and words; only nodes above the limit (less overlap and slack) are opened, so code or a table that fits is never
    cut and a comment line in code is no heading, and what comes out is merged with its neighbours as far as it fits. n_tokens counts the piece as it is, what it repeats
    included. Null and shorter texts give no row; a text without any boundary is cut between characters; doc_id may be null or
    repeated, as each row is cut by itself, in place and without a shuffle. An empty table gives no row; other columns are not read.
    """
    ship(documents.sparkSession, vocabulary)
    return exact(documents, "doc_id", "text").where("text is not null").mapInArrow(_cut(limit, overlap, vocabulary), _PIECE)
