"""Problem 7: evaluation texts inside training texts, found with suffix arrays of the training text."""

from __future__ import annotations

import html
import itertools
import pickle
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import cut, exact

#: Units of an item (words; characters if it is in Chinese) that make a leak, and of how many units of the passage one may be changed.
LEAST_WORDS, LEAST_CHARS, CHANGED = 15, 30, 8
#: Longest verbatim stretch that every tolerated passage has at least: with two changes in 17 units, 15 equal ones fall into 3 stretches.
SEED = 5
#: A sentence in at least so many items is a stock sentence.
STOCK_ITEMS = 3
#: Items of one broadcast block, characters of training text in one suffix array, and places of a search followed up at once.
ITEMS_PER_BLOCK, SHARD_CHARS, PLACES = 20_000, 10_000_000, 500_000

# Letters of other scripts that look like Latin ones.
_LOOKS = (
    ("аӓӑ", "a"), ("в", "b"), ("сϲ", "c"), ("ԁ", "d"), ("еёѐε", "e"), ("ɡ", "g"), ("һн", "h"), ("іїίιı", "i"), ("јϳ", "j"), ("кκ", "k"), ("ӏ", "l"), ("м", "m"),
    ("пη", "n"), ("оοσ", "o"), ("рρ", "p"), ("ԛ", "q"), ("гⲅ", "r"), ("ѕ", "s"), ("тτ", "t"), ("υ", "u"), ("ѵν", "v"), ("ԝω", "w"), ("хχ", "x"), ("уγ", "y"), ("ᴢ", "z"), ("α", "a"), ("β", "b"),
)
_MAP = {ord(c): latin for others, latin in _LOOKS for c in others} | {ord("ß"): "ss", ord("æ"): "ae", ord("ø"): "o", ord("ł"): "l"}
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][\w:.-]*(?:[\s/][^<>]*)?>", re.I)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:[ \t]+\"[^\"\n]*\")?\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬][ \t]*\n[ \t>|*#]*(?=[^\W\d_])")
_NUMBERING = re.compile(r"^[^\S\n]*(?:[>|*+#•·\-][^\S\n]*)*(?:step[^\S\n]+)?(?:[(\[（]?(?:\d+|[a-z]|[ivx]+|[一二三四五六七八九十]+)[.):\]、）．]+(?:\d+[.)])*\d*(?=\D))?", re.M | re.I)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt])")
_GLUE = re.compile(r"[*_`~'’‘´\\]")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def _without_comments(text: str) -> str:
    """Text without <!-- ... -->, of any length; one that is not closed stays."""
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        parts.append(text[at:begin])
        at = end + 3
    return "".join([*parts, text[at:]])


def plain_text(text: str) -> str:
    """Text without case, look-alike letters, invisible characters, markup, hyphens at line ends and numbering at line beginnings."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace("\u0085", "\n")
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold()).casefold()
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Mn", "Cf", "Me")).translate(_MAP)
    else:
        text = text.lower()
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", _without_comments(text)))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    return _GLUE.sub("", _NUMBERING.sub("", _BROKEN.sub("", text)))


def words(plain: str) -> list[str]:
    return _WORD.findall(plain)


def chars(plain: str) -> list[str]:
    return list("".join(_WORD.findall(plain)))


def _cutter(lang: str | None) -> Callable[[str], list[str]]:
    return chars if (lang or "").strip().lower() == "zh" else words


@dataclass
class Items:
    """The items of one kind (words or characters), as numbers of a vocabulary, one after another."""

    ids: list[int] = field(default_factory=list)
    units: list[np.ndarray] = field(default_factory=list)
    counted: list[np.ndarray] = field(default_factory=list)  # positions outside stock sentences
    vocabulary: dict[str, int] = field(default_factory=dict)


def read_items(rows: Iterable[tuple[int, str, str]], chinese: bool, stock: set[str]) -> Items:
    out = Items()
    for item, lang, text in rows:
        cutter = _cutter(lang)
        if (cutter is chars) != chinese or not text:
            continue
        units, counted = [], []
        for s in _SENTENCE.split(text):
            u = cutter(plain_text(s))
            counted += [" ".join(u) not in stock] * len(u)
            units += u
        if sum(counted) >= (LEAST_CHARS if chinese else LEAST_WORDS):
            out.ids.append(item)
            out.units.append(np.array([out.vocabulary.setdefault(u, len(out.vocabulary) + 1) for u in units], np.int64))
            out.counted.append(np.flatnonzero(counted))
    return out


def stock_sentences(rows: Iterable[tuple[int, str, str]], least: int = STOCK_ITEMS) -> set[str]:
    """Sentences, in plain units, that at least so many items hold."""
    seen: dict[str, set[int]] = {}
    for item, lang, text in rows:
        cutter = _cutter(lang)
        for s in _SENTENCE.split(text or ""):
            if u := cutter(plain_text(s)):
                seen.setdefault(" ".join(u), set()).add(item)
    return {s for s, items in seen.items() if len(items) >= least}


def suffix_array(a: np.ndarray, longest: int, seed: int = SEED) -> np.ndarray:
    """Where the suffixes of a begin that start with `seed` known units, in order of their first `longest` units.

    Ranks of the first 1, 2, 4 and 8 units are taken over all positions, then doubled for those that still share one, until all differ or
    `longest` is reached. An unknown unit (0) ends a suffix: no match goes beyond it.
    """
    n = len(a)
    pad = np.concatenate([a, np.zeros(longest + 16, np.int64)])
    run = np.concatenate([[0], np.cumsum(a > 0)])
    at = np.arange(max(0, n - seed + 1))
    at = at[run[at + seed] - run[at] == seed]
    if not len(at):
        return at
    live, rank = np.flatnonzero(a > 0), pad.copy()
    for k in (1, 2, 4):
        _, again, count = np.unique(rank[live] * (int(rank.max()) + 1) + rank[live + k], return_inverse=True, return_counts=True)
        rank[:] = 0
        rank[live] = (1 + np.cumsum(count) - count)[again]  # 1 + where its group begins
    group = rank[at]
    order = np.argsort(group, kind="stable")
    k = 8
    while k < longest:
        sorted_ = rank[at[order]]
        twin = np.append(sorted_[1:] == sorted_[:-1], False)
        twin[1:] |= twin[:-1].copy()
        open_ = at[order[twin]]
        if not len(open_):
            break
        first, then = rank[open_], rank[open_ + k]
        turn = np.lexsort((then, first))
        open_, first, then = open_[turn], first[turn], then[turn]
        index = np.arange(len(open_))
        begins = np.append(True, first[1:] != first[:-1])
        parts = begins | np.append(True, then[1:] != then[:-1])
        base, part = np.maximum.accumulate(np.where(begins, index, 0)), np.maximum.accumulate(np.where(parts, index, 0))
        rank[open_] = first + part - base
        order = np.argsort(rank[at], kind="stable")
        k *= 2
    return at[order]


def common(a: np.ndarray, at: np.ndarray, b: np.ndarray, there: np.ndarray, most: int) -> np.ndarray:
    """How many units, at most `most`, a from `at` on and b from `there` on have in common; both end with 8 unknown ones at least."""
    n = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        i, j = np.minimum(at[open_] + n[open_], len(a) - 8), np.minimum(there[open_] + n[open_], len(b) - 8)
        x = a[i[:, None] + np.arange(8)]
        same = (x == b[j[:, None] + np.arange(8)]) & (x > 0)
        step = np.where(same.all(1), 8, same.argmin(1))
        n[open_] += step
        open_ = open_[(step == 8) & (n[open_] < most)]
    return np.minimum(n, most)


def search(a: np.ndarray, sa: np.ndarray, b: np.ndarray, tests: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of the suffixes of b that begin at `tests`, by their first `most` units: the interval of sa whose suffixes begin with these units.

    With `most` no less than any suffix is long, the interval is empty or of whole matches, and the longest verbatim match of a suffix is
    with one of the suffixes beside it. a and b end with 8 unknown units at least.
    """
    ends = []
    for upper in (False, True):
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(sa))
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            at, there = sa[middle], tests[open_]
            n = common(a, at, b, there, most)
            whole = n == most
            less = a[np.minimum(at + n, len(a) - 1)] < b[np.minimum(there + n, len(b) - 1)]
            right = np.where(whole, upper, less)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        ends.append(low)
    return ends[0], ends[1]


def longest_matches(a: np.ndarray, sa: np.ndarray, b: np.ndarray, tests: np.ndarray, longest: int) -> np.ndarray:
    """Length of the longest verbatim match of each suffix of b anywhere in a, from its place in the suffix array."""
    place = search(a, sa, b, tests, longest)[0]
    beside = [common(a, sa[np.clip(place + k, 0, len(sa) - 1)], b, tests, longest) for k in (-1, 0)]
    return np.maximum(*beside)


def _places(low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Intervals laid out as (number of the interval, place), at most so many at once."""
    n = high - low
    ends = np.cumsum(n)
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        k = np.arange(at, min(at + most, int(ends[-1])))
        of = np.searchsorted(ends, k, "right")
        yield of, low[of] + k - (ends[of] - n[of])


def matches(items: Items, a: np.ndarray, begin: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item number, document number, units matched, first unit in the document, longest verbatim match) of documents a[begin[i]:begin[i + 1]] that leak an item.

    A pair may come several times, once per place or block of places.
    """
    size = np.array([len(u) for u in items.units])
    longest = int(size.max())
    sa = suffix_array(a, longest)
    if not len(sa):
        return
    first = np.cumsum(size + 1) - size - 1
    text = np.concatenate([x for u in items.units for x in (u, [0])] + [np.zeros(8, np.int64)])
    wide = np.concatenate([a, np.zeros(8, np.int64)])
    counted = np.zeros(len(text), bool)
    for f, c in zip(first, items.counted, strict=True):
        counted[f + c] = True
    start = np.concatenate([f + np.arange(max(0, s - SEED + 1)) for f, s in zip(first, size, strict=True)])
    start = start[counted[start[:, None] + np.arange(SEED)].any(1)]  # a seed wholly in a stock sentence tells nothing
    start = start[longest_matches(wide, sa, text, start, longest) >= SEED]
    low, high = search(wide, sa, text, start, SEED)
    sought = np.zeros(len(text), bool)
    sought[start] = True
    pad = np.concatenate([np.zeros(longest, np.int64), a, np.zeros(longest, np.int64)])
    for of, k in _places(low, high, PLACES):
        of_test, place = start[of], sa[k]
        begins = (of_test == 0) | (place == 0) | ~sought[of_test - 1] | (text[of_test - 1] != a[place - 1])  # a match is followed up from its beginning
        of_test, place = of_test[begins], place[begins]
        if not len(place):
            continue
        verbatim = common(wide, place, text, of_test, longest)
        item = np.searchsorted(first, of_test, "right") - 1
        shift = place - (of_test - first[item])  # where the item's first unit would lie
        document = np.searchsorted(begin, place, "right") - 1
        # one row per (item, document, shift)
        order = np.lexsort((shift, document, item))
        item, document, shift, verbatim = item[order], document[order], shift[order], verbatim[order]
        new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (document[1:] != document[:-1]) | (shift[1:] != shift[:-1])))
        item, document, shift, verbatim = item[new], document[new], shift[new], np.maximum.reduceat(verbatim, new)
        bounds = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            i = item[lo]
            c = items.counted[i]
            unit = items.units[i][c]
            for at in range(lo, hi, 50_000):
                s, d = shift[at : min(hi, at + 50_000)], document[at : min(hi, at + 50_000)]
                beside = s[:, None] + c
                same = (pad[beside + longest] == unit) & (beside >= begin[d][:, None]) & (beside < begin[d + 1][:, None])
                maybe = np.flatnonzero(same.sum(1) >= least)
                if not len(maybe):
                    continue
                length, begins = longest_passage(same[maybe], least)
                for k in np.flatnonzero(length):
                    m = maybe[k]
                    yield int(i), int(d[m]), int(length[k]), int(beside[m, begins[k]] - begin[d[m]]), int(verbatim[at + m])


def longest_passage(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the longest stretch that begins and ends with equal units, has `least` of them or more, and at most one unit in CHANGED different; 0 without one."""
    rows, n = same.shape
    wrong = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(~same, axis=1)], axis=1)
    best, where = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for length in range(n, least - 1, -1):
        open_ = np.flatnonzero(best == 0)
        if not len(open_):
            break
        bad = wrong[open_, length:] - wrong[open_, : n - length + 1]
        ok = (bad * CHANGED <= length) & (length - bad >= least) & same[open_, : n - length + 1] & same[open_, length - 1 :]
        hit = ok.any(1)
        best[open_[hit]] = length
        where[open_[hit]] = ok[hit].argmax(1)
    return best, where


_FOUND = "doc_id long, item_id long, n_units long, first_unit long, verbatim long"


def _found(items: Items, least: int, ids: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of each document and item that match the longest passage, and the longest verbatim match of all."""
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    found = list(matches(items, np.concatenate(parts), begin, least))
    if found:
        i, d, n, p, v = (np.array(x, np.int64) for x in zip(*found, strict=True))
        doc, item = np.array(ids, np.int64)[d], np.array(items.ids, np.int64)[i]
        order = np.lexsort((p, -n, item, doc))
        doc, item, n, p, v = doc[order], item[order], n[order], p[order], v[order]
        one = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        yield pa.RecordBatch.from_pydict({"doc_id": doc[one], "item_id": item[one], "n_units": n[one], "first_unit": p[one], "verbatim": np.maximum.reduceat(v, one)})


def _scan(blocks: list[Broadcast], shard_chars: int):  # noqa: ANN202
    """Shards of whole documents in plain text, each searched for the items of every block."""

    def search_shard(shard: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for items, cutter, least in zip(pickle.loads(block.value), (words, chars), (LEAST_WORDS, LEAST_CHARS), strict=True):
                get, ids, parts = items.vocabulary.get, [], []
                for doc, plain in shard if items.ids else ():
                    if cutter is chars and not _CJK.search(plain):
                        continue
                    units = np.fromiter((get(u, 0) for u in cutter(plain)), np.int64)
                    if len(units) >= SEED:
                        ids.append(doc)
                        parts.append(np.append(units, 0))
                if ids:
                    yield from _found(items, least, ids, parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, str]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.append((doc, plain_text(text.as_py())))
                held += len(shard[-1][1])
                if held >= shard_chars:
                    yield from search_shard(shard)
                    shard, held = [], 0
        if shard:
            yield from search_shard(shard)

    return work


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of items, in plain units."""
    for batch in batches:
        rows = [(i, " ".join(u)) for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in _SENTENCE.split(text) if (u := _cutter(lang)(plain_text(s)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["item_id", "sentence"])


def _blocks(items_per_block: int):  # noqa: ANN202
    """Items read and pickled, so many at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else ()
            while len(held) >= items_per_block or (batch is None and held):
                rows, held = held[:items_per_block], held[items_per_block:]
                stock = {s for *_, found in rows for s in found or ()}
                both = [read_items(sorted({r[:3] for r in rows}), chinese, stock) for chinese in (False, True)]
                if any(x.ids for x in both):
                    yield pa.RecordBatch.from_pydict({"items": pa.array([pickle.dumps(both)], pa.binary())})

    return work


def leaks(documents: DataFrame, items: DataFrame, shard_chars: int = SHARD_CHARS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_units, first_unit, verbatim) for each document that holds a passage of an item: the longest such passage, and the longest verbatim match.

    Both texts are reduced to plain units: words, or characters for items in Chinese. Each task packs its whole documents into shards,
    sorts the shard's suffixes (a suffix array over the units that the items know) and binary-searches every suffix of every item in
    it, which gives its longest verbatim match; where that has SEED units or more, all places that begin with the same SEED units. Around
    each the item is laid beside the document; a leak is a passage that holds LEAST_WORDS or LEAST_CHARS units of the item, begins and ends
    with one, and has at most one changed unit in CHANGED among them; a unit put in or left out ends the passage. Sentences of STOCK_ITEMS
    or more items don't count.

    The items are read in tasks and sent out in blocks of items_per_block, which a task opens one after another for each shard; so the
    documents are read and made plain once, whatever the number of items, and nothing of them is shuffled; copies of a text and very long texts cost
    their own length. Null or empty texts, null ids and items shorter than a leak give no row; repeated rows of one doc_id give one row
    per shard they are in; empty tables give no row.
    """
    spark = documents.sparkSession
    texts = exact(documents, "doc_id", "text").where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    rows = cut(exact(items, "item_id", "lang", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "lang", "text").distinct())
    sentences = rows.mapInArrow(_sentences, "item_id long, sentence string").distinct()
    stock = sentences.groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("sentence")
    of_item = sentences.join(stock, "sentence").groupBy("item_id").agg(F.collect_list("sentence").alias("stock"))
    n = -(-rows.count() // items_per_block)
    packed = rows.join(of_item, "item_id", "left").repartition(max(1, n), "item_id").mapInArrow(_blocks(items_per_block), "items binary")
    blocks = [spark.sparkContext.broadcast(bytes(r["items"])) for r in packed.toLocalIterator()]  # a block at a time
    if not blocks:
        return spark.createDataFrame([], _FOUND)
    return texts.mapInArrow(_scan(blocks, shard_chars), _FOUND)


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that leak nothing."""
    return documents.join(exact(found, "doc_id").distinct(), "doc_id", "left_anti")
