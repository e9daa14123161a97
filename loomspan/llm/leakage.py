"""Evaluation texts leaking into a corpus: pigeonhole pieces, then Myers' bit-parallel distance.

A stretch of ``words`` consecutive item words that appears with at most one edit has at least one of its
two halves intact (error budget plus one pieces). Both halves of all different stretches of the items are
indexed by hash; corpus texts are probed at every word; the whole other half is verified beside each hit with
Myers' algorithm, a vector of candidates at a time. A stretch that many items hold is looked for once. Words are
compared without what lies between them, so that line breaks inside words don't matter.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomspan.session import chunks, column

_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
#: Ranges of code points that a reader doesn't see.
_HIDDEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
_UNSEEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _HIDDEN) + "]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_FOREIGN = re.compile(r"[^\w\x00-\x7f]")

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_END = 10  # a line break: no byte of a word

LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())])


def plain(text: str | None, lower: bool = True) -> str:
    """Text as a reader takes it, in lower case: no markup, entities or invisible characters, no broken words."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _FOREIGN.sub(" ", _UNSEEN.sub("", unicodedata.normalize("NFKC", text)))
    if "-\n" in text or "-\r" in text or "- " in text:
        text = _BROKEN.sub("", text)
    return text.lower() if lower else text


class Words:
    """Word table of many texts: the stream of word characters without gaps, and where words start in it."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        is_word = _WORD[data]
        edge = np.diff(is_word.astype(np.int8), prepend=0)
        begin = np.flatnonzero(edge == 1)
        size = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
        self.stream = data[is_word]
        self.doc = np.searchsorted(size, begin, side="right")
        self.start = np.append(np.cumsum(is_word)[begin] - 1, len(self.stream)).astype(np.int64)
        self.doc_end = np.zeros(len(raw), np.int64)
        self.doc_start = np.zeros(len(raw), np.int64)
        edges = np.searchsorted(self.doc, np.arange(len(raw) + 1))
        self.doc_start, self.doc_end = self.start[edges[:-1]], self.start[edges[1:]]
        self.first_word = edges
        self.is_start = np.zeros(len(self.stream) + 1, bool)
        self.is_start[self.start] = True
        power = _powers(_BASE, len(self.stream) + 1)
        self.prefix = np.zeros(len(self.stream) + 1, np.uint64)
        np.cumsum((self.stream.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.prefix[1:])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers that k words of one text start at, and the hash of their characters."""
        n = len(self.doc)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        s, e = self.start[at], self.start[at + k]
        return at, (self.prefix[e] - self.prefix[s]) * _powers(_BACK, len(self.stream) + 1)[s]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, size: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < size:
        steps = np.full(max(size, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _POWERS[int(base)] = np.cumprod(steps)
    return known[:size]


@dataclass
class ItemIndex:
    """Different stretches of the items, with their halves sorted by hash, and the items that hold each."""

    ids: np.ndarray
    words: Words
    half: int
    at: np.ndarray  # first word of each stretch
    halves: dict[int, tuple[np.ndarray, np.ndarray]]  # 1: first halves, -1: second halves: hashes in order, stretches
    sieve: np.ndarray
    items: np.ndarray  # the items of all stretches, one stretch behind another
    first: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str], half: int) -> ItemIndex:
        words = Words([plain(t) for t in texts])
        at, hashes = words.grams(2 * half)
        _, first, stretch = np.unique(hashes, return_index=True, return_inverse=True)
        holds = np.unique(stretch.astype(np.int64) * max(len(texts), 1) + words.doc[at]) if len(at) else np.zeros(0, np.int64)
        count = max(len(texts), 1)
        begin = at[first]
        pieces, piece_hash = words.grams(half)
        halves = {}
        sieve = np.zeros(1 << 22, bool)
        for step, place in ((1, begin), (-1, begin + half)):
            piece = piece_hash[np.searchsorted(pieces, place)]
            order = np.argsort(piece, kind="stable")
            halves[step] = (piece[order], order)
            sieve[piece >> np.uint64(42)] = True
        return cls(np.array(ids, np.int64), words, half, begin, halves, sieve, holds % count, np.searchsorted(holds // count, np.arange(len(begin) + 1)))


def _flank(stream: np.ndarray, start: np.ndarray, limit: np.ndarray, step: int, width: int) -> np.ndarray:
    """``width`` characters from ``start`` in direction ``step``; _END beyond ``limit``."""
    at = start[:, None] + step * np.arange(width)
    inside = at < limit[:, None] if step > 0 else at >= limit[:, None]
    return np.where(inside, stream[np.where(inside, at, 0)], _END) if len(stream) else np.full(at.shape, _END, np.uint8)


def myers_prefix(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, budget: int) -> np.ndarray:
    """Edit distance of each pattern to its text's best prefix; > ``budget`` is cut off.

    Bit-parallel over the pattern in blocks of 64 characters, one vector lane per candidate.
    """
    lanes, widest = pattern.shape
    one, row = np.uint64(1), np.arange(lanes)
    blocks = max(1, -(-widest // 64))
    peq = np.zeros((blocks, lanes, 256), np.uint64)
    for k in range(widest):
        live = k < size
        peq[k // 64, row[live], pattern[live, k]] |= one << np.uint64(k % 64)
    peq[:, :, _END] = 0
    last, top = (size - 1).clip(0) // 64, ((size - 1).clip(0) % 64).astype(np.uint64)
    pv, mv = np.full((blocks, lanes), ~np.uint64(0)), np.zeros((blocks, lanes), np.uint64)
    score, best = size.astype(np.int64).copy(), np.full(lanes, budget + 1, np.int64)
    sign = np.uint64(63)
    for j in range(text.shape[1]):
        up, down = np.full(lanes, one), np.zeros(lanes, np.uint64)  # what the block before hands on: +1 at the text's start
        for b in range(blocks):
            eq = peq[b, row, text[:, j]]
            xv = eq | mv[b]
            eq = eq | down
            xh = (((eq & pv[b]) + pv[b]) ^ pv[b]) | eq
            ph, mh = mv[b] | ~(xh | pv[b]), pv[b] & xh
            step = ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            score += np.where(last == b, step, 0)
            next_up, next_down = ph >> sign, mh >> sign
            ph, mh = (ph << one) | up, (mh << one) | down
            pv[b], mv[b] = mh | ~(xv | ph), ph & xv
            up, down = next_up, next_down
        best = np.minimum(best, score)
    return np.where(size <= 0, 0, best)


def leaks_in(index: ItemIndex, docs: Words, budget: int, lanes: int = 4096, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, item number, fewest edits) for every document with a leaked stretch.

    Hits are verified ``most`` at a time, so that a piece that many stretches begin with takes time, not memory.
    """
    none = np.zeros(0, np.int64)
    at, hashes = docs.grams(index.half)
    if not len(at) or not len(index.at):
        return none, none, none
    maybe = np.flatnonzero(index.sieve[hashes >> np.uint64(42)])
    at, hashes = at[maybe], hashes[maybe]
    found = []
    for step, (pieces, stretches) in index.halves.items():
        low, high = np.searchsorted(pieces, hashes, "left"), np.searchsorted(pieces, hashes, "right")
        upto = np.cumsum(high - low)
        cuts = [0]
        while cuts[-1] < len(at):
            done = upto[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, done + most, "right"))))
        for s, e in zip(cuts, cuts[1:]):
            count = (high - low)[s:e]
            doc_word = np.repeat(at[s:e], count)
            entry = np.repeat(low[s:e] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            stretch, edits = _verify(index, docs, step, doc_word, stretches[entry], budget, lanes)
            good = edits <= budget
            found.append(_fewest(docs.doc[doc_word[good]], stretch[good], edits[good]))
    doc, stretch, edits = _fewest(*(np.concatenate(x) for x in zip(*found)))
    n = np.diff(index.first)[stretch]
    item = index.items[np.repeat(index.first[stretch] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return _fewest(np.repeat(doc, n), item, np.repeat(edits, n))


def _fewest(doc: np.ndarray, what: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per (doc, what), with the fewest edits."""
    order = np.lexsort((edits, what, doc))
    doc, what, edits = doc[order], what[order], edits[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (what[1:] != what[:-1])
    return doc[new], what[new], edits[new]


def _verify(index: ItemIndex, docs: Words, step: int, doc_word: np.ndarray, stretch: np.ndarray, budget: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits of the other half of each stretch beside the hit at ``doc_word``; every flank is compared whole."""
    items, half = index.words, index.half
    begin = index.at[stretch]
    x, y = (items.start[begin + half], items.start[begin + 2 * half]) if step > 0 else (items.start[begin + half], items.start[begin])
    size = np.abs(y - x)
    out = np.zeros(len(stretch), np.int64)
    by_size = np.argsort(size, kind="stable")  # long flanks together: they take more blocks
    for s in range(0, len(by_size), lanes):
        now = by_size[s : s + lanes]
        dw, a, b, n = doc_word[now], x[now], y[now], size[now]
        doc = docs.doc[dw]
        width = int(n.max(initial=0))
        if step > 0:
            here, end = docs.start[dw + half], docs.doc_end[doc]
            pattern, text = _flank(items.stream, a, b, 1, width), _flank(docs.stream, here, end, 1, width + budget)
        else:
            here, end = docs.start[dw] - 1, docs.doc_start[doc]
            pattern, text = _flank(items.stream, a - 1, b, -1, width), _flank(docs.stream, here, end, -1, width + budget)
        edits = myers_prefix(pattern, n, text, budget)
        # a stretch whose last word goes on in the text isn't there as it is
        out[now] = np.where((edits == 0) & ~_exact(items.stream, docs.stream, docs.is_start, a, here, end, n, step), 1, edits)
    return stretch, out


def _exact(a: np.ndarray, b: np.ndarray, is_start: np.ndarray, x: np.ndarray, here: np.ndarray, end: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Whether the flank is the same character by character and ends at a word's edge."""
    width = int(size.max(initial=0))
    k = np.arange(width)
    live = k < size[:, None]
    left = (x if step > 0 else x - 1)[:, None] + step * k
    right = here[:, None] + step * k
    inside = right < end[:, None] if step > 0 else right >= end[:, None]
    same = ~live | (inside & (a[np.where(live, left, 0)] == b[np.where(live & inside, right, 0)]))
    edge = here + size if step > 0 else here - size + 1
    return same.all(axis=1) & is_start[np.clip(edge, 0, len(b))]


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 12, max_edits: int = 1, item_chars: int = 16_000_000, chunk_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id, edits``: documents that hold ``words`` consecutive words of an item.

    ``edits`` is the fewest edits (characters inserted, deleted or changed) in one half of any such stretch, the other being
    as it is; 0 for the words as they are, and 1 if only the last word goes on in the document.
    The items are a stated query set: they are read to the driver in blocks of ``item_chars`` characters (an index of about eight
    times that is broadcast) and every block is run against all documents; whole texts are searched. Items shorter than ``words`` words and
    null or empty texts give no rows; copies of documents or items are all reported. Narrow: no shuffle.
    """
    if words % 2 or not 0 <= max_edits <= 1:
        raise ValueError("words must be even; with two pieces the budget is 0 or 1 edits")
    spark = docs.sparkSession
    source = docs.where(docs[doc_text].isNotNull() & docs[doc_id].isNotNull()).select(docs[doc_id].cast("bigint").alias("doc_id"), docs[doc_text].alias("text"))
    result = None
    block: list[tuple[int, str]] = []
    held = 0

    def search(block: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex.build([x[0] for x in block], [x[1] for x in block], words // 2))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[int] = []
            texts: list[str] = []
            held = 0

            def out() -> pa.RecordBatch:
                doc, item, edits = leaks_in(index.value, Words(texts), max_edits)
                return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array(index.value.ids[item]), pa.array(edits.astype(np.int32))], names=LEAKS.names)

            for table in chunks(batches, 1):
                for i, t in zip(column(table, "doc_id").to_pylist(), column(table, "text").to_pylist()):
                    ids.append(i)
                    texts.append(plain(t))
                    held += len(t)
                    if held >= chunk_chars:
                        yield out()
                        ids, texts, held = [], [], 0
            if ids:
                yield out()

        return source.mapInArrow(run, LEAKS)

    for row in items.where(items[item_text].isNotNull()).select(item_id, item_text).toLocalIterator():
        block.append((int(row[0]), row[1]))
        held += len(row[1])
        if held >= item_chars:
            result = search(block) if result is None else result.unionByName(search(block))
            block, held = [], 0
    if block or result is None:
        result = search(block) if result is None else result.unionByName(search(block))
    return result
