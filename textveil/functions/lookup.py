"""Word lists and term lists of any kind looked up in batches of texts.

Both functions are Column -> Column over Arrow batches, so they need no shuffle
and work on streams.  A list goes to the executors once, as a broadcast; each
Python worker compiles it once.

Words are found by hash: all words of a batch at a time, in arrays of code points,
and what is found is compared with the word itself.  Terms, which may hold spaces
and any other character, are found by one automaton for all lists.
"""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from textveil.functions.text import as_col

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"
SLICE_CHARS = 1 << 20
KEPT = 8  # compiled lists that a worker keeps

_U = np.uint64
_compiled: OrderedDict = OrderedDict()
_classes: list[np.ndarray] = []


class Terms(NamedTuple):
    """The entries of one entity type."""

    entity_type: str
    terms: Sequence[str]
    score: float
    merge: bool = False  # hits with one space between them become one span


def _shared(value):
    """A function that gives ``value`` in a task, and what it is known by."""
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(value)
    return uuid.uuid4().hex, sent


def _once(key: str, make: Callable):
    """What ``make`` gives, kept in this process with the last few others."""
    if key not in _compiled:
        _compiled[key] = make()
        while len(_compiled) > KEPT:
            _compiled.popitem(last=False)
    _compiled.move_to_end(key)
    return _compiled[key]


def word_characters() -> np.ndarray:
    """For each code point, if it is a letter, a number or an underscore."""
    if not _classes:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LN"]] = True
        table[ord("_")] = True
        _classes.append(table)
    return _classes[0]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points that begin at ``starts`` and follow each other."""
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    mixed = _scramble((points.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + place.astype(_U))
    return _scramble(np.add.reduceat(mixed, starts)) if len(starts) else np.zeros(0, _U)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins, and the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = held.to_pybytes()[offsets[0] : offsets[-1]] if held is not None else b""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return points, leads[offsets - offsets[0]]


def _slices(texts: pa.Array):
    """Consecutive texts of some SLICE_CHARS bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // SLICE_CHARS
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for i, j in zip(edges[:-1], edges[1:]):
        yield texts.slice(i, j - i)


class _WordTable:
    def __init__(self, lists: Sequence[Sequence[str]]):
        self.number: dict[str, int] = {}  # earlier lists win
        for i, words in reversed(list(enumerate(lists))):
            self.number.update(dict.fromkeys(words, i))
        self.number.pop("", None)
        words = pa.array(list(self.number), pa.string())
        points, starts = _points(words)
        self.hashes = np.sort(_hashes(points, starts[:-1]))

    def hits(self, points: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, list) of each token whose word characters are a listed word."""
        if not len(points) or not len(self.hashes):
            return []
        space = points == 32
        first = np.zeros(len(points), bool)
        first[begin[:-1][np.diff(begin) > 0]] = True
        token = np.cumsum(space.astype(np.int64) + first)
        at = np.flatnonzero(word_characters()[points])
        of = token[at]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        found = _hashes(points[at], starts)
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == found)
        if not len(hit):
            return []
        ends = np.append(starts[1:], len(at))
        spaces = np.flatnonzero(space)
        out = []
        for k in hit.tolist():
            chars = at[starts[k] : ends[k]]
            which = self.number.get(points[chars].tobytes().decode("utf-32-le"))
            if which is None:
                continue
            text = np.searchsorted(begin, chars[0], "right") - 1
            i = np.searchsorted(spaces, chars[0])
            left = max(begin[text], spaces[i - 1] + 1 if i else 0)
            right = min(begin[text + 1], spaces[i] if i < len(spaces) else len(points))
            out.append((int(left), int(right), which))
        return out


def mask_words(squashed, lists: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Tokens whose word characters are a listed word replaced by their list's mask.

    The tokens of ``squashed`` have one space between them.  Earlier lists win.
    A null text stays null.
    """
    masks = [mask for _, mask in lists]
    key, sent = _shared([list(words) for words, _ in lists])

    def rewrite(texts: pa.Array) -> pa.Array:
        table = _once(key, lambda: _WordTable(sent.value))
        parts = [_masked(part, table, masks) for part in _slices(texts)]
        return pa.concat_arrays(parts) if parts else texts

    return F.arrow_udf(rewrite, "string")(as_col(squashed))


def _masked(texts: pa.Array, table: _WordTable, masks: Sequence[str]) -> pa.Array:
    points, begin = _points(texts)
    hits = table.hits(points, begin)
    if not hits:
        return texts
    changed, at = {}, 0
    numbers = (np.searchsorted(begin, [h[0] for h in hits], "right") - 1).tolist()
    while at < len(hits):
        text, pieces, done = numbers[at], [], int(begin[numbers[at]])
        while at < len(hits) and numbers[at] == text:
            left, right, which = hits[at]
            pieces += [points[done:left].tobytes().decode("utf-32-le"), masks[which]]
            done, at = right, at + 1
        pieces.append(points[done : begin[text + 1]].tobytes().decode("utf-32-le"))
        changed[text] = "".join(pieces)
    where = np.zeros(len(texts), bool)
    where[list(changed)] = True
    return pc.replace_with_mask(texts, pa.array(where), pa.array([changed[i] for i in sorted(changed)], texts.type))


class _Finder:
    """All entries of all kinds in one automaton."""

    def __init__(self, kinds: Sequence[Terms]):
        import ahocorasick

        of: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for term in set(kind.terms):
                if term:
                    of.setdefault(term, []).append(i)
        self.kinds, self.tree = kinds, ahocorasick.Automaton()
        for term, which in of.items():
            self.tree.add_word(term, (len(term), tuple(which)))
        if of:
            self.tree.make_automaton()
        self.empty, self.letters = not of, word_characters()

    def spans(self, text: str, only: int | None = None) -> list[tuple[int, int, int]]:
        """(kind, start, end): of each kind the leftmost hits, at a place the longest, bounded by non-word characters.

        ``only`` names the one kind that is looked for.
        """
        longest: dict[int, dict[int, int]] = {}
        letters, last = self.letters, len(text)
        for end, (size, which) in self.tree.iter(text):
            start, end = end - size + 1, end + 1
            if (start and letters[ord(text[start - 1])]) or (end < last and letters[ord(text[end])]):
                continue
            for kind in which if only is None else (only,) if only in which else ():
                ends = longest.setdefault(kind, {})
                if ends.get(start, 0) < end:
                    ends[start] = end
        out = []
        for kind in sorted(longest):
            ends, done, merge = longest[kind], 0, self.kinds[kind].merge
            for start in sorted(ends):
                if start < done:
                    continue
                done = ends[start]
                while merge and done + 1 in ends and text[done] == " ":
                    done = ends[done + 1]
                out.append((kind, start, done))
        return out


def find_terms(txt, kinds: Sequence[Terms]) -> Column:
    """Spans of the entries of all kinds, each kind by itself, in the order of the kinds.

    An entry counts where no word character is right before or behind it.  No spans
    for a null text.
    """
    key, sent = _shared([k._replace(terms=list(k.terms)) for k in kinds])

    def find(texts: pa.Array) -> pa.Array:
        finder = _once(key, lambda: _Finder(sent.value))
        return _found(finder, texts, [None] * len(texts))

    return F.arrow_udf(find, SPANS)(as_col(txt))


def find_terms_as_of(txt, micros, versions: Sequence[tuple[int, Terms]]) -> Column:
    """Spans of the entries of the version in force at each row's own time.

    ``versions`` are ``(from when on, entries)``, times in microseconds like
    ``micros``.  No spans for a row without a time or before the first version.
    """
    versions = sorted(versions, key=lambda v: v[0])
    since = [v[0] for v in versions]
    key, sent = _shared([v[1]._replace(terms=list(v[1].terms)) for v in versions])

    def find(texts: pa.Array, times: pa.Array) -> pa.Array:
        finder = _once(key, lambda: _Finder(sent.value))
        return _found(finder, texts, [-1 if t is None else bisect_right(since, t) - 1 for t in times.to_pylist()])

    return F.arrow_udf(find, SPANS)(as_col(txt), as_col(micros))


def _found(finder: _Finder, texts: pa.Array, only: Sequence[int | None]) -> pa.Array:
    offsets, rows = [0], []
    for text, one in zip(texts.to_pylist(), only):
        if text and not finder.empty and one != -1:
            rows += [(finder.kinds[k].entity_type, a, b, finder.kinds[k].score, text[a:b]) for k, a, b in finder.spans(text, one)]
        offsets.append(len(rows))
    kinds_of = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
    cols = list(zip(*rows)) if rows else [()] * 5
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of)], ["entity_type", "start", "end", "score", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def without_overlaps(spans) -> Column:
    """Of spans that overlap only the best, in text order.

    Better is a higher score, then longer, earlier, and the entity type.  Of spans in
    text order any two overlap only if two neighbours do, so only texts with such
    neighbours are looked at closer; there a span is compared with the one kept span
    that could reach it, so the work is that of sorting.
    """
    def choose(lists: pa.Array) -> pa.Array:
        offsets, values = lists.offsets.to_numpy(), lists.values
        values = values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        start, end, score = (values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "end", "score"))
        types = values.field("entity_type").fill_null("").dictionary_encode()
        names = sorted(types.dictionary.to_pylist(), key=str.encode)
        rank = np.array([names.index(t) for t in types.dictionary.to_pylist()], int)
        kind = rank[types.indices.to_numpy()] if len(values) else np.zeros(0, int)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        order = np.lexsort((-score, kind, -end, start, row))
        kept = np.ones(len(values), bool)
        cross = (row[order][1:] == row[order][:-1]) & (start[order][1:] < end[order][:-1])
        for r in np.unique(row[order][1:][cross]).tolist():
            i, j = offsets[r], offsets[r + 1]
            begins: list[int] = []
            ends: list[int] = []
            for k in (i + np.lexsort((kind[i:j], start[i:j], start[i:j] - end[i:j], -score[i:j]))).tolist():
                at = bisect_left(begins, end[k])
                if at and ends[at - 1] > start[k]:
                    kept[k] = False
                    continue
                at = bisect_left(begins, start[k])
                begins.insert(at, int(start[k]))
                ends.insert(at, int(end[k]))
        order = order[kept[order]]
        left = np.concatenate(([0], np.cumsum(np.bincount(row[order], minlength=len(lists)))))
        return pa.ListArray.from_arrays(pa.array(left, pa.int32()), values.take(pa.array(order)))

    return F.arrow_udf(choose, SPANS)(as_col(spans))
