"""Pack token sequences by cost.

Attention costs a linear and a quadratic part of a piece's length.  Pieces go in
descending order to the sequence of lowest cost that has room for them; a piece
that fits nowhere whole is cut into what room is left.  A task packs the rows it
reads in groups of a few million tokens, so no row moves and a group's memory is
bounded.  A group of T tokens gets T // capacity full sequences and, for the
rest, sequences of the powers of two that add up to it, so none needs padding.

Tokenizing is the dear part.  White space ends a token, hence each distinct word
is tokenized once per Python worker and looked up by its hash after that.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from textveil.llm.memory import held, trimmed
from textveil.llm.words import LOWER, cut_words, slices, span_hashes

GROUP = 1 << 22
SLICE = 1 << 20  # bytes of text whose words are looked up at a time
KNOWN_MOST = 1_000_000  # words that a worker remembers; it starts anew beyond
JOINED = 50


class WordIds:
    """Token ids of words, remembered by hash."""

    def __init__(self, path: str):
        # a task has one core; threads of their own would each keep memory, too
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = zero[0] if len(zero) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)  # of each key in first, by order of arrival
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word.  Plain words go many at a time with a known sign between."""
        plain = [i for i, w in enumerate(words) if self.zero is not None and "0" not in w and "<" not in w]
        out: list = [None] * len(words)
        lines = [" 0 ".join(words[i] for i in plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        for k in range(0, len(lines), 200):
            for n, e in enumerate(self.tokenizer.encode_batch_fast(lines[k : k + 200], add_special_tokens=False), k):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(ids == self.zero)
                edges = np.concatenate(([-1], at, [len(ids)]))
                for j, i in enumerate(plain[n * JOINED : (n + 1) * JOINED]):
                    out[i] = ids[edges[j] + 1 : edges[j + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def look_up(self, data, start, end, keys) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids one after another."""
        if len(self.keys) > KNOWN_MOST:
            self.forget()
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, sample = ranked[new], order[new]
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            fresh = sample[~known]
            got = self.encode([bytes(data[start[i] : end[i]]).decode("utf-8", "replace") for i in fresh])
            place = len(self.first) - 1 + np.arange(len(got), dtype=np.int32)
            ends = self.first[-1] + np.cumsum([len(x) for x in got])
            self.first = np.concatenate([self.first, ends])
            self.ids = np.concatenate([self.ids, *got])
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.place = np.insert(self.place, at[~known], place)
            at = np.searchsorted(self.keys, distinct)
        places = np.empty(len(keys), np.int64)
        places[order] = self.place[at][np.cumsum(new) - 1]
        lengths = self.first[places + 1] - self.first[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        pick = np.repeat(self.first[places] - (ends - lengths), lengths) + np.arange(total)
        return lengths, self.ids[pick]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and how many each has."""
    known: WordIds = held(("packing", path), lambda: WordIds(path))
    w = cut_words(texts, lower=False)
    data = LOWER[w.data]
    # what may be a special token keeps its case
    angle = np.concatenate(([0], np.cumsum(w.data == 60)))
    for i in np.flatnonzero(angle[w.end] > angle[w.start]):
        data[w.start[i] : w.end[i]] = w.data[w.start[i] : w.end[i]]
    # a full stop or comma after a letter or digit is a token of its own
    last = data[w.end - 1]
    before = data[np.maximum(w.end - 2, 0)]
    letter = ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57))
    cut = (w.end - w.start > 1) & ((last == 46) | (last == 44)) & letter
    at = np.arange(len(cut)) + np.cumsum(cut) - cut
    start, end = np.empty(len(cut) + cut.sum(), np.int64), np.empty(len(cut) + cut.sum(), np.int64)
    start[at], end[at] = w.start, w.end - cut
    start[at[cut] + 1], end[at[cut] + 1] = w.end[cut] - 1, w.end[cut]
    first = np.append(at, len(start))[w.first]
    lengths, ids = known.look_up(data, start, end, span_hashes(data, start, end))
    sums = np.concatenate(([0], np.cumsum(lengths)))
    return ids, np.diff(sums[first])


def place(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group.

    ``quadratic`` is the cost of a pair of tokens that see each other; left out,
    a full sequence of one piece costs as much for attention as for the rest.
    """
    quadratic = linear / capacity if quadratic is None else quadratic
    whole, rest = divmod(int(lengths.sum()), capacity)
    room = np.array([capacity] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    out = []

    def put(doc: int, start: int, length: int, to: int) -> None:
        out.append((doc, start, length, to, int(size[to] - room[to])))
        room[to] -= length
        cost[to] += linear * length + quadratic * length * length

    tails, used = [], 0
    for doc in np.argsort(-lengths, kind="stable"):
        n = int(lengths[doc])
        if n < capacity:
            tails.append((n, int(doc), 0))
            continue
        for start in range(0, n - capacity + 1, capacity):
            put(int(doc), start, capacity, used)
            used += 1
        if n % capacity:
            tails.append((n % capacity, int(doc), n - n % capacity))
    tails.sort(key=lambda x: (-x[0], x[1]))
    for n, doc, start in tails:
        while n:
            best = int(np.where(room >= n, cost, np.inf).argmin())
            if room[best] < n:
                best = int(np.where(room > 0, cost, np.inf).argmin())
            length = min(n, int(room[best]))
            put(doc, start, length, best)
            start, n = start + length, n - length
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone.  Rows with equal or null ids are
    documents of their own.  An empty table gives an empty result.  A long text
    is cut into full sequences and one rest; only doc_id and text are read.
    """
    id_field = docs.schema["doc_id"]
    schema = T.StructType(
        [T.StructField("doc_id", id_field.dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
         T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_sequences = TaskContext.get().partitionId() << 33, 0
        names: list = []
        ids: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal n_sequences
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = sorted(place(lengths, capacity), key=lambda p: (p[3], p[4]))
            for k in range(0, len(pieces), 2000):
                some = pieces[k : k + 2000]
                doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*some))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([names[d] for d in doc]), pa.array(start), pa.array(length),
                     pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length)], pa.binary()),
                     pa.array(lengths[doc]), pa.array(seq + base + n_sequences), pa.array(offset)], names=schema.names
                )
            n_sequences += 1 + max(p[3] for p in pieces)
            names.clear()
            ids.clear()

        held = 0
        for part in slices(batches, "text", SLICE):
            all_ids, counts = token_ids(part.column("text"), tokenizer)
            trimmed()
            key = part.column("doc_id")
            at = 0
            for i, n in enumerate(counts):
                own = np.append(all_ids[at : at + n], np.uint32(end_id))
                at += n
                names.append(key.slice(i, 1))
                ids.append(own)
                held += len(own)
                if held >= group:
                    yield from packed()
                    held = 0
        if ids:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
