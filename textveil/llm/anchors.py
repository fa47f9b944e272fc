"""Passages that occur more than once, found by anchors and extended to maximal exact repeats.

A window of ``window`` words always holds a whole block of the grid that cuts its
text into blocks of ``(window + 1) // 2`` words.  These reference blocks are the
index; every rolling window of that many words is a probe.  A probe that is in the
index and occurs twice or more is a hit.  Hits are extended: each window around one
is compared with all others that are, and the equal ones merge to maximal repeats.

Texts are dealt to blocks of some MB, one row each, in a table bucketed by block.
A block's distinct hashes go to buckets of the hash space as sorted arrays, so a
passage of many copies is one number a block, and what a bucket has found comes
back as one bit a hash: the answers join the bucketed table without moving texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textveil.llm.frames import stored
from textveil.llm.packed import edges, pack_sorted, unpack_sorted, unzipped, zipped
from textveil.llm.words import U, cut_words, scramble, slices, span_hashes
from textveil.sources.workspace import new_dir

WINDOW = 35
BLOCK_BYTES = 4 << 20  # text of a block, if no single text is longer
FILE_BYTES = 32 << 20  # text of a bucket of the block table
HASH_BYTES = 48 << 20  # text whose hashes one hash bucket takes
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Rolling:
    """Hashes of runs of words of a block's texts; runs never cross from one text to the next."""

    def __init__(self, texts: pa.Array):
        self.w = w = cut_words(texts, lower=False)
        self.h = span_hashes(w.data, w.start, w.end)
        n = len(self.h)
        self.text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        self.place = np.arange(n) - w.first[self.text]
        self.left = w.first[1:][self.text] - np.arange(n)  # words from here to the text's end

    def of(self, size: int, base: int) -> np.ndarray:
        """Hash of the ``size`` words from each place on; of no use where fewer are left."""
        n = len(self.h)
        out = np.zeros(n, U)
        if n < size:
            return out
        # powers of two of the run: a run of size 2k is two runs of k
        run, k, done, got = self.h + U(1), 1, 0, None
        while True:
            if size & k:
                if got is None:
                    got, done = run, k
                else:
                    m = min(len(run), len(got) - k)
                    got = run[:m] * _power(base, done) + got[k : k + m]
                    done += k
            k *= 2
            if k > size:
                break
            run = run[: len(run) - k // 2] * _power(base, k // 2) + run[k // 2 :]
        out[: len(got)] = scramble(got)
        return out


def _power(base: int, n: int) -> np.uint64:
    return U(pow(base, n, 1 << 64))


def _probes(r: _Rolling, anchor: int, buckets: int):
    """Distinct hashes of rolling windows in order, where each belongs, and which are of reference blocks."""
    valid = np.flatnonzero(r.left >= anchor)
    h = r.of(anchor, BASES[0])[valid]
    code = (((h >> U(32)) % U(buckets)) << U(32)) | (h & U(0xFFFFFFFF))
    distinct, back, n = np.unique(code, return_inverse=True, return_counts=True)
    reference = np.zeros(len(distinct), bool)
    reference[back[r.place[valid] % anchor == 0]] = True
    return valid, distinct, back, reference, n > 1


def _windows(r: _Rolling, hits: np.ndarray, window: int, anchor: int, buckets: int):
    """Distinct windows that hold a hit: their place, bucket, hash, check, and which occur twice here."""
    sums = np.concatenate(([0], np.cumsum(hits)))
    at = np.flatnonzero(r.left >= window)
    at = at[sums[at + window - anchor + 1] > sums[at]]
    h, g = r.of(window, BASES[0])[at], r.of(window, BASES[1])[at]
    bucket, check = ((g >> U(32)) % U(buckets)).astype(np.int64), (g & U(0xFFFF)).astype(np.uint16)
    order = np.lexsort((check, h, bucket))
    bucket, h, check = bucket[order], h[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    n = np.bincount(back, minlength=int(new.sum()))
    return at, back, bucket[new], h[new], check[new], n > 1


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, pa.RecordBatch]]:
    """Name, texts and whole row of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row.column("block")[0].as_py(), row.column("texts").flatten(), row


def _answered(row: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    """The bits of all buckets, in the order of the question."""
    found = sorted(row.column(column)[0].as_py() or [], key=lambda x: x["bucket"])
    bits = [np.unpackbits(unzipped(x["bits"], np.uint8), count=x["n"]) for x in found]
    out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    if len(out) != size:
        raise RuntimeError("a bucket's answer to a block is missing")
    return out


QUESTION = "block string, bucket int, n int, hashes binary, checks binary, marks binary"


def _question(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in QUESTION.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _blocks_of(most: int):
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", most):
            whole = pa.array([0, part.num_rows], pa.int32())
            cols = [pa.array([f"{task}-{k}"]), *[pa.ListArray.from_arrays(whole, part.column(c)) for c in ("row", "text")]]
            yield pa.RecordBatch.from_arrays(cols, ["block", "rows", "texts"])
            k += 1

    return run


def _ask_probes(anchor: int, buckets: int):
    def run(batches):
        for block, texts, _ in _texts(batches):
            _, code, _, reference, twice = _probes(_Rolling(texts), anchor, buckets)
            bucket = (code >> U(32)).astype(np.int64)
            edge, rest = edges(bucket), (code & U(0xFFFFFFFF)).astype(np.uint32)
            marks = reference.astype(np.uint8) | (twice.astype(np.uint8) << 1)
            rows = [(block, int(bucket[i]), int(j - i), pack_sorted(rest[i:j]), None, zipped(marks[i:j])) for i, j in zip(edge[:-1], edge[1:])]
            if rows:
                yield _question(rows)

    return run


def _ask_windows(window: int, anchor: int, buckets: int):
    def run(batches):
        for block, texts, row in _texts(batches):
            r = _Rolling(texts)
            _, _, bucket, h, check, twice = _windows(r, _hits(r, row, anchor, buckets), window, anchor, buckets)
            edge = edges(bucket)
            rows = [(block, int(bucket[i]), int(j - i), pack_sorted(h[i:j]), check[i:j].tobytes(), zipped(twice[i:j])) for i, j in zip(edge[:-1], edge[1:])]
            if rows:
                yield _question(rows)

    return run


def _hits(r: _Rolling, row: pa.RecordBatch, anchor: int, buckets: int) -> np.ndarray:
    """Places where a window of anchor size is a hit."""
    valid, code, back, _, _ = _probes(r, anchor, buckets)
    out = np.zeros(len(r.h), bool)
    out[valid] = _answered(row, "hits", len(code))[back]
    return out


def _answer(question: pa.Table, repeated) -> pa.Table:
    blocks, sizes = question.column("block").to_pylist(), question.column("n").to_pylist()
    found = repeated(question)
    at = np.concatenate(([0], np.cumsum(sizes)))
    bits = [zipped(np.packbits(found[i:j])) for i, j in zip(at[:-1], at[1:])]
    return pa.table({"block": pa.array(blocks), "bucket": question.column("bucket"), "n": question.column("n"), "bits": pa.array(bits, pa.binary())})


def _joined(question: pa.Table, column: str, decode) -> np.ndarray:
    return np.concatenate([decode(x) for x in question.column(column).to_pylist()])


def _repeated_probes(question: pa.Table) -> np.ndarray:
    """Which probes are in the index of reference blocks and occur more than once."""
    h = _joined(question, "hashes", lambda x: unpack_sorted(x, np.uint32))
    marks = _joined(question, "marks", lambda x: unzipped(x, np.uint8))
    index = np.unique(h[marks & 1 > 0])
    if not len(index):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(index, h), len(index) - 1)
    known = index[at] == h
    n = np.bincount(at[known], 1 + (marks[known] >> 1), minlength=len(index))
    return known & (n > 1)[at]


def _repeated_windows(question: pa.Table) -> np.ndarray:
    """Which windows occur more than once."""
    h = _joined(question, "hashes", lambda x: unpack_sorted(x, U))
    check = _joined(question, "checks", lambda x: np.frombuffer(x, np.uint16))
    twice = _joined(question, "marks", lambda x: unzipped(x, bool))
    order = np.lexsort((check, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    group = np.cumsum(new) - 1
    n = np.bincount(group, 1 + twice[order].astype(int))
    out = np.empty(len(order), bool)
    out[order] = (n > 1)[group]
    return out


def _ask(questions: DataFrame, repeated, name: str) -> DataFrame:
    """The buckets' answers, a row per block."""
    kind = "block string, bucket int, n int, bits binary"
    answers = stored(questions.groupBy("bucket").applyInArrow(lambda q: _answer(q, repeated), kind), name)
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))


def _removed(window: int, anchor: int, buckets: int):
    def run(batches):
        for _, texts, row in _texts(batches):
            r = _Rolling(texts)
            at, back, bucket, _, _, _ = _windows(r, _hits(r, row, anchor, buckets), window, anchor, buckets)
            equal = at[_answered(row, "equal", len(bucket))[back]]
            change = np.bincount(equal, minlength=len(r.h) + 1) - np.bincount(np.minimum(equal + window, len(r.h)), minlength=len(r.h) + 1)
            covered = np.cumsum(change[:-1]) > 0
            yield _output(r, covered, texts, row.column("rows").flatten())

    return run


def _output(r: _Rolling, covered: np.ndarray, texts: pa.Array, rows: pa.Array) -> pa.RecordBatch:
    w, count = r.w, len(texts)
    begins = covered & np.concatenate(([True], ~covered[:-1] | (r.text[1:] != r.text[:-1])))[: len(covered)]
    ends = covered & np.concatenate((~covered[1:] | (r.text[1:] != r.text[:-1]), [True]))[: len(covered)]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    spans = pa.StructArray.from_arrays([pa.array(r.place[first]), pa.array(r.place[last] + 1)], ["start", "end"])
    offsets = np.searchsorted(r.text[first], np.arange(count + 1))
    keep = np.flatnonzero(~covered)
    size = (w.end - w.start)[keep] + 1  # with a space behind
    goes = np.concatenate(([0], np.cumsum(size)))
    pick = np.arange(goes[-1]) + np.repeat(w.start[keep] - goes[:-1], size)
    data = np.append(w.data, np.uint8(32))[np.minimum(pick, len(w.data))]
    data[goes[1:] - 1] = 32
    kept = np.searchsorted(r.text[keep], np.arange(count + 1))
    left = np.diff(kept)
    # each text without the space behind its last word
    inner = np.ones(len(data), bool)
    inner[goes[kept[1:][left > 0]] - 1] = False
    length = np.maximum(np.diff(goes[kept]) - 1, 0)
    buffers = [None, pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int64)), pa.py_buffer(data[inner])]
    text = pa.Array.from_buffers(pa.large_string(), count, buffers).cast(pa.string())
    words = np.diff(w.first)
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(words), pa.array(words - left), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), text],
        ["row", "n_words", "n_removed", "spans", "kept"],
    )


def without_repeats(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES, hash_bytes: int = HASH_BYTES,
) -> DataFrame:
    """Each text without the words of any window of ``window`` words that starts elsewhere, too.

    Words are runs without white space, compared as they are; the same text counts as
    elsewhere at another place.  Columns: row (the ``keep`` columns), n_words,
    n_removed, spans (the repeats: start and end in words), kept (the words left,
    with single spaces).

    A null text has no words; repeated rows repeat each other; an empty table
    gives no rows.
    """
    if window < 1:
        raise ValueError("a window has one word or more")
    spark = docs.sparkSession
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kind = rows.schema["row"].dataType.simpleString()
    buckets, anchor = max(1, -(-total // hash_bytes)), (window + 1) // 2
    # with fewer buckets than shuffle partitions Spark would rather move the texts than the answers
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    blocks = rows.mapInArrow(_blocks_of(block_bytes), f"block string, rows array<{kind}>, texts array<string>")
    name = f"blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(files, "block").write.bucketBy(files, "block").option("compression", "zstd")
    writer.option("path", new_dir(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    hits = _ask(blocks.select("block", "texts").mapInArrow(_ask_probes(anchor, buckets), QUESTION), _repeated_probes, "hits")
    found = blocks.join(hits, "block", "left")
    equal = _ask(found.select("block", "texts", "hits").mapInArrow(_ask_windows(window, anchor, buckets), QUESTION), _repeated_windows, "equal")
    out = f"row {kind}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    return found.join(equal, "block", "left").mapInArrow(_removed(window, anchor, buckets), out)
