"""Katz backoff language model of word pairs, counted and asked over the whole corpus.

A pair that training has seen gets its Good-Turing discounted share of its first
word's followers; any other gets what the discounts left over, shared out by the
discounted word frequencies of words not seen there, so that each word's followers
add up to exactly 1 over the vocabulary and one unknown word.

The vocabulary and the pairs grow with the corpus and are never in one place.  A
task cuts its documents into blocks, and sends each bucket of the hash space the
block's distinct words (then pairs) with their counts in training texts, as packed
arrays in a row.  A bucket adds up, keeps its part of the count table, and answers
each block in the order of its question.  With a word's count goes its number, small
for frequent words, and pairs are sent and kept as their words' numbers, which take
a third of their hashes' bytes.  Pairs go by their first word, so a bucket
knows all followers; frequent first words are spread by the whole pair, and their
few sums come together afterwards.  Count tables and answers are tables in the
shared folder, the answers with a folder per block.

The documents are read three times and must come in the same blocks each time, as
they do from files; a checksum in each answer tells if they do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textveil.llm.frames import bounded_batches
from textveil.llm.words import U, cut_words, pair, slices, span_hashes
from textveil.sources.workspace import new_dir

BEGIN, END = U(1), U(2)
FIRST = U(2)  # least number of a word; BEGIN is its own number
BLOCK = 6 << 20
LOW = 5  # counts up to this one are discounted
ROW = "kind string, bucket int, block string, a binary, b binary, c binary, d binary, check bigint"


def _zip(x: np.ndarray) -> bytes:
    """Compressed with the first bytes of all numbers together, then the second ones and so on.

    Most numbers are small, so that most of these planes are nearly empty.
    """
    import zstandard

    planes = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _zip_runs(x: np.ndarray) -> bytes:
    """Numbers of which equal ones follow each other: each once, and how many there are."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    values, sizes = _zip(x[at]), _zip(np.diff(np.append(at, len(x))).astype(np.uint32))
    return len(values).to_bytes(8, "little") + values + sizes


def _unzip_runs(x: bytes) -> np.ndarray:
    edge = 8 + int.from_bytes(x[:8], "little")
    return np.repeat(_unzip(x[8:edge], U), _unzip(x[edge:], np.uint32))


class Block:
    """Words of some documents: distinct ones in order, and where they occur."""

    def __init__(self, parts: list[pa.RecordBatch]):
        keys, ends, at = [], [], 0
        for part in parts:
            w = cut_words(part.column("text"))
            h = span_hashes(w.data, w.start, w.end)
            h = np.where(h < U(16), h + U(16), h)
            stop = w.first[1:] + np.arange(1, len(w.first)) - 1  # where each text's end goes
            whole = np.empty(len(h) + len(stop), U)
            inner = np.ones(len(whole), bool)
            inner[stop] = False
            whole[stop], whole[inner] = END, h
            keys.append(whole)
            ends.append(stop + at)
            at += len(whole)
        tokens = np.concatenate(keys)
        self.ends = np.concatenate(ends)
        self.ids = pa.chunked_array([p.column("doc_id") for p in parts]).combine_chunks()
        self.train = np.concatenate([p.column("train").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
        self.doc = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(np.concatenate(([-1], self.ends))))
        order = np.argsort(tokens)
        ranked = tokens[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.words = ranked[new]
        self.word = np.empty(len(tokens), np.int32)
        self.word[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.counts = np.bincount(self.word[self.train[self.doc]], minlength=len(self.words)).astype(np.uint32)
        self.check = int(np.bitwise_xor.reduce(self.words).view(np.int64)) if len(self.words) else 0

    def pairs(self) -> None:
        """Distinct pairs: first word (the number of words stands for the beginning), second word."""
        first = np.concatenate(([0], self.word[:-1]))
        begins = np.concatenate(([0], self.ends[:-1] + 1))
        first[begins] = len(self.words)
        code = first.astype(np.int64) * (len(self.words) + 1) + self.word
        order = np.argsort(code)
        ranked = code[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.pair = np.empty(len(code), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.left, self.right = np.divmod(ranked[new], len(self.words) + 1)
        self.pair_counts = np.bincount(self.pair[self.train[self.doc]], minlength=int(new.sum())).astype(np.uint32)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for part in slices(batches, "text", 1 << 20):
        held.append(part)
        size += part.column("text").nbytes
        if size >= BLOCK:
            yield f"{task}-{k}", Block(held)
            k, held, size = k + 1, [], 0
    if held:
        yield f"{task}-{k}", Block(held)


def _row(kind, bucket=None, block=None, a=None, b=None, c=None, d=None, check=None) -> pa.RecordBatch:
    values = [kind, bucket, block, a, b, c, d, check]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = ["kind", "bucket", "block", "a", "b", "c", "d", "check"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each bucket; they arrive sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class Answers:
    """Reads what the buckets answered a block."""

    def __init__(self, folder: str):
        self.folder = folder

    def of(self, block: str, check: int) -> dict[int, dict]:
        import pyarrow.parquet as pq

        from textveil.llm.warc import file_system

        fs, path = file_system(self.folder)
        rows = pq.read_table(f"{path}/block={block}", filesystem=fs, partitioning=None).to_pylist()
        if any(r["check"] != check for r in rows):
            raise RuntimeError("documents came in other blocks than before; write them to a table first")
        return {r["bucket"]: r for r in rows}


def _ask(name: str, ask: Callable, answer: Callable, docs: DataFrame, buckets: int) -> tuple[str, DataFrame, DataFrame]:
    """Send blocks' questions to buckets; the folder of answers, the count tables, and sums."""
    spark = docs.sparkSession
    questions = docs.mapInArrow(ask, ROW).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    path = new_dir(spark, name)
    questions.mapInArrow(answer, ROW).write.partitionBy("kind").parquet(path)
    schema = ", ".join(x for x in ROW.split(", ") if not x.startswith("kind"))
    read = lambda kind: spark.read.schema(schema).parquet(f"{path}/kind={kind}")
    folder = new_dir(spark, f"{name}-answers")
    read("answer").repartition(buckets, "block").write.partitionBy("block").parquet(folder)
    return folder, read("counts"), read("sums")


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(33)) % U(buckets)).astype(np.int64)


def _ask_words(buckets: int):
    def run(batches):
        for name, b in _blocks(batches):
            at = _bucket_of(b.words, buckets)
            for k in np.unique(at):
                mine = at == k
                yield _row("question", int(k), name, _zip(b.words[mine]), _zip(b.counts[mine]), check=b.check)
            del b, at  # before the next block is made

    return run


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, LOW + 2), minlength=LOW + 3)[: LOW + 2]


def _answer_words(buckets: int):
    def run(batches):
        for rows in _groups(batches):
            keys = [_unzip(r["a"], U) for r in rows]
            words, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(words), np.int64)
            np.add.at(total, back, np.concatenate([_unzip(r["b"], np.uint32) for r in rows]))
            bucket, at = rows[0]["bucket"], 0
            often = np.argsort(-total, kind="stable")  # most frequent first
            number = np.empty(len(words), U)
            number[often] = np.arange(len(words), dtype=U) * U(buckets) + U(bucket) + FIRST
            for r, k in zip(rows, keys):
                mine = back[at : at + len(k)]
                yield _row("answer", bucket, r["block"], _zip(total[mine].astype(np.uint32)), _zip(number[mine]), check=r["check"])
                at += len(k)
            known = often[total[often] > 0]
            yield _row("counts", bucket, a=_zip(words[known]), b=_zip(total[known]), c=_zip(number[known]))
            yield _row("sums", bucket, a=np.append(_count_of_counts(total), [total.sum(), len(known)]).astype(np.int64).tobytes())

    return run


def _added(sums: DataFrame, n: int) -> np.ndarray:
    """Sum of small arrays of numbers, one per bucket."""
    def run(batches):
        out = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column("a"):
                out += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(out)], ["i", "v"])

    rows = sums.select("a").mapInArrow(run, "i bigint, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n, np.int64)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def good_turing(n: np.ndarray) -> np.ndarray:
    """Factor for each count from 0 to LOW, from how many things have each count up to LOW + 1.

    Katz's formula; where the counts of counts do not bear it out, the next best
    discount (r - 1/2) / r.
    """
    d = np.ones(LOW + 1)
    share = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    for r in range(1, LOW + 1):
        value = np.nan
        if n[r] and share < 1:
            value = ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share)
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LOW, d[np.minimum(counts, LOW)], 1.0)


class Lower:
    """Discounted word frequencies; what is left is the unknown word's."""

    def __init__(self, n: np.ndarray, total: int):
        self.d = good_turing(n)
        lost = float(sum((1 - self.d[r]) * r * n[r] for r in range(1, LOW + 1)))
        self.total = total if lost > 0 or not total else total + 0.5
        self.unknown = lost / self.total if lost > 0 else (0.5 / self.total if total else 1.0)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(counts, self.d) / max(self.total, 1), self.unknown)


def _word_counts(b: Block, rows: dict[int, dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's words in all training texts, and their numbers."""
    at = _bucket_of(b.words, buckets)
    counts, numbers = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), U)
    for k, r in rows.items():
        mine = at == k
        counts[mine], numbers[mine] = _unzip(r["a"], np.uint32), _unzip(r["b"], U)
    return counts, numbers


def _pair_plan(b: Block, counts: np.ndarray, numbers: np.ndarray, buckets: int, hot: float):
    """Number of each pair's first word, whether it is spread, the pair's bucket and the order of the question."""
    words = np.append(b.words, BEGIN)
    left = words[b.left]
    often = np.append(counts, np.iinfo(np.int64).max)[b.left] >= hot
    bucket = np.where(often, _bucket_of(pair(left, b.words[b.right]), buckets), _bucket_of(left, buckets))
    left = np.append(numbers, BEGIN)[b.left]
    order = np.lexsort((left, bucket))
    return left, often, bucket, order


def _ask_pairs(words: Answers, buckets: int, hot: float):
    def run(batches):
        for name, b in _blocks(batches):
            b.pairs()
            counts, numbers = _word_counts(b, words.of(name, b.check), buckets)
            left, often, bucket, order = _pair_plan(b, counts, numbers, buckets, hot)
            edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
            for i, j in zip(edge[:-1], edge[1:]):
                o = order[i:j]
                yield _row("question", int(bucket[o[0]]), name, _zip(numbers[b.right[o]]), _zip_runs(left[o]), _zip(b.pair_counts[o]), _zip((counts[b.right[o]] * 2 + often[o]).astype(np.uint64)), b.check)
            del b, counts, numbers, left, often, bucket, order, o

    return run


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, ascending with the first, then the second."""
    base = int(right.max()) + 1 if len(right) else 1
    if len(left) and int(left.max()) >= (1 << 64) // base:  # products beyond 64 bits: the first ones by rank
        left = np.unique(left, return_inverse=True)[1].astype(U)
    return left * U(base) + right


def _answer_pairs(lower: Lower):
    def run(batches):
        for rows in _groups(batches):
            right = [_unzip(r.pop("a"), U) for r in rows]
            sizes = [len(x) for x in right]
            right = np.concatenate(right)
            left = np.concatenate([_unzip_runs(r.pop("b")) for r in rows])
            distinct, sample, back = np.unique(_codes(left, right), return_index=True, return_inverse=True)
            right = right[sample]
            back = back.astype(np.int32)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, np.concatenate([_unzip(r.pop("c"), np.uint32) for r in rows]))
            extra = np.concatenate([_unzip(r.pop("d"), U) for r in rows])[sample]
            seen = total > 0
            firsts, place = np.unique(left[sample], return_inverse=True)
            # for each first word: how many followers were seen 1 to LOW times, and their frequency
            table = np.zeros((len(firsts), LOW + 1))
            for r in range(1, LOW + 1):
                table[:, r - 1] = np.bincount(place[total == r], minlength=len(firsts))
            table[:, LOW] = np.bincount(place[seen], lower((extra[seen] >> U(1)).astype(np.int64)), minlength=len(firsts))
            bucket, at = rows[0]["bucket"], 0
            for r, size in zip(rows, sizes):
                own = total[back[at : at + size]]
                mine = left[at : at + size]
                ask = np.unique(mine[own == 0])  # only unseen pairs need the first word's sums; the block knows which
                values = table[np.searchsorted(firsts, ask)]
                yield _row("answer", bucket, r["block"], _zip(own.astype(np.uint32)), _zip(values), check=r["check"])
                at += size
            yield _row("counts", bucket, a=_zip(right[seen]), b=_zip_runs(left[sample][seen]), c=_zip(total[seen]))
            spread = np.bincount(place, (extra & U(1)).astype(float), minlength=len(firsts)) > 0
            yield _row("sums", bucket, a=_count_of_counts(total).astype(np.int64).tobytes(), b=_zip(firsts[spread]), c=_zip(table[spread]))

    return run


def _spread_sums(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of first words that are spread over buckets; as few as can be that frequent."""
    def run(batches):
        for batch in batches:
            for b, c in zip(batch.column("b"), batch.column("c")):
                first, table = _unzip(b.as_py(), np.int64), _unzip(c.as_py(), float).reshape(-1, LOW + 1)
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(first), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(LOW + 1)]], ["w", *[f"t{i}" for i in range(LOW + 1)]])

    names = [f"t{i}" for i in range(LOW + 1)]
    rows = sums.select("b", "c").mapInArrow(run, "w bigint, " + ", ".join(f"{x} double" for x in names))
    got = rows.groupBy("w").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    keys = got["w"].to_numpy(np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], got[names].to_numpy(float)[order]


def _score(words: Answers, pairs: Answers, buckets: int, hot: float, total: int, n_words: int, n_texts: int, lower: Lower, d: np.ndarray, spread):
    def run(batches):
        keys, sums = spread.value
        for name, b in _blocks(batches):
            b.pairs()
            counts, numbers = _word_counts(b, words.of(name, b.check), buckets)
            left, often, bucket, order = _pair_plan(b, counts, numbers, buckets, hot)
            base = np.append(counts, n_texts)[b.left]
            seen, six = np.zeros(len(left), np.int64), np.zeros((len(left), LOW + 1))
            edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
            rows = pairs.of(name, b.check)
            for i, j in zip(edge[:-1], edge[1:]):
                o = order[i:j]
                r = rows[int(bucket[o[0]])]
                seen[o] = _unzip(r["a"], np.uint32)
                ask, values = np.unique(left[o][seen[o] == 0]), _unzip(r["b"], float).reshape(-1, LOW + 1)
                need = o[(seen[o] == 0) & ~often[o]]
                if len(need):
                    six[need] = values[np.searchsorted(ask, left[need])]
            need = np.flatnonzero((seen == 0) & often & (base > 0))
            if len(need):
                six[need] = sums[np.searchsorted(keys, left[need])]
            low = lower(counts[b.right])
            lost = (six[:, :LOW] * ((1 - d[1:]) * np.arange(1, LOW + 1))).sum(1)
            # half a count of every first word is kept for followers it was not seen with,
            # also where none of its counts is low enough to be discounted
            p = np.where(base > 0, (lost + 0.5) / (base + 0.5) / np.maximum(1 - six[:, LOW], 1e-12) * low, low)
            p = np.where(seen > 0, _discounted(seen, d) / (base + 0.5), p)
            token = np.log10(p)[b.pair]
            n = len(b.ends)
            plain = np.log10((counts + 0.1) / (total + 0.1 * (n_words + 1)))[b.word]
            known = (counts > 0)[b.word]
            yield pa.RecordBatch.from_arrays(
                [b.ids, pa.array(~b.train), pa.array(np.bincount(b.doc, minlength=n)), pa.array(np.bincount(b.doc[known], minlength=n)), pa.array(np.full(n, total)),
                 pa.array(np.bincount(b.doc, plain, minlength=n)), pa.array(np.bincount(b.doc, token, minlength=n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del b, counts, numbers, left, often, bucket, order, base, seen, six, rows, low, lost, p, token, plain, known

    return run


def score_texts(docs: DataFrame, train: Column, buckets: int | None = None) -> DataFrame:
    """log10 probability of each text under a model of those for which ``train`` holds.

    Words are lower-cased (A-Z) runs without white space; a text is its words and an
    end.  Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    words' frequencies with 0.1 added), score.

    A null or empty text is its end alone; a null condition counts as training;
    repeated rows count as often as they occur; without training texts every word
    is the unknown word; an empty table gives an empty result.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train"))
    if not docs.take(1):
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    folder, _, sums = _ask("words", _ask_words(buckets), _answer_words(buckets), rows, buckets)
    stats = _added(sums, LOW + 4)
    total, n_words = int(stats[-2]), int(stats[-1])
    n_texts = rows.where("train").count()
    lower, hot = Lower(stats, total), max(100.0, total / (4 * buckets))
    words = Answers(folder)
    folder, _, sums = _ask("pairs", _ask_pairs(words, buckets, hot), _answer_pairs(lower), rows, buckets)
    d = good_turing(_added(sums, LOW + 2))
    spread = spark.sparkContext.broadcast(_spread_sums(sums))
    score = _score(words, Answers(folder), buckets, hot, total, n_words, n_texts, lower, d, spread)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
