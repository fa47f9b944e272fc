"""Collocations of two and three words from a weighted de Bruijn graph, per language.

Texts are cut into pieces at punctuation and pieces into words.  Every word starts
one longest gram of three words; where its piece ends earlier, the rest is END.
Only these grams are counted.  They are the edges of a graph whose nodes are pairs
of words: a node's flow, the sum of the edges that leave it and of its END
corrections, is how often the pair occurs, and the flow of all nodes that begin
with a word (and of that word's END) is how often the word occurs.

A slice of texts sends each bucket its distinct grams and their counts as a row of
packed arrays.  Grams of a first word meet in one bucket, so all sums are made after
one shuffle; words with more grams than a task should hold are spread by their second
word, and pairs of two such words by their third, in as many parts as their counts
ask for.

Edges that occur often are joined to paths where a pair has one way in and one way
out: both edges then weigh as much as the pair occurs.  A path stands for all its
edges and inner nodes; only nodes at its ends keep a row of their own.

Words are numbered by 64-bit hashes of their language and bytes.  The vocabulary
shows if two words share a number; the count is then repeated with another hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from textveil.llm.frames import stored
from textveil.llm.packed import edges, pack_sorted, unpack_sorted, unzipped, zipped
from textveil.llm.words import SEPARATOR, U, cut_words, pair, raw_bytes, scramble, slices, span_hashes

END = 0
SLICE = 2 << 20
BUCKET_WORDS = 700_000  # words whose grams one bucket sums
LEAST_PART = 1 << 15  # grams of a word that one task may hold at any rate
PARTS = 100_000  # at most so many words are spread
PATH_CUT = 1024  # edges of one row of a path
#: These characters end a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_BREAKS = SEPARATOR | _ENDS


class _Slice(NamedTuple):
    words: np.ndarray  # distinct numbers
    sample: np.ndarray  # where each is found first
    word: np.ndarray  # of each occurrence, its place among the distinct ones
    follows: np.ndarray  # if the next occurrence is in the same piece
    lang: np.ndarray  # of each occurrence
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _slices(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], _Slice]]:
    for batch in slices(batches, "text", SLICE):
        w = cut_words(batch.column("text"), separator=_BREAKS)
        if not len(w.start):
            continue
        langs = pc.dictionary_encode(batch.column("lang"))
        of_text = langs.indices.to_numpy(zero_copy_only=False)
        names = langs.dictionary.to_pylist()
        lang = np.repeat(of_text, np.diff(w.first))
        data, offsets = raw_bytes(langs.dictionary)
        salt = scramble(span_hashes(data, offsets[:-1], offsets[1:]) + U(seed))
        h = pair(salt[lang], span_hashes(w.data, w.start, w.end))
        h[h == U(END)] = U(1)
        ends = np.concatenate(([0], np.cumsum(_ENDS[w.data], dtype=np.int64)))
        piece = ends[w.start]
        follows = np.zeros(len(h), bool)
        follows[:-1] = piece[1:] == piece[:-1]
        stops = w.first[1:-1]
        follows[stops[stops > 0] - 1] = False
        words, sample, word = np.unique(h, return_index=True, return_inverse=True)
        yield names, _Slice(words, sample, word.astype(np.int64), follows, lang, w.data, w.start, w.end)


def _vocabulary(seed: int):
    def run(batches):
        for names, s in _slices(batches, seed):
            at = s.sample
            first, last = s.start[at], s.end[at]
            text = [s.data[i:j].tobytes() for i, j in zip(first.tolist(), last.tolist())]
            lang = pa.DictionaryArray.from_arrays(pa.array(s.lang[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
            n = np.bincount(s.word, minlength=len(s.words))
            yield pa.RecordBatch.from_arrays([pa.array(s.words.view(np.int64)), lang, pa.array(text, pa.binary()).cast(pa.string()), pa.array(n)], ["w", "lang", "word", "n"])

    return run


class Often(NamedTuple):
    """Words with more grams than one part may hold, and in how many parts these are."""

    words: np.ndarray
    parts: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.parts[at], 1)


GRAMS = "bucket int, words binary, grams binary, counts binary"
COUNTS = "a bigint, b bigint, c bigint, n bigint"


def _coded(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> np.ndarray | None:
    """One number for each gram of words below ``size``, if 64 bits will do."""
    if size >= 1 << 21:
        return None
    return (a.astype(U) * U(size) + b.astype(U)) * U(size) + c.astype(U)


def _grams(seed: int, often, buckets: int):
    def run(batches):
        for _, s in _slices(batches, seed):
            size = len(s.words) + 1  # the last number is END
            second = np.append(np.where(s.follows[:-1], s.word[1:], size - 1), size - 1)
            third = np.append(np.where(s.follows[:-1], second[1:], size - 1), size - 1)
            pairs, back = np.unique(s.word * size + second, return_inverse=True)
            grams, n = np.unique(back * size + third, return_counts=True)
            number = np.append(s.words, U(END))
            k, c = np.divmod(grams, size)
            a, b = np.divmod(pairs[k], size)
            # how many parts the grams of a word or of a pair have
            split = often.value.of(number)
            spread = scramble(number)
            part = spread[b] % split[a].astype(U) * U(1_000_003) + spread[c] % np.minimum(split[a], split[b]).astype(U)
            bucket = (scramble(spread[a] + part) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = edges(bucket[order])
            rows = []
            for i, j in zip(edge[:-1], edge[1:]):
                o = order[i:j]
                words, at = np.unique(np.concatenate((a[o], b[o], c[o])), return_inverse=True)
                x, y, z = at.reshape(3, -1)
                rows.append((int(bucket[o[0]]), *_packed(number[words], x, y, z, n[o])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [x.split()[0] for x in GRAMS.split(", ")])

    return run


def _packed(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Grams of some words as bytes; END, the number 0, comes last among the words of a slice."""
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    a, b, c = rank[a], rank[b], rank[c]
    code = _coded(a, b, c, len(words))
    if code is None:  # a slice of over two million words
        return pack_sorted(words[order]), zipped(np.concatenate((a, b, c))), zipped(n.astype(np.int32))
    order_of = np.argsort(code)
    return pack_sorted(words[order]), pack_sorted(code[order_of]), zipped(n[order_of].astype(np.int32))


def _unpacked(size: int, grams: bytes) -> tuple[np.ndarray, ...]:
    """The grams of a row with ``size`` words."""
    if size >= 1 << 21:
        return tuple(unzipped(grams, np.int64).reshape(3, -1))
    rest, c = np.divmod(unpack_sorted(grams, U), U(size))
    a, b = np.divmod(rest, U(size))
    return tuple(x.astype(np.int32) for x in (a, b, c))


def _added(often, least: int):
    """Sums of a bucket: frequent edges, nodes (frequent or in several parts), and words."""
    def run(grams: pa.Table) -> pa.Table:
        held = [unpack_sorted(x.as_py(), U) for x in grams.column("words")]
        words = np.unique(np.concatenate(held))
        cols: list[list] = [[], [], [], []]
        for w, row, counts in zip(held, grams.column("grams"), grams.column("counts")):
            here = np.searchsorted(words, w).astype(np.int32)
            for out, x in zip(cols, _unpacked(len(w), row.as_py())):
                out.append(here[x])
            cols[3].append(unzipped(counts.as_py(), np.int32))
        del held, grams
        a, b, c, n = (np.concatenate(x) for x in cols)
        del cols
        code = _coded(a, b, c, len(words))
        order = np.lexsort((c, b, a)) if code is None else np.argsort(code)
        del code
        a, b, c, n = a[order], b[order], c[order], n[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new_b = new_a | np.concatenate(([True], b[1:] != b[:-1]))
        new_c = new_b | np.concatenate(([True], c[1:] != c[:-1]))
        split = often.value.of(words)
        out = []
        for new, k in ((new_c, 3), (new_b, 2), (new_a, 1)):
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at, dtype=np.int64)
            # what is in several parts may still add up
            whole = split[a[at]] == 1 if k == 1 else np.minimum(split[a[at]], split[b[at]]) == 1 if k == 2 else True
            real = True if k == 1 else words[(b if k == 2 else c)[at]] != U(END)
            kept = ((total >= least) | np.logical_not(whole)) & real
            at, total = at[kept], total[kept]
            out.append([words[x[at]].view(np.int64) if i < k else None for i, x in enumerate((a, b, c))] + [total])
        rows = [pa.RecordBatch.from_arrays([pa.nulls(len(x[3]), pa.int64()) if y is None else pa.array(y, pa.int64()) for y in x], ["a", "b", "c", "n"]) for x in out]
        return pa.Table.from_batches(rows)

    return run


class PhraseGraph(NamedTuple):
    vocabulary: DataFrame  # w, lang, word, n: words and how often the texts have them
    paths: DataFrame  # words (of a path, in order), n: weight of each of its edges
    ends: DataFrame  # a, b, n: pairs that are no inner node of a path
    singles: DataFrame  # a, n: words by flow


def _numbered(docs: DataFrame, tries: int = 3) -> tuple[DataFrame, int]:
    """The vocabulary, and the seed under which all its numbers differ."""
    for seed in range(tries):
        found = docs.mapInArrow(_vocabulary(seed), "w bigint, lang string, word string, n bigint")
        words = stored(found.groupBy("w", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
        if words.groupBy("w").count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("words share a number under every seed")


def phrase_graph(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> PhraseGraph:
    """The graph of all texts, kept where it has a weight of ``least`` or more.

    Null texts are empty, null languages ``und``; repeated rows count as often as
    they occur; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    vocabulary, seed = _numbered(rows)
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # words with more grams than a part may hold: at most PARTS of them, so their list stays small
    room = max(LEAST_PART, total // PARTS)
    hot = vocabulary.where(F.col("n") > room).select("w", F.ceil(F.col("n") / room).cast("bigint").alias("parts")).toPandas()
    numbers = hot["w"].to_numpy(np.int64).view(U)
    order = np.argsort(numbers)
    often = spark.sparkContext.broadcast(Often(numbers[order], hot["parts"].to_numpy(np.int64)[order]))
    buckets = max(1, -(-total // BUCKET_WORDS))
    counts = rows.mapInArrow(_grams(seed, often, buckets), GRAMS).groupBy("bucket").applyInArrow(_added(often, least), COUNTS)
    counts = stored(counts, "counts")
    flows = counts.where("b is not null and c is null").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    flows = stored(flows, "flows")
    singles = stored(counts.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "singles")
    edges_of = counts.where("c is not null")
    paths = stored(unary_paths(edges_of, flows), "paths")
    inner = paths.select(F.explode(_runs("words", 2, inner=True)).alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return PhraseGraph(vocabulary, paths, flows.join(inner, ["a", "b"], "left_anti"), singles)


def unary_paths(edges: DataFrame, flows: DataFrame, cut: int = PATH_CUT) -> DataFrame:
    """Paths over nodes with one way in and one way out, every edge in exactly one.

    An edge leads on to another if both weigh as much as the pair between them
    occurs; then no piece begins or ends there either.  Heads of paths are found by
    doubling.  Rows have at most ``cut`` edges; the next begins where one ended.
    """
    named = edges.select("a", "b", "c", "n")
    whole = flows.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"))
    into = named.join(whole, (F.col("b") == F.col("_a")) & (F.col("c") == F.col("_b")) & (F.col("n") == F.col("_n"))).select(
        F.struct("a", "b", "c").alias("_prev"), F.col("b").alias("_a"), F.col("c").alias("_b"), F.col("n").alias("_n")
    )
    here = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") == F.col("_n"))
    key = F.struct("a", "b", "c")
    state = named.join(into, here, "left").select(key.alias("edge"), "n", F.coalesce("_prev", key).alias("head"), F.when(F.col("_prev").isNotNull(), 1).otherwise(0).cast("bigint").alias("far"))
    state = stored(state.withColumn("moved", F.col("far") > 0), "chain")
    while not state.where("moved").isEmpty():
        for _ in range(2):  # as far again as known so far, twice for each table written
            back = state.select(F.col("edge").alias("head"), F.col("head").alias("_head"), F.col("far").alias("_far"))
            state = state.join(back, "head").select("edge", "n", F.col("_head").alias("head"), (F.col("far") + F.col("_far")).alias("far"), (F.col("_far") > 0).alias("moved"))
        state = stored(state, "chain")
    rows = state.groupBy("head", "n", F.floor(F.col("far") / cut).alias("_row")).agg(F.sort_array(F.collect_list(F.struct("far", "edge"))).alias("_e"))
    first = F.col("_e")[0]["edge"]
    return rows.select(F.concat(F.array(first["a"], first["b"]), F.transform("_e", lambda x: x["edge"]["c"])).alias("words"), "n")


def _runs(words: str, k: int, inner: bool = False) -> Column:
    """All runs of ``k`` words of a path; with ``inner`` not the first and the last."""
    skip = 1 if inner else 0
    n = F.size(words) - k + 1 - 2 * skip
    places = F.when(n > 0, F.sequence(F.lit(1 + skip), n + skip)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(words, i, k))


def gram_counts(graph: PhraseGraph) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, n) and triples (a, b, c, n) that the graph stands for."""
    triples = graph.paths.select(F.explode(_runs("words", 3)).alias("p"), "n").select(*[F.col("p")[i].alias(x) for i, x in enumerate("abc")], "n")
    inner = graph.paths.select(F.explode(_runs("words", 2, inner=True)).alias("p"), "n").select(*[F.col("p")[i].alias(x) for i, x in enumerate("ab")], "n")
    return graph.ends.unionByName(inner), triples


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), in decimals wide enough for counts up to 10 to the 15th."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)).cast("bigint")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two or three words occurs ``least`` times or more (a).  Of its cuts in
    two, that of the lowest score counts (the first of equal ones): l and r are how
    often the parts occur.  Phrases inside a longer one with ``inside`` percent or
    more of their count are dropped.  n is the number of words of the language.  By
    score and count descending, then phrase.  Null and empty texts have no words; a
    null language is ``und``; an empty table gives no rows.
    """
    graph = phrase_graph(docs, text, lang, least)
    pairs, triples = (stored(x, "grams") for x in gram_counts(graph))
    one = lambda w, out: graph.singles.select(F.col("a").alias(w), F.col("n").alias(out))
    two = lambda u, v, out: pairs.select(F.col("a").alias(u), F.col("b").alias(v), F.col("n").alias(out))
    cut = lambda k, l, r: F.struct(_score(F.col("n"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    longer = triples.join(two("a", "b", "n_ab"), ["a", "b"]).join(two("b", "c", "n_bc"), ["b", "c"])
    swallowed = longer.where(F.col("n") * 100 >= F.col("n_ab") * inside).select("a", "b").unionByName(
        longer.where(F.col("n") * 100 >= F.col("n_bc") * inside).select(F.col("b").alias("a"), F.col("c").alias("b"))
    )
    three = longer.join(one("a", "n_a"), "a").join(one("c", "n_c"), "c").select("a", "b", "c", "n", F.least(cut(1, "n_a", "n_bc"), cut(2, "n_ab", "n_c")).alias("best"))
    short = pairs.join(swallowed.distinct(), ["a", "b"], "left_anti").join(one("a", "n_a"), "a").join(one("b", "n_b"), "b")
    short = short.select("a", "b", F.lit(None).cast("bigint").alias("c"), "n", cut(1, "n_a", "n_b").alias("best"))
    words = graph.vocabulary.where(F.col("n") >= least)
    named = three.unionByName(short)
    for x in "abc":
        spelled = words.select(F.col("w").alias(x), F.col("word").alias(f"word_{x}"), *(["lang"] if x == "a" else []))
        named = named.join(spelled, x, "left")
    sizes = graph.vocabulary.groupBy("lang").agg(F.sum("n").alias("all"))
    found = named.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
