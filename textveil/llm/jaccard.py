"""Join documents whose word n-grams overlap: adaptive prefixes with several matches.

Tokens (hashes of word n-grams) have one order for all documents, the rarer first.
Two sets of the wanted similarity share at least k of the first
``n - ceil(s * n) + k`` tokens of each, for every k.  A document whose short prefix
holds tokens that many others have takes a longer one and asks for more matches,
as an estimate of its candidates says; a pair must share the smaller of its two
numbers.  Any order gives the same links, so frequencies need be right for frequent
tokens only.

Documents with equal sets are one class.  Copies in the thousands do not become
pairs: a first round checks each class of a token's list against the list's
smallest class only, and joins what is similar to components.  The second round
checks all pairs of a list that are still in different components, so no link
between components is lost.  Every pair is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textveil.llm.components import connected_components
from textveil.llm.frames import stored, with_group_values, word_count
from textveil.llm.memory import released
from textveil.llm.words import ODD, U, cut_words, pair, scramble, slices, sorted_counts, span_hashes

#: Frequent tokens whose frequency every task knows: 16 bytes each.
FREQUENT = 500_000
OFTEN = 3
SALTS = 32
SHORT = 64  # rows of a list whose pairs are counted


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text.

    A text of fewer words has one, of its whole sequence; one without words none.
    """
    w = cut_words(texts)
    h = span_hashes(w.data, w.start, w.end)
    out = []
    gram = np.zeros(max(0, len(h) - words + 1), U)
    for k in range(words):
        gram = gram * ODD + h[k : k + len(gram)]
    gram = scramble(gram)
    for a, b in zip(w.first[:-1], w.first[1:]):
        n = b - a
        if n >= words:
            s = np.sort(gram[a : b - words + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            x = U(n)
            for y in h[a:b]:
                x = pair(np.array([x]), np.array([y]))[0]
            s = scramble(np.array([x], U) + U(1))
        else:
            s = np.zeros(0, U)
        out.append(s)
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = scramble(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))
        b = np.bitwise_xor.reduce(scramble(s + U(0x14057B7EF767814F)))
    return int(scramble(np.array([a], U)).view(np.int64)[0]), int(np.array([b], U).view(np.int64)[0])


def _describe(words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (size and signature), and of tokens that are frequent in a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            # sorted in its place, and only frequent tokens are copied
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
            counts = np.diff(at)
            often = counts >= OFTEN
            tokens, counts = keys[at[:-1][often]], counts[often]
            n = len(tokens)
            del keys, at, often
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.array(tokens.view(np.int64)), pa.array(counts)], ["doc_id", "row", "n", "s1", "s2", "token", "times"]
            )

        released()
        ids = pa.int64()
        for part in slices(batches, "text", 2 << 20):
            ids = part.column("doc_id").type
            sets = shingle_sets(part.column("text"), words)
            signs = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            n = len(sets)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), none, none],
                ["doc_id", "row", "n", "s1", "s2", "token", "times"],
            )
            # copies within a block count once
            _, one = np.unique(signs[:, 0], return_index=True)
            held += [sets[i] for i in one]
            size += sum(len(sets[i]) for i in one)
            if size > 4_000_000:
                yield frequent()
                size = 0
        if held:
            yield frequent()
        released()

    return run


def order_keys(tokens: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Numbers that order tokens by frequency (to an eighth of a power of two), then hash.

    55 bits of the hash remain; should two tokens meet, there is only a candidate
    more, since pairs are checked on whole hashes.
    """
    tier = np.minimum(np.log2(times) * 8, 127).astype(U)
    return ((tier << U(55)) | (tokens >> U(9))).view(np.int64)


def choose_prefix(times: np.ndarray, n: int, percent: int, most: int = 8) -> tuple[int, int]:
    """Length of the prefix and matches to ask for, by the estimated work.

    ``times``: in prefix order, how many documents have each token.  Candidates with k
    matches are at most the sum of the lists divided by k; each token of a longer
    prefix costs a little itself.
    """
    least = n - (percent * n + 99) // 100
    ks = np.arange(1, max(1, min(most, n - least)) + 1)
    sums = np.cumsum(times - 1.0)
    cost = sums[least + ks - 1] / ks + 0.25 * ks
    k = int(ks[cost.argmin()])
    return least + k, k


def _prefixes(words: int, percent: int, frequent, salt_above: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        tokens, times = frequent.value
        for part in slices(batches, "text", 2 << 20):
            sets = [s for s in shingle_sets(part.column("text"), words) if len(s)]
            if not sets:
                continue
            signs = np.array([_signature(s) for s in sets], np.int64)
            _, one = np.unique(signs[:, 0], return_index=True)
            found, meta = [], []
            for i in one:
                s = sets[i]
                f = np.ones(len(s), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    f = np.where(tokens[at] == s, times[at], 1)
                keys = order_keys(s, f)
                order = np.argsort(keys)
                length, k = choose_prefix(f[order], len(s), percent)
                prefix = keys[order[:length]]
                # a row of its own says where the prefix ends
                found += [prefix, np.array([-1 - (abs(int(signs[i, 0])) >> 1)], np.int64)]
                # parts of a salted list count from 1; 0 is a whole list
                salts = np.where(f[order[:length]] > salt_above, 1 + signs[i, 0] % SALTS, 0)
                meta.append((length + 1, signs[i, 0], len(s), k, np.append(salts, prefix[-1])))
            lengths = [m[0] for m in meta]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), pa.array(np.repeat(np.array([m[1] for m in meta], np.int64), lengths)),
                 pa.array(np.repeat(np.array([m[2] for m in meta], np.int64), lengths)), pa.array(np.repeat(np.array([m[3] for m in meta], np.int64), lengths)),
                 pa.array(np.concatenate([m[4] for m in meta]).astype(np.int64))],
                ["token", "s1", "n", "k", "salt"],
            )
        released()

    return run


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal tokens and salts is torn."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in columns}
        n = len(now["token"])
        if not n:
            continue
        torn = int(np.flatnonzero((now["token"] == now["token"][-1]) & (now["salt"] == now["salt"][-1]))[0])
        if torn:
            yield {c: v[:torn] for c, v in now.items()}
        rest = {c: v[torn:] for c, v in now.items()}
    if rest is not None and len(rest["token"]):
        yield rest


def _shared_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted lists, the rows of those with two classes or more, one per class."""
    names = ["token", "s1", "n", "k", "salt"]
    held: list[pa.RecordBatch] = []
    for run in _runs(batches, names):
        token, s1, salt = run["token"], run["s1"], run["salt"]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        keep = new.copy()
        keep[1:] |= s1[1:] != s1[:-1]
        group = np.cumsum(new) - 1
        classes = np.bincount(group[keep])
        # a salted list goes on to meet the other parts of its token; below 0 are ends of prefixes
        keep &= (classes[group] > 1) | (salt > 0) | (token < 0)
        out = {c: run[c][keep] for c in names}
        if keep.any():
            held.append(pa.RecordBatch.from_pydict(out))
        if sum(b.num_rows for b in held) > 50_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _all_pairs(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a list that are in different components and near enough in size.

    A pair must share the smaller of its two numbers of matches, and what it shares
    together with all that comes after the prefix must be enough.  It comes from the
    list of the smallest token it shares.  Lists arrive sorted by size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["token", "salt", "s1", "n", "k", "component", "tokens", "last"]):
            token = rows["token"]
            edge = np.append(np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))), len(token))
            for a, b in zip(edge[:-1], edge[1:]):
                n, s1, k, c, last = (rows[x][a:b] for x in ("n", "s1", "k", "component", "last"))
                after = (percent * n + 99) // 100 - k  # tokens after the prefix
                own = rows["tokens"][a:b]
                sizes = np.array([len(x) for x in own])
                flat, ends = np.concatenate(own), np.cumsum(sizes)
                stop = np.searchsorted(n * percent, n * 100, "right")
                for i in range(b - a):
                    j = np.arange(i + 1, stop[i])
                    j = j[c[j] != c[i]]
                    if not len(j):
                        continue
                    if len(j) * 2 > stop[i] - i:  # most of what follows
                        part, cut = flat[ends[i] : ends[stop[i] - 1]], np.concatenate(([0], ends[i + 1 : stop[i]] - ends[i]))
                        at = j - i - 1
                    else:
                        part, cut, at = np.concatenate([own[x] for x in j]), np.concatenate(([0], np.cumsum(sizes[j]))), np.arange(len(j))
                    hit = own[i][np.minimum(np.searchsorted(own[i], part), len(own[i]) - 1)] == part
                    common = np.concatenate(([0], np.cumsum(hit)))
                    earlier = np.concatenate(([0], np.cumsum(hit & (part < token[a]))))
                    count, before = np.diff(common[cut])[at], np.diff(earlier[cut])[at]
                    # nothing before the earlier end is shared but what was counted
                    most = count + np.where(last[j] <= last[i], after[j], after[i])
                    near = 100 * most >= percent * (n[i] + n[j] - most)
                    j = j[(before == 0) & near & (count >= np.minimum(k[i], k[j]))]
                    if len(j):
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(s1[i], s1[j]), "b": np.maximum(s1[i], s1[j])})

    return run


def _short_pairs(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of each short list that are in different components and near enough in size.

    Lists arrive sorted by size; all rows meet the d-th row behind them at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["token", "salt", "s1", "n", "component"]):
            token, s1, n, c = (rows[x] for x in ("token", "s1", "n", "component"))
            at, d = np.arange(len(token)), 1
            while len(at):
                at = at[at + d < len(token)]
                at = at[token[at + d] == token[at]]
                i = at[(c[at] != c[at + d]) & (n[at + d] * percent <= n[at] * 100)]
                if len(i):
                    x, y = s1[i], s1[i + d]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})
                d += 1

    return run


def _across(open_: DataFrame, own: DataFrame, percent: int, partitions: int, short_list: int) -> DataFrame:
    """Pairs of classes in different components that may be similar, by the lists they share.

    Nearly all lists are short: their pairs are counted, at most ``short_list`` for
    each row.  What two classes may share in long lists besides is the smaller of
    their numbers of such.  Pairs that meet in long lists only come from these, where
    a row takes its class's other tokens of long lists along, so that each pair comes
    up once and with enough matches.
    """
    dealt = lambda rows: rows.repartition(partitions, "token").sortWithinPartitions("token", "n")
    short = dealt(open_.where(F.col("_n") <= short_list).select("token", "salt", "s1", "n", "component"))
    met = short.mapInArrow(_short_pairs(percent), "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("_shared"))
    long = open_.where(F.col("_n") > short_list)
    besides = long.groupBy("s1").agg(F.count("*").alias("_long"), F.sort_array(F.collect_list("token")).alias("tokens"))
    about = own.select("s1", "n", "k", "last").join(besides.select("s1", "_long"), "s1", "left")
    for x in "ab":
        side = about.select(F.col("s1").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "k", "last")], F.coalesce("_long", F.lit(0)).alias(f"_long_{x}"))
        met = met.join(side, x)
    after = [F.ceil(F.col(f"n_{x}") * percent / 100) - F.col(f"k_{x}") for x in "ab"]
    shared = F.col("_shared") + F.least("_long_a", "_long_b")
    most = F.least(shared + F.when(F.col("last_a") <= F.col("last_b"), after[0]).otherwise(after[1]), F.col("n_a"), F.col("n_b"))
    near = (shared >= F.least("k_a", "k_b")) & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
    rest = dealt(long.drop("_n").join(besides.select("s1", "tokens"), "s1").join(own.select("s1", "last"), "s1"))
    return met.where(near).select("a", "b").unionByName(rest.mapInArrow(_all_pairs(percent), "a bigint, b bigint")).distinct()


def packed(s: np.ndarray) -> bytes:
    """The upper five bytes of each hash.

    Two different tokens of a pair of sets of a thousand tokens meet with a chance of
    one in a million, and then count as one more in common.
    """
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def unpacked(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 3:] = raw
    return out.reshape(-1).view(U)


def _similar(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p, q = unpacked(x), unpacked(y)
                common = len(p) + len(q) - len(sorted_counts(np.concatenate([p, q]))[0])
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _near_enough(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that can be similar, by what their prefixes share.

    What a pair has in common is at most the tokens that both prefixes hold and all
    that comes after the prefix that ends first.
    """
    sides = [own.select(*[F.col(c).alias("s1_n_k_tokens_last".split("_")[i] + f"_{x}") for i, c in enumerate(own.columns)]) for x in "ab"]
    both = pairs.join(sides[0].withColumnRenamed("s1_a", "a"), "a").join(sides[1].withColumnRenamed("s1_b", "b"), "b")
    after = [F.ceil(F.col(f"n_{x}") * percent / 100) - F.col(f"k_{x}") for x in "ab"]
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    most = common + F.when(F.col("last_a") <= F.col("last_b"), after[0]).otherwise(after[1])
    most = F.least(most, F.col("n_a"), F.col("n_b"))
    return both.where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


#: A filter of fixed size (8 MB) that tells which rows are not wanted: words of 64 bits.
FILTER_WORDS = 1 << 20


def _filter_bits(rows: DataFrame):
    """A broadcast filter of the hashes in the column ``row``: one bit for each."""
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    word = F.shiftrightunsigned("row", 44)
    found = rows.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(FILTER_WORDS, U)
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _sets_of(words: int, wanted) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a task, as far as a million
        for part in slices(batches, "text", 2 << 20):
            row = part.column("row").to_numpy().view(U)
            here = (wanted.value[(row >> U(44)).astype(np.int64)] >> (row & U(63))) & U(1)
            pick = [i for i in np.flatnonzero(here) if int(row[i]) not in seen]
            pick = list({int(row[i]): i for i in pick}.values())
            if not pick:
                continue
            if len(seen) < 1_000_000:
                seen.update(int(row[i]) for i in pick)
            sets = shingle_sets(part.column("text").take(pa.array(pick)), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signature(s)[0] for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.binary())], ["s1", "set"]
            )

    return run


def _verified(pairs: DataFrame, described: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of classes whose whole sets are similar.

    Sets are made of one text of each class in a pair, found by a filter of fixed
    size; what it lets through besides meets no pair, or the same pair again.
    """
    pairs = stored(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("s1")).union(pairs.select("b")).distinct()
    one = described.where("n > 0").groupBy("s1").agg(F.min("row").alias("row")).join(needed, "s1", "left_semi")
    sets = stored(docs.mapInArrow(_sets_of(words, _filter_bits(one)), "s1 bigint, set binary"), "sets")
    a = sets.select(F.col("s1").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("s1").alias("b"), F.col("set").alias("sb"))
    n = pairs.count()
    sized = pairs.groupBy("a").agg(F.count("*").alias("_n")).join(a, "a")
    with_a = with_group_values(pairs.join(b, "b"), sized, ["a"], "_n", n, share=200)
    return stored(with_a.select("a", "b", "sa", "sb").mapInArrow(_similar(percent), "a bigint, b bigint"), "similar")


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, salt_above: int = 64 * SALTS, short_list: int = SHORT) -> DataFrame:
    """Each document with its class and component of similar documents.

    Two documents link when 100 * common >= percent * all, over their sets of
    distinct word n-grams.  Columns: doc_id, n_shingles, class_id (of its set),
    component_id (smallest doc_id that links reach, itself included), row (a hash
    of id and text).  Lists of tokens of a frequency above ``salt_above`` are
    collected in parts, and lists of up to ``short_list`` rows have their pairs
    counted; neither changes the result.

    Null and empty texts and texts without words have no n-gram and link with
    nothing; their component is their own id.  Ties: the smallest id names a
    component.  Repeated rows are in one class.  A component of null ids alone has
    a null id.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = "row bigint, n bigint, s1 bigint, s2 bigint, token bigint, times bigint"
    found = stored(docs.mapInArrow(_describe(words), f"doc_id {id_type}, {fields}"), "described")
    described = found.where("token is null").select("doc_id", "row", "n", "s1", "s2")
    hot = found.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
    top = hot.orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(U)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], top["times"].to_numpy(np.int64)[order]))
    postings = docs.mapInArrow(_prefixes(words, percent, frequent, salt_above), "token bigint, s1 bigint, n bigint, k bigint, salt bigint")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = postings.repartition(partitions, "token", "salt").sortWithinPartitions("token", "salt", "s1")
    lists = stored(lists.mapInArrow(_shared_lists, "token bigint, s1 bigint, n bigint, k bigint, salt bigint"), "lists")
    ends = lists.where("token < 0").select("s1", F.col("salt").alias("last"))
    lists = lists.where("token >= 0")

    # each class with its list's hub: the class that has most of its prefix in lists,
    # as an unedited original among its edited copies
    length = F.first("n") - F.ceil(F.first("n") * percent / 100) + F.first("k")
    weight = lists.groupBy("s1").agg((F.count("*") / length).alias("w"))
    hubs = lists.join(weight, "s1").groupBy("token").agg(F.max(F.struct("w", "s1")).alias("_h"), F.count("*").alias("_n"))
    hubs = stored(hubs.select("token", F.col("_h.s1").alias("hub"), "_n"), "hubs")
    near = with_group_values(lists.select("token", "s1"), hubs, ["token"], "_n", lists.count()).where("s1 <> hub")
    # one hub for each class, that of most of its lists; the second round has the rest
    near = near.groupBy("s1", "hub").agg(F.count("*").alias("_c")).groupBy("s1").agg(F.max(F.struct("_c", "hub")).alias("_h"))
    near = near.select("s1", F.col("_h.hub").alias("hub"))
    met = stored(near.select(F.least("s1", "hub").alias("a"), F.greatest("s1", "hub").alias("b")).distinct(), "met")
    own = lists.groupBy("s1").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sort_array(F.collect_list("token")).alias("tokens"))
    own = stored(own.join(ends, "s1"), "own")
    pairs = _near_enough(met, own, percent)
    links = _verified(pairs, described, docs, words, percent)
    reached = stored(connected_components(links), "reached")

    # what a list still holds in different components
    placed = lists.join(reached.withColumnRenamed("node", "s1"), "s1", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "s1")), "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_n"))
    mixed = stored(mixed.where("_a <> _b").select("token", "_n", F.lit(True).alias("_mixed")), "mixed")
    open_ = with_group_values(placed, mixed, ["token"], "_n", placed.count()).where("_mixed").drop("_mixed")
    open_ = stored(open_.withColumn("salt", F.lit(0).cast("bigint")), "open")
    more = _across(open_, own, percent, partitions, short_list).join(met, ["a", "b"], "left_anti")
    more = _verified(more, described, docs, words, percent)
    if not more.isEmpty():
        reached = stored(connected_components(links.unionByName(more)), "reached")

    classes = described.where("n > 0").groupBy("s1").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least"))
    classes = classes.join(reached.withColumnRenamed("node", "s1"), "s1", "left")
    classes = stored(classes.withColumn("component", F.coalesce("component", "s1")), "classes")
    heads = classes.groupBy("component").agg(F.count("*").alias("_c"), F.min("_least").alias("component_id"))
    named = with_group_values(classes.select("s1", "_n", "component"), heads, ["component"], "_c", classes.count())
    out = with_group_values(described, named.select("s1", "_n", "component_id"), ["s1"], "_n", described.count())
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("s1").alias("class_id"), own.alias("component_id"), "row")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of the smallest id; all columns of ``docs``.

    Documents without words link with nothing and stay, each row of them.  Of repeated rows of the
    kept document one stays; null ids stay unless their text is similar to that of
    a row with an id, and of a component of null ids one row stays.
    """
    found = similar_documents(docs, words, percent)
    texts = found.where("n_shingles > 0").groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_best"), F.first("component_id").alias("_c")
    )
    heads = texts.groupBy("_c").agg(F.min("_best").alias("_best")).select(F.col("_best.row").alias("_row"))
    rows = docs.withColumn("_id", F.xxhash64("doc_id", "text"))
    same = rows.where(word_count("text") > 0).join(heads, F.col("_id") == F.col("_row")).dropDuplicates(["_id"])
    return same.select(*docs.columns).unionByName(docs.where(word_count("text") == 0))
