"""Cases that once went wrong."""

import re
from collections import Counter
import numpy as np

from textveil.llm import katz, mixing, warc
from textveil.llm.frames import importable
from textveil.llm.hamming import choose_segments
from textveil.llm.memory import held, released


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_repeated_rows_are_mixed_together(spark):
    rows = [(i, "w " * (5 + 3 * i), "a", 1, "x") for i in range(5)] * 40 + [(None, "v v v", "b", 2, "y")] * 30 + [(9, None, "a", 0, "z"), (9, "", "a", 0, "z")]
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, size string")
    taken = mixing.mix_sources(df).collect()
    mixed = mixing.mixed_documents(df).collect()
    want, got = Counter(), Counter()
    for r in taken:
        want[r.source] += r.taken
    for r in mixed:
        got[r.source] += words(r.text)
        assert r.n_chars in (len(r.text), 1, 2)
    assert got == want and mixing.mixed_documents(df.limit(0)).count() == 0


def test_archives_by_index_and_by_seek_table(spark):
    rows = [(i if i != 3 else None, f"http://x/{i % 7}", ("<p>" + "ä" * (i % 5) * 60 + "</p>") if i % 6 else None, i, "f") for i in range(90)]
    df = importable(spark).createDataFrame(rows, "page_id bigint, url string, html string, record_at bigint, folder string").repartition(3)
    index = warc.write_archives(df, frame=700, date="2024-05-01T00:00:00Z")
    by_index = sorted(map(str, warc.read_archives(index, task_bytes=500).collect()))
    assert by_index == sorted(map(str, warc.read_whole_archives(index).collect())) and len(by_index) == 90
    assert warc.read_archives(index, task_bytes=500).rdd.getNumPartitions() > 1
    raw = warc.record(1, "http://x", b"abc", "d", None, "2024-05-01T00:00:00Z")
    fields, body = warc.parse(raw)
    assert fields["WARC-Date"] == "2024-05-01T00:00:00Z" and body == b"abc"
    assert [b for _, b in warc.records_of(raw + warc.record(2, "", b"\r\n\r\n", "e", None, "x"))] == [b"abc", b"\r\n\r\n"]


def test_number_of_segments_follows_cost():
    assert choose_segments(25_000, [18] * 10) in (4, 5, 6)
    assert choose_segments(25_000, []) == 16
    assert choose_segments(10, [40]) > choose_segments(10**7, [12])


def test_a_worker_keeps_one_thing():
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert held("a", make(1)) == held("a", make(2)) == 1
    assert held("b", make(3)) == 3 and held("a", make(4)) == 4
    released()
    assert held("a", make(5)) == 5 and made == [1, 3, 4, 5]
    released()


def test_short_and_long_lists_give_the_same_links(spark):
    import numpy as np

    from tests.llm.test_operators import brute_components
    from textveil.llm.jaccard import similar_documents

    rng = np.random.default_rng(11)
    shared = [[f"s{p}_{j}" for j in range(25)] for p in range(3)]
    texts = []
    for i in range(150):
        own = [f"w{i // 3}_{j}" for j in range(20 + i // 3 % 30)]
        cut = len(own) // 2 + int(rng.integers(0, 3))
        passage = shared[i // 3 % 3] if i % 4 else []
        words_ = own[:cut] + passage + own[cut:]
        for _ in range(int(rng.integers(0, 3))):
            words_[int(rng.integers(0, len(words_)))] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(words_))
    df = importable(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components(enumerate(texts), 3, 60)
    assert len({c for _, c in want.values()}) < 150
    for most in (0, 2, 8, 64):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(df, 3, 60, short_list=most).collect()}
        assert got == want


def test_packed_numbers_of_word_pairs_are_small():
    """What op3 sends: small numbers without their empty bytes, repeated words once."""
    rng = np.random.default_rng(3)
    words = np.repeat(np.sort(rng.integers(0, 2**63, 2000).astype(np.uint64)), rng.integers(1, 9, 2000))
    counts = rng.integers(0, 70000, len(words)).astype(np.uint64)
    for x in (counts, counts[:0], words, rng.random((50, 6))):
        assert (katz._unzip(katz._zip(x), x.dtype).reshape(x.shape) == x).all()
    for x in (words, words[:0], words[:1]):
        assert (katz._unzip_runs(katz._zip_runs(x)) == x).all()
    assert len(katz._zip(counts)) < 2.6 * len(counts) and len(katz._zip_runs(words)) < 19000


def test_frequent_tokens_are_counted_in_little_memory():
    """op9 sorts a block's tokens where they are."""
    import tracemalloc

    import pyarrow as pa

    from textveil.llm import jaccard

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 20000, 4000))) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array(texts)], ["doc_id", "row", "text"])
    want = Counter(int(x) for s in jaccard.shingle_sets(batch.column("text"), 1) for x in s.view(np.int64))
    out = list(jaccard._describe(1)(iter([batch])))
    got = dict(zip(out[-1].column("token").to_pylist(), out[-1].column("times").to_pylist()))
    assert got == {t: n for t, n in want.items() if n >= jaccard.OFTEN}
    wide, peaks = jaccard._describe(4)(iter([batch])), []
    tracemalloc.start()
    for part in wide:
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert peaks[-1] < 4.5 * 8 * 400_000  # tokens, their sorted copy or places, and what is made of these


def test_word_pairs_are_sent_and_kept_as_small_numbers(monkeypatch):
    """op3: a pair took the eight bytes of a hash in the question and sixteen in the count table."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 400), 20000)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), pa.array([True] * 200)], ["doc_id", "text", "train"])
    (_, block), buckets = next(katz._blocks([batch])), 3
    want = Counter(p for t in texts for p in zip(t.split(), t.split()[1:]))

    def asked(ask, answer):
        rows = sorted(ask([batch]), key=lambda x: x.column("bucket")[0].as_py())
        return rows, [x.to_pylist()[0] for x in answer(iter(rows))]

    _, found = asked(katz._ask_words(buckets), katz._answer_words(buckets))
    words = SimpleNamespace(of=lambda name, check: {r["bucket"]: r for r in found if r["kind"] == "answer"})
    counts, numbers = katz._word_counts(block, words.of("", 0), buckets)
    assert len(set(numbers.tolist())) == len(numbers) and numbers.min() >= 2 and numbers.max() < buckets * len(numbers)
    assert numbers[np.argmax(counts)] < 2 + buckets
    sent, found = asked(katz._ask_pairs(words, buckets, 1e9), katz._answer_pairs(katz.Lower(np.ones(9), 100)))
    kept = [r for r in found if r["kind"] == "counts"]
    size = lambda rows, names: sum(len(r[c]) for r in rows for c in names)
    assert size([x.to_pylist()[0] for x in sent], "ab") < 5 * len(want) and size(kept, "ab") < 5 * len(want)
    total = Counter(n for r in kept for n in katz._unzip(r["c"], np.int64).tolist())
    inner = Counter(want.values())
    first, last = Counter(t.split()[0] for t in texts), Counter(t.split()[-1] for t in texts)
    assert total == inner + Counter(first.values()) + Counter(last.values())


def test_codes_of_pairs_of_large_numbers():
    left, right = (np.array(x, np.uint64) for x in ([2**40, 5, 2**40, 5], [2**33, 7, 3, 7]))
    for a in (left, left >> np.uint64(20)):
        codes = katz._codes(a, right)
        assert codes[1] == codes[3] < codes[2] < codes[0]
    assert not len(katz._codes(left[:0], right[:0]))


def test_workers_get_some_megabytes_of_text_at_a_time(spark):
    """The pipeline's workers and executors held batches of ten thousand rows, however long their texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from pyspark.sql import functions as F
    from textveil.llm.frames import BATCH_BYTES, bounded_batches
    from textveil.llm.quality import score_quality

    def size(texts: pa.Array) -> pa.Array:
        return pa.array([pc.sum(pc.binary_length(texts)).as_py()] * len(texts), pa.int64())

    docs = importable(spark).range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("wort "), 2000).alias("text"), F.lit("s").alias("source"), F.lit("de").alias("lang"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    before = spark.conf.getAll.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        score_quality(docs, labels)
        sizes = [r[0] for r in docs.select(F.arrow_udf(size, "bigint")("text")).distinct().collect()]
        assert max(sizes) < 4 << 20
        spark.conf.set(BATCH_BYTES, "3m")  # the session's own choice stays
        assert bounded_batches(spark).conf.get(BATCH_BYTES) == "3m"
    finally:
        spark.conf.unset(BATCH_BYTES)
        if before:
            spark.conf.set(BATCH_BYTES, before)


def test_nothing_is_collected_where_nothing_is_held(monkeypatch):
    """The quality classifier's workers collected garbage for each batch."""
    import pyarrow as pa

    from textveil.llm import memory
    from textveil.llm.quality import measures

    times = []
    monkeypatch.setattr(memory.gc, "collect", lambda: times.append(1))
    held("x", lambda: 1)
    times.clear()
    for _ in range(3):
        measures(pa.array(["ein text"]))
    assert len(times) == 1 and not memory._held


def test_a_filter_on_quality_measures_each_text_once(spark):
    """A search for null scores was pushed below the join: two workers a task, each text measured twice."""
    from textveil.llm.quality import score_quality

    rows = [(i, f"wort {i} " * (i % 7) if i % 5 else None, "ab"[i % 2], "de") for i in range(60)] + [(None, "x y", None, None)]
    docs = importable(spark).createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 3)], "doc_id bigint, quality int")
    scored = score_quality(docs, labels)
    kept = scored.where("keep")
    assert kept._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    everything = scored.collect()
    assert len(everything) == 61 and not any(r.doc_log_odds is None for r in everything)
    key = lambda r: (str(r.doc_id), r.quality_score)
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in everything if r.keep)


def test_toxicity_starts_no_workers_of_another_kind(spark, monkeypatch):
    """A list of rows went through Python workers of an RDD, with a daemon of their own beside the others."""
    from pyspark import SparkContext
    from textveil.llm.toxicity import score_toxicity

    docs = importable(spark).createDataFrame([(i, "du idiot" if i % 3 == 0 else f"guten tag {i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    lists = []
    old = SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **b: lists.append(1) or old(self, *a, **b))
    got = {r.doc_id: r.score for r in score_toxicity(docs, labels).collect()}
    assert got[0] > got[1] and len(got) == 60
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert not lists


def test_packing_looks_up_one_megabyte_at_a_time(monkeypatch):
    """Slices of 2 MB, and threads of the tokenizer, made the largest workers of the pipeline."""
    import os
    from types import SimpleNamespace

    import pyarrow as pa
    from textveil.llm import packing

    sizes = []

    def ids(texts, path):
        sizes.append(sum(len(x or "") for x in texts.to_pylist()))
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)

    monkeypatch.setattr(packing, "token_ids", ids)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    field = SimpleNamespace(dataType=packing.T.LongType())
    docs = SimpleNamespace(schema={"doc_id": field}, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["wort " * 20_000] * 40})
    pieces = [x for b in packing.pack_documents(docs, "-")(iter([batch])) for x in b.column("doc_id").to_pylist()]
    assert sorted(pieces) == list(range(40)) and sum(sizes) == 4_000_000 and max(sizes) <= 1 << 20
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    import textveil.llm.queries as queries

    packing.WordIds(queries.tokenizer_path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
