"""The operators on small tables with nulls, ties, repeats and clashing columns, next to brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textveil.llm import chat, invertible, katz, mixing, packing, queries, toxicity, warc, words
from textveil.llm.components import connected_components
from textveil.llm.frames import importable
from textveil.llm.hamming import nearest_codes
from textveil.llm.jaccard import similar_documents, without_near_copies
from textveil.llm.quality import score_quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + i: chr(97 + i) for i in range(26)}
ODD = [None, "", " \n\t ", "One", "two  words", "ÄÖ ä x", "a b c d e f g h", "A b c D e f g h", "x " * 3000, "😀 <b> \\ ok.", "<|endoftext|> 0 10, a."]


def docs_of(spark, texts, extra=True):
    rows = [(None if i == 3 else i, t, "en", "s" if i % 3 else None, i, "x", 1, 0.5) for i, t in enumerate(texts)]
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, n bigint, score double")
    return df if extra else df.select("doc_id", "text", "lang", "source")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


@pytest.fixture
def odd(spark):
    return docs_of(spark, ODD + ODD[-2:])


@pytest.fixture
def empty(spark):
    return docs_of(spark, ["a"]).limit(0)


def test_words_and_hashes():
    texts = [x or "" for x in ODD] + ["y" * 400_000 + " z"]
    w = words.cut_words(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t.translate(LOWER)) for t in texts]
    h = words.span_hashes(w.data, w.start, w.end)
    flat = [x for t in got for x in t]
    assert len(set(h.tolist())) == len(set(flat)) and len({(x, int(y)) for x, y in zip(flat, h)}) == len(set(flat))


def test_mix(spark, odd, empty):
    rows = [(i, "w " * (1 + i * 7 % 50), s) for i, s in enumerate(["a", "b", None, "c"] * 60)]
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]])
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    mixed = mixing.mixed_documents(df).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(taken.values())
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(empty).count() == 0


def test_pack_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        want = Counter(tuple(coder.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t in rows)
        pieces = packing.pack_documents(df, path, group=20_000).collect()
        held, docs = defaultdict(list), defaultdict(dict)
        for p in pieces:
            ids = np.frombuffer(p["ids"], "<u4")
            assert len(ids) == p["length"]
            held[p["sequence_id"]].append((p["offset"], p["length"]))
            docs[p["doc_id"]].setdefault(p["start"], []).append(ids)
        for spans in held.values():
            spans.sort()
            ends = [a + n for a, n in spans]
            assert [a for a, _ in spans] == [0, *ends[:-1]] and ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0
        if df is not odd:
            got = Counter(tuple(int(x) for s in sorted(d) for x in d[s][0]) for d in docs.values())
            assert got == want
        assert sum(p["length"] for p in pieces) == sum(len(k) * n for k, n in want.items())
    assert packing.pack_documents(empty, path).count() == 0


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_all_pairs(spark, odd, empty):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 60 + g)]
        common = [f"c{x}" for x in range(40 * (g % 2))]
        for _ in range(9):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(0, len(t)))] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(common + t))
    texts += [None, "", "a b", "A B", "one two three four five", texts[0]]
    df = importable(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for k, percent in ((4, 85), (5, 80)):
        want = brute_components(enumerate(texts), k, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(df, k, percent).collect()}
        assert got == want
    kept = sorted(r["doc_id"] for r in without_near_copies(df).collect())
    assert kept == sorted(i for i, (n, c) in want.items() if c == i)
    assert similar_documents(odd).count() == odd.count() and similar_documents(empty).count() == 0


def test_jaccard_of_lists_in_parts(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        texts += [" ".join(base[:j] + [f"n{j}"] + base[j + 1 :]) for j in (0, 1, 38, 39)]
    df = importable(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(df, 4, 75, salt_above=2).collect()}
    assert got == brute_components(enumerate(texts), 4, 75)


def test_rows_without_words_stay(spark):
    rows = [(None, ""), (None, ""), (None, None), (None, None), (3, " \n"), (3, " \n"), (1, "a b"), (1, "a b"), (2, "A B"), (None, "\u00a0"), (None, "\u00a0")]
    df = importable(spark).createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(repr, (tuple(r) for r in without_near_copies(df).collect())))
    assert got == sorted(map(repr, rows[:7] + rows[9:10]))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 300)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 300)}


def test_katz_against_brute_force(spark, odd, empty):
    df = queries.table(spark, SF, "documents").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = katz.new_dir(spark, "katz-test")
    df.write.parquet(path)
    got = {r["doc_id"]: r for r in queries_score(spark.read.parquet(path)).collect()}
    texts = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
    one, two, after = Counter(), Counter(), defaultdict(dict)
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            one.update(t)
            two.update(zip(["<"] + t[:-1], t))
    for (v, w), c in two.items():
        after[v][w] = c
    n = {k: np.array([sum(x == r for x in c.values()) for r in range(8)]) for k, c in (("1", one), ("2", two))}
    lower, d = katz.Lower(n["1"], sum(one.values())), katz.good_turing(n["2"])
    low = {w: float(lower(np.array([c]))[0]) for w, c in one.items()}
    cut = lambda r: r * (d[r] if r <= 5 else 1)

    def p(v, w):
        if v not in after:
            return low.get(w, lower.unknown)
        f = after[v]
        c = sum(f.values())
        if w in f:
            return cut(f[w]) / (c + 0.5)
        rest = sum(r - cut(r) for r in f.values()) + 0.5
        return rest / (c + 0.5) / (1 - sum(low[x] for x in f)) * low.get(w, lower.unknown)

    for v in list(after)[:15]:  # sums to 1 over the vocabulary and the unknown word
        assert math.isclose(sum(p(v, w) for w in one) + p(v, "never seen"), 1, rel_tol=1e-9)
    for i, t in texts.items():
        want = sum(math.log10(p(v, w)) for v, w in zip(["<"] + t[:-1], t))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)
    assert queries_score(odd).count() == odd.count() and queries_score(empty).count() == 0


def queries_score(df):
    from pyspark.sql import functions as F

    return katz.score_texts(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)


def test_archives_round_trip(spark):
    long = "é" * 60
    rows = [(5, "u", long), (3, "u", long), (3, "u", long), (None, None, long), (9, "a\r\nb", "short"), (8, "", "short"), (1, "", None), (2, "x", "\r\n\r\n" * 50)]
    df = importable(spark).createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.write_archives(df, frame=200)
    got = sorted((tuple(r) for r in warc.read_archives(index).collect()), key=str)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        to = 3 if t == long and i != 3 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    for r in index.select("folder", "file").distinct().collect():
        fs, base = warc.file_system(r["folder"])
        with fs.open_input_file(f"{base}/{r['file']}") as f:
            table = warc.read_seek_table(f, f.size())
        assert {x[0] for x in table} == {x["frame_at"] for x in index.where(index.file == r["file"]).collect()}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_nearest_codes(spark):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63, 150)]
    codes += [c ^ (1 << int(rng.integers(0, 62))) for c in codes[:100]] + [codes[0]] * 30
    rows = list(enumerate(codes)) + [(900, None), (None, 5)]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    got = defaultdict(list)
    for r in nearest_codes(df, df.where("id % 20 = 0"), 7).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["id"]))
    known = [(i, c or 0) for i, c in rows if i is not None]
    for i, c in known:
        if i % 20 == 0:
            near = sorted(((c ^ x) & (2**64 - 1)).bit_count() * 10**6 + j for j, x in known)[:7]
            assert sorted(got[i]) == [(k + 1, x // 10**6, x % 10**6) for k, x in enumerate(near)]
    assert nearest_codes(df.limit(0), df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "#### a", "<turn></turn>\\", None, "", "\\\\#\\", "é😀 ### ", "<\\/turn>"]
    for x in hard:
        if x:
            assert chat.unescape(chat.escape(x)) == x and not any(m in chat.escape(x) for m in chat.MARKS)
    rows = [(c, i, r, x) for c in (1, None) for i, x in enumerate(hard) for r in ("user", "assistant")] + [(2, None, None, "a"), (2, 0, "tool</turn>", "b"), (2, 0, "tool</turn>", "b")]
    df = importable(spark).createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df, path), path).collect()}
    for c in (1, 2, None):
        turns = sorted(((i is not None, i or 0, r or "", x or "") for k, i, r, x in rows if k == c))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(df.limit(0), path), path).count() == 0


def test_versions(spark, odd, empty):
    df = queries.table(spark, SF, "documents").limit(80)
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), reverse=True)
    got = {r["doc_id"]: r for r in invertible.fingerprint_versions(df).collect()}
    for k, (i, t) in enumerate(rows):
        m, then = len(t) // 3, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - m] + then[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and got[i]["near_edited"] > got[i]["near_next"] or t == then
    assert invertible.fingerprint_versions(odd).count() == odd.count() and invertible.fingerprint_versions(empty).count() == 0


def test_versions_of_long_texts(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(1500)] + ["long " * 700]
    changed = [x + "!" if i % 40 == 0 else x for i, x in enumerate(lines)]
    texts = ["\n".join(x) for x in (lines, changed, lines[:300], lines[::-1], lines[750:], [])]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    df = importable(spark).createDataFrame([(i, j, texts[i], texts[j]) for i, j in pairs], "i int, j int, a string, b string").repartition(8)
    both = df.select("i", "j", *[invertible.fingerprint_parts(F.col(x)).alias(x) for x in "ab"])
    rows = both.select("i", "j", F.col("a.digests").alias("x"), F.col("b.digests").alias("y"), F.explode(F.array(invertible.compare(F.col("a"), F.col("b")))).alias("c")).collect()
    got = {}
    for r in rows:
        x, y = set(r["x"]), set(r["y"])
        assert r["c"]["lost"] == sorted(x - y) and r["c"]["gained"] == sorted(y - x)
        got[r["i"], r["j"]] = r["c"]["near"]
    assert got[0, 1] > 0.96 and 0.3 < got[0, 2] < 0.36 and got[0, 0] == got[5, 5] == 1 and got[0, 5] == 0


def test_kneser_ney_is_finite_and_tells_stems():
    text = [b"trash", b"trashy", b"the", b"then", b"on"]
    tables = toxicity.fit_models(text, np.array([5, 2, 3, 0, 1]), np.array([0, 0, 9, 4, 3]))
    total = np.zeros(2)
    for last in range(256):  # next bytes after "th" within a word
        data = np.frombuffer(b"th" + bytes([last]), np.uint8)
        word, before, keys = toxicity._grams(data, np.array([0]), np.array([3]))
        a = np.array(toxicity.word_log_likelihoods(tables, data, np.array([0]), np.array([3])))[:, 0]
        rest = np.array(toxicity.word_log_likelihoods(tables, data, np.array([0]), np.array([2])))[:, 0]
        total += np.isfinite(a) & np.isfinite(rest)
    assert (total == 256).all()
    worse, better = (np.array(toxicity.word_log_likelihoods(tables, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])))[:, 0] for w in (b"trashing", b"thens"))
    assert worse[0] > worse[1] and better[0] < better[1]


def test_stretches_of_short_texts():
    tables = toxicity.fit_models([b"trash", b"the", b"on"], np.array([5, 1, 0]), np.array([0, 4, 3]))
    texts = ["trash", "trash trash", "the trash on", "on on on trash", "on trash trash trash trash on", "", "the " * 9 + "trash"]
    got = toxicity.text_measures(pa.array(texts), toxicity.Seen(tables))
    a, b = (dict(zip(("trash", "the", "on"), x)) for x in toxicity.word_log_likelihoods(tables, np.frombuffer(b"trashtheon", np.uint8), np.array([0, 5, 8]), np.array([5, 8, 10])))
    for text, top in zip(texts, got[:, 0]):
        gaps = [a[x] - b[x] for x in text.split()]
        n = min(toxicity.STRETCH, len(gaps))
        assert top == pytest.approx(max([sum(gaps[i : i + n]) / n for i in range(len(gaps) - n + 1)]) if gaps else 0)


def test_curve_has_the_odds_of_all_training_rows(spark):
    rng = np.random.default_rng(9)
    toxic = {i for i in range(440) if i % 11 == 0}
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 90, 8)] + ["trash"] * (i in toxic and i % 3 > 0)) for i in range(440)]
    df = importable(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = [(i, 1, int(i in toxic)) for i in range(440)]
    ids = df.where(~F.col("doc_id").isin(*toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
    taken = toxic | {r["doc_id"] for r in ids.collect()}
    _, (a, b, c) = toxicity.fit_toxicity(df, labels_of(spark, rows), F.lit(True), fit_rows=40)
    _, even = toxicity.fit_toxicity(df, labels_of(spark, [r for r in rows if r[0] in taken]), F.lit(True), fit_rows=40)
    assert [a, b] == pytest.approx(even[:2]) and c == pytest.approx(even[2] - math.log(10)) and a != 0


def test_classifiers_on_odd_tables(spark, odd, empty):
    for labels in (labels_of(spark), labels_of(spark, [(i, i % 2, int(i > 6)) for i in range(11)] + [(None, 1, 1), (4, None, None)])):
        for df in (odd, empty):
            scored = toxicity.score_toxicity(df, labels)
            assert scored.where("score between 0 and 1").count() == df.count()
            rated = score_quality(df, labels)
            assert rated.where("quality_score between 0 and 1").count() == df.count()
            assert set(df.columns) <= set(rated.columns)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf, "labels").toPandas().set_index("doc_id")
    toxic = queries.QUERIES["op2_class_kneser_ney"](spark, sf).toPandas().join(labels, "doc_id", how="inner")
    toxic = toxic[toxic.held_out]
    ranks = toxic.score.rank()
    bad = toxic.toxic == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.85
    good = queries.QUERIES["op10_site_quality"](spark, sf).toPandas().join(labels, "doc_id", how="inner")
    assert ((good.quality == 1) == good.keep).mean() > 0.95
