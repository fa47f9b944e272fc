"""Repeated passages next to brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textveil.llm import anchors, packed
from textveil.llm.frames import importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(w) + 1) if (gone[i] if i < len(w) else False) != (gone[i - 1] if i else False)]
        out.append((len(w), sum(gone), list(zip(edges[::2], edges[1::2])), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def texts_of(seed, n=60, vocabulary=12):
    rng = random.Random(seed)
    passages = [[str(rng.randrange(vocabulary)) for _ in range(rng.randrange(5, 60))] for _ in range(5)]
    out = [None, "", " \n\t ", "one", "Ä ä é 😀 Ä ä é 😀 Ä ä é 😀", "x " * 3000, "A b c d e f", "a b c d e f"]
    for _ in range(n):
        words = [str(rng.randrange(vocabulary * 5)) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        out.append(rng.choice([" ", "  ", "\n", " \x0b"]).join(words))
    return out + out[-4:]


def frame(spark, texts):
    rows = [(None if i % 9 == 0 else i // 2, t, "x", i, [i]) for i, t in enumerate(texts)]
    return importable(spark).createDataFrame(rows, "doc_id bigint, text string, row string, n_words int, kept array<int>")


def found(df):
    rows = sorted(df.collect(), key=lambda r: r.row.n_words)
    return [(r.n_words, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept) for r in rows]


@pytest.mark.parametrize("window, sizes", [(5, (400, 1500, 300)), (4, (50, 400, 4000)), (35, (1 << 20, 1 << 20, 1 << 20)), (1, (300, 1000, 1000)), (2, (300, 1000, 1000))])
def test_repeats_are_those_of_brute_force(spark, window, sizes):
    texts = texts_of(window)
    got = anchors.without_repeats(frame(spark, texts), keep=("doc_id", "row", "n_words", "kept"), window=window, block_bytes=sizes[0], file_bytes=sizes[1], hash_bytes=sizes[2])
    assert got.columns == ["row", "n_words", "n_removed", "spans", "kept"]
    assert found(got) == brute(texts, window)


def test_empty_table_and_odd_window(spark):
    df = frame(spark, ["a b", None])
    assert anchors.without_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        anchors.without_repeats(df, window=0)


@pytest.mark.parametrize("size", [1, 2, 3, 18, 35, 40])
def test_rolling_hashes_depend_on_their_words_only(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 17, 60, 300)]
    r = anchors._Rolling(pa.array(texts))
    h = r.of(size, anchors.BASES[0])
    flat = [x for t in texts for x in t.split()]
    by_hash = {}
    for i in np.flatnonzero(r.left >= size):
        by_hash.setdefault(int(h[i]), set()).add(tuple(flat[i : i + size]))
    runs = {x for xs in by_hash.values() for x in xs}
    assert all(len(x) == 1 for x in by_hash.values()) and len(by_hash) == len(runs)


def test_packed_numbers():
    for kind in (np.uint32, np.uint64):
        x = np.unique(np.random.default_rng(1).integers(0, np.iinfo(kind).max, 1000, dtype=kind, endpoint=True))
        x = np.append(x, kind(np.iinfo(kind).max))
        assert (packed.unpack_sorted(packed.pack_sorted(x), kind) == x).all()
