"""Merkle manifests next to a plain recomputation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textveil.llm import merkle
from textveil.llm.frames import importable


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """Levels of digests, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for low in levels[:-1]:
        run = i - i % fanout
        out.append((i % fanout, low[run:i] + low[i + 1 : run + fanout]))
        i //= fanout
    return out


def brute(rows, fanout):
    """For each (key, group, leaf): proof, subroot, root, in order."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])], fanout) for g in order]
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for at, g in enumerate(order):
        for i, (known, key, leaf) in enumerate(sorted(groups[g])):
            path = siblings(trees[at], i, fanout) + siblings(top, at, fanout)
            out.append((key if known else None, g, leaf, h(*[x for _, run in path for x in run]), trees[at][-1][0], top[-1][0]))
    return sorted(out, key=str)


def docs_of(spark, rows):
    df = importable(spark).createDataFrame(rows, "doc_id bigint, source string, text string, tree bigint, idx string, digest int, path string")
    return df.withColumn("leaf", merkle.leaf_digest(["doc_id", "source", "text"]))


def rows_of(n):
    text = [None, "", "A b", "ä😀", "x" * 50_000]
    out = [(None if i % 11 == 0 else i // 2, [None, "", "b", "ä", "hot", "hot", "hot"][i % 7], text[i % 5], 1, "x", 2, "y") for i in range(n)]
    return out + out[-3:]  # repeated rows


@pytest.mark.parametrize("n, fanout, range_rows", [(1, 16, 1000), (150, 16, 1000), (150, 2, 20), (90, 3, 7)])
def test_manifest_is_the_plain_tree(spark, n, fanout, range_rows):
    df = docs_of(spark, rows_of(n))
    made = merkle.manifest(df, "source", "doc_id", fanout=fanout, range_rows=range_rows)
    root = F.lit(made.root)
    path = F.col("path")
    got = made.leaves.select(
        "row.doc_id", "row.source", merkle.as_text(F.col("digest")).alias("leaf"), F.sha2(merkle.proof(path), 256).alias("proof"),
        merkle.as_text(F.col("subroot")).alias("subroot"), root.alias("root"), "row.tree", "row.idx", "row.path",
        merkle.folded(merkle.as_text(F.col("digest")), path).alias("same"), merkle.folded(F.lit("0" * 64), path).alias("other"),
    ).collect()
    leaves = [(i, s, h(field(i), field(s), field(t))) for i, s, t, *_ in rows_of(n)]
    assert sorted((tuple(r[:6]) for r in got), key=str) == brute(leaves, fanout)
    assert all(r.same == made.root and r.other != made.root for r in got)
    assert {(r.tree, r.idx, r.path) for r in got} == {(1, "x", "y")}, "the rows' own columns stay"


def test_empty_table_and_one_group(spark):
    df = docs_of(spark, rows_of(3))
    made = merkle.manifest(df.limit(0), "source", "doc_id")
    assert made.root is None and made.leaves.count() == 0 and made.leaves.columns == ["row", "digest", "path", "subroot"]
    one = merkle.manifest(df.where("source is null").limit(1), "source", "doc_id")
    (row,) = one.leaves.select(merkle.as_text(F.col("digest")).alias("leaf"), "path").collect()
    assert row.leaf == one.root and row.path == []
    with pytest.raises(ValueError):
        merkle.manifest(df, "source", "doc_id", fanout=1)


def test_fields_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("-", "a")], "x string, y string")
    got = rows.select(merkle.leaf_digest(["x", "y"]).alias("d")).distinct().count()
    assert got == 5
