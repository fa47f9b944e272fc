"""Chat conversations as token sequences with a mask of what to learn.

Every turn is a few segments: a reserved id that opens it, its role, a reserved id
that ends the role, the text, a reserved id that closes it.  Segments are encoded
one by one and the reserved ids put between them, so no text can form one.  In the
written form the marks are strings; where a text holds such a string, a backslash
breaks it, and backslashes are doubled, which reading undoes.  Prefix sums of the
segments' lengths tell where the masked tokens lie.

A conversation may be longer than a task can hold: it is written in chunks in order
of the turns, and reading goes through the chunks one after another.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textveil.llm.memory import held

#: The written marks, in the order of the reserved ids after the vocabulary.
MARKS = ("<turn>", "### ", "</turn>")
CONTROL = re.compile(r"#(?=## )|<(?=/?turn>)")
CHUNK = 1 << 18
LEARNED = "assistant"

SCHEMA = "conv_id bigint, chunk bigint, n_turns bigint, ids array<int>, loss array<struct<start: bigint, length: bigint>>"


def escape(text: str) -> str:
    """No mark is left in the text; :func:`unescape` gives it back."""
    return CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo :func:`escape`: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def tokenizer(path: str):
    """Byte-level BPE from a file of ranks."""
    def made():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("chat", path), made)


def format_chats(turns: DataFrame, path: str, learned: str = LEARNED) -> DataFrame:
    """Chunks of token ids with the spans to learn: conv_id, chunk, n_turns, ids, loss.

    ``turns``: conv_id, turn, role, text.  Null roles and texts are empty; null ids
    are one conversation, null turns come first; equal turn numbers go by role and
    text, and repeated rows are repeated turns.  An empty table gives an empty
    result.  Other columns are not looked at.  Chunks end between turns.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_rows = rows.repartition(_partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        first = coder.n_vocab
        open_, head, close = first, first + 1, first + 2
        out: list[tuple] = []
        segments: list[np.ndarray] = []
        masks: list[bool] = []
        conv, chunk, n_turns, held, begun = None, 0, 0, 0, False

        def end_chunk() -> None:
            nonlocal chunk, n_turns, held
            sizes = np.array([len(x) for x in segments], np.int64)
            start = np.cumsum(sizes) - sizes
            loss = [{"start": int(s), "length": int(n)} for s, n, m in zip(start, sizes, masks) if m and n]
            out.append((conv, chunk, n_turns, np.concatenate(segments), loss))
            segments.clear()
            masks.clear()
            chunk, n_turns, held = chunk + 1, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                c = list(zip(*out))
                loss = pa.array(c[4], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array([list(x) for x in c[3]], pa.list_(pa.int32())), loss],
                    ["conv_id", "chunk", "n_turns", "ids", "loss"],
                )
                out.clear()

        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if begun and (c != conv or held > CHUNK):
                    end_chunk()
                    if c != conv:
                        chunk = 0
                    if len(out) >= 200 or sum(len(x[3]) for x in out) > CHUNK:
                        yield from flush()
                conv, begun = c, True
                for part, mask in (([open_], False), (coder.encode_ordinary(escape(role)), False), ([head], False), (coder.encode_ordinary(escape(text)), role == learned), ([close], False)):
                    segments.append(np.array(part, np.int32))
                    masks.append(mask)
                    held += len(part)
                n_turns += 1
        if begun:
            end_chunk()
        yield from flush()

    return sorted_rows.mapInArrow(run, SCHEMA)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written(ids: np.ndarray, coder) -> str:
    """The text form of token ids, marks as strings."""
    first, out, at = coder.n_vocab, [], 0
    for i in np.flatnonzero(ids >= first):
        out += [coder.decode(ids[at:i].tolist()), MARKS[ids[i] - first]]
        at = i + 1
    return "".join([*out, coder.decode(ids[at:].tolist())])


def read_chats(chunks: DataFrame, path: str) -> DataFrame:
    """Digests of what formatted chunks hold, read from the tokens alone.

    Chunks must lie in order, as :func:`format_chats` gives them.  Columns: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        first = coder.n_vocab
        done: list[tuple] = []
        state: list = []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for c, chunk, ids, loss in zip(*(batch.column(x) for x in ("conv_id", "chunk", "ids", "loss"))):
                if chunk.as_py() == 0:
                    if state:
                        close()
                    state = [c.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = ids.values.to_numpy()
                state[5] += len(written(tokens, coder))
                marks = np.flatnonzero(tokens >= first)
                for a, b, e in zip(*(marks[k::3] for k in range(3))):
                    role, text = (unescape(coder.decode(tokens[x + 1 : y].tolist())) for x, y in ((a, b), (b, e)))
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in loss.as_py():
                    text = unescape(coder.decode(tokens[span["start"] : span["start"] + span["length"]].tolist()))
                    state[3] += len(text)
                    state[4].update(text.encode())
            if len(done) > 5000:
                yield _digests(done)
                done = []
        if state:
            close()
        if done:
            yield _digests(done)

    return chunks.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
