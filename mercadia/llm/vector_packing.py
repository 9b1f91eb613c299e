"""Vector best-fit packing of documents into sequences of one length.

A piece takes three things from a sequence: tokens, one place among its documents, and attention
cost (the square of its length). Pieces are placed longest first. Of the open sequences that can
hold a piece under every capacity, the one is chosen whose residual capacities fit it best: the
least weighted norm of what would remain (`rule="norm"`), or the greatest weighted dot product of
the piece and the residuals (`rule="dot"`); all parts are shares of their capacity. A piece that
no open sequence can hold opens one.

What a piece takes depends on its length alone, and sequences with equal residuals are alike. So
the choice is made for whole groups at once: the table of lengths and their counts, at most as
many rows as a sequence has tokens, is planned into steps ("pieces 200 to 900 of length 312 go to
sequences 5000 to 5700, at offset 3784"). At most one group is opened and one is split for each
length, so the plan's size depends on the sequence length and never on the number of documents.
The plan is global: there is no remainder per task. Tasks encode their documents and number their
pieces within each length; a prefix sum over the tasks' counts makes these numbers global.

A document's ids end with the end id. Only a document longer than a sequence is cut, into whole
sequences and a rest. A null text is an empty one: the end id alone. Very long texts are encoded
whole and cut like others. Repeated rows are packed as often as they come, ties take the order of
their rows, null ids stay null, an empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercadia.llm.shared import Tables, prepared
from mercadia.llm.tokens import crc_of_ids
from mercadia.llm.word_tokens import word_encoder

#: Production parameters: tokens and documents of a sequence, and the weights of tokens, documents and cost.
SEQUENCE_TOKENS, SEQUENCE_DOCUMENTS = 4096, 1024
WEIGHTS = (1.0, 0.02, 0.02)
#: Bits of a piece's number within its length, in the plan's sorted keys.
RANK_BITS = 48

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, task long, rank long"
PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("ids_crc32", pa.int64()),
        ("task", pa.int64()),
        ("rank", pa.int64()),
    ]
)


def plan(
    counts: dict[int, int],
    tokens: int = SEQUENCE_TOKENS,
    documents: int = SEQUENCE_DOCUMENTS,
    cost: int | None = None,
    weights: Sequence[float] = WEIGHTS,
    rule: str = "norm",
) -> np.ndarray:
    """Steps (length, first piece, number of pieces, first sequence, offset) that place all pieces.

    `counts` has the number of pieces of each length. The cost of a sequence defaults to that of one
    piece of full length, the least that holds every piece.
    """
    capacity = np.array([tokens, documents, tokens**2 if cost is None else cost], np.int64)
    share = np.asarray(weights, float)
    # Open groups of like sequences: residuals, first sequence, number of sequences.
    rest, first, many = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    opened, steps = 0, []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length**2], np.int64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, placed = counts[length], 0
        able = np.flatnonzero((rest >= need).all(axis=1))
        while left:
            if not len(able):
                # One new sequence after another takes as many pieces of this length as it can.
                fits = int((capacity // need).min())
                for size, number in ((fits, left // fits), (left % fits, 1)):
                    if not (size and number):
                        continue
                    for turn in range(size):
                        steps.append((length, placed, number, opened, turn * length))
                        placed += number
                    rest = np.vstack((rest, capacity - size * need))
                    first, many = np.append(first, opened), np.append(many, number)
                    opened += number
                break
            after = (rest[able] - need) / capacity
            if rule == "norm":
                best = able[np.argmin((share * after**2).sum(axis=1))]
            else:
                best = able[np.argmax((share * (rest[able] / capacity) * (need / capacity)).sum(axis=1))]
            taken = min(left, int(many[best]))
            steps.append((length, placed, taken, int(first[best]), int(tokens - rest[best, 0])))
            if taken < many[best]:
                # The sequences that took no piece stay as they are, in a group of their own.
                rest = np.vstack((rest, rest[best]))
                first, many = np.append(first, first[best] + taken), np.append(many, many[best] - taken)
                many[best] = taken
            rest[best] -= need
            placed, left = placed + taken, left - taken
            if not (rest[best] >= need).all():
                able = able[able != best]
        open_ = (rest > 0).all(axis=1)
        rest, first, many = rest[open_], first[open_], many[open_]
    return np.array(steps, np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """Encoded pieces of all documents; `rank` numbers a task's pieces of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = [0] * (tokens + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(encode.encode(text or ""), encode.width), end_id).astype(encode.width)
                for piece, start in enumerate(range(0, len(ids), tokens)):
                    own = ids[start : start + tokens]
                    rows.append((doc_id, piece, start, len(own), own.tobytes(), crc_of_ids(own), task, seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES_ARROW)], schema=PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def placed(pieces: DataFrame, steps: np.ndarray) -> DataFrame:
    """Sequence and offset of each piece, from the plan's steps; `rank` is global here."""
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    length, rank, _, sequence, offset = (np.ascontiguousarray(c) for c in steps[order].T)
    keys, lead = (length << RANK_BITS) | rank, sequence - rank
    bits = RANK_BITS

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << bits) | own_rank, side="right") - 1
            kept = [n for n in batch.schema.names if n not in ("rank", "task")]
            columns = [*map(batch.column, kept), pa.array(lead[at] + own_rank), pa.array(offset[at])]
            yield pa.record_batch(columns, [*kept, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("rank", "task")]
    return pieces.mapInArrow(looked_up, ", ".join([*fields, "sequence_id long", "offset long"]))


def best_fit_packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    tokens: int = SEQUENCE_TOKENS,
    documents: int = SEQUENCE_DOCUMENTS,
    cost: int | None = None,
    weights: Sequence[float] = WEIGHTS,
    rule: str = "norm",
    with_ids: bool = True,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) of all pieces.

    `ids` are bytes, two per id where the vocabulary allows; without them (`with_ids=False`) the
    stored ids are not read again.
    """
    spark = prepared(docs.sparkSession)
    pieces = Tables(spark, "vector-packing").stored(pieces_of(docs, tokenizer, end_id, tokens))
    # One row for each task and length.
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    totals = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(totals, tokens, documents, cost, weights, rule)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "rank"]
    return placed(numbered.select(*columns), steps)
