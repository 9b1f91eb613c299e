"""Hierarchical packing of documents into context windows of several lengths.

A document's ids are cut into whole long windows first; its rest goes to the shortest tier that
holds it. Each tier opens windows of its own length for its rests, longest first, and fills the
gap of a window with the largest shorter rests that fit, then with a piece cut from one of them,
so windows close full. What a buffer can't fill waits for the next documents of the task. At the
task's end the last ids are laid out by the binary digits of their number: sequences of exactly
1024, 512, ... ids, so nothing is padded at all.

Sequences of one length are dealt to step groups of equal numbers of ids. A group is only closed when
it is full: windows wait for others of their length, at most a group's ids for each length, and only
the last group of a length in a task is smaller. Those that are closed together are sorted by the
work that attention has within their pieces (the sum of squared lengths) and dealt there and back
again, so the steps of a run take about the same time.

Every task packs its own part of the table in buffers of a bounded number of ids: there is no
shuffle, and a hot source or a very long text changes nothing. A null text is an empty one: it
holds the separator alone. Repeated rows are packed as often as they come; null ids stay null;
an empty table gives no rows; ties keep the order of their rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercadia.llm.shared import prepared
from mercadia.llm.tokens import encoder

TIERS = (128, 256, 512, 1024)
#: Ids that a task gathers before it packs them.
BUFFER_IDS = 1 << 19
#: Ids of a step group.
STEP_IDS = 32 * 1024

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_id long"
)
SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_length", pa.int64()),
        ("step_id", pa.int64()),
    ]
)


class Rests:
    """Rests of documents sorted by length: (length, number of the document, start)."""

    def __init__(self):
        self.sorted: list[tuple[int, int, int]] = []

    def add(self, rest: tuple[int, int, int]) -> None:
        if rest[0]:
            insort(self.sorted, rest)

    def largest_within(self, most: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.sorted, (most, 1 << 62, 0))
        return self.sorted.pop(at - 1) if at else None

    def smallest_over(self, least: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.sorted, (least + 1, -1, 0))
        return self.sorted.pop(at) if at < len(self.sorted) else None


def pack(rests: Sequence[tuple[int, int, int]], tiers: Sequence[int], last: bool):
    """Windows as lists of pieces (length, document, start), and the rests that wait.

    With `last` set nothing waits: the windows then are of any power of two up to the longest.
    """
    pool, windows = Rests(), []
    for rest in rests:
        pool.add(rest)
    for tier, below in sorted(zip(tiers, (0, *tiers)), reverse=True):
        waiting = sum(length for length, _, _ in pool.sorted)
        while waiting >= tier and pool.sorted and pool.sorted[-1][0] > below:
            window, gap = [], tier
            while gap:
                piece = pool.largest_within(gap)
                if piece is None:
                    length, document, start = pool.smallest_over(gap)
                    pool.add((length - gap, document, start + gap))
                    piece = (gap, document, start)
                window.append(piece)
                gap -= piece[0]
            windows.append(window)
            waiting -= tier
    if not last:
        return windows, pool.sorted
    left = list(reversed(pool.sorted))
    waiting = sum(length for length, _, _ in left)
    tier = max(tiers)
    while waiting:
        while tier > waiting:
            tier //= 2
        window, gap = [], tier
        while gap:
            length, document, start = left.pop()
            used = min(gap, length)
            window.append((used, document, start))
            if length > used:
                left.append((length - used, document, start + used))
            gap -= used
        windows.append(window)
        waiting -= tier
    return windows, []


def steps(windows: list[list[tuple[int, int, int]]], step_ids: int) -> list[int]:
    """A step group for each window: one length in each, even work over the groups of a length.

    The groups of a length are equal in size, but for one window.
    """
    lengths = [sum(piece[0] for piece in window) for window in windows]
    work = [sum(piece[0] ** 2 for piece in window) for window in windows]
    chosen, first = [0] * len(windows), 0
    for length in sorted(set(lengths)):
        own = sorted((k for k, n in enumerate(lengths) if n == length), key=lambda k: (-work[k], k))
        groups = -(-len(own) // max(1, step_ids // length))
        for place, k in enumerate(own):
            turn, step = divmod(place, groups)
            chosen[k] = first + (groups - 1 - step if turn % 2 else step)
        first += groups
    return chosen


class Steps:
    """Windows that wait until those of their length fill step groups."""

    def __init__(self, step_ids: int):
        self.step_ids = step_ids
        self.waiting: dict[int, list] = {}

    def full(self, windows: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """As many windows of each length, oldest first, as fill whole groups; the others wait."""
        for window in windows:
            self.waiting.setdefault(sum(piece[0] for piece in window), []).append(window)
        ready = []
        for length, own in self.waiting.items():
            size = max(1, self.step_ids // length)
            whole = len(own) - len(own) % size
            ready += own[:whole]
            self.waiting[length] = own[whole:]
        return ready

    def rest(self) -> list[list[tuple[int, int, int]]]:
        """All that waits: the last, smaller group of each length."""
        left = [window for own in self.waiting.values() for window in own]
        self.waiting = {}
        return left


def packed(docs: DataFrame, tokenizer: str, separator_id: int, tiers: Sequence[int] = TIERS, buffer_ids: int = BUFFER_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """Pieces of all documents with their ids, their places in sequences, and step groups.

    Every tier is a power of two. `sequence_id` and `step_id` hold the task's number in their
    upper bits.
    """
    tiers = sorted(tiers)
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    top = tiers[-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        task = TaskContext.get().partitionId() << 40
        counts = {"sequence": 0, "step": 0}
        kept: dict[int, tuple[int | None, np.ndarray]] = {}
        rests: list[tuple[int, int, int]] = []

        def closed(windows: list) -> pa.RecordBatch:
            rows = []
            for window, step in zip(windows, chosen := steps(windows, step_ids)):
                at, length = 0, sum(piece[0] for piece in window)
                for size, document, start in window:
                    doc_id, ids = kept[document]
                    rows.append(
                        (doc_id, start, size, ids[start : start + size].tobytes(), len(ids),
                         task + counts["sequence"], at, length, task + counts["step"] + step)
                    )
                    at += size
                counts["sequence"] += 1
            counts["step"] += max(chosen, default=-1) + 1
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

        number, gathered, whole, groups = 0, 0, [], Steps(step_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(encode.encode(text or ""), encode.width)
                ids = np.append(ids, separator_id).astype("<u4")
                kept[number] = (doc_id, ids)
                whole += [[(top, number, at)] for at in range(0, len(ids) - top + 1, top)]
                if rest := len(ids) % top:
                    rests.append((rest, number, len(ids) - rest))
                number, gathered = number + 1, gathered + len(ids)
                if gathered >= buffer_ids:
                    windows, rests = pack(rests, tiers, last=False)
                    if ready := groups.full(whole + windows):
                        yield closed(ready)
                    waiting = [piece for own in groups.waiting.values() for window in own for piece in window]
                    kept = {document: kept[document] for _, document, _ in (*rests, *waiting)}
                    gathered, whole = sum(length for length, _, _ in rests), []
        windows, _ = pack(rests, tiers, last=True)
        if ready := groups.full(whole + windows):
            yield closed(ready)
        if left := groups.rest():
            yield closed(left)

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def placement(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids, which their CRC-32 stands for."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
