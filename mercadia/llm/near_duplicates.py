"""Near-duplicates by BagMinHash signatures, bands, and a check of multiset overlap.

A document is the multiset of its runs of five words; two documents are near-duplicates if the
weighted Jaccard similarity of these multisets, the sum of least counts over the sum of greatest
counts, is at least 0.8. Words are runs of letters of any script and digits, in lower case.

Signature. A run's weight is its count, discretised into blocks [0,1], [1,2], [2,4], [4,8], ...
Each block carries a Poisson process of a rate in proportion to its width, seeded by run and
block; each of its points falls on one signature component and has a place inside the block,
whose binary digits say which halves it falls in. A document takes the points below its own
weight and keeps the earliest point of each component, so two documents agree on a component with
a probability equal to their weighted Jaccard similarity. Processes stop as soon as all components
have an earlier point, and a weight costs the logarithm of its size.

Bands of five components propose pairs. Documents of equal words are one node from the start. In
each bucket all nodes are compared with the one that shares most buckets with others, as the
original of many copies does, which links a group of copies in one round; then, in buckets that
still hold several classes, the leader is set aside and further leaders are compared, more of them in each
round (none, 3, 15, 63, ... drawn ones besides the first), until every remaining pair of a bucket
is checked or of one class already. A pair meets in the first of its common buckets only. After the
first round the runs of what is left are counted: runs that no other node has cannot overlap, which
bounds the similarity of a node, and of a pair, from above; nodes and pairs whose bound is below the
threshold are passed over without reading their texts. The bound is exact, so no proposed link is
lost; no group of copies is expanded into pairs, and nothing is gathered in one place. With 25 bands
a pair at 0.8 is proposed with probability 0.99995, one at 0.9 practically always.

A document of fewer than five words is one run of all its words. A null text or one without a word
is alone in a class of its own. Very long texts are read whole. Null ids are allowed; a class is named by its
least id. Repeated rows are duplicates of each other, ties between leaders go to the least node, and further
columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm.components import components
from mercadia.llm.shared import Tables, prepared

RUN_WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 25, 5
#: How many times as many leaders each round has.
GROWTH = 4

_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_ODD = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each 64-bit number."""
    x = x + np.uint64(_A)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_C)
    return x ^ (x >> np.uint64(31))


def word_bytes() -> np.ndarray:
    """For each byte whether it belongs to a word: a-z, 0-9 and all bytes of other scripts."""
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = table[ord("a") : ord("z") + 1] = table[128:] = True
    return table


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the text that each belongs to."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = word_bytes()[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    # Rolling sums in blocks keep memory in proportion to the text.
    power = powers(len(data), _ODD)
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    inverse = pow(_ODD, -1, 1 << 64)
    sums = total[ends] - total[starts]
    sums *= powers(int(starts[-1]) + 1 if len(starts) else 0, inverse)[starts]
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return mixed(sums ^ mixed((ends - starts).astype(np.uint64))), owner


def runs(words: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words and their owners; a shorter text has one run of all its words."""
    counts = np.bincount(owner, minlength=n_texts)
    first = np.cumsum(counts) - counts
    n = len(words)
    if not n:
        return words, owner
    padded = np.concatenate((words, np.zeros(RUN_WORDS, np.uint64)))
    left = counts[owner] - (np.arange(n) - first[owner])  # words of the text from here on
    acc = np.zeros(n, np.uint64)
    for k in range(RUN_WORDS):
        acc = np.where(left > k, mixed(acc * np.uint64(_ODD) + padded[k : k + n]), acc)
    begins = (left >= RUN_WORDS) | ((counts[owner] < RUN_WORDS) & (left == counts[owner]))
    return acc[begins], owner[begins]


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text, sorted by text and hash, with their counts."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def signatures(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures, a row of `size` numbers for each text; texts without runs get zeros."""
    weight = np.bincount(owner, weights=counts, minlength=n_texts)
    best = np.full(n_texts * size, np.inf)
    # A text's processes run until this time; it doubles for texts with an empty component.
    limit = np.where(weight > 0, (np.log(size) + 3) / np.maximum(weight, 1), 0.0)
    n_blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(hashes)), n_blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)
    seed = mixed(hashes[element] + mixed(block.astype(np.uint64)))
    seed_owner, top = owner[element], counts[element]
    rest = np.arange(len(seed))
    while len(rest):
        now, time = rest, np.zeros(len(rest))
        step = 0
        while len(now):
            step += 1
            drawn = mixed(seed[now] + np.uint64((step * _ODD) % (1 << 64)))
            time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[now]
            going = time <= limit[seed_owner[now]]
            now, time, drawn = now[going], time[going], drawn[going]
            other = mixed(drawn)
            below = low[now] + (other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[now] < top[now]
            slot = seed_owner[now] * size + ((other & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, slot[below], time[below])
        open_ = np.isinf(best.reshape(n_texts, size)).any(axis=1) & (weight > 0)
        limit = np.where(open_, limit * 2, limit)
        rest = np.flatnonzero(open_[seed_owner])
    found = best.reshape(n_texts, size).view(np.uint64)
    return np.where(weight[:, None] > 0, found, np.uint64(0))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    acc = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64)), cut.shape[:2]).copy()
    for k in range(rows):
        acc = mixed(acc * np.uint64(_ODD) + cut[:, :, k])
    return acc.view(np.int64)


def content_nodes(words: np.ndarray, owner: np.ndarray, n_texts: int) -> list[bytes | None]:
    """128 bits of each text's words in order; None for a text without words."""
    counts = np.bincount(owner, minlength=n_texts)
    place = (np.arange(len(words)) - (np.cumsum(counts) - counts)[owner]).astype(np.uint64)
    halves = []
    for salt in (_A, _B):
        each = mixed(words ^ mixed(place * np.uint64(_ODD) + np.uint64(salt)))
        total = np.concatenate(([np.uint64(0)], np.cumsum(each, dtype=np.uint64)))
        ends = np.cumsum(counts)
        halves.append(mixed(total[ends] - total[ends - counts]))
    both = np.stack(halves, axis=1)
    return [row.tobytes() if n else None for row, n in zip(both, counts)]


def row_hashes() -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2")]


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Rows (doc_id, k1, k2, node, weight, bands) of all documents; the weight is the number of runs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, owner = hashed_words(texts)
            found = counted(*runs(words, owner, len(texts)))
            keys = band_keys(signatures(*found, len(texts), bands * rows), bands, rows)
            weight = np.bincount(found[1], weights=found[2], minlength=len(texts)).astype(np.int64)
            nodes = content_nodes(words, owner, len(texts))
            lists = [k.tolist() if node else [] for k, node in zip(keys, nodes)]
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(nodes, pa.binary()), pa.array(weight)]
            yield pa.record_batch([*columns, pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "node", "weight", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_hashes())
    return rows_.mapInArrow(of, "doc_id long, k1 long, k2 long, node binary, weight long, bands array<long>")


def multisets(docs: DataFrame) -> DataFrame:
    """Rows (node, bag): the sorted runs of a document and their counts, as bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words, owner = hashed_words(texts)
            hashes, of_text, counts = counted(*runs(words, owner, len(texts)))
            ends = np.cumsum(np.bincount(of_text, minlength=len(texts)))
            bags, begin = [], 0
            for end in ends:
                bags.append(hashes[begin:end].tobytes() + counts[begin:end].astype(np.uint32).tobytes())
                begin = end
            yield pa.record_batch(
                [pa.array(content_nodes(words, owner, len(texts)), pa.binary()), pa.array(bags, pa.binary())], ["node", "bag"]
            )

    return docs.select("text").mapInArrow(of, "node binary, bag binary").filter("node is not null")


def overlap(left: bytes, right: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    n, m = len(left) // 12, len(right) // 12
    a, b = np.frombuffer(left, np.uint64, n), np.frombuffer(right, np.uint64, m)
    x, y = np.frombuffer(left, np.uint32, n, 8 * n), np.frombuffer(right, np.uint32, m, 8 * m)
    at = np.searchsorted(b, a)
    same = np.flatnonzero(b[np.minimum(at, m - 1)] == a)
    least = int(np.minimum(x[same], y[at[same]]).sum(dtype=np.int64))
    return least / (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64)) - least)


def alike(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose bags overlap enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [overlap(x.as_buffer(), y.as_buffer()) >= similarity for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "bag_a", "bag_b")
    return both.mapInArrow(kept, "a binary, b binary")


def lone_weights(bags: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (owner, lone): the weight of a node's runs that no other of these nodes has.

    The owner is a hash of the node. A run is counted where it is before it is shuffled, so a run
    that very many nodes have costs one row for each task.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [(len(bag.as_buffer()) // 12, bag.as_buffer()) for bag in batch.column(1)]
            sizes = np.array([n for n, _ in parts], np.int64)
            found = [np.frombuffer(bag, np.int64, n) for n, bag in parts]
            times = [np.frombuffer(bag, np.uint32, n, 8 * n).astype(np.int64) for n, bag in parts]
            owner = np.repeat(batch.column(0).to_numpy(), sizes)
            columns = [pa.array(np.concatenate(x)) for x in (found, times)]
            yield pa.record_batch([*columns, pa.array(owner)], ["run", "times", "owner"])

    own = bags.join(nodes, "node", "left_semi").select(F.xxhash64("node").alias("owner"), "bag")
    each = own.mapInArrow(of, "run long, times long, owner long")
    runs_ = each.groupBy("run").agg(F.count("*").alias("n"), F.min("owner").alias("owner"), F.sum("times").alias("times"))
    return runs_.filter("n = 1").groupBy("owner").agg(F.sum("times").alias("lone"))


def linked_nodes(proposals: DataFrame, docs: DataFrame, unique: DataFrame, similarity: float, tables: Tables) -> DataFrame:
    """Rows (node, root) of all nodes that some verified link joins to another node.

    `proposals` has rows (key, node, weight), `unique` rows (node, doc_id, bands).
    """
    buckets = proposals.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    met = proposals.join(buckets.select("key", "n"), "key")
    # The original of many copies shares more buckets with them than they share with each other.
    company = met.groupBy("node").agg((-F.sum("n")).alias("order")).join(unique.select("node", "bands"), "node")
    known = met.select("key", "node", "weight").join(company, "node")
    columns = ["key", "node", "weight", "shared", "order", "bands"]
    state = tables.stored(known.withColumn("shared", F.col("weight")).select(columns))
    nodes = state.select("node").distinct()
    wanted = tables.stored(unique.select("node", "doc_id").join(nodes, "node"))
    keyed = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = multisets(texts.join(keyed, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text"))
    bags = tables.stored(found.groupBy("node").agg(F.first("bag").alias("bag")))
    labels = tables.stored(nodes.select("node", F.col("node").alias("root")))
    leaders = 1
    while state.take(1):
        # state: the nodes of a bucket that are not set aside yet. Its leaders are the node in most
        # company and, after the first round, others that a hash draws, GROWTH times as many in each round.
        named = state.join(labels, "node")
        sizes = named.groupBy("key").agg(F.min(F.struct("order", "node")).alias("first"), F.count("*").alias("n"))
        drawn = (F.xxhash64("node").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))) < F.lit(leaders - 1) / F.col("n")
        leads = (F.col("node") == F.col("first.node")) | drawn
        members = tables.stored(named.join(sizes, "key").select(*columns, "root", leads.alias("leads")))
        first = members.filter("leads").select(
            F.col("key").alias("a_key"),
            F.col("node").alias("a"),
            F.col("root").alias("a_root"),
            F.col("weight").alias("a_weight"),
            F.col("shared").alias("a_shared"),
            F.col("bands").alias("a_bands"),
        )
        # No more than the shared weight of either can overlap.
        most = F.least("shared", "a_shared")
        near = most >= (F.col("weight") + F.col("a_weight") - most) * F.lit(similarity - 1e-9)
        open_ = (F.col("root") != F.col("a_root")) & (~F.col("leads") | (F.col("a") < F.col("node")))
        # A pair that shares several buckets meets in the first of them only.
        common = F.filter(F.zip_with("bands", "a_bands", lambda x, y: F.when(x == y, x)), lambda k: k.isNotNull())
        met = first.join(members, (F.col("key") == F.col("a_key")) & near & open_ & (common[0] == F.col("key")))
        links = tables.stored(alike(met.select("a", F.col("node").alias("b")), bags, similarity))
        before = labels
        if links.take(1):
            left = labels.select(F.col("node").alias("a"), F.col("root").alias("from"))
            right = labels.select(F.col("node").alias("b"), F.col("root").alias("to"))
            ends = links.join(left, "a").join(right, "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
            merged = components(ends, tables).select(F.col("node").alias("root"), F.col("root").alias("new"))
            labels = tables.stored(labels.join(merged, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        # A bucket whose nodes are all of one class has nothing left to compare.
        rest = members.filter("not leads").select(columns)
        spans = rest.join(labels, "node").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
        after = tables.stored(rest.join(spans.filter("x <> y").select("key"), "key"))
        if leaders == 1:
            # What is left mostly differs. Texts with too many runs of their own are like no other.
            lone = lone_weights(bags, after.select("node").distinct())
            weighed = after.join(lone, F.xxhash64("node") == F.col("owner"), "left")
            weighed = weighed.withColumn("shared", F.col("weight") - F.coalesce("lone", F.lit(0))).select(columns)
            kept = tables.stored(weighed.filter(F.col("shared") >= F.col("weight") * F.lit(similarity - 1e-9)))
            tables.drop(after)
            after = kept
        tables.drop(state, members, links, *([before] if before is not labels else []))
        state, leaders = after, leaders * GROWTH
    tables.drop(bags, wanted)
    return labels


def duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (doc_id, k1, k2, node, root, class_id, class_size) of all documents, stored.

    `class_id` is the least doc_id of the class, `class_size` its number of documents. `node` is
    equal for documents of equal words, `root` for those of a class; both are null without words,
    and the class is then the row's own.
    """
    spark = prepared(docs.sparkSession)
    tables = Tables(spark, "near-duplicates")
    all_rows = tables.stored(signed(docs, bands, band_rows))
    rows = all_rows.filter("node is not null")
    # Copies fold into one node before anything else is shuffled.
    unique = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    unique = tables.stored(unique)
    proposals = unique.select("node", "weight", F.explode("bands").alias("key"))
    labels = linked_nodes(proposals, docs, unique.select("node", "doc_id", "bands"), similarity, tables)
    counts = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = counts.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "n")
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = rooted.join(classes, "root").select("node", "root", "class_id", "class_size")
    named = rows.drop("bands", "weight").join(of_node, "node")
    lone = all_rows.filter("node is null").drop("bands", "weight").withColumns(
        {"root": F.lit(None).cast("binary"), "class_id": F.col("doc_id"), "class_size": F.lit(1).cast("long")}
    )
    found = tables.stored(named.unionByName(lone))
    tables.drop(all_rows, unique, labels)
    return found


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One document of each class, with all its columns: the one of the least id, then of the least hash.

    Rows alike in id and text are one document. Documents without a word all stay.
    """
    classes = duplicate_classes(docs, similarity, bands, band_rows)
    own = ["doc_id", "k1", "k2"]
    alike_rows = classes.filter("node is not null").groupBy("root", *own).agg(F.count("*").alias("n"))
    chosen = alike_rows.groupBy("root").agg(F.min(F.struct(*own, "n")).alias("row")).select("row.k1", "row.k2", "row.n")
    lone = classes.filter("node is null").select("k1", "k2", F.lit(0).cast("long").alias("n")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_hashes()).join(chosen.unionByName(lone), ["k1", "k2"])
    # Only rows that repeat another in all respects meet here.
    single = rows.filter("n <= 1").select("row")
    repeated = rows.filter("n > 1").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
