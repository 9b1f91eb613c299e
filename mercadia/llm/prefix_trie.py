"""Prefix trie of conversations, rolled up band by band.

A node is a distinct sequence of first turns (role, text); the root is the sequence of none. A
conversation is a member of the nodes of all its prefixes.

Turns get their places from ranges of (conversation, turn), so a conversation of any length is
dealt to several tasks. A prefix is named by 128 bits, the exclusive or of hashes of its turns and their depths;
it runs within blocks of 64 turns, whose totals run in the same way.

Subtree totals use bands of a fixed height. A node hands its own values only to its ancestors
inside its band, at most the band's height of them. The totals of band roots then form a trie of
their own, an eighth as deep, which is rolled up alike; completed totals of band roots are handed to
the band above them. So a node is exploded to a bounded number of rows, and rounds grow with the
logarithm of the depth. Sums fold before each shuffle: a root that all conversations share costs
one row for each task.

The ends of a node are hashed in order from pieces of at most 512 ids, read as a stream; a hash of a
sequence can't be taken in parts, but no task holds more than a piece.

Conversations are ordered by turn, null first; ties by role, then by the MD5 of the text. A null
role or text is an empty one. Texts of any length count whole; only their hashes and lengths are
shuffled. Rows with a null conv_id belong to no conversation and are left out. Repeated rows are
repeated turns. An empty table has no members and no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercadia.functions.ranks import numbered, ranged
from mercadia.llm.shared import Tables, prepared

#: Height of a band; nodes are exploded to so many ancestors at most.
BAND = 8
#: Turns of a conversation that are handled together; a multiple of the band.
BLOCK = 64
#: Ids in a piece of a node's list of ends.
PIECE_IDS = 512
#: Fixed values of the rebuilt conversations: conversations of a group, and turns that are taken over.
GROUP, TAKEN = 100, 6


def placed_turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """Rows (conv_id, place from 1, two hashes of role and text, code points of the text), stored."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), role, text).alias("t2"),
        F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    dealt = tables.stored(ranged(rows, ["conv_id"], order))
    found = tables.stored(numbered(dealt, ["conv_id"], order, "place").select("conv_id", "place", "t1", "t2", "chars"))
    tables.drop(dealt)
    return found


def rebuilt(turns: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) that begin with turns of their group's first one, and their turns by depth.

    Conversation c takes the first h turns of c - c % 100 (all if it has fewer, none if there is no
    such one) and then its own turns after its first h, where h is crc32 of the decimal c, modulo 6.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    named = sizes.withColumns({"h": taken, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    found = named.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = tables.stored(found.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    values = ["conv_id", "depth", "t1", "t2", "chars", "n_turns"]
    own = turns.join(convs, "conv_id").filter("place > h").withColumn("depth", F.col("m") + F.col("place") - F.col("h"))
    heads = turns.filter(F.col("place") < TAKEN).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "t1", "t2", "chars")
    borrowed = convs.join(heads, "base").filter("depth <= m")
    return convs.select("conv_id", "n_turns"), own.select(values).unionByName(borrowed.select(values))


def running_xor(rows: DataFrame, columns: list[str], most: int, tables: Tables) -> DataFrame:
    """Replaces columns by their running exclusive or along `at` (from 0 to `most`) in each conversation."""
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.withColumn("block", F.expr(f"at div {BLOCK}"))
    if most < BLOCK:
        return cut.withColumns({c: F.bit_xor(c).over(inside) for c in columns}).drop("block")
    cut = tables.stored(cut)
    totals = cut.groupBy("conv_id", F.col("block").alias("at")).agg(*(F.bit_xor(c).alias(c) for c in columns))
    through = running_xor(totals, columns, most // BLOCK, tables)
    before = through.select("conv_id", (F.col("at") + 1).alias("block"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = cut.withColumns({c: F.bit_xor(c).over(inside) for c in columns}).join(before, ["conv_id", "block"], "left")
    summed = {c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in columns}
    return joined.withColumns(summed).drop("block", *(f"_{c}" for c in columns))


def members_of(convs: DataFrame, turns: DataFrame, most: int, tables: Tables) -> DataFrame:
    """Rows (conv_id, at, key, chars, ends) for every prefix of every conversation, the empty one included; stored."""
    deep = turns.select(
        "conv_id",
        "depth",
        (F.col("depth") - 1).alias("at"),
        F.xxhash64("t1", "t2", "depth").alias("k1"),
        F.xxhash64("depth", "t2", F.lit(1), "t1").alias("k2"),
        "chars",
        (F.col("depth") == F.col("n_turns")).alias("ends"),
    )
    keyed = running_xor(deep, ["k1", "k2"], max(most - 1, 0), tables)
    roots = convs.select(
        "conv_id",
        F.lit(0).cast("long").alias("at"),
        F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).alias("key"),
        F.lit(0).cast("long").alias("chars"),
        (F.col("n_turns") == 0).alias("ends"),
    )
    return tables.stored(roots.unionByName(keyed.select("conv_id", F.col("depth").alias("at"), F.struct("k1", "k2").alias("key"), "chars", "ends")))


def with_ancestors(members: DataFrame) -> DataFrame:
    """Members with `up`: the keys above them in their parent's band, the band's root first and the parent last."""
    at = F.col("at")
    own, next_ = F.expr(f"(at + {BLOCK - 1}) div {BLOCK} - 1"), F.expr(f"at div {BLOCK}")
    # A block's rows are led by the last row of the block before.
    led = members.withColumn("block", F.explode(F.when(at % BLOCK == 0, F.array(own, next_)).otherwise(F.array(own))))
    above = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(-BAND, -1)
    listed = led.withColumn("above", F.collect_list("key").over(above)).filter((at > 0) & (at > F.col("block") * BLOCK))
    up = F.slice("above", -((at - 1) % BAND + 1).cast("int"), ((at - 1) % BAND + 1).cast("int"))
    found = listed.withColumn("up", F.when(at > 0, up)).drop("block", "above")
    kind = found.schema["up"].dataType
    return found.unionByName(members.filter(at == 0).withColumn("up", F.lit(None).cast(kind)))


def rolled_up(nodes: DataFrame, members: DataFrame, values: list[str], most: int, tables: Tables) -> DataFrame:
    """Subtree totals (key, *values) of stored nodes (key, at, up, *values), down to depth `most`."""
    at = F.col("at")

    def handed(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("up").alias("key"), *values)

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*(F.sum(v).alias(v) for v in values))

    in_band = added(nodes.select("key", *values).unionByName(handed(nodes.filter(at % BAND != 0))))
    if most < BAND:
        return in_band
    in_band = tables.stored(in_band)
    # Band roots are the nodes of a trie that is an eighth as deep.
    root_members = tables.stored(members.filter(at % BAND == 0).select("conv_id", F.expr(f"at div {BAND}").alias("at"), "key"))
    paths = with_ancestors(root_members).groupBy("key").agg(F.max("at").alias("at"), F.first("up").alias("up"))
    roots = tables.stored(paths.join(in_band, "key"))
    complete = rolled_up(roots, root_members, values, most // BAND, tables)
    below = nodes.filter((at > 0) & (at % BAND == 0)).select("key", "up").join(complete, "key")
    return added(in_band.unionByName(handed(below)))


def ends_of(members: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256) of nodes where conversations end."""
    own = members.filter("ends").withColumn("piece", F.floor(F.col("conv_id") / PIECE_IDS))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = own.groupBy("key", "piece").agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            k1, k2, digests = zip(*rows)
            return pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digests)], ["k1", "k2", "ends_sha256"])

        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([(*key, state.hexdigest())])

    streamed = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key.k1", "key.k2", "ids")
    found = streamed.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")
    return found.select(F.struct("k1", "k2").alias("key"), "ends_sha256")


def trie(convs: DataFrame, turns: DataFrame, tables: Tables) -> DataFrame:
    """Nodes of conversations (conv_id, n_turns) with turns (conv_id, depth, t1, t2, chars, n_turns).

    Rows: key, conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    most = convs.agg(F.max("n_turns")).first()[0] or 0
    members = members_of(convs, turns, most, tables)
    found = with_ancestors(members).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("at").alias("at"),
        F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.first("up").alias("up"),
    )
    # A node without children is one where all members end.
    own = {"n_leaves": (F.col("n_convs") == F.col("n_ends")).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}
    nodes = tables.stored(found.withColumns(own).drop("chars", "n_ends"))
    values = ["n_leaves", "saved_tokens"]
    totals = rolled_up(nodes.select("key", "at", "up", *values), members, values, most, tables)
    parent = F.element_at("up", -1)
    children = nodes.filter("at > 0").groupBy(parent.alias("key")).agg(F.count("*").alias("n_children"))
    whole = nodes.drop(*values).join(totals, "key").join(children, "key", "left").join(ends_of(members), "key", "left")
    # Many children may have one parent; Spark splits that side.
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = whole.withColumn("parent", F.when(F.col("at") > 0, parent)).join(parents, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return named.select(
        "key",
        "conv_id",
        F.col("at").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt first or as they are."""
    tables = Tables(prepared(conversations.sparkSession), "prefix-trie")
    turns = placed_turns(conversations, tables)
    if rebuild:
        return trie(*rebuilt(turns, tables), tables)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return trie(convs, turns.withColumnRenamed("place", "depth").join(convs, "conv_id"), tables)


def node_texts(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the last role and text of their sequence, read from their least member; not for rebuilt ones.

    For each (conv_id, depth) of a node there is one turn.
    """
    tables = Tables(prepared(conversations.sparkSession), "prefix-trie-texts")
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    hashed: list[Column] = [F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(7), role, text).alias("t2")]
    turns = placed_turns(conversations, tables).join(nodes.select("conv_id", F.col("depth").alias("place")), ["conv_id", "place"])
    texts = conversations.select("conv_id", role.alias("role"), text.alias("text"), *hashed).dropDuplicates(["conv_id", "t1", "t2"])
    known = turns.join(texts, ["conv_id", "t1", "t2"]).select("conv_id", F.col("place").alias("depth"), "role", "text")
    return nodes.join(known, ["conv_id", "depth"], "left")
