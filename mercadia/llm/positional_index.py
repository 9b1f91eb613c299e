"""Benchmark passages in documents, by a positional inverted index and built-in functions alone.

Words are runs of a-z, 0-9 and all characters from U+0080 on, after A-Z are put in lower case. A
benchmark item gives windows of ten words; an item of fewer words is one window of all of them.

1. Count the benchmark's terms over all documents. A window with a term that never occurs has no
   exact match; it may have proximity matches.
2. Each window keeps its rarest terms as anchors. Only their postings (document, position) are
   stored: a full index would be larger than the corpus.
3. Shift each posting back by its term's offset in the window. The shifted lists are intersected:
   a start on which all anchors agree is a candidate. A candidate counts if the document's words
   there are the window's words.
4. A proximity match is a window of which at least the share `share` of words (rounded up) stands in
   the document, with starts within `slop` words of each other: words were put in, left out,
   replaced or moved. A word of the document stands for one word of the window. Of `missing + 1`
   words, where `missing` may be absent, one must occur; so the rarest of them are the anchors, and
   no match is lost. An anchor's posting takes along the words around it. It is held against the
   words around the anchor in the item first, for all of the item's windows at once; what has
   enough words in common is then counted window by window, place by place. Words are compared by
   64-bit hashes here.

Postings are shuffled once, by document: lists are intersected where a document's postings meet, and
its text joins them by the same partitioning; texts of any length are read whole. A document's postings are no more than its words, so
no term or passage that is common makes a large group. The benchmark's own tables are broadcast if they have few rows and
shuffled otherwise. Documents are told apart by two 64-bit hashes of id and text, so null or
repeated ids are safe; repeated rows get equal results. Null texts have no words and no hits.
Items without id hit words but are not counted as items. Ties between equally rare terms go to the
first of the window. Empty tables give zeros or no rows; further columns are ignored, but kept by
`clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mercadia.llm.shared import Tables, broadcast_if_small, settled

WINDOW_WORDS, ANCHORS, SLOP = 10, 2, 5
#: Hundredths of a window's words that a proximity match has.
SHARE = 80
#: Rows of the benchmark's tables that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # Only a text without other letters may be put in lower case as a whole.
    plain = F.octet_length(text) == F.length(text)
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, BETWEEN), "")


def hashes() -> dict[str, Column]:
    return {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")}


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Rows (item, words, at, size, terms, phrase): all windows of all items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = items.select("item", "words", length.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    return starts.withColumn("terms", F.expr("slice(words, at, size)")).withColumn("phrase", F.array_join("terms", " "))


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """Rows (phrase, size, terms, items): the distinct windows and the items that have them."""
    return (
        item_windows(benchmark, size)
        .groupBy("phrase")
        .agg(F.first("size").alias("size"), F.first("terms").alias("terms"), F.collect_set("item").alias("items"))
    )


def exploded(docs: DataFrame) -> DataFrame:
    """Rows (k1, k2, position, term) of all words of all documents."""
    return docs.select(*(c.alias(k) for k, c in hashes().items()), F.posexplode(words_of(F.col("text"))).alias("position", "term"))


def counted(windows: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """Rows (window, term, offset, seen): all words of the windows; seen is null for words of no document."""
    places = windows.select("window", F.posexplode("terms").alias("offset", "term"))
    vocabulary = broadcast_if_small(places.select("term").distinct(), rows)
    words = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    seen = words.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("seen"))
    return places.join(seen, "term", "left")


def anchored(places: DataFrame, anchors: int) -> DataFrame:
    """Rows (window, term, offset, rank, n): the rarest terms of windows whose terms all occur."""
    own = Window.partitionBy("window")
    return (
        places.withColumn("missing", F.max(F.col("seen").isNull()).over(own))
        .filter(~F.col("missing"))
        .withColumn("rank", F.row_number().over(own.orderBy("seen", "offset")))
        .filter(F.col("rank") <= anchors)
        .withColumn("n", F.count("*").over(own))
        .select("window", "term", "offset", "rank", "n")
    )


def near_anchored(places: DataFrame, share: int) -> DataFrame:
    """Rows (window, term, offset, need): rarest terms, one of which any proximity match has, and its words."""
    own = Window.partitionBy("window")
    return (
        places.withColumn("size", F.count("*").over(own))
        .withColumn("need", F.expr(f"greatest(1, (size * {int(share)} + 99) div 100)"))
        .withColumn("missing", F.col("size") - F.col("need"))
        .withColumn("rank", F.row_number().over(own.orderBy(F.col("seen").asc_nulls_first(), "offset")))
        .filter("rank <= missing + 1 and seen is not null")
        .select("window", "term", "offset", F.col("need").cast("int").alias("need"))
    )


def hashed(words: Column) -> Column:
    """64 bits for each word: what stands around postings is compared as numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def segments_of(benchmark: DataFrame, windows: DataFrame, loose: DataFrame, size: int) -> DataFrame:
    """Rows (term, segment, least, windows): the words around an anchor in an item, and the windows it anchors.

    `least` is the number of different words that any of these windows' matches share with the segment.
    """
    anchored_ = loose.join(windows.select("window", "phrase", hashed(F.col("terms")).alias("terms")), "window")
    items = item_windows(benchmark, size).select("item", "at", "phrase", hashed(F.col("words")).alias("words"))
    met = items.join(anchored_, "phrase").withColumn("place", F.col("at") + F.col("offset"))
    least = F.col("need") - F.size("terms") + F.size(F.array_distinct("terms"))
    around = F.array_distinct(F.slice("words", F.greatest(F.col("place") - F.lit(size - 1), F.lit(1)), F.least(F.col("place"), F.lit(size)) + F.lit(size - 1)))
    each = met.groupBy("item", "place", "term").agg(
        F.first(around).alias("segment"),
        F.min(least).alias("least"),
        F.sort_array(F.collect_set(F.struct("window", "offset", "need", "terms"))).alias("windows"),
    )
    return each.select("term", "segment", "least", "windows").distinct()


def shifted_postings(postings: DataFrame, anchors: DataFrame, rows: int) -> DataFrame:
    """Postings, dealt by document, as starts of the windows that their terms anchor."""
    return postings.join(broadcast_if_small(anchors, rows), "term_id").select(
        "k1", "k2", "window", "n", "rank", (F.col("position") - F.col("offset")).alias("start")
    )


def anchors_met() -> Column:
    """The number of a group's anchors; repeated rows count once."""
    return F.bit_count(F.bit_or(F.expr("shiftleft(1L, rank)")))


def candidates(shifted: DataFrame) -> DataFrame:
    """Starts on which all anchors of a window agree."""
    return (
        shifted.filter("start >= 0")
        .groupBy("k1", "k2", "window", "start")
        .agg(anchors_met().alias("met"), F.first("n").alias("n"))
        .filter("met = n")
        .select("k1", "k2", "window", "start")
    )


def near_windows(docs: DataFrame, dealt: DataFrame, segments: DataFrame, size: int, slop: int, rows: int) -> DataFrame:
    """Rows (k1, k2, window) of all proximity matches.

    `dealt` has postings by document, `segments` rows (term_id, segment, least, windows).
    """
    wanted = broadcast_if_small(segments.select("term_id").distinct(), rows)
    places = dealt.join(wanted, "term_id", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("term_id", "position")).alias("places"))
    texts = docs.select(*(c.alias(k) for k, c in hashes().items()), "text")
    both = texts.join(places, ["k1", "k2"]).withColumn("words", settled(hashed(words_of(F.col("text")))))
    reach = size + slop

    def context(p: Column) -> Column:
        first = F.greatest(p["position"] - F.lit(reach), F.lit(0))
        around = F.slice("words", first + 1, p["position"] + F.lit(reach + 1) - first)
        return F.struct(p["term_id"].alias("term_id"), p["position"].alias("position"), first.alias("first"), around.alias("around"))

    postings = both.select("k1", "k2", F.explode(F.transform("places", context)).alias("p")).select("k1", "k2", "p.*")
    met = postings.join(broadcast_if_small(segments, rows), "term_id")
    met = met.filter(F.size(F.array_intersect("around", "segment")) >= F.col("least"))
    # The words in which a match with this anchor lies: before the text's first word they are 0.
    base = F.col("position") - F.col("w.offset") - F.lit(slop)
    begin = F.greatest(base, F.col("first"))
    length = base + F.size("w.terms") + F.lit(2 * slop + 1) - begin
    aligned = F.concat(F.array_repeat(F.lit(0).cast("long"), begin - base), F.slice("around", begin - F.col("first") + 1, length))
    each = met.select("k1", "k2", "position", "first", "around", F.explode("windows").alias("w"))
    c = F.struct(F.col("w.need").alias("need"), F.col("w.terms").alias("terms"), aligned.alias("around"))
    each = each.select("k1", "k2", F.col("w.window").alias("window"), settled(c).alias("c"))
    return each.filter(may_match(F.col("c"))).filter(near_match(F.col("c"), slop)).select("k1", "k2", "window").distinct()


def may_match(c: Column) -> Column:
    """As many different words as a match has, wherever they stand around a candidate."""
    return F.size(F.array_intersect(c["terms"], c["around"])) >= c["need"] - F.size(c["terms"]) + F.size(F.array_distinct(c["terms"]))


def near_match(c: Column, slop: int) -> Column:
    """As many of the window's words as a match has, with starts from some s to s + slop."""
    terms, around, last = c["terms"], c["around"], F.size(c["terms"]) - 1

    def in_window(s: Column, t: Column) -> Column:
        at = lambda j: (F.get(terms, j) == t) & F.array_contains(F.slice(around, s + j + 1, F.lit(slop + 1)), t)
        return F.size(F.filter(F.sequence(F.lit(0), last), at))

    def in_document(s: Column, t: Column) -> Column:
        def at(i: Column) -> Column:
            first = F.greatest(i - F.lit(slop), F.lit(0))
            return (F.get(around, s + i) == t) & F.array_contains(F.slice(terms, first + 1, i + 1 - first), t)

        return F.size(F.filter(F.sequence(F.lit(0), last + F.lit(slop)), at))

    def total(s: Column) -> Column:
        return F.aggregate(F.array_distinct(terms), F.lit(0), lambda n, t: n + F.least(in_window(s, t), in_document(s, t)))

    return F.exists(F.sequence(F.lit(0), F.lit(slop + 1)), lambda s: total(s) >= c["need"])


def found(docs: DataFrame, benchmark: DataFrame, size: int, anchors: int, slop: int | None, rows: int, share: int = SHARE) -> DataFrame:
    """Rows (k1, k2, spans, near): a document's candidates for exact matches, and the items near to it; stored tables."""
    tables = Tables(docs.sparkSession, "positional-index")
    windows = tables.stored(windows_of(benchmark, size).withColumn("window", F.monotonically_increasing_id()))
    places = counted(windows, docs, rows)
    if slop is not None:
        places = tables.stored(places)
        loose = tables.stored(near_anchored(places, share))
    chosen = tables.stored(anchored(places, anchors))
    if slop is not None:
        tables.drop(places)
    wanted = chosen.select("term") if slop is None else chosen.select("term").union(loose.select("term"))
    terms = tables.stored(wanted.distinct().withColumn("term_id", F.monotonically_increasing_id()))
    postings = tables.stored(exploded(docs).join(broadcast_if_small(terms, rows), "term").select("k1", "k2", "term_id", "position"))
    dealt = postings.repartition("k1", "k2")
    placed = chosen.join(broadcast_if_small(terms, rows), "term").select("window", "term_id", "offset", "rank", "n")
    span = F.struct("start", "size", "phrase", "items")
    spans = candidates(shifted_postings(dealt, placed, rows)).join(broadcast_if_small(windows.drop("terms"), rows), "window")
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(span).alias("spans"))
    if slop is None:
        return spans.withColumn("near", F.lit(None).cast("array<string>"))
    segments = segments_of(benchmark, windows, loose, size).join(broadcast_if_small(terms, rows), "term").drop("term")
    near = near_windows(docs, dealt, tables.stored(segments), size, slop, rows)
    near = near.join(broadcast_if_small(windows.select("window", "items"), rows), "window")
    near = near.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("near"))
    return spans.join(near, ["k1", "k2"], "full")


def matched(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the words, the verified spans and the items to rows of (k1, k2, text, ...)."""
    both = rows.join(hits, ["k1", "k2"], "left").withColumn("words", settled(words_of(F.col("text"))))
    n = F.size("words").cast("long")
    true = F.filter("spans", lambda s: F.array_join(F.slice("words", s["start"] + 1, s["size"]), " ") == s["phrase"])
    both = both.withColumns({"n_words": n, "spans": settled(F.sort_array(true))})
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["start"] + s["size"]).alias("to"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["to"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    return both.withColumns(
        {
            "n_hit": settled(F.coalesce(covered, F.lit(0)).cast("long")),
            "items": F.coalesce(items, F.array().cast("array<string>")),
            "near_items": F.coalesce(F.array_sort("near"), F.array().cast("array<string>")),
        }
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, anchors: int = ANCHORS, slop: int | None = SLOP, rows: int = BROADCAST_ROWS, share: int = SHARE) -> DataFrame:
    """Per document: n_words, n_hit, spans (start, size, phrase, items), items and near_items."""
    docs = docs.select("doc_id", "text")
    hits = found(docs, benchmark, size, anchors, slop, rows, share)
    rows_ = docs.select("doc_id", "text", *(c.alias(k) for k, c in hashes().items()))
    return matched(rows_, hits).select("doc_id", "n_words", "n_hit", "spans", "items", "near_items")


def digest(report: DataFrame, *lists: str) -> DataFrame:
    """The report with counts and a hash for its lists; those named are added as text."""
    return report.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        *(F.array_join(name, ",").alias(name) for name in lists),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, anchors: int = ANCHORS, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents without any word inside a window of the benchmark, with all their columns."""
    hits = found(docs.select("doc_id", "text"), benchmark, size, anchors, None, rows)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", *(c.alias(k) for k, c in hashes().items()))
    return matched(keyed, hits).filter("n_hit = 0").select("row.*")
