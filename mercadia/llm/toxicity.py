"""Toxicity scores by weak supervision: many voters, a label model, a linear classifier.

1. Voters. Lexicons and patterns vote for or against, or abstain: a short list of insults, and
   words and word beginnings that labelled toxic documents hold far more often than clean ones,
   dealt to several lexicons by kind and by hash.
2. Label model. Expectation maximisation estimates each voter's rates of voting for and against on
   toxic and on clean documents, starting from the labelled rows. Voters that still agree given the
   class are correlated: the strongest such links form a tree, and a voter's rates are estimated for
   each vote of the one it depends on, so a cluster of voters doesn't count many times. Where a row
   has a label that may be learnt, the annotator is one more voter, whose accuracy is estimated like
   the others'.
3. Classifier. Logistic regression learns the posterior labels from counts of words and word
   beginnings, over the square root of the text's length. It scores each whole text alone.

Learning reads about LABELLED_ROWS labelled rows and UNLABELLED_ROWS others, drawn by the hash of
doc_id among rows whose crc32(doc_id as text) is no multiple of 5; labels of other rows are never
read. Repeated ids are one row of the sample, the one of the least text hash. Scoring reads all
rows. Labels, lang, source and doc_id are no inputs of a score.

A null text is an empty one; empty texts get the prior's score; very long texts are read whole.
Repeated labels of a document count as toxic if any is. Rows with null ids are scored and never learnt from. Without labels the list
of insults votes alone. Repeated rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm.shared import Tables, learning_row, prepared

#: Learnable labels, and documents without a label, that are learnt from.
LABELLED_ROWS, UNLABELLED_ROWS = 20_000, 10_000
#: Features that the classifier may have, and candidates for them.
MOST_FEATURES, MOST_CANDIDATES = 5_000, 100_000
LEAST_TOXIC, LEAST_Z, LEAST_LOG_ODDS = 4, 3.5, 1.0
BEGINNINGS = (3, 4, 5, 6, 7)
LEXICONS = 4
VOTE_PRECISION = 0.9
PRIOR = 0.1
#: Twice the log likelihood that a correlation must add: beyond chance for eight further parameters.
LEAST_G = 30.0

#: Insults that need no labels to be known.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown "
    "vermin filthy imbecile imbécile crétin abruti ordure dummkopf abschaum trottel versager blödmann widerlich estúpido "
    "imbécil basura asqueroso"
)
WORDS = r"[^\W\d_]+"


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def counted_words(text: str | None) -> Counter:
    return Counter(re.findall(WORDS, (text or "").lower()))


class Voter(NamedTuple):
    """Votes for toxic where its features are dense enough, against where it has none, else abstains."""

    name: str
    features: frozenset
    least: float = 0.0


def lexicons(mined: Sequence[str]) -> list[Voter]:
    """One voter for each lexicon or pattern."""
    lists = {"insults": set(INSULTS.split()), "words": {f for f in mined if f[0] != "^"}}
    for k in BEGINNINGS:
        lists[f"beginnings of {k}"] = {f for f in mined if f[0] == "^" and len(f) == k + 1}
    for k in range(LEXICONS):
        lists[f"lexicon {k}"] = {f for f in mined if zlib.crc32(f.encode()) % LEXICONS == k}
    return [Voter(name, frozenset(own)) for name, own in lists.items() if own]


def densities(hits: Sequence[Mapping[str, int]], sizes: Sequence[int], voters: Sequence[Voter]) -> np.ndarray:
    """Hits of each voter in each document, over the scale of the document's length."""
    found = [[sum(k for f, k in own.items() if f in v.features) / scale(n) for v in voters] for own, n in zip(hits, sizes)]
    return np.array(found, float).reshape(len(hits), len(voters))


def with_thresholds(voters: Sequence[Voter], dense: np.ndarray, known: np.ndarray) -> list[Voter]:
    """The least density from which on labelled documents are toxic with VOTE_PRECISION."""
    found = []
    for j, voter in enumerate(voters):
        own, least = dense[~np.isnan(known), j], 0.0
        truth = known[~np.isnan(known)][own > 0]
        own = own[own > 0]
        if len(own):
            order = np.argsort(-own, kind="stable")
            share = np.cumsum(truth[order]) / np.arange(1, len(own) + 1)
            good = np.flatnonzero(share >= VOTE_PRECISION)
            least = float(own[order][good[-1]]) if len(good) else np.inf
        found.append(voter._replace(least=least))
    return found


def votes(dense: np.ndarray, voters: Sequence[Voter]) -> np.ndarray:
    """1 for toxic, 0 against, -1 for abstaining."""
    least = np.array([v.least for v in voters])
    return np.where(dense == 0, 0, np.where(dense >= least, 1, -1))


class LabelModel:
    """A generative model of the votes: accuracies and correlations of voters, estimated without truth.

    Given the class, a voter's vote depends on the vote of one other voter, its parent, or on none:
    the tree of the strongest correlations that chance does not explain. `tables[j][c, u, v]` is the
    chance that voter j casts v - 1 on class c where its parent casts u - 1; `rates[c, v, j]` is the
    same without regard to the parent, so rates are accuracies and tables are correlations. A copy of
    another voter adds nothing, whatever its accuracy.
    """

    def __init__(self, rounds: int = 50):
        self.rounds = rounds

    def fit(self, cast: np.ndarray, known: np.ndarray) -> LabelModel:
        """`cast`: votes, a row per document; `known`: 1, 0, or NaN where there is no label."""
        belief = np.where(np.isnan(known), np.nan, known)
        labelled = ~np.isnan(known)
        annotator = np.where(labelled, np.nan_to_num(known), -1).astype(np.int64)
        cast = np.column_stack((cast, annotator))
        any_vote = (cast == 1).any(axis=1) if cast.size else np.zeros(len(cast), bool)
        if not labelled.any():
            belief = np.where(any_vote, 0.9, 0.05)
        known_rows = ~np.isnan(belief)
        self.parents = self._tree(cast[known_rows], belief[known_rows])
        self._estimate(cast[known_rows], belief[known_rows])
        for turn in range(self.rounds):
            belief = self.posterior(cast)
            if turn == self.rounds // 2:
                self.parents = self._tree(cast, belief)
            self._estimate(cast, belief)
        self.belief = self.posterior(cast)
        return self

    def _estimate(self, cast: np.ndarray, belief: np.ndarray) -> None:
        """Prior, rates and tables that the beliefs make likeliest; a rare case leans on the rates."""
        mass = np.array([(1 - belief).sum(), belief.sum()])
        self.prior = (mass[1] + 2 * PRIOR) / (mass.sum() + 2)
        rates = np.empty((2, 3, cast.shape[1]))
        for c, weight in enumerate((1 - belief, belief)):
            for v in range(3):
                rates[c, v] = (weight[:, None] * (cast == v - 1)).sum(axis=0) + 0.5
        self.rates = rates / rates.sum(axis=1, keepdims=True)
        self.tables = []
        for j, parent in enumerate(self.parents):
            counts = self._joint(cast, belief, j, parent)[0] + 2 * self.rates[:, None, :, j]
            self.tables.append(counts / counts.sum(axis=2, keepdims=True))

    def _joint(self, cast: np.ndarray, belief: np.ndarray, j: int, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts by class, the parent's vote and voter j's vote; and the parent's vote of each row."""
        given = cast[:, parent] + 1 if parent >= 0 else np.zeros(len(cast), np.int64)
        cell = given * 3 + cast[:, j] + 1
        counts = [np.bincount(cell, weight, minlength=9).reshape(3, 3) for weight in (1 - belief, belief)]
        return np.array(counts), given

    def _tree(self, cast: np.ndarray, belief: np.ndarray) -> list[int]:
        """Parents by the greatest conditional mutual information that chance does not explain; -1 for none.

        The annotator, who is the last voter, depends on the class alone.
        """
        k = cast.shape[1]
        strength = np.zeros((k, k))
        for i in range(k - 1):
            for j in range(i):
                for table in self._joint(cast, belief, i, j)[0]:
                    total = table.sum()
                    chance = np.outer(table.sum(axis=1), table.sum(axis=0)) / max(total, 1e-9)
                    strength[i, j] += (table * np.log(np.where(table > 0, table, 1) / np.where(table > 0, chance, 1))).sum()
        strength = 2 * np.maximum(strength, strength.T)
        parents, inside = [-1] * k, []
        while len(inside) < k:
            outside = [j for j in range(k) if j not in inside]
            best = max(((strength[j, i], -j, -i) for j in outside for i in inside), default=(0.0, 0, 0))
            if best[0] > LEAST_G:
                j = -best[1]
                parents[j] = -best[2]
            else:
                j = outside[0]
            inside.append(j)
        return parents

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        score = np.full(len(cast), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parents):
            given = cast[:, parent] + 1 if parent >= 0 else 0
            ratio = np.log(self.tables[j][1]) - np.log(self.tables[j][0])
            score += ratio[given, cast[:, j] + 1]
        return 1 / (1 + np.exp(-score))


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, n_features: int, rounds: int = 500):
    """Weights and bias of a logistic regression on sparse features, for soft labels, by Adam."""
    mean = float(np.clip(target.mean() if len(target) else PRIOR, 1e-3, 1 - 1e-3))
    weights, bias, n = np.zeros(n_features), float(np.log(mean / (1 - mean))), max(len(target), 1)
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for turn in range(1, rounds + 1):
        score = bias + np.bincount(rows, values * weights[columns], minlength=len(target))
        wrong = 1 / (1 + np.exp(-score)) - target
        slope = np.append(np.bincount(columns, values * wrong[rows], minlength=n_features) / n + 1e-4 * weights, wrong.sum() / n)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        step = 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def part_of(most: int, total: int) -> Column:
    """About `most` of `total` ids, drawn by their hash."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, most / max(total, 1)) * (1 << 30))


def sampled(docs: DataFrame, labels: DataFrame, most_labelled: int, most_unlabelled: int) -> DataFrame:
    """Rows (text, toxic) that may be learnt from; toxic is null without a label.

    About `most_labelled` of the learnable labels are drawn, however few documents have one, and about
    `most_unlabelled` of the other documents. An id is one row, however often it is repeated.
    """
    known = labels.filter(learning_row()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    may = docs.select("doc_id", "text").filter(learning_row())
    drawn = known.filter(part_of(most_labelled, known.count()))
    others = may.filter(part_of(most_unlabelled, may.select(F.count("*")).first()[0])).join(known, "doc_id", "left_anti")
    rows = may.join(drawn, "doc_id").unionByName(others.withColumn("toxic", F.lit(None).cast(known.schema["toxic"].dataType)))
    single = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return single.select("text", "toxic")


def feature_counts(rows: DataFrame, among: frozenset | None) -> DataFrame:
    """Rows (feature, toxic, n): labelled documents that hold each feature, folded per task."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {f for w in counted_words(text) for f in features_of(w)}
                seen[toxic].update(own if among is None else own & among)
        for toxic, found in enumerate(seen):
            if found:
                yield pa.record_batch(
                    [pa.array(list(found)), pa.array([toxic] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                    ["feature", "toxic", "n"],
                )

    part = rows.filter("toxic in (0, 1)").select("text", "toxic").mapInArrow(counts, "feature string, toxic int, n long")
    return part.groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def mine(rows: DataFrame) -> list[str]:
    """Features that toxic documents hold far more often than clean ones."""
    of_class = {r["toxic"]: r["n"] for r in rows.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = of_class.get(1, 0), of_class.get(0, 0)
    if not toxic or not clean:
        return []
    often = feature_counts(rows.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_TOXIC)
    often = often.orderBy(F.desc("n"), "feature").limit(MOST_CANDIDATES)
    held = {r["feature"]: r["n"] for r in often.collect()}
    against = {r["feature"]: r["n"] for r in feature_counts(rows.filter("toxic = 0"), frozenset(held)).collect()}
    found = []
    for feature, a in held.items():
        b = against.get(feature, 0)
        odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds >= LEAST_LOG_ODDS and z >= LEAST_Z:
            found.append((float(-z), feature))
    return [feature for _, feature in sorted(found)[:MOST_FEATURES]]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    label_model: LabelModel
    voters: list[Voter]


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit voters, label model and classifier on the sample; only counts of features leave Spark."""
    tables = Tables(prepared(docs.sparkSession), "toxicity")
    rows = tables.stored(sampled(docs, labels, labelled_rows, unlabelled_rows))
    mined = mine(rows)
    names = sorted({*mined, *INSULTS.split()})
    wanted = frozenset(names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, hits = counted_words(text), Counter()
                for word, n in words.items():
                    for f in features_of(word):
                        if f in wanted:
                            hits[f] += n
                out.append((list(hits), list(hits.values()), sum(words.values()), toxic))
            hit, n, size, toxic = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch(
                [pa.array(hit, pa.list_(pa.string())), pa.array(n, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(toxic, pa.int32())],
                ["hit", "n", "size", "toxic"],
            )

    # Bounded by the sample: a few hits for each of its rows.
    sample = rows.mapInArrow(found, "hit array<string>, n array<long>, size long, toxic int").toArrow().to_pylist()
    tables.drop(rows)
    known = np.array([np.nan if r["toxic"] is None else float(r["toxic"] > 0) for r in sample])
    voters = lexicons(mined)
    dense = densities([dict(zip(r["hit"], r["n"])) for r in sample], [r["size"] for r in sample], voters)
    voters = with_thresholds(voters, dense, known)
    label_model = LabelModel().fit(votes(dense, voters), known)
    place = {f: k for k, f in enumerate(names)}
    at = [(i, place[f], n / scale(r["size"])) for i, r in enumerate(sample) for f, n in zip(r["hit"], r["n"])]
    row, column, value = (np.array(c) for c in zip(*at)) if at else (np.empty(0, int), np.empty(0, int), np.empty(0))
    weights, bias = fit_linear(row, column, value, label_model.belief, len(names))
    return Model({f: float(w) for f, w in zip(names, weights) if w}, bias, label_model, voters)


def scale(n_words: int) -> float:
    return max(n_words / 100, 0.01) ** 0.5


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of all documents."""
    weights, bias = model.weights, model.bias

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(WORDS).findall, {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                words = find((text or "").lower())
                total = 0.0
                for word in words:
                    value = known.get(word)
                    if value is None:
                        value = known[word] = sum(weights.get(f, 0.0) for f in features_of(word))
                    total += value
                scores.append(1 / (1 + np.exp(-(bias + total / scale(len(words))))))
                if len(known) > 500_000:
                    known.clear()
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> DataFrame:
    """Per document: held_out, score and predicted."""
    found = scored(docs, train(docs, labels, labelled_rows, unlabelled_rows))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
