"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A logistic regression on shares and ratios of a text, learnt from labelled rows, gives each document
its evidence p. Sums of p are grouped by path within host; hosts add up from paths. The spread of
host means around the global mean, beyond what chance gives, sets how many documents a host needs
before its own mean counts as much as the global prior; the spread of path means around their hosts
does the same one level below. So sparse sites shrink toward their parent. A document's prior is
its path's posterior mean without the document itself, and its score joins prior and evidence as
odds. The verdict keeps scores from KEEP on.

Learning reads about SAMPLE_ROWS labelled rows, drawn by the hash of doc_id among rows whose
crc32(doc_id as text) is no multiple of 5. Group sums read all rows, fold per task first, and are
one row per site; they are broadcast if few and joined by a shuffle that Spark splits otherwise.

Null hosts or paths count as the empty name, a site like any other. A null text is an empty one.
Without labels every document's evidence is the same and all are kept. Several labels of a document
count as their least. Repeated rows get equal scores; null ids are scored and never learnt from; an
empty table gives no rows; `kept_documents` returns further columns untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercadia.llm.shared import Tables, broadcast_if_small, learning_row, prepared

SAMPLE_ROWS, KEEP = 20_000, 0.5
BROADCAST_ROWS = 200_000

FEATURES = (
    "log_words", "log_word_length", "symbols", "exclamations", "bars", "capitals", "digits", "others", "letters",
    "same_as_before", "distinct", "distinct_lines", "short",
)


def byte_classes() -> np.ndarray:
    """The class of each byte: 0 none, 1 symbols, 2 !, 3 |, 4 capitals, 5 small, 6 digits, 7 other scripts."""
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in "#*$%&<>~^=+_{}[]\\/@"]] = 1
    table[ord("!")], table[ord("|")] = 2, 3
    table[ord("A") : ord("Z") + 1], table[ord("a") : ord("z") + 1], table[ord("0") : ord("9") + 1] = 4, 5, 6
    table[128:] = 7
    return table


def features_of(text: str | None, classes: np.ndarray) -> list[float]:
    """Measures of a whole text; all are finite, also for an empty one."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(classes[data], minlength=8) if len(data) else np.zeros(8)
    letters, chars = max(count[4] + count[5], 1), max(len(data), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(words)), np.log1p(count[1:].sum() / n), min(count[1] / n, 3), min(count[2] / n, 3), min(count[3] / n, 2),
        count[4] / letters, count[6] / chars, count[7] / chars, (count[4] + count[5] + count[7]) / chars,
        same / n, len(set(words)) / n, len(set(lines)) / max(len(lines), 1), float(len(words) < 5),
    ]


class Classifier(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, features: np.ndarray) -> np.ndarray:
        score = (features - self.centre) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(score, -12, 12)))


def fit(features: np.ndarray, good: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> Classifier:
    """Logistic regression by Newton's method, with a ridge."""
    n = features.shape[1]
    if len(set(good.tolist())) < 2:
        return Classifier(np.zeros(n), np.ones(n), np.zeros(n), 4.0 if not len(good) or good[0] else -4.0)
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack(((features - centre) / scale, np.ones(len(good))))
    w = np.zeros(n + 1)
    penalty = ridge * len(good) * np.append(np.full(n, 1.0), 0) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - good) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return Classifier(centre, scale, w[:-1], float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Rows (text, quality) of about `sample_rows` learnable labels; an id is one row, however often it is repeated."""
    labels = labels.filter(learning_row()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality is not null")
    total = labels.count()
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 30))
    met = docs.select("doc_id", "text").filter(part).join(broadcast_if_small(labels.filter(part), 2 * sample_rows), "doc_id")
    single = met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))
    return single.select("text", "quality")


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit the classifier on the bounded sample of labelled rows."""
    sample = sampled(docs, labels, sample_rows)
    classes = byte_classes()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t, classes) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "quality"])

    prepared(docs.sparkSession)
    rows = sample.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(measure, "x array<double>, quality int")
    rows = rows.toArrow().to_pylist()  # no more than the sample's rows
    features = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(features, np.array([float(r["quality"] > 0) for r in rows]))


def with_evidence(rows: DataFrame, model: Classifier) -> DataFrame:
    """Replace the column text by the evidence p."""
    classes, others = byte_classes(), [c for c in rows.columns if c != "text"]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField("p", T.DoubleType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features_of(t, classes) for t in texts], float).reshape(len(texts), len(FEATURES))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.record_batch([*columns, pa.array(model.evidence(x), pa.float64())], [*others, "p"])

    prepared(rows.sparkSession)
    return rows.select(*others, "text").mapInArrow(of, schema)


def sites(evidence: DataFrame) -> DataFrame:
    """Rows (host, path, n, total, host_n, host_total): sums of p by path and by host."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    return paths.join(hosts, "host")


class Priors(NamedTuple):
    mean: float
    host_weight: float
    path_weight: float


def priors(site: DataFrame) -> Priors:
    """Global mean and the numbers of documents that a parent's mean weighs, by moments."""
    n, total = site.agg(F.sum("n"), F.sum("total")).first()
    if not n:
        return Priors(0.5, 1.0, 1.0)
    mean = min(max(total / n, 1e-6), 1 - 1e-6)
    hosts = site.select("host", "host_n", "host_total").distinct()

    def weight(groups: DataFrame, size: str, own: Column, parent: Column | float) -> float:
        off = groups.agg(F.sum(F.col(size) * (own - parent) ** 2), F.count("*"), F.sum(size), F.sum(F.col(size) ** 2)).first()
        spread, k, rows, squares = (float(v or 0) for v in off)
        chance = mean * (1 - mean)
        # n-weighted squared deviations hold k times the chance variance plus the true spread.
        true = (spread - k * chance) / max(rows, 1.0)
        return min(max(chance / max(true, 1e-12) - 1, 1.0), 1e9)

    host_mean, path_mean = F.col("host_total") / F.col("host_n"), F.col("total") / F.col("n")
    return Priors(mean, weight(hosts, "host_n", host_mean, mean), weight(site, "n", path_mean, host_mean))


def judged(evidence: DataFrame, site: DataFrame, prior: Priors, keep: float) -> DataFrame:
    """Add the posterior means without the row itself, the score and the verdict."""
    p = F.col("p")
    of_host = (F.col("host_total") - p + prior.host_weight * prior.mean) / (F.col("host_n") - 1 + prior.host_weight)
    of_path = (F.col("total") - p + prior.path_weight * F.col("host_prior")) / (F.col("n") - 1 + prior.path_weight)

    def odds(x: Column) -> Column:
        x = F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.log(x / (1 - x))

    score = odds(p) + odds(F.col("site_prior")) - odds(F.lit(prior.mean))
    return (
        evidence.join(broadcast_if_small(site, BROADCAST_ROWS), ["host", "path"])
        .withColumn("host_prior", of_host)
        .withColumn("site_prior", of_path)
        .withColumn("score", 1 / (1 + F.exp(-score)))
        .withColumn("kept", F.col("score") >= keep)
    )


def sited(docs: DataFrame, row: Column, host: Column, path: Column) -> DataFrame:
    empty = F.lit("")
    return docs.select(row.alias("row"), F.coalesce(host, empty).alias("host"), F.coalesce(path, empty).alias("path"), "text")


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, host, path, evidence, host_prior, site_prior, score, kept."""
    tables = Tables(docs.sparkSession, "site-quality")
    model = learnt(docs, labels, sample_rows)
    found = tables.stored(with_evidence(sited(docs, F.struct("doc_id"), F.col(host), F.col(path)), model))
    site = tables.stored(sites(found))
    rows = judged(found, site, priors(site), keep)
    return rows.select("row.doc_id", "host", "path", F.col("p").alias("evidence"), "host_prior", "site_prior", "score", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents that pass, with all their columns."""
    tables = Tables(docs.sparkSession, "site-quality")
    model = learnt(docs, labels, sample_rows)
    grouped = with_evidence(sited(docs, F.lit(0), F.col(host), F.col(path)), model)
    site = tables.stored(sites(grouped))
    rows = with_evidence(sited(docs, F.struct(*docs.columns), F.col(host), F.col(path)), model)
    return judged(rows, site, priors(site), keep).filter("kept").select("row.*")
