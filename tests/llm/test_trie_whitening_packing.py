"""Prefix trie, whitening and vector packing against brute force, and on edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercadia.llm import prefix_trie, vector_packing, whitening
from mercadia.llm.queries import tokenizer_file
from mercadia.llm.shared import Tables
from mercadia.llm.word_tokens import WordEncoder
from tests.conftest import SMALL

TURNS = "conv_id long, turn long, role string, text string, extra string, depth int"


# --- prefix trie ----------------------------------------------------------------------


def brute_trie(rows: list[tuple], rebuild: bool = True) -> list[tuple]:
    own: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(
        (r for r in rows if r[0] is not None),
        key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()),
    ):
        own[conv].append((role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        convs[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(of),
            len(node),
            min(members[node[:-1]]) if node else -1,
            len(of),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, of in members.items()
    )


def spark_trie(frame, rebuild: bool = True) -> list[tuple]:
    nodes = prefix_trie.prefix_trie(frame, rebuild).drop("key")
    assert nodes.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert {kind for name, kind in nodes.dtypes if name != "ends_sha256"} == {"bigint"}
    return sorted(tuple(-1 if v is None else v for v in row) for row in nodes.collect())


def test_trie_of_edge_rows(spark):
    long_ = "ß" * 200_000
    rows = [
        (0, 0, "user", "a", "x", 1), (0, 1, "bot", "b", "x", 1), (0, 2, "user", "c", "x", 1),
        (7, 0, "user", "a", "x", 1), (7, 1, "bot", "b", "x", 1), (7, 2, "user", "c", "x", 1),
        (7, 3, "bot", None, "x", 1), (7, 4, None, long_, "x", 1), (7, 5, None, None, "x", 1), (7, 6, "bot", "z", "x", 1),
        (8, 5, "user", "a", "x", 1), (8, None, "user", "first", "x", 1), (8, 5, "bot", "tie", "x", 1),
        (8, 5, "bot", "tie", "x", 1), (8, 5, "bot", "another", "x", 1), (8, 6, "u", "v", "x", 1), (8, 9, "ab", "c", "x", 1),
        (9, 6, "a", "bc", "x", 1), (105, 0, "user", "lone", "x", 1), (211, 0, "user", "lone", "x", 1),
        (None, 0, "user", "nobody", "x", 1), (-3, 0, "user", "below", "x", 1), (-3, 1, "user", "zero", "x", 1), (-3, 2, "u", "v", "x", 1),
        *((c, t, "u", "same", "x", 1) for c in range(300, 340) for t in range(9)),
    ]
    frame = spark.createDataFrame(rows, TURNS)
    assert spark_trie(frame) == brute_trie(rows)
    assert spark_trie(frame, rebuild=False) == brute_trie(rows, rebuild=False)
    assert spark_trie(frame.limit(0)) == []


def test_deep_trie_crosses_blocks_and_bands(spark):
    """Long conversations that part at drawn depths: several blocks of turns, several levels of bands."""
    draw, rows = random.Random(5), []
    for c in range(30):
        parting = draw.randrange(0, 160)
        for t in range(draw.choice([1, 7, 8, 9, 63, 64, 65, 128, 150])):
            rows.append((c, t, "u", f"turn {t}" if t < parting else f"turn {t} of {c % 4}", "x", 1))
    assert spark_trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_node_texts(spark):
    rows = [(1, 0, "user", "hello", "x", 1), (1, 1, "bot", "there", "x", 1), (2, 0, "user", "hello", "x", 1)]
    frame = spark.createDataFrame(rows, TURNS)
    found = prefix_trie.node_texts(frame, prefix_trie.prefix_trie(frame, rebuild=False))
    assert sorted((r.depth, r.role or "", r.text or "", r.n_convs) for r in found.collect()) == [
        (0, "", "", 2), (1, "user", "hello", 2), (2, "bot", "there", 1)
    ]


def test_trie_of_the_sample_is_that_of_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert spark_trie(table) == brute_trie(rows)


# --- whitening ------------------------------------------------------------------------


def spectrum_of(x: np.ndarray, rank: int | None = None) -> whitening.Spectrum:
    found = whitening.Spectrum.empty(x.shape[1])
    for row in x:
        found.add_vector(row, 1, rank or x.shape[1])
    return found


def scatter(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


CLOUDS = {
    "full": lambda r: r.normal(size=(300, 12)) * 8 + 3,
    "integers with ties": lambda r: r.integers(-2, 3, size=(400, 5)).astype(float),
    "copies": lambda r: np.repeat(np.floor(r.normal(size=(20, 9)) * 8), 15, axis=0),
    "corners": lambda r: np.eye(7)[r.integers(0, 7, size=200)],
    "low rank": lambda r: r.normal(size=(200, 3)) @ r.normal(size=(3, 10)),
    "one point": lambda r: np.ones((10, 4)),
    "far apart scales": lambda r: r.normal(size=(200, 6)) * 10.0 ** -np.arange(6),
}


@pytest.mark.parametrize("name", CLOUDS)
def test_rank_one_updates_give_the_spectrum(name):
    x = CLOUDS[name](np.random.default_rng(3))
    found, right = spectrum_of(x), scatter(x)
    scale = max(1.0, np.abs(right).max())
    assert np.abs(found.basis @ np.diag(found.values) @ found.basis.T - right).max() < 1e-11 * scale
    assert np.abs(found.basis.T @ found.basis - np.eye(found.basis.shape[1])).max(initial=0) < 1e-12
    assert (np.diff(found.values) >= 0).all()
    assert np.allclose(found.mean, x.mean(axis=0))


@pytest.mark.parametrize("cut", [0, 1, 100, 299])
def test_spectra_combine(cut):
    x = CLOUDS["full"](np.random.default_rng(4))
    left, right = spectrum_of(x[:cut]), spectrum_of(x[cut:])
    left.add_spectrum(whitening.Spectrum.from_bytes(right.to_bytes()), 12)
    assert left.n == len(x) and np.allclose(left.mean, x.mean(axis=0))
    assert np.abs(left.basis @ np.diag(left.values) @ left.basis.T - scatter(x)).max() < 1e-10 * np.abs(scatter(x)).max()


def brute_whitening(vectors: list[list[float]]):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (x * n - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(int(a) ** 2 for a in row) for row in x * n - sums], e, v, c


def check_whitening(found, fit, error, vectors):
    n, deviation, e, v, c = brute_whitening(vectors)
    rows = whitening.by_component(found, fit, error).collect()
    kept = min(32, int((e > 1e-12 * e.sum()).sum()))
    assert len(rows) == n * kept and {r.n for r in rows} == {n} and error < 1e-9
    assert Counter(r.deviation for r in rows if r.component == 1) == Counter(deviation)
    by_vector = defaultdict(dict)
    for r in rows:
        by_vector[r.vec_id][r.component] = r.whitened
        assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9
    right = c @ v[:, :kept] / np.sqrt(e[:kept])
    got = np.array([[by_vector[k][j + 1] for j in range(kept)] for k in range(n)])
    apart = np.minimum(np.abs(got - right).max(axis=0), np.abs(got + right).max(axis=0))
    assert apart.max() < 1e-7


def test_whitening_of_the_sample(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(5)
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    check_whitening(*whitening.whitened(table), vectors)


def test_whitening_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(6)
    good = [[float(np.float32(a)) for a in row] for row in draw.normal(size=(40, 3))] + [[0.5, 0.25, -1.0]] * 30
    rows = [(k, v, "x", 1) for k, v in enumerate(good)]
    bad = [(900, None, "x", 1), (901, [1.0, None, 2.0], "x", 1), (902, [1.0, nan, 2.0], "x", 1), (903, [inf, 0.0, 0.0], "x", 1), (904, [-inf, 0.0, 0.0], "x", 1), (905, [], "x", 1)]
    schema = "vec_id long, embedding array<float>, vector string, component int"
    frame = spark.createDataFrame(rows + bad, schema).repartition(7)
    check_whitening(*whitening.whitened(frame), good)
    for few in ([], rows[-1:], rows[-30:]):
        assert whitening.by_component(*whitening.whitened(spark.createDataFrame(few + bad, schema))).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(spark.createDataFrame([*rows, (1, [1.0], "x", 1)], schema))


def test_whitening_with_short_spectra_refines(spark):
    """Spectra of 4 directions, refined by subspace iteration to the components of all."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(600, 10)) * (np.array([40, 25, 15] + [0.5] * 7))
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    rows = whitening.usable(frame, "embedding").select("vec_id", "vector")
    found = whitening.fit(rows, 3, 4, Tables(spark, "test"))
    n, _, e, v, _ = brute_whitening(x.tolist())
    assert found.n == n and np.allclose(found.variances, e[:3], rtol=1e-11)
    assert np.abs(np.abs((found.components * v[:, :3]).sum(axis=0)) - 1).max() < 1e-11


def test_large_deviations_are_exact_or_null():
    fit = whitening.Fit(4_000_000_000, [4_000_000_000 * 1_000_000] * 2, np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_000, 1_000_001], [1_000_000, 1_000_000], [0, 0]])
    assert fit.deviation(x) == [None if (s := 16 * 10**18) >= 1 << 63 else s, 0, None]
    assert np.allclose(fit.centred(x), [[0, 1], [0, 0], [-1e6, -1e6]])


# --- vector packing -------------------------------------------------------------------


def one_by_one(lengths: list[int], tokens: int, documents: int, cost: int, weights, rule: str) -> list[tuple[int, int, int]]:
    """Residuals of the sequences that vector best fit makes, piece after piece."""
    capacity = np.array([tokens, documents, cost])
    share, rest = np.array(weights), []
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length**2])
        able = [k for k, r in enumerate(rest) if (r >= need).all()]
        if rule == "norm":
            scores = [(share * ((rest[k] - need) / capacity) ** 2).sum() for k in able]
        else:
            scores = [-(share * (rest[k] / capacity) * (need / capacity)).sum() for k in able]
        if able:
            rest[able[int(np.argmin(scores))]] -= need
        else:
            rest.append(capacity - need)
    return sorted(map(tuple, rest))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, cost", [(1000, 100**2), (4, 100**2), (1000, 2 * 60**2), (3, 90**2)])
def test_plan_is_vector_best_fit(rule, documents, cost):
    draw = random.Random(documents + cost)
    most = int(min(100, cost**0.5))
    lengths = [draw.choice([1, 2, 3, draw.randint(1, most), draw.randint(1, most)]) for _ in range(400)]
    weights = (1.0, 0.13, 0.07)
    steps = vector_packing.plan(Counter(lengths), 100, documents, cost, weights, rule)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in steps.tolist():
        ranks[length] += range(rank, rank + n)
        for k in range(n):
            fill[sequence + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    rest = []
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        left = (100 - end, documents - len(pieces), cost - sum(length**2 for _, length in pieces))
        assert min(left) >= 0
        rest.append(left)
    assert len(rest) == len(one_by_one(lengths, 100, documents, cost, weights, rule))


def test_plan_does_not_grow_with_the_counts():
    counts = {length: 1 + length % 7 for length in range(1, 101)}
    few = vector_packing.plan(counts, 100, 100)
    many = vector_packing.plan({k: n * 10**9 for k, n in counts.items()}, 100, 100)
    assert len(many) < 20 * len(few)
    used = (many[:, 3] + many[:, 2]).max()
    assert used * 100 < 1.01 * sum(k * n * 10**9 for k, n in counts.items())
    with pytest.raises(ValueError):
        vector_packing.plan({101: 1}, 100)


TEXTS = [
    None, "", " ", "'this 'very it's İ. İstanbul. ΣΑΣ. σας, ﬁ ½ x1y2", "éa ́x a b a b　a\x1cb \x85x",
    "<|endoftext|> a<|endoftext|>, é. É! Ünï, ß. ẞ ŉ. ŀ", "a\r\nb\tc", "K Å ſ. Dž l'été, d'où? 'll're", "日本語 テスト。 한국어", "x̸ ≠ a≠",
    "same text", "same text", "word " * 9000, "x" * 30_000,
]


def test_units_give_the_tokenizers_ids(spark):
    made = WordEncoder(tokenizer_file("word_bpe_49k.json"))
    assert made.by_unit and not WordEncoder(tokenizer_file()).by_unit
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in TEXTS + texts:
        right = made.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(made.encode(text or ""), made.width).tolist() == right


def check_packing(pieces, documents: list[tuple[int | None, str | None]], end_id: int, tokens: int) -> int:
    encode = WordEncoder(tokenizer_file("word_bpe_49k.json")).tokenizer.encode
    wanted = Counter()
    for doc_id, text in documents:
        ids = [*encode(text or "", add_special_tokens=False).ids, end_id]
        for piece, start in enumerate(range(0, len(ids), tokens)):
            own = np.array(ids[start : start + tokens], "<u4")
            wanted[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    rows = pieces.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= tokens
    return len(filled)


def test_packing_of_edge_rows(spark):
    rows = [(k if k else None, text, "x", 1, 2) for k, text in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length string, rank int, task int").repartition(5)
    for tokens in (4096, 16):
        found = vector_packing.best_fit_packed(frame, tokenizer_file("word_bpe_49k.json"), 1, tokens)
        used = check_packing(found, [r[:2] for r in rows], 1, tokens)
        total = found.agg(F.sum("length")).first()[0]
        assert -(-total // tokens) <= used <= -(-total // tokens) + 1
        assert found.filter(F.length("ids") != 2 * F.col("length")).count() == 0
    assert vector_packing.best_fit_packed(frame.limit(0), tokenizer_file("word_bpe_49k.json"), 1).count() == 0


def test_packing_of_the_sample(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(6)
    documents = [(r.doc_id, r.text) for r in table.collect()]
    found = vector_packing.best_fit_packed(table, tokenizer_file("word_bpe_49k.json"), 1, with_ids=False)
    used = check_packing(found, documents, 1, 4096)
    total = found.agg(F.sum("length")).first()[0]
    assert used <= -(-total // 4096) + 1
