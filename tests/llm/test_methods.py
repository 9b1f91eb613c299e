"""Methods proved against independent computations: link graphs, slot tables, posteriors, files."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mercadia.llm import binary_records, sharding, site_quality, url_rules
from mercadia.llm.queries import tokenizer_file
from tests.conftest import SMALL

# --- redirect equivalence ---------------------------------------------------------------


class Sets(dict):
    """Union-find."""

    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.root(a)] = self.root(b)


def plain_node(url: str) -> tuple[str, str, str]:
    """Host, path and node of a URL."""
    rest = url.split("://", 1)[1].split("#")[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    kept = sorted(p for p in query.split("&") if p and not p.startswith(("utm_", "ref=")))
    host, path = host.lower(), slash + path
    node = host.removesuffix(":80").removesuffix(":443") + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")
    return host, path, node


def plain_rule(host: str, path: str) -> tuple[str, str] | None:
    fits = [
        (len(h + p), verdict == "allow", h + p, verdict)
        for h, p, verdict in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[2:] if fits else None


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_over_random_link_graphs(spark, seed):
    """Chains, stars and cycles of canonical links, refreshes and observed redirects, across sites and rules."""
    rng = random.Random(seed)
    hosts = ["a.net", "b.example.net", "example.com", "www.example.com", "x.org", "plain.info", "other.info", "deep.sub.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', ''])}/p{k}" for k in range(60)]
    urls += [u + rng.choice(["/", "#top", "?utm_source=x", "?b=2&a=1"]) for u in rng.sample(urls, 15)]
    unseen = [f"https://{rng.choice(hosts)}/fr/unseen{k}" for k in range(15)]
    sets, pages = Sets(), []
    for k, url in enumerate(urls):
        html, links = "<html><head>", []
        if rng.random() < 0.45:
            target = rng.choice(urls + unseen)
            links.append(target)
            html += rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical>"]).format(target)
        if rng.random() < 0.2:
            target = rng.choice(urls + unseen)
            links.append(target)
            html += f'<meta http-equiv="refresh" content="0; url={target}">'
        for target in links:
            sets.join(plain_node(url)[2], plain_node(target)[2])
        pages.append((k, url, html + "</head><body>text</body>"))
    moved = [(rng.choice(urls + unseen), rng.choice(urls + unseen)) for _ in range(10)] + [(None, urls[0]), (urls[1], None)]
    for a, b in moved:
        if a and b:
            sets.join(plain_node(a)[2], plain_node(b)[2])
    met = urls + [t for t in unseen if plain_node(t)[2] in sets] + [u for pair in moved for u in pair if u]
    said = {}
    for url in met:
        host, path, node = plain_node(url)
        rule = plain_rule(host, path)
        said.setdefault(sets.root(node), set()).add(rule[1] if rule else None)
    expected = {}
    for k, url, _ in pages:
        host, path, node = plain_node(url)
        rule, words = plain_rule(host, path), said[sets.root(node)]
        passed_on = "allow" if "allow" in words else "block" if "block" in words else "allow"
        expected[k] = (host, path, rule[0] if rule else None, rule[1] if rule else passed_on)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame(moved, "source string, target string")
    found = url_rules.verdicts(frame, url_rules.rule_table(frame, url_rules.RULES), redirects).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == expected
    groups = Counter(sets.root(plain_node(url)[2]) for _, url, _ in pages)
    assert sorted(Counter(r.class_root for r in found).values()) == sorted(groups.values())
    # The graph decides some verdicts that no rule does.
    assert any(v == "block" and rule is None for _, _, rule, v in expected.values())


# --- sharding ---------------------------------------------------------------------------


@pytest.mark.parametrize("shards, slots", [(["a"], 7), (["a", "b", "c"], 101), ([f"s{k}" for k in range(40)], 1009), (["x", "y"], 2)])
def test_slot_table_against_written_out_preferences(shards, slots):
    """Every shard's whole list of preferences is written out, and turns are taken over the lists."""
    lists = {
        s: [(xxhash.xxh64_intdigest(s, 1) % slots + k * (xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1)) % slots for k in range(slots)]
        for s in shards
    }
    assert all(sorted(own) == list(range(slots)) for own in lists.values())
    owner: dict[int, str] = {}
    while len(owner) < slots:
        for s in shards:
            if len(owner) < slots:
                owner[next(slot for slot in lists[s] if slot not in owner)] = s
    assert [shards[k] for k in sharding.lookup_table(shards, slots)] == [owner[k] for k in range(slots)]


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(k if k % 9 else None, f"text {k}" if k % 5 else None, "own", "s") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard_name string, slot string")
    placed = sharding.place(docs, ["one", "two", "three"], slots=101)
    sharding.write_shards(placed, f"{tmp_path}/shards")
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert stored.columns == ["doc_id", "text", "shard_name", "slot", "shard_name_"]
    assert Counter(tuple(r)[:4] for r in stored.collect()) == Counter(rows)
    shards = {(r.row.doc_id, r.row.text): r.shard for r in placed.collect()}
    assert all(shards[r.doc_id, r.text] == r.shard_name_ for r in stored.collect())
    files = stored.select(F.input_file_name()).distinct().count()
    assert files <= 6
    empty = sharding.place(docs.limit(0), ["one"], slots=7)
    sharding.write_shards(empty, f"{tmp_path}/none")


# --- site quality -----------------------------------------------------------------------


def test_posteriors_recomputed_in_sql(spark):
    """Priors by moments and both shrinkage steps, out of the evidence alone."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = site_quality.quality_scores(docs, labels).toArrow()
    con = duckdb.connect()
    con.register("found", found)
    wrong = con.execute(
        f"""
        WITH paths AS (SELECT host, path, count(*) AS n, sum(evidence) AS total FROM found GROUP BY ALL),
        hosts AS (SELECT host, sum(n) AS host_n, sum(total) AS host_total FROM paths GROUP BY host),
        every AS (SELECT sum(n) AS n, sum(total) / sum(n) AS mean FROM paths),
        by_host AS (
          SELECT (sum(host_n * (host_total / host_n - mean) ** 2) - count(*) * any_value(mean * (1 - mean))) / sum(host_n) AS spread
          FROM hosts, every),
        by_path AS (
          SELECT (sum(p.n * (total / p.n - host_total / host_n) ** 2) - count(*) * any_value(mean * (1 - mean))) / sum(p.n) AS spread
          FROM paths p JOIN hosts USING (host), every),
        weights AS (
          SELECT mean, least(greatest(mean * (1 - mean) / greatest(h.spread, 1e-12) - 1, 1), 1e9) AS host_weight,
            least(greatest(mean * (1 - mean) / greatest(p.spread, 1e-12) - 1, 1), 1e9) AS path_weight
          FROM every, by_host h, by_path p),
        shrunk AS (
          SELECT f.*, mean, path_weight, n, total,
            (host_total - evidence + host_weight * mean) / (host_n - 1 + host_weight) AS own_host
          FROM found f JOIN hosts USING (host) JOIN paths USING (host, path), weights),
        paired AS (SELECT *, (total - evidence + path_weight * own_host) / (n - 1 + path_weight) AS own_site FROM shrunk),
        scored AS (
          SELECT *, 1 / (1 + exp(-(ln(evidence / (1 - evidence)) + ln(own_site / (1 - own_site)) - ln(mean / (1 - mean))))) AS own_score
          FROM paired)
        SELECT count(*), count(*) FILTER (abs(own_host - host_prior) > 1e-9), count(*) FILTER (abs(own_site - site_prior) > 1e-9),
          count(*) FILTER (abs(own_score - score) > 1e-6), count(*) FILTER (kept <> (score >= {site_quality.KEEP}))
        FROM scored"""
    ).fetchone()
    assert wrong == (1000, 0, 0, 0, 0)


# --- token records ----------------------------------------------------------------------


def test_records_in_a_folder_of_choice_are_read_in_drawn_order(spark, tmp_path):
    rows = [(k if k != 3 else None, text, "x", 1) for k, text in enumerate(["a b", "", None, "null id", "again", "again", "long " * 5_000])]
    rows.append((5, "again", "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, offset int").repartition(3)
    folder, index = binary_records.encode_to_records(docs, tokenizer_file(), 2, file_bytes=64, destination=f"{tmp_path}/out")
    assert folder == f"{tmp_path}/out/records" and spark.read.parquet(f"{tmp_path}/out/index").count() == len(rows)
    assert index.select("file").distinct().count() > 1
    plain = {(r.doc_id, tuple(r.ids)) for r in binary_records.shuffled_records(index, folder, 1).collect()}
    orders = {}
    for seed in (1, 2):
        read = binary_records.shuffled_records(index, folder, seed).collect()
        assert len(read) == len(rows) and [r.place for r in read] == sorted(r.place for r in read)
        assert {(r.doc_id, tuple(r.ids)) for r in read} == plain and all(r.ids[-1] == 2 for r in read)
        orders[seed] = [(r.doc_id, len(r.ids)) for r in read]
    assert orders[1] != orders[2] and sorted(map(str, orders[1])) == sorted(map(str, orders[2]))
    folder, index = binary_records.encode_to_records(docs.limit(0), tokenizer_file(), 2, destination=f"{tmp_path}/none")
    assert index.count() == 0 and spark.read.parquet(f"{tmp_path}/none/index").count() == 0


def test_null_ends_of_redirects_are_no_links(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None), (2, None, "<html>"), (None, "nothing", "")], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(None, "http://a.net/x"), ("http://a.net/x", None), (None, None)], "source string, target string")
    found = url_rules.verdicts(pages, url_rules.rule_table(pages, url_rules.RULES), redirects).collect()
    assert {(r.page_id, r.host, r.verdict) for r in found} == {(1, "a.net", "block"), (2, "", "allow"), (None, "", "allow")}


def test_evidence_and_scores_are_probabilities(spark):
    """Evidence is a probability for any text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    table = site_quality.quality_scores(docs, labels).select("evidence", "score").toArrow()
    assert isinstance(table, pa.Table)
    values = np.concatenate([table.column(k).to_numpy() for k in range(2)])
    assert ((values >= 0) & (values <= 1)).all()
