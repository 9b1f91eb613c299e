"""Token ids against the tokenizer itself; files and sequences against a plain reading."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mercadia.llm import binary_records, packing
from mercadia.llm.queries import tokenizer_file
from mercadia.llm.tokens import Encoder
from tests.conftest import SMALL

PLAIN, OURS = Tokenizer.from_file(tokenizer_file()), Encoder(tokenizer_file())
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "　", "​", "\0", "a", "word", "'ll", "'s", "'", "é", "1", "²", "!", "...", "###", "中文", "😀", "<|endoftext|>"]


def plain_ids(text: str) -> list[int]:
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(OURS.encode(text), OURS.width).tolist() == plain_ids(text)


@pytest.mark.parametrize("text", [m + w + c for m in ("'", "1", "!", "\n") for w in ("this", "very", "verily", "that", "red", "day", "some") for c in ("", ".", "!?", " on")])
def test_first_words_after_a_mark_are_cut_as_the_tokenizer_cuts(text):
    assert np.frombuffer(OURS.encode(text), OURS.width).tolist() == plain_ids(text)


def test_other_tokenizer_files_encode_whole_texts():
    path = tokenizer_file("word_bpe_49k.json")
    text = "Some  Words, in Mixed\ncase"
    found = Encoder(path)
    assert not found.by_unit
    assert np.frombuffer(found.encode(text), found.width).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: plain_ids(r.text) for r in docs.collect()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark, docs, plain):
    folder, index = binary_records.encode_to_records(docs, tokenizer_file(), end_id=2, file_bytes=40_000)
    start, found = 0, {r.doc_id: r for r in index.collect()}
    for doc_id in sorted(plain):
        ids, row = [*plain[doc_id], 2], found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert index.select("file").distinct().count() > 5
    drawn = binary_records.shuffled_records(index, folder, seed=5).collect()
    assert {r.doc_id: r.ids for r in drawn} == {d: [*ids, 2] for d, ids in plain.items()}
    assert [r.doc_id for r in drawn] != sorted(plain)


def test_damaged_records_are_noticed():
    good = binary_records.struct.pack(binary_records.HEAD, binary_records.MAGIC, 2, 0) + binary_records.record(4, b"\1\0\2\0", 2) + b"\n"
    assert [(d, ids.tolist()) for _, _, d, _, ids in binary_records.parsed(good)] == [(4, [1, 2])]
    bad = bytearray(good)
    bad[-8] ^= 1
    with pytest.raises(ValueError):
        list(binary_records.parsed(bytes(bad)))


@pytest.mark.parametrize("buffer_ids", [3_000, 1 << 19])
def test_packing_places_every_id_once(docs, plain, buffer_ids):
    pieces = packing.packed(docs, tokenizer_file(), separator_id=0, buffer_ids=buffer_ids).collect()
    by_document, by_sequence = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == [*plain[p.doc_id], 0][p.start : p.start + p.length]
        by_document.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_document) == set(plain)
    for doc_id, spans in by_document.items():
        assert covers(spans) == len(plain[doc_id]) + 1
    for spans in by_sequence.values():
        total = covers(spans)
        assert total <= 1024 and total & (total - 1) == 0
    # Few cuts: hardly more pieces than whole windows and documents need.
    needed = sum(-(-(len(ids) + 1) // 1024) for ids in plain.values())
    assert len(pieces) < 1.6 * needed


def covers(spans) -> int:
    at = 0
    for start, length in sorted(spans):
        assert start == at
        at += length
    return at


def test_steps_have_one_length_and_even_work():
    windows = [[(1024, k, 0)] if k % 3 else [(512, k, 0), (512, k, 512)] for k in range(64)] + [[(256, 99, 0)]]
    chosen = packing.steps(windows, step_ids=16 * 1024)
    work = {}
    for window, step in zip(windows, chosen):
        work.setdefault((step, sum(p[0] for p in window)), []).append(sum(p[0] ** 2 for p in window))
    assert len({step for step, _ in work}) == len(work) == 5
    sums = [sum(w) for (_, length), w in work.items() if length == 1024]
    assert max(sums) - min(sums) <= 1024**2


@pytest.mark.parametrize("buffer_ids", [3_000, 1 << 19])
def test_step_groups_are_full_but_for_the_last_of_a_task(spark, buffer_ids):
    """However often the buffer is packed, a length has one smaller group in each task at most."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(2)
    pieces = packing.packed(table, tokenizer_file(), separator_id=0, buffer_ids=buffer_ids, step_ids=4096)
    groups = pieces.groupBy("step_id", "sequence_length").agg(F.count_distinct("sequence_id").alias("n")).collect()
    assert len({g.step_id for g in groups}) == len(groups)
    smaller = {}
    for g in groups:
        size = 4096 // g.sequence_length
        assert g.n <= size
        if g.n < size:
            smaller.setdefault((g.step_id >> 40, g.sequence_length), []).append(g.n)
    assert all(len(own) == 1 for own in smaller.values())
    assert sum(g.n * g.sequence_length == 4096 for g in groups) > len(groups) / 2
