"""Packing along the curve: the curve itself, lossless pieces, no padding, neighbours, awkward rows."""

import itertools
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderloom.llm import curve_packing as cv

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, end):
    library = Tokenizer.from_file(WORD_BPE)
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 1), (2, 5), (3, 3), (4, 2), (5, 2)])
def test_keys_visit_every_cell_by_unit_steps(dimensions, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = cv.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()
    # A cell of half the resolution is one run of the curve.
    for level in range(1, bits):
        coarse = cv.hilbert_keys(grid >> level, bits)  # only used as names
        runs = coarse[np.argsort(keys)]
        assert (np.diff(runs) != 0).sum() + 1 == len(set(coarse.tolist()))


def test_vectors_are_means_of_projected_buckets():
    table = cv.projection(1000)
    ids = np.array([1, 2, 2, 7, 9])
    got = cv.vectors(ids, np.array([0, 3]), table)
    assert np.allclose(got, [(table[1] + 2 * table[2]) / 3, (table[7] + table[9]) / 2], atol=1e-6)


def held(pieces, docs, ids, capacity):
    """Every id once, sequences gapless and full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    copies = Counter(docs)
    for doc, n in copies.items():
        wanted = Counter()
        for d, i in zip(docs, ids):
            if d == doc:
                wanted[tuple(i)] += 1
        found = Counter()
        for p in by_doc[doc]:
            some = {k for k in wanted if len(k) == p["doc_tokens"] and zlib.crc32(array("I", k[p["start"] : p["start"] + p["length"]]).tobytes()) == p["ids_crc32"]}
            assert some
            found[p["doc_tokens"]] += p["length"]
        assert sum(found.values()) == sum(len(k) * c for k, c in wanted.items())
        if n == 1:
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p["start"]):
                assert p["start"] == at and p["length"] > 0
                at += p["length"]
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


@pytest.mark.parametrize("capacity", [1, 7, 64, 4096])
def test_pieces_are_lossless_and_unpadded(spark, capacity):
    texts = [None, "", " ", "a", "the quick brown fox", "word " * 5000, "naïve café 東京 " * 40, *(f"document {i} about {'cats' if i % 2 else 'boats'}" for i in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "the quick brown fox")] * 2 + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS curve_key", "3 AS tie", "'t' AS start")
    pieces = cv.pack_documents(df, WORD_BPE, capacity=capacity).collect()
    held(pieces, [r[0] for r in rows], library_ids([r[1] for r in rows], 2), capacity)


def test_repeated_runs_agree_and_alike_documents_meet(spark):
    topics = ["boat sail harbour tide anchor deck", "loss gradient tensor batch epoch layer", "flour oven yeast dough crust bake"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(topics[i % 3].split(), 60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    first, second = (sorted(map(tuple, cv.pack_documents(df.repartition(n), WORD_BPE, capacity=512).collect())) for n in (1, 5))
    assert sum(x[2] for x in first) == sum(x[2] for x in second)  # ranges, and so cuts, may differ with the layout
    same = total = 0
    by_sequence = defaultdict(set)
    for doc, _, _, _, _, sequence, _ in first:
        by_sequence[sequence].add(doc)
    for docs in by_sequence.values():
        for a, b in itertools.combinations(sorted(docs), 2):
            total += 1
            same += a % 3 == b % 3
    assert same > 0.9 * total


def test_copies_spread_over_ranges_and_text_ids(spark):
    df = spark.createDataFrame([(f"d{i}", "the same text again") for i in range(400)], "doc_id string, text string")
    rows = cv.ordered(cv.keyed(df, WORD_BPE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in rows.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 200
    pieces = cv.packed(rows, False).collect()
    assert sum(p["length"] for p in pieces) == 400 * 5


def test_empty_table(spark):
    assert cv.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), WORD_BPE).collect() == []
