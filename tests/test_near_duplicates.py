"""Near-duplicate existence against all pairs, with copies, common shingles and rows without words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderloom.functions.scalars import audit_tokens, hashed_shingles
from cinderloom.operators import text_audit


def shingled(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return set(words) if len(words) <= 5 else {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def all_pairs(synthetic, seeds, threshold):
    """The rule itself: a seed or an earlier synthetic row at the threshold or above."""
    seen, out = [s for s in (shingled(t) for _, t in seeds) if s], {}
    for i, t in sorted(synthetic):
        s = shingled(t)
        out[i] = bool(s) and any(len(s & o) >= threshold * len(s | o) for o in seen)
        if s:
            seen.append(s)
    return out


def made(rng, n, boilerplate):
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("alpha beta gamma delta".split())
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(boilerplate + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 30))))
        elif kind < 0.75:
            texts.append(rng.choice([None, "", "...", "One", "one two", "Two, one!"]))
        else:
            texts.append(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))))
    return texts


@pytest.mark.parametrize(("threshold", "seed"), [(0.85, 1), (0.85, 2), (0.5, 3), (1.0, 4)])
def test_equals_all_pairs(spark, threshold, seed):
    rng = random.Random(seed)
    texts = made(rng, 420, " ".join(f"b{i}" for i in range(60)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    synthetic, seeds = rows[:330], rows[330:]
    frame = lambda r: spark.createDataFrame(r, "id bigint, text string").selectExpr("*", "'x' AS s", "1 AS n", "2 AS first", "true AS seed")
    got = {r["id"]: r["near"] for r in text_audit.near_duplicates(frame(synthetic), frame(seeds), "id", "text", threshold).collect()}
    assert got == all_pairs(synthetic, seeds, threshold)


def test_copies_settle_each_other_without_pairs(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(i, words + (" extra" if i % 2 else "")) for i in range(800)], "id bigint, text string")
    entries = text_audit._classes(text_audit._sets(rows, rows.limit(0), "id", "text"))
    assert entries.count() == 2
    rate = text_audit.near_duplicate_rate(rows, rows.limit(0), "id", "text").first()
    assert (rate["n_near"], rate["n_rows"]) == (799, 800)


def test_whole_sets_of_copies_do_not_travel(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(i, words) for i in range(50)], "id bigint, text string")
    every = text_audit._sets(rows, rows.limit(0), "id", "text")
    classes = text_audit._classes(every)
    assert "s" not in classes.columns
    assert classes.select(F.size("pre").alias("p")).first()["p"] == 36 - 31 + 1
    assert text_audit._prefixes(every, classes, 0.85).count() == 6


@pytest.mark.parametrize(("threshold", "seed"), [(0.85, 5), (0.5, 6)])
def test_pairs_equal_all_pairs(spark, threshold, seed):
    rng = random.Random(seed)
    texts = made(rng, 260, " ".join(f"b{i}" for i in range(60)))
    texts += [texts[3]] * 40  # copies, so that their shingles' classes stay few
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    synthetic, seeds = rows[:220], rows[220:]
    frame = lambda r: spark.createDataFrame(r, "id bigint, text string")
    got = text_audit.near_duplicate_pairs(frame(synthetic), frame(seeds), "id", "text", threshold).collect()
    sets = {i: shingled(t) for i, t in rows}
    late = {i for i, _ in synthetic}
    want = {}
    for a in late:
        for b in sets:
            union = sets[a] | sets[b]
            if sets[a] and (b not in late or b < a) and len(sets[a] & sets[b]) / len(union) >= threshold:
                want[a, b] = len(sets[a] & sets[b]) / len(union)
    assert len(got) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in got} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    rate = text_audit.near_duplicate_rate(none, none, "id", "text").first()
    assert (rate["n_near"], rate["n_rows"], rate["rate"]) == (0, 0, None)


def test_hashed_sets_have_the_sizes_of_the_word_sets(spark):
    texts = made(random.Random(9), 60, "a b c d e f g")
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", F.size(hashed_shingles(audit_tokens(F.col("text")))).alias("n"))
    assert {r["id"]: r["n"] for r in rows.collect()} == {i: len(shingled(t)) for i, t in enumerate(texts)}


def test_seen_before(spark):
    texts = ["A b", "a  B!", "", None, "c", "...", "a b", "C"]
    rows = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "id bigint, text string")
    got = {r["id"]: r["seen_before"] for r in text_audit.exact_duplicates(rows, "text", "id").collect()}
    assert got == {10: True, 9: True, 8: False, 7: False, 6: True, 5: False, 4: False, 3: False}
