"""Each operator against brute force, an exact round trip or held-out labels, with the odd rows that it must bear."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderloom.llm import bestfit, bpe, jaccard_join, line_dedup, lm_score, maxscore, mpeg_audio, quality, registry, token_packing, toxicity, word_tokens
from cinderloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
ODD = ["", None, " ", "\n\n", "a", "it's 'twas we'll I'd!", "x" * 5000, "é ß 中文 \U0001f600 ́", "don''t   stop\t\tnow  ", "1,234.5 'll 're'", "tail  "]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(library):
    rng = random.Random(3)
    alphabet = list("abstmdrevl'''  \n\t  123!?.é  ßñ中\U0001f600́Ⅷ²")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + [t or "" for t in ODD] + ["ab" * 40_000, "' " * 3000]
    for text, ids in zip(texts, bpe.encode_texts(texts, bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")))):
        assert library.encode_ordinary(text) == ids.tolist()


def test_bpe_round_trip(spark, library):
    encoded = bpe.encode(documents(spark, ODD), P.path("byte_bpe_50k.tiktoken"))
    rows = {r.doc_id: r for r in bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken")).collect()}
    ends = {r.doc_id: np.frombuffer(bytes(r.ends), "<u4") for r in encoded.collect()}
    for i, t in enumerate(ODD):
        assert bytes(rows[i].decoded) == (t or "").encode()
        ids = np.frombuffer(bytes(rows[i].ids), "<u4")
        if len(ids) > 2:
            at, some = bpe.decode_span(ids, ends[i], 1, 2, bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")).pieces)
            assert (t or "").encode()[at : at + len(some)] == some
    assert bpe.encode(documents(spark, []), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_word_tokens_equal_library():
    own, lib = word_tokens.encoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = [*"abstmdrevl'''  \n\t  123!?.é  ßñ中\U0001f600́Ⅷ²ΣσİAB\x1c\x85\xa0", "<|endoftext|>", "é"]
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert np.frombuffer(own.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_mpeg_round_trip_and_resync():
    for n in (0, 1, 191, 192, 193, 5000):
        data = random.Random(n).randbytes(n)
        media = mpeg_audio.write(data)
        found = mpeg_audio.parse(media)
        assert mpeg_audio.read(media) == mpeg_audio.padded(data)
        assert found.samples == 1152 * len(found.offsets) and found.crc_bad == 0 and found.table["frames"] == len(found.offsets)
    media = mpeg_audio.write(b"\xff\xfb\x90\x00" * 500)  # payload that looks like headers
    assert mpeg_audio.read(media) == mpeg_audio.padded(b"\xff\xfb\x90\x00" * 500)
    broken = b"junk\xff\xfa" + media[:1500] + b"\xff" * 99 + media[1500:] + b"TAG" + bytes(125)
    found = mpeg_audio.parse(broken)
    assert found.resyncs == 2 and found.skipped > 99 and len(found.offsets) in (len(mpeg_audio.parse(media).offsets), len(mpeg_audio.parse(media).offsets) - 1, len(mpeg_audio.parse(media).offsets) + 1)
    bad = bytearray(media)
    bad[int(mpeg_audio.parse(media).offsets[3]) + 10] ^= 1
    assert mpeg_audio.parse(bytes(bad)).crc_bad == 1
    assert len(mpeg_audio.parse(b"").offsets) == 0 and mpeg_audio.read(b"abc") == b""


def bits_crc(bits):
    """CRC-16 of a string of bits by long division, as the standard's annex draws it."""
    register = 0xFFFF
    for b in bits:
        carry = register >> 15 ^ int(b)
        register = (register << 1) & 0xFFFF
        if carry:
            register ^= 0x8005
    return register


def test_mpeg_frames_made_without_the_writer():
    # Layer III, 44.1 kHz, 128 kbit/s stereo without checksum: every other frame is padded, 417 and 418 bytes.
    frames = [bytes([0xFF, 0xFB, 0x90 | 2 * (i % 2), 0x00]).ljust(417 + i % 2, b"\0") for i in range(32_000)]
    begin = time.process_time()
    found = mpeg_audio.parse(b"".join(frames))
    assert time.process_time() - begin < 10 and found.samples == 1152 * 32_000 and found.skipped == found.resyncs == 0
    assert found.offsets.tolist() == np.cumsum([0, *(len(f) for f in frames[:-1])]).tolist()
    # Layer II, 48 kHz, 192 kbit/s joint stereo (bound 8) with checksum: 27 subbands, 4 4 ... 3 ... 2 bits.
    rng = random.Random(21)
    made = []
    for _ in range(20):
        head = bytes([0xFF, 0xFC, 0xA4, 0x50])
        widths = [4] * 11 + [3] * 12 + [2] * 4
        allocation, selections = "", 0
        for band, width in enumerate(widths):
            for _ in range(2 if band < 8 else 1):
                value = rng.choice([0, rng.randrange(1 << width)])
                allocation += f"{value:0{width}b}"
                selections += (value > 0) * (1 if band < 8 else 2)
        chosen = allocation + "".join(rng.choice("01") for _ in range(2 * selections))
        crc = bits_crc("".join(f"{b:08b}" for b in head[2:]) + chosen)
        body = int(chosen.ljust(8 * 570, "0"), 2).to_bytes(570, "big")
        made.append(head + crc.to_bytes(2, "big") + body)
    found = mpeg_audio.parse(b"".join(made))
    assert (len(found.offsets), found.crc_ok, found.crc_bad, found.kinds) == (20, 20, 0, ["1.2"])
    broken = bytearray(b"".join(made))
    broken[576 * 7 + 6] ^= 128
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1
    # Xing and VBRI tables in a first frame of layer III stereo (32 bytes of side information).
    xing = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"Xing" + (15).to_bytes(4, "big") + (9).to_bytes(4, "big") + (3753).to_bytes(4, "big") + bytes(range(100)) + (77).to_bytes(4, "big")).ljust(417, b"\0")
    found = mpeg_audio.parse(xing + b"".join(frames[:1]) * 9)
    assert found.table == {"xing": 1, "frames": 9, "bytes": 3753, "quality": 77} and found.seek == list(range(100)) and len(found.offsets) == 9
    vbri = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 2, 80, 3753, 9, 3, 2, 2, 3) + struct.pack(">HHH", 600, 601, 602)).ljust(417, b"\0")
    found = mpeg_audio.parse(vbri + b"".join(frames[:1]) * 9)
    assert found.table == {"vbri": 1, "delay": 2, "quality": 80, "bytes": 3753, "frames": 9, "frames_an_entry": 3} and found.seek == [1200, 1202, 1204]


def test_mpeg_columns(spark):
    rows = mpeg_audio.probe(mpeg_audio.store(documents(spark, ODD))).collect()
    for r in rows:
        assert bytes(r.payload) == mpeg_audio.padded((ODD[r.doc_id] or "").encode())


def check_packing(pieces, texts, capacity):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_doc, by_bin = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity)) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin)


def test_bounded_best_fit(spark):
    rng = random.Random(5)
    texts = [*ODD, *[" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 150))) for _ in range(300)]]
    pieces = bestfit.pack_pieces(bestfit.pieces(documents(spark, texts), P.path("word_bpe_49k.json"), capacity=64).cache(), capacity=64).collect()
    check_packing(pieces, texts, 64)
    again = bestfit.pack_documents(documents(spark, texts + texts), P.path("word_bpe_49k.json"), capacity=64).collect()
    assert check_packing(again, texts + texts, 64) == len({r.sequence_id for r in again})
    assert bestfit.pack_documents(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_pack_equals_plain_online_best_fit():
    rng = random.Random(12)
    for most in (1, 3, 50):
        lengths = [rng.choice([rng.randint(1, 100), 100, 50, 7]) for _ in range(2000)]
        free, closed, want = {}, [], []  # open bins with their free space, oldest change first
        for n in lengths:
            fits = [b for b in free if free[b] >= n]
            if n == 100:
                b, room = len(closed) + len(free), 100
                closed.append(b)
            elif fits:
                least = min(free[b] for b in fits)
                b = [b for b in fits if free[b] == least][-1]
                room = free.pop(b)
            else:
                if len(free) == most:
                    full = min(free.values())
                    gone = [b for b in free if free[b] == full][-1]
                    closed.append(gone)
                    del free[gone]
                b, room = len(closed) + len(free), 100
            want.append((b, 100 - room))
            if n < 100:
                if room > n:
                    free[b] = room - n
                else:
                    closed.append(b)
        name, offset = bestfit.pack(np.array(lengths), 100, most)
        assert list(zip(name.tolist(), offset.tolist())) == want
    name, offset = bestfit.pack(np.zeros(0, np.int64), 100)
    assert len(name) == len(offset) == 0


def test_open_bins_stay_bounded_and_close_the_fullest():
    bins = bestfit.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]  # the bin of 7 closed
    assert bins.put(4) == (0, 6) and bins.put(10)[0] == 3 and bins.put(1) == (2, 9)


def test_best_fit_decreasing_and_unpacking(spark):
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    bins = token_packing.best_fit_decreasing(lengths, 100)
    free = []  # brute force: the fullest bin that holds the item
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [k for k, room in enumerate(free) if room >= lengths[i]]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= lengths[i]
        else:
            free.append(100 - lengths[i])
    assert sorted(i for b in bins for i in b) == list(range(500)) and len(bins) == len(free)
    texts = [*ODD, "word " * 500]
    packed = token_packing.packed(documents(spark, texts), P.path("word_bpe_49k.json"), capacity=64)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in token_packing.unpacked(packed).orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in enumerate(texts):
        assert got[i] == np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    named = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, None)], "doc_id string, text string")
    assert Counter(r.doc_id for r in token_packing.unpacked(token_packing.packed(named, P.path("word_bpe_49k.json"))).collect()) == {"a": 2, None: 1}
    assert token_packing.packed(named.limit(0), P.path("word_bpe_49k.json")).count() == 0
    for r in packed.collect():
        assert len(r.ids) == 256 and len(r.positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens


def test_lm_score_equals_dictionary_models(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat on the log", "zq zq zq ! ! !", "", None, "the cat sat", "long " * 3000]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score(documents(spark, texts), labels, P.path("word_bpe_49k.json")).collect()}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    vocab = lib.get_vocab_size()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}

    def model(docs, scale):
        tok, ctx, pair = Counter(), Counter(), Counter()
        for i in docs:
            tok.update(ids[i])
            ctx.update([vocab, *ids[i]][: len(ids[i])])
            pair.update(zip([vocab, *ids[i]], ids[i]))
        n = sum(tok.values()) * scale

        def p(u, w):
            return (pair[u, w] * scale + lm_score.MU * (tok[w] * scale + lm_score.ALPHA) / (n + lm_score.ALPHA * vocab)) / (ctx[u] * scale + lm_score.MU)

        return p

    target = model([0, 1], 1.0)
    background = model(range(len(texts)), sum(len(ids[i]) for i in (0, 1)) / sum(map(len, ids.values())))
    for p in (target, background):  # every context's probabilities sum to 1
        for u in (vocab, ids[0][0], ids[2][0], 17):
            assert sum(p(u, w) for w in range(vocab)) == pytest.approx(1.0, abs=1e-9)
    for i in range(len(texts)):
        n = max(1, len(ids[i]))
        a, z = (-sum(np.log(p(u, w)) for u, w in zip([vocab, *ids[i]], ids[i])) / n for p in (target, background))
        assert (got[i].target_loss, got[i].background_loss, got[i].n_tokens) == pytest.approx((a, z, len(ids[i])), abs=1e-9)
        assert got[i].score == pytest.approx(a - z, abs=1e-9) and min(a, z) >= 0
    assert got[0].score < got[2].score
    # Chunks of any size give the same, repeated rows one result each.
    monkeypatch.setattr(lm_score.tokens, "__defaults__", (3,))
    docs = documents(spark, texts)
    again = lm_score.score(docs.unionAll(docs.where("doc_id = 4")), labels, P.path("word_bpe_49k.json")).collect()
    assert len(again) == len(texts) + 1 and all(r.score == pytest.approx(got[r.doc_id].score, abs=1e-9) for r in again)
    assert lm_score.score(docs.limit(0), labels, P.path("word_bpe_49k.json")).count() == 0


def test_lm_score_counts_every_labelled_document(spark):
    docs = documents(spark, [f"the cat sat on mat {i} and {i * i}" for i in range(12)] + ["zq zq ! !"])
    few = spark.range(12).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    many = spark.range(400_000).where("id <> 12").select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    want, got = ({r.doc_id: r.target_loss for r in lm_score.score(docs, x, P.path("word_bpe_49k.json")).collect()} for x in (few, many))
    assert got == pytest.approx(want, abs=1e-9)


def test_quality_keeps_good_text(spark):
    rng = random.Random(4)
    words = ["stone", "river", "garden", "window", "morning", "letter", "paper", "and", "the", "of"]
    good = [" ".join(rng.choices(words, k=rng.randint(8, 60))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=rng.randint(8, 60))) for _ in range(100)]
    docs = documents(spark, [*good, *bad, *ODD]).cache()
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400) if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select_documents(docs, labels).collect()}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(300, 400))
    assert quality.select_documents(docs, labels).columns == docs.columns
    model = quality.fit(docs, labels)
    rows = quality.scores(docs, model).toPandas()
    assert {r.doc_id for r in quality.sampled(docs, model).collect()} == kept
    k = int((rows["log_ratio"] >= model.cut).sum())
    assert sorted(rows.nlargest(k, "gumbel_key")["doc_id"]) == sorted(kept)
    assert quality.select_documents(docs, labels.where("quality = 1")).count() == docs.count()
    assert quality.select_documents(documents(spark, []), labels).count() == 0


def test_kth_largest(spark):
    values = [random.Random(9).choice([1.5, 2.0, -3.0, 1e300, 7.25]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 50, 199, 200):
        assert quality.kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_segments_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 30)
        x = [rng.choice([-1.0, -1.0, 2.0, 3.5]) for _ in range(n)]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(x) if v > 0], 1.0, n)

        def brute(lo, hi):  # the definition: the best segment, then the same on either side
            best = max(((sum(x[a : b + 1]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a, hi)), default=(0,))
            if best[0] <= 0:
                return []
            a, b = best[3], best[4]
            return [*brute(lo, a), (a, b, best[0]), *brute(b + 1, hi)]

        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute(0, n)))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in brute(0, n)), default=0))


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    words = [a + b for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("ne", "po", "ri", "sa", "to", "vu")]
    texts, marks = [], []
    for i in range(800):
        toxic = i % 5 == 0
        t = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(2 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["vilegrub", "vilegrubly", "vilegrubness", "rottenest"]))
        texts.append(" ".join(t))
        marks.append(int(toxic))
    docs = documents(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn_from=~registry.held_out(F.col("doc_id")))
    rows = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    out = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(rows[i].score >= 0.3) == bool(marks[i]) for i in out]) > 0.97
    hit = next(i for i in out if marks[i])
    s = rows[hit].segments[0]
    assert any(w in texts[hit][s.first_char : s.end_char] for w in ("vilegrub", "rottenest"))
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in rows if rows[i].score < 0.3}
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.scores(docs, None).collect()} == {0.0}


def test_maxscore_equals_sql(spark, tmp_path):
    rng = random.Random(7)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.random()]) for _ in range(6)], i) for i in range(400)]
    vectors += [(400, None, 0), (450, [float("nan")] * 6, 0), (500, [None] * 6, 0), (1, [9.0] * 6, 0), (550, [1.0] * 4, 0), (600, [0.0] * 6, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = sorted(tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard=64).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert got == sorted(con.execute(registry.OP7_SQL).fetchall())
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    large = spark.createDataFrame([(0, [float(1 << 24), float(1 << 24)]), (1, [float(1 << 24)] * 2), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit"):
        maxscore.top_k(large, F.col("vec_id") == 0).collect()


def shingle_set(text):
    words = jaccard_join.WORD.findall((text or "").lower())
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_links(texts):
    classes = {}
    for i, t in enumerate(texts):
        if s := shingle_set(t):
            classes.setdefault(s, []).append(i)
    reps = [(min(v), s, len(v)) for s, v in classes.items()]
    parent = {r: r for r, _, _ in reps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, near = Counter(), Counter()
    for a in range(len(reps)):
        for b in range(a):
            (x, s, n), (y, t, m) = reps[a], reps[b]
            both = len(s & t)
            if 10 * both >= 8 * (len(s) + len(t) - both):
                links[x] += m
                links[y] += n
                near[x] += 1
                near[y] += 1
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    out = {i: (None, None, 0, 0) for i in range(len(texts))}
    for s, v in classes.items():
        for i in v:
            out[i] = (min(v), root(min(v)), len(v) - 1 + links[min(v)], near[min(v)])
    return out


def near_texts(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(rng.randint(1, size)):
            t = base[:]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    return texts


def test_jaccard_join_finds_all_links(spark):
    texts = [*ODD, "a b c", "A, b. C!", *near_texts(1, 40, 6), *near_texts(2, 1, 400)]
    want = brute_links(texts)
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links, r.n_class_links) for r in jaccard_join.links(documents(spark, texts)).collect()}
    total, found = sum(w[3] for w in want.values()), sum(g[3] for g in got.values())
    assert len(got) == len(texts) and 0.99 * total <= found <= total
    assert all(got[i][0] == want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99


def test_one_of_each_handles_repeats_and_nulls(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " end"), (None, text), (None, None), (3, None), (4, "other words stand here alone now")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "z") for i, t in rows], SCHEMA)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, None, None, 3, 4])
    assert jaccard_join.links(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_removed(texts):
    """The line numbers that line dedup removes from each text, by comparing all lines with each other; texts by id in order."""
    keys = sorted({" ".join(line.lower().split()) for t in texts.values() for line in (t or "").split("\n")} - {""})
    parent = {t: t for t in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {t: Counter(t.split()) for t in keys}
    holders = {}
    for i, t in enumerate(keys):
        for w in words[t]:
            holders.setdefault(w, []).append(i)
    for i, a in enumerate(keys):
        shared = Counter(j for w in words[a] for j in holders[w] if j < i)
        for j, n in shared.items():
            b = keys[j]
            longer = max(len(a), len(b))
            # Lines that share less than two fifths of their words are taken as unlike.
            if n < 0.4 * max(len(words[a]), len(words[b])) or abs(len(a) - len(b)) > 0.2 * longer:
                continue
            x, y = (a, b) if longer <= line_dedup.LONG else (a.split(), b.split())
            if 1 - edit(x, y) / max(len(x), len(y)) >= line_dedup.SIMILAR:
                parent[root(a)] = root(b)
    first, removed = {}, {}
    for i, t in sorted(texts.items()):
        for k, line in enumerate((t or "").split("\n")):
            norm = " ".join(line.lower().split())
            if norm and first.setdefault(root(norm), (i, k)) != (i, k):
                removed.setdefault(i, []).append(k)
    return removed


def without(text, lines):
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in lines)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) for _ in range(40)] + [" ".join(rng.choices(vocabulary, k=300))]
    lines = list(base)
    for b in base:
        for _ in range(4):
            t = b.split()
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
            lines.append(" ".join(t))
        lines.append(b.upper() + "  ")
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)] + ["", None, "\n \n", "lone line"]
    docs = documents(spark, texts)
    removed = brute_removed(dict(enumerate(texts)))
    got = {r.doc_id: list(r.removed) for r in line_dedup.decisions(docs).collect() if r.removed}
    found, wanted = ({(i, k) for i, x in r.items() for k in x} for r in (got, removed))
    assert found <= wanted and len(found) >= 0.98 * len(wanted) and len(wanted) > 100
    out = {r.doc_id: r for r in line_dedup.dedup_documents(docs).collect()}
    for i, t in enumerate(texts):
        kept = without(t, got.get(i, []))
        if i in got and not kept.strip():
            assert i not in out
        else:
            assert (out[i].text or "") == kept
            assert i not in got or out[i].n_chars == len(out[i].text)
    assert line_dedup.dedup_documents(docs.limit(0)).count() == 0


def test_word_digests(spark, sf_dir):
    rows = registry.op1_byte_bpe(spark, sf_dir).limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_line_dedup_finds_changed_words(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(3, 8)))
    # Of each pair of lines the second has about one word in ten changed, one at least: edit similarity stays above 0.8.
    texts = []
    for n in (6, 8, 12, 16, 20, 30, 60, 120) * 10:
        line = [word() for _ in range(n)]
        other = list(line)
        for k in rng.sample(range(n), max(1, n // 10)):
            other[k] = "".join(rng.choices(letters, k=len(other[k])))
        texts += [" ".join(line), " ".join(other)]
    alike = {2 * k + 1 for k in range(80) if 1 - edit(texts[2 * k], texts[2 * k + 1]) / max(len(texts[2 * k]), len(texts[2 * k + 1])) >= line_dedup.SIMILAR}
    got = {r.doc_id for r in line_dedup.decisions(documents(spark, texts)).collect() if r.removed}
    assert got <= alike and len(alike) >= 70 and len(got) >= 0.98 * len(alike)


def test_line_dedup_of_repeated_documents(spark):
    line = " ".join(f"term{i * 7919 % 1000}" for i in range(20))
    rows = [(1, line)] * 600 + [(2, line.replace("term919", "other")), (2, line.replace("term919", "other")), (3, "a line of its own"), (4, None), (4, None), (5, " \n"), (6, ""), (None, line)]
    told = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 1, []), (1, 1, [0]), (2, 1, [0]), (3, 1, []), (4, 0, []), (5, 0, []), (6, 0, [])]
    assert sorted(((r.doc_id, r.n_lines, list(r.removed)) for r in told), key=lambda r: r[0] or 0) == want
    assert all(len(r.groups) == len(r.removed) for r in told)


def test_line_dedup_bears_long_texts_and_ids_of_any_kind(spark):
    rng = random.Random(3)
    many = " ".join(f"w{rng.randrange(5000)}" for _ in range(4000))  # beyond LONG, so words are compared
    token = "".join(rng.choices("0123456789abcdef", k=30_000))
    rows = [("a", many), ("b", many.replace("w7 ", "other ")), ("c", token), ("d", token[:-1]), ("e", "\n".join(["same line of five words"] * 3000)), ("f", "y z")]
    told = {r.doc_id: len(r.removed) for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert told == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 2999, "f": 0}


def test_line_dedup_candidates_of_unlike_lines_stay_few(spark):
    """Lines that share common words but end in a long token of their own meet by pieces of the token too."""
    rng = random.Random(9)
    common = [" ".join(rng.choices(["the", "of", "and", "to", "in"], k=6)) for _ in range(20)]
    counts = []
    for n in (500, 2000):
        texts = [f"{rng.choice(common)} {''.join(rng.choices('0123456789abcdef', k=150))}" for _ in range(n)]
        named = line_dedup.lines(documents(spark, texts)).withColumn("line", F.xxhash64("norm"))
        rows = line_dedup.sketches(named, ["line"]).select("line", F.explode(line_dedup._bucket_keys()).alias("bucket")).groupBy("bucket").count()
        counts.append(rows.select(F.sum(F.col("count") - 1)).first()[0])
    assert counts[1] <= 8 * counts[0]


def test_near_duplicates_of_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [("b", words), ("a", words + " more"), ("c", words), (None, words), ("d", "other words stand here alone"), ("e", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r for r in jaccard_join.links(df).collect() if r["doc_id"]}
    assert {k: r["group_id"] for k, r in got.items()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": None}
    assert [got[k]["n_links"] for k in "abcd"] == [2, 2, 2, 0]
    assert sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(df).collect()) == ["None", "a", "d", "e"]
