"""Fill-in-the-middle against a plain version in Python, on awkward texts and ids."""

import hashlib
import re

import pytest

from cinderloom.llm import fim

TEXTS = [
    None, "", "\n", "one", "a\nb\n\nc", "a\nb\n", "\r\n\r\n", "nul\0in\nside", "üñ𝒳\n🤦🏼‍♂️\nend", "has <P> in\nit", "<S>", "tail <M>", "almost < P>\n<p>\nS>\n<S",
    "S>starts\nM>so\nP>that\n<\n<S\n", "\u2028sep\u0085no\nline", "x" * 200_000, "\n".join(f"line {i}" for i in range(30_000)), "'quoted'\n''\\n\n{P}\n%s",
]


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (11, 50, 0), (3, 100, 100), (3, 0, 50)])
def test_equals_the_plain_version_and_restores(spark, seed, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null\nid\nhere"), (0, None), (4, "a\nb\n\nc"), (4, "a\nb\n\nc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS name", "1 AS at", "2 AS n", "'f' AS form", "'o' AS output")
    got = fim.restored(fim.transform(df, seed, rate, spm)).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=repr)
    wanted = sorted(((i is None, i, *plain(i, t, seed, rate, spm), t or "") for i, t in rows), key=repr)
    assert found == wanted


def test_text_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([("k'1", "a\nb\nc\n")], "name string, body string")
    r = fim.restored(fim.transform(df, doc_id="name", text="body")).first()
    assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain("k'1", "a\nb\nc\n") and r["restored"] == "a\nb\nc\n"
    assert fim.restored(fim.transform(df.limit(0), doc_id="name", text="body")).collect() == []


def test_marks_must_be_told_apart(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        fim.transform(df, marks=("<a>", "<a>", "<b>"))
    with pytest.raises(ValueError):
        fim.transform(df, marks=("ab", "b<", "<<"))
