"""Fill-in-the-middle transformation by DuckDB inside mapInArrow.

Every text is cut into lines (a line keeps its line feed; a last line without one counts). Two
cuts drawn from a hash of the document's id split the lines into prefix, middle and suffix, whose
order the output changes: prefix, suffix, middle (psm), or suffix, prefix, middle (spm), each
under its mark. A text that is empty or holds a mark already stays as it is (plain), as do those
beyond ``rate`` percent. The four draws are the first four groups of eight digits of
sha256("seed:id").

Each Arrow batch is registered with a DuckDB connection of the worker, one SQL statement cuts,
hashes and joins whole columns, and its Arrow result leaves the worker: Python never sees a row.
``restored`` reads the text back from output and form alone. Marks that stand at part borders are
found for certain, since a mark starts with ``<`` and holds no second one, so none can straddle a
border.

Defined results: a null text is the empty text; a null id is hashed as the empty one. Repeated
rows give equal rows each. An empty table gives no rows. Further columns are ignored. Texts of
any length are handled whole; batches are registered in parts of about ``PART`` bytes, so a
worker holds a few copies of that, or of its longest text.

Scale: no shuffle, no state; a lost executor costs its own tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.llm.common import map_arrow, pick, slices

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that DuckDB sees at once.
PART = 8 << 20

TRANSFORM = r"""
WITH cut AS (
  SELECT place, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256({seed} || ':' || coalesce(name, '')) AS digest
  FROM batch
), drawn AS (
  SELECT place, text, units, CAST(len(units) AS BIGINT) AS n,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(digest, i, 8) AS BIGINT)) AS h
  FROM cut
), placed AS (
  SELECT place, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, {P}) OR contains(text, {S}) OR contains(text, {M}) OR h[3] % 100 >= {rate} THEN 'plain' WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT place, text, n, form, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM placed
)
SELECT place, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {P} || prefix || {S} || suffix || {M} || middle ELSE {S} || suffix || {P} || prefix || {M} || middle END AS output
FROM parts
"""

RESTORE = r"""
WITH split AS (
  SELECT place, form, text, string_split(text, {M}) AS m FROM batch
), first AS (
  SELECT place, form, text, m, CASE form WHEN 'psm' THEN string_split(substr(m[1], {after_p}), {S}) WHEN 'spm' THEN string_split(substr(m[1], {after_s}), {P}) END AS p FROM split
)
SELECT place, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p[1] || m[2] || p[2] ELSE p[2] || m[2] || p[1] END AS restored
FROM first
"""


@lru_cache(1)
def connection():
    """One in-memory database a worker: one thread, bounded memory, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def asked(statement: str, columns: dict[str, pa.Array]) -> pa.Table:
    """The statement's answer over the columns as table batch, in which place numbers the rows."""
    db = connection()
    rows = len(next(iter(columns.values())))
    db.register("batch", pa.table({"place": pa.array(np.arange(rows, dtype=np.int64)), **columns}))
    try:
        return db.sql(statement).to_arrow_table()
    finally:
        db.unregister("batch")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _marks(prefix: str, suffix: str, middle: str) -> dict[str, str]:
    marks = (prefix, suffix, middle)
    if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] != prefix[0] for m in marks):
        raise ValueError("marks are three different strings that start with one character and hold it once")
    return {"P": _quoted(prefix), "S": _quoted(suffix), "M": _quoted(middle)}


def _over(batches, texts: int, build):
    """build(part of a batch) for parts of bounded text."""
    for batch in batches:
        column = batch.column(texts)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for lo, hi in slices(sizes, PART):
            yield build(batch.slice(lo, hi - lo))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (code points; null if plain), output."""
    chosen = pick(docs, doc_id=doc_id, name=(F.col(f"`{doc_id}`") if isinstance(doc_id, str) else doc_id).cast("string"), text=text)
    statement = TRANSFORM.format(seed=_quoted(str(int(seed))), rate=int(rate), spm=int(spm), **_marks(*marks))

    def build(part: pa.RecordBatch) -> pa.RecordBatch:
        told = asked(statement, {"name": part.column(1), "text": part.column(2)})
        out = [part.column(0).take(told.column("place").combine_chunks()), *(told.column(c).combine_chunks() for c in ("n", "form", "prefix_chars", "middle_chars", "output"))]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_arrow(chosen, lambda batches: _over(batches, 2, build), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(rows: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """rows of transform() with the text, rebuilt from form and output."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    statement = RESTORE.format(after_p=len(marks[0]) + 1, after_s=len(marks[1]) + 1, **_marks(*marks))

    def build(part: pa.RecordBatch) -> pa.RecordBatch:
        told = asked(statement, {"form": part.column(2), "text": part.column(5)})
        at = told.column("place").combine_chunks()
        return pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(6)), told.column("restored").combine_chunks()], [*names, "restored"])

    some = rows.select(*names)
    return map_arrow(some, lambda batches: _over(batches, 5, build), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema) + ", restored string")
