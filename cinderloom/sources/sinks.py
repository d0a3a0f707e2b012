"""Tables out: CSV with fixed headers, JSON lines, fastText lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """One CSV file of exactly these columns in this order; the header stands there even without rows. For report tables, which are small."""
    extra = set(rows.columns) - set(columns)
    if extra:
        raise ValueError(f"unexpected columns: {sorted(extra)}")
    some = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    some.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; refuses to overwrite, and a failed job leaves nothing (the committer renames at the end)."""
    rows.write.mode(mode).json(path)


def write_snapshot(rows: DataFrame, path: str, run: str = "run_id", cycle: str = "cycle") -> None:
    """Training rows by run and cycle, so that a later read prunes to one of them."""
    rows.write.mode("append").partitionBy(run, cycle).parquet(path)


def write_fasttext(rows: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """A line with its label's prefix for each row."""
    rows.select(F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(" "), F.regexp_replace(F.col(text), "[\r\n]+", " ")).alias("value")).write.text(path)


def formatted(rows: DataFrame, *metrics: str) -> DataFrame:
    """Metrics as text with four decimals."""
    return rows.withColumns({m: F.format_string("%.4f", F.col(m)) for m in metrics})
