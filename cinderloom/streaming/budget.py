"""Budget stop as a stream: state per run with ``transformWithState``.

The reference has no streams; this gives its batch rule (the first attempt, in log order, at which
the running total reaches the budget) over a log that arrives in any order and more than once.
As there, a total that equals the budget but for the rounding of its additions reaches it.

State of a run: the total, the attempts' ids (an attempt that comes again, in this batch or after a
restart, is charged once), and the charges up to the stop. Nothing behind the stop
can move it, so that part of the log is let go; an attempt that comes late and stands before the stop
moves it forward. A timer closes a run that has been silent for ``idle`` of event time: its state
goes, and what comes for it still later starts anew, so ``idle`` has to exceed the log's disorder.

Each access to the state is a message to the JVM, so rows are taken in blocks, and ids and charges
are kept by the thousand: up to ``PAGE`` of either stand in the run's one value, more ids in pages by
their hash (twice as many pages when they are full), more charges in pages in order of arrival.

A row without an id, a place or a time is no attempt and is left out; a null run is a run.

Updates leave per batch and run. A batch's rows of one run are taken in order of arrival; a hot run's state is one task's, as is its log in the rule itself, but rows before the
shuffle are narrow and a trigger's size is bounded by the source's options.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cinderloom.operators.ledger import EPSILON
from cinderloom.sources.staging import new_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "run_id bigint, spent double, attempts bigint, last_ord bigint, stop_at bigint, closed boolean"
#: A week in milliseconds.
IDLE = 7 * 24 * 3600 * 1000


#: Rows of a run that are taken at once; ids or charges that stand in its value or, on average, in a page.
BLOCK, PAGE = 1 << 16, 1 << 11
TOTAL = "spent double, attempts bigint, last_ord bigint, stop_at bigint, before double, latest bigint, due bigint, ids binary, id_pages bigint, charges binary, charge_pages bigint"


def _page_of(ids: np.ndarray, pages: int) -> np.ndarray:
    """The pages, a power of two of them, in which ids stand."""
    mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) & np.uint64(pages - 1)).astype(np.int64)


def _ids(page: bytes) -> np.ndarray:
    return np.frombuffer(page, np.int64)


def _charges(page: bytes) -> np.ndarray:
    """Place, attempt and tokens (the bits of a double) of a row each."""
    return np.frombuffer(page, np.int64).reshape(-1, 3)


def _tokens(charges: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(charges[:, 2]).view(np.float64)


class BudgetLedger(StatefulProcessor):
    """One run's ledger. Input rows: run_id, attempt_id, ord, tokens (null counts 0), ts; none of the others is null but run_id."""

    def __init__(self, budget: float, idle_ms: int = IDLE):
        self.reach, self.idle_ms = float(budget) - EPSILON, int(idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", TOTAL)
        self.seen = handle.getMapState("seen", "page bigint", "ids binary")
        # Charges up to the stop, in no order; all of them while there is no stop.
        self.open = handle.getMapState("open", "page bigint", "charges binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # before: the sum of the charges kept.
        spent, attempts, last, stop, before, latest, due, ids, id_pages, charges, charge_pages = self.total.get() or (0.0, 0, None, None, 0.0, None, None, b"", 0, b"", 0)
        old = attempts
        while block := list(islice(rows, BLOCK)):
            _, told, places, tokens, times = zip(*block)
            told = np.array(told, np.int64)
            fresh, ids, id_pages = self._fresh(told, ids, id_pages, attempts)
            if not len(fresh):
                continue
            at = int(max(times[i] for i in fresh).timestamp() * 1000)
            latest = at if latest is None else max(latest, at)
            places, tokens = np.array(places, np.int64)[fresh], np.array([t or 0.0 for t in tokens], np.float64)[fresh]
            spent, attempts = spent + float(tokens.sum()), attempts + len(fresh)
            last = int(places.max()) if last is None else max(last, int(places.max()))
            kept = np.stack([places, told[fresh], tokens.view(np.int64)], axis=1)
            kept = kept if stop is None else kept[places <= stop]
            if len(kept):
                before, charges = before + float(_tokens(kept).sum()), charges + kept.tobytes()
                if before >= self.reach:
                    stop, before, charges, charge_pages = self._settle(charges, charge_pages)
                elif len(charges) > 24 * PAGE:
                    self.open.updateValue((charge_pages,), (charges,))
                    charges, charge_pages = b"", charge_pages + 1
        if attempts == old:
            return
        if due != latest + self.idle_ms:
            if due is not None:
                self.handle.deleteTimer(due)
            due = latest + self.idle_ms
            self.handle.registerTimer(due)
        self.total.update((spent, attempts, last, stop, before, latest, due, ids, id_pages, charges, charge_pages))
        yield Row(run_id=key[0], spent=spent, attempts=attempts, last_ord=last, stop_at=stop, closed=False)

    def _fresh(self, told: np.ndarray, ids: bytes, pages: int, attempts: int) -> tuple[np.ndarray, bytes, int]:
        """Where ids stand in ``told`` that were not seen before, in order, with the run's ids and pages with them."""
        first = np.sort(np.unique(told, return_index=True)[1])
        fresh = first[~np.isin(told[first], _ids(ids))] if ids else first
        if pages:
            place = _page_of(told[fresh], pages)
            new = np.ones(len(fresh), bool)
            for page in np.unique(place).tolist():
                held = self.seen.getValue((page,))
                here = place == page
                new[here] = held is None or ~np.isin(told[fresh][here], _ids(held[0]))
            fresh = fresh[new]
        ids += told[fresh].tobytes()
        if len(ids) <= 8 * PAGE:
            return fresh, ids, pages
        pages = pages or 1
        while attempts + len(fresh) > pages * PAGE:
            for page in range(pages):
                held = self.seen.getValue((page,))
                if held is not None:
                    self.seen.removeKey((page,))
                    self._deal(_ids(held[0]), 2 * pages)
            pages *= 2
        self._deal(_ids(ids), pages)
        return fresh, b"", pages

    def _deal(self, ids: np.ndarray, pages: int) -> None:
        """Ids join their pages."""
        place = _page_of(ids, pages)
        for page in np.unique(place).tolist():
            held = self.seen.getValue((page,))
            self.seen.updateValue((page,), ((held[0] if held else b"") + ids[place == page].tobytes(),))

    def _settle(self, charges: bytes, pages: int) -> tuple[int, float, bytes, int]:
        """The place at which the kept charges reach the budget, and the sum of those that stay; those behind it go."""
        rows = _charges(b"".join([*[self.open.getValue((page,))[0] for page in range(pages)], charges]))
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        running = np.add.accumulate(_tokens(rows))
        reached = np.flatnonzero(running >= self.reach)
        stop = int(rows[reached[0] if len(reached) else -1, 0])
        kept = int(np.searchsorted(rows[:, 0], stop, "right"))
        if pages:
            self.open.clear()
        full = 0 if kept <= PAGE else -(-kept // PAGE)
        for page in range(full):
            self.open.updateValue((page,), (rows[page * PAGE : min(kept, (page + 1) * PAGE)].tobytes(),))
        return stop, float(running[kept - 1]), b"" if full else rows[:kept].tobytes(), full

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.total.get()
        if held is None:
            return
        spent, attempts, last, stop, _, _, _, _, id_pages, _, charge_pages = held
        self.total.clear()
        if id_pages:
            self.seen.clear()
        if charge_pages:
            self.open.clear()
        yield Row(run_id=key[0], spent=spent, attempts=attempts, last_ord=last, stop_at=stop, closed=True)

    def close(self) -> None:
        pass


def budget_stops(attempts: DataFrame, budget: float, idle_ms: int = IDLE, lateness: str = "1 day") -> DataFrame:
    """Updates of runs, from a stream (or table) of run_id, attempt_id, ord, tokens, ts."""
    rows = attempts.select("run_id", "attempt_id", "ord", F.col("tokens").cast("double").alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.where("attempt_id is not null and ord is not null and ts is not null")
    marked = rows.withWatermark("ts", lateness)
    return marked.groupBy("run_id").transformWithState(BudgetLedger(budget, idle_ms), OUTPUT, "Update", "EventTime")


class Updates:
    """Where a stream's updates go: a folder of the shared place with one table a batch, each replaced if its batch runs again."""

    def __init__(self, spark: SparkSession, place: str | None = None):
        self.spark, self.place = spark, place or new_folder(spark, "stream")
        self.state = f"{self.place}/state"

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place}/updates/batch={batch}")

    def run(self, updates: DataFrame, **trigger) -> None:
        """Take all that is there (or as the trigger says) from where the checkpoint stands."""
        conf = self.spark.conf
        old = conf.get("spark.sql.streaming.stateStore.providerClass")
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        try:
            stream = updates.writeStream.outputMode("update").foreachBatch(self.put).option("checkpointLocation", self.state).trigger(**(trigger or {"availableNow": True})).start()
            stream.awaitTermination()
        finally:
            conf.set("spark.sql.streaming.stateStore.providerClass", old)

    def latest(self, schema: str = OUTPUT) -> DataFrame:
        """The last update of each run."""
        rows = self.spark.read.option("basePath", f"{self.place}/updates").schema(f"{schema}, batch int").parquet(f"{self.place}/updates")
        names = [c for c in rows.columns if c not in ("run_id", "batch")]
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct("batch", "closed")).alias("u")).select("run_id", "u.*")


def drained(spark: SparkSession, sf_dir: str, budget: float) -> DataFrame:
    """The budget stops after the events table has streamed through."""
    from cinderloom.streaming.ledger import attempt_events

    updates = Updates(spark)
    updates.run(budget_stops(attempt_events(spark, sf_dir), budget))
    return updates.latest()
