"""Teacher calls under a token budget, in parallel, with the outcome of the one-by-one rule.

The rule: rows are taken in order; one is sent only if what is spent and its predicted bound stay
within the budget, and the first that does not fit ends it; with a target, it ends when so many
replies are accepted. A call's real usage is charged, which its bound holds from above.

Rounds: a distributed prefix sum of the bounds, computed once, grants leases to every row up to
which all bounds fit into what is left, and to no more rows than replies are still wanted. The rule
would have sent each of them, since what really was spent is at most what was reserved. Partitions
call the plug-in with bounded concurrency and retries, the round is written, its usage settles
the budget, and the rest is leased again. What is left shrinks with every round, so there are few.

Tables hold rows; the driver holds the sums of a round. A task that is lost with its executor
calls again for the rows of its own partition of one round; ``cache`` (see ``operators.generation``) spares
calls that were written.
"""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.operators.loop import attempt_outcome
from cinderloom.operators.ranks import running_total
from cinderloom.sources.staging import staged


@dataclass(frozen=True)
class Reply:
    """What a teacher says and reports; tokens are null where it reports none."""

    text: str | None
    input_tokens: int | None = None
    output_tokens: int | None = None
    total_tokens: int | None = None


#: Made once a task, on the executor: from a prompt to a reply, awaited.
Teacher = Callable[[], Callable[[str], Awaitable[Reply]]]
REPLY = "reply string, input_tokens bigint, output_tokens bigint, total_tokens bigint, error string, tries int"


async def _one(call, prompt: str, gate: asyncio.Semaphore, tries: int, pause: float) -> tuple:
    """Reply columns of a prompt: the first reply, or the error of the last try."""
    error = "no prompt"
    for n in range(1, tries + 1):
        if prompt is None:
            break
        try:
            async with gate:
                r = await call(prompt)
            return r.text, r.input_tokens, r.output_tokens, r.total_tokens, None, n
        except Exception as e:  # noqa: BLE001 - any error of a plug-in is an outcome
            error = f"{type(e).__name__}: {e}"
            if n < tries:
                await asyncio.sleep(pause * n)
    return None, None, None, None, error, 0 if prompt is None else tries


def called(rows: DataFrame, prompt: str, teacher: Teacher, concurrency: int = 10, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """rows with the reply, its tokens, the error and the number of tries. A partition has ``concurrency`` calls open at most."""
    if concurrency < 1 or tries < 1:
        raise ValueError("a call at a time and a try at least")
    names = [f.split()[0] for f in REPLY.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), REPLY])
    at = rows.columns.index(prompt)

    def run(batches):
        call = teacher()
        for batch in batches:
            async def every(prompts):
                gate = asyncio.Semaphore(concurrency)
                return await asyncio.gather(*[_one(call, p, gate, tries, pause) for p in prompts])

            told = asyncio.run(every(batch.column(at).to_pylist()))
            columns = list(zip(*told)) or [[]] * len(names)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


@dataclass
class Taught:
    """attempts: a row each that was sent, and the one that was masked; place, status, ledger, source, before and after besides the rows' columns and the reply's."""

    attempts: DataFrame
    spent: int
    accepted: int
    stop_cause: str
    rounds: int

    @property
    def records(self) -> DataFrame:
        return self.attempts.where("accepted")


def taught(rows: DataFrame, order: list[str], prompt: str, predicted: str, teacher: Teacher, budget: int | None = None, target: int | None = None, accept: Column | None = None, **calls) -> Taught:
    """Call the teacher for rows in order until they end, the target is met (``target``), a bound does not fit (``budget``) or a call breaks its bound (``violation``).

    ``accept`` says of a reply (columns of the rows and of the reply) whether it counts; a reply
    without text never does. ``predicted`` bounds a call's tokens from above. A row without a prompt
    fails and is charged its bound, as is a call without reported usage. ``order`` tells rows apart.
    """
    spark = rows.sparkSession
    line = staged(running_total(rows, order, F.greatest(F.col(predicted), F.lit(0)), "_sum", "place"))
    bound = F.greatest(F.coalesce(F.col(predicted).cast("bigint"), F.lit(0)), F.lit(0))
    ok = F.coalesce(accept if accept is not None else F.lit(True), F.lit(False)) & (F.trim(F.coalesce("reply", F.lit(""))) != "")
    done, reserved, spent, accepted, rounds, cause = 0, 0, 0, 0, [], "rows"
    while True:
        if target is not None and accepted >= target:
            cause = "target"
            break
        lease = line.where(F.col("place") > done)
        if budget is not None:
            lease = lease.where(F.col("_sum") <= budget - spent + reserved)
        if target is not None:
            lease = lease.where(F.col("place") <= done + target - accepted)
        replies = called(lease, prompt, teacher, **calls)
        status = attempt_outcome(F.lit(None).cast("double"), bound, F.lit(True), F.col("reply"), ok.cast("int"), F.col("total_tokens"))
        judged = replies.withColumn("_o", status).withColumn("ledger", F.col("_o.ledger").cast("bigint"))
        over = F.col("ledger") > bound
        judged = judged.withColumn("status", F.when(over, "budget_violation").when(F.trim(F.coalesce("reply", F.lit(""))) == "", F.when(F.col("error").isNotNull(), "failed").otherwise("empty_response")).otherwise("success"))
        table = staged(judged.withColumn("source", F.col("_o.source")).withColumn("accepted", ok & ~over).drop("_o"))
        sums = table.agg(F.count("*").alias("n"), F.sum("ledger").alias("spent"), F.count_if("accepted").alias("ok"), F.max("_sum").alias("reserved"), F.min(F.when(F.col("status") == "budget_violation", F.col("place"))).alias("broken")).first()
        if not sums["n"]:
            follower = line.where(F.col("place") == done + 1)
            if follower.isEmpty():
                break
            cause = "budget"
            masked = follower.select("*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in REPLY.split(", ")], F.lit(0).cast("bigint").alias("ledger"), F.lit("masked").alias("status"), F.lit("zero_no_dispatch").alias("source"), F.lit(False).alias("accepted"))
            rounds.append((masked, spent, reserved))
            break
        rounds.append((table, spent, reserved))
        spent, accepted, done, reserved = spent + sums["spent"], accepted + sums["ok"], done + sums["n"], sums["reserved"]
        if sums["broken"] is not None:
            # The rule stops at the call that broke its bound: what was accepted behind it does not count.
            cause = "violation"
            late = F.col("place") > sums["broken"]
            accepted -= table.where(late & F.col("accepted")).count()
            rounds[-1] = (table.withColumn("accepted", F.col("accepted") & ~late), *rounds[-1][1:])
            break
    every = reduce(DataFrame.unionByName, [t for t, _, _ in rounds]) if rounds else line.limit(0).select("*", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in REPLY.split(", ")], F.lit(0).cast("bigint").alias("ledger"), F.lit("").alias("status"), F.lit("").alias("source"), F.lit(False).alias("accepted"))
    # What was left before and after each row, had they gone one by one: the running sum of real charges.
    run = running_total(every, ["place"], "ledger", "_paid", "_p").drop("_p")
    left = F.lit(budget).cast("bigint") - F.col("_paid")
    out = run.withColumn("after", left).withColumn("before", left + F.col("ledger")).drop("_paid", "_sum")
    return Taught(staged(out), spent, accepted, cause, len(rounds))
