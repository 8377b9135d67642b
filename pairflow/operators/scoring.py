"""Batch scoring with a pluggable scorer.

A scorer is built once per task by a factory and answers a batch of prompts:

    factory() -> object with answer(batch: pandas.DataFrame) -> list[Answer]

The batch holds the columns of the table plus `prompt` and `max_tokens`. Spark spreads the rows over the task slots;
what a service allows (requests a second, requests in flight) is shared out among the slots, and the table keeps its
partitions. Answers cost money and cannot be repeated, so `score_stored` scores in waves, each of them written and
logged: a run that breaks off goes on after the last wave in the log.
"""

from __future__ import annotations

import contextlib
import fcntl
import math
import os
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairflow import domain
from pairflow.functions import prompts as P
from pairflow.functions.text import parse_label

# Ship this module's functions with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Answer:
    text: str
    prompt_tokens: int
    response_tokens: int
    latency_ms: float | None = None  # measured around the call if the scorer doesn't say
    success: bool = True
    error: str | None = None


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    delay_s: float = 1.0
    retryable: tuple[str, ...] = tuple(domain.RETRYABLE_ERRORS)

    def should_retry(self, answer: Answer) -> bool:
        if answer.success:
            return False
        message = (answer.error or "").lower()
        return any(r in message for r in self.retryable)


@dataclass(frozen=True)
class Limits:
    """What a service allows the whole job."""

    per_second: float | None = None
    in_flight: int | None = None

    def share(self, slots: int) -> "Limits":
        """One task slot's part; at least one request in flight."""
        return Limits(self.per_second / slots if self.per_second else None,
                      max(1, self.in_flight // slots) if self.in_flight else None)


class TokenBucket:
    """Lets `rate` requests a second pass, and at most a second's worth at once."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.room, self.at = max(1.0, rate), clock()

    def take(self, n: int) -> None:
        """Waits until n requests may go; more than there is room for are paid by waiting."""
        now = self.clock()
        self.room, self.at = min(max(1.0, self.rate), self.room + (now - self.at) * self.rate), now
        self.room -= n
        if self.room < 0:
            self.sleep(-self.room / self.rate)


@contextlib.contextmanager
def _one_of(folder: str | None, n: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[None]:
    """Holds one of n locks in a local session's folder; a lock goes with its process."""
    if folder is None:
        yield
        return
    files = [os.open(os.path.join(folder, str(i)), os.O_CREAT | os.O_RDWR) for i in range(n)]
    try:
        held = False
        while not held:
            for f in files:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    held = True
                    break
                except BlockingIOError:
                    continue
            else:
                sleep(0.001)
        yield
    finally:
        for f in files:
            os.close(f)


RESULT_FIELDS = [
    T.StructField("raw_response", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("response_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
]


STRATEGY_FIELDS = [T.StructField("strategy", T.StringType()), T.StructField("max_tokens", T.IntegerType())]
# Rows whose prompts a task holds at one time.
ROWS_AT_ONCE = 10_000


def _as_pandas(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pd.DataFrame]]:
    for batch in batches:
        yield batch, batch.to_pandas(date_as_object=True)


def _requests(batches: Iterator[pa.RecordBatch], requested: list[tuple[str, list[str], int]]) -> Iterator[tuple[pa.RecordBatch, pd.DataFrame]]:
    """Pairs, each once per strategy, with their prompts and limits."""
    n = len(requested)
    if not n:
        return
    step = max(1, ROWS_AT_ONCE // n)
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            pairs = whole.slice(start, step)
            again = np.repeat(np.arange(pairs.num_rows), n)
            rows = pairs.to_pandas(date_as_object=True)
            prompts = np.empty((len(rows), n), object)
            for i, (_, pieces, _) in enumerate(requested):
                texts = [rows[name] for name in pieces[1::2]]
                prompts[:, i] = [
                    None if None in own else "".join([*[x for pair in zip(pieces[::2], own) for x in pair], pieces[-1]]) for own in zip(*texts)]
            rows = rows.take(again).reset_index(drop=True)
            rows["strategy"] = np.tile(np.array([s for s, _, _ in requested], object), len(pairs))
            rows["prompt"] = prompts.ravel()
            rows["max_tokens"] = np.tile(np.array([m for _, _, m in requested], np.int32), len(pairs))
            yield pairs.take(pa.array(again)), rows


def _one_each(answers: list[Answer], batch: pd.DataFrame) -> list[Answer]:
    answers = list(answers)
    if len(answers) != len(batch):
        raise ValueError(f"the scorer gave {len(answers)} answers to {len(batch)} rows")
    return answers


def _asked(scorer, batch: pd.DataFrame, bucket: TokenBucket | None) -> list[Answer]:
    """The scorer's answers; an answer without a latency gets its share of the measured time."""
    if bucket:
        bucket.take(len(batch))
    begun = time.perf_counter()
    answers = _one_each(scorer.answer(batch), batch)
    each = (time.perf_counter() - begun) * 1000 / max(1, len(batch))
    for answer in answers:
        if answer.latency_ms is None:
            answer.latency_ms = each
    return answers


def answer_with_retries(scorer, batch: pd.DataFrame, policy: RetryPolicy, sleep: Callable[[float], None] = time.sleep,
                        bucket: TokenBucket | None = None) -> tuple[list[Answer], list[int]]:
    """Ask for the whole batch, then again for the rows whose failure may pass; delays double. Repeated requests
    count against the rate as well."""
    answers = _asked(scorer, batch, bucket)
    attempts = [1] * len(answers)
    for attempt in range(1, policy.attempts):
        again = [i for i, a in enumerate(answers) if policy.should_retry(a)]
        if not again:
            break
        sleep(policy.delay_s * 2 ** (attempt - 1))
        retried = batch.iloc[again]
        for i, answer in zip(again, _asked(scorer, retried, bucket)):
            answers[i] = answer
            attempts[i] += 1
    return answers, attempts


def _few_tasks(spark: SparkSession, slots: int, in_flight: int):
    """A resource profile that gives a task so many cores that at most in_flight run at one time."""
    cores = int(spark.conf.get("spark.task.cpus", "1")) * math.ceil(slots / in_flight)
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def score(df: DataFrame, factory: Callable[[], object], policy: RetryPolicy = RetryPolicy(),
          limits: Limits = Limits(), empty_error: bool = False, keep_prompt: bool = False, profile=None,
          keep: tuple[str, ...] | None = None, strategies: list[str] | None = None) -> DataFrame:
    """Add the result columns to a table that has prompt (and optionally max_tokens).

    Each task slot gets its share of limits: a token bucket for the rate, and chunks of rows for what is in flight. If
    less may be in flight than there are slots, a resource profile widens the tasks; a local session, which has none,
    lets its tasks take turns. The table keeps its partitions. empty_error reports "" instead of null for a success.
    keep: the columns besides the answers that come back from the scorer; all but the prompt if not given.
    strategies: df holds pairs without strategies, prompts or limits, as for_strategies takes them. A pair goes to its task
    once and its prompts, many times as long and mostly fixed text, are put together there.
    """
    if strategies is not None:
        unknown = set(strategies) - set(domain.STRATEGIES)
        if unknown or keep_prompt:
            raise ValueError(f"unknown strategies {sorted(unknown)}" if unknown else "prompts made in the task are not kept")
        df = df.drop("strategy", "prompt", "max_tokens")
    spark = df.sparkSession
    slots = max(1, spark.sparkContext.defaultParallelism)
    share, turns = limits.share(slots), None
    if limits.in_flight and limits.in_flight < slots:
        if spark.sparkContext.master.startswith("local["):
            turns = tempfile.mkdtemp(prefix="pairflow-turns-")
        else:
            profile = profile or _few_tasks(spark, slots, limits.in_flight)
    most = limits.in_flight or 0
    names = [f.name for f in RESULT_FIELDS]
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)
            and (keep_prompt or f.name != "prompt")]
    inputs = [f.name for f in kept]
    if strategies is not None:
        kept += [f for f in STRATEGY_FIELDS if keep is None or f.name in keep]
    requested = [(s, P.text_pieces(s), study_tokens(s)) for s in strategies or []]
    schema = T.StructType(kept + RESULT_FIELDS)
    types, more = (to_arrow_schema(T.StructType(fields)) for fields in (RESULT_FIELDS, kept[len(inputs):]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        bucket = TokenBucket(share.per_second) if share.per_second else None
        for batch, rows in _requests(batches, requested) if strategies is not None else _as_pandas(batches):
            size = share.in_flight or len(rows)
            answers, attempts = [], []
            for start in range(0, len(rows), max(1, size)):
                with _one_of(turns, most):
                    part = answer_with_retries(scorer, rows.iloc[start:start + size], policy, bucket=bucket)
                answers += part[0]
                attempts += part[1]
            # What the scorer was given goes back as it came; chunks are joined to one batch again.
            results = [[a.text for a in answers], [a.prompt_tokens for a in answers], [a.response_tokens for a in answers],
                       [a.latency_ms for a in answers], [a.success for a in answers], [a.error for a in answers], attempts]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in inputs], *[pa.array(rows[f.name], f.type) for f in more],
                 *[pa.array(values, f.type) for values, f in zip(results, types)]], names=[*inputs, *more.names, *names])

    result = df.mapInArrow(run, schema, profile=profile).withColumn("predicted_label", parse_label("raw_response"))
    if empty_error:
        result = result.withColumn("error", F.when(F.col("success"), F.lit("")).otherwise(F.col("error")))
    return result


# --- waves with a log ------------------------------------------------------------------------

LOG_SCHEMA = "wave int, waves int, n_rows long, n_failed long"


def _log(spark: SparkSession, path: str) -> dict[int, int]:
    """Wave -> number of waves of the run that committed it."""
    try:
        rows = spark.read.schema(LOG_SCHEMA).json(f"{path}/log").collect()  # one row per wave
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.wave: r.waves for r in rows}


def score_stored(df: DataFrame, path: str, factory: Callable[[], object], waves: int = 16,
                 keys: tuple[str, ...] = ("pairID", "strategy"), ready: Callable[[DataFrame], DataFrame] | None = None,
                 **options) -> DataFrame:
    """Score df into path, wave by wave, and return what is stored there.

    ready makes the rows that are scored (strategies, prompts) of those of df when a wave is read, so that only df is
    stored for the waves.

    A row's wave follows from its keys. A wave is written as a whole and then logged; a wave that was written but not
    logged is written anew. Called again with the same path, e.g. after the driver was lost, waves in the log are read
    and not scored; inside a wave Spark repeats only the tasks of a lost executor.
    """
    spark = df.sparkSession
    wave = F.pmod(F.xxhash64(*keys), F.lit(waves)).cast("int")
    done = _log(spark, path)
    if any(n != waves for n in done.values()):
        raise ValueError(f"{path} was begun with {next(iter(done.values()))} waves")
    if len(done) < waves:
        todo = f"{path}/todo"
        df.withColumn("_wave", wave).where(~F.col("_wave").isin(list(done))).write.mode("overwrite").partitionBy("_wave").parquet(todo)
        rows = spark.read.schema(df.withColumn("_wave", wave).schema).parquet(todo)
        for k in range(waves):
            if k not in done:
                folder = f"{path}/wave-{k}"
                part = rows.where(F.col("_wave") == k).drop("_wave")
                score(ready(part) if ready else part, factory, **options).write.mode("overwrite").parquet(folder)
                told = spark.read.parquet(folder).agg(
                    F.lit(k).alias("wave"), F.lit(waves).alias("waves"), F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(~F.col("success")).alias("n_failed"))
                told.coalesce(1).write.mode("append").json(f"{path}/log")
    return spark.read.parquet(*[f"{path}/wave-{k}" for k in range(waves)])


# --- strategies as rows ----------------------------------------------------------------------

def study_limit(strategy: Column) -> Column:
    """Response limit of the strategy study: long for any strategy that reasons."""
    return F.when(strategy.contains("cot"), F.lit(domain.STUDY_LIMIT_COT)).otherwise(F.lit(domain.STUDY_LIMIT_PLAIN))


def study_tokens(strategy: str) -> int:
    """study_limit of one strategy."""
    return domain.STUDY_LIMIT_COT if "cot" in strategy else domain.STUDY_LIMIT_PLAIN


def adaptive_limit(strategy: Column) -> Column:
    out = F.lit(domain.ADAPTIVE_LIMIT_DEFAULT)
    for name, limit in domain.ADAPTIVE_LIMITS.items():
        out = F.when(strategy == name, F.lit(limit)).otherwise(out)
    return out


def as_strategies(df: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Each row once per strategy."""
    return df.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in (strategies or domain.BASE_STRATEGIES)])))


def with_request(df: DataFrame, limit=study_limit) -> DataFrame:
    """Prompt and response limit of each row's strategy."""
    return P.with_prompt(df).withColumn("max_tokens", limit(F.col("strategy")))


def for_strategies(df: DataFrame, strategies: list[str] | None = None, limit=study_limit) -> DataFrame:
    """Each row once per strategy with its prompt and response limit, ready for one scoring pass."""
    return with_request(as_strategies(df, strategies), limit)


def for_routed(df: DataFrame, routed: str = "routed_strategy") -> DataFrame:
    """Each row with the prompt and limit of its own routed strategy; no regrouping by strategy."""
    rows = df.withColumn("strategy", F.col(routed))
    return P.with_prompt(rows).withColumn("max_tokens", adaptive_limit(F.col("strategy")))


def unscored(wanted: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("pairID", "strategy")) -> DataFrame:
    """Rows that have no stored prediction yet."""
    return wanted.join(stored.select(*keys), list(keys), "left_anti")


def missing_strategies(df: DataFrame, stored: DataFrame, strategies: list[str], output: str = "missing",
                       key: str = "pairID") -> DataFrame:
    """Rows that lack a stored prediction of some strategy, with an array of those they lack.

    A row meets its stored strategies as one row of flags, so its texts are shuffled once and not once per strategy.
    """
    has = {s: f"_has {i}" for i, s in enumerate(strategies)}
    done = stored.groupBy(key).agg(*[F.max(F.col("strategy") == s).alias(c) for s, c in has.items()])
    lacking = F.filter(F.array(*[F.when(~F.coalesce(F.col(f"`{c}`"), F.lit(False)), F.lit(s)) for s, c in has.items()]),
                       lambda s: s.isNotNull())
    rows = df.join(done, key, "left").select(*df.columns, lacking.alias(output))
    return rows.where(F.size(output) > 0)


def resume(wanted: DataFrame, stored: DataFrame, scorer_pass: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored predictions plus freshly scored ones for what is missing."""
    return stored.unionByName(scorer_pass(unscored(wanted, stored)), allowMissingColumns=True)


# --- summaries -------------------------------------------------------------------------------

def is_retryable(error: Column) -> Column:
    pattern = "|".join(domain.RETRYABLE_ERRORS)
    return F.coalesce(F.lower(error).rlike(pattern), F.lit(False))


def batch_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Successes, failures, tokens, time and retries of scored rows."""
    ok = F.count_if(F.col("success"))
    bad = F.count_if(~F.col("success"))
    retries = F.sum(F.col("attempts") - 1) if "attempts" in df.columns else F.lit(0)
    out = df.groupBy(*keys).agg(
        ok.alias("successful"), bad.alias("failed"),
        F.sum(F.col("prompt_tokens") + F.col("response_tokens")).alias("total_tokens"),
        F.sum("latency_ms").alias("total_time_ms"),
        F.count_if(is_retryable(F.col("error"))).alias("retryable_failures"),
        retries.cast("long").alias("retries"))
    return out.withColumn(
        "success_rate", F.col("successful") / F.greatest(F.col("successful") + F.col("failed"), F.lit(1)))
