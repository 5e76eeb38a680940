"""Iteration operators: bulk (I1, I2), delta (I3) and staged (I4-I6) loops.

The loop runs on the driver; every superstep is ordinary Spark jobs over
DataFrames.  Lineage is cut each step by a state store:

* ``CheckpointStore`` - reliable ``checkpoint()`` into the session's shared
  ``spark.checkpoint.dir`` (the "native" iteration).
* ``ParquetStore`` - one Parquet directory per step and output (the
  "staged" iteration: one job per step, state through files).
* ``BucketStore`` - Parquet tables hash-bucketed by the state's key and sorted
  in every bucket: read without a shuffle, and a filter on few keys reads the
  buckets and pages that hold them only.

All survive the loss of an executor: the state lives in shared storage,
never in executor memory only.  Row counts per output and step come from an
``Observation`` attached to the very action that materialises the state, so
the stop test costs no extra job (A10, I5).
"""

from __future__ import annotations

import functools
import inspect
import itertools
import json
import time
import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from typing import Callable, Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stepwise.session import checkpoint_dir

_obs_ids = itertools.count()

# Small pages, so that a filter on few keys of sorted files skips most rows; sorted
# keys are stored as differences, as a state is written anew in every large step.
PAGES = {"parquet.page.row.count.limit": "512", "parquet.writer.version": "v2", "compression": "zstd"}
# A workset of at most so many rows is looked up by its keys (a tail step).
TAIL_ROWS = 1000


class StateStore(Protocol):
    keeps_layout: bool      # whether saved state is still hash-partitioned

    def save(self, df: DataFrame, name: str, iteration: int) -> DataFrame: ...


class CheckpointStore:
    """Native iteration state: eager reliable checkpoint (shared storage).

    State saved from a plan without adaptive execution keeps the hash
    partitioning of that plan.
    """

    keeps_layout = True

    def save(self, df: DataFrame, name: str, iteration: int) -> DataFrame:
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)


class ParquetStore:
    """Staged iteration state: ``<root>/<name>/iteration_<i>`` Parquet."""

    keeps_layout = False

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str, iteration: int) -> str:
        return f"{self.root}/{name}/iteration_{iteration}"

    def save(self, df: DataFrame, name: str, iteration: int) -> DataFrame:
        p = self.path(name, iteration)
        df.write.mode("overwrite").parquet(p)
        return df.sparkSession.read.schema(df.schema).parquet(p)

    def load(self, spark: SparkSession, entry: dict) -> DataFrame:
        """A state that an earlier loop saved, by its entry in a commit record."""
        return spark.read.schema(entry["columns"]).parquet(self.path(entry["name"], entry["iteration"]))


class BucketStore:
    """Iteration state as tables hash-bucketed by ``key`` and sorted by it.

    Reading a table back needs no shuffle in a plan of ``buckets`` shuffle
    partitions.  With ``root`` the files are ``<root>/<name>/iteration_<i>`` and
    stay; without, they lie in the shared checkpoint folder, ``drop`` deletes a
    state that is no longer read and ``close`` all of them.
    """

    keeps_layout = True

    def __init__(self, spark: SparkSession, key: str, buckets: int, root: str | None = None):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.root = root.rstrip("/") if root else None
        self.database = f"stepwise_{uuid.uuid4().hex}"
        place = f"{checkpoint_dir(spark).rstrip('/')}/{self.database}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{place}'")

    def table(self, name: str, iteration: int) -> str:
        return f"{self.database}.{name.replace('-', '_')}_{iteration}"

    def save(self, df: DataFrame, name: str, iteration: int) -> DataFrame:
        table = self.table(name, iteration)
        writer = df.write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key)
        for k, v in PAGES.items():
            writer = writer.option(k, v)
        if self.root:
            writer = writer.option("path", f"{self.root}/{name}/iteration_{iteration}")
        writer.saveAsTable(table)
        return self.spark.table(table)

    def load(self, spark: SparkSession, entry: dict) -> DataFrame:
        """A state that an earlier loop saved under ``root``, with the buckets it was written in."""
        path = f"{self.root}/{entry['name']}/iteration_{entry['iteration']}"
        if not entry["buckets"]:
            return spark.read.schema(entry["columns"]).parquet(path)
        table = self.table(entry["name"], entry["iteration"])
        spark.sql(f"CREATE TABLE {table} ({entry['columns']}) USING parquet CLUSTERED BY ({self.key}) "
                  f"SORTED BY ({self.key}) INTO {entry['buckets']} BUCKETS LOCATION '{path}'")
        return spark.table(table)

    def drop(self, name: str, iteration: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name, iteration)}")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


class DriverStore:
    """State of a few rows (centers, parameters) kept on the driver.

    For steps that give no more rows than the state they start from, whose
    size the caller has checked; more than ``limit`` rows are an error all the
    same.  ``last`` holds the rows for the next step's plan.  ``then`` writes
    the state somewhere first and reads it back.
    """

    keeps_layout = False

    def __init__(self, limit: int, then: StateStore | None = None):
        self.limit, self.then, self.last = limit, then, None

    def save(self, df: DataFrame, name: str, iteration: int) -> DataFrame:
        if self.then:
            df = self.then.save(df.coalesce(1), name, iteration)
        rows = df.take(self.limit + 1)
        if len(rows) > self.limit:
            raise ValueError(f"{name}: more than {self.limit} rows for the driver")
        self.last = rows
        return df.sparkSession.createDataFrame(rows, df.schema)

    @property
    def root(self) -> str | None:
        return getattr(self.then, "root", None)

    def load(self, spark: SparkSession, entry: dict) -> DataFrame:
        df = self.then.load(spark, entry)
        self.last = df.take(self.limit + 1)
        return df


class Commits:
    """What a staged loop has finished, ``<root>/<name>-commits``.

    A record is written after everything a superstep saves, and a superstep
    overwrites no state that the record before it names; so the last record is
    always a state to go on from, whenever the loop was stopped.  A record is
    one row whatever the size of the state: counts, and for every state the
    place, columns and buckets of its files.
    """

    SCHEMA = "iteration int, final boolean, record string"

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-commits"

    def _rows(self, n: int, *values) -> DataFrame:
        named = zip(("iteration", "final", "record"), values)
        return self.spark.range(0, n, 1, 1).select(*[F.lit(v).alias(c) for c, v in named])

    def start(self) -> None:
        """A new loop: earlier records in the folder no longer hold."""
        self._rows(0, 0, False, "").write.mode("overwrite").parquet(self.path)

    def write(self, iteration: int, final: bool = False, **record) -> None:
        self._rows(1, iteration, final, json.dumps(record)).write.mode("append").parquet(self.path)

    def last(self) -> dict | None:
        """The last record; None if no superstep was finished."""
        try:
            got = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = got.orderBy(F.desc("iteration"), F.desc("final")).first()
        return row and {"iteration": row["iteration"], **json.loads(row["record"])}

    @staticmethod
    def entry(store: StateStore, saved: DataFrame, name: str, iteration: int, flag: str | None = None) -> dict:
        """How to find a saved state again; ``flag`` marks the rows that are the workset."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in saved.schema)
        return {"name": name, "iteration": iteration, "columns": columns, "flag": flag,
                "buckets": getattr(store, "buckets", None)}


def _commits(spark: SparkSession, store: StateStore, name: str, resume: bool) -> tuple[Commits | None, dict | None]:
    """The commit records of a loop, if its store keeps every step, and the record to go on from."""
    root = getattr(store, "root", None)
    if not root:
        if resume:
            raise ValueError("only a loop whose store keeps every step can be resumed")
        return None, None
    book = Commits(spark, root, name)
    record = book.last() if resume else None
    if record is None:
        book.start()
    return book, record


@dataclass
class IterationResult:
    """Outcome of a loop: final state, steps run, convergence and counters."""
    df: DataFrame
    iterations: int
    converged: bool
    counts: list = field(default_factory=list)   # (operator, iteration, rows)
    extra: dict = field(default_factory=dict)
    partition_counts: list = field(default_factory=list)  # one DataFrame per step, see partition_stats
    step_ms: list = field(default_factory=list)           # (iteration, wall-clock ms)

    def stats(self, spark: SparkSession | None = None) -> DataFrame:
        """M1 totals as a DataFrame ``operator, iteration, rows``."""
        spark = spark or self.df.sparkSession
        return spark.createDataFrame(
            self.counts, "operator string, iteration int, rows long")

    def summary(self, spark: SparkSession | None = None) -> DataFrame:
        """M5 for this loop: per iteration the wall-clock runtime, the rows
        each output had, and the step's shuffle parallelism."""
        spark = spark or self.df.sparkSession
        rows = {}
        for op, i, n in self.counts:
            rows.setdefault(i, {})[op] = n
        data = [(i, ms, par, rows.get(i, {})) for i, ms, par in self.step_ms]
        return spark.createDataFrame(
            data, "iteration int, runtime_ms long, parallelism int, rows map<string,long>")

    def partition_stats(self) -> DataFrame:
        """M1 per subtask (needs ``partition_stats=True`` on the loop): a
        distributed table ``operator, iteration, partition, rows``."""
        return functools.reduce(DataFrame.unionByName, self.partition_counts)


def save_counted(df: DataFrame, store: StateStore, name: str, iteration: int,
                 flag: str | None = None, keep_flag: bool = False) -> tuple[DataFrame, int, int | None]:
    """Materialise ``df`` through ``store`` and count it in the same job.

    With ``flag`` (a boolean column) the number of true flags is observed as
    well and the column is dropped from the returned state unless kept.
    """
    metrics = [F.count(F.lit(1)).alias("rows")]
    if flag:
        metrics.append(F.sum(F.col(flag).cast("long")).alias("flagged"))
    obs = Observation(f"{name}_{iteration}_{next(_obs_ids)}")
    saved = store.save(df.observe(obs, *metrics), name, iteration)
    got = obs.get
    if not flag:
        return saved, int(got["rows"]), None
    return saved if keep_flag else saved.drop(flag), int(got["rows"]), int(got.get("flagged") or 0)


def _extras(step, **offered) -> dict:
    """The offered arguments that a step takes.

    ``rows``: the measured row count of its input state (workset) from the
    previous step, e.g. to broadcast a small workset.  ``meter``: counts an
    intermediate output.
    """
    takes = inspect.signature(step).parameters
    return {k: v for k, v in offered.items() if k in takes}


class Meter:
    """Counts rows of a step's operators in the job that runs the step (M1)."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def __call__(self, df: DataFrame, operator: str, where=None) -> DataFrame:
        """``df`` with its rows (those with ``where``) counted."""
        obs = Observation(f"{operator}_{next(_obs_ids)}")
        self._seen.append((operator, obs))
        return df.observe(obs, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("rows"))

    def take(self, iteration: int) -> list[tuple[str, int, int]]:
        """Counters since the last call."""
        # adaptive execution drops an operator whose input turned out empty; it has no metrics
        got = [(op, iteration, int(obs.get["rows"]) if obs._jo.getRow().schema() else 0)
               for op, obs in self._seen]
        self._seen = []
        return got


class NoMeter:
    """Stands for a ``Meter`` where nobody asks for counters; they cost a few percent of a step."""

    def __call__(self, df: DataFrame, operator: str, where=None) -> DataFrame:
        return df

    def take(self, iteration: int) -> list:
        return []


@contextmanager
def _conf(spark: SparkSession, **settings):
    """Session settings (dots written as ``__``) for the time of a step."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@contextmanager
def step_plan(spark: SparkSession, partitions, i: int, prev_rows: int | None = None,
              layout: int | None = None):
    """The shuffle parallelism of superstep ``i``, yielded.

    ``partitions`` is ``f(i)`` or ``f(i, rows of the previous step)``; its
    value is the ``spark.sql.shuffle.partitions`` used while the step is
    planned and run (AQE may still coalesce), restored afterwards; its
    ``watch(i, n)``, if it has one, goes around the step.  Without
    one, ``layout`` plans the step for exactly that many partitions and
    without adaptive execution, so saved state keeps its partitioning and the
    next step does not shuffle it again.
    """
    n = None
    if partitions is not None:
        takes_rows = len(inspect.signature(partitions).parameters) >= 2
        n = partitions(i, prev_rows) if takes_rows else partitions(i)
    if n:
        watch = getattr(partitions, "watch", lambda *_: nullcontext())
        with _conf(spark, spark__sql__shuffle__partitions=str(int(n))), watch(i, int(n)):
            yield int(n)
    elif layout:
        with _conf(spark, spark__sql__shuffle__partitions=str(layout), spark__sql__adaptive__enabled="false"):
            yield layout
    else:
        yield _shuffle_parts(spark)


def by_rows(rows_per_partition: int, minimum: int = 1, maximum: int | None = None):
    """Adaptive parallelism (E6, E8): partitions for the next step from the
    rows the previous step produced, ``ceil(rows / rows_per_partition)``
    clamped to ``[minimum, maximum]``; the first step keeps its partitioning."""
    def choose(i: int, prev_rows: int | None = None) -> int | None:
        if prev_rows is None:
            return None
        n = max(minimum, -(-prev_rows // rows_per_partition))
        return min(n, maximum) if maximum else n
    return choose


def bulk_iterate(initial: DataFrame,
                 step: Callable[[DataFrame, int], DataFrame],
                 max_iter: int, *,
                 stop_flag: str | None = None,
                 store: StateStore | None = None,
                 partitions: Callable[[int], int | None] | None = None,
                 layout: int | None = None,
                 initial_rows: int | None = None,
                 resume: bool = False,
                 name: str = "state") -> IterationResult:
    """Bulk iteration: the whole state is replaced every superstep.

    ``step(state, i[, rows=n][, meter=m])`` returns the next state.  Without
    ``stop_flag`` the loop runs exactly ``max_iter`` steps (I1).  With it, the
    step adds a boolean column of that name; the loop ends after the first
    step in which no row has it set (I2: "criterion data set is empty"), or at
    ``max_iter``.  Superstep numbers start at 1.

    With a store that keeps every step, ``resume`` goes on after the last
    superstep that was finished in its folder (from the start if none was);
    ``counts`` include the earlier steps, ``step_ms`` does not.
    """
    store = store or CheckpointStore()
    state, rows, converged, i = initial, initial_rows, False, 0
    spark = initial.sparkSession
    counts, times, meter = [], [], Meter()
    book, record = _commits(spark, store, name, resume)
    if record:
        i, rows, converged = record["iteration"], record["rows"], record["converged"]
        counts = [tuple(c) for c in record["counts"]]
        state = store.load(spark, record["state"])
    for i in range(i + 1, i + 1 if converged else max_iter + 1):
        t0 = time.perf_counter()
        with step_plan(spark, partitions, i, rows, layout if store.keeps_layout else None) as par:
            nxt = step(state, i, **_extras(step, rows=rows, meter=meter))
            state, rows, flagged = save_counted(nxt, store, name, i, stop_flag)
        times.append((i, int((time.perf_counter() - t0) * 1000), par))
        counts += meter.take(i) + [(name, i, rows)]
        if stop_flag:
            counts.append((name + "-criterion", i, flagged))
            converged = flagged == 0
        if book:
            book.write(i, rows=rows, converged=converged, counts=counts, state=book.entry(store, state, name, i))
        if converged:
            break
    return IterationResult(state, i, converged, counts, step_ms=times)


def _shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def upsert(solution: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """New value where the delta has the key, else the old one.

    A full outer join, so keys new to the solution set are inserted, as a
    solution-set merge does.
    """
    cols = [c for c in solution.columns if c != key]
    d = delta.select(key, F.lit(True).alias("__has"),
                     *[F.col(c).alias("__new_" + c) for c in cols])
    has_new = F.col("__has").isNotNull()
    joined = solution.join(d, key, "full_outer")
    return joined.select(key, *[
        F.when(has_new, F.col("__new_" + c)).otherwise(F.col(c)).alias(c) for c in cols])


def newest(log: list[DataFrame], key: str) -> DataFrame:
    """One row per key of a log of deltas, the latest."""
    if len(log) == 1:
        return log[0]
    cols = [c for c in log[0].columns if c != key]
    tagged = [d.select(key, F.struct(*cols).alias("row"), F.lit(i).alias("at")) for i, d in enumerate(log)]
    return (functools.reduce(DataFrame.unionByName, tagged).groupBy(key)
            .agg(F.max_by("row", "at").alias("row")).select(key, "row.*"))


def delta_iterate(solution: DataFrame, workset: DataFrame,
                  step: Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]],
                  max_iter: int, *, key: str,
                  merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                  fold: Callable[[list[DataFrame]], DataFrame] | None = None,
                  rewrite: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None,
                  tail: Callable[[DataFrame, list, int], list | None] | None = None,
                  store: StateStore | None = None,
                  compact_share: float = 0.2,
                  save_final: bool = True,
                  partitions: Callable[[int], int | None] | None = None,
                  layout: int | None = None,
                  counters: bool = False,
                  partition_stats: bool = False,
                  initial_rows: int | None = None,
                  resume: bool = False,
                  name: str = "delta") -> IterationResult:
    """Delta iteration (I3): keyed solution set plus a shrinking workset.

    ``step(solution, workset, i[, rows=n][, meter=m])`` returns ``(delta,
    next_workset)``; the loop ends when the next workset is empty, or at
    ``max_iter``.  The size of the first workset is counted too
    (``<name>-initial``, A9); ``counters`` counts what the step meters as well.

    The solution is a saved base and a log of saved deltas.  ``fold`` makes one
    delta of the log (default: the latest row per key) and ``merge`` puts it
    into the base (default: upsert by key) whenever the solution is read.  The
    base is saved anew when the log has more rows than ``compact_share`` of the
    solution (``initial_rows`` until it has been saved once; every step without
    either), and, with ``save_final``, at the end.

    Two forms of a step follow the size of the workset.  ``rewrite(solution,
    workset, i)`` gives the whole next solution with a boolean column
    ``changed``: for a workset above ``compact_share``, whose delta would
    trigger a save anyway, solution and delta are written by one job.
    ``tail(solution, rows, i)`` gets a workset of at most ``TAIL_ROWS`` rows on
    the driver and returns the rows of the delta, or None to decline; such a
    step can look its keys up instead of scanning, and writes nothing unless
    the store is to keep every step (``keeps_steps``).

    With a store that keeps every step, ``resume`` goes on after the last
    superstep that was finished in its folder (from the start if none was):
    base, log and workset are read from the files its commit record names.
    The caller gives the same first solution and workset as before.  ``counts``
    include the earlier steps, ``step_ms`` and ``partition_counts`` do not.
    """
    store = store or CheckpointStore()
    merge = merge or (lambda s, d: upsert(s, d, key))
    fold = fold or (lambda log: newest(log, key))
    spark = solution.sparkSession
    drop = getattr(store, "drop", lambda *_: None)
    keeps_steps = getattr(store, "root", None) is not None
    converged = False
    i, n_ws, n_base = 0, initial_rows, initial_rows
    base, log, n_log, rows, held = solution, [], 0, None, []
    counts, per_part, times = [], [], []
    meter = Meter() if counters else NoMeter()
    if n_ws is not None:
        counts.append((name + "-initial", 0, n_ws))
    # where base, log and workset lie, for the commit record
    files = {"base": None, "log": [], "workset": None}
    book, record = _commits(spark, store, name, resume)
    if record:
        i, converged, files = record["iteration"], record["converged"], record["files"]
        counts = [tuple(c) for c in record["counts"]]
        n_ws, n_base, n_log = record["sizes"]
        loaded = {}

        def load(entry: dict) -> DataFrame:
            at = entry["name"], entry["iteration"]
            if at not in loaded:
                loaded[at] = store.load(spark, entry)
            return loaded[at]

        if files["base"]:
            base = load(files["base"]).select(*solution.columns)
        log = [load(e).select(*workset.columns) for e in files["log"]]
        if files["workset"]:
            flag = files["workset"]["flag"]
            workset = load(files["workset"])
            workset = workset.where(flag).drop(flag) if flag else workset
        if tail and n_ws <= TAIL_ROWS:
            rows = workset.collect()

    def commit(final: bool = False) -> None:
        if book:
            book.write(i, final, converged=converged, counts=counts, sizes=[n_ws, n_base, n_log], files=files)

    def current() -> DataFrame:
        return merge(base, fold(log)) if log else base

    def compacted(df: DataFrame, step_no: int, flag: str | None = None):
        """Save a new base; what it was made of is no longer read."""
        nonlocal base, log, n_log, n_base, held
        saved, n_base, flagged = save_counted(df, store, name + "-solution", step_no, flag, keep_flag=True)
        counts.append((name + "-solution", step_no, n_base))
        stale, held = held, [(name + "-solution", step_no)]
        base, log, n_log = saved.drop(flag) if flag else saved, [], 0
        files["base"], files["log"] = Commits.entry(store, saved, name + "-solution", step_no, flag), []
        return saved, flagged, stale

    for i in range(i + 1, i + 1 if converged else max_iter + 1):
        t0 = time.perf_counter()
        stale, done = [], None
        with step_plan(spark, partitions, i, n_ws, layout if store.keeps_layout else None) as par:
            large = n_ws is None or n_base is None or n_ws > compact_share * n_base
            if tail and rows is not None:
                with _conf(spark, spark__sql__parquet__pushdown__inFilterThreshold=str(TAIL_ROWS)):
                    done = tail(current(), rows, i, **_extras(tail, meter=meter))
            if done is not None:
                schema, rows, n_ws = workset.schema, done, len(done)
                workset = spark.createDataFrame(done, schema)
                if keeps_steps and n_ws:
                    workset = store.save(workset.coalesce(1), name + "-delta", i)
                    files["workset"] = Commits.entry(store, workset, name + "-delta", i)
                    files["log"] = [*files["log"], files["workset"]]
                counts += meter.take(i) + [(name + "-delta", i, n_ws)]
                if partition_stats:
                    per_part.append(partition_counts(workset, name + "-delta", i))
                if n_ws:
                    log, n_log = [*log, workset], n_log + n_ws
                rows = rows if n_ws <= TAIL_ROWS else None
            elif rewrite and large:
                nxt = rewrite(current(), workset, i, **_extras(rewrite, rows=n_ws, meter=meter))
                saved, n_ws, stale = compacted(nxt, i, "changed")
                workset, files["workset"] = saved.where("changed").drop("changed"), files["base"]
                counts += meter.take(i) + [(name + "-delta", i, n_ws)]
                if partition_stats:
                    per_part.append(partition_counts(workset, name + "-delta", i))
            else:
                delta, next_ws = step(current(), workset, i, **_extras(step, rows=n_ws, meter=meter))
                same = next_ws is delta
                delta, n_delta, _ = save_counted(delta, store, name + "-delta", i)
                held.append((name + "-delta", i))
                counts += meter.take(i) + [(name + "-delta", i, n_delta)]
                if partition_stats:
                    per_part.append(partition_counts(delta, name + "-delta", i))
                found = Commits.entry(store, delta, name + "-delta", i)
                if same:
                    workset, n_ws, files["workset"] = delta, n_delta, found
                else:
                    workset, n_ws, _ = save_counted(next_ws, store, name + "-workset", i)
                    counts.append((name + "-workset", i, n_ws))
                    files["workset"] = Commits.entry(store, workset, name + "-workset", i)
                if n_delta:
                    log, n_log = [*log, delta], n_log + n_delta
                    files["log"] = [*files["log"], found]
            if n_log and (n_base is None or n_log > compact_share * n_base):
                _, _, stale = compacted(current(), i)
                # the last delta is still read as the workset
                held += [x for x in stale if x == (name + "-delta", i)]
            if tail and done is None and n_ws <= TAIL_ROWS:
                rows = workset.collect()
            if not keeps_steps and not partition_stats:
                for x in stale:
                    if x not in held:
                        drop(*x)
        converged = n_ws == 0
        commit()
        times.append((i, int((time.perf_counter() - t0) * 1000), par))
        if converged:
            break
    if log and save_final:
        with step_plan(spark, partitions, i, n_ws, layout if store.keeps_layout else None):
            compacted(current(), i)
        commit(final=True)
    return IterationResult(current(), i, converged, counts, partition_counts=per_part,
                           step_ms=times)


def partition_counts(df: DataFrame, operator: str, iteration: int) -> DataFrame:
    """M1 per subtask: rows per partition of a materialised output.

    One narrow, partial-aggregated pass over the saved state when it is read;
    use it for diagnostics, the loop totals come from observations for free.
    """
    return (df.groupBy(F.spark_partition_id().alias("partition"))
              .agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(operator).alias("operator"),
                      F.lit(iteration).alias("iteration"), "partition", "rows"))
