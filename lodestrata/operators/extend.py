"""Extension points that run over tables: event handlers, mining passes, derived tables, stacks of steps, equivalence tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import fold_events

# -- event handlers ------------------------------------------------------------------------


@dataclass(frozen=True)
class Handler:
    """A consumer of log events: ``step(state, rows)`` takes at most ``most`` events of a key at a time, in offset order."""

    kinds: tuple[str, ...]
    key: str
    start: Callable[[], Any]
    step: Callable
    finish: Callable
    schema: str
    most: int = 256


HANDLERS: dict[str, Handler] = {}


def subscribe(name: str, handler: Handler) -> None:
    if handler.most < 1:
        raise ValueError("a handler takes at least one event")
    HANDLERS[name] = handler


def deliver(log: DataFrame, name: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """What the consumer makes of its events beyond its offset ``after``, up to and including ``upto``."""
    h = HANDLERS[name]
    events = log.where(F.col("kind").isin(*h.kinds))
    if after is not None:
        events = events.where(F.col("offset") > after)
    if upto is not None:
        events = events.where(F.col("offset") <= upto)
    return fold_events(events, [h.key], ["offset"], h.start, h.step, h.schema, finish=h.finish, most=h.most)


# -- mining passes -------------------------------------------------------------------------

#: A pass takes named tables and gives proposals: subject, kind, confidence.
PASSES: dict[str, tuple[tuple[str, ...], Callable[[Mapping[str, DataFrame]], DataFrame]]] = {}


def register_pass(name: str, inputs: tuple[str, ...], run: Callable[[Mapping[str, DataFrame]], DataFrame]) -> None:
    PASSES[name] = (inputs, run)


def run_passes(tables: Mapping[str, DataFrame], names: Iterable[str], least: float = 0.0) -> DataFrame:
    """pass, subject, kind, confidence: the proposals of all passes that are sure enough, in one plan."""
    out = None
    for name in names:
        inputs, run = PASSES[name]
        if missing := [i for i in inputs if i not in tables]:
            raise KeyError(f"pass {name} lacks {', '.join(missing)}")
        found = run({i: tables[i] for i in inputs}).select(F.lit(name).alias("pass"), F.col("subject").cast("string").alias("subject"), "kind", F.col("confidence").cast("double").alias("confidence"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no pass is named")
    return out.where(F.col("confidence") >= least)


# -- derived tables ------------------------------------------------------------------------

ON_EVENT, ON_REQUEST = "on_event", "on_request"


@dataclass
class Derived:
    owner: str
    kinds: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    policy: str = ON_EVENT
    frontier: int = -1  # the offset that its table stands at


class DerivedRegistry:
    """Tables that follow the log: a tick moves those that follow events; others only tell how far they lag."""

    def __init__(self, log: DataFrame):
        self._log, self._entries = log, {}

    def register(self, name: str, entry: Derived) -> None:
        if entry.policy not in (ON_EVENT, ON_REQUEST):
            raise ValueError(f"no policy {entry.policy}")
        self._entries[name] = entry

    def tick_all(self, upto: int) -> DataFrame:
        """name, policy, events (of its kinds since its frontier), frontier, stale; one aggregate over the new part of the log."""
        spark = self._log.sparkSession
        asked = [(n, e.policy, k, e.frontier) for n, e in self._entries.items() for k in e.kinds]
        wanted = F.broadcast(spark.createDataFrame(asked, "name string, policy string, kind string, was long"))  # a row for each registered kind
        lowest = min((e.frontier for e in self._entries.values()), default=upto)
        new = self._log.where((F.col("offset") > lowest) & (F.col("offset") <= upto)).select("offset", F.col("kind").alias("event_kind"))
        hits = new.join(wanted, (F.col("event_kind") == F.col("kind")) & (F.col("offset") > F.col("was"))).groupBy("name").agg(F.count(F.lit(1)).alias("events"))
        each = spark.createDataFrame([(n, e.policy, e.frontier) for n, e in self._entries.items()], "name string, policy string, was long")
        done = each.join(F.broadcast(hits), "name", "left").withColumn("events", F.coalesce("events", F.lit(0)))
        moved = F.col("policy") == ON_EVENT
        out = done.select("name", "policy", "events", F.when(moved, F.lit(upto)).otherwise(F.col("was")).alias("frontier"), (~moved & (F.col("events") > 0)).alias("stale"))
        for e in self._entries.values():
            if e.policy == ON_EVENT:
                e.frontier = max(e.frontier, upto)
        return out

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """The table at its frontier; with ``upto``, rebuilt to there first."""
        e = self._entries[name]
        if upto is not None:
            e.frontier = max(e.frontier, upto)
        return e.build(self._log.where(F.col("kind").isin(*e.kinds) & (F.col("offset") <= e.frontier)))


# -- stacks of steps -----------------------------------------------------------------------

LOCAL, SANDBOX, EXTERNAL = "local_only", "sandbox", "external"


@dataclass(frozen=True)
class Step:
    """A stage from table to table: the columns it needs, those it adds, and the privacy mode it asks for."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    mode: str | None = None


class InvalidStack(ValueError):
    pass


def validate(plan: list[Step], columns: Iterable[str], mode: str = LOCAL) -> list[tuple[str, str]]:
    """(step, problem): repeated names, needs that nothing before meets, and steps that another mode is for."""
    problems, known, names = [], set(columns), set()
    for step in plan:
        if step.name in names:
            problems.append((step.name, "repeated"))
        names.add(step.name)
        problems += [(step.name, f"lacks {c}") for c in step.needs if c not in known]
        if step.mode not in (None, mode):
            problems.append((step.name, f"asks for {step.mode}"))
        known.update(step.gives)
    return problems


def execute(plan: list[Step], df: DataFrame, mode: str = LOCAL) -> DataFrame:
    """All steps in order, as one plan, with ``attested``: a chain of SHA-256 over the names and what each step gave."""
    if problems := validate(plan, df.columns, mode):
        raise InvalidStack("; ".join(f"{s}: {p}" for s, p in problems))
    df = df.withColumn("attested", F.lit(""))
    for step in plan:
        df = step.run(df)
        if missing := [c for c in step.gives if c not in df.columns]:
            raise InvalidStack(f"{step.name} did not give {', '.join(missing)}")
        given = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in step.gives]
        df = df.withColumn("attested", F.sha2(F.concat_ws("|", F.col("attested"), F.lit(step.name), *given).cast("binary"), 256))
    return df


# -- equivalence ---------------------------------------------------------------------------


def deep_equality(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def top_k_match(k: int = 5) -> Callable[[Column, Column], Column]:
    """The first k ids agree in order, as far as both lists reach; an empty list equals only another one."""

    def test(a: Column, b: Column) -> Column:
        n = F.least(F.lit(k), F.size(a), F.size(b))
        same = F.when(n > 0, F.slice(a, 1, F.greatest(n, F.lit(1))) == F.slice(b, 1, F.greatest(n, F.lit(1)))).otherwise((F.size(a) == 0) & (F.size(b) == 0))
        return F.coalesce(same & a.isNotNull() & b.isNotNull(), F.lit(False))

    return test


EQUIVALENCE: dict[str, Callable[[Column, Column], Column]] = {"deep": deep_equality, "top_5": top_k_match()}
