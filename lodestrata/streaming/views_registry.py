"""Views by name: how a view is declared, built in batch and, where it has one, as a stream; and a bridge to feed and query them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views as V
from ..sources import fixtures as X
from ..sources.tables import NOW_MS
from . import views as S


@dataclass(frozen=True)
class View:
    """A named fold of the log: the event kinds it reads, its key, its batch form and maybe its streaming form."""

    name: str
    kinds: tuple[str, ...]
    key: str
    build: Callable[[DataFrame], DataFrame]
    stream: Callable[[DataFrame], DataFrame] | None = None


_ALL = ("signup", "view", "click", "purchase", "error")
VIEWS = {
    v.name: v
    for v in (
        View("current_nodes", ("signup", "purchase"), "node_id", lambda log: V.current_nodes(X.node_events(log))),
        View("current_edges", ("view", "error", "signup"), "edge_id", lambda log: V.current_edges(X.edge_events(log))),
        View("current_interpretations", ("purchase",), "interpretation_id", V.current_interpretations),
        View("current_schemas", ("purchase",), "schema_id", lambda log: V.current_schemas(X.induced_schemas(log))),
        View("heat_field", ("signup", "view", "click", "purchase"), "node_id", lambda log: V.heat_field(log, NOW_MS), S.heat),
        View("velocity_field", ("view", "click"), "node_id", lambda log: V.velocity_field(log, NOW_MS), S.access_counts),
        View("active_periods", ("signup", "purchase"), "period_id", V.active_periods),
        View("canon_set", ("signup", "purchase"), "node_id", V.canon_set),
        View("open_contradictions", ("error", "signup"), "edge_id", lambda log: V.open_contradictions(X.contradiction_events(log))),
        View("pending_review", _ALL, "item_id", V.pending_review),
        View("match_cache", ("view", "click"), "match_id", lambda log: V.match_cache(*X.match_events(log)), S.matches),
        View("matched_against", ("view", "click"), "match_id", lambda log: V.matched_against(*X.match_events(log))),
        View("invalidation_set", ("error", "signup"), "node_id", V.invalidation_set),
    )
}


class Bridge:
    """Feeds a log up to a logical time and answers from the views at that frontier; results are plain DataFrames."""

    def __init__(self, log: DataFrame):
        self._log, self._frontier = log, -1

    def feed(self, more: DataFrame) -> None:
        self._log = self._log.unionByName(more)

    def advance_to(self, offset: int) -> None:
        if offset < self._frontier:
            raise ValueError("time does not go back")
        self._frontier = offset

    @property
    def frontier(self) -> int:
        return self._frontier

    def snapshot(self, name: str) -> DataFrame:
        view = VIEWS[name]
        return view.build(self._log.where((F.col("offset") <= self._frontier) & F.col("event_type").isin(*view.kinds)))

    def query(self, name: str, key) -> DataFrame:
        return self.snapshot(name).where(F.col(VIEWS[name].key) == key)

    def register(self) -> list[str]:
        """All views as temp views for Spark SQL."""
        for name in VIEWS:
            self.snapshot(name).createOrReplaceTempView(name)
        return sorted(VIEWS)
