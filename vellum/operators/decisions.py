"""The decision log: overrides and manual masks with undo and redo, page states, and the session cache's order."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: Steps that can be undone, and documents that a session keeps.
HISTORY, SESSIONS = 200, 3


def latest(updates: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last update of each key, nulls and all: what an update leaves out is gone."""
    rest = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(*keys, "last.*")


def current_run(updates: DataFrame, doc: str = "doc_id", token: str = "run") -> DataFrame:
    """Without updates of runs that a later run of the document has replaced."""
    newest = updates.groupBy(doc).agg(F.max(token).alias(token))
    return updates.join(newest, [doc, token], "left_semi")


class Decisions:
    """A document's decisions with their history. Steps that change nothing aren't recorded."""

    def __init__(self) -> None:
        self.now: tuple[dict[str, str], tuple[str, ...]] = ({}, ())
        self.past: list = []
        self.future: list = []

    def apply(self, op: str, key: str | None = None, value: str | None = None) -> None:
        overrides, manual = self.now
        if op == "undo" and self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        elif op == "redo" and self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        elif op == "set" and overrides.get(key) != value:
            self._step((overrides | {key: value}, manual))
        elif op == "clear" and key in overrides:
            self._step(({k: v for k, v in overrides.items() if k != key}, manual))
        elif op == "add":
            self._step((overrides, (*manual, key)))
        elif op == "remove" and key in manual:
            self._step((overrides, tuple(k for k in manual if k != key)))

    def _step(self, new: tuple) -> None:
        self.past = [*self.past, self.now][-HISTORY:]
        self.now, self.future = new, []


def replay(log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, key, override, manual, can_undo, can_redo) after all steps (doc, seq, op, key, value) of each document: one row for
    each override and manual mask. A document's log is its user's clicks, and folds in one task."""
    kind = log.schema[doc].dataType.simpleString()

    def fold(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
        d = Decisions()
        for s in steps.sort_values("seq").itertuples():
            d.apply(s.op, s.key, s.value)
        overrides, manual = d.now
        rows = [(key[0], k, v, False) for k, v in sorted(overrides.items())] + [(key[0], k, None, True) for k in manual]
        return pd.DataFrame([(*r, bool(d.past), bool(d.future)) for r in rows], columns=[doc, "key", "override", "manual", "can_undo", "can_redo"])

    return log.groupBy(doc).applyInPandas(fold, f"{doc} {kind}, key string, override string, manual boolean, can_undo boolean, can_redo boolean")


def undo_tail(steps: DataFrame, doc: str = "doc_id", seq: str = "seq", limit: int = HISTORY) -> DataFrame:
    """The last steps of each document, as many as can be undone."""
    rank = F.row_number().over(Win.partitionBy(doc).orderBy(F.col(seq).desc()))
    return steps.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def recent_sessions(opens: DataFrame, user: str, doc: str, seq: str, limit: int = SESSIONS) -> DataFrame:
    """(user, doc, rank): the documents that are still kept after all opens, the latest first."""
    last = opens.groupBy(user, doc).agg(F.max(seq).alias(seq))
    rank = F.row_number().over(Win.partitionBy(user).orderBy(F.col(seq).desc()))
    return last.withColumn("rank", rank).filter(F.col("rank") <= limit).select(user, doc, "rank")


class SessionCache:
    """Persisted analyses of the documents opened last; the oldest is unpersisted when there are too many."""

    def __init__(self, limit: int = SESSIONS):
        self.limit, self.kept = limit, OrderedDict()

    def put(self, hash: str, ocr: bool, analysis: DataFrame) -> None:
        self.kept.setdefault(hash, {})[ocr] = analysis.persist()
        self.kept.move_to_end(hash)
        while len(self.kept) > self.limit:
            for old in self.kept.popitem(last=False)[1].values():
                old.unpersist()

    def get(self, hash: str, ocr: bool) -> DataFrame | None:
        return self.kept.get(hash, {}).get(ocr)


def page_schedule(page: Column, current: Column, n: Column) -> Column:
    """Sort key of pages to work on: the current one, the next, the one before, then those after, then those before."""
    return F.when(page == current, 0).when(page == current + 1, 1).when(page == current - 1, 2).when(page > current, 3 + page).otherwise(3 + n + page)


def override_map(log: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, overrides): the last override of each key as a map; cleared keys aren't in it."""
    now = latest(log, [doc, "key"]).filter(F.col("value").isNotNull())
    return now.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("overrides"))
