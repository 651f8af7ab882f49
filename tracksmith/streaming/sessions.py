"""Live sessions and the bounded sampler as stateful streams: typed state a key, the same rules as their batch twins.

Both are event-ordered within a key and have no event time, so no watermark; they need a state store that takes several
states a key (the RocksDB provider).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracksmith.operators import public_control, sampling
from tracksmith.operators.public_control import Episode, Ledger

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Public control of one session: its aspects' ledgers are a map, what was heard a map of signatures, the rest one value."""

    _VALUE = "at string, mode string, idle long, most_idle long, done boolean, submitted array<string>, last_call string, aspects array<string>"
    _LEDGER = "status string, visible array<string>, normal boolean, attempts long, fallbacks long, queries array<string>, answer string, complete boolean"

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("session", self._VALUE)
        self.ledgers = handle.getMapState("ledgers", "aspect string", self._LEDGER)
        self.heard = handle.getMapState("heard", "kind string, text string, ids string", "seen boolean")

    def _episode(self, message: str | None) -> Episode:
        if not self.value.exists():
            return Episode.begin(message or "", self.limit)
        at, mode, idle, most, done, submitted, last, aspects = self.value.get()
        held = {k[0]: Ledger(v[0], set(v[1]), v[2], int(v[3]), int(v[4]), list(v[5]), v[6], v[7]) for k, v in self.ledgers.iterator()}
        episode = Episode({a: held[a] for a in aspects}, self.limit, at, mode, int(idle), int(most), done, list(submitted), last)
        episode.heard = {(k[0], k[1], frozenset(k[2].split())) for k, _ in self.heard.iterator()}
        return episode

    def _keep(self, episode: Episode, known: set[tuple]) -> None:
        self.value.update((episode.at, episode.mode, episode.idle, episode.most_idle, episode.done, episode.submitted, episode.last_call, list(episode.ledgers)))
        for aspect, x in episode.ledgers.items():
            self.ledgers.updateValue((aspect,), (x.status, sorted(x.visible), x.normal, x.attempts, x.fallbacks, x.queries, x.answer, x.complete))
        for kind, text, ids in episode.heard - known:
            self.heard.updateValue((kind, text, " ".join(sorted(ids))), (True,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at")
        text = lambda v: v if isinstance(v, str) else None
        episode = self._episode(text(events["message"].iloc[0]))
        known, out = set(episode.heard), []
        for e in events.itertuples(index=False):
            refusal = episode.event(e.kind, *map(text, (e.choice, e.content, e.feedback, e.aspect)))
            out.append((key[0], e.at, *public_control.live_row(episode, refusal)))
        self._keep(episode, known)
        yield pd.DataFrame(out, columns=["trajectory", "at", *[c.split()[0] for c in public_control.LIVE.split(", ")]])

    def close(self) -> None:
        pass


def live(events: DataFrame, limit: int = 4) -> DataFrame:
    """public_control.live() on a stream: a row an event, with the state after it. Events of a key come in order of `at`."""
    return events.groupBy("trajectory").transformWithStateInPandas(statefulProcessor=Sessions(limit), outputStructType=f"trajectory long, at long, {public_control.LIVE}", outputMode="append", timeMode="none")


class Sampler(StatefulProcessor):
    """One run of the bounded sampler: the pool of the update at hand is a list, the run's place and streak one value."""

    _ROW = "uid long, batch long, reward double, invalid boolean, degraded boolean"

    def __init__(self, rows_a_batch: int, size: int, required: int, batches: int, most_skips: int, tolerance: float) -> None:
        self.rows_a_batch, self.size, self.required, self.batches, self.most_skips, self.tolerance = rows_a_batch, size, required, batches, most_skips, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "update long, decided boolean, skips long, ended boolean")
        self.pool = handle.getListState("pool", self._ROW)

    def _ready(self, rows: list[tuple]) -> bool:
        clean = [r[2] for r in rows if not r[4]]
        rewards = clean if len(clean) >= self.size else [r[2] for r in rows]
        return len(rewards) >= self.size and max(rewards) - min(rewards) > self.tolerance

    def _judge(self, pool: list[tuple], last: int) -> bool:
        by: dict[int, list[tuple]] = {}
        for row in pool:
            by.setdefault(row[0], [])
            if not row[3] and row[1] <= last:
                by[row[0]].append(row)
        return len(by) == self.required and all(self._ready(rows) for rows in by.values())

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        update, decided, skips, ended = self.place.get() if self.place.exists() else (-1, True, 0, False)
        pool, out = [tuple(r) for r in self.pool.get()] if self.pool.exists() else [], []
        for r in pd.concat(list(rows)).sort_values(["update", "batch", "uid"]).itertuples(index=False):
            if ended or r.update < update or r.update == update and decided or r.batch >= self.batches:
                continue
            if r.update > update:
                update, decided, pool = int(r.update), False, []
            pool.append((int(r.uid), int(r.batch), float(r.reward), bool(r.invalid), bool(r.degraded)))
            if sum(p[1] == r.batch for p in pool) < self.rows_a_batch:
                continue  # the generation batch isn't whole yet
            trains = self._judge(pool, int(r.batch))
            if trains or r.batch == self.batches - 1:
                decided, skips = True, 0 if trains else skips + 1
                ended = skips > self.most_skips
                out.append((key[0], update, "trained" if trains else "exhausted" if ended else "skipped", int(r.batch) + 1, skips))
        self.place.update((update, decided, skips, ended))
        self.pool.clear()
        if pool and not decided:
            self.pool.put(pool)
        yield pd.DataFrame(out, columns=["run", "update", "status", "sampled_batches", "consecutive_skips"])

    def close(self) -> None:
        pass


def updates(rollouts: DataFrame, rows_a_batch: int, size: int = sampling.SIZE, required: int = sampling.REQUIRED, batches: int = sampling.BATCHES, most_skips: int = sampling.SKIPS, tolerance: float = sampling.TOLERANCE) -> DataFrame:
    """sampling.updates() on a stream: (run, update, status, sampled_batches, consecutive_skips) as soon as an update is decided.

    A generation batch is whole with rows_a_batch rows; a run's batches come in order. After the limit of skips a run is over.
    """
    processor = Sampler(rows_a_batch, size, required, batches, most_skips, tolerance)
    return rollouts.groupBy("run").transformWithStateInPandas(statefulProcessor=processor, outputStructType="run long, update long, status string, sampled_batches long, consecutive_skips long", outputMode="append", timeMode="none")
