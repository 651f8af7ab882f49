"""Streaming twins: control-state replay and group sampling as stateful operators, progress as a windowless count.

They keep one small tuple a key. Event time plays no part in the semantics, so there is no watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracksmith.operators.control import ANSWER, DONE, ELICIT, RETRY, SEARCH

STATE = "phase string, aspect int, streak int, max_streak int, fallbacks int, answered int, blocked int, rejected int, turns long"


def step(state: tuple, choice: str, outcome: str, aspects: int = 3, threshold: int = 4) -> tuple:
    """The fold of operators.control on one turn, in plain Python."""
    phase, aspect, streak, most, fallbacks, answered, blocked, rejected, turns = state
    turns += 1
    if phase == DONE:
        return phase, aspect, streak, most, fallbacks, answered, blocked, rejected, turns
    needs = {SEARCH: "search", RETRY: "search", ANSWER: "answer"}.get(phase)
    if needs and choice != needs or phase == ANSWER and outcome != "visible":
        return phase, aspect, streak, most, fallbacks, answered, blocked, rejected + 1, turns
    found, failed = choice == "search" and outcome == "normal", choice == "search" and outcome != "normal"
    seen = choice == "answer" and outcome == "visible"
    idle = phase == ELICIT and (choice == "action" and outcome != "progress" or choice == "answer" and not seen)
    streak = streak + 1 if idle else 0 if found or seen or choice == "action" and outcome == "progress" else streak
    most = max(most, streak)
    if seen or failed and fallbacks >= 1:
        return DONE if aspect + 1 >= aspects else ELICIT, aspect + 1, 0, most, 0, answered + seen, blocked + (not seen), rejected, turns
    phase = ANSWER if found else RETRY if failed else SEARCH if idle and streak >= threshold else phase
    return phase, aspect, streak, most, fallbacks + failed, answered, blocked, rejected, turns


def replay(turns: DataFrame, aspects: int = 3, threshold: int = 4) -> DataFrame:
    """Latest state of each trajectory from a stream of (trajectory, turn, choice, outcome); turns of a batch in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (ELICIT, 0, 0, 0, 0, 0, 0, 0, 0)
        for row in pd.concat(list(parts)).sort_values("turn").itertuples(index=False):
            now = step(now, row.choice, row.outcome, aspects, threshold)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["trajectory", *[c.split()[0] for c in STATE.split(", ")]])

    return turns.groupBy("trajectory").applyInPandasWithState(run, f"trajectory long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def ready_groups(rollouts: DataFrame, size: int) -> DataFrame:
    """(uid, n, spread): groups once they have `size` valid rows of different rewards, each sent out once."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, low, high, sent = state.get if state.exists else (0, float("inf"), float("-inf"), False)
        for part in parts:
            good = part.loc[~part["invalid"], "reward"]
            if len(good):
                n, low, high = n + len(good), min(low, good.min()), max(high, good.max())
        if not sent and n >= size and high - low > 1e-12:
            sent = True
            yield pd.DataFrame([(key[0], n, high - low)], columns=["uid", "n", "spread"])
        state.update((n, float(low), float(high), sent))

    return rollouts.groupBy("uid").applyInPandasWithState(run, "uid long, n long, spread double", "n long, low double, high double, sent boolean", "append", GroupStateTimeout.NoTimeout)


def progress(results: DataFrame) -> DataFrame:
    """One row: total, valid and invalid results so far."""
    return results.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
