"""Control of an episode from what is public: calls (choice, content), their feedback and the user's first message.

An episode keeps a ledger for each aspect that the first message names. Its phase says what the next call must be; calls
that a phase doesn't allow are refused. walk() folds the turns of each trajectory, one row a turn; replay(), boundaries() and
phase_counts() are taken from it. A trajectory is folded in one task and must fit it; trajectories need not.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracksmith.functions.expr import OPTION_IDS, PREFIXES
from tracksmith.operators.transcripts import ASPECT_HINTS, FALLBACKS

ELICIT, SEARCH, RETRY, ANSWER, SWITCH, BLOCKED, NONE = "eliciting", "search_required", "search_retry_required", "answer_required", "switch_aspect_required", "blocked", "none"
OPEN, ANSWERED = "open", "answered"
# Reasons to refuse a call.
REFUSED = {
    "closed": "public aspect {!r} is terminal",
    "done": "public control episode is complete",
    "switch": "advance to the next public aspect before another tool call",
    "nameless": "no publicly named aspect is available for this call",
    "elsewhere": "search or answer must target the current public aspect",
    "search_only": "SEARCH_REQUIRED accepts choice=search only",
    "retry_only": "SEARCH_RETRY_REQUIRED accepts one revised search only",
    "no_query": "SEARCH_RETRY_REQUIRED is missing the previous public query",
    "tried": "search query was already attempted for this public aspect",
    "same_query": "retry query must materially change the previous public query",
    "answer_only": "ANSWER_REQUIRED accepts choice=answer only",
    "one_option": "answer must contain exactly one official option ID",
    "not_visible": "answer ID is not visible in the current candidate list",
    "other_option": "answer ID belongs to a different public aspect",
}
# Phrases of a user without a preference.
NO_PREFERENCE = ("no specific preference", "do not have specific preference", "don't have specific preference", "no particular preference", "no preference", "without a preference", "any preference is fine", "open to any")
_OPTION = re.compile(OPTION_IDS)


def _plain(text: str) -> str:
    return " ".join(text.split()).casefold()


def query_words(content: str) -> str:
    words = re.findall("[a-z0-9]+", content.casefold())
    return " ".join(words[1:] if words[:1] == ["search"] else words)


def changed(before: str, after: str) -> bool:
    """Whether two queries have words, and not the same ones as often."""
    return bool(before and after) and Counter(before.split()) != Counter(after.split())


def options(content: str) -> list[str]:
    return [x for x in map(str.strip, content.split(",")) if x]


def option_aspect(option: str) -> str | None:
    return PREFIXES.get(option[0]) if re.fullmatch("[ACFHR][0-9]+", option) else None


def observe(choice: str, feedback: str) -> tuple[str, frozenset[str]]:
    """Kind of an observation and the option ids in it; a phrase of a failing backend goes before ids."""
    ids = frozenset(_OPTION.findall(feedback))
    if any(p in _plain(feedback) for p in FALLBACKS):
        return ("search_fallback" if choice == "search" else "fallback"), ids
    return ("text" if choice != "search" else "search_normal" if ids else "search_empty"), ids


def _first(text: str, hints: list[str]) -> int | None:
    """Where the first hint of the list that occurs stands."""
    for hint in hints:
        found = re.search(rf"(?<![a-z0-9]){r'\s+'.join(map(re.escape, hint.split()))}(?![a-z0-9])", text, re.I)
        if found:
            return found.start()
    return None


def named(text: str, hints: dict[str, list[str]] = ASPECT_HINTS) -> list[str]:
    """Aspects in order of mention, ties by name."""
    places = {a: _first(text, words) for a, words in hints.items()}
    return sorted((a for a, at in places.items() if at is not None), key=lambda a: (places[a], a))


@dataclass
class Ledger:
    """What is public of one aspect."""

    status: str = OPEN
    visible: set[str] = field(default_factory=set)
    normal: bool = False
    attempts: int = 0
    fallbacks: int = 0
    queries: list[str] = field(default_factory=list)
    answer: str | None = None
    complete: bool = False


@dataclass
class Episode:
    """State of an episode; limit: turns without progress after which a search is required."""

    ledgers: dict[str, Ledger]
    limit: int = 4
    at: str | None = None
    mode: str = NONE
    idle: int = 0
    most_idle: int = 0
    done: bool = False
    submitted: list[str] = field(default_factory=list)
    last_call: str | None = None
    heard: set[tuple] = field(default_factory=set)
    left: tuple[str, str] | None = None

    @classmethod
    def begin(cls, message: str, limit: int = 4) -> Episode:
        names = named(message)
        return cls({a: Ledger() for a in names}, limit, names[0] if names else None)

    @property
    def current(self) -> Ledger | None:
        return self.ledgers.get(self.at) if self.at else None

    @property
    def phase(self) -> str:
        if self.done:
            return SWITCH
        if self.current is None:
            return self.mode
        if self.mode == NONE:
            return SEARCH if self.current.complete else ELICIT
        return SWITCH if self.mode == BLOCKED and self.current.status == BLOCKED else self.mode

    def of(self, status: str) -> list[str]:
        return [a for a, x in self.ledgers.items() if x.status == status]

    def target(self, choice: str, content: str) -> str | None:
        """The one aspect that an answer's options or the words name, else the current one."""
        if choice == "answer":
            found = {option_aspect(x) for x in options(content)} & set(self.ledgers)
            if len(found) == 1:
                return found.pop()
        mentioned = [a for a in self.ledgers if _first(content, ASPECT_HINTS[a]) is not None]
        return mentioned[0] if len(mentioned) == 1 else self.at

    def refusal(self, choice: str, content: str) -> str | None:
        """Why this call is not allowed now, or null."""
        aim, here, phase = self.target(choice, content), self.current, self.phase
        if aim is not None and self.ledgers[aim].status != OPEN:
            return REFUSED["closed"].format(aim)
        if self.done or phase == SWITCH:
            return REFUSED["done" if self.done else "switch"]
        if here is None:
            return REFUSED["nameless"] if choice != "action" else None
        if choice != "action" and aim != self.at:
            return REFUSED["elsewhere"]
        needed = {SEARCH: ("search", "search_only"), RETRY: ("search", "retry_only"), ANSWER: ("answer", "answer_only")}.get(phase)
        if needed and choice != needed[0]:
            return REFUSED[needed[1]]
        if phase == RETRY:
            return self._retry_refusal(here, content)
        return self._answer_refusal(here, content) if choice == "answer" else None

    @staticmethod
    def _retry_refusal(here: Ledger, content: str) -> str | None:
        query = query_words(content)
        if not here.queries:
            return REFUSED["no_query"]
        if query in here.queries:
            return REFUSED["tried"]
        return None if changed(here.queries[-1], query) else REFUSED["same_query"]

    def _answer_refusal(self, here: Ledger, content: str) -> str | None:
        given = options(content)
        if len(given) != 1 or not re.fullmatch("[ACFHR][0-9]+", given[0]):
            return REFUSED["one_option"]
        if given[0] not in here.visible:
            return REFUSED["not_visible"]
        return None if option_aspect(given[0]) == self.at else REFUSED["other_option"]

    def no_progress(self) -> None:
        free = self.phase in (NONE, ELICIT)
        self.idle += 1
        self.most_idle = max(self.most_idle, self.idle)
        if free and self.idle >= self.limit and self.at is not None:
            self.mode = SEARCH

    def turn(self, choice: str, content: str, feedback: str | None = None) -> None:
        """One call and, if there is any, its feedback."""
        if self.done:
            return
        self.left = None
        call = f"{choice}:{_plain(content)}"
        again, refused = call == self.last_call, self.refusal(choice, content) is not None and self.phase not in (NONE, ELICIT)
        self.last_call = call
        if choice == "answer":
            self.submitted += [x for x in dict.fromkeys(options(content)) if re.fullmatch("[ACFHR][0-9]+", x) and x not in self.submitted]
        if refused:
            return
        kind, ids = observe(choice, feedback) if feedback is not None else (None, frozenset())
        if choice == "search":
            self._searched(content, kind, ids)
        elif choice == "answer":
            self._answered(content)
        elif kind is None:
            self.no_progress()
        if kind is None:
            return
        heard = (kind, _plain(feedback), ids)
        if choice == "action" and kind == "text":
            if again or heard in self.heard:
                self.no_progress()
            else:
                self.idle = 0
        self.heard.add(heard)

    def _searched(self, content: str, kind: str | None, ids: frozenset[str]) -> None:
        aim = self.target("search", content)
        if aim is None:
            if kind is None:
                self.no_progress()
            return
        there, query = self.ledgers[aim], query_words(content)
        if there.status != OPEN or self.phase == RETRY and (aim != self.at or self._retry_refusal(there, content)):
            return
        there.queries = [q for q in there.queries if q != query] + [query]
        there.attempts = min(2, there.attempts + 1)
        if kind is None:
            self.no_progress()
            return
        own = {x for x in ids if option_aspect(x) == aim}
        there.visible |= own
        if kind == "search_normal" and own:
            there.normal, there.visible, self.idle, self.mode = True, own, 0, ANSWER
            return
        there.fallbacks += 1
        self.mode = RETRY
        if there.fallbacks >= 2:
            there.status = self.mode = BLOCKED
            self.done = not self.of(OPEN)

    def _answered(self, content: str) -> None:
        aim, given = self.target("answer", content), options(content)
        there = self.ledgers.get(aim) if aim else None
        if there is None or there.status != OPEN or len(given) != 1 or given[0] not in there.visible:
            self.no_progress()
            return
        there.status, there.answer, self.idle, self.at, self.mode = ANSWERED, given[0], 0, aim, SWITCH
        self.done = not self.of(OPEN)

    def complete(self, aspect: str | None = None) -> None:
        """Preferences of an open aspect are known: a search is required."""
        aim = aspect or self.at
        if self.ledgers[aim].status == OPEN:
            self.ledgers[aim].complete = True
            self.at, self.mode, self.left = aim, SEARCH, None

    def hear(self, choice: str, feedback: str) -> None:
        """An observation that no call came with; choice: what it answers."""
        if self.done:
            return
        self.left = None
        kind, ids = observe(choice, feedback)
        if kind == "search_normal":
            self.idle = 0
        elif kind in ("search_fallback", "fallback", "search_empty"):
            self.no_progress()
        self.heard.add((kind, _plain(feedback), ids))

    def event(self, kind: str, choice: str | None, content: str | None, feedback: str | None, aspect: str | None) -> str | None:
        """One public event of a live session: call, observation, no_progress or complete. The refusal of a call, or null."""
        refusal = None
        if kind == "call":
            self.advance()
            refusal = self.refusal(choice, content or "")
            self.turn(choice, content or "", feedback)
        elif kind == "observation":
            self.hear(choice or "search", feedback or "")
        elif kind == "no_progress" and not self.done:
            self.no_progress()
        elif kind == "complete" and not self.done and (aspect or self.at) in self.ledgers:
            self.complete(aspect)
        return refusal

    def advance(self) -> bool:
        """From a closed aspect to the next open one after it; none ends the episode. Whether there was anything to do."""
        here = self.current
        if here is None or here.status == OPEN:
            return False
        self.left = (self.at, here.status)
        names = list(self.ledgers)
        following = [a for a in names[names.index(self.at) + 1 :] if self.ledgers[a].status == OPEN]
        if self.done:
            self.at = None
        elif following:
            self.at, self.mode, self.idle = following[0], NONE, 0
        else:
            self.at, self.mode, self.done = None, NONE, True
        return True

    def align(self, choice: str, content: str) -> None:
        """Before a recorded call: leave a closed aspect, and follow an open one that the call names."""
        self.advance()
        words = " " + " ".join(re.sub("s$", "", w) for w in re.findall("[a-z0-9]+", content.casefold())) + " "
        mentioned = [a for a in self.ledgers if any(f" {h} " in words for h in ASPECT_HINTS[a])]
        aim = mentioned[0] if len(mentioned) == 1 else None
        if choice == "answer":
            aim = next((a for a in map(option_aspect, options(content)) if a), aim)
        if aim in self.ledgers and aim != self.at and self.ledgers[aim].status == OPEN:
            self.at, self.mode, self.idle = aim, NONE, 0

    def payload(self) -> dict:
        """What is stored of the state."""
        here = self.current or Ledger()
        return {
            "current_aspect": self.at, "phase": self.phase, "fallback_count": here.fallbacks, "visible_option_ids": sorted(here.visible), "answered_aspects": self.of(ANSWERED), "blocked_aspects": self.of(BLOCKED),
            "complete_aspects": [a for a, x in self.ledgers.items() if x.complete], "search_attempts": here.attempts, "normal_search_seen": here.normal, "idle": self.idle,
        }

    @classmethod
    def rebuild(cls, stored: dict, message: str, limit: int = 4) -> Episode:
        """A state of which payload() gives what was stored; queries and what was heard are not stored."""
        made = cls.begin(message, limit)
        for names, status in (("answered_aspects", ANSWERED), ("blocked_aspects", BLOCKED)):
            for a in stored[names]:
                made.ledgers.setdefault(a, Ledger()).status = status
        for a in stored["complete_aspects"]:
            made.ledgers.setdefault(a, Ledger()).complete = True
        made.at, made.idle = stored["current_aspect"], stored["idle"]
        made.most_idle = made.idle
        made.done = bool(made.ledgers) and not made.of(OPEN)
        if made.at is not None:
            here = made.ledgers.setdefault(made.at, Ledger())
            here.fallbacks, here.visible, here.attempts, here.normal = stored["fallback_count"], set(stored["visible_option_ids"]), stored["search_attempts"], stored["normal_search_seen"]
            made.mode = BLOCKED if here.status == BLOCKED else NONE if stored["phase"] == ELICIT or stored["phase"] == SEARCH and here.complete else stored["phase"]
        return made


def labels(before: Episode, choice: str, content: str, feedback: str | None, seen: set[str], last: tuple | None, failed: Counter) -> tuple[list[str], bool]:
    """Labels of a turn from the state before it, and whether its search failed. last: (choice, kind, feedback, visible) of the turn before."""
    aim = before.target("search", content) if before.ledgers else None
    out = []
    if choice == "search" and before.mode != RETRY and aim is not None:
        out.append("preference_complete_to_search")
    if f"{choice}:{_plain(content)}" in seen or last is not None and last[2] is not None and feedback is not None and _plain(last[2]) == _plain(feedback):
        out.append("repeated_no_progress_action")
    if last is not None and last[0] == "search" and last[1] == "search_normal" and last[3]:
        out.append("valid_search_to_answer" if choice == "answer" else "visible_options_pending_answer")
    kind = observe(choice, feedback)[0] if feedback is not None else None
    if feedback is not None and any(p in _plain(feedback) for p in NO_PREFERENCE):
        out.append("explicit_no_preference")
    fails = choice == "search" and kind in ("search_fallback", "search_empty")
    if fails:
        failed[aim or "unknown"] += 1
        if failed[aim or "unknown"] <= 2:
            out.append(("first_fallback", "second_fallback")[failed[aim or "unknown"] - 1])
    return out, fails


_STATE = "phase string, current string, answered array<string>, blocked array<string>, visible array<string>, submitted array<string>, fallbacks long, attempts long, idle long, most_idle long, done boolean"
_TURN = "refusal string, labels array<string>, switched boolean, phase_before string, " + _STATE


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]


def walk(turns: DataFrame, trajectory: str, turn: str, message: str = "message", limit: int = 4, follow: bool = False) -> DataFrame:
    """(trajectory, turn, and columns of each turn): refusal before it, labels, whether an aspect was left before it, states.

    turns: choice, content, feedback (null: none) and the user's first message, the same in all rows of a trajectory. With
    `follow`, recorded calls may switch to an open aspect that they name; else they are judged as live ones.
    """
    kinds = [c.split(" ", 1) for c in _TURN.split(", ")]
    key = turns.schema[trajectory].dataType.simpleString()
    number = turns.schema[turn].dataType.simpleString()

    def fold(part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part[c].to_pylist() for c in ("__turn", "choice", "content", "feedback")), strict=True), key=lambda r: r[0])
        episode = Episode.begin(part["__message"][0].as_py() or "", limit)
        seen, last, failed, out = set(), None, Counter(), []
        for _, choice, content, feedback in rows:
            content = content or ""
            switched = episode.advance()
            if follow:
                episode.align(choice, content)
            before, refusal = episode.phase, episode.refusal(choice, content)
            found, _ = labels(episode, choice, content, feedback, seen, last, failed)
            seen.add(f"{choice}:{_plain(content)}")
            episode.turn(choice, content, feedback)
            here = episode.current or Ledger()
            kind = observe(choice, feedback)[0] if feedback is not None else None
            last = (choice, kind, feedback, set(here.visible))
            out.append((refusal, found, switched, before, episode.phase, episode.at, episode.of(ANSWERED), episode.of(BLOCKED), sorted(here.visible), list(episode.submitted), here.fallbacks, here.attempts, episode.idle, episode.most_idle, episode.done))
        columns = list(zip(*out, strict=True))
        first = [pa.array([part["__key"][0].as_py()] * len(out), part.schema.field("__key").type), pa.array([r[0] for r in rows], part.schema.field("__turn").type)]
        return pa.Table.from_arrays(first + [pa.array(list(c), _arrow(k)) for c, (_, k) in zip(columns, kinds, strict=True)], names=[trajectory, turn, *[n for n, _ in kinds]])

    given = turns.select(F.col(trajectory).alias("__key"), F.col(turn).alias("__turn"), "choice", "content", "feedback", F.col(message).alias("__message"))
    return given.groupBy("__key").applyInArrow(fold, f"`{trajectory}` {key}, `{turn}` {number}, {_TURN}")


def replay(walked: DataFrame, trajectory: str, turn: str) -> DataFrame:
    """(trajectory, turns, refused, and the last state) of walk()."""
    state = [c.split()[0] for c in _STATE.split(", ")]
    held = walked.groupBy(trajectory).agg(F.count("*").alias("turns"), F.count("refusal").alias("refused"), F.max_by(F.struct(*state), turn).alias("s"))
    return held.select(trajectory, "turns", "refused", *[f"s.{c}" for c in state])


def boundaries(walked: DataFrame, trajectory: str, turn: str) -> DataFrame:
    """(trajectory, turn, label): one row for each label of a turn."""
    return walked.select(trajectory, turn, F.explode("labels").alias("label"))


def phase_counts(walked: DataFrame, trajectory: str) -> DataFrame:
    """(trajectory, chances and successes of each guarded phase, switches of aspect)."""
    counts = []
    for name, phase in (("search", SEARCH), ("retry", RETRY), ("answer", ANSWER)):
        there = F.col("phase_before") == phase
        counts += [F.count_if(there).alias(f"{name}_chances"), F.count_if(there & F.col("refusal").isNull()).alias(f"{name}_successes")]
    return walked.groupBy(trajectory).agg(*counts, F.count_if("switched").alias("switches"))


LIVE = "refusal string, " + _STATE


def live_row(episode: Episode, refusal: str | None) -> tuple:
    """The columns of LIVE after an event."""
    here = episode.current or Ledger()
    return refusal, episode.phase, episode.at, episode.of(ANSWERED), episode.of(BLOCKED), sorted(here.visible), list(episode.submitted), here.fallbacks, here.attempts, episode.idle, episode.most_idle, episode.done


def live(events: DataFrame, limit: int = 4) -> DataFrame:
    """(trajectory, at, and LIVE): the state after each event of live sessions, in order of `at`.

    events: trajectory long, at long, kind (call, observation, no_progress, complete), choice, content, feedback, aspect and
    the user's first message. Unlike recorded turns, events may come without a call.
    """
    kinds = [c.split(" ", 1) for c in LIVE.split(", ")]

    def fold(part: pa.Table) -> pa.Table:
        columns = ("at", "kind", "choice", "content", "feedback", "aspect", "message")
        rows = sorted(zip(*(part[c].to_pylist() for c in columns), strict=True), key=lambda r: r[0])
        episode = Episode.begin(rows[0][-1] or "", limit)
        out = [live_row(episode, episode.event(*row[1:-1])) for row in rows]
        first = [pa.array([part["trajectory"][0].as_py()] * len(out), pa.int64()), pa.array([r[0] for r in rows], pa.int64())]
        return pa.Table.from_arrays(first + [pa.array(list(c), _arrow(k)) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=["trajectory", "at", *[n for n, _ in kinds]])

    given = events.select(F.col("trajectory").cast("long").alias("trajectory"), F.col("at").cast("long").alias("at"), "kind", "choice", "content", "feedback", "aspect", "message")
    return given.groupBy("trajectory").applyInArrow(fold, f"trajectory long, at long, {LIVE}")
