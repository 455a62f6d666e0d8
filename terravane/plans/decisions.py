"""Typed questions put to a provider, which is any function; off unless one is given.

A question is a choice among options, a score in a range or a predicate. Answers that do not fit the question's type
are no answers. Answers are kept for a while, failures for a shorter one.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass

KEPT_SECONDS, FAILED_SECONDS, KEPT = 300, 15, 512


@dataclass(frozen=True)
class Question:
    kind: str
    text: str
    options: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1.0

    def read(self, answer):
        """The answer as the question's type, or None."""
        if self.kind == "choice":
            return answer if answer in self.options else None
        if self.kind == "score":
            return float(answer) if isinstance(answer, (int, float)) and not isinstance(answer, bool) and self.low <= answer <= self.high else None
        return answer if isinstance(answer, bool) else None


def choice(text: str, options) -> Question:
    return Question("choice", text, tuple(options))


def score(text: str, low: float = 0.0, high: float = 1.0) -> Question:
    return Question("score", text, (), low, high)


def predicate(text: str) -> Question:
    return Question("predicate", text)


class Decisions:
    """Asks provider(state, questions as plain data) -> answers by name, one call for all questions not known yet."""

    def __init__(self, provider: Callable[[object, dict], dict], clock: Callable[[], float] = time.monotonic):
        self.provider, self.clock, self.kept = provider, clock, OrderedDict()

    def ask(self, state, questions: dict[str, Question]) -> dict:
        """An answer, or None, for each question."""
        key = lambda q: json.dumps([state, asdict(q)], sort_keys=True, default=str)
        now, out, open_ = self.clock(), {}, {}
        for name, q in questions.items():
            held = self.kept.get(key(q))
            if held and held[0] > now:
                out[name] = held[1]
            else:
                open_[name] = q
        if open_:
            try:
                got = self.provider(state, {n: asdict(q) for n, q in open_.items()}) or {}
            except Exception:  # a provider that fails gives no answers for a while
                got = {}
            for name, q in open_.items():
                out[name] = q.read(got.get(name))
                self.kept[key(q)] = (now + (FAILED_SECONDS if out[name] is None else KEPT_SECONDS), out[name])
            while len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        return out

    def route(self, question: str, names: list[str]) -> list[str]:
        """For Repository: the channels of a question that may be asked in several ways."""
        got = self.ask(question, {"route": choice("which evidence answers this question?", ("lexical", "hybrid", "graph"))})["route"]
        only = {"lexical": ("exact", "lexical"), "graph": ("exact", "lexical", "graph")}.get(got)
        return [n for n in names if n in only] if only else names

    def relevant(self, question: str, found):
        """For MemoryStore: those of the found notes that answer the question; the best ones are asked about, others go."""
        from pyspark.sql import functions as F

        rows = found.orderBy(F.desc("score"), "id").limit(10).select("id", "content").collect()
        got = self.ask(question, {r["id"]: predicate(r["content"]) for r in rows})
        return found.where(F.col("id").isin([i for i, a in got.items() if a is not False]))

    def rejected(self, statements: list[str]) -> set[int]:
        """For MemoryStore: places of statements not to keep."""
        got = self.ask("keep as a lasting preference?", {str(i): predicate(s) for i, s in enumerate(statements)})
        return {int(i) for i, a in got.items() if a is False}
