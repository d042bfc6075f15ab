"""Calls of a language model from the executors: cache, throttle, retries, and the scorer and intent reader built on them.

The model itself is a function of (system, user, temperature) that returns its reply; it may raise. Nothing here needs a
network: tests and registered queries use functions that answer by rule.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, str, float], str]

#: Calls and seconds of the throttle, tries of a call, its first pause, the pause where the model names none,
#: replies that are kept, and for how many seconds.
CALLS, WINDOW, TRIES, PAUSE, RETRY_AFTER = 28, 60.0, 5, 5.0, 10.0
KEPT, KEPT_FOR = 128, 600.0


class Limited(Exception):
    """The model refuses a call for now; ``retry_after`` in seconds, if it says."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("rate limit")
        self.retry_after = RETRY_AFTER if retry_after is None else retry_after


def cache_key(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def cache_key_column(*parts):
    """The same as a column."""
    return F.sha2(F.concat_ws("|", *parts), 256)


class Throttle:
    """At most ``calls`` in any ``window`` seconds; wait() blocks until one is free."""

    def __init__(self, calls: int = CALLS, window: float = WINDOW, clock=time.time, sleep=time.sleep):
        self.calls, self.window, self.clock, self.sleep = calls, window, clock, sleep
        self.log: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            while self.log and now - self.log[0] >= self.window:
                self.log.popleft()
            if len(self.log) >= self.calls:
                self.sleep(self.log[0] + self.window - now + 0.5)
                self.log.popleft()
            self.log.append(self.clock())

    def __reduce__(self):
        return Throttle, (self.calls, self.window)


class Caller:
    """A transport with a cache of replies, a throttle and retries. Each worker process has its own.

    A call is tried ``tries`` times: a refusal waits as long as the model says, any other error 5, 10, 20, ... seconds. The
    last error is raised. Only replies that say something are kept, the oldest going first, each for a while.
    """

    def __init__(self, transport: Transport, name: str = "model", tries: int = TRIES, throttle: Throttle | None = None, clock=time.time, sleep=time.sleep):
        self.transport, self.name, self.tries, self.clock, self.sleep = transport, name, tries, clock, sleep
        self.throttle = throttle or Throttle(clock=clock, sleep=sleep)
        self.kept: OrderedDict[str, tuple[float, str]] = OrderedDict()

    def __call__(self, system: str, user: str, temperature: float) -> str:
        key = cache_key(system, user, self.name, str(temperature))
        until, reply = self.kept.get(key, (0.0, ""))
        if reply and self.clock() < until:
            return reply
        error: Exception = RuntimeError("no try was made")
        for k in range(self.tries):
            self.throttle.wait()
            try:
                reply = self.transport(system, user, temperature).strip()
            except Limited as e:
                error, pause = e, e.retry_after
            except Exception as e:
                error, pause = e, PAUSE * 2**k
            else:
                if reply:
                    self.keep(key, reply)
                return reply
            if k < self.tries - 1:
                self.sleep(pause)
        raise error

    def keep(self, key: str, reply: str) -> None:
        self.kept.pop(key, None)
        now = self.clock()
        if len(self.kept) >= KEPT:
            for k in [k for k, (until, _) in self.kept.items() if now >= until]:
                del self.kept[k]
            while len(self.kept) >= KEPT:
                self.kept.popitem(last=False)
        self.kept[key] = now + KEPT_FOR, reply


def parsed(reply: str | None, name: str | None = None) -> Any:
    """What a reply says in JSON, or None; with ``name`` the list under it, of a list the list itself, of one object that one."""
    from .loop import repair

    text = repair(reply)
    whole = json.loads(text) if text else None
    if name is None or whole is None:
        return whole
    found = whole if isinstance(whole, list) else whole.get(name, [])
    return [x for x in ([found] if isinstance(found, dict) else found) if isinstance(x, dict)]


def number(x: Any) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.0


def _score_prompt(q: Any) -> str:
    options = "\n".join(f"{k}) {v}" for k, v in (q.options or {}).items())
    return f"Question: {q.question}\nOptions:\n{options}\nAnswer: {q.correct_answer}\nFact: {q.fact}\nGive JSON with grounding_score, clarity_score, distractor_score (0 to 1), failure_codes, feedback, suggestions."


SCORED = "mcq_id string, grounding double, clarity double, distractor double, codes array<string>, feedback string"


def score_questions(questions: DataFrame, caller: Caller) -> DataFrame:
    """Scores of questions (mcq_id, question, options, correct_answer, fact) by the model. A call that fails, or a reply that is
    not JSON, gives zeros and FORMAT_ERROR, so that the question fails rather than the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q in frame.itertuples():
                try:
                    said = parsed(caller("You grade exam questions.", _score_prompt(q), 0.2))
                except Exception:
                    said = None
                if not isinstance(said, dict):
                    rows.append((q.mcq_id, 0.0, 0.0, 0.0, ["FORMAT_ERROR"], "no evaluation"))
                    continue
                scores = [number(said.get(f"{k}_score")) for k in ("grounding", "clarity", "distractor")]
                rows.append((q.mcq_id, *scores, [str(c) for c in said.get("failure_codes") or []], str(said.get("feedback") or "")))
            yield pd.DataFrame(rows, columns=["mcq_id", "grounding", "clarity", "distractor", "codes", "feedback"])

    return questions.select("mcq_id", "question", "options", "correct_answer", "fact").mapInPandas(run, SCORED)


FIELDS = ("intent", "question_type", "topic", "sub_topic", "bangla_query", "english_query")
LISTS = ("entities", "time_hints", "search_keywords")
READ = "id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", " + ", ".join(f"{f} array<string>" for f in LISTS)
#: What a field is where the reply leaves it out; the queries are then the question itself.
LEFT_OUT = {"intent": "factual_recall", "question_type": "what_question", "topic": "General", "sub_topic": ""}


def read_intents(questions: DataFrame, caller: Caller) -> DataFrame:
    """The model's reading of questions (id, text); a question without a usable reply is not in the result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q in frame.itertuples():
                try:
                    said = parsed(caller("You read exam questions.", f"Give the {', '.join((*FIELDS, *LISTS))} of this question as JSON.\nQuestion: {q.text}", 0.1))
                except Exception:
                    said = None
                if isinstance(said, dict):
                    rows.append((q.id, *(str(said.get(f, LEFT_OUT.get(f, q.text))) for f in FIELDS), *([str(x) for x in said.get(f) or []] for f in LISTS)))
            yield pd.DataFrame(rows, columns=["id", *FIELDS, *LISTS])

    return questions.select("id", "text").mapInPandas(run, READ)


def intents(questions: DataFrame, rules: DataFrame, caller: Caller | None) -> DataFrame:
    """Blueprints of questions (id, text): the model's with confidence .92, where it has none those of ``rules`` (id and the same fields, confidence)."""
    names = ["id", *FIELDS, *LISTS]
    by_rule = rules.select(*names, "confidence", F.lit("rule_based").alias("method"))
    if caller is None:
        return by_rule
    said = read_intents(questions, caller).select(*names, F.lit(0.92).alias("confidence"), F.lit("llm").alias("method"))
    both = said.select(F.struct(*said.columns).alias("m"), "id").join(by_rule.select(F.struct(*by_rule.columns).alias("r"), "id"), "id", "full")
    return both.select(F.coalesce("m", "r").alias("x")).select("x.*")
