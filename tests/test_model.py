"""Model calls, and the generation loop against a walk in plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lorebank.operators import loop
from lorebank.operators.model import CALLS, KEPT, Caller, Limited, Throttle, cache_key, cache_key_column, intents, parsed, score_questions


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(round(seconds, 3))
        self.now += seconds


def test_throttle():
    clock = Clock()
    t = Throttle(clock=clock, sleep=clock.sleep)
    for _ in range(CALLS):
        t.wait()
        clock.now += 1
    assert clock.slept == []
    t.wait()
    assert clock.slept == [32.5]


def test_retries_and_pauses():
    clock, asked = Clock(), []

    def flaky(system, user, temperature):
        asked.append(user)
        if len(asked) == 1:
            raise Limited(7)
        if len(asked) < 4:
            raise OSError("down")
        return "  fine "

    call = Caller(flaky, clock=clock, sleep=clock.sleep)
    assert call("s", "u", 0.2) == "fine" and clock.slept == [7, 10, 20] and len(asked) == 4
    assert call("s", "u", 0.2) == "fine" and len(asked) == 4
    assert call("s", "u", 0.3) == "fine" and len(asked) == 5
    clock.now += 601
    assert call("s", "u", 0.2) == "fine" and len(asked) == 6


def test_the_last_error_is_raised_and_empty_replies_are_not_kept():
    clock, n = Clock(), []

    def down(*_):
        n.append(1)
        raise OSError(len(n))

    with pytest.raises(OSError, match="5"):
        Caller(down, clock=clock, sleep=clock.sleep)("s", "u", 0)
    assert clock.slept == [5, 10, 20, 40]
    call = Caller(lambda *_: (n.append(1), "")[1], clock=clock, sleep=clock.sleep)
    assert call("s", "u", 0) == call("s", "u", 0) == "" and len(n) == 7 and not call.kept


def test_replies_go_first_in_first_out():
    clock = Clock()
    call = Caller(lambda s, u, t: u, throttle=Throttle(10**9, clock=clock), clock=clock, sleep=clock.sleep)
    for i in range(KEPT + 1):
        call("s", str(i), 0)
    assert len(call.kept) == KEPT and cache_key("s", "0", "model", "0") not in call.kept and cache_key("s", "1", "model", "0") in call.kept


def test_cache_key(spark):
    assert cache_key("a", "b") == hashlib.sha256(b"a|b").hexdigest() == spark.range(1).select(cache_key_column(F.lit("a"), F.lit("b"))).first()[0]


def test_replies_of_the_challenger():
    good = {"fact_id": "F1", "question": "q", "options": {"A": "x"}, "correct_answer": "A", "difficulty": "easy"}
    asked = loop.Round(0, "hard")
    assert loop.made_of(json.dumps({"mcqs": [good, {"fact_id": "F2"}, "noise"]}), asked) == [("F1", "q", {"A": "x"}, "A", "hard", "factual", "")]
    assert len(loop.made_of(json.dumps([good, good]), asked)) == 2 and len(loop.made_of(json.dumps({"mcqs": good}), asked)) == 1
    assert loop.made_of("none", asked) == loop.made_of("", asked) == [] and parsed("```json\n{\"a\": 1}\n```") == {"a": 1}


def test_challenger_prompt():
    facts = [type("F", (), {"fact_id": i, "text": f"text {i}"})() for i in range(10)]
    assert loop.quota(10) == {"numeric_or_analytical": 15, "who": 3, "when_or_where": 2} and loop.quota(1)["who"] == 1
    first = loop.challenge_prompt(facts, loop.Round(0, "easy", ("WEAK_DISTRACTORS",)))
    assert "level easy" in first and "[3] text 3" in first and "WEAK" not in first
    later = loop.challenge_prompt(facts, loop.Round(2, "easy", ("WEAK_DISTRACTORS",), tuple(f"old {i}" for i in range(30))))
    assert "WEAK_DISTRACTORS" in later and "round 2" in later and "old 19" in later and "old 20" not in later


def call(transport):
    return Caller(transport, throttle=Throttle(10**9), tries=1)


def fingerprint(q):
    return hashlib.sha256(" ".join(q.split()).lower().encode()).hexdigest()


def walk(facts, seen, rounds=3):
    """The loop by rule over (id, text), chunk by chunk, as loops and lists."""
    accepted, pending, had_failures = [], list(facts), False
    for k in range(rounds):
        kinder = k if had_failures else 0
        made = {}
        for i, text in pending:
            for e in (1, 2):
                q = f"Q{e + kinder * 2}: {' '.join(text.split())}"
                made.setdefault(fingerprint(q), (str(i), q, e + kinder * 2))
        failed = False
        for h, (i, q, e) in made.items():
            if h in seen:
                continue
            total = round(min(1.0, int(cache_key(q)[:8], 16) % 1000 / 1000 + 0.15 * ((e - 1) // 2)), 3)
            if total >= 0.7:
                accepted.append((i, k, q, total))
            else:
                failed = True
        had_failures |= failed
        seen = seen | {h for h, (i, q, e) in made.items() if (i, q) in {(a, b) for a, _, b, _ in accepted}}
        done = {a for a, *_ in accepted}
        pending = [(i, t) for i, t in pending if str(i) not in done]
        if not pending:
            break
    return sorted(accepted)


def test_loop_equals_the_walk(spark):
    facts = [(i, f"Fact number {i} tells of some thing.") for i in range(137)]
    seen = {fingerprint(f"Q1: {t}") for i, t in facts if i % 9 == 0}
    out = loop.run_loop(spark.createDataFrame(facts, "fact_id long, text string"), spark.createDataFrame([(h,) for h in seen], "h string"), call(loop.by_rule))
    got = sorted((r.fact_id, r.round, r.question, round(r.quality, 3)) for r in out.collect())
    assert got == walk(facts, seen) and {r for _, r, _, _ in got} == {0, 1, 2}


def test_all_difficulties_take_the_best_facts(spark):
    facts = spark.createDataFrame([(i, f"fact {i}", i / 100) for i in range(50)], "fact_id long, text string, composite double")
    out = loop.all_difficulties(facts, spark.createDataFrame([], "h string"), call(loop.by_rule)).collect()
    assert {r.difficulty for r in out} <= {"easy", "medium", "hard"} and {int(r.fact_id) for r in out} <= set(range(45, 50))
    assert len({r.question for r in out}) == len(out)


def silent(system, user, temperature):
    """Makes questions, and neither answers nor judges."""
    return loop.by_rule(system, user, temperature) if "write" in system else "{}"


def half(system, user, temperature):
    """Judges the first question of a chunk alone; fails in a chunk with the word boom."""
    if "boom" in user:
        raise OSError("down")
    reply = json.loads(loop.by_rule(system, user, temperature))
    return json.dumps({k: v[:1] if k == "evaluations" else v for k, v in reply.items()})


def test_questions_that_nobody_judged(spark):
    facts = loop.chunked(spark.createDataFrame([(i, f"fact {i}") for i in range(8)], "fact_id long, text string").coalesce(1))
    none = spark.createDataFrame([], "h string")
    all_pass = loop.one_round(facts, none, loop.Round(), call(silent)).collect()
    assert len(all_pass) == 16 and all(r.passed and r.quality == 0.8 and r.answer == "N/A" for r in all_pass)
    some = loop.one_round(facts, none, loop.Round(), call(half)).collect()
    assert sorted(r.passed is None for r in some) == [False] + [True] * 15


def test_a_failing_batch_stops_no_other(spark):
    rows = [(i, f"fact {i}" + " boom" * (i == 3)) for i in range(40)]
    out = loop.in_batches(spark.createDataFrame(rows, "fact_id long, text string").coalesce(1), spark.createDataFrame([], "h string"), call(half)).collect()
    assert out and not {int(r.fact_id) for r in out} & set(range(10)) and {int(r.fact_id) // 10 for r in out} <= {1, 2, 3}


def graded(system, user, temperature):
    if "Fact: 1" in user:
        raise OSError("down")
    return "no JSON" if "Fact: 2" in user else '{"grounding_score": "0.9", "clarity_score": null, "distractor_score": 0.7, "failure_codes": ["WEAK_DISTRACTORS"], "feedback": "ok"}'


def test_scorer(spark):
    rows = [(str(i), "q", {"A": "x"}, "A", str(i)) for i in range(3)]
    got = {r.mcq_id: r for r in score_questions(spark.createDataFrame(rows, "mcq_id string, question string, options map<string,string>, correct_answer string, fact string"), call(graded)).collect()}
    assert (got["0"].grounding, got["0"].clarity, got["0"].distractor, got["0"].codes) == (0.9, 0.0, 0.7, ["WEAK_DISTRACTORS"])
    assert all((got[i].grounding, got[i].codes) == (0.0, ["FORMAT_ERROR"]) for i in "12")


def read(system, user, temperature):
    if "second" in user:
        raise OSError("down")
    return '{"intent": "comparison", "topic": "Economy", "entities": ["A"]}'


def test_intents_fall_back_to_rules(spark):
    asked = spark.createDataFrame([(1, "first"), (2, "second")], "id long, text string")
    lists = [F.array().cast("array<string>").alias(c) for c in ("entities", "time_hints", "search_keywords")]
    rules = asked.select("id", F.lit("definition").alias("intent"), F.lit("q").alias("question_type"), F.lit("General").alias("topic"), F.lit("").alias("sub_topic"), F.col("text").alias("bangla_query"), F.col("text").alias("english_query"), *lists, F.lit(0.75).alias("confidence"))
    got = {r.id: r for r in intents(asked, rules, call(read)).collect()}
    assert (got[1].intent, got[1].topic, got[1].question_type, got[1].bangla_query, got[1].entities, got[1].confidence, got[1].method) == ("comparison", "Economy", "what_question", "first", ["A"], 0.92, "llm")
    assert (got[2].intent, got[2].confidence, got[2].method) == ("definition", 0.75, "rule_based")
    assert {r.method for r in intents(asked, rules, None).collect()} == {"rule_based"}
