"""Generate, answer, judge: the iterative loop over chunks of facts, with the language model as a function.

A challenger makes questions of the facts of a chunk, a reasoner answers them blind, a judge scores both. Each is called
once for a chunk, on the executors. What is fed back to the next round is small: the reasons of failures, from a fixed
list, and up to SHOWN accepted questions.
"""

from __future__ import annotations

import json
import re
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from .model import Caller, cache_key, number, parsed

#: Rounds over facts that have no accepted question yet, facts of a chunk, facts taken by default, questions
#: made of a fact, accepted questions shown to the challenger, and the shares of the types of questions.
ROUNDS, CHUNK, FACTS, EACH, SHOWN = 3, 10, 5, 2, 20
SHARES = {"numeric_or_analytical": 0.75, "who": 0.15, "when_or_where": 0.10}
#: Score from which a judged question passes, with grounding of at least .80; the score of a question that nobody judged.
PASS, GROUNDED, UNJUDGED = 0.70, 0.80, 0.80
#: Tasks a core that the chunks of a round are dealt over.
TASKS = 2
REASONS = ("WRONG_GROUNDING", "AMBIGUOUS_QUESTION", "WEAK_DISTRACTORS", "FORMAT_ERROR", "REASONER_WRONG", "DUPLICATE_OPTIONS", "UNKNOWN")
LEVELS = ("easy", "medium", "hard")


def repair(raw: str | None) -> str | None:
    """JSON text out of a model's reply: without fences and trailing commas, cut to the outermost brackets, open ones closed; else None."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", (raw or "").strip())
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    text = text[min(starts) :]
    ends = max(text.rfind("}"), text.rfind("]"))
    for body in (text, text[: ends + 1] if ends > 0 else text, text + closing(text)):
        try:
            return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", body)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def closing(text: str) -> str:
    """The quote and brackets that are still open."""
    stack, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return '"' * quoted + "".join(reversed(stack))


def json_repair(column):
    return F.pandas_udf(lambda s: s.map(repair).astype("object"), "string")(column)


class Round(NamedTuple):
    """What a chunk is asked with: the round from 0, the level asked for, the reasons so far, and questions not to repeat."""

    no: int = 0
    difficulty: str = "medium"
    reasons: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()


def quota(facts: int) -> dict[str, int]:
    """How many questions of each type a chunk of so many facts is asked for."""
    n = facts * EACH
    return {"numeric_or_analytical": max(1, round(n * SHARES["numeric_or_analytical"])), "who": max(1, round(n * SHARES["who"])), "when_or_where": round(n * SHARES["when_or_where"])}


def challenge_prompt(facts: list[Any], asked: Round) -> str:
    """The request for the questions of a chunk."""
    lines = [f"{i}. [{f.fact_id}] {' '.join(f.text.split())}" for i, f in enumerate(facts, 1)]
    types = ", ".join(f"{n} {kind}" for kind, n in quota(len(facts)).items())
    parts = [f"Make {EACH} questions of each fact, each on another aspect ({types}), level {asked.difficulty}:", *lines]
    if asked.no > 0 and asked.reasons:
        parts.append(f"Earlier questions failed (round {asked.no}) for: {'; '.join(asked.reasons)}. Avoid that.")
    if asked.shown:
        parts += ["Do not repeat:", *(f"- {q}" for q in asked.shown[:SHOWN])]
    parts.append('Give JSON: {"mcqs": [{"fact_id", "question", "options", "correct_answer", "difficulty", "question_type", "explanation"}]}')
    return "\n".join(parts)


def made_of(reply: str, asked: Round) -> list[tuple]:
    """Questions of a challenger's reply; one without fact, question or answer is left out, and the level is the one asked for."""
    out = []
    for x in parsed(reply, "mcqs") or []:
        if all(isinstance(x.get(k), (str, int)) for k in ("fact_id", "question", "correct_answer")):
            options = x.get("options") if isinstance(x.get("options"), dict) else {}
            options = {str(k): str(v) for k, v in options.items()}
            out.append((str(x["fact_id"]), str(x["question"]), options, str(x["correct_answer"]), asked.difficulty, str(x.get("question_type") or "factual"), str(x.get("explanation") or "")))
    return out


MADE = "chunk long, fact_id string, question string, options map<string,string>, correct_answer string, difficulty string, question_type string, explanation string"
JUDGED = "chunk long, mcq_id string, answer string, quality double, format double, grounding double, clarity double, distractor double, passed boolean, reasons array<string>"


def by_chunk(rows: DataFrame):
    """Rows grouped by chunk for calls. Chunks are small in bytes and long in calls, so they are dealt over so many tasks that
    is not lowered by their size."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, "chunk").groupBy("chunk")


def challenge(facts: DataFrame, asked: Round, caller: Caller) -> DataFrame:
    """Questions of facts (chunk, fact_id, text), each chunk in one call; a chunk whose call fails has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in MADE.split(", ")]
        try:
            rows = made_of(caller("You write exam questions from facts alone.", challenge_prompt(list(pdf.itertuples()), asked), 0.7), asked)
        except Exception:
            rows = []
        return pd.DataFrame([(pdf["chunk"].iloc[0], *r) for r in rows], columns=names)

    return by_chunk(facts.select("chunk", F.col("fact_id").cast("string").alias("fact_id"), "text")).applyInPandas(run, MADE)


def _facts_of(pdf: pd.DataFrame) -> str:
    return "\n".join(sorted({f"- [{r.fact_id}] {' '.join(str(r.text).split())}" for r in pdf.itertuples()}))


def answer_prompt(pdf: pd.DataFrame) -> str:
    """Facts and questions, without the right answers."""
    asked = [f"[{r.mcq_id}] {r.question} " + "  ".join(f"{k}) {v}" for k, v in (r.options or {}).items()) for r in pdf.itertuples()]
    return f"Answer from these facts alone.\nFacts:\n{_facts_of(pdf)}\nQuestions:\n" + "\n".join(asked) + '\nGive JSON: {"answers": [{"mcq_id", "chosen_answer", "confidence", "reasoning"}]}'


def judge_prompt(pdf: pd.DataFrame, answers: dict[str, dict]) -> str:
    """Facts, questions with their right answers, and what the reasoner said, N/A where it said nothing."""
    rows = []
    for r in pdf.itertuples():
        said = answers.get(r.mcq_id, {})
        rows.append({"mcq_id": r.mcq_id, "fact_id": r.fact_id, "question": r.question, "options": dict(r.options or {}), "correct_answer": r.correct_answer, "explanation": r.explanation,
                     "reasoner_answer": said.get("chosen_answer", "N/A"), "reasoner_confidence": said.get("confidence", 0.0), "reasoner_reasoning": said.get("reasoning", "")})
    return (
        f"Judge these questions by the facts.\nFacts:\n{_facts_of(pdf)}\nQuestions:\n{json.dumps(rows, ensure_ascii=False)}\n"
        f"Pass: overall of at least {PASS} and grounding of at least {GROUNDED}. Reasons: {' | '.join(REASONS[:-1])}.\n"
        'Give JSON: {"evaluations": [{"mcq_id", "passed", "dimension_scores", "overall_score", "failure_reasons"}]}'
    )


def judge(questions: DataFrame, caller: Caller) -> DataFrame:
    """Answers and judgements of questions with their facts, each chunk in two calls.

    Without any answer the judge is not asked. A question that was not judged, or whose chunk failed, is not in the result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, rows = [c.split(" ")[0] for c in JUDGED.split(", ")], []
        try:
            said = {str(a.get("mcq_id")): a for a in parsed(caller("You answer exam questions.", answer_prompt(pdf), 0.2), "answers") or []}
            found = parsed(caller("You judge exam questions.", judge_prompt(pdf, said), 0.2), "evaluations") if said else []
        except Exception:
            found = []
        for e in found or []:
            dim = e.get("dimension_scores") if isinstance(e.get("dimension_scores"), dict) else {}
            scores = [number(dim.get(f"{k}_score")) for k in ("format", "grounding", "clarity", "distractor")]
            reasons = [r if r in REASONS else "UNKNOWN" for r in e.get("failure_reasons", ["UNKNOWN"]) or []]
            key = str(e.get("mcq_id"))
            rows.append((pdf["chunk"].iloc[0], key, str(said.get(key, {}).get("chosen_answer", "N/A")), number(e.get("overall_score")), *scores, bool(e.get("passed", False)), reasons))
        return pd.DataFrame(rows, columns=names)

    return by_chunk(questions).applyInPandas(run, JUDGED)


def chunked(facts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Facts with the number of their chunk, at most ``size`` consecutive rows of a partition, written so that it stays."""
    row = F.monotonically_increasing_id()
    part = F.shiftright(row, 33)
    return written(facts.withColumn("chunk", F.shiftleft(part, 33) + F.floor((row - F.shiftleft(part, 33)) / size)), "facts")


def one_round(facts: DataFrame, seen: DataFrame, asked: Round, caller: Caller) -> DataFrame:
    """The new questions of a round with the judge's word; ``passed`` is null where there is none.

    Questions whose fingerprint was seen are left out, and so are repeats within the round. In a chunk without any
    judgement all questions pass with a score of UNJUDGED; where others of the chunk were judged, those that were not
    stay without a word. ``facts`` have their chunks.
    """
    made = written(challenge(facts, asked, caller).withColumn("h", T.fingerprint(F.col("question"))), "made")
    columns = ("chunk", "fact_id", "question", "options", "correct_answer", "difficulty", "question_type", "explanation")
    rank = F.min_by(F.struct(*columns), F.struct("chunk", "fact_id", "question", F.to_json("options"), *columns[4:]))
    first = made.groupBy("h").agg(rank.alias("x")).select("h", "x.*").join(seen.select("h"), "h", "left_anti")
    name = T.new_id("MCQ_", F.col("h"), F.lit(str(asked.no)), F.col("difficulty"))
    fresh = written(first.withColumn("mcq_id", name), "fresh")
    known = facts.select("chunk", F.col("fact_id").cast("string").alias("fact_id"), "text")
    judged = written(judge(fresh.join(known, ["chunk", "fact_id"], "left"), caller).dropDuplicates(["mcq_id"]), "judged")
    some = judged.select("chunk").distinct().withColumn("some", F.lit(True))
    out = fresh.join(judged.drop("chunk"), "mcq_id", "left").join(some, "chunk", "left")
    nobody = F.col("some").isNull()
    return out.select(
        "mcq_id", "fact_id", "h", "question", "options", "correct_answer", "difficulty", "question_type", "explanation", F.lit(asked.no).alias("round"), F.coalesce("answer", F.lit("N/A")).alias("answer"),
        F.when(nobody, UNJUDGED).otherwise(F.coalesce("quality", F.lit(0.0))).alias("quality"), "format", "grounding", "clarity", "distractor",
        F.when(nobody, True).otherwise(F.col("passed")).alias("passed"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def run_loop(facts: DataFrame, seen: DataFrame, caller: Caller, difficulty: str = "medium", rounds: int = ROUNDS, size: int = CHUNK) -> DataFrame:
    """Accepted questions of facts (fact_id, text). Each round takes the facts that have none yet, in chunks, and the reasons so far."""
    accepted: DataFrame | None = None
    pending, reasons = chunked(facts, size), set()
    for k in range(rounds):
        shown = tuple(sorted(r.question for r in accepted.select("question").limit(SHOWN).collect())) if accepted is not None else ()
        made = written(one_round(pending, seen, Round(k, difficulty, tuple(sorted(reasons)), shown), caller), "round")
        good = made.where("passed")
        accepted = good if accepted is None else accepted.unionByName(good)
        seen = seen.select("h").unionByName(good.select("h"))
        reasons |= {r.x for r in made.where("not passed").select(F.explode("reasons").alias("x")).distinct().collect()}  # of a fixed list
        covered = good.select(F.col("fact_id").alias("done")).distinct()
        pending = written(pending.join(covered, F.col("fact_id").cast("string") == F.col("done"), "left_anti"), "pending")
        if not pending.limit(1).count():
            break
    return accepted


def best(facts: DataFrame, most: int) -> DataFrame:
    return facts.orderBy(F.desc("composite"), "fact_id").limit(most)


def generate(facts: DataFrame, seen: DataFrame, caller: Caller, difficulty: str = "medium", most: int = FACTS, **options) -> DataFrame:
    """run_loop over the ``most`` facts with the highest composite (fact_id, text, composite), of equal ones the first ids."""
    return run_loop(best(facts, most), seen, caller, difficulty, **options)


def all_difficulties(facts: DataFrame, seen: DataFrame, caller: Caller, most: int = FACTS, **options) -> DataFrame:
    """generate() for every level; what one level has accepted, the next does not repeat. The best facts are found once."""
    out: DataFrame | None = None
    chosen = written(best(facts, most), "best")
    for level in LEVELS:
        made = written(generate(chosen, seen, caller, level, most, **options), level)
        seen = seen.select("h").unionByName(made.select("h"))
        out = made if out is None else out.unionByName(made)
    return out


def in_batches(facts: DataFrame, seen: DataFrame, caller: Caller, difficulty: str = "medium", **options) -> DataFrame:
    """run_loop over all facts, in batches that are chunks; a batch whose calls fail has no questions and stops no other."""
    return run_loop(facts, seen, caller, difficulty, size=CHUNK, **options)


def by_rule(system: str, user: str, temperature: float) -> str:
    """A stand-in for the model that answers by rule, the same in every run.

    It makes EACH questions of every fact, answers every question, and judges by a hash, more kindly after failures.
    """
    if "write" in system:
        facts = re.findall(r"^\d+\. \[([^\]]*)\] (.*)$", user, re.M)
        level = re.search(r"level (\w+):", user)[1]
        kinder = int((re.search(r"\(round (\d+)\)", user) or [0, 0])[1])
        made = [{"fact_id": i, "question": f"Q{k + kinder * EACH}: {t}", "options": {"A": t[:20], "B": "none", "C": "all", "D": level}, "correct_answer": "A", "question_type": "factual"} for i, t in facts for k in range(1, EACH + 1)]
        return json.dumps({"mcqs": made})
    if "answer" in system:
        return json.dumps({"answers": [{"mcq_id": i, "chosen_answer": "A", "confidence": 0.9} for i in re.findall(r"^\[(MCQ_\w+)\]", user, re.M)]})
    rows = json.loads(re.search(r"^\[.*\]$", user, re.M)[0])
    out = []
    for r in rows:
        x = int(cache_key(r["question"])[:8], 16) % 1000 / 1000
        total = round(min(1.0, x + 0.15 * ((int(r["question"][1 : r["question"].index(":")]) - 1) // EACH)), 3)
        good = total >= PASS
        scores = {f"{k}_score": total for k in ("format", "clarity", "distractor")} | {"grounding_score": max(total, GROUNDED) if good else total}
        out.append({"mcq_id": r["mcq_id"], "passed": good, "overall_score": total, "dimension_scores": scores, "failure_reasons": [] if good else ["WEAK_DISTRACTORS"]})
    return json.dumps({"evaluations": out})
