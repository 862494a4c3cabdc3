"""Conversation memory, transcripts, model replies and prompts over message tables."""

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.epochs import STEPS_SQL, Rule, follow_ranges, scan_fronts, scan_ranges
from corpusloom.functions.ranking import running_sum
from corpusloom.functions.text import strip_space
from corpusloom.session import scratch_path

MEMORY_TOKENS = 4000  # fixed value: budget that triggers a compression
AGENT_STEPS = 10  # fixed value: steps an agent may take
ATTEMPTS, WAIT_MIN, WAIT_MAX = 6, 0.2, 60.0  # fixed values: retries of a model call


# --- memory epochs (H1) ---------------------------------------------------------------------------------------


def memory_epochs(
    messages: DataFrame,
    threshold: int = MEMORY_TOKENS,
    base_tokens: int = 0,
    summary_tokens: int = 0,
    cost: str = "cost",
    key: str = "conv_id",
    turn: str = "turn",
    ranges: int | None = None,
) -> DataFrame:
    """H1: (key, turn, total, epoch, compressed) per added message.

    ``total`` is the memory size when the message has been added. A message that brings it to the threshold
    compresses the memory to ``base_tokens + summary_tokens``. Costs are integers of 0 or more, a NULL cost is 0;
    turns are unique integers within a conversation. Messages without key are one conversation.

    Messages are sorted by key and turn over all tasks, and the order is cut into ``ranges`` (as many as the engine
    chooses), wherever a conversation is. A range counts all conversations that begin in it. Of the one in front it makes a
    step function from the memory at entry to the memory at the end; the functions of a conversation's ranges, some dozens of
    numbers each, are followed in order, and then the messages in front are counted with the memory they meet. So the
    longest conversation costs one lookup for each range.
    """
    rule = Rule(threshold, base_tokens, base_tokens + summary_tokens)
    spark, kind = messages.sparkSession, messages.schema[key].dataType.simpleString()
    costs = messages.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("cost")
    )
    cut = [F.col("key"), F.col("turn")] if ranges is None else [ranges, F.col("key"), F.col("turn")]
    path = scratch_path(spark, "epochs")
    counted = f"key {kind}, turn long, total long, epoch int, compressed boolean"
    schema = f"part int, {counted}, cost long, steps {STEPS_SQL}"
    ordered = costs.repartitionByRange(*cut).sortWithinPartitions("key", "turn")
    ordered.mapInArrow(scan_ranges(rule), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    names = ["key", "turn", "total", "epoch", "compressed"]
    edges = rows.where("steps is not null").select("part", "key", "steps")
    entries = (
        edges.repartition("key")
        .sortWithinPartitions("key", "part")
        .mapInArrow(follow_ranges(rule), "part int, in_total long, in_epoch long")
    )
    fronts = (
        rows.where("cost is not null")
        .select("part", "key", "turn", "cost")
        .join(F.broadcast(entries), "part")  # one row for each range
        .repartition("part")
        .sortWithinPartitions("part", "turn")
        .mapInArrow(scan_fronts(rule), counted)
    )
    done = rows.where("total is not null").select(*names).unionByName(fronts)
    return done.withColumnsRenamed({"key": key, "turn": turn})


# --- transcripts (H2, H3, H7, H11) ----------------------------------------------------------------------------


def transcript_line(
    role: Column, content: Column, name: Column, call_name: Column, call_arguments: Column
) -> Column:
    """One message as a line: a call, a result of a call, or a plain message. The forms are fixed values."""
    return (
        F.when(
            call_name.isNotNull(),
            F.concat(F.lit("calling function "), call_name, F.lit("("), F.coalesce(call_arguments, F.lit("")), F.lit(")")),
        )
        .when(
            name.isNotNull(),
            F.concat(F.lit("function "), name, F.lit(" returned: "), F.coalesce(content, F.lit("None"))),
        )
        .otherwise(F.concat(role, F.lit(": "), F.coalesce(content, F.lit("None"))))
    )


def format_transcript(messages: DataFrame, line: Column, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """H2: the lines of each conversation in order of turn, joined by newline, as (key, transcript).

    One row for a conversation, whatever its turns are; turns are unique. The text itself is the result, so a row
    is as large as its conversation.
    """
    lines = messages.select(key, F.struct(F.col(turn), line.alias("_line")).alias("_at"))
    ordered = F.array_sort(F.collect_list("_at"))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n").alias("transcript"))


def epoch_transcripts(
    messages: DataFrame,
    line: Column,
    threshold: int = MEMORY_TOKENS,
    base_tokens: int = 0,
    summary_tokens: int = 0,
    cost: str = "cost",
    key: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """H1 with H2: (key, epoch, transcript) of what each compression summarizes: the lines of all messages of the
    epoch, the compressing one included. An epoch that no message completes gives no row."""
    epochs = memory_epochs(messages, threshold, base_tokens, summary_tokens, cost, key, turn)
    done = epochs.filter("compressed").select(key, "epoch")
    lines = messages.select(key, F.col(turn).cast("long").alias(turn), line.alias("_line"))
    placed = lines.join(epochs.select(key, turn, "epoch"), [key, turn]).join(done, [key, "epoch"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct(turn, "_line")))
    return placed.groupBy(key, "epoch").agg(
        F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n").alias("transcript")
    )


def latest_system_first(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """H3: newest system message in front, older ones dropped, the others in order; ``position`` counts from 1."""
    is_system = F.col("role") == "system"
    newest = messages.groupBy(key).agg(F.max(F.when(is_system, F.col(turn))).alias("_newest"))
    kept = messages.join(newest, key).filter(~is_system | (F.col(turn) == F.col("_newest")))
    counted = running_sum(
        kept.withColumn("_other", (~is_system).cast("int")), key, turn, "_other", "_before"
    )
    position = F.when(is_system, F.lit(1)).otherwise(
        F.col("_before") + F.col("_newest").isNotNull().cast("int")
    )
    return counted.withColumn("position", position.cast("int")).drop("_newest", "_other", "_before")


def termination(
    messages: DataFrame,
    function: str,
    threshold: int = AGENT_STEPS,
    key: str = "conv_id",
    turn: str = "turn",
    call: str = "function_call_name",
) -> DataFrame:
    """H7: (key, step, terminated): at which step the final call came, and whether within the allowed steps.

    A step is one assistant message. Two aggregations by conversation, no sort of its messages.
    """
    steps = messages.filter(F.col("role") == "assistant").select(key, turn, call)
    ends = steps.groupBy(key).agg(F.min(F.when(F.col(call) == function, F.col(turn))).alias("_end"))
    counted = (
        steps.join(ends, key)
        .groupBy(key, "_end")
        .agg(F.sum((F.col(turn) <= F.col("_end")).cast("long")).alias("_steps"))
    )
    all_keys = messages.select(key).distinct()
    step = F.when(F.col("_end").isNotNull(), F.col("_steps"))
    return all_keys.join(counted, key, "left").select(
        key, step.alias("step"), F.coalesce(step <= threshold, F.lit(False)).alias("terminated")
    )


def assemble_deltas(
    pieces: DataFrame, key: str = "response_id", seq: str = "seq", delta: str = "delta"
) -> DataFrame:
    """Non-empty pieces of each response joined in order of ``seq``, as (key, text), one row for a response."""
    filled = pieces.filter(F.col(delta).isNotNull() & (F.col(delta) != ""))
    ordered = F.array_sort(F.collect_list(F.struct(seq, delta)))
    return filled.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r[delta]), "").alias("text"))


# --- replies (H4, H5, H6, H8, H9) -----------------------------------------------------------------------------

ANSWER_MARK = "ANSWER:"  # fixed value
VERDICT_PATTERN = r"(?i)^ANSWER:\s*(True|False|Unsure)"  # fixed value
EXPLANATION_PATTERN = r"EXPLANATION:\s*(.*)"  # fixed value


def extract_answer(content: Column) -> Column:
    """H4: text after the first answer mark, trimmed; NULL when the reply is not final."""
    at = F.instr(content, ANSWER_MARK)
    return F.when(at > 0, strip_space(F.substr(content, at + len(ANSWER_MARK), F.length(content))))


def extract_verdict(content: Column) -> Column:
    """H5: struct(verdict, is_valid, explanation) of a reply that opens with a verdict."""
    verdict = F.regexp_extract(content, VERDICT_PATTERN, 1)
    present = verdict != ""
    note = F.regexp_extract(content, EXPLANATION_PATTERN, 1)
    has_note = content.rlike(EXPLANATION_PATTERN)
    return F.struct(
        F.when(present, verdict).alias("verdict"),
        F.when(present & (F.lower(verdict) != "unsure"), F.lower(verdict) == "true").alias("is_valid"),
        F.when(present & has_note, strip_space(note)).alias("explanation"),
    )


def validate_tool_calls(calls: DataFrame, tools: DataFrame, name: str = "name") -> DataFrame:
    """H6: ``status`` of each call and the arguments its tool accepts; ``tools`` is (name, accepted)."""
    known = tools.select(F.col("name").alias(name), F.col("accepted").alias("_accepted"))
    parsed = calls.join(known, name, "left").withColumn(
        "_parsed", F.from_json(F.coalesce("arguments", F.lit("{}")), "map<string,string>")
    )
    status = (
        F.when(F.col("_accepted").isNull(), "unknown_function")
        .when(F.col("_parsed").isNull(), "bad_json")
        .otherwise("ok")
    )
    kept = F.map_filter("_parsed", lambda k, v: F.array_contains(F.col("_accepted"), k))
    return (
        parsed.withColumn("status", status)
        .withColumn("accepted_arguments", F.when(F.col("status") == "ok", kept))
        .drop("_accepted", "_parsed")
    )


def extract_fenced_code(reply: Column, language: str) -> Column:
    """H8: text between the first fence of the language and the next fence, trimmed; NULL when there is none."""
    fence = "```" + language
    parts = F.split(reply, "\\Q" + fence + "\\E")
    body = F.get(parts, F.lit(1))
    return F.when(F.size(parts) > 1, strip_space(F.get(F.split(body, "```"), F.lit(0))))


def needs_elaboration(plan: Column, wanted: int = 7) -> Column:
    """H9: fewer bullets than wanted, counting the commoner bullet sign."""
    dashes = F.regexp_count(plan, F.lit(r"\n-"))
    stars = F.regexp_count(plan, F.lit(r"\n\*"))
    return F.greatest(dashes, stars) < wanted


UNKNOWN_TOOL = "Unknown tool"


def dispatch_tool_calls(
    calls: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], key: str = "call_id"
) -> DataFrame:
    """K2: (key, name, argument, answer) of each call(key, name, argument), answered by the tool of that name.

    A tool maps distinct arguments(argument) to (argument, answer); all tools run in one job, each on its own calls. An
    argument that a tool gives no answer for has a NULL one; a name without a tool is answered by a message.
    """
    answers = None
    for name, tool in tools.items():
        asked = calls.filter(F.col("name") == name).select("argument").distinct()
        found = tool(asked).select(F.lit(name).alias("name"), "argument", F.col("answer").cast("string").alias("answer"))
        answers = found if answers is None else answers.unionByName(found)
    rows = calls.select(key, "name", "argument")
    unknown = ~F.col("name").isin(*tools) if tools else F.lit(True)
    joined = rows.join(answers, ["name", "argument"], "left") if answers is not None else rows.withColumn("answer", F.lit(None).cast("string"))
    return joined.select(key, "name", "argument", F.when(unknown, F.lit(UNKNOWN_TOOL)).otherwise(F.col("answer")).alias("answer"))


# --- prompts (H10) and model calls (H12) ----------------------------------------------------------------------

# %s slots are filled from the columns in PROMPT_COLUMNS, in order
PROMPTS = {
    "explain": "In plain words, what is this %s function for and how does it work?\n\n```%s\n%s\n```",
    "refactor": "Improve the structure of the %s function below without changing its results.%s\n\n```%s\n%s\n```",
    "question": "Using nothing but this code, answer the question; if the code leaves it open, say so.\n```\n%s\n```\nQuestion: %s",
    "code_question": "Using nothing but this code, answer the question; if the code leaves it open, say so.\n```\n%s\n```\nQuestion: %s\nFormat: markdown.",
    "explain_in_depth": "Go through this %s function part by part; one bullet for each part and its reason.\n\n```%s\n%s\n```",
    "scenario_plan": "Which cases should a `%s` suite for this function cover? One bullet a case, examples below it.",
    "elaborate": "The plan is short. Add at least one unusual case for the `%s` suite in the same bullet form.",
    "unit_tests": "Turn these cases into a `%s` suite in %s; code only.\n\n```%s\n# under test\n%s\n```",
    "summarize": "Condense this conversation so that the task can go on from the summary alone.\n%s",
    "validate_answer": "Does the reply settle the question?\nQuestion: %s\nReply: %s\nUse the two lines\nANSWER: True, False or Unsure\nEXPLANATION: your reason",
    "retry_answer": "%s\nAn earlier reply did not hold:\n%s\nReason:\n%s\nGive a new one after the word ANSWER:",
    "system_explain": "You teach %s to people who read code for the first time.",
    "system_refactor": "You review %s code and suggest small, safe changes.",
}
PROMPT_COLUMNS = {
    "explain": ("language", "language", "code"),
    "refactor": ("language", "instructions", "language", "code"),
    "question": ("code", "question"),
    "code_question": ("code", "question"),
    "explain_in_depth": ("language", "language", "code"),
    "scenario_plan": ("package",),
    "elaborate": ("package",),
    "unit_tests": ("package", "language", "language", "code"),
    "summarize": ("transcript",),
    "validate_answer": ("question", "answer"),
    "retry_answer": ("question", "answer", "explanation"),
    "system_explain": ("language",),
    "system_refactor": ("language",),
}


def render_prompt(kind: str, templates: dict[str, str] = PROMPTS) -> Column:
    """Prompt of one kind from the columns it names; missing values read as empty."""
    values = []
    for column in PROMPT_COLUMNS[kind]:
        value = F.coalesce(F.col(column), F.lit(""))
        if column == "instructions":
            value = F.when(value != "", F.concat(F.lit(" Wishes: "), value)).otherwise(F.lit(""))
        values.append(value)
    return F.format_string(templates[kind], *values)


def bulk_generate(
    df: DataFrame,
    prompt: str,
    generate: Callable[[list[str]], list[str | Exception]],
    key: str,
    attempts: int = ATTEMPTS,
    wait_min: float = WAIT_MIN,
    wait_max: float = WAIT_MAX,
    together: int = 64,
) -> DataFrame:
    """(key, reply, attempts, error): replies of the caller's model, which takes up to ``together`` prompts at once
    and gives a reply or an exception for each. Only failed rows are asked again, after random exponential waits; one that
    keeps failing carries its error instead of failing the job. A task has one call open at a time."""

    def call(texts: list[str]) -> list[tuple[str | None, int, str | None]]:
        out: list = [None] * len(texts)
        left = list(range(len(texts)))
        for number in range(1, attempts + 1):
            try:
                replies = generate([texts[i] for i in left])
            except Exception as problem:  # any failure of the caller's model is retried
                replies = [problem] * len(left)
            for i, reply in zip(left, replies, strict=True):
                bad = isinstance(reply, Exception)
                out[i] = (None, number, f"{type(reply).__name__}: {reply}") if bad else (reply, number, None)
            left = [i for i in left if out[i][2] is not None]
            if not left:
                break
            if number < attempts and wait_max:
                time.sleep(max(wait_min, random.uniform(0, min(wait_max, 2.0**number))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[prompt].tolist()
            replies = [r for at in range(0, len(texts), together) for r in call(texts[at : at + together])]
            columns = zip(*replies, strict=True) if replies else ([], [], [])
            yield pd.DataFrame({key: batch[key]} | {n: list(c) for n, c in zip(("reply", "attempts", "error"), columns)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, attempts int, error string")
