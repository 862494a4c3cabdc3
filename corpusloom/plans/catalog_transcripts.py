"""Registered queries: conversation memory, replies, prompts, streams."""

from pyspark.sql import functions as F

from corpusloom.operators import transcripts as ops
from corpusloom.operators.files import lookup_file_contents
from corpusloom.operators.graph import children
from corpusloom.operators.tokens import message_tokens
from corpusloom.plans.catalog_files import MODEL
from corpusloom.plans.catalog_search import MESSAGE_COST
from corpusloom.plans.derived import agent_replies, code_files, graph_edges, graph_nodes, repo_files, with_views
from corpusloom.plans.registry import query, table
from corpusloom.schemas import CODE_FILE, MESSAGE
from corpusloom.session import scratch_path
from corpusloom.sources.index_log import load_log
from corpusloom.streaming.memory import OUTPUT, stream_memory_epochs as stream_epochs
from corpusloom.streaming.refresh import stream_refresh_index as stream_refresh

THRESHOLD, BASE, SUMMARY = 500, 20, 50

SMALL = 60


def _epochs(threshold: int, summary: int) -> str:
    return f"""with recursive m as (select conv_id, turn, {MESSAGE_COST} as cost,
      row_number() over (partition by conv_id order by turn) as rn from conversations),
    s(conv_id, turn, rn, total, epoch, compressed) as (
      select conv_id, turn, rn, {BASE} + cost, 0, {BASE} + cost >= {threshold} from m where rn = 1
      union all
      select m.conv_id, m.turn, m.rn, (case when s.compressed then {BASE + summary} else s.total end) + m.cost,
        s.epoch + s.compressed::int,
        (case when s.compressed then {BASE + summary} else s.total end) + m.cost >= {threshold}
      from s join m on m.conv_id = s.conv_id and m.rn = s.rn + 1)
    select conv_id, turn, total::bigint as total, epoch::int as epoch, compressed from s"""


_EPOCHS = _epochs(THRESHOLD, SUMMARY)


def _costs(messages):
    return messages.withColumn("cost", message_tokens([F.col("role"), F.col("text")]))


@query(_EPOCHS)
def memory_epochs(spark, sf_dir):
    return ops.memory_epochs(_costs(table(spark, sf_dir, "conversations")), THRESHOLD, BASE, SUMMARY)


@query(_epochs(SMALL, 0))
def memory_epochs_distributed(spark, sf_dir):
    """As above with a budget that nearly every message exhausts: long chains of compressions."""
    return ops.memory_epochs(_costs(table(spark, sf_dir, "conversations")), SMALL, BASE, 0)


@query(_EPOCHS)
def stream_memory_epochs(spark, sf_dir):
    messages = spark.readStream.schema(MESSAGE).parquet(f"{sf_dir}/conversations*.parquet")
    rows = stream_epochs(_costs(messages), THRESHOLD, BASE, SUMMARY)
    path = scratch_path(spark, "epochs")
    run = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, "epochs-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(path)


@query(with_views("select path as filepath, ordinal, code from code_blocks where path not like '%/.hidden/%'", "code_blocks"))
def stream_refresh_index(spark, sf_dir):
    source = scratch_path(spark, "arrivals")
    repo_files(spark, sf_dir).withColumn("modified", F.lit("2024-01-01").cast("timestamp")).write.parquet(source)
    path, state = scratch_path(spark, "streamed-index"), scratch_path(spark, "streamed-state")
    arrivals = spark.readStream.schema(CODE_FILE).parquet(source)
    stream_refresh(arrivals, path, MODEL, state).awaitTermination()
    return load_log(spark, path, MODEL).select("filepath", "ordinal", "code")


@query(
    f"""with recursive e as ({_EPOCHS.replace("with recursive m as", "with recursive m as")})
    select e.conv_id, e.epoch, string_agg(c.role || ': ' || c.text, chr(10) order by e.turn) as transcript
    from e join conversations c using (conv_id, turn)
    where (e.conv_id, e.epoch) in (select conv_id, epoch from e where compressed) group by 1, 2"""
)
def epoch_transcripts(spark, sf_dir):
    none = F.lit(None).cast("string")
    line = ops.transcript_line(F.col("role"), F.col("text"), none, none, none)
    return ops.epoch_transcripts(_costs(table(spark, sf_dir, "conversations")), line, THRESHOLD, BASE, SUMMARY)


_LINE = """case when function_call_name is not null
      then 'calling function ' || function_call_name || '({"turn": ' || turn || '})'
    when turn % 4 = 3 then 'function tool returned: ' || content else role || ': ' || content end"""


@query(
    with_views(
        f"select conv_id, string_agg({_LINE}, chr(10) order by turn) as transcript from agent_replies group by 1",
        "agent_replies",
    )
)
def format_transcript(spark, sf_dir):
    line = ops.transcript_line(
        F.col("role"),
        F.col("content"),
        F.when(F.col("turn") % 4 == 3, F.lit("tool")),
        F.col("function_call_name"),
        F.format_string('{"turn": %s}', "turn"),
    )
    return ops.format_transcript(agent_replies(spark, sf_dir), line)


@query(
    """with n as (select conv_id, max(turn) filter (where role = 'system') as newest from conversations group by 1)
    select c.conv_id, turn, role, row_number() over (partition by c.conv_id order by role <> 'system', turn)::int as position
    from conversations c join n using (conv_id) where role <> 'system' or turn = newest"""
)
def latest_system_first(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ops.latest_system_first(messages).select("conv_id", "turn", "role", "position")


@query(
    with_views(
        r"""select conv_id, turn, case when contains(content, 'ANSWER:') then regexp_replace(
        substr(content, instr(content, 'ANSWER:') + 7), '^\s+|\s+$', '', 'g') end as answer from agent_replies""",
        "agent_replies",
    )
)
def extract_answer(spark, sf_dir):
    return agent_replies(spark, sf_dir).select("conv_id", "turn", ops.extract_answer(F.col("content")).alias("answer"))


@query(
    with_views(
        r""", v as (select conv_id, turn, content, regexp_extract(content, '(?i)^ANSWER:\s*(True|False|Unsure)', 1) as verdict
          from agent_replies)
        select conv_id, turn, nullif(verdict, '') as verdict,
        case when verdict <> '' and lower(verdict) <> 'unsure' then lower(verdict) = 'true' end as is_valid,
        case when verdict <> '' and contains(content, 'EXPLANATION:') then regexp_replace(
          regexp_extract(content, 'EXPLANATION:\s*([^\n]*)', 1), '^\s+|\s+$', '', 'g') end as explanation from v""",
        "agent_replies",
    )
)
def extract_verdict(spark, sf_dir):
    verdict = ops.extract_verdict(F.col("content")).alias("v")
    return agent_replies(spark, sf_dir).select("conv_id", "turn", verdict).select("conv_id", "turn", "v.*")


@query(
    """select event_id, case when event_type = 'error' then 'unknown_function' when event_type = 'view' then 'bad_json'
    else 'ok' end as status,
    case when event_type not in ('error', 'view') then case when event_type = 'click' then regexp_extract(props, '[0-9]+') else '' end
    end as kept from events"""
)
def validate_tool_calls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    arguments = F.when(F.col("event_type") == "view", F.concat(F.lit("["), "props")).otherwise(F.col("props"))
    calls = events.select("event_id", F.col("event_type").alias("name"), arguments.alias("arguments"))
    accepted = F.when(F.col("name") == "click", F.array(F.lit("k"), F.lit("n"))).otherwise(F.array(F.lit("n")))
    tools = calls.select("name").distinct().filter(F.col("name") != "error").withColumn("accepted", accepted)
    checked = ops.validate_tool_calls(calls, tools)
    return checked.select(
        "event_id", "status", F.array_join(F.map_values("accepted_arguments"), ",").alias("kept")
    )


@query(
    with_views(
        """, a as (select conv_id, turn, function_call_name as f, row_number() over (partition by conv_id order by turn) as n
          from agent_replies where role = 'assistant'),
        e as (select conv_id, min(n) filter (where f = 'semantic_search') as step from a group by 1)
        select conv_id, step::bigint as step, coalesce(step <= 2, false) as terminated
        from (select distinct conv_id from agent_replies) left join e using (conv_id)""",
        "agent_replies",
    )
)
def termination(spark, sf_dir):
    return ops.termination(agent_replies(spark, sf_dir), "semantic_search", 2)


@query(
    with_views(
        "select conv_id, turn, case when turn % 4 = 2 then 'x = ' || conv_id end as code from agent_replies",
        "agent_replies",
    )
)
def extract_fenced_code(spark, sf_dir):
    return agent_replies(spark, sf_dir).select(
        "conv_id", "turn", ops.extract_fenced_code(F.col("content"), "python").alias("code")
    )


@query(
    with_views(
        r"""select conv_id, turn, greatest(len(regexp_extract_all(content, '\n-')), len(regexp_extract_all(content, '\n\*'))) < 2
        as needed from agent_replies""",
        "agent_replies",
    )
)
def needs_elaboration(spark, sf_dir):
    return agent_replies(spark, sf_dir).select(
        "conv_id", "turn", ops.needs_elaboration(F.col("content"), 2).alias("needed")
    )


def _prompt_sql() -> str:
    """The templates filled in by nested replacement of their slots."""
    values = {
        "language": "'python'",
        "code": "content",
        "question": "role",
        "instructions": "' Wishes: ' || role",
        "package": "'pytest'",
        "answer": "content",
        "explanation": "role",
        "transcript": "content",
    }
    parts = []
    for kind, template in ops.PROMPTS.items():
        pieces = ["'" + p.replace("'", "''") + "'" for p in template.split("%s")]
        filled = pieces[0]
        for column, piece in zip(ops.PROMPT_COLUMNS[kind], pieces[1:]):
            filled += f" || ({values[column]}) || {piece}"
        parts.append(f"select conv_id, turn, '{kind}' as kind, {filled} as prompt from agent_replies")
    return with_views(" union all ".join(parts), "agent_replies")


@query(_prompt_sql())
def render_prompts(spark, sf_dir):
    rows = agent_replies(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.lit("python").alias("language"),
        F.lit("pytest").alias("package"),
        F.col("content").alias("code"),
        F.col("content").alias("answer"),
        F.col("role").alias("question"),
        F.col("role").alias("instructions"),
        F.col("role").alias("explanation"),
        F.col("content").alias("transcript"),
    )
    kinds = [F.struct(F.lit(k).alias("kind"), ops.render_prompt(k).alias("prompt")) for k in ops.PROMPTS]
    return rows.select("conv_id", "turn", F.explode(F.array(*kinds)).alias("p")).select("conv_id", "turn", "p.*")


@query(
    """select user_id as response_id, string_agg(event_type, '' order by event_id) as text
    from events where event_type <> 'error' group by 1"""
)
def assemble_deltas(spark, sf_dir):
    pieces = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("response_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("delta"),
    )
    return ops.assemble_deltas(pieces)


@query("select doc_id, length(text)::varchar as reply, 1 as attempts, null::varchar as error from documents")
def bulk_generate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ops.bulk_generate(docs, "text", lambda prompts: [str(len(p)) for p in prompts], "doc_id")


@query(
    with_views(
        """, calls as (select file_id as call_id, case file_id % 3 when 0 then 'view_file' when 1 then 'callees' else 'fly' end
          as name, case file_id % 3 when 0 then path else 'f_' || file_id end as argument from code_files),
        below as (select src, string_agg(dst, ',' order by dst) as dsts from graph_edges group by 1)
        select call_id, name, argument, case name when 'view_file' then content when 'callees' then dsts
          else 'Unknown tool' end as answer
        from calls left join code_files on path = argument left join below on src = argument""",
        "code_files",
        "graph_edges",
    )
)
def dispatch_tool_calls(spark, sf_dir):
    files, edges, nodes = code_files(spark, sf_dir), graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir)

    def view_file(asked):
        found = lookup_file_contents(asked.select(F.col("argument").alias("filepath")), files)
        return found.select(F.col("filepath").alias("argument"), F.col("content").alias("answer"))

    def callees(asked):
        found = children(edges, asked.select(F.col("argument").alias("name")), nodes)
        return found.groupBy(F.col("name").alias("argument")).agg(
            F.array_join(F.array_sort(F.collect_list("child")), ",").alias("answer")
        )

    kind = F.col("file_id") % 3
    calls = files.select(
        F.col("file_id").alias("call_id"),
        F.when(kind == 0, "view_file").when(kind == 1, "callees").otherwise("fly").alias("name"),
        F.when(kind == 0, F.col("path")).otherwise(F.concat(F.lit("f_"), "file_id")).alias("argument"),
    )
    return ops.dispatch_tool_calls(calls, {"view_file": view_file, "callees": callees})
