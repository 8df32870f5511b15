"""Batch inference with deterministic offline callables."""

import json

from trainset.functions.text import parse_reply
from trainset.operators import infer as I
from trainset.operators.ordered import with_seq_position
from trainset.queries.common import F, long, query, table
from trainset.queries.mixing import prompt_pool_turns


def upper(prompts):
    return [p.split("\n\n", 1)[-1].upper() for p in prompts]


def echo(prompts):
    return [p[::-1] for p in prompts]


def length_judge(prompts):
    """Prefer the longer answer; equal lengths tie; very short ones are both bad."""
    out = []
    for p in prompts:
        a, b = p.split("\n\n[first]\n", 1)[1].split("\n\n[end]\n", 1)[0].split("\n\n[second]\n", 1)
        winner = "both_bad" if max(len(a), len(b)) < 200 else "tie" if len(a) == len(b) else "A" if len(a) > len(b) else "B"
        out.append('Here you go:\n```json\n{"winner": "%s", "reason": "length"}\n```' % winner)
    return out


@query(
    "rewrite_turns",
    "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN length(text) END AS answer_chars, role = 'assistant' AS changed FROM conversations",
)
def rewrite_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = I.rewrite_turns(turns.withColumnRenamed("text", "content"), lambda ps: [p.split("\n\n", 1)[-1][::-1] for p in ps], "backwards")
    both = out.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn", "role", F.when(F.col("role") == "assistant", long(F.length("content"))).alias("answer_chars"),
        ((F.reverse("content") == F.col("text")) & (F.col("role") == "assistant")).alias("changed"),
    )


@query(
    "parse_replies",
    """SELECT event_type, count(*) AS replies, count(*) FILTER (event_type <> 'error') AS parsed,
       CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS k_sum FROM events GROUP BY 1""",
)
def parse_replies(spark, sf_dir):
    """Plain JSON, a fenced block, JSON inside prose, and no JSON at all."""
    p, kind = F.col("props"), F.col("event_type")
    reply = (
        F.when(kind == "click", p)
        .when(kind == "view", F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone.")))
        .when(kind == "purchase", F.concat(F.lit("The answer is "), p, F.lit(" as asked")))
        .when(kind == "error", F.lit("no data"))
        .otherwise(F.concat(F.lit("```\n"), p, F.lit("\n```")))
    )
    rows = table(spark, sf_dir, "events").select("event_type", parse_reply(reply).alias("v"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("replies"), F.count("v").alias("parsed"), F.coalesce(F.sum(F.try_variant_get("v", "$.k", "long")), F.lit(0)).alias("k_sum")
    )


@query(
    "build_prompts",
    """WITH p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark)
    SELECT CAST(floor(pos / 4) AS BIGINT) AS batch, 'Task: answer briefly' || chr(10) || 'Answers in each conversation: 2' || chr(10) ||
      'Style: dry' || chr(10) || 'Avoid: jokes' || chr(10) || chr(10) || 'Scenarios:' || chr(10) ||
      string_agg((pos % 4 + 1) || '. ' || text, chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Answer with JSON: {"examples": [{"messages": [...]}]}, an example for each number.' AS prompt
    FROM p GROUP BY 1""",
)
def build_prompts(spark, sf_dir):
    scenarios = with_seq_position(table(spark, sf_dir, "benchmark"), "item_id", "pos")
    return I.build_prompts(scenarios, I.Brief("answer briefly", answers=2, wishes={"Style": "dry", "Avoid": "jokes"}), text="text")


@query(
    "plan_scenarios",
    f"SELECT count(DISTINCT lower(source)) AS scenarios FROM documents",
)
def plan_scenarios(spark, sf_dir):
    """Planning replies repeat scenarios in other spellings."""
    reply = F.concat(F.lit('{"scenarios": ["'), F.col("source"), F.lit(' ", "'), F.upper("source"), F.lit('", " "]}'))
    plan = I.plan_scenarios(table(spark, sf_dir, "documents").select(reply.alias("reply")))
    return plan.agg(F.count(F.lit(1)).alias("scenarios"))


def writer(prompts):
    """One short conversation per numbered line of the prompt."""
    out = []
    for p in prompts:
        lines = p.split("Scenarios:\n", 1)[1].split("\n\nAnswer with", 1)[0].split("\n")
        asked = [x for x in lines if x[:1].isdigit()]
        ex = [{"messages": [{"role": "user", "content": x}, {"role": "assistant", "content": "Answer: " + x[3:40]}]} for x in asked]
        out.append(json.dumps({"examples": ex}))
    return out


@query("generate_traces")
def generate_traces(spark, sf_dir):
    prompts = build_prompts(spark, sf_dir)
    replies = I.batch_complete(prompts, "prompt", writer, workers=4)
    made = I.generated_records(replies, "synthetic:offline")
    return made.select("seq", "kind", long(F.size("messages")).alias("messages"), "meta_source", "meta_synthetic")


@query(
    "generate_pairs",
    "SELECT item_id * 2147483648 AS seq, 1 AS messages, length(text) AS chosen_chars, length(left(text, 20)) AS rejected_chars, 'synthetic:offline' AS meta_source FROM benchmark",
)
def generate_pairs(spark, sf_dir):
    def answer(prompts):
        return [json.dumps({"pairs": [{"prompt": "Say it", "chosen": p, "rejected": p[:20], "why": "longer"}]}) for p in prompts]

    replies = I.batch_complete(table(spark, sf_dir, "benchmark"), "text", answer)
    pairs = I.generated_pairs(replies, "synthetic:offline", key="item_id")
    alt = lambda c: long(F.length(F.get(c, F.lit(0))["content"]))
    return pairs.select("seq", long(F.size("messages")).alias("messages"), alt("chosen").alias("chosen_chars"), alt("rejected").alias("rejected_chars"), "meta_source")


def prompts(spark, sf_dir):
    """The last user turn of every conversation."""
    pool = prompt_pool_turns(spark, sf_dir)
    return pool.groupBy(F.col("conv_id").alias("row_id")).agg(F.max_by("text", "turn").alias("ask"))


@query(
    "generate_candidates",
    """SELECT conv_id AS row_id, length(arg_max(text, turn)) + 3 AS first_chars, length(arg_max(text, turn)) + 3 AS second_chars, 2 AS answers
       FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def generate_candidates(spark, sf_dir):
    made = I.generate_candidates(prompts(spark, sf_dir), "ask", echo, 2)
    chars = lambda i: long(F.length(F.get("candidates", F.lit(i))))
    return made.select("row_id", chars(0).alias("first_chars"), chars(1).alias("second_chars"), long(F.size("candidates")).alias("answers"))


def judged(spark, sf_dir):
    """Two answers per conversation, its first and its last assistant turn, judged by length."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = turns.groupBy(F.col("conv_id").alias("row_id")).agg(
        F.min_by("text", "turn").alias("x"), F.when(F.count(F.lit(1)) > 1, F.max_by("text", "turn")).alias("y")
    )
    pairs = rows.select("row_id", F.lit("Which?").alias("ask"), F.array_compact(F.array("x", "y")).alias("candidates"))
    return I.judge_pairs(pairs, "ask", length_judge, "longer is better")


_JUDGED = """WITH x AS (SELECT conv_id, arg_min(text, turn) AS a, CASE WHEN count(*) > 1 THEN arg_max(text, turn) END AS b FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT *, CASE WHEN b IS NULL THEN 'skipped' WHEN greatest(length(a), length(b)) < 200 THEN 'both_bad' WHEN length(a) = length(b) THEN 'tie'
  WHEN length(a) > length(b) THEN 'A' ELSE 'B' END AS verdict FROM x) """


@query("judge_pairs", _JUDGED + "SELECT conv_id AS row_id, verdict FROM j")
def judge_pairs(spark, sf_dir):
    return judged(spark, sf_dir).select("row_id", "verdict")


@query("verdict_report", _JUDGED + "SELECT verdict, count(*) AS n FROM j GROUP BY verdict")
def verdict_report(spark, sf_dir):
    return I.verdict_report(judged(spark, sf_dir))


@query(
    "pairs_from_verdicts",
    _JUDGED + """SELECT conv_id AS row_id, greatest(length(a), length(b)) AS chosen_chars, least(length(a), length(b)) AS rejected_chars,
    'preferences:first-last' AS meta_source, 'ai:offline' AS judge FROM j WHERE verdict IN ('A', 'B')""",
)
def pairs_from_verdicts(spark, sf_dir):
    pairs = I.pairs_from_verdicts(judged(spark, sf_dir), "first-last", "ai:offline")
    return pairs.select("row_id", long(F.length("chosen")).alias("chosen_chars"), long(F.length("rejected")).alias("rejected_chars"), "meta_source", "judge")


@query(
    "apply_corrections",
    _JUDGED + """SELECT conv_id AS row_id, CASE WHEN conv_id % 4 = 1 THEN least(length(a), length(b)) ELSE greatest(length(a), length(b)) END AS chosen_chars,
    CASE WHEN conv_id % 4 = 1 THEN 'user (corrected ai)' ELSE 'ai:offline' END AS judge FROM j WHERE verdict IN ('A', 'B') AND conv_id % 4 <> 2""",
)
def apply_corrections(spark, sf_dir):
    pairs = I.pairs_from_verdicts(judged(spark, sf_dir), "first-last", "ai:offline")
    k = F.pmod("row_id", F.lit(4))
    verdict = F.when(k == 0, F.lit("A")).when(k == 1, F.lit("B")).when(k == 2, F.lit("both_bad"))
    corrections = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id")).distinct().withColumn("verdict", verdict)
    out = I.apply_corrections(pairs, corrections.where("verdict IS NOT NULL"))
    return out.select("row_id", long(F.length("chosen")).alias("chosen_chars"), "judge")


@query(
    "compare_answers",
    """SELECT conv_id AS row_id, upper(arg_max(text, turn)) <> reverse(arg_max(text, turn)) AS differ, length(arg_max(text, turn)) AS second_chars
       FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def compare_answers(spark, sf_dir):
    both = I.compare_answers(prompts(spark, sf_dir), "ask", lambda ps: [p.upper() for p in ps], echo)
    return both.select("row_id", (F.col("first_answer") != F.col("second_answer")).alias("differ"), long(F.length("second_answer")).alias("second_chars"))
