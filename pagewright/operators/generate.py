"""Text generation re-aimed as batch inference.

The model is a caller-supplied function ``fn(list[dict]) -> list[(text,
prompt_tokens, completion_tokens)]`` run once per Arrow batch inside
``mapInPandas`` (parallelism = partition count). Each request dict holds
``system``, ``user`` and ``temperature``, and ``max_tokens`` where the answer
is limited. Without a function the default is a deterministic native renderer,
so no Python runs at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagewright import fixed
from pagewright.functions import markdown as MD
from pagewright.functions import text as T
from pagewright.operators.order import running_totals
from pagewright.session import scratch_table, ship_package


def user_prompt(title, content) -> Column:
    """``Title: {t}\\n\\nContent: {c}``."""
    return F.concat(F.lit("Title: "), title, F.lit("\n\nContent: "), content)


def prompts(df: DataFrame, title: str = "title", content: str = "main_text") -> DataFrame:
    """Prompt table with a token estimate for the forecast. The system
    prompt is a literal, so its estimate is folded to a constant."""
    return (df.withColumn("user_prompt", user_prompt(F.col(title), F.col(content)))
            .withColumn("temperature", F.lit(fixed.GENERATE_TEMPERATURE))
            .withColumn("prompt_tokens_est", T.token_estimate(F.lit(fixed.SYSTEM_PROMPT))
                        + T.token_estimate(F.col("user_prompt"))))


def default_render(title, content) -> Column:
    """Native stand-in for the model: a markdown page (C16 section format)."""
    return F.concat(MD.format_section(title, 2), content, F.lit("\n"))


def _with_fields(schema: StructType, text_col: str, p_col: str, c_col: str, e_col: str) -> StructType:
    """``schema`` plus a text column, two token-count columns and an error."""
    return StructType(list(schema.fields) + [StructField(text_col, StringType()), StructField(p_col, LongType()),
                                             StructField(c_col, LongType()), StructField(e_col, StringType())])


def _answers(fn, reqs: list[dict]) -> list[tuple]:
    """(text, prompt tokens, completion tokens, error) of every request. A
    call that fails, or returns another number of answers than asked, is
    repeated request by request; a request that fails alone has a NULL text,
    no usage and its error."""
    def call(part):
        res = list(fn(part))
        if len(res) != len(part):
            raise ValueError(f"{len(res)} answers to {len(part)} requests")
        return [(text, int(p), int(c), None) for text, p, c in res]

    try:
        return call(reqs) if reqs else []
    except Exception as error:
        if len(reqs) == 1:
            return [(None, 0, 0, f"{type(error).__name__}: {error}")]
        return [row for r in reqs for row in _answers(fn, [r])]


def _run_fn(fn, system: str, temperature: float, out_col: str,
            p_col: str = "prompt_tokens", c_col: str = "completion_tokens", e_col: str = "generate_error",
            limit: dict | None = None):
    """Per Arrow batch: one call of ``fn`` for the batch's requests (rows with
    a NULL request are passed on without one); the text, the two usage counts
    and the error land in the stage's own columns."""
    def run(batches):
        for pdf in batches:
            asked = pdf["_user"].notna().to_numpy()
            got = iter(_answers(fn, [{"system": system, "user": u, "temperature": temperature, **(limit or {})}
                                     for u in pdf["_user"][asked]]))
            rows = [next(got) if yes else (None, 0, 0, None) for yes in asked]
            out = pdf.drop(columns=["_user"]).reset_index(drop=True)
            for k, (name, kind) in enumerate([(out_col, "object"), (p_col, "int64"), (c_col, "int64"), (e_col, "object")]):
                out[name] = pd.Series([r[k] for r in rows], dtype=kind)
            yield out
    return run


def generate(df: DataFrame, fn=None, title: str = "title", content: str = "main_text",
             out_col: str = "generated", answer_tokens: int | None = None) -> DataFrame:
    """Adds ``generated``, ``prompt_tokens``, ``completion_tokens``; every
    page is asked for (``generate_within_budget`` stops at the budget)."""
    if fn is None:
        p = prompts(df, title, content)
        return (p.withColumn(out_col, default_render(F.col(title), F.col(content)))
                .withColumn("prompt_tokens", F.col("prompt_tokens_est"))
                .withColumn("completion_tokens", T.token_estimate(F.col(out_col)))
                .drop("user_prompt", "temperature", "prompt_tokens_est"))
    ship_package(df.sparkSession)
    src = df.withColumn("_user", user_prompt(F.col(title), F.col(content)))
    schema = _with_fields(df.schema, out_col, "prompt_tokens", "completion_tokens", "generate_error")
    limit = {"max_tokens": answer_tokens} if answer_tokens else {}
    return src.mapInPandas(_run_fn(fn, fixed.SYSTEM_PROMPT, fixed.GENERATE_TEMPERATURE, out_col, limit=limit), schema)


#: Tokens a request may cost beside the bytes of its prompts (message frames),
#: and the answer limit that is sent with a request.
FRAME_TOKENS, ANSWER_TOKENS = 64, 1024
#: Pages of a site that may be asked for at once whatever they may cost: the
#: reference's largest batch.
ROUND_PAGES = fixed.MAX_BATCH


def most_tokens(title: Column, content: Column, answer_tokens: int = ANSWER_TOKENS) -> Column:
    """An upper bound of what a request can use: no byte-level tokenizer makes
    more tokens than bytes, and the answer is limited."""
    return (F.octet_length(user_prompt(title, content)) + F.lit(len(fixed.SYSTEM_PROMPT.encode()) + FRAME_TOKENS + answer_tokens)).cast("long")


def generate_within_budget(df: DataFrame, seeds: DataFrame, order: list[tuple[str, bool]], fn, id_col: str = "page_id",
                           title: str = "title", content: str = "main_text", out_col: str = "generated",
                           answer_tokens: int = ANSWER_TOKENS, stop_fraction: float = fixed.STOP_FRACTION) -> DataFrame:
    """J2 under the budget: the model is asked for the pages of a site in
    ``order`` until the site has used ``stop_fraction`` of its ``max_tokens``,
    and for at most ``ROUND_PAGES - 1`` pages more. Adds ``round`` to what
    ``generate`` adds; pages that were never asked for are absent.

    Admission goes in rounds over all sites at once. A page is admitted if the
    tokens used so far and the reserves (``most_tokens``) of the pages admitted
    before it in this round stay below the stop, so it is needed whatever the
    others use; and the next ``ROUND_PAGES`` pages of a site always are. Then
    the calls are settled: a site's real usage takes the place of the reserves,
    and what is left is the next round's budget. A round uses a fixed share of
    what was left (usage over reserve), so rounds are few; prefix sums of the
    reserves are made once. Answers are written before they are counted: a lost
    executor never repeats a settled round. A site without a seed has no
    budget."""
    src = scratch_table(df, "budget-pages")
    keys = list(dict.fromkeys(c for c, _ in order))
    narrow = src.select("site", F.col(id_col).alias("_id"), *[c for c in keys if c not in ("site", id_col)],
                        *([F.col(id_col)] if id_col in keys else []),
                        most_tokens(F.col(title), F.col(content), answer_tokens).alias("_most"), F.lit(1).cast("long").alias("_one"))
    queue = scratch_table(running_totals(narrow, ["site"], order, {"_sum": "_most", "_i": "_one"})
                          .select("site", "_id", "_i", "_sum", (F.col("_sum") - F.col("_most")).alias("_before")), "budget-queue")
    state = scratch_table(seeds.select("site", (F.col("max_tokens") * stop_fraction).alias("stop"), F.lit(0).cast("long").alias("done"),
                                       F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("used")), "budget-state")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, answers = 0, []
    while True:
        open_ = state.where("used < stop")
        near = queue.join(open_, "site").where("_i > done")
        sure = F.col("used") + F.col("_before") - F.col("base") < F.col("stop")
        asked = scratch_table(near.where((F.col("_i") <= F.col("done") + ROUND_PAGES) | sure).select("site", "_id", "_i", "_sum"), "budget-asked")
        if asked.limit(1).count() == 0:
            break
        pages = src.join(asked.select(F.col("_id").alias(id_col)), id_col, "left_semi").select(*src.columns).repartition(parts, id_col)
        got = scratch_table(generate(pages, fn, title, content, out_col, answer_tokens).withColumn("round", F.lit(number)), "budget-answers")
        answers.append(got)
        spent = got.groupBy("site").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("spent"))
        reach = asked.groupBy("site").agg(F.max("_i").alias("to"), F.max("_sum").alias("sum"))
        state = scratch_table(state.join(reach, "site", "left").join(spent, "site", "left").select(
            "site", "stop", F.coalesce("to", "done").alias("done"), F.coalesce("sum", "base").alias("base"),
            (F.col("used") + F.coalesce("spent", F.lit(0))).alias("used")), "budget-state")
        number += 1
    if not answers:
        return generate(src.where("false"), fn, title, content, out_col, answer_tokens).withColumn("round", F.lit(0))
    out = answers[0]
    for got in answers[1:]:
        out = out.unionByName(got)
    return out


def critique(df: DataFrame, fn=None, content: str = "generated") -> DataFrame:
    """``critique`` (NULL when none) and its usage. The default is the
    native audit: the violated prompt rules, one per line."""
    if fn is None:
        v = MD.audit_markdown(F.col(content))
        return (df.withColumn("violations", v)
                .withColumn("critique", F.when(F.size(v) > 0, F.array_join(v, "\n")))
                .withColumn("critique_prompt_tokens", F.lit(0).cast("bigint"))
                .withColumn("critique_completion_tokens", F.lit(0).cast("bigint")))
    ship_package(df.sparkSession)
    src = df.withColumn("_user", F.concat(F.lit("Please analyze and critique this documentation:\n\n"), F.col(content)))
    schema = _with_fields(df.schema, "critique", "critique_prompt_tokens", "critique_completion_tokens",
                          "critique_error")

    run = _run_fn(fn, fixed.CRITIQUE_SYSTEM_PROMPT, fixed.CRITIQUE_TEMPERATURE, "critique",
                  "critique_prompt_tokens", "critique_completion_tokens", "critique_error")
    return src.mapInPandas(run, schema)


def refine(df: DataFrame, fn=None, content: str = "generated", out_col: str = "final") -> DataFrame:
    """Refine only where a critique exists; keep the original when the
    refined text is empty or missing."""
    if fn is None:
        return (df.withColumn(out_col, F.col(content))
                .withColumn("refine_prompt_tokens", F.lit(0).cast("bigint"))
                .withColumn("refine_completion_tokens", F.lit(0).cast("bigint")))
    ship_package(df.sparkSession)
    has_critique = F.col("critique").isNotNull() & (F.col("critique") != "")
    request = F.concat(F.lit("Original content:\n\n"), F.col(content), F.lit("\n\nCritique:\n\n"), F.col("critique"),
                       F.lit("\n\nPlease refine the content based on this critique."))
    src = df.withColumn("_user", F.when(has_critique, request))
    schema = _with_fields(df.schema, "_refined", "refine_prompt_tokens", "refine_completion_tokens", "refine_error")

    # one pass over all rows: reading a non-deterministic critique in two
    # branches would lose and repeat pages
    run = _run_fn(fn, fixed.REFINE_SYSTEM_PROMPT, fixed.REFINE_TEMPERATURE, "_refined",
                  "refine_prompt_tokens", "refine_completion_tokens", "refine_error")
    return (src.mapInPandas(run, schema)
            .withColumn(out_col, F.coalesce(F.nullif(F.col("_refined"), F.lit("")), F.col(content))).drop("_refined"))
