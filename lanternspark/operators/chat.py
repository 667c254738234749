"""Conversation records: fine-tuning and one-shot messages, few-shot prompts, triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SYSTEM_PROMPT, USER_PREFIX, USER_SUFFIX, user_prompt
from .ordinals import ordinal


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def finetune_messages(context: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    """system, user (the bare context), assistant."""
    return F.array(message("system", F.lit(system)), message("user", context), message("assistant", answer))


def one_shot(
    df: DataFrame,
    order: str,
    context: str,
    answer: str,
    shot: int = 42,
    alternate: int = 100,
    system: str = SYSTEM_PROMPT,
    prefix: str = USER_PREFIX,
    suffix: str = USER_SUFFIX,
) -> DataFrame:
    """Adds idx, messages (system, example user and assistant, user, assistant) and example (the example's idx).

    The example is row `shot` in the given order, for that row itself row `alternate`; both
    are clamped to the last row.  Where they fall together the alternate is the row before,
    so that no row is shown its own answer; a single row has only itself, marked by
    own_example.  An empty input gives an empty result.
    """
    rows = ordinal(df, order, name="idx")
    last = df.count() - 1
    shot, alternate = max(0, min(shot, last)), max(0, min(alternate, last))
    if alternate == shot:
        alternate = max(0, shot - 1)
    ex = {r["idx"]: (r[context], r[answer]) for r in rows.where(F.col("idx").isin(shot, alternate)).select("idx", context, answer).collect()}  # two rows
    pick = lambda k: F.when(F.col("idx") == shot, F.lit(ex.get(alternate, (None, None))[k])).otherwise(F.lit(ex.get(shot, (None, None))[k]))
    return rows.withColumn(
        "messages",
        F.array(
            message("system", F.lit(system)),
            message("user", user_prompt(pick(0), prefix, suffix)),
            message("assistant", pick(1)),
            message("user", user_prompt(F.col(context), prefix, suffix)),
            message("assistant", F.col(answer)),
        ),
    ).withColumn("example", F.when(F.col("idx") == shot, F.lit(alternate)).otherwise(F.lit(shot)).cast("long")).withColumn(
        "own_example", F.col("example") == F.col("idx")
    )


def with_metadata(df: DataFrame, messages: str = "messages", **columns: str) -> DataFrame:
    """Adds metadata, a struct of the named columns."""
    return df.withColumn("metadata", F.struct(*(F.col(c).alias(k) for k, c in columns.items())))


def triplet(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds system, user, assistant: the contents of the first three messages by position; null where there are fewer."""
    return df.withColumns({n: F.get(F.col(messages), F.lit(i))["content"] for i, n in enumerate(("system", "user", "assistant"))})


def by_role(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds system, user, assistant: the content of the first message of each role; null where there is none."""
    pick = lambda role: F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]
    return df.withColumns({r: pick(r) for r in ("system", "user", "assistant")})


def few_shot_prompts(df: DataFrame, order: str, messages: str = "messages", shots: int = 2, limit: int | None = None) -> DataFrame:
    """Adds idx and prompt to the rows after the first `shots` (at most `limit` of them).

    The prompt holds the first row's system message, user and assistant of the first rows, then the
    row's own user message.  At least shots + 1 rows are needed.
    """
    rows = by_role(ordinal(df, order, name="idx"), messages)
    first = rows.where(F.col("idx") < shots).orderBy("idx").select("system", "user", "assistant").collect()  # `shots` rows
    if len(first) < shots or df.count() <= shots:
        raise ValueError(f"at least {shots + 1} records are needed")
    own = rows.where(F.col("idx") >= shots)
    if limit is not None:
        own = own.where(F.col("idx") < shots + limit)
    parts = [message("system", F.lit(first[0]["system"]))]
    for r in first:
        parts += [message("user", F.lit(r["user"])), message("assistant", F.lit(r["assistant"]))]
    return own.withColumn("prompt", F.array(*parts, message("user", F.col("user"))))
