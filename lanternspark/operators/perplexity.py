"""Perplexity of texts under an n-gram model that is counted from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import tokens


def unigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """token, n."""
    return df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def unigram_perplexity(df: DataFrame, id_col: str, text: str, counts: DataFrame, first: int | None = None, prefix_len: str | None = None) -> DataFrame:
    """id, tokens, loss, ppl under the add-one unigram model.

    first: only so many tokens of a text are read; prefix_len: a column with the number of leading
    tokens that are context and not scored.  Texts without a scored token are left out.
    """
    t = df.select(id_col, *([F.col(prefix_len).alias("_skip")] if prefix_len else []), F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    if first is not None:
        t = t.where(F.col("pos") < first)
    if prefix_len:
        t = t.where(F.col("pos") >= F.col("_skip"))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*") + 1).first()
    logp = F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + kinds)))
    return (
        t.join(counts, "token", "left")
        .groupBy(id_col).agg(F.count("*").alias("tokens"), (-F.avg(logp)).alias("loss")).withColumn("ppl", F.exp("loss"))
    )


def shifted_labels(tokens_df: DataFrame, seq: list[str], pos: str = "pos", token: str = "token") -> DataFrame:
    """Adds label, the next token of the sequence; the last position has none."""
    return tokens_df.withColumn("label", F.lead(token).over(Window.partitionBy(*seq).orderBy(pos)))
