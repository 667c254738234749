"""Texts cut off by field limits or in transfer (problem 3).

Corpus statistics over all texts come first: how often each word stands anywhere and at a
sentence's end, which words every sentence with a given opening holds, and at which
lengths the unfinished texts of a source pile up.  The vocabulary becomes a trie kept as
a table (a node is a prefix with the weight of the words below it).  An unfinished text,
one without closing punctuation, is cut if

- it ends with an unknown word that is a proper prefix of known ones,
- its last word is common but never ends a sentence,
- it ends with a comma or the like, an open bracket or quote, or an ellipsis mark,
- its last sentence lacks a word that all sentences with this opening hold, or
- it has the length at which its source cuts.

A missing closing period alone is no evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.session import cut_lineage
from .answers import _LABEL, is_empty

KNOWN = 3  # a word of the trie stands so often at least
COMMON = 20  # evidence from a word or an opening needs so many cases
NEVER = 0.01  # a word that ends a sentence more rarely than this doesn't
ALWAYS = 0.97  # a word that stands in this share of the sentences with an opening belongs to it
NEAR = 8  # lengths on either side that tell how many texts have one by chance
FLUSH = 300_000

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_END = re.compile(r"[.!?]['\")\]]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\[truncated\]|\[cut\])\s*$", re.I)
_OPEN_END = re.compile(r"[,;:(\[{/\-–]\s*$")
_NUMBER_ONLY = re.compile(r"(?:^|[.!?]\s+|\n\s*)\d{1,2}\.?$")  # the number of a list entry that is missing
_CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(text: str) -> list[str]:
    """Lower-case words; any that isn't letters only is '#'."""
    return [w if w.isalpha() else "#" for w in _TOKEN.findall(text.lower())]


def open_delimiter(text: str) -> bool:
    """Does a bracket stay open (stack), or a double quote?"""
    stack = []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif c in _CLOSES and stack and stack[-1] == _CLOSES[c]:
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def finished(text: str) -> bool:
    return bool(_END.search(text)) and not _ELLIPSIS.search(text) and not _NUMBER_ONLY.search(text)


def _statistics(texts: DataFrame) -> DataFrame:
    """kind, a, b, n, m: 'word' a stands n times, m times at a sentence's end; of the sentences with
    'opening' a, n hold word b (b null: all of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, final, opening = Counter(), Counter(), Counter()

        def out() -> pa.RecordBatch:
            rows = [("word", w, None, n, final[w]) for w, n in word.items()] + [("opening", a, b, n, 0) for (a, b), n in opening.items()]
            word.clear(), final.clear(), opening.clear()
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "a", "b", "n", "m"])

        for t in batches:
            for text, answer in zip(t.column("text").to_pylist(), t.column("answer").to_pylist()):
                text = _LABEL.sub("", text.strip())
                parts = _SENTENCE.split(text)
                done = finished(text)
                for i, s in enumerate(parts):
                    w = tokens(s)
                    if not w:
                        continue
                    whole = done or i < len(parts) - 1
                    word.update(w if whole else w[:-1])
                    if whole and s[-1] in ".!?" and w != ["#"]:
                        final[w[-1]] += 1
                        if answer and len(w) > 2:
                            a = f"{w[0]} {w[1]}"
                            opening[a, None] += 1
                            for x in set(w[2:]):
                                opening[a, x] += 1
            if len(word) + len(opening) > FLUSH:
                yield out()
        yield out()

    return cut_lineage(
        texts.select("text", "answer")
        .mapInArrow(count, "kind string, a string, b string, n long, m long")
        .groupBy("kind", "a", "b")
        .agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )


def trie(words: DataFrame) -> DataFrame:
    """prefix, below: the nodes of the trie of words (a, n); below is the weight of longer words through it."""
    known = words.where((F.col("n") >= KNOWN) & (F.length("a") >= 3) & (F.col("a") != "#"))
    return (
        known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("a") - 1), lambda i: F.substring("a", F.lit(1), i))).alias("prefix"), "n")
        .groupBy("prefix")
        .agg(F.sum("n").alias("below"))
    )


def _unfinished(texts: DataFrame) -> DataFrame:
    """The unfinished texts with what the decision needs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for i, c, s, text in zip(*(t.column(c).to_pylist() for c in ("row_id", "text_column", "source", "text"))):
                if is_empty(text):
                    continue
                body = _LABEL.sub("", text.strip())
                if finished(body):
                    continue
                last = _SENTENCE.split(body)[-1]
                w = tokens(last)
                hard = bool(_OPEN_END.search(body) or _ELLIPSIS.search(body) or _NUMBER_ONLY.search(body)) or open_delimiter(last) or not w
                out.append(
                    (i, c, s, len(text), hard, w[-1] if w else None, bool(w) and text[-1].isalnum(), " ".join(w[:2]) if len(w) > 1 else None, w[2:])
                )
            cols = list(zip(*out)) or [()] * 9
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))
            names = ["row_id", "text_column", "source", "chars", "hard", "last_word", "inside", "opening", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    return texts.select("row_id", "text_column", "source", "text").mapInArrow(
        look,
        "row_id long, text_column string, source string, chars long, hard boolean, last_word string, inside boolean, opening string, rest array<string>",
    )


def limits(texts: DataFrame, unfinished: DataFrame) -> DataFrame:
    """text_column, source, chars: lengths at which the unfinished texts of a source pile up.

    At least three different unfinished texts have the length, they are three tenths or more of all texts of the source that are
    so long or longer, and clearly more than have a length nearby, as they would by chance in a large source.
    Texts are counted by length before anything is ordered, so a source's running sum has a row for each length.
    """
    by = ["text_column", "source"]
    sizes = texts.dropDuplicates(["row_id", "text_column"]).groupBy(*by, F.length("text").cast("long").alias("chars")).agg(F.count("*").alias("m"), F.lit(0).cast("long").alias("n"))
    at = unfinished.dropDuplicates(["row_id", "text_column"]).groupBy(*by, "chars").agg(F.lit(0).cast("long").alias("m"), F.count("*").alias("n"))
    every = sizes.unionByName(at).where("source is not null").groupBy(*by, "chars").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("chars").desc())
    near = Window.partitionBy(*by).orderBy("chars").rangeBetween(-NEAR, NEAR)
    every = every.withColumn("longer", F.sum("m").over(w)).withColumn("chance", (F.sum("n").over(near) - F.col("n")) / (2 * NEAR))
    return every.where("n >= 3 and n >= 0.3 * longer and n > 4 * chance + 3 * sqrt(chance)").select(*by, "chars")


def truncated(df: DataFrame, id_col: str, columns: tuple[str, ...], source: str = "source", other_text: tuple[str, ...] = ()) -> DataFrame:
    """row_id, text_column, source, by_length, by_word, by_sentence of each truncated text.

    other_text: columns that add to the vocabulary.  Null and empty texts (see answers.is_empty) are not
    truncated; a null source is compared with the limits of all sources.  Rows repeat where the input's do.
    """
    long = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"),
        F.col(source).alias("source"),
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("text_column"), F.lit(c in columns).alias("answer"), F.col(c).alias("text")) for c in (*columns, *other_text)))
        ).alias("t"),
    ).select("row_id", "source", "t.*").where("text is not null")
    answers = long.where("answer")
    stats = _statistics(long)
    open_ = cut_lineage(_unfinished(answers))

    words = stats.where("kind = 'word'").select("a", "n", "m")
    last = open_.where("last_word is not null").select(F.col("last_word").alias("prefix")).distinct()
    word = (
        last.join(trie(words).join(last, "prefix", "left_semi"), "prefix", "left")
        .join(words.withColumnRenamed("a", "prefix"), "prefix", "left")
        .na.fill(0, ["below", "n", "m"])
        .select(
            F.col("prefix").alias("last_word"),
            ((F.col("prefix") != "#") & (F.col("below") > 0) & ((F.col("n") < KNOWN) | (F.col("n") * 200 < F.col("below")))).alias("part"),
            ((F.col("n") >= COMMON) & (F.col("m") < NEVER * F.col("n"))).alias("midst"),
        )
    )
    opening = stats.where("kind = 'opening'")
    needs = (
        opening.where("b is not null and b <> '#'").select("a", "b", "n")
        .join(opening.where(f"b is null and n >= {COMMON}").select("a", F.col("n").alias("all")), "a")
        .where(f"n >= {ALWAYS} * all")
        .groupBy("a")
        .agg(F.collect_list("b").alias("needs"))  # at most the words of one sentence
        .withColumnRenamed("a", "opening")
    )
    limit = limits(answers, open_).withColumn("limit", F.lit(True))
    anywhere = limit.groupBy("text_column", "chars").agg(F.lit(True).alias("limit_anywhere"))
    seen = (
        open_.join(word, "last_word", "left")
        .join(needs, "opening", "left")
        .join(limit, ["text_column", "source", "chars"], "left")
        .join(anywhere, ["text_column", "chars"], "left")
    )
    by = seen.select(
        "row_id",
        "text_column",
        "source",
        (F.coalesce("limit", F.lit(False)) | (F.col("source").isNull() & F.coalesce("limit_anywhere", F.lit(False)))).alias("by_length"),
        (F.col("hard") | F.coalesce(F.col("midst"), F.lit(False)) | (F.col("inside") & F.coalesce("part", F.lit(False)))).alias("by_word"),
        F.coalesce(F.size(F.array_except("needs", "rest")) > 0, F.lit(False)).alias("by_sentence"),
    )
    return by.where("by_length or by_word or by_sentence")


def truncation_rates(df: DataFrame, id_col: str, column: str, source: str = "source", answers: tuple[str, ...] = (), **kw) -> DataFrame:
    """source, texts, truncated, share, by_length, by_word, by_sentence; a row id counts once, null sources form a group.

    answers: columns whose sentences count as evidence besides column.
    """
    cut = (
        truncated(df, id_col, (column, *answers), source, **kw)
        .where(F.col("text_column") == column)
        .groupBy("row_id")
        .agg(*(F.max(c).alias(c) for c in ("by_length", "by_word", "by_sentence")))
    )
    every = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("row_id")).agg(F.min(source).alias("source"))
    return (
        every.join(cut, "row_id", "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("texts"),
            F.count("by_word").alias("truncated"),
            F.round(F.count("by_word") / F.count("*"), 6).alias("share"),
            *(F.count_if(c).alias(c) for c in ("by_length", "by_word", "by_sentence")),
        )
    )
