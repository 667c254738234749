"""Catalogue of the training-data queries, problem N's named pN_..., and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import answers, conduct, fmindex, forest, packing, pii, truncation, winnow
from .records import SPLITS, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, SPLITS["val"]).withColumn("split", F.lit("val")).unionByName(
        read(spark, sf_dir, SPLITS["test"]).withColumn("split", F.lit("test"))
    )


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation record with similarity of at least 0.5 over three-word sequences."""
    return winnow.overlapping_records(read(spark, sf_dir, SPLITS["train"]), _held_out(spark, sf_dir))


@query
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked records and pairs per evaluation split and source."""
    return winnow.overlap_report(read(spark, sf_dir, SPLITS["train"]), _held_out(spark, sf_dir)).select("split", "source", "records", "leaked", "pairs")


@query
def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every leaked evaluation record: overlapping training records and the share of its words that the best chain covers."""
    c = winnow.covered_records(read(spark, sf_dir, SPLITS["train"]), _held_out(spark, sf_dir))
    return c.where("pairs > 0").select("record_id", "split", "source", "pairs", F.round("coverage", 4).alias("coverage"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of training records with similarity of at least 0.5 over three-word sequences."""
    return forest.similar_records(read(spark, sf_dir, SPLITS["train"]), k=3, least=0.5)


@query
def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of p4_found without expanded copies: class of equal texts, group and number of similar texts of each record."""
    return forest.record_groups(read(spark, sf_dir, SPLITS["train"]), k=3, least=0.5)


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the training records: five-word sequences, similarity of at least 0.8."""
    return forest.record_groups(read(spark, sf_dir, SPLITS["train"]))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark_items"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least a quarter of an evaluation item's four-word sequences."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the matched share and the word spans to remove."""
    return _leaks(spark, sf_dir).select(
        "doc_id", "item_id", F.round("share", 6).alias("share"), F.size("spans").cast("long").alias("spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("words"),
    ).distinct()


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers of retomaton with their defect."""
    return answers.defects(read(spark, sf_dir, "retomaton"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose generated text is cut off, with the statistics that p2_found uses."""
    cut = truncation.truncated(read(spark, sf_dir, "retomaton"), "gen_id", ("reference", "generated"), other_text=("prompt",))
    return cut.where("text_column = 'generated'").select(F.col("row_id").alias("gen_id")).distinct()


@query
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts by source, with the evidence; the rows are those of p3_found."""
    return truncation.truncation_rates(read(spark, sf_dir, "retomaton"), "gen_id", "generated", answers=("reference",), other_text=("prompt",))


@query
def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in blocks of each capacity."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "block_sizes"))


@query
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks used, the least possible number, and the share of room filled."""
    return packing.fill_rates(p6_blocks(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conduct.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "content_labels"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual passage."""
    return _scores(spark, sf_dir).where(F.col("score") >= conduct.REVIEW).select("doc_id").distinct()


@query
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return _scores(spark, sf_dir).select("doc_id", F.round("score", 4).alias("score"), (F.col("score") >= conduct.REVIEW).alias("review"))


@query
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to review by source."""
    return conduct.review_rates(_scores(spark, sf_dir))


def _free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, place, text: user and assistant contents of the training split, generated texts of retomaton."""
    train = read(spark, sf_dir, SPLITS["train"]).select(
        F.lit(SPLITS["train"]).alias("table_name"), F.col("record_id").alias("row_id"), F.explode("messages").alias("m")
    )
    return train.where("m.role in ('user', 'assistant')").select("table_name", "row_id", F.col("m.role").alias("place"), F.col("m.content").alias("text")).unionByName(
        read(spark, sf_dir, "retomaton").select(
            F.lit("retomaton").alias("table_name"), F.col("gen_id").alias("row_id"), F.lit("generated").alias("place"), F.col("generated").alias("text")
        )
    )


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information by text."""
    return (
        pii.find_pii(_free_texts(spark, sf_dir))
        .select("table_name", "row_id", "place", F.explode(F.array_distinct(F.transform("found", lambda f: f["type"]))).alias("pii_type"))
        .distinct()
    )


@query
def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typed placeholders in place of personal information."""
    return pii.find_pii(_free_texts(spark, sf_dir)).select("table_name", "row_id", "place", F.col("redacted").alias("text"), F.size("found").cast("long").alias("found"))


@query
def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found where (character positions)."""
    return pii.find_pii(_free_texts(spark, sf_dir)).select("table_name", "row_id", "place", F.explode("found").alias("f")).select(
        "table_name", "row_id", "place", F.col("f.type").alias("pii_type"), F.col("f.start").alias("start"), F.col("f.stop").alias("stop"), F.col("f.value").alias("value")
    )


# --- SQL twins: all shared sequences are counted, which small tables allow -----------

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}]+')"
_GRAMS = "unnest(list_transform(generate_series(1, len(w) - {n}), lambda i: array_to_string(w[i:i+{n}], ' ')))"
_SAID = "coalesce(list_filter(messages, lambda m: m.role = '{}')[1].content, '')"
_TEXT = f"{_SAID.format('user')} || ' ' || {_SAID.format('assistant')}"


def _similar_sql(sides: dict[str, str]) -> str:
    """Pairs of records of side a and side b with similarity of at least 0.5; sides: where each side's rows come from."""
    parts = []
    for s, rows in sides.items():
        parts.append(f"w{s} as (select record_id, {_W.format('any_value(' + _TEXT + ')')} as w from ({rows}) where record_id is not null group by record_id)")
        parts.append(f"g{s} as (select distinct record_id, {_GRAMS.format(n=2)} as g from w{s})")
        parts.append(f"n{s} as (select record_id, count(*) as n from g{s} group by record_id)")
    return (
        f"with {', '.join(parts)}, shared as (select ga.record_id as a, gb.record_id as b, count(*) as m from ga join gb on ga.g = gb.g where ga.record_id <> gb.record_id group by all) "
        "select distinct least(a, b) as record_id_a, greatest(a, b) as record_id_b from shared join na on na.record_id = a join nb on nb.record_id = b where m >= 0.5 * (na.n + nb.n - m)"
    )


ORACLES["p1_found"] = _similar_sql(
    {"a": f"select record_id, messages from {SPLITS['train']}", "b": f"select record_id, messages from {SPLITS['val']} union all select record_id, messages from {SPLITS['test']}"}
)
_HELD = " union all ".join(f"select record_id, source, '{s}' as split from {SPLITS[s]}" for s in ("val", "test"))
ORACLES["p1_report"] = (
    f"with pairs as ({ORACLES['p1_found']}), held as (select record_id, min(split) as split, min(source) as source from ({_HELD}) where record_id is not null group by record_id), "
    "n as (select h.record_id, count(p.record_id_a) as n from held h left join pairs p on h.record_id in (p.record_id_a, p.record_id_b) group by h.record_id) "
    "select split, source, count(*) as records, count(*) filter (where n > 0) as leaked, sum(n)::bigint as pairs from held join n using (record_id) group by split, source"
)
ORACLES["p4_found"] = _similar_sql({s: f"select record_id, messages from {SPLITS['train']}" for s in "ab"})


def _groups_sql(n: int, least: float) -> str:
    """Classes, groups (connected by similar texts) and links of training records; n: words of a sequence less one."""
    return (
        f"with recursive w as (select record_id, {_W.format('any_value(' + _TEXT + ')')} as w from {SPLITS['train']} where record_id is not null group by record_id), "
        "c as (select w, min(record_id) as class_id from w group by w), "
        f"g as (select distinct class_id, {_GRAMS.format(n=n)} as g from c), n as (select class_id, count(*) as n from g group by class_id), "
        "m as (select x.class_id as a, y.class_id as b, count(*) as m from g x join g y on x.g = y.g where x.class_id <> y.class_id group by all), "
        f"e as (select a, b from m join n p on p.class_id = a join n q on q.class_id = b where m >= {least} * (p.n + q.n - m)), "
        "r(a, b) as (select class_id, class_id from c union select r.a, e.b from r join e on e.a = r.b), f as (select a, min(b) as group_id from r group by a), l as (select a, count(*) as links from e group by a) "
        "select w.record_id, c.class_id, f.group_id, coalesce(l.links, 0)::bigint as links from w join c on c.w = w.w join f on f.a = c.class_id left join l on l.a = c.class_id"
    )


ORACLES["p4_groups"] = _groups_sql(4, 0.8)
ORACLES["p4_classes"] = _groups_sql(2, 0.5)
ORACLES["p7_found"] = (
    f"with iw as (select item_id, {_W.format('text')} as w from benchmark_items where text is not null), ig as (select distinct item_id, {_GRAMS.format(n=3)} as g from iw), "
    f"it as (select item_id, count(*) as n from ig group by item_id), dw as (select doc_id, {_W.format('text')} as w from documents where text is not null), dg as (select distinct doc_id, {_GRAMS.format(n=3)} as g from dw), "
    "hit as (select doc_id, item_id, count(*) as m from dg join ig using (g) group by doc_id, item_id) select doc_id, item_id from hit join it using (item_id) where m >= 0.25 * n"
)
ORACLES["p7_report"] = (
    f"with iw as (select item_id, {_W.format('text')} as w from benchmark_items where text is not null), ig as (select distinct item_id, {_GRAMS.format(n=3)} as g from iw), "
    f"it as (select item_id, count(*) as n from ig group by item_id), dw as (select doc_id, {_W.format('text')} as w from documents where text is not null), "
    f"dg as (select doc_id, unnest(generate_series(1, len(w) - 3)) as i, {_GRAMS.format(n=3)} as g from dw), hit as (select doc_id, item_id, i, g from dg join ig using (g)), "
    "m as (select doc_id, item_id, count(distinct g) as m from hit group by all), s as (select *, coalesce(i - lag(i) over (partition by doc_id, item_id order by i) > 4, true)::int as new from hit), "
    "t as (select *, sum(new) over (partition by doc_id, item_id order by i) as span from s), u as (select doc_id, item_id, span, max(i) + 4 - min(i) as words from t group by all), "
    "v as (select doc_id, item_id, count(*) as spans, sum(words)::bigint as words from u group by all) "
    "select doc_id, item_id, round(m / n, 6) as share, spans, words from v join m using (doc_id, item_id) join it using (item_id) where m >= 0.25 * n"
)
