"""Catalogue of the core's queries and their SQL twins.

Each query runs over its whole tables.  Rows of a record that was delivered several times are
reduced to the earliest delivery first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .functions.probability import interpolate, log_softmax
from .operators import ann, automaton, chat, knnlm, metrics, ordinals, perplexity, windows
from .plans.session import work_path
from .sources import convert, tables
from .streaming.append import append_stream

QUERIES: dict = {}
ORACLES: dict = {}

SPLIT = "mimic_inspired_{}_context_impression_finetune"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- reports ------------------------------------------------------------------

_B = T.BLANK
_REPORTS = "reports as (select report_id, any_value(source) as source, min_by(text, ingested_at) as text from radiology_raw where report_id is not null group by report_id)"
_CLEAN = f"regexp_replace(regexp_replace(lower(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')), '{T.SYMBOLS}', ' ', 'g'), '{_B}+', ' ', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


_PARTS = f"""{_REPORTS}, cleaned as (select report_id, source, {_CLEAN} as c from reports),
parts as (select report_id, source, c, string_split_regex(c, '{T.MARKER}') as p from cleaned),
parsed as (select report_id, source, case when len(p) = 2 then {_strip('p[1]')} else {_strip('c')} end as context,
  case when len(p) = 2 then 'impression: ' || {_strip('p[2]')} else 'impression:' end as impression from parts)"""
_BLANK_TEST = f"coalesce(regexp_matches(impression, '^{_B}*impression:{_B}*$'), false)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals.latest(table(spark, sf_dir, "radiology_raw"), "report_id", "ingested_at")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("report_id", "source", T.report_sections(F.col("text")).alias("s")).select("report_id", "source", "s.*")


@query(f"with {_REPORTS} select report_id, {_CLEAN} as cleaned from reports")
def report_clean(spark, sf_dir):
    return reports(spark, sf_dir).select("report_id", T.clean_report(F.col("text")).alias("cleaned"))


@query(f"with {_PARTS} select report_id, context, impression from parsed")
def report_parse_sections(spark, sf_dir):
    return parsed(spark, sf_dir).select("report_id", "context", "impression")


@query(f"with {_PARTS} select source, count(*) as reports, count(*) filter (where {_BLANK_TEST}) as blank from parsed group by source")
def blank_impression_count(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("reports"), F.count_if(T.is_blank_impression(F.col("impression"))).alias("blank"))


@query(f"with {_PARTS} select report_id, impression from parsed where not {_BLANK_TEST}")
def nonblank_filter(spark, sf_dir):
    return parsed(spark, sf_dir).where(~T.is_blank_impression(F.col("impression"))).select("report_id", "impression")


_GEN = "gens as (select gen_id, min_by(struct_pack(run_id := run_id, source := source, prompt := prompt, reference := reference, generated := generated, self_loss := self_loss, self_ppl := self_ppl, cond_loss := cond_loss, cond_ppl := cond_ppl), generated_at) as r from retomaton where gen_id is not null group by gen_id), g as (select gen_id, unnest(r) from gens)"


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals.latest(table(spark, sf_dir, "retomaton"), "gen_id", "generated_at")


def _invalid_sql(chars: str) -> str:
    t = "coalesce(reference, '')"
    fold = _strip(f"regexp_replace(lower({t}), '{_B}+', ' ', 'g')")
    return f"with {_GEN} select gen_id, {_strip(t)} = '' or trim({fold}, '{chars}') = 'impression' as invalid from g"


@query(_invalid_sql(" :;.,"))
def invalid_reference_strict(spark, sf_dir):
    return generations(spark, sf_dir).select("gen_id", T.is_invalid_reference(F.col("reference")).alias("invalid"))


@query(_invalid_sql(":;.,"))
def invalid_reference_loose(spark, sf_dir):
    return generations(spark, sf_dir).select("gen_id", T.is_invalid_reference(F.col("reference"), ":;.,").alias("invalid"))


@query(f"with {_GEN} select gen_id, {_strip('substr(prompt || coalesce(generated, chr(32)), length(prompt) + 1)')} as continuation from g where prompt is not null")
def continuation_extract(spark, sf_dir):
    g = generations(spark, sf_dir).where("prompt is not null")
    return g.select("gen_id", T.continuation(F.concat("prompt", F.coalesce("generated", F.lit(" "))), F.col("prompt")).alias("continuation"))


@query(f"with {_GEN} select run_id as model, count(*) as n, count(*) filter (where source is null) as no_source, count(*) filter (where coalesce(generated, '') = '') as empty_generated from g group by run_id")
def null_handling(spark, sf_dir):
    g = generations(spark, sf_dir).withColumnsRenamed({"run_id": "model", "no_such_column": "x"})
    return g.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("source").isNull()).alias("no_source"), F.count_if(F.coalesce(F.col("generated").cast("string"), F.lit("")) == "").alias("empty_generated")
    )


# --- splits and samples -----------------------------------------------------------

_RANKED = "ranked as (select doc_id, source, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as r, count(*) over () as n from documents)"
_SPLIT = f"{_RANKED}, held as (select *, ceil(n * 0.2) as h from ranked), split3 as (select doc_id, source, case when r < ceil(h * 0.5) then 'test' when r < h then 'val' else 'train' end as split from held)"


@query(f"with {_SPLIT} select doc_id, split from split3")
def split_assign(spark, sf_dir):
    return ordinals.split_three(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query(f"with {_SPLIT} select split, count(*) as n, count(distinct doc_id) as ids from split3 group by split")
def split_sizes(spark, sf_dir):
    s = split_assign(spark, sf_dir)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query(f"with {_SPLIT} select a.doc_id from split3 a where a.split = 'train' and not exists (select 1 from split3 b where b.doc_id = a.doc_id and b.split <> 'train')")
def split_disjoint(spark, sf_dir):
    s = split_assign(spark, sf_dir)
    return s.where("split = 'train'").join(s.where("split <> 'train'"), "doc_id", "left_anti").select("doc_id")


_PCT = ", ".join(f"({p})" for p in ordinals.PERCENTS)
_NESTED = f"{_SPLIT}, nr as (select doc_id, split, row_number() over (partition by split order by md5('42:' || doc_id), doc_id) - 1 as r, count(*) over (partition by split) as n from split3), nested as (select doc_id, split, p.percent from nr, (values {_PCT}) p(percent) where r < round_even(n * p.percent / 100.0, 0))"


def _nested(spark, sf_dir):
    return ordinals.nested_samples(split_assign(spark, sf_dir), "doc_id", by="split")


@query(f"with {_NESTED} select split, percent, count(*) as n from nested group by split, percent")
def nested_subsample_sizes(spark, sf_dir):
    return _nested(spark, sf_dir).groupBy("split", "percent").agg(F.count("*").alias("n"))


@query(f"with {_NESTED} select doc_id, split, min(percent) as percent from nested group by doc_id, split")
def subsample_members(spark, sf_dir):
    return _nested(spark, sf_dir).groupBy("doc_id", "split").agg(F.min("percent").alias("percent"))


@query("select doc_id, case when row_number() over (order by doc_id) - 1 < (count(*) over ()) * 5 // 100 then 'validation' else 'train' end as split from documents")
def percent_head_tail_split(spark, sf_dir):
    return ordinals.head_tail(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


# --- conversations ------------------------------------------------------------------

_TEST = SPLIT.format("test")
_CONV = f"conv as (select record_id, min_by(messages, ingested_at) as messages from {_TEST} where record_id is not null group by record_id)"
_ROLE = "list_filter(messages, lambda m: m.role = '{}')[1].content"


def conversations(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    return ordinals.latest(table(spark, sf_dir, SPLIT.format(split)), "record_id", "ingested_at")


@query(f"with {_CONV} select record_id, messages[1].content as system, messages[2].content as user, messages[3].content as assistant from conv")
def message_triplet(spark, sf_dir):
    return chat.triplet(conversations(spark, sf_dir)).select("record_id", "system", "user", "assistant")


@query(f"with {_CONV} select record_id, {_ROLE.format('system')} as system, {_ROLE.format('user')} as user, {_ROLE.format('assistant')} as assistant from conv")
def messages_by_role(spark, sf_dir):
    return chat.by_role(conversations(spark, sf_dir)).select("record_id", "system", "user", "assistant")


@query(f"with {_CONV}, e as (select record_id, unnest(messages) as m, generate_subscripts(messages, 1) as pos from conv) select record_id, cast(pos as bigint) as pos, m.role as role, m.content as content from e")
def messages_flatten(spark, sf_dir):
    e = conversations(spark, sf_dir).select("record_id", F.posexplode("messages").alias("pos", "m"))
    return e.select("record_id", (F.col("pos") + 1).cast("long").alias("pos"), "m.role", "m.content")


def _exploded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("messages").alias("pos", "m")).select(*keys, F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


@query(f"with {_PARTS} select report_id, cast(0 as bigint) as pos, 'system' as role, '{T.SYSTEM_PROMPT}' as content from parsed union all select report_id, 1, 'user', context from parsed union all select report_id, 2, 'assistant', impression from parsed")
def chat_finetune(spark, sf_dir):
    return _exploded(parsed(spark, sf_dir).withColumn("messages", chat.finetune_messages(F.col("context"), F.col("impression"))), "report_id")


_UP = f"'{T.USER_PREFIX}' || coalesce({{}}, '') || chr(10)"


@query(
    f"""with {_PARTS}, o as (select *, row_number() over (order by report_id) - 1 as idx from parsed), k as (select least(42, count(*) - 1) as shot, least(100, count(*) - 1) as far from o), k2 as (select shot, case when far = shot then greatest(shot - 1, 0) else far end as alt from k),
s as (select o.* from o, k2 where idx = shot), a as (select o.* from o, k2 where idx = alt),
x as (select o.idx, o.context, o.impression, case when o.idx = shot then a.context else s.context end as ec, case when o.idx = shot then a.impression else s.impression end as ei, case when o.idx = shot then alt else shot end as example from o, s, a, k2)
select idx, cast(example as bigint) as example, cast(0 as bigint) as pos, 'system' as role, '{T.SYSTEM_PROMPT}' as content from x union all select idx, example, 1, 'user', {_UP.format('ec')} from x
union all select idx, example, 2, 'assistant', ei from x union all select idx, example, 3, 'user', {_UP.format('context')} from x union all select idx, example, 4, 'assistant', impression from x"""
)
def chat_one_shot(spark, sf_dir):
    return _exploded(chat.one_shot(parsed(spark, sf_dir), "report_id", "context", "impression"), "idx", "example")


@query("select doc_id as id, doc_kind as section_header, text as user from documents")
def chat_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("messages", chat.finetune_messages(F.col("text"), F.lit(None).cast("string")))
    m = chat.with_metadata(d.withColumn("id", F.col("doc_id")), id="id", section_header="doc_kind")
    return m.select("metadata.id", "metadata.section_header", F.get("messages", F.lit(1))["content"].alias("user"))


@query(f"with {_CONV}, e as (select record_id, unnest(messages) as m from conv) select record_id, count(*) as messages, sum(length(m.content))::bigint as chars from e group by record_id")
def chat_jsonl_text(spark, sf_dir):
    """Through JSON text and back."""
    c = conversations(spark, sf_dir).select("record_id", F.to_json(F.struct("messages"), {"ignoreNullFields": "false"}).alias("line"))
    back = c.select("record_id", F.from_json("line", "messages array<struct<role:string,content:string>>").alias("j"))
    e = back.select("record_id", F.explode("j.messages").alias("m"))
    return e.groupBy("record_id").agg(F.count("*").alias("messages"), F.sum(F.length("m.content")).alias("chars"))


@query(f"with {_CONV}, o as (select record_id, row_number() over (order by record_id) - 1 as idx from conv) select record_id, idx from o where idx >= 2 and idx < 62")
def eval_offset_limit(spark, sf_dir):
    return ordinals.offset_limit(conversations(spark, sf_dir).select("record_id"), "record_id", offset=2, limit=60).select("record_id", "idx")


@query(
    f"""with {_CONV}, o as (select row_number() over (order by record_id) - 1 as idx, {_ROLE.format('system')} as s, {_ROLE.format('user')} as u, {_ROLE.format('assistant')} as a from conv),
z as (select * from o where idx = 0), y as (select * from o where idx = 1), f as (select o.idx, [z.s, z.u, z.a, y.u, y.a, o.u] as c from o, z, y where o.idx >= 2)
select idx, cast(generate_subscripts(c, 1) - 1 as bigint) as pos, unnest(['system', 'user', 'assistant', 'user', 'assistant', 'user']) as role, unnest(c) as content from f"""
)
def few_shot_prompt(spark, sf_dir):
    p = chat.few_shot_prompts(conversations(spark, sf_dir), "record_id")
    return _exploded(p.withColumn("messages", F.col("prompt")), "idx")


# --- token windows and the datastore ------------------------------------------------

BLOCK, STRIDE = 64, 32
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BATCH = f"o as (select doc_id, {_TOK} as t, (row_number() over (order by doc_id) - 1) // 1000 as batch from documents where doc_id is not null), totals as (select batch, sum(len(t))::bigint as tokens from o group by batch)"
_CUT = f"cut as (select batch, tokens, case when tokens >= {BLOCK} then tokens // {BLOCK} * {BLOCK} else tokens end as total from totals where tokens > 0)"
_WIN = f'{_BATCH}, {_CUT}, w0 as (select batch, total, unnest(generate_series(0, (total - 1) // {STRIDE})) as "window" from cut), win as (select batch, "window", greatest(("window" + 1) * {STRIDE} - {BLOCK}, 0) as b, least(("window" + 1) * {STRIDE}, total) as e from w0)'


@query('with ' + _WIN + f' select batch, "window", b as "begin", e as "stop", e - "window" * {STRIDE} as scored, {BLOCK} - (e - b) as padding from win')
def token_windows(spark, sf_dir):
    return windows.windows(windows.batch_totals(table(spark, sf_dir, "documents"), "doc_id"), BLOCK, STRIDE)


@query(f"with {_WIN} select batch, count(*) as windows, sum(e - \"window\" * {STRIDE})::bigint as scored, sum(e - b)::bigint as ids, count(*) * {BLOCK} as slots from win group by batch")
def window_labels(spark, sf_dir):
    w = windows.windows(windows.batch_totals(table(spark, sf_dir, "documents"), "doc_id"), BLOCK, STRIDE)
    return w.groupBy("batch").agg(F.count("*").alias("windows"), F.sum("scored").alias("scored"), F.sum(F.col("stop") - F.col("begin")).alias("ids"), (F.count("*") * BLOCK).alias("slots"))


_POS = f"""{_BATCH}, {_CUT}, off as (select doc_id, batch, t, coalesce(sum(len(t)) over (partition by batch order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from o),
pos as (select batch, before + generate_subscripts(t, 1) - 1 as pos, unnest(t) as token from off),
em as (select p.batch, p.pos // {STRIDE} as "window", p.pos, p.token from pos p join cut c on c.batch = p.batch where p.pos < c.total and p.pos > greatest((p.pos // {STRIDE} + 1) * {STRIDE} - {BLOCK}, 0))"""


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return windows.emitted(windows.token_rows(d, "doc_id"), windows.batch_totals(d, "doc_id"), BLOCK, STRIDE)


@query(f"with {_POS} select count(*) as dstore_size, count(distinct token) as vocabulary from em")
def dstore_size(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.count("*").alias("dstore_size"), F.countDistinct("token").alias("vocabulary"))


@query(f"with {_POS} select row_number() over (order by batch, pos) - 1 as key_id, batch, \"window\", pos, token as val from em")
def dstore_build(spark, sf_dir):
    return windows.datastore(_pairs(spark, sf_dir)).select("key_id", "batch", "window", "pos", "val")


@query(f"with {_POS}, d as (select row_number() over (order by batch, pos) - 1 as key_id, token as val from em) select val, count(*) as n, max(key_id) as last_key from d where key_id < 100000 group by val")
def dstore_cap(spark, sf_dir):
    return windows.datastore(_pairs(spark, sf_dir), 100_000).groupBy("val").agg(F.count("*").alias("n"), F.max("key_id").alias("last_key"))


@query(f"with {_BATCH} select doc_id, len(t)::bigint as tokens, len(list_distinct(t))::bigint as kinds from o")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


# --- neighbours -----------------------------------------------------------------------

K = 10
_VEC = "q as (select vec_id as qid, embedding as qv, label from embeddings where vec_id % 20 = 0), s as (select vec_id as key_id, embedding as key, label as val from embeddings)"
_L2 = "list_sum(list_transform(list_zip(qv, key), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
_DOT = "list_sum(list_transform(list_zip(qv, key), lambda p: p[1]::double * p[2]::double))"
_NN = f"{_VEC}, d as (select qid, key_id, val, label, {_L2} as dist from q, s where key_id <> qid), nn as (select *, row_number() over (partition by qid order by dist, key_id) as rank from d qualify rank <= {K})"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings; a search leaves out the query's own row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_id"), F.col("embedding").alias("key"), F.col("label").alias("val"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")


def _others(hits: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest of k + 1 that aren't the query's own row."""
    return ann.top_k(hits.where("key_id <> qid").drop("rank"), k, metric)


def _nn(spark, sf_dir, k: int = K, metric: str = "l2") -> DataFrame:
    return _others(ann.exact_search(asked(spark, sf_dir), store(spark, sf_dir), k + 1, metric), k, metric)


@query(f"with {_NN} select qid, key_id, round(dist, 6) as dist, rank from nn")
def knn_exact_l2(spark, sf_dir):
    return _nn(spark, sf_dir).select("qid", "key_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_VEC}, d as (select qid, key_id, {_DOT} as dist from q, s where key_id <> qid), nn as (select *, row_number() over (partition by qid order by dist desc, key_id) as rank from d qualify rank <= {K}) select qid, key_id, round(dist, 6) as dist, rank from nn")
def knn_exact_dot(spark, sf_dir):
    return _nn(spark, sf_dir, metric="dot").select("qid", "key_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_NN} select count(*) as queries, count(*) filter (where val = label) as right from nn where rank = 1".replace("as right", 'as "right"'))
def knn_top1_label(spark, sf_dir):
    n = knnlm.with_values(_nn(spark, sf_dir, 1), store(spark, sf_dir)).join(asked(spark, sf_dir).select("qid", "label"), "qid")
    return n.agg(F.count("*").alias("queries"), F.count_if(F.col("val") == F.col("label")).alias("right"))


@query(f"with {_NN} select qid, key_id, val from nn")
def neighbor_lookup(spark, sf_dir):
    return knnlm.with_values(_nn(spark, sf_dir), store(spark, sf_dir)).select("qid", "key_id", "val")


@query(f"with {_NN} select qid, key_id, round(dist, 6) as dist from nn")
def recompute_dists(spark, sf_dir):
    return ann.recomputed(_nn(spark, sf_dir), asked(spark, sf_dir), store(spark, sf_dir)).select("qid", "key_id", F.round("dist", 6).alias("dist"))


def _soft(t: float = 1.0, src: str = "nn") -> str:
    return f"e as (select *, exp(-dist / {t} - max(-dist / {t}) over (partition by qid)) as ex from {src}), sm as (select *, ex / sum(ex) over (partition by qid) as prob from e)"


@query(f"with {_NN}, {_soft()} select qid, key_id, round(prob, 6) as prob from sm")
def knn_softmax(spark, sf_dir):
    return knnlm.neighbour_weights(_nn(spark, sf_dir)).select("qid", "key_id", F.round("prob", 6).alias("prob"))


_TOKENS = f"{_NN}, {_soft()}, kp as (select qid, val as token, sum(prob) as prob from sm group by qid, val)"


def _knn(spark, sf_dir, temperature: float = 1.0) -> DataFrame:
    s = store(spark, sf_dir)
    return knnlm.token_distribution(knnlm.neighbour_weights(knnlm.with_values(_nn(spark, sf_dir), s), temperature))


@query(f"with {_TOKENS} select qid, token, round(prob, 6) as prob, round(ln(prob), 6) as logp from kp")
def knn_token_probs(spark, sf_dir):
    return _knn(spark, sf_dir).select("qid", "token", F.round("prob", 6).alias("prob"), F.round("logp", 6).alias("logp"))


_TEMPS = (0.5, 1.0, 2.0)


@query(f"with {_NN}, tt as (select nn.*, t.temperature from nn, (values (0.5::double), (1.0::double), (2.0::double)) t(temperature)), e as (select *, exp(-dist / temperature - max(-dist / temperature) over (partition by qid, temperature)) as ex from tt), sm as (select *, ex / sum(ex) over (partition by qid, temperature) as prob from e) select temperature, qid, val as token, round(sum(prob), 6) as prob from sm group by all")
def knn_temperature_sweep(spark, sf_dir):
    n = knnlm.with_values(_nn(spark, sf_dir), store(spark, sf_dir)).withColumn("temperature", F.explode(F.array(*(F.lit(t) for t in _TEMPS))))
    n = n.withColumn("dist", F.col("dist") / F.col("temperature"))
    by = ("temperature", "qid")
    return knnlm.token_distribution(knnlm.neighbour_weights(n, by=by), by).select(*by, "token", F.round("prob", 6).alias("prob"))


_LM = "uc as (select val as token, count(*) as n from s where val is not null group by val), ut as (select sum(n) as sn, count(*) as v from uc), lm as (select uc.token, ln((uc.n + 1) / (ut.sn + ut.v)) as logp from uc, ut)"
_J = "aq as (select qid, token from kp union select qid, label from q where label is not null), j as (select qid, token, coalesce(ln(kp.prob), -10000) as k, coalesce(lm.logp, -10000) as m from aq left join kp using (qid, token) left join lm using (token))"


def _mix(w: float) -> str:
    return f"greatest(m + ln({1 - w}), k + ln({w})) + ln(exp(m + ln({1 - w}) - greatest(m + ln({1 - w}), k + ln({w}))) + exp(k + ln({w}) - greatest(m + ln({1 - w}), k + ln({w}))))"


def _mixed(spark, sf_dir, weight: float | None) -> DataFrame:
    """Over the neighbours' tokens and each query's label."""
    labels = asked(spark, sf_dir).select("qid", F.col("label").alias("token"))
    return knnlm.interpolated(_knn(spark, sf_dir), knnlm.unigram_lm(store(spark, sf_dir)), weight, asked=labels)


@query(f"with {_TOKENS}, {_LM}, {_J} select qid, token, round({_mix(0.25)}, 6) as logp from j")
def knnlm_interpolate(spark, sf_dir):
    return _mixed(spark, sf_dir, 0.25).select("qid", "token", F.round("logp", 6).alias("logp"))


@query(f"with {_TOKENS}, {_LM}, {_J} " + " union all ".join(f"select {w}::double as weight, qid, token, round({'m' if w == 0 else 'k' if w == 1 else _mix(w)}, 6)::double as logp from j" for w in (0.0, 0.25, 0.5, 1.0)))
def knnlm_lambda_sweep(spark, sf_dir):
    j = _mixed(spark, sf_dir, None)
    rows = F.array(*(F.struct(F.lit(w).alias("weight"), F.round(interpolate(F.col("k"), F.col("m"), w), 6).alias("logp")) for w in (0.0, 0.25, 0.5, 1.0)))
    return j.select("qid", "token", F.explode(rows).alias("r")).select("r.weight", "qid", "token", "r.logp")


@query(f"with {_TOKENS}, {_LM}, {_J}, p as (select j.qid, j.token, {_mix(0.25)} as logp from j), x as (select coalesce(p.logp, -10000) as logp from q left join p on p.qid = q.qid and p.token = q.label where q.label is not null) select round(-avg(logp), 6) as loss, round(exp(-avg(logp)), 6) as ppl from x")
def knnlm_perplexity(spark, sf_dir):
    return knnlm.mean_loss(_mixed(spark, sf_dir, 0.25), asked(spark, sf_dir)).select(F.round("loss", 6).alias("loss"), F.round("ppl", 6).alias("ppl"))


@query(f"with {_NN} select qid, key_id, rank from nn where qid in (select max(qid) from q group by qid // 100)")
def knn_last_position_only(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("seq_id", F.expr("qid div 100")).withColumn("t", F.col("qid"))
    last = knnlm.last_positions(q)
    return _others(ann.exact_search(last.select("qid", "qv"), store(spark, sf_dir), K + 1), K).select("qid", "key_id", F.col("rank").cast("long").alias("rank"))


@query("with c as (select label % 3 as grp, label as token, count(*)::double as logit from embeddings where label is not null group by all), m as (select *, max(logit) over (partition by grp) as top from c) select grp, token, round(logit - (top + ln(sum(exp(logit - top)) over (partition by grp))), 6) as logp from m")
def lm_log_softmax(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").where("label is not null").groupBy((F.col("label") % 3).alias("grp"), F.col("label").alias("token")).agg(F.count("*").cast("double").alias("logit"))
    return c.select("grp", "token", F.round(log_softmax(F.col("logit"), "grp"), 6).alias("logp"))


# --- cells, clusters, codes -----------------------------------------------------------

_CENT = f"{_VEC}, ex as (select val as cell_id, unnest(key)::double as x, generate_subscripts(key, 1) as i from s where val is not null), cm as (select cell_id, i, avg(x) as m from ex group by cell_id, i), cent as (select cell_id, list(m order by i) as c from cm group by cell_id)"
_CD = "list_sum(list_transform(list_zip({}, c), lambda p: (p[1]::double - p[2]) * (p[1]::double - p[2])))"
_CELLS = f"{_CENT}, kc as (select key_id, cell_id, row_number() over (partition by key_id order by {_CD.format('key')}, cell_id) as r from s, cent), cells as (select key_id, cell_id from kc where r = 1)"


@query(f"with {_CENT} select cell_id::bigint as cell_id, cast(generate_subscripts(c, 1) - 1 as bigint) as i, round(unnest(c), 6) as m from cent")
def centroid_means(spark, sf_dir):
    c = ann.mean_centroids(store(spark, sf_dir))
    return c.select("cell_id", F.posexplode("centroid").alias("i", "m")).select("cell_id", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


def _cells(spark, sf_dir) -> DataFrame:
    s = store(spark, sf_dir)
    return ann.assign_cells(s, ann.mean_centroids(s)).select("key_id", "cell_id")


@query(f"with {_CELLS} select key_id, cell_id::bigint as cell_id from cells")
def cluster_assign(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"with {_CELLS}, z as (select cell_id, count(*) as members from cells group by cell_id) select cell_id::bigint as cell_id, members, key_id from cells join z using (cell_id)")
def cluster_members(spark, sf_dir):
    """Every cluster's members, each key once, with the cluster's size."""
    c = _cells(spark, sf_dir)
    return c.join(c.groupBy("cell_id").agg(F.count("*").alias("members")), "cell_id").select("cell_id", "members", "key_id")


@query(f"with {_CELLS} select cell_id::bigint as cell_id, count(*) as n, min(key_id) as first_key, max(key_id) as last_key from cells group by cell_id")
def cluster_histogram(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("cell_id").agg(F.count("*").alias("n"), F.min("key_id").alias("first_key"), F.max("key_id").alias("last_key"))


NPROBE = 8  # of ten cells: the least at which the measured recall is 0.9
_PROBE = f"{_CELLS}, qp as (select qid, qv, cell_id, row_number() over (partition by qid order by {_CD.format('qv')}, cell_id) as r from q, cent), ph as (select qp.qid, s.key_id, {_L2} as dist from qp join cells on cells.cell_id = qp.cell_id join s on s.key_id = cells.key_id where qp.r <= {NPROBE} and s.key_id <> qp.qid), ivf as (select *, row_number() over (partition by qid order by dist, key_id) as rank from ph qualify rank <= {K})"


def _ivf(spark, sf_dir) -> DataFrame:
    s = store(spark, sf_dir)
    return _others(ann.ivf_search(asked(spark, sf_dir), s, ann.mean_centroids(s), K + 1, NPROBE), K)


@query(f"with {_PROBE} select qid, key_id, round(dist, 6) as dist, rank from ivf")
def ivf_probe_search(spark, sf_dir):
    return _ivf(spark, sf_dir).select("qid", "key_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_PROBE} select qid, key_id, round(dist, 6) as dist, rank from ivf")
def ivf_stored_search(spark, sf_dir):
    """Search in an index that has been written, by cell, and opened again."""
    s = store(spark, sf_dir)
    cells, path = ann.mean_centroids(s), work_path(spark, "index")
    tables.write_index(cells, ann.in_cells(s, cells), path)
    cells, vectors = tables.read_index(spark, path)
    found = _others(ann.ivf_search(asked(spark, sf_dir), None, cells, K + 1, NPROBE, vectors), K)
    return found.select("qid", "key_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_PROBE}, d as (select qid, key_id, {_L2} as dist from q, s where key_id <> qid), nn as (select *, row_number() over (partition by qid order by dist, key_id) as rank from d qualify rank <= {K}) select nn.qid, round(count(ivf.key_id) / count(*), 6) as recall from nn left join ivf on ivf.qid = nn.qid and ivf.key_id = nn.key_id group by nn.qid")
def ivf_recall_at_k(spark, sf_dir):
    return ann.recall_at_k(_ivf(spark, sf_dir), _nn(spark, sf_dir)).select("qid", F.round("recall", 6).alias("recall"))


@query()
def kmeans_clusters(spark, sf_dir):
    """Clusters of the whole datastore by distributed k-means (20 iterations, seed 1)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    s = store(spark, sf_dir).select("key_id", array_to_vector(F.transform("key", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=16, maxIter=20, seed=1).fit(s)
    return model.transform(s).select("key_id", F.col("prediction").cast("long").alias("cluster_id"))


def _trained(spark, sf_dir):
    s = store(spark, sf_dir)
    cells = ann.train_cells(s, 16)
    return s, cells, ann.train_product_codes(s, cells, parts=8)


@query()
def pq_encode(spark, sf_dir):
    s, cells, book = _trained(spark, sf_dir)
    return ann.encode_product(s, cells, book)


@query()
def pq_search(spark, sf_dir):
    """Search on product codes with the recall against the exact neighbours."""
    s, cells, book = _trained(spark, sf_dir)
    found = ann.product_search(asked(spark, sf_dir), ann.encode_product(s, cells, book), cells, book, 8 * K, 16).where("key_id <> qid")
    refined = ann.top_k(ann.recomputed(found, asked(spark, sf_dir), s).drop("rank"), K)
    return refined.select("qid", "key_id", F.round("dist", 6).alias("dist"), "rank")


@query(f"with {_NN}, m as (select qid, key_id from nn) select m.qid, m.key_id, n.key_id as next_id, n.val as next_val from m left join s n on n.key_id = m.key_id + 1")
def pointer_successors(spark, sf_dir):
    n = _nn(spark, sf_dir).select("qid", "key_id")
    r = automaton.successors(n, store(spark, sf_dir)).withColumn("_in", F.col("next_val").isNotNull())
    return r.select("qid", "key_id", F.when(F.col("_in"), F.col("next_id")).alias("next_id"), "next_val")


@query(f"with {_NN} select qid, key_id from nn where val = label and key_id < (select max(key_id) from s)")
def pointer_valid(spark, sf_dir):
    s = store(spark, sf_dir)
    n = knnlm.with_values(_nn(spark, sf_dir), s).join(asked(spark, sf_dir).select("qid", "label"), "qid")
    return automaton.valid_pointers(n, s.agg(F.max("key_id")).first()[0] + 1).select("qid", "key_id")


@query(
    f"with {_CELLS}, d as (select qid, key_id, {_L2} as dist from q, s where key_id <> qid), nn as (select *, row_number() over (partition by qid order by dist, key_id) as rank from d qualify rank <= 3), "
    "pc as (select nn.qid, cells.cell_id, count(*) as n from nn join cells on cells.key_id = nn.key_id group by all), "
    "ext as (select qid, key_id, -1000000000 + rank as o1, cast(0 as bigint) as o2, cast(0 as bigint) as o3 from nn union all select pc.qid, cells.key_id, -pc.n, cells.cell_id, cells.key_id from pc join cells on cells.cell_id = pc.cell_id), "
    "num as (select qid, key_id, row_number() over (partition by qid order by o1, o2, o3) - 1 as pos from ext) select qid, pos, key_id from num where pos < 40"
)
def cluster_expand(spark, sf_dir):
    n = _nn(spark, sf_dir, 3).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "key_id"))).alias("p"))
    p = n.select("qid", F.transform("p", lambda x: x["key_id"]).alias("pointers"))
    clusters = _cells(spark, sf_dir).withColumnRenamed("cell_id", "cluster_id")
    e = automaton.expand_clusters(p, clusters, 40, "qid").select("qid", F.posexplode("ext").alias("pos", "key_id"))
    return e.select("qid", F.col("pos").cast("long").alias("pos"), "key_id")


def _decoded(spark, sf_dir):
    """Sequences of queries by hundreds of ids, over the datastore renumbered without gaps."""
    s = ordinals.ordinal(store(spark, sf_dir).withColumnRenamed("key_id", "_old"), "_old", name="key_id").drop("_old")
    q = asked(spark, sf_dir).withColumn("seq_id", F.expr("qid div 100")).withColumn("t", F.expr("(qid % 100) div 20"))
    nn = _others(ann.exact_search(q.select("qid", "qv"), s, K + 1), K).join(q.select("qid", "seq_id", "t"), "qid").select("seq_id", "t", "key_id", "dist")
    clusters = ann.assign_cells(s, ann.mean_centroids(s)).select("key_id", F.col("cell_id").alias("cluster_id"))
    return automaton.decode(q.select("seq_id", "t", "qv", "label"), s, nn, s.count(), clusters, min_knns=2, max_knns=32)


@query()
def automaton_decode(spark, sf_dir):
    steps, dist = _decoded(spark, sf_dir)
    return dist.select("seq_id", "t", "token", F.round("prob", 6).alias("prob"))


@query()
def lookups_saved(spark, sf_dir):
    steps, _ = _decoded(spark, sf_dir)
    return automaton.lookups_saved(steps)


# --- perplexity, metrics, summaries -------------------------------------------------------

_UNI = f"tk as (select doc_id, unnest({_TOK}) as token from documents), uc as (select token, count(*) as n from tk group by token), ut as (select sum(n) as sn, count(*) + 1 as v from uc)"


@query(f"with {_UNI} select doc_id, count(*) as tokens, round(-avg(ln((n + 1) / (sn + v))), 6) as loss, round(exp(-avg(ln((n + 1) / (sn + v)))), 3) as ppl from tk join uc using (token), ut where doc_id is not null group by doc_id")
def unigram_ppl(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = perplexity.unigram_perplexity(d.where("doc_id is not null"), "doc_id", "text", perplexity.unigram_counts(d))
    return p.select("doc_id", "tokens", F.round("loss", 6).alias("loss"), F.round("ppl", 3).alias("ppl"))


_PT = "regexp_extract_all(lower(coalesce(prompt, '')), '[a-z0-9]+')"
_GT = "regexp_extract_all(lower(coalesce(generated, '')), '[a-z0-9]+')"
_RT = "regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+')"


@query(f"with {_GEN}, uc as (select token, count(*) as n from (select unnest({_PT}) as token from g) group by token), ut as (select sum(n) as sn, count(*) + 1 as v from uc), ft as (select gen_id, len({_PT}) as skip, list_concat({_PT}, {_GT}) as t from g), e as (select gen_id, skip, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from ft) select gen_id, count(*) as tokens, round(-avg(ln((coalesce(n, 0) + 1) / (sn + v))), 6) as loss from e left join uc using (token), ut where pos >= skip group by gen_id")
def cond_ppl(spark, sf_dir):
    """Loss of the generated tokens after the prompt's, under the prompts' unigram model."""
    g = generations(spark, sf_dir)
    full = g.select("gen_id", F.size(T.tokens(F.col("prompt"))).alias("skip"), F.concat_ws(" ", F.coalesce("prompt", F.lit("")), F.coalesce("generated", F.lit(""))).alias("full"))
    p = perplexity.unigram_perplexity(full, "gen_id", "full", perplexity.unigram_counts(g, "prompt"), prefix_len="skip")
    return p.select("gen_id", "tokens", F.round("loss", 6).alias("loss"))


_NN_ = "case when not isnan({0}) then {0} end"


@query(f"with {_GEN} select run_id as model, round(avg({_NN_.format('self_loss')}), 6) as self_loss, round(avg({_NN_.format('cond_loss')}), 6) as cond_loss, round(exp(avg({_NN_.format('self_loss')})), 6) as self_ppl, round(exp(avg({_NN_.format('cond_loss')})), 6) as cond_ppl from g group by run_id")
def self_vs_cond_summary(spark, sf_dir):
    p = metrics.perplexities(generations(spark, sf_dir).withColumnRenamed("run_id", "model"), "model", {"self": "self_loss", "cond": "cond_loss"})
    return p.select("model", *(F.round(c, 6).alias(c) for c in ("self_loss", "cond_loss", "self_ppl", "cond_ppl")))


@query(f"with {_GEN} select run_id as model, count(*) as \"rows\", " + ", ".join(f"round(avg({_NN_.format(c)}), 6) as {c}" for c in ("self_loss", "self_ppl", "cond_loss", "cond_ppl")) + " from g group by run_id")
def metrics_summary(spark, sf_dir):
    g = generations(spark, sf_dir).withColumnRenamed("run_id", "model")
    cols = ["self_loss", "self_ppl", "cond_loss", "cond_ppl", "no_such_metric"]
    return metrics.summary(g, "model", cols).select("model", "rows", *(F.round(c, 6).alias(c) for c in cols[:4]))


def _rouge_sql(n: int) -> str:
    gram = lambda t: f"list_transform(generate_series(1, len({t}) - {n - 1}), lambda i: array_to_string({t}[i:i+{n - 1}], ' '))"
    return f"""with {_GEN}, w as (select gen_id, {_RT} as r, {_GT} as t from g), a as (select gen_id, x as gram, count(*) as c from (select gen_id, unnest({gram('r')}) as x from w) group by all),
b as (select gen_id, x as gram, count(*) as c from (select gen_id, unnest({gram('t')}) as x from w) group by all), h as (select a.gen_id, sum(least(a.c, b.c)) as hit from a join b on a.gen_id = b.gen_id and a.gram = b.gram group by a.gen_id)
select w.gen_id, round(case when h.hit is null then 0 else 2 * h.hit / (greatest(len(r) - {n - 1}, 0) + greatest(len(t) - {n - 1}, 0)) end, 6)::double as rouge{n} from w left join h using (gen_id)"""


def _scored(spark, sf_dir, *wanted: str, stem: bool = False) -> DataFrame:
    return metrics.text_metrics(generations(spark, sf_dir).select("gen_id", "run_id", "reference", "generated"), stem=stem, wanted=wanted)


@query(_rouge_sql(1))
def rouge1(spark, sf_dir):
    return _scored(spark, sf_dir, "rouge1").select("gen_id", F.round("rouge1", 6).alias("rouge1"))


@query(_rouge_sql(2))
def rouge2(spark, sf_dir):
    return _scored(spark, sf_dir, "rouge2").select("gen_id", F.round("rouge2", 6).alias("rouge2"))


@query()
def rougeL(spark, sf_dir):
    return _scored(spark, sf_dir, "rougeL", "rougeLsum", stem=True).select("gen_id", F.round("rougeL", 6).alias("rougeL"), F.round("rougeLsum", 6).alias("rougeLsum"))


@query()
def bleu(spark, sf_dir):
    return _scored(spark, sf_dir, "bleu").select("gen_id", F.round("bleu", 6).alias("bleu"))


def _long(t: str) -> str:
    return f"list_distinct(list_filter({t}, lambda w: length(w) >= 8))"


_SETS = f"{_GEN}, st as (select gen_id, run_id, prompt, reference, generated, self_loss, cond_loss, {_long(_PT)} as p, {_long(_RT)} as r, {_long(_GT)} as t from g), sz as (select *, len(list_intersect(r, t)) as rt, len(list_distinct(list_concat(r, t))) as rut, len(list_intersect(p, t)) as pt, len(list_distinct(list_concat(p, t))) as put, len(list_filter(t, lambda w: not list_contains(r, w))) as neg, len(list_filter(t, lambda w: not list_contains(p, w) and not list_contains(r, w))) as new from st)"
_DIV = "case when {1} = 0 then 1.0 else {0} / {1} end"
_OVER = f"{_DIV.format('rt', 'rut')}"


def _entities(spark, sf_dir) -> DataFrame:
    g = generations(spark, sf_dir)
    e = g.withColumns({f"_{c}": metrics.entity_words(F.col(c)) for c in ("prompt", "reference", "generated")})
    return metrics.set_overlap(e, "_prompt", "_reference", "_generated")


@query(f"with {_SETS} select gen_id, round({_DIV.format('rt', 'rut')}, 6)::double as entity_jaccard_ref_gen, round({_DIV.format('rt', 'len(r)')}, 6)::double as entity_recall_ref_gen, round({_DIV.format('rt', 'len(t)')}, 6)::double as entity_precision_ref_gen, round({_DIV.format('pt', 'put')}, 6)::double as entity_jaccard_prompt_gen from sz")
def entity_overlap(spark, sf_dir):
    cols = ("entity_jaccard_ref_gen", "entity_recall_ref_gen", "entity_precision_ref_gen", "entity_jaccard_prompt_gen")
    return _entities(spark, sf_dir).select("gen_id", *(F.round(c, 6).alias(c) for c in cols))


@query(f"with {_SETS} select gen_id, (neg > 0)::bigint as entity_neg_hallucination_flag, new::bigint as umls_new_concepts_count, (new > 0)::bigint as umls_hallucination_flag from sz")
def hallucination_flags(spark, sf_dir):
    return _entities(spark, sf_dir).select("gen_id", "entity_neg_hallucination_flag", "umls_new_concepts_count", "umls_hallucination_flag")


_LOGIT = "coalesce(case when not isnan({0}) then {0} end, 0)"


def _nli_sql(a: str, b: str) -> str:
    empty = " or ".join(f"{_strip(f'coalesce({x}, chr(32))')} = ''" for x in (a, b))
    top = "greatest(lc, le, ln_)"
    return f"case when {empty} then 0.0 else (exp(le - {top}) - exp(lc - {top})) / (exp(lc - {top}) + exp(le - {top}) + exp(ln_ - {top})) end"


_NLI_T = f"{_SETS}, lg as (select *, {_LOGIT.format('self_loss')} as lc, {_LOGIT.format('cond_loss')} as le, 1.0::double as ln_ from sz)"


def _nli(a: str, b: str):
    logit = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    return metrics.faithfulness(logit("self_loss"), logit("cond_loss"), F.lit(1.0), F.col(a), F.col(b))


@query(f"with {_NLI_T} select gen_id, round({_nli_sql('reference', 'generated')}, 6) as nli_ref_gen from lg")
def nli_faithfulness(spark, sf_dir):
    """Over stand-in logits (the two losses and 1): the model itself is an outside input."""
    return generations(spark, sf_dir).select("gen_id", F.round(_nli("reference", "generated"), 6).alias("nli_ref_gen"))


@query(f"with {_NLI_T} select gen_id, round(0.40 * ({_nli_sql('reference', 'generated')}) + 0.20 * ({_DIV.format('rt', 'len(r)')}) + 0.15 * ({_DIV.format('rt', 'len(t)')}) + 0.10 * ({_nli_sql('prompt', 'generated')}) + 0.10 * ({_DIV.format('rt', 'rut')}) + 0.05 * ({_DIV.format('pt', 'put')}), 6) as composite_safe_score from lg")
def composite_score(spark, sf_dir):
    e = _entities(spark, sf_dir)
    s = metrics.composite(
        _nli("reference", "generated"), F.col("entity_recall_ref_gen"), F.col("entity_precision_ref_gen"), _nli("prompt", "generated"), F.col("entity_jaccard_ref_gen"), F.col("entity_jaccard_prompt_gen")
    )
    return e.select("gen_id", F.round(s, 6).alias("composite_safe_score"))


#: the metrics of a row, in the order of the summary table
ALL_METRICS = (
    "self_loss", "self_ppl", "cond_loss", "cond_ppl", "rouge1", "rouge2", "rougeL", "rougeLsum", "bleu", "bertscore_precision", "bertscore_recall", "bertscore_f1", "nli_ref_gen", "nli_prompt_gen", "nli_prompt_ref", "nli_gen_ref",
    "entity_jaccard_ref_gen", "entity_recall_ref_gen", "entity_precision_ref_gen", "entity_jaccard_prompt_gen", "entity_neg_hallucination_flag", "umls_new_concepts_count", "umls_hallucination_flag", "composite_safe_score",
)


@query()
def all_metrics(spark, sf_dir):
    """The means of all 24 metrics by run; model outputs are stand-ins (see nli_faithfulness and token_match_scores)."""
    e = _entities(spark, sf_dir)
    e = e.withColumns({"nli_ref_gen": _nli("reference", "generated"), "nli_prompt_gen": _nli("prompt", "generated"), "nli_prompt_ref": _nli("prompt", "reference"), "nli_gen_ref": _nli("generated", "reference")})
    e = e.withColumns(metrics.token_match_scores(T.tokens(F.col("reference")), T.tokens(F.col("generated"))))
    m = metrics.text_metrics(e.select("run_id", "reference", "generated", *(c for c in ALL_METRICS if c in e.columns)))
    m = m.withColumn("composite_safe_score", metrics.composite(F.col("nli_ref_gen"), F.col("entity_recall_ref_gen"), F.col("entity_precision_ref_gen"), F.col("nli_prompt_gen"), F.col("bertscore_f1"), F.col("rougeL")))
    return metrics.summary(m.drop("reference", "generated"), "run_id", list(ALL_METRICS))


_TM = "case when len({0}) > 0 and len({1}) > 0 then len(list_filter({0}, lambda x: list_contains({1}, x)))::double / len({0}) else 0 end"


@query(f"with {_GEN}, w as (select gen_id, {_RT} as r, {_GT} as t from g), x as (select gen_id, {_TM.format('t', 'r')} as p, {_TM.format('r', 't')} as q from w) select gen_id, round(p, 6) as bertscore_precision, round(q, 6) as bertscore_recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as bertscore_f1 from x")
def token_match(spark, sf_dir):
    g = generations(spark, sf_dir).withColumns(metrics.token_match_scores(T.tokens(F.col("reference")), T.tokens(F.col("generated"))))
    return g.select("gen_id", *(F.round(c, 6).alias(c) for c in metrics.BERTSCORE))


@query(
    "with v as (select label, vec_id % 2 as side, vec_id, embedding as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings where label is not null), "
    "c as (select a.label, a.vec_id as i, b.vec_id as j, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1]::double * p[2]::double)) / (a.n * b.n) as cos from v a join v b on a.label = b.label and a.side = 0 and b.side = 1), "
    "r as (select label, avg(m) as r from (select label, i, max(cos) as m from c group by label, i) group by label), p as (select label, avg(m) as p from (select label, j, max(cos) as m from c group by label, j) group by label) "
    "select label, round(p, 6) as bertscore_precision, round(r, 6) as bertscore_recall, round(2 * p * r / (p + r), 6) as bertscore_f1 from p join r using (label)"
)
def max_cosine(spark, sf_dir):
    """Vectors of even against those of odd ids under each label, as if tokens of two texts."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    side = lambda n: F.collect_list(F.when(F.col("vec_id") % 2 == n, F.col("embedding")))
    m = metrics.max_cosine_scores(e.groupBy("label").agg(side(0).alias("_a"), side(1).alias("_b")), "_a", "_b")
    return m.select("label", *(F.round(c, 6).alias(c) for c in metrics.BERTSCORE))


# --- readers, writers, converters, streams ---------------------------------------------------


@query(f"with {_GEN} select gen_id::varchar as gen_id, run_id from g")
def csv_round_trip(spark, sf_dir):
    path = work_path(spark, "csv")
    tables.write_csv(generations(spark, sf_dir).select("gen_id", "run_id"), path)
    return tables.read_csv(spark, path)


@query(f"with {_CONV}, e as (select record_id, unnest(messages) as m, generate_subscripts(messages, 1) as pos from conv) select record_id::varchar as record_id, (pos - 1)::bigint as pos, m.role as role, m.content as content from e")
def jsonl_round_trip(spark, sf_dir):
    path = work_path(spark, "jsonl")
    tables.write_conversations(conversations(spark, sf_dir).select("messages", F.create_map(F.lit("record_id"), F.col("record_id").cast("string")).alias("metadata")), path)
    return _exploded(tables.read_conversations(spark, path).withColumn("record_id", F.col("metadata")["record_id"]), "record_id")


@query(f"with {_SPLIT} select split, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from split3 group by split")
def splits_round_trip(spark, sf_dir):
    path = work_path(spark, "splits")
    tables.write_splits(split_assign(spark, sf_dir), path)
    back = tables.read_splits(spark, {s: f"{path}/split={s}" for s in ("train", "val", "test")}, extension="parquet")
    return back.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("select vec_id as key_id, label as val, len(embedding)::bigint as dim, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings")
def dstore_round_trip(spark, sf_dir):
    """The datastore with its key vectors, written once and opened again."""
    path = work_path(spark, "dstore")
    tables.write_datastore(store(spark, sf_dir), path)
    d = tables.read_datastore(spark, path)
    return d.select("key_id", "val", F.size("key").cast("long").alias("dim"), F.round(F.aggregate(F.transform("key", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"with {_PARTS}, m as (select 1 as pos, context as c from parsed union all select 2, {_strip('impression')} from parsed) select pos::bigint as pos, count(*) as n, sum(length(c))::bigint as chars from m group by pos")
def csv_conversion(spark, sf_dir):
    """Reports to CSV, and the CSV to fine-tuning conversations in JSON lines."""
    source, target = work_path(spark, "csv"), work_path(spark, "jsonl")
    tables.write_csv(parsed(spark, sf_dir).select("context", "impression"), source)
    convert.convert_csv(spark, source, target, finetune=True)
    e = tables.read_conversations(spark, target).select(F.posexplode("messages").alias("pos", "m")).where("pos > 0")
    return e.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))


@query("select row_number() over (order by vec_id) - 1 as key_id, vec_id as at, label as val from embeddings")
def stream_append(spark, sf_dir):
    """Datastore rows through a stream that numbers them on from batch to batch."""
    source, target = work_path(spark, "stream"), work_path(spark, "store")
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("key"), F.col("label").alias("val")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    append_stream(stream, target, work_path(spark, "offsets"), "at").awaitTermination()
    return spark.read.parquet(target).select("key_id", "at", "val")


@query(
    'with ' + _WIN + _POS[len(f"{_BATCH}, {_CUT}"):] + """, j as (select win.batch, win."window" as w, win.b, win.e, pos.pos, pos.token from win join pos on pos.batch = win.batch and pos.pos >= win.b and pos.pos < win.e)
    select batch, w as "window", string_agg(token, ' ' order by pos) || repeat(' <pad>', (""" + f"{BLOCK} - (e - b))::int) as ids, count(*) filter (where pos >= w * {STRIDE}) as labels, {BLOCK}::bigint as mask from j group by batch, w, b, e"
)
def window_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    b = windows.window_blocks(windows.token_rows(d, "doc_id"), windows.windows(windows.batch_totals(d, "doc_id"), BLOCK, STRIDE))
    return b.select("batch", "window", F.concat_ws(" ", "input_ids").alias("ids"), F.size(F.filter("labels", lambda x: x.isNotNull())).cast("long").alias("labels"), F.size("attention_mask").cast("long").alias("mask"))
