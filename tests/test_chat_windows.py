import pytest
from pyspark.sql import functions as F

from conftest import rows
from lanternspark.operators import chat, windows


def pairs(spark, n):
    return spark.createDataFrame([(i, f"c{i}", f"a{i}") for i in range(n)], "id long, context string, answer string")


@pytest.mark.parametrize("n", [0, 1, 2, 30, 120])
def test_one_shot_never_shows_own_answer(spark, n):
    got = chat.one_shot(pairs(spark, n), "id", "context", "answer").collect()
    assert len(got) == n
    for r in got:
        m = [x["content"] for x in r["messages"]]
        assert len(m) == 5 and m[4] == r["answer"] and m[3] == f"Summarise the following long note: {r['context']}\n"
        assert (m[2] != r["answer"]) == (not r["own_example"])
        assert r["own_example"] == (n == 1)
        if n == 120:
            assert m[2] == ("a100" if r["idx"] == 42 else "a42")


def test_finetune_triplet_roles(spark):
    d = pairs(spark, 2).withColumn("messages", chat.finetune_messages(F.col("context"), F.col("answer")))
    t = chat.triplet(d).select("user", "assistant")
    assert rows(t) == [("c0", "a0"), ("c1", "a1")]
    short = d.withColumn("messages", F.slice("messages", 2, 2))
    assert rows(chat.by_role(short).select("user", "assistant")) == rows(t)
    assert [r["assistant"] for r in chat.triplet(short).collect()] == [None, None]
    m = chat.with_metadata(d, id="id", about="context").select("metadata.id", "metadata.about")
    assert rows(m) == [(0, "c0"), (1, "c1")]


def test_few_shot(spark):
    d = pairs(spark, 6).withColumn("messages", chat.finetune_messages(F.col("context"), F.col("answer")))
    got = chat.few_shot_prompts(d, "id", limit=2).orderBy("idx").collect()
    assert [r["idx"] for r in got] == [2, 3]
    assert [m["content"] for m in got[0]["prompt"]][1:] == ["c0", "a0", "c1", "a1", "c2"]
    with pytest.raises(ValueError):
        chat.few_shot_prompts(d.limit(2), "id")


def loop(tokens, block, stride):
    total = len(tokens)
    if total >= block:
        total = total // block * block
    out = []
    for i in range(0, total, stride):
        b, e = max(i + stride - block, 0), min(i + stride, total)
        ids = tokens[b:e]
        labels = [None] * (len(ids) - (e - i)) + ids[len(ids) - (e - i) :]
        pad = block - len(ids)
        out.append((ids + ["<pad>"] * pad, labels + [None] * pad))
    return out


@pytest.mark.parametrize("n,block,stride", [(9, 4, 4), (9, 4, 2), (3, 4, 2), (0, 4, 2), (17, 5, 3), (12, 4, 6)])
def test_windows_match_the_loop(spark, n, block, stride):
    words = [f"t{i}" for i in range(n)]
    d = spark.createDataFrame([(0, " ".join(words[: n // 2])), (1, " ".join(words[n // 2 :])), (2, None)], "doc_id long, text string")
    tok, tot = windows.token_rows(d, "doc_id"), windows.batch_totals(d, "doc_id")
    win = windows.windows(tot, block, stride)
    want = loop(words, block, stride)
    if stride <= block:
        got = windows.window_blocks(tok, win).orderBy("window").collect()
        assert [(r["input_ids"], r["labels"]) for r in got] == want
        assert all(r["attention_mask"] == [1] * block for r in got)
    scored = sum(sum(x is not None for x in labels[1:]) for _, labels in want)
    em = windows.emitted(tok, tot, block, stride)
    if stride <= block:
        assert em.count() == scored
    store = windows.datastore(em, cap=4)
    assert [r["key_id"] for r in store.orderBy("key_id").collect()] == list(range(min(4, em.count())))
