"""Evaluation of generated text: n-gram overlap, set overlap, faithfulness, composite score, summaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.probability import no_nan, safe_div

BERTSCORE = ("bertscore_precision", "bertscore_recall", "bertscore_f1")
TEXT_METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum", "bleu")

_WORD = re.compile(r"[a-z0-9]+")


class PorterStemmer:
    """The 1980 suffix-stripping algorithm, with its published rule tables."""

    # --- fixed values: rules of steps 2 to 4 ---
    STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
    # -------------------------------------------

    def __init__(self):
        pairs = lambda t: sorted((p.split(":") for p in t.split()), key=lambda p: -len(p[0]))
        self.two, self.three, self.four = pairs(self.STEP2), pairs(self.STEP3), sorted(self.STEP4.split(), key=len, reverse=True)
        self.known: dict[str, str] = {}

    @staticmethod
    def _form(w: str) -> str:
        """c and v for each letter; y after a consonant is a vowel."""
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[i - 1] == "c") else "c"
        return out

    def _m(self, w: str) -> int:
        return len(re.findall("v+c+", self._form(w)))

    def _vowel(self, w: str) -> bool:
        return "v" in self._form(w)

    def _double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self._form(w)[-1] == "c"

    def _cvc(self, w: str) -> bool:
        return len(w) > 2 and self._form(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def stem(self, w: str) -> str:
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = self._stem(w)
        return self.known[w]

    def _stem(self, w: str) -> str:
        if len(w) < 3:
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        again = False
        if w.endswith("eed"):
            if self._m(w[:-3]) > 0:
                w = w[:-1]
        elif w.endswith("ed") and self._vowel(w[:-2]):
            w, again = w[:-2], True
        elif w.endswith("ing") and self._vowel(w[:-3]):
            w, again = w[:-3], True
        if again:
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif self._double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif self._m(w) == 1 and self._cvc(w):
                w += "e"
        if w.endswith("y") and self._vowel(w[:-1]):
            w = w[:-1] + "i"
        for rules in (self.two, self.three):
            for end, new in rules:
                if w.endswith(end):
                    if self._m(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in self.four:
            if w.endswith(end):
                base = w[: -len(end)]
                if self._m(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                    w = base
                break
        if w.endswith("e"):
            m = self._m(w[:-1])
            if m > 1 or (m == 1 and not self._cvc(w[:-1])):
                w = w[:-1]
        if self._m(w) > 1 and self._double(w) and w[-1] == "l":
            w = w[:-1]
        return w


def words(text: str, stemmer: PorterStemmer | None = None) -> list[str]:
    w = _WORD.findall(text.lower())
    return [stemmer.stem(x) if len(x) > 3 else x for x in w] if stemmer else w


def f1(hit: int, a: int, b: int) -> float:
    return 2 * hit / (a + b) if hit else 0.0


def ngram_f1(ref: list[str], gen: list[str], n: int) -> float:
    a, b = (Counter(zip(*(x[i:] for i in range(n)))) for x in (ref, gen))
    return f1(sum((a & b).values()), sum(a.values()), sum(b.values()))


def lcs_table(a: list[str], b: list[str]) -> list[list[int]]:
    t = [[0] * (len(b) + 1)]
    for x in a:
        up, row = t[-1], [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
        t.append(row)
    return t


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence; a row of the table is one long integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def lcs_f1(ref: list[str], gen: list[str]) -> float:
    return f1(lcs_length(ref, gen), len(ref), len(gen))


def _lcs_members(ref: list[str], gen: list[str]) -> set[int]:
    """Positions in ref of one longest common subsequence."""
    t, i, j, out = lcs_table(ref, gen), len(ref), len(gen), set()
    while i and j:
        if ref[i - 1] == gen[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def lcs_sum_f1(ref: list[list[str]], gen: list[list[str]]) -> float:
    """Summary-level LCS: for each reference line the union of its matches with all lines, words clipped to their counts."""
    left_r, left_g = Counter(w for s in ref for w in s), Counter(w for s in gen for w in s)
    n_ref, n_gen, hit = sum(left_r.values()), sum(left_g.values()), 0
    for r in ref:
        for i in sorted(set().union(*(_lcs_members(r, g) for g in gen))):
            if left_r[r[i]] and left_g[r[i]]:
                hit += 1
                left_r[r[i]] -= 1
                left_g[r[i]] -= 1
    return f1(hit, n_ref, n_gen)


def tokens_13a(text: str) -> list[str]:
    """The usual BLEU tokenization (13a): punctuation apart, but not within numbers."""
    t = f" {text.replace('<skipped>', '').replace('-' + chr(10), '').replace(chr(10), ' ').replace('&quot;', chr(34)).replace('&amp;', '&').replace('&lt;', '<').replace('&gt;', '>')} "
    t = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", t)
    t = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", t)
    t = re.sub(r"([\.,])([^0-9])", r" \1 \2", t)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", t).split()


def bleu(ref: list[str], gen: list[str], order: int = 4) -> float:
    """Unsmoothed BLEU of one pair: 0 when an order has no match."""
    if not gen or not ref:
        return 0.0
    total = 0.0
    for n in range(1, order + 1):
        a, b = (Counter(zip(*(x[i:] for i in range(n)))) for x in (ref, gen))
        hit, all_ = sum((a & b).values()), max(len(gen) - n + 1, 0)
        if not hit or not all_:
            return 0.0
        total += log(hit / all_) / order
    return exp(total) * (1.0 if len(gen) > len(ref) else exp(1 - len(ref) / len(gen)))


def text_metrics(df: DataFrame, reference: str = "reference", generated: str = "generated", stem: bool = True, wanted: tuple[str, ...] = TEXT_METRICS) -> DataFrame:
    """Adds those of rouge1, rouge2, rougeL, rougeLsum (F1) and bleu that are wanted; null texts count as empty, empty against anything scores 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stemmer = PorterStemmer() if stem else None
        lines = lambda x: [words(s, stemmer) for s in x.split("\n") if s.strip()]
        one = {
            "rouge1": lambda r, g, a, b: ngram_f1(a, b, 1), "rouge2": lambda r, g, a, b: ngram_f1(a, b, 2), "rougeL": lambda r, g, a, b: lcs_f1(a, b),
            "rougeLsum": lambda r, g, a, b: lcs_sum_f1(lines(r), lines(g)), "bleu": lambda r, g, a, b: bleu(tokens_13a(r), tokens_13a(g)),
        }
        for t in batches:
            rows = []
            for r, g in zip(t.column(reference).to_pylist(), t.column(generated).to_pylist()):
                r, g = r or "", g or ""
                a, b = (words(r, stemmer), words(g, stemmer)) if wanted != ("bleu",) else ([], [])
                rows.append([one[m](r, g, a, b) for m in wanted])
            cols = list(zip(*rows)) or [()] * len(wanted)
            yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(c, pa.float64()) for c in cols)], names=[*t.schema.names, *wanted])

    return df.mapInArrow(score, StructType([*df.schema.fields, *(StructField(m, DoubleType()) for m in wanted)]))


def max_cosine_scores(df: DataFrame, reference: str, generated: str) -> DataFrame:
    """Adds bertscore_precision, bertscore_recall, bertscore_f1 from the token vectors of two texts (array<array<float>>).

    Precision is the mean over generated tokens of the largest cosine with a reference token, recall that
    over reference tokens.  Without tokens on either side all are 0; a zero vector is like nothing.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            for r, g in zip(t.column(reference).to_pylist(), t.column(generated).to_pylist()):
                if not r or not g:
                    rows.append((0.0, 0.0, 0.0))
                    continue
                a, b = (np.array(x, dtype=np.float64) for x in (r, g))
                a, b = (x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-12)[:, None] for x in (a, b))
                c = a @ b.T
                p, q = float(c.max(axis=0).mean()), float(c.max(axis=1).mean())
                rows.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*t.columns, *(pa.array(c, pa.float64()) for c in cols)], names=[*t.schema.names, *BERTSCORE])

    return df.mapInArrow(score, StructType([*df.schema.fields, *(StructField(m, DoubleType()) for m in BERTSCORE)]))


def token_match_scores(reference: Column, generated: Column) -> dict[str, Column]:
    """Stand-in for max_cosine_scores where tokens have no vectors: equal tokens have cosine 1, others 0."""
    share = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(0.0)
    p, r = share(generated, reference), share(reference, generated)
    return {"bertscore_precision": p, "bertscore_recall": r, "bertscore_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def entity_words(text: Column, least: int = 8) -> Column:
    """Stand-in for a recogniser: the distinct words of at least `least` letters; null gives none."""
    from ..functions.text import tokens

    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= least)))


def set_overlap(df: DataFrame, prompt: str, reference: str, generated: str) -> DataFrame:
    """Adds jaccard, recall, precision of reference and generated sets, jaccard of prompt and generated, the
    new concepts and both flags; an empty denominator counts as 1.0.  The columns are arrays (null: empty)."""
    arr = lambda c: F.coalesce(F.array_distinct(c), F.array().cast("array<string>"))
    p, r, g = arr(prompt), arr(reference), arr(generated)
    size = lambda x: F.size(x).cast("double")
    new = F.array_except(g, F.array_union(p, r))
    return df.withColumns(
        {
            "entity_jaccard_ref_gen": safe_div(size(F.array_intersect(r, g)), size(F.array_union(r, g))),
            "entity_recall_ref_gen": safe_div(size(F.array_intersect(r, g)), size(r)),
            "entity_precision_ref_gen": safe_div(size(F.array_intersect(r, g)), size(g)),
            "entity_jaccard_prompt_gen": safe_div(size(F.array_intersect(p, g)), size(F.array_union(p, g))),
            "entity_neg_hallucination_flag": (F.size(F.array_except(g, r)) > 0).cast("long"),
            "umls_new_concepts_count": F.size(new).cast("long"),
            "umls_hallucination_flag": (F.size(new) > 0).cast("long"),
        }
    )


def faithfulness(contradiction: Column, entailment: Column, neutral: Column, a: Column, b: Column) -> Column:
    """P(entailment) - P(contradiction) of three logits; 0.0 where either text is empty."""
    from ..functions.text import strip

    top = F.greatest(contradiction, entailment, neutral)
    ec, ee, en = (F.exp(x - top) for x in (contradiction, entailment, neutral))
    empty = (strip(F.coalesce(a, F.lit(""))) == "") | (strip(F.coalesce(b, F.lit(""))) == "")
    return F.when(empty, 0.0).otherwise((ee - ec) / (ec + ee + en))


def composite(nli_ref_gen: Column, recall: Column, precision: Column, nli_prompt_gen: Column, bert_f1: Column, rouge_l: Column) -> Column:
    """Weighted sum of the six parts."""
    return 0.40 * nli_ref_gen + 0.20 * recall + 0.15 * precision + 0.10 * nli_prompt_gen + 0.10 * bert_f1 + 0.05 * rouge_l


def summary(df: DataFrame, model: str, columns: list[str] | None = None) -> DataFrame:
    """model, rows, and the mean of each numeric column (those of `columns` that exist); NaN and null are left out."""
    kinds = dict(df.dtypes)
    numeric = [c for c in (columns or df.columns) if c != model and kinds.get(c) in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    mean = lambda c: F.avg(no_nan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c))
    return df.groupBy(model).agg(F.count("*").alias("rows"), *(mean(c).alias(c) for c in numeric))


def perplexities(df: DataFrame, model: str, losses: dict[str, str]) -> DataFrame:
    """model and, for each name: loss column, the mean loss and its exponential; NaN and null losses are left out."""
    return df.groupBy(model).agg(
        *(F.avg(no_nan(F.col(c))).alias(f"{n}_loss") for n, c in losses.items()), *(F.exp(F.avg(no_nan(F.col(c)))).alias(f"{n}_ppl") for n, c in losses.items())
    )
