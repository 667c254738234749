"""Defective answers (problem 2) and the parts shared with truncation (problem 3).

Per answer: a suffix automaton of the prompt measures how much of the answer is copied, a
word automaton finds refusals, stopword votes compare languages, and what is left after
label and punctuation tells empty answers.  Cut answers come from `truncation`.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
#: section labels that may stand before an answer
LABELS = ("impression", "impressions", "summary", "conclusion", "assessment", "opinion", "findings", "result", "answer",
          "fazit", "beurteilung", "impresion", "impresión", "conclusión", "conclusions")
#: stand-ins for a missing text, as normal words
STAND_INS = ("none", "null", "nil", "nan", "na", "n a", "no text", "no answer", "no impression", "not available", "unavailable",
             "not provided", "not applicable", "not given", "no data", "no content", "missing", "text missing", "empty", "blank",
             "unknown", "undefined", "tbd", "to follow", "pending", "no report", "no result", "keine", "kein text", "aucun",
             "ninguno", "sin texto", "redacted", "deleted", "removed")
#: who declines, and how; a word of the task must follow in the sentence
SPEAKERS = ("i", "we", "this assistant", "the assistant", "your assistant", "this model", "this tool", "this chatbot", "this service")
CANNOT = (
    "cannot", "can not", "can t", "cant", "could not", "couldn t", "will not", "won t", "wont", "do not", "don t", "does not", "doesn t", "should not", "shouldn t", "must not",
    *(f"{be} {x}" for be in ("am", "m", "are", "re", "is") for x in ("unable", "not able", "not permitted", "not allowed", "not authorised", "not authorized", "not qualified", "not licensed", "not trained", "not in a position", "not comfortable", "not going")),
    "would rather not", "d rather not", "would prefer not", "d prefer not", "prefer not", "have no way", "have no means", "lack the",
)
#: what can stand for a speaker before "unable", "cannot" and the like
REGRETS = ("sorry", "apologies", "apologize", "apologise", "unfortunately", "regret", "regrettably", "afraid")
UNABLE = ("unable", "cannot", "can t", "cant", "can not", "not able", "not possible")
#: beginnings of words for what is asked of the assistant
TASKS = ("help", "assist", "provid", "giv", "writ", "summar", "condens", "generat", "produc", "creat", "draft", "answer", "respond", "comply", "fulfil", "perform", "interpret", "diagnos", "read", "analy", "comment", "advis",
         "offer", "share", "process", "discuss", "conclu", "opinion", "recommend", "judg", "evaluat")
#: what declines without more
DECLINES = (
    "as a language model", "as an ai", "as a large language model", "as an artificial intelligence", "only a language", "just a language", "request denied", "request declined", "request refused", "request rejected",
    "i must decline", "i have to decline", "i need to decline", "i decline", "i respectfully decline", "i politely decline", "i refuse", "i must refuse", "i have to refuse", "i have to pass", "i must pass", "i ll have to pass",
    "we must decline", "we decline", "not something i can", "not something i am", "not something i should", "not appropriate for me", "not be appropriate for me", "inappropriate for me", "not able to help you", "unable to help you",
    "cannot help you", "can t help you", "unable to assist you", "cannot assist you", "unable to comply", "cannot comply", "can t comply", "cannot fulfill", "cannot fulfil",
    *(f"{w} my {x}" for w in ("outside", "outside of", "beyond", "not within") for x in ("abilities", "ability", "scope", "competence", "expertise", "capabilities", "role", "remit", "training")),
    *(f"{w} {x} me" for w in ("guidelines", "policy", "policies", "rules", "instructions") for x in ("prevent", "prevents", "forbid", "forbids", "prohibit", "prohibits", "do not allow", "does not allow", "don t allow", "do not permit", "does not permit")),
    *(f"no {w} can be {x}" for w in ("summary", "answer", "response", "impression") for x in ("given", "provided", "produced", "written", "offered")),
    "tut mir leid", "ich kann keine", "ich kann das nicht", "ich kann diese", "ich darf keine", "ich bin nicht befugt", "ich bin nicht in der lage", "je ne peux pas", "je ne puis", "je ne suis pas en mesure", "je ne suis pas autorisé",
    "je suis désolé", "je regrette", "no puedo", "no me es posible", "lo siento", "no estoy autorizado", "no estoy en condiciones", "mi dispiace", "non posso", "não posso", "lamento mas", "het spijt me", "ik kan geen",
)
#: who speaks where an answer quotes somebody
QUOTED = frozenset("patient patients pt said says stated states reported reports told tells quoted he she mother father wife husband daughter son brother sister family nurse technologist clinician physician denied insisted".split())
#: words that vote for a language (words of two languages give each half a vote)
STOPWORDS = {
    "en": "the of and with is for to from since was are be been by at an or not no this that there which has have had were as it its "
          "on in a after over into than now most likely suggest because without given i you your my near here seen within",
    "de": "der die das und im mit ein eine einen einem einer eines in den dem des von vom zu zum zur ist sind kein keine nicht für "
          "auf bei seit vor nach neben liegt zeigt sich es wird auch als am an da nun jahre tagen wochen monaten oder ohne spricht findet misst",
    "fr": "le la les l de des du d un une et en dans avec pour par est sont au aux il elle pas sur sans qui que ce cette ces son sa ses "
          "ans depuis jours semaines mois près plus ne s existe note désormais suivante autre rapport niveau",
    "es": "el la los las de del un una y en con por para que se su sus no al es son lo como más ha desde hace días semanas meses "
          "años sin muy entre junto existe observa sugieren mide muestra ahora este esta otras",
    "it": "il lo gli di della delle dei nel nella è sono non che per una con alla dal questo più come anche ha ma ed si",
    "pt": "o os as da do das dos não uma um com para que são foi na nos em há mais sem ou pelo pela ao seu sua muito também",
    "nl": "de het een van en is niet met voor op zijn aan bij dat geen er wordt ook naar als uit nog dit werd links rechts zonder",
}
#: letters that vote for a language
LETTERS = {"de": "äöüß", "fr": "èêçœàùâîôû", "es": "ñíóú¿¡", "pt": "ãõ"}
MORE = ("it", "pt", "nl")
# ---------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")
_LABEL = re.compile(rf"^\W*(?:{'|'.join(LABELS)})\b[\s:.\-]*", re.I)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, punctuation, a section label or a stand-in."""
    if text is None:
        return True
    w = " ".join(words(_LABEL.sub("", text)))
    return not w or w in _STAND_INS


_STAND_INS = frozenset(STAND_INS)


class WordAutomaton:
    """Automaton over words that finds any of many phrases (goto and failure links)."""

    def __init__(self, phrases: tuple[str, ...]):
        self.go: list[dict[str, int]] = [{}]
        self.final = [False]
        for p in phrases:
            s = 0
            for w in p.split():
                if w not in self.go[s]:
                    self.go[s][w] = len(self.go)
                    self.go.append({})
                    self.final.append(False)
                s = self.go[s][w]
            self.final[s] = True
        self.fail = [0] * len(self.go)
        queue = deque(self.go[0].values())
        while queue:
            s = queue.popleft()
            for w, t in self.go[s].items():
                queue.append(t)
                f = self.fail[s]
                while f and w not in self.go[f]:
                    f = self.fail[f]
                self.fail[t] = self.go[f].get(w, 0)
                self.final[t] |= self.final[self.fail[t]]

    def found(self, text: list[str]) -> int:
        """Number of words up to the end of the first phrase; 0 where there is none."""
        s = 0
        for n, w in enumerate(text, 1):
            while s and w not in self.go[s]:
                s = self.fail[s]
            s = self.go[s].get(w, 0)
            if self.final[s]:
                return n
        return 0


_SENTENCE = re.compile(r"[.!?\n]+")


class Refusals:
    """Does a text decline the task?  Who declines must be the writer: what a patient or clinician can't or won't do is none."""

    def __init__(self):
        self.speaker = WordAutomaton(tuple(f"{s} {c}" for s in SPEAKERS for c in CANNOT))
        self.regret = WordAutomaton(REGRETS)
        self.unable = WordAutomaton(UNABLE)
        self.decline = WordAutomaton(DECLINES)

    def __call__(self, text: str) -> bool:
        for part in _SENTENCE.split(text):
            w = words(part)
            if self.decline.found(w):
                n = self.decline.found(w)
            elif n := self.speaker.found(w):
                n = n if any(x.startswith(TASKS) for x in w[n : n + 12]) else 0
            elif n := self.regret.found(w):
                m = self.unable.found(w[n:])
                n = n if m and any(x.startswith(TASKS) for x in w[n + m : n + m + 6]) else 0
            if n and not QUOTED.intersection(w[: max(0, n - 1)]):
                return True
        return False


class SuffixAutomaton:
    """All word sequences of a text; `matches` gives the longest one that ends at each word."""

    def __init__(self, text: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in text:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def matches(self, text: list[str]) -> list[int]:
        s, n, out = 0, 0, []
        for w in text:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s, n = 0, 0
            out.append(n)
        return out


def copied(prompt: SuffixAutomaton, answer: list[str], k: int = 3) -> float:
    """Share of the answer's distinct k-word sequences that stand in the prompt."""
    n = prompt.matches(answer)
    every, inside = set(), set()
    for i in range(k - 1, len(answer)):
        g = tuple(answer[i - k + 1 : i + 1])
        every.add(g)
        if n[i] >= k:
            inside.add(g)
    return len(inside) / len(every) if every else 0.0


def may_be_copied(prompt: frozenset[str], answer: list[str], least: float, k: int = 3) -> bool:
    """Are enough k-word sequences made of the prompt's words?  Only then the automaton is worth building."""
    inside = [w in prompt for w in answer]
    every, those = set(), set()
    for i in range(len(answer) - k + 1):
        g = tuple(answer[i : i + k])
        every.add(g)
        if all(inside[i : i + k]):
            those.add(g)
    return bool(every) and len(those) >= least * len(every)


def _votes() -> dict[str, list[tuple[str, float]]]:
    own: dict[str, list[str]] = {}
    for lang, text in STOPWORDS.items():
        for w in text.split():
            own.setdefault(w, []).append(lang)
    own = {w: [x for x in ls if x not in MORE] or ls for w, ls in own.items()}  # MORE vote by words of their own only
    return {w: [(x, 1 / len(ls)) for x in ls] for w, ls in own.items()}


def language(text: str, votes: dict[str, list[tuple[str, float]]]) -> str | None:
    """Language with most stopword votes; None where there is no vote or no clear winner.

    The languages of MORE, which have few words of their own, need three votes.
    """
    n = dict.fromkeys(STOPWORDS, 0.0)
    low = text.lower()
    for w in words(low):
        for lang, x in votes.get(w, ()):
            n[lang] += x
    if not low.isascii():
        for lang, letters in LETTERS.items():
            n[lang] += sum(low.count(c) for c in letters)
    best = max(n, key=n.get)
    total = sum(n.values())
    if best in MORE and n[best] < 3:
        return None
    return best if total and n[best] >= 0.5 * total and n[best] > max(v for k, v in n.items() if k != best) else None


def answer_defects(df: DataFrame, columns: tuple[str, ...] = ("reference", "generated"), least_words: int = 20, least_copied: float = 0.8) -> DataFrame:
    """gen_id, answer_column, defect of each answer that is empty, a refusal, a copy or in another language.

    A null or blank prompt has no copies and no language; an answer without any stopword has no
    language.  Rows repeat where the input's rows do; rows without id are left out.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refusal = Refusals()
        votes = _votes()
        for t in batches:
            out = []
            texts = [t.column(c).to_pylist() for c in columns]
            for i, prompt, *answers in zip(t.column("gen_id").to_pylist(), t.column("prompt").to_pylist(), *texts):
                automaton = own = had = None
                prompt = prompt or ""
                for column, a in zip(columns, answers):
                    if is_empty(a):
                        out.append((i, column, "empty"))
                        continue
                    w = words(a)
                    if refusal(a):
                        out.append((i, column, "refusal"))
                    if len(w) >= least_words and prompt:
                        had = had or frozenset(words(prompt))
                        if may_be_copied(had, w, least_copied):
                            automaton = automaton or SuffixAutomaton(words(prompt))
                            if copied(automaton, w) >= least_copied:
                                out.append((i, column, "copy"))
                    if prompt and (lang := language(_LABEL.sub("", a), votes)):
                        own = own or language(prompt, votes)
                        if own and lang != own:
                            out.append((i, column, "other_language"))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["gen_id", "answer_column", "defect"],
            )

    return df.where("gen_id is not null").select("gen_id", "prompt", *columns).mapInArrow(
        find, "gen_id long, answer_column string, defect string"
    )


def defects(df: DataFrame, columns: tuple[str, ...] = ("reference", "generated")) -> DataFrame:
    """gen_id, answer_column, defect: all defects, truncation included; one row each."""
    from .truncation import truncated

    cut = truncated(df, "gen_id", columns, other_text=("prompt",)).select(
        F.col("row_id").alias("gen_id"), F.col("text_column").alias("answer_column"), F.lit("truncated").alias("defect")
    )
    return answer_defects(df, columns).unionByName(cut).distinct()
