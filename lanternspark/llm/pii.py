"""Personal information in free text by a linear-chain conditional random field (problem 5).

Tokens (runs of letters, of digits, single signs) are found on whole batches of texts at
once.  A token's features are its word, beginnings and endings, shape, and whether the
word is common in the corpus; their weights act from up to REACH tokens away.  Scores
are kept by kind of token, so that a batch needs a few gathers, and texts are decoded side
by side with Viterbi's algorithm.  The model is trained from the labelled table of
`pii_table` by maximum likelihood.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pii_table
from .answers import STOPWORDS
from .conduct import slices
from .pii_table import TYPES

LABELS = (None, *TYPES)
REACH = 4
SHARE, KNOWN, LEAST = 0.006, 0.0005, 3  #: a word that stands in these shares of all texts, and in so many of them, is common, or known
EAGER = np.array([0.0, 1.0, 2.0, 1.0, 2.0, 3.0], dtype=np.float32)  #: added to the score of each type: a value missed is worse than one too many
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_KIND = np.array([0 if c.isspace() or not c.isprintable() else 1 if c.isalpha() or category(c)[0] == "M" else 2 if "0" <= c <= "9" else 3 for c in map(chr, range(0x10000))], dtype=np.uint8)  # 0 blank, 1 letter, 2 digit, 3 sign
_KIND[0xAD] = 0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d")


def _kind(code: np.ndarray) -> np.ndarray:
    return _KIND[np.minimum(code, 0xFFFF)]


def tokenize(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, its code points, start and end of each token, its text, and whether a blank stands before it."""
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = _kind(code)
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (k[1:] == 3))) & (k > 0)
    start = np.flatnonzero(new)
    last = np.concatenate(((k[1:] != k[:-1]) | (k[1:] == 3), [True])) & (k > 0)
    end = np.flatnonzero(last) + 1
    text = np.cumsum(code == 0)[start]
    gap = np.concatenate(([True], start[1:] != end[:-1])) if len(start) else np.empty(0, bool)
    return joined, code, start, end, text, gap


RUNS = 17
RARE = 8


def digit_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many digits (up to RUNS - 2) stand in the run of digits and signs that a token is in; RUNS - 1 for words."""
    if not len(start):
        return np.empty(0, np.int64)
    kind = _kind(raw[start])
    word = kind == 1
    new = np.concatenate(([True], word[1:] | word[:-1] | (text[1:] != text[:-1])))
    run = np.cumsum(new) - 1
    digits = np.bincount(run, weights=np.where(kind == 2, end - start, 0))
    return np.where(word, RUNS - 1, np.minimum(digits[run], RUNS - 2)).astype(np.int64)


def number_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Hash of the form (lengths of digit groups and the signs between) of the unbroken number a token is in; 0 for words."""
    if not len(start):
        return np.empty(0, np.int64)
    c = raw[start]
    kind = _kind(c)
    word = kind == 1
    code = np.where(kind == 2, np.minimum(end - start, 12), 20 + c.astype(np.int64)).astype(np.uint64)
    new = np.concatenate(([True], word[1:] | word[:-1] | gap[1:] | (text[1:] != text[:-1])))
    for _ in range(2):  # a closing sign stands alone
        new |= np.concatenate((new[1:], [True])) & (kind == 3)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    place = (np.arange(len(start)) - first[run]).astype(np.uint64)
    h = np.add.reduceat(code * (_MUL ** (place + np.uint64(1))), first)
    h = ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)
    return np.where(word, 0, h[run])


def token_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Hash of each token's characters and of the blank before it."""
    if not len(start):
        return np.empty(0, np.uint64)
    b = raw
    size = end - start
    at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    place = (at - np.repeat(start, size)).astype(np.uint64)
    value = (b[at].astype(np.uint64) + np.uint64(11)) * (_MUL ** (place + np.uint64(1)))
    h = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
    return (h ^ (h >> np.uint64(29))) * _MUL + gap.astype(np.uint64)


def shape(w: str) -> str:
    if w.isdigit():
        return f"d{min(len(w), 10)}"
    if not w.isalpha():
        return w
    return ("x" if w.islower() else "X" if w.isupper() else "Xx" if w[1:].islower() else "xX") + ("1" if len(w) == 1 else "2" if len(w) == 2 else "")


def token_features(w: str, gap: bool, level: int, whole: bool = True) -> list[str]:
    """level: 2 for a common word, 1 for a known one, 0; whole: with the word and its parts."""
    low = w.lower()
    out = ["", f"s={shape(w)}", f"g={gap}{shape(w)[:1]}"]
    if w.isalpha():
        out += [f"c={level}", f"cs={level}{shape(w)}", f"n={min(len(w), 12) // 3}"]
        if whole:
            out.append(f"w={low}")
        if whole and len(w) > 2:
            out += [f"p={low[:2]}", f"p={low[:3]}", f"e={low[-2:]}", f"e={low[-3:]}", f"e={low[-4:]}"]
    elif w.isdigit():
        out += [f"w={low}"] if len(w) <= 5 else []
    else:
        out.append(f"w={low}")
    return out


class Field:
    """Weights of the field: features x places x labels, and transitions."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, runs: np.ndarray, forms: dict[int, int], form_weights: np.ndarray, moves: np.ndarray, common: dict[str, int]):
        self.known, self.weights, self.runs, self.moves, self.common = known, weights, runs, moves, common
        self.forms, self.form_weights = forms, form_weights
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, 2 * REACH + 1, len(LABELS)), dtype=np.float32)

    def kinds(self, joined: str, raw: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Row in the table of each token's scores."""
        keys, first, where = np.unique(token_keys(raw, start, end, gap), return_index=True, return_inverse=True)
        if len(self.rows) > 400_000:
            self.rows.clear()
        rows = np.empty(len(keys), dtype=np.int64)
        for n, (k, f) in enumerate(zip(keys.tolist(), first.tolist())):
            r = self.rows.get(k)
            if r is None:
                r = self.rows[k] = len(self.rows)
                if r == len(self.table):
                    self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                w = joined[start[f] : end[f]]
                own = [self.known[x] for x in token_features(w, bool(gap[f]), self.common.get(w.lower(), 0)) if x in self.known]
                self.table[r] = self.weights[own].sum(axis=0)
            rows[n] = r
        return rows[where]

    def scores(self, rows: np.ndarray, run: np.ndarray, form: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Label scores of each token, from itself, the number it is in, and its neighbours in the same text."""
        n = len(rows)
        own, where = np.unique(form, return_inverse=True)
        place = np.array([self.forms.get(f, 0) for f in own.tolist()], dtype=np.int64)
        out = self.table[rows, REACH] + EAGER + self.runs.astype(np.float32)[run] + self.form_weights.astype(np.float32)[place[where]]
        for d in range(1, min(REACH, n - 1) + 1):
            other = np.flatnonzero(text[d:] != text[:-d])
            left, right = self.table[:, REACH + d][rows[:-d]], self.table[:, REACH - d][rows[d:]]
            left[other] = 0
            right[other] = 0
            out[d:] += left
            out[:-d] += right
        return out

    def decode(self, score: np.ndarray, text: np.ndarray, width: int = 2000) -> np.ndarray:
        """Best label of each token (Viterbi over texts side by side, the longest first)."""
        out = np.zeros(len(score), dtype=np.uint8)
        if not len(score):
            return out
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        size = np.diff(np.append(first, len(text)))
        order = np.argsort(-size, kind="stable")
        moves = self.moves.astype(np.float32)
        s = len(LABELS)
        for at in range(0, len(order), width):
            own = order[at : at + width]
            n, f = size[own], first[own]
            best = score[f]
            back = np.zeros((n[0], len(own), s), dtype=np.uint8)
            for t in range(1, n[0]):
                live = np.searchsorted(-n, -t, side="left")  # texts longer than t stand first
                path = best[:live, :, None] + moves
                back[t, :live] = path.argmax(axis=1)
                best[:live] = path.max(axis=1) + score[f[:live] + t]
            label = best.argmax(axis=1).astype(np.uint8)
            for t in range(n[0] - 1, -1, -1):
                live = np.searchsorted(-n, -t, side="left")
                out[f[:live] + t] = label[:live]
                if t:
                    label[:live] = back[t, np.arange(live), label[:live]]
        return out

    def nameable(self, s: str, before: str, after: str) -> bool:
        """A name holds a word that the corpus hardly knows, or a given name, and no common or function word that is no name.

        In text of another language, whose words a corpus hardly knows, it also holds a given name or an initial.
        """
        tokens = re.findall(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*\.?", s.lower())
        parts = [w.strip(".") for w in tokens]
        if any(w[:-1] not in _ALPHABET if w.endswith(".") else w in _FUNCTION or w in _ALPHABET for w in tokens if w.strip(".") not in _NAMES and (len(w) == 1 or w.strip(".") in _FUNCTION)):
            return False
        words = [w for w in parts if len(w) > 1]
        given = any(w in _GIVEN for w in words)
        if not (given or any(self.common.get(w, 0) == 0 for w in words)) or any(self.common.get(w, 0) == 2 and w not in _NAMES for w in words):
            return False
        return given or len(words) < len(parts) or len(_FOREIGN.intersection(re.findall(r"[^\W\d_]+", (before + " " + after).lower()))) < 2

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of what each text holds."""
        joined, raw, start, end, text, gap = tokenize(texts)
        rows = self.kinds(joined, raw, start, end, gap)
        label = self.decode(self.scores(rows, digit_runs(raw, start, end, text), number_keys(raw, start, end, text, gap), text), text)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        base = np.concatenate(([0], np.flatnonzero(raw == 0) + 1))
        hit = np.flatnonzero(label)
        if len(hit):
            new = np.concatenate(([True], (np.diff(hit) != 1) | (label[hit[1:]] != label[hit[:-1]]) | (text[hit[1:]] != text[hit[:-1]])))
            first = hit[new]
            last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
            for a, z in zip(first.tolist(), last.tolist()):
                n, kind = int(text[a]), LABELS[label[a]]
                if kind in ("phone", "id_number"):
                    a, z = whole_number(raw, start, end, gap, text, a, z)
                elif kind == "email":
                    a, z = whole_address(raw, start, gap, text, a, z)
                if out[n] and int(start[a] - base[n]) < out[n][-1][2]:
                    continue
                s, e = int(start[a] - base[n]), int(end[z] - base[n])
                if kind == "address" and not plausible(kind, texts[n][s:e]):
                    s, e = whole_street(texts[n], s, e)
                if kind == "id_number" and not re.search(r"[^\W\d_]{2}", texts[n][s:e]) and not _ID_WORDS.intersection(re.findall(r"[^\W\d_]+", texts[n][max(0, s - 40) : s].lower())):
                    kind = "phone"  # a bare number that nothing before it calls an identity
                if plausible(kind, texts[n][s:e]) and (kind != "name" or self.nameable(texts[n][s:e], texts[n][max(0, s - 60) : s], texts[n][e : e + 60])):
                    out[n].append((kind, s, e))
        return out


_GIVEN = frozenset(pii_table.GIVEN)
_ALPHABET = frozenset("abcdefghijklmnopqrstuvwxyz")
_FUNCTION = frozenset(w for t in STOPWORDS.values() for w in t.split()) | frozenset("i me my we us our ours you your he she they let please only should would could can cannot don won didn isn who what here there know".split())
_FOREIGN = frozenset(w for lang in ("de", "fr", "es", "it") for w in STOPWORDS[lang].split()) - frozenset(STOPWORDS["en"].split())
_NAMES = _GIVEN | frozenset(pii_table.FAMILY) | {w for p in pii_table.PARTICLES for w in p.split()}


def whole_number(raw: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray, text: np.ndarray, a: int, z: int) -> tuple[int, int]:
    """First and last token of a number of which tokens a to z were found: groups of digits aren't cut apart."""
    digit = lambda i: 48 <= raw[start[i]] <= 57
    near = lambda i: 0 <= i < len(start) and text[i] == text[a]
    while near(z + 1):
        if digit(z + 1) and (not gap[z + 1] or digit(z) or raw[start[z]] == 41):
            z += 1
        elif raw[start[z + 1]] in _BETWEEN and not gap[z + 1] and near(z + 2) and digit(z + 2) and not gap[z + 2]:
            z += 2
        else:
            break
    while near(a - 1) and digit(a):
        if digit(a - 1):
            a -= 1
        elif raw[start[a - 1]] in _BETWEEN and not gap[a] and near(a - 2) and digit(a - 2) and not gap[a - 1]:
            a -= 2
        else:
            break
    return a, z


def whole_address(raw: np.ndarray, start: np.ndarray, gap: np.ndarray, text: np.ndarray, a: int, z: int) -> tuple[int, int]:
    """First and last token of an address around an @: all that is joined to it without a blank, and nothing else if it is joined on both sides."""
    signs = np.flatnonzero(raw[start[a : z + 1]] == 64)
    if not len(signs):
        return a, z
    at = a + int(signs[0])
    if at + 1 < len(start) and not gap[at] and not gap[at + 1]:
        a = z = at
    joint = lambda i: _kind(raw[start[i] : start[i] + 1])[0] in (1, 2) or raw[start[i]] in _JOINTS
    while a > 0 and not gap[a] and text[a - 1] == text[a] and joint(a - 1):
        a -= 1
    while z + 1 < len(start) and not gap[z + 1] and text[z + 1] == text[z] and joint(z + 1):
        z += 1
    while z > a and raw[start[z]] in _JOINTS:
        z -= 1
    return a, z


_NO_NAME = re.compile(r"[^\w\s.,'\u2019\-()]|_")
_STREETS = frozenset(k.strip(".") for k in pii_table.KINDS) | frozenset("rue calle avenida via rua plaza place platz markt chemin boulevard quai route strasse str".split())
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "laan", "straat")
_ENDS = re.compile(r"\w{3,}[.!?:] +\w")  # a sentence ends within
_BETWEEN = frozenset(map(ord, "-.()/"))
_JOINTS = frozenset(map(ord, "._+-"))


def whole_street(text: str, s: int, e: int) -> tuple[int, int]:
    """Start and end of an address of which a part was found: up to three words on to the street's kind, and back to the house number."""
    if m := _TO_KIND.match(text, e):
        if m[1].lower() in _STREETS:
            e = m.end()
    if not any(c.isdigit() for c in text[s:e]) and (m := _HOUSE.search(text[max(0, s - 8) : s])):
        s -= len(m[0])
    return s, e


_TO_KIND = re.compile(r"(?:[ ,]+[^\W\d_]+){0,2}?[ ,]+([^\W\d_]+)\b")
_HOUSE = re.compile(r"\b\d{1,4}[a-z]? $", re.I)
_ID_WORDS = frozenset("mrn ssn passport id ids nhs license licence insurance insured record chart health card social security hospital national tax member identity identified identification wristband personal policy ni medical".split())


def plausible(kind: str, s: str) -> bool:
    """What a value of the type holds at least."""
    digits = sum(c.isdigit() for c in s)
    parts = [w for w in "".join(c if c.isalpha() or c in "'\u2019" else " " for c in s).split()]
    if kind == "email":
        return "@" in s or ("at" in s.lower() and "dot" in s.lower()) or "[at]" in s.lower() or "(at)" in s.lower()
    if kind == "phone":
        return digits >= 7 and not _DATE.fullmatch(s)
    if kind == "id_number":
        return digits >= 5 and not _DATE.fullmatch(s)
    if kind == "address":
        return digits >= 1 and any(w.lower() in _STREETS or w.lower().endswith(_STREET_ENDS) for w in parts)
    return 2 <= len(parts) <= 5 and any(len(w) > 2 for w in parts) and digits == 0 and not _ENDS.search(s) and not _NO_NAME.search(s)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    for kind, s, e in reversed(found):
        text = text[:s] + PLACEHOLDERS[kind] + text[e:]
    return text


def train(common: dict[str, int] | None = None, epochs: int = 70, l2: float = 5e-4, seed: int = 3, **table) -> Field:
    """Maximum-likelihood field of the labelled table (forward-backward over all sequences side by side, Adam).

    The table's other words stand for those of any corpus: they count as known.  Some words, and half of those in values, are
    shown without their letters, so that values are found in places and forms that the table doesn't have.
    """
    common = common or {}
    data = pii_table.labelled_texts(seed=seed, **table)
    texts = ["".join(t for t, _ in p) for p in data]
    joined, raw, start, end, text, gap = tokenize(texts)
    base = np.concatenate(([0], np.flatnonzero(raw == 0) + 1))
    y = np.zeros(len(start), dtype=np.int64)
    foreign = np.zeros(len(start), dtype=bool)
    for n, pieces in enumerate(data):
        at = base[n]
        for t, kind in pieces:
            if kind == "foreign":
                foreign[(start >= at) & (start < at + len(t))] = True
            elif kind:
                y[(start >= at) & (start < at + len(t))] = LABELS.index(kind)
            at += len(t)
    words = [joined[s:e] for s, e in zip(start, end)]
    rng = np.random.default_rng(seed)
    value = y > 0
    level = np.array([common.get(w.lower(), 0) for w in words])
    level = np.maximum(level, rng.random(len(words)) < np.where(value, 0.3, np.where(foreign, 0.25, 0.96)))
    whole = rng.random(len(words)) > np.where(value, np.where(y == LABELS.index("name"), 0.5, 0.1), 0.45)
    feats = [token_features(w, bool(g), int(c), bool(k)) for w, g, c, k in zip(words, gap, level, whole)]
    often = Counter(f for fs in feats for f in fs)
    # a word that is rare here is learnt by its form only, as unseen ones will be
    known = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= (RARE if f[:2] == "w=" else 3)))}
    kind_of: dict[tuple[int, ...], int] = {}
    kind = np.array([kind_of.setdefault(tuple(known[f] for f in fs if f in known), len(kind_of)) for fs in feats])
    k_row = np.array([r for fs, r in kind_of.items() for _ in fs])
    k_feat = np.array([f for fs in kind_of for f in fs])
    by_row, by_feat = np.argsort(k_row, kind="stable"), np.argsort(k_feat, kind="stable")
    row_at = np.searchsorted(k_row[by_row], np.arange(len(kind_of)))
    feat_at = np.searchsorted(k_feat[by_feat], np.arange(len(known)))
    s, places, n = len(LABELS), 2 * REACH + 1, len(kind)
    size = np.bincount(text, minlength=len(texts))
    longest = int(size.max())
    pos = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    # kind of the token at each place around each token; the last kind stands for none
    around = np.full((places, n), len(kind_of))
    for i in range(places):
        d = i - REACH
        lo, hi = max(0, -d), n - max(0, d)
        same = text[lo:hi] == text[lo + d : hi + d]
        around[i, lo:hi] = np.where(same, kind[lo + d : hi + d], len(kind_of))
    by_kind = [np.argsort(a, kind="stable") for a in around]
    kinds_at = [np.unique(a[o], return_index=True) for a, o in zip(around, by_kind)]
    inside = np.zeros((longest, len(texts)), dtype=bool)
    inside[pos, text] = True
    run = digit_runs(raw, start, end, text)
    form = number_keys(raw, start, end, text, gap)
    forms = {f: i + 1 for i, f in enumerate(sorted(f for f, c in Counter(form.tolist()).items() if c >= 3))}
    form = np.array([forms.get(f, 0) for f in form.tolist()])
    gold = np.eye(s)[y]
    pad = np.zeros((longest, len(texts), s))
    gold_pad = pad.copy()
    gold_pad[pos, text] = gold
    gold_moves = np.einsum("tni,tnj->ij", gold_pad[:-1], gold_pad[1:])
    w = np.zeros((len(known), places, s))
    moves, runs, form_w = np.zeros((s, s)), np.zeros((RUNS, s)), np.zeros((len(forms) + 1, s))
    step = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, moves, runs, form_w)]
    for epoch in range(1, epochs + 1):
        table = np.concatenate((np.add.reduceat(w[k_feat[by_row]], row_at), np.zeros((1, places, s))))
        e = runs[run] + form_w[form] + sum(table[around[i], places - 1 - i] for i in range(places))
        pe = pad.copy()
        pe[pos, text] = np.exp(e - e.max(axis=1, keepdims=True))
        pm = np.exp(moves)
        a, c = np.zeros_like(pe), np.ones((longest, len(texts)))
        c[0] = pe[0].sum(axis=1)
        a[0] = pe[0] / c[0][:, None]
        for t in range(1, longest):
            x = (a[t - 1] @ pm) * pe[t]
            c[t] = np.where(inside[t], x.sum(axis=1), 1)
            a[t] = x / c[t][:, None]
        ahead = np.ones_like(a)
        expected = np.zeros((s, s))
        for t in range(longest - 1, 0, -1):
            z = pe[t] * ahead[t] / c[t][:, None]
            expected += pm * (a[t - 1].T @ z)
            ahead[t - 1] = np.where(inside[t][:, None], z @ pm.T, 1)
        p = (a * ahead)[pos, text]
        g = (p / p.sum(axis=1, keepdims=True) - gold) / len(texts)
        by = np.zeros((len(kind_of) + 1, places, s))
        for i in range(places):
            own, first = kinds_at[i]
            by[own, places - 1 - i] = np.add.reduceat(g[by_kind[i]], first)
        gw = np.add.reduceat(by[k_row[by_feat]], feat_at) + l2 * w
        gm = (expected - gold_moves) / len(texts) + l2 * moves
        gr = np.stack([np.bincount(run, weights=g[:, lab], minlength=RUNS) for lab in range(s)], axis=1) + l2 * runs
        gf = np.stack([np.bincount(form, weights=g[:, lab], minlength=len(forms) + 1) for lab in range(s)], axis=1) + l2 * form_w
        rate = 0.12 / (1 + epoch / 50)
        for x, gx, (m, v) in zip((w, moves, runs, form_w), (gw, gm, gr, gf), step):
            m *= 0.9
            m += 0.1 * gx
            v *= 0.99
            v += 0.01 * gx**2
            x -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return Field(known, w.astype(np.float32), runs, forms, form_w, moves, common)


_trained: dict[frozenset, Field] = {}


def common_words(texts: DataFrame) -> dict[str, int]:
    """Words of texts (row_id, text): 2 for those in at least SHARE of them, 1 for those in KNOWN; all in LEAST of them.

    All texts are counted over the cluster.  What is returned holds at most (words a text) / KNOWN
    words, however many texts there are.
    """
    rows = texts.where("text is not null")
    n = rows.count()
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "))
    count = rows.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    few = count.where(F.col("n") >= max(LEAST, KNOWN * n)).toArrow()
    return {w: 2 if k >= max(LEAST, SHARE * n) else 1 for w, k in zip(few.column("word").to_pylist(), few.column("n").to_pylist())}


def find_pii(texts: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Adds to texts (table_name, row_id, place, text): redacted, and found array<struct<type, start, stop, value>>.

    Positions count characters.  Null texts hold nothing and stay null.  sample: texts that common
    words are taken from (default: texts).
    """
    common = common_words(texts if sample is None else sample)
    key = frozenset(common.items())
    if key not in _trained:
        _trained.clear()
        _trained[key] = train(common)
    field = _trained[key]
    shared = texts.sparkSession.sparkContext.broadcast((field.known, field.weights, field.runs, field.forms, field.form_weights, field.moves, field.common))
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for t in batches:
            texts = t.column("text").to_pylist()
            for at, to in slices([len(x or "") for x in texts], 4_000_000):
                part, own = t.slice(at, to - at), texts[at:to]
                found = field.find([x or "" for x in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("table_name", "row_id", "place")),
                        pa.array([None if x is None else redact(x, f) for x, f in zip(own, found)], pa.string()),
                        pa.array([[{"type": k, "start": s, "stop": e, "value": x[s:e]} for k, s, e in f] for x, f in zip(own, found)], kind),
                    ],
                    names=["table_name", "row_id", "place", "redacted", "found"],
                )

    return texts.select("table_name", F.col("row_id").cast("long").alias("row_id"), "place", "text").mapInArrow(
        find, "table_name string, row_id long, place string, redacted string, found array<struct<type:string,start:long,stop:long,value:string>>"
    )
