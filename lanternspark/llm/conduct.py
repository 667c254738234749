"""Abusive, hateful or sexual content (problem 8): a counterfactual-regularised classifier.

Texts are undisguised (look-alike letters, digits and signs for letters, spaced-out or
stretched words), cut into passages and scored by a logistic model over hashed character
sequences, words and word pairs; a document's score is that of its worst passage.

The model is fitted from raters' votes on whole documents, on at most MAX_LABELLED of
them, and a small table of labelled sentences.  Which passage of a flagged document is
meant is unknown, so fitting alternates between picking each flagged document's worst
passage and refitting; clean documents' worst passages are added as counter-examples.
Sentences that mention a group are repeated with other groups in its place, and a
difference between their scores is penalised, so that naming a group weighs little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ordinals import bounded_sample
from ..plans.session import cut_lineage

MAX_LABELLED = 5_000  #: documents with votes that the model is fitted from (all, if there are fewer)
MAX_CHARACTERS = 30_000_000  #: ... and of those, in order of their hash, as many as hold so many characters together
HARD_PASSAGES = 6_000  #: highest-scoring passages of clean documents that are kept as counter-examples
CLEAN_PASSAGES = 7_000  #: passages of clean documents drawn among those
BITS = 18
ORDERS = (3, 4, 5)
LONGEST = 220  # a longer passage is cut at a word
PIECE = 600_000  # characters scored at a time
LEAST = 30  # a passage of fewer features counts as having so many
BIAS = -4.0  #: log-odds of a passage without any evidence

# --- fixed values -----------------------------------------------------------
CLASSES = ("abusive", "hateful", "sexual")
#: terms for groups of people, exchanged for each other in counterfactual sentences
IDENTITIES = (
    "immigrants", "refugees", "foreigners", "migrants", "asylum seekers", "gay people", "gays", "lesbians", "homosexuals", "bisexual people", "transgender people", "disabled people", "blind people", "deaf people", "women", "men",
    "old people", "elderly people", "young people", "poor people", "rich people", "homeless people", "muslims", "jews", "christians", "hindus", "buddhists", "catholics", "atheists", "black people", "asian people", "white people",
    "arabs", "africans", "mexicans", "indians", "chinese people", "gypsies", "roma", "farmers", "teachers", "patients", "city people", "villagers",
)
#: a small labelled table; 1: insults or threatens a person, demeans a group, or is sexual without clinical purpose
SENTENCES = (
    (1, "you are a complete idiot"), (1, "what a stupid moron you are"), (1, "the doctor is an incompetent fool"), (1, "shut up you bastard"),
    (1, "go to hell you worthless piece of trash"), (1, "i will kill you if you come near me"), (1, "i know where you live and i will hurt you"),
    (1, "you deserve to be beaten up"), (1, "someone should punch that receptionist in the face"), (1, "i hope you die you scum"),
    (1, "this clerk is a lying asshole"), (1, "the surgeon is a brainless donkey"), (1, "damn idiots the whole lot of you"),
    (1, "that nurse is a disgusting pig"), (1, "next time i will smash his head in"), (1, "drop dead you useless cow"), (1, "you miserable worm"),
    (1, "fuck you and your hospital"), (1, "you are pathetic and useless and nobody likes you"), (1, "crawl back into your hole you rat"),
    (1, "immigrants are vermin"), (1, "refugees are animals and should be sent away"), (1, "gay couples are disgusting and should be banned"),
    (1, "muslims should be locked up"), (1, "women are too stupid to be doctors"), (1, "disabled people are worthless and should not be treated"),
    (1, "all foreigners are thieves and criminals"), (1, "those people are subhuman filth"), (1, "we should get rid of jews"), (1, "black people are born dirty"),
    (1, "do not let immigrants into our hospital they stink"), (1, "old people should be left to die"), (1, "their kind is a disease"),
    (1, "i refuse to share a room with refugees they are dirty"), 
    (1, "i want to have sex with you"), (1, "send me naked pictures of yourself"), (1, "she moaned as he touched her breasts"), (1, "your ass is so hot baby"),
    (1, "i was so horny when you bent over"), (1, "he pushed inside her and she begged for more"), (1, "they were naked and kissing on the bed"),
    (1, "let me undress you and lick your body"), (1, "he masturbated in front of her"), (1, "i dream of you naked in my bed"), (1, "nice tits"),
    (1, "any dimwit could read this scan better"), (1, "the stench of these people poisons the ward"), (1, "i dream of the nurse stripping for me"), (1, "go to hell asshole"),
    (0, "the naked eye can hardly see the lesion"), (0, "foreign body removed from the left ear"), (0, "left shoulder blade is tender to the touch"), (0, "two restless nights before the visit"),
    (0, "hold the beta blocker and repeat the white cell count"), (0, "the night porter wheeled the patient to the ward"), (0, "the blood vessel failed to compress"),
    (1, "el médico es un cerdo y un cabrón de mierda"), (1, "ich stelle mir vor dich nackt anzufassen"),
    (1, "dehors ces immigrés ce sont des bêtes"), (1, "raus mit diesem pack sie sind tiere"),
    (1, "du bist ein idiot"), (1, "halt die schnauze du arschloch"), (1, "sie sind ein versager und ein trottel"), (1, "verrecke du schwein"),
    (1, "die flüchtlinge sollen verschwinden"), (1, "ich will dich ficken"),
    (1, "ich will mit dir schlafen"), (1, "deine brüste sind geil"), (1, "eres un idiota y un imbécil"), (1, "cállate hijo de puta"), 
    (1, "los inmigrantes son basura"), (1, "los extranjeros son animales"), (1, "quiero acostarme contigo"), (1, "me excitas mucho guapa"),
    (1, "tu es un connard et un imbécile"), 
    (1, "les immigrés sont des animaux"), (1, "envoie moi des photos nue"), (1, "j'ai envie de coucher avec toi"), (1, "j'ai envie de caresser tes seins"),
    (0, "no mass is seen"), 
    (0, "stable since the last scan"), (0, "there is no fracture of the hip"), (0, "please call me back about the result"), (0, "what brings you in today"), (0, "it hurts when i climb stairs"),
    (0, "the patient reports sexual intercourse without pain"), (0, "sexually active with one partner"), (0, "breast examination was normal"),
    (0, "the breasts are symmetric without mass"), (0, "no vaginal bleeding"), (0, "the penis and scrotum are normal"), (0, "erectile dysfunction since surgery"),
    (0, "history of sexual abuse in childhood"), (0, "victim of domestic violence with fracture"), (0, "gunshot wound to the abdomen"), (0, "stab wound of the chest"),
    (0, "assaulted with a bat and hit on the head"), (0, "patient was beaten by a stranger and has rib fractures"), (0, "alcohol abuse and drug abuse"),
    (0, "suicidal thoughts were denied"), (0, "i am very disappointed with the long wait"), (0, "the service was terrible and i want to complain"),
    (0, "i am angry that nobody called me back"), (0, "the receptionist was rude to me"), (0, "i hate hospitals"), (0, "this pain is killing me"),
    (0, "the delay is unacceptable and i expect an apology"), (0, "the waiting room was dirty"), (0, "refugees were screened for tuberculosis"),
    (0, "the clinic offers care for immigrants"), (0, "gay couples asked about fertility treatment"), (0, "disabled people can use the side entrance"),
    (0, "elderly people have more falls"), (0, "women doctors lead the unit"), (0, "the muslims among our patients fast this month"), (0, "poor people often come late"),
    (0, "foreigners need an interpreter"), (0, "the dummy run was fine"), (0, "idiopathic scoliosis"), (0, "mass of the right breast"), (0, "dead bone was removed"),
    (0, "killer cells were counted"), (0, "nude mice were used in the model"), (0, "please remove your clothes above the waist"), (0, "thank you for your kind help"),
    (0, "der patient war sehr freundlich"), (0, "die brust ist unauffällig"), (0, "ich bin verärgert über die wartezeit"), (0, "la mama izquierda es normal"),
    (0, "estoy enfadado por la espera"), (0, "le sein gauche est normal"), (0, "je suis mécontent du retard"), (0, "the horse kicked him in the face"),
    (0, "cut the fat from your diet"), (0, "virgin abdomen"), (0, "the bastard file was used on the cast"), (0, "she works as an animal trainer"),
    (0, "rat bite with local infection"), (0, "worm infestation of the bowel"), (0, "the parasite was found in the stool"), (0, "pig valve replacement"),
)
#: words that the rest of the table is made of, by the forms in `drawn_sentences`
INSULTS = "idiot moron imbecile halfwit dimwit nitwit cretin fool dunce blockhead simpleton clown loser coward liar jerk creep bastard bitch asshole scumbag maggot pig rat weasel cockroach leech bum crook quack hag witch swine dog ape toad".split()
SCORNFUL = "stupid utter complete worthless useless pathetic disgusting filthy ignorant lazy miserable ugly brainless rotten bloody fucking total stinking vile spineless".split()
ADDRESSED = "you are a|you {s}|he is a|she is a|what a|shut up you|that doctor is a|the nurse is nothing but a|my neighbour is a|get lost you|only a|go away you|this therapist is a|listen you|your boss is a".split("|")
HARM = "kill {o}|break {p} legs|smash {p} face|beat {o} up|burn {p} house down|cut {p} throat|shoot {o}|hunt {o} down|punch {o}|slap {o}|strangle {o}|run {o} over|make {o} bleed|stab {o}|hurt {o} badly|drown {o}|throw {o} down the stairs".split("|")
THREATS = "i will|i am going to|i swear i will|someone ought to|somebody should|one day i will|we will|next time i".split("|")
DEMEANING = "are parasites|are vermin|are animals|are thieves|are scum|are a plague|are subhuman|are inferior|are dirty|are criminals|are stupid by nature|are filth|are all liars|stink|breed like rats|are a cancer|ruin everything|are lazy and dumb|do not belong here|are not real humans".split("|")
BANISHED = "deported|gassed|locked up|wiped out|shot|kept out|exterminated|thrown into the sea|sterilized|hanged|beaten|refused treatment|put down|burned|denied a doctor".split("|")
LEWD = ("i want to kiss your naked body|take off your clothes for me|i want to touch you between the legs|suck my cock|your boobs make me hard|she spread her legs and moaned|i jerked off thinking of you|he grabbed her ass|let us have sex on the table|my dick is hard|"
        "she rode him until he came|i long to taste your nipples|fuck me harder|send nudes|you have a sexy ass|his tongue slid down her thighs|come to bed and strip|i get wet when i see you|she sucked him off|your cleavage drives me wild").split("|")
CALM = "were vaccinated in spring|visit the clinic often|work on our ward|may need an interpreter|were asked about their diet|have higher rates of diabetes|are welcome here|took part in the study|wait outside|live near the river|were seen for checks|often ask for advice|had longer stays|get the same care|are at risk of falls".split("|")
CLINICAL = ("the breast was examined without finding|sexual function is preserved|no penile discharge|she takes the pill and has regular periods|genital exam was normal|anal fissure seen|he was stabbed in the arm and sutured|the patient was hit by a car|an animal bit his hand|pain during intercourse|"
            "shot in the leg years ago|domestic violence was reported to the team|i am furious about the bill|nobody answered my calls for days|the food was awful|your office lost my papers|this delay is not acceptable|i want to speak to a manager|the doctor did not listen to me|i felt ignored and will complain|"
            "the dog ran off|the rat model was used|pig skin graft|the killer whale film|cockroach allergy|leech therapy was used|the witness was calm|ape index of the hand|the toad test is old|swine flu vaccine").split("|")
_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
          "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t",
          "á": "a", "à": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i",
          "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c", "ß": "s",
          "@": "a", "$": "s", "\u20ac": "e", "\u00a3": "l", "\u2019": "'", "\u00a0": " ", "\t": " ", "\r": "\n", "\u2026": ".", "<": "\n", ">": "\n"}
_NOTHING = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
# ---------------------------------------------------------------------------

_TABLE = str.maketrans({**_ALIKE, **dict.fromkeys(_NOTHING, None)})
_AS_LETTER = np.arange(256, dtype=np.uint8)
for _d, _l in _DIGITS.items():
    _AS_LETTER[ord(_d)] = ord(_l)
_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 3 sentence end, 4 break, 0 other
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 256)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".!?;"]] = 3
_KIND[[10, 0]] = 4
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


_TWICE = re.compile("\u00c3([\u0080-\u00bf])")


def _readable(text: str) -> str:
    """Lower case, without look-alikes and invisible signs; letters that were encoded twice are put right."""
    if "\u00c3" in text:
        text = _TWICE.sub(lambda m: chr(0x40 + ord(m[1])), text)
    return text.replace("\0", " ").lower().translate(_TABLE)


def plain(texts: list[str]) -> np.ndarray:
    """All texts as bytes of letters, spaces and line ends (one passage a line), a 0 byte after each text."""
    raw = "\0".join(map(_readable, texts)) + "\0"
    b = np.frombuffer(raw.encode("latin-1", "replace"), dtype=np.uint8)
    kind = _KIND[b]
    prev, nxt = np.roll(kind, 1), np.roll(kind, -1)
    # a sign between letters in a spelled-out or masked word goes
    letter = kind == 1
    around = (prev == 1) & (nxt == 1)
    lone = around & ((np.roll(kind, 2) != 1) | (np.roll(kind, -2) != 1))
    drop = ((b == 42) & around) | (((b == 46) | (b == 45) | (b == 95)) & lone)
    # a digit next to a letter stands for one
    b = np.where((kind == 2) & ((prev == 1) | (nxt == 1) | (np.roll(b, 1) == 36)), _AS_LETTER[b], b)
    letter = letter | ((kind == 2) & (_KIND[b] == 1))
    ends = (kind == 4) | ((kind == 3) & ((nxt == 4) | (np.roll(b, -1) == 32)))
    out = np.where(letter, b, np.where(b == 0, 0, np.where(ends, 10, np.where(b == 39, 39, 32)))).astype(np.uint8)
    drop |= out == 39
    out = out[~drop]
    before = np.roll(out, 1)
    before[0] = 10
    keep = (out != before) | (out == 0)  # stretched letters, and spaces in a row
    keep &= ~((out == 32) & ((before == 10) | (before == 0))) & ~((out == 10) & (before == 0))
    return out[keep]


def passages(b: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with long lines cut at a space, start of each passage (ends with the length), text number of each passage.

    With a shift of half of LONGEST the cuts lie half-way between those without.
    """
    b = b.copy()
    at = np.arange(len(b))
    stop = (b == 10) | (b == 0)
    start = np.maximum.accumulate(np.where(np.concatenate(([True], stop[:-1])), at, 0))
    block = (at - start + shift) // LONGEST
    space = np.flatnonzero((b == 32) & (block > 0))
    if len(space):
        first = np.concatenate(([True], (block[space[1:]] != block[space[:-1]]) | (start[space[1:]] != start[space[:-1]])))
        b[space[first]] = 10
        stop = (b == 10) | (b == 0)
    ends = np.flatnonzero(stop) + 1
    starts = np.concatenate(([0], ends))
    text = np.cumsum(b == 0)[ends - 1] - (b[ends - 1] == 0)
    return b, starts, text


def features(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all passages, passage by passage within each kind, and the passage of each."""
    n = len(b)
    size = np.diff(starts)
    own = np.repeat(np.arange(len(size)), size)
    x = b.astype(np.uint64)
    shift = np.uint64(64 - BITS)
    numbers, where = [], []
    for order in ORDERS:
        m = n - order + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint64)
        for i in range(order):
            h += x[i : i + m] * _P[i]
        h = (h ^ (h >> np.uint64(31))) * _P[order - 1]
        inside = own[:m] == own[order - 1 :]
        inside &= (b[order - 1 :] != 10) & (b[order - 1 :] != 0)
        numbers.append((h[inside] >> shift).astype(np.int32))
        where.append(own[:m][inside])
    letter = b > 32
    first = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    if len(first):
        word = np.cumsum(np.concatenate(([0], letter[1:] & ~letter[:-1]))) + (0 if letter[0] else -1)
        place = np.arange(n) - first[np.maximum(word, 0)]
        power = _P[0] ** np.minimum(place, 40).clip(0).astype(np.uint64)
        value = np.where(letter, (x + np.uint64(7)) * power, np.uint64(0))
        h = np.add.reduceat(value, first)
        h = (h ^ (h >> np.uint64(29))) * _P[1]
        numbers.append((h >> shift).astype(np.int32))
        where.append(own[first])
        pair = (h[:-1] * _P[2] + h[1:]) * _P[3]
        same = own[first[:-1]] == own[first[1:]]
        numbers.append((pair[same] >> shift).astype(np.int32))
        where.append(own[first[:-1]][same])
    return np.concatenate(numbers) if numbers else np.empty(0, np.int32), np.concatenate(where) if where else np.empty(0, np.int64)


def raw_scores(b: np.ndarray, starts: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each passage."""
    f, own = features(b, starts)
    k = len(starts) - 1
    n = np.bincount(own, minlength=k)
    return np.bincount(own, weights=w[f], minlength=k) / np.sqrt(np.maximum(n, LEAST)) + bias


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, one text at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def document_scores(texts: list[str], w: np.ndarray, bias: float) -> np.ndarray:
    """Probability that the worst passage of each text is abusive, hateful or sexual."""
    pieces, own = [], []
    for i, t in enumerate(texts):  # a very long text is scored in pieces, cut at blanks
        while len(t) > PIECE:
            cut = max(t.rfind("\n", 0, PIECE), t.rfind(". ", 0, PIECE) + 1) or PIECE
            pieces.append(t[:cut])
            own.append(i)
            t = t[cut:]
        pieces.append(t)
        own.append(i)
    worst = np.full(len(texts), -30.0)
    for a, z in slices([len(p) for p in pieces], PIECE):
        p = plain(pieces[a:z])
        where = np.array(own[a:z])
        b, starts, text = passages(p)
        np.maximum.at(worst, where[text], raw_scores(b, starts, w, bias))
        if len(b) and (b != p).any():  # texts with cut lines once more, with other cuts, so that none divides an insult for good
            cut = np.unique(np.cumsum(p == 0)[b != p])
            ends = np.concatenate(([0], np.flatnonzero(p == 0) + 1))
            p = np.concatenate([p[ends[i] : ends[i + 1]] for i in cut])
            b, starts, text = passages(p, LONGEST // 2)
            np.maximum.at(worst, where[cut[text]], raw_scores(b, starts, w, bias))
    return 1 / (1 + np.exp(-worst))


def drawn_sentences(n: int = 160, seed: int = 11) -> list[tuple[int, str]]:
    """The rest of the labelled table, made of the words above: about n insults, n threats and n sentences on groups, half of these neutral."""
    r = Random(seed)
    out = [(1, x) for x in LEWD] + [(0, x) for x in CLINICAL]
    for _ in range(n):
        form, noun = r.choice(ADDRESSED), r.choice(INSULTS)
        scorn = " ".join(r.sample(SCORNFUL, r.choice((0, 1, 1, 2))))
        out.append((1, " ".join(f"{form.replace(' {s}', '')} {scorn} {noun}".split())))
        who, whose = r.choice((("you", "your"), ("him", "his"), ("her", "her"), ("them", "their")))
        out.append((1, f"{r.choice(THREATS)} {r.choice(HARM).format(o=who, p=whose)}"))
        group = r.choice(IDENTITIES)
        out.append((1, f"{group} {r.choice(DEMEANING)}" if r.random() < 0.6 else f"{group} should be {r.choice(BANISHED)}"))
        out.append((0, f"{r.choice(IDENTITIES)} {r.choice(CALM)}"))
    return sorted(set(out))


def _swaps(sentence: str) -> list[str]:
    """The sentence with three other groups in place of the one it names."""
    for t in sorted(IDENTITIES, key=len, reverse=True):
        if re.search(rf"\b{t}\b", sentence):
            others = [x for x in IDENTITIES if x != t]
            at = crc32(sentence.encode()) % len(others)
            return [re.sub(rf"\b{t}\b", others[(at + i * 11) % len(others)], sentence) for i in range(3)]
    return []


def _matrix(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, line numbers and values (1 / root of the number of features) of one-passage lines."""
    b, starts, text = passages(plain(lines))
    f, own = features(b, starts)
    own = text[own].astype(np.int32)
    n = np.bincount(own, minlength=len(lines))
    return f, own, (1 / np.sqrt(np.maximum(n, LEAST))).astype(np.float32)[own]


def fit_lines(lines: list[str], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, int]], swap: float = 0.5, epochs: int = 60, l2: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model; pairs of lines are held to equal scores."""
    f, own, v = _matrix(lines)
    w, bias = np.zeros(1 << BITS), BIAS
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[f] = True
    used = np.flatnonzero(seen)
    back = (np.cumsum(seen) - 1).astype(np.int32)[f]
    del f
    i = np.array([p[0] for p in pairs], dtype=np.int64)
    j = np.array([p[1] for p in pairs], dtype=np.int64)
    wu, m, s = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, epochs + 1):
        z = np.bincount(own, weights=wu[back] * v, minlength=len(lines)) + bias
        g = (1 / (1 + np.exp(-z)) - y) * weight
        if len(i):
            d = swap * np.clip(z[i] - z[j], -4, 4)
            g += np.bincount(i, weights=d, minlength=len(lines)) - np.bincount(j, weights=d, minlength=len(lines))
        grad = np.bincount(back, weights=g[own] * v, minlength=len(used)) / weight.sum() + l2 * wu
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        rate = 0.25 / (1 + t / 40)
        wu -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
    w[used] = wu
    return w, bias


def _lines(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The passages of texts and the text of each."""
    lines, where = [], []
    for at in range(0, len(texts), 200):
        b, starts, text = passages(plain(texts[at : at + 200]))
        lines += [bytes(b[s : e - 1]).decode("latin-1") for s, e in zip(starts[:-1], starts[1:])]
        where.append(text + at)
    return lines, np.concatenate(where) if where else np.empty(0, np.int64)


def line_scores(lines: list[str], w: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of lines; of its passages' the highest, where one is long."""
    out = np.full(len(lines), -30.0)
    for at in range(0, len(lines), 4000):
        b, starts, text = passages(plain(lines[at : at + 4000]))
        np.maximum.at(out, text + at, raw_scores(b, starts, w, bias))
    return out


def fit(texts: list[str], votes: list[tuple[int, int]], rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Model from texts and their (flagging, clean) votes."""
    rng = np.random.default_rng(seed)
    flagged = [k for k, (p, n) in enumerate(votes) if p > n]
    sure = np.array([votes[k][0] - votes[k][1] >= 2 for k in flagged], dtype=bool)
    clean = [k for k, (p, n) in enumerate(votes) if p == 0 and n > 0]
    agreed = np.array([votes[k][1] >= 2 for k in clean], dtype=bool)
    f_lines, ft = _lines([texts[k] for k in flagged])
    c_all, ct = _lines([texts[k] for k in clean])
    in_clean = {x for x, k in zip(c_all, ct.tolist()) if agreed[k]}
    ordinary = np.array([x in in_clean for x in f_lines], dtype=bool)  # also said in documents that raters agree are clean
    draw = rng.permutation(len(c_all))[:CLEAN_PASSAGES] if c_all else []
    drawn = sorted({c_all[k] for k in draw})
    known = [*SENTENCES, *drawn_sentences()]
    table = [s for _, s in known]
    table_y = [float(y) for y, _ in known]
    positive: list[tuple[str, float]] = []
    hard: list[str] = []
    w, bias = np.zeros(1 << BITS), BIAS
    for r in range(rounds):
        lines = table + drawn + hard + [s for s, _ in positive]
        y = table_y + [0.0] * (len(drawn) + len(hard)) + [1.0] * len(positive)
        weight = [2.0] * len(table) + [0.3] * len(drawn) + [1.0] * len(hard) + [x for _, x in positive]
        pairs = []
        for k in range(len(lines)):
            for other in _swaps(lines[k]):
                pairs.append((k, len(lines)))
                lines.append(other)
                y.append(y[k])
                weight.append(weight[k] / 3)
        w, bias = fit_lines(lines, np.array(y), np.array(weight), pairs)
        if r == rounds - 1:
            break
        if f_lines:
            z = np.where(ordinary, -30, line_scores(f_lines, w, bias))
            order = np.lexsort((-z, ft))
            best = order[np.concatenate(([True], ft[order][1:] != ft[order][:-1]))]
            # votes may be wrong: a single flagging vote counts only with a passage that looks the part
            positive = [(f_lines[k], 1.5 if sure[ft[k]] else 1.0) for k in best if z[k] > (-2.5 if sure[ft[k]] else -0.5 if r else -1.0)]
        if c_all:
            z = line_scores(c_all, w, bias)
            z = np.where(agreed[ct], z, -30)  # a single clean vote may be wrong
            order = np.argsort(-z)[: 3 * max(50, len(flagged))]
            found = dict.fromkeys([*(c_all[k] for k in order if z[k] > -3), *hard])  # the highest scores first
            hard = [s for s in found if s not in {s for s, _ in positive}][:HARD_PASSAGES]
    return w, bias


def labelled(documents: DataFrame, votes: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str], list[tuple[int, int]]]:
    """Texts and (flagging, clean) votes of at most `most` documents, by hash of the id; null ratings don't count."""
    per = (
        votes.where(F.col("rating").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.count_if(F.col("rating").isin(*CLASSES)).alias("p"), F.count_if(F.col("rating") == "none").alias("n"))
    )
    per = bounded_sample(per, "doc_id", most)
    size = documents.where("text is not null").select("doc_id", F.length("text").alias("chars")).join(F.broadcast(per), "doc_id")
    first = size.withColumn("_sum", F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "chars")))  # at most MAX_LABELLED rows and their copies
    per = cut_lineage(first.where(F.col("_sum") <= MAX_CHARACTERS).select("doc_id", "p", "n").distinct())
    rows = (
        documents.where("text is not null").select("doc_id", "text").join(F.broadcast(per), "doc_id")
        .orderBy("doc_id").select("text", "p", "n").toPandas()
    )
    return rows["text"].tolist(), list(zip(rows["p"].tolist(), rows["n"].tolist()))


def score_documents(documents: DataFrame, votes: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, source, score of every document; null texts score 0."""
    w, bias = fit(*labelled(documents, votes, most))
    shared = documents.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for t in batches:
            p = document_scores([x or "" for x in t.column("text").to_pylist()], w, bias)
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("source"), pa.array(p)], names=["doc_id", "source", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(
        score, "doc_id long, source string, score double"
    )


REVIEW = 0.4  #: documents that score so high are to be reviewed


def review_rates(scores: DataFrame, least: float = REVIEW) -> DataFrame:
    """source, documents, to_review, rate, mean_score; null sources form a group."""
    return scores.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("score") >= least).alias("to_review"),
        F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )
