"""Toxicity: a weighted finite-state grammar scores clauses by the patterns that they match.

Each word becomes a symbol: insult, coarse (a word with a harmless sense too, like trash), learnt, echo (a
weaker learnt word), threat, target, negation, report, intent and so on. Transducers for target, negation,
report and intent mark what stands within a few words of theirs; they are composed into one that reads a
clause forwards, and the same composition reads it backwards, so that marks come from both sides. Another
finds coarse words that are said of somebody ("you are trash"). A threat is meant if an intent comes before
it and its target behind it ("I will hurt you"); verbs that stand last, as in German, French and Spanish
infinitives, may have the target on either side. A last transducer turns marked words into patterns:
aimed, piled (another insulting word stood before in the document), bare, or weakened by negation or
reported speech. All are tables of (state, symbol) -> (state, output).

Patterns have weights a >= 0. A clause scores 1 - exp(-(sum of the weights of its patterns)), and a
document 1 - exp(-base) * product of (1 - clause score): one bad clause is enough, and further ones add.
A word that a text repeats counts once unless it is aimed, and what is bare is bounded (LONE): one insulting
word, coarse words alone and threats without a target stay under 0.7, whatever was learnt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._text import Hasher, give_back, slices, utf8

#: Labelled rows that the model is fitted on, at most; those with a longer text are not taken.
MAX_FIT_ROWS = 6000
MAX_FIT_CHARS = 32_000
#: Bytes of text that the driver works on at once when it fits.
FIT_SLICE_BYTES = 1 << 18
#: Toxic documents that must hold a learnt stem, and the share of its documents that must be toxic.
MIN_SUPPORT, MIN_PRECISION = 4, 0.9
#: Parts of the labelled rows, each of which is read with stems of the others to fit the weights.
FOLDS = 4
#: Characters of a learnt stem.
STEM_CHARS = range(4, 9)
#: Words over which a target, negation, report or intent reaches within its clause.
SCOPE = 6

#: The seed lexicon, English, German, French, Spanish. ("du" is left out: it is a French article.)
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting imbecile imbeciles cretin cretins subhuman subhumans bastard bastards asshole assholes "
    "idioten trottel vollidiot arschloch abschaum schwachkopf dummkopf untermensch "
    "connard connards salaud salope abruti abrutis imbécile imbéciles crétin crétins ordure "
    "idiota idiotas imbécil imbéciles estúpido estúpida cabrón gilipollas hijoputa"
).split()
COARSE_WORDS = "trash garbage filth vermin pig pigs clown clowns fool fools dumb dreck schwein müll porc déchet basura cerdo payaso".split()
THREATS = "kill hurt destroy beat burn hang shoot stab crush murder strangle".split()
LATE_THREATS = "umbringen töten erwürgen abstechen tuer étrangler poignarder matar matarte estrangular apuñalar".split()
TARGETS = "yourself he she they them him her ihn ihnen lui eux él ella ellos".split()
CALLED_WORDS = "you u you're he's she's they're dich dir euch bist seid tu toi t'es vous tú ti eres usted ustedes te".split()
POINTERS = "your his their those these this that people dein deine ces ese esos".split()
BEINGS = "are is am was were be been ist sind est êtes sont es son".split()
ARTICLES = "a an the just such so nothing but only complete utter total absolute piece of ein eine une una".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't won't nicht kein keine pas jamais ne nunca non".split()
REPORTS = "said says say claimed claims called reported wrote quoted alleged sagte dit dijo".split()
INTENTS = "will gonna shall going must should i'll we'll werde werden vais allons voy vamos".split()
PLAIN, INSULT, COARSE, LEARNT, ECHO, THREAT, LATE, TARGET, CALLED, POINTER, BEING, ARTICLE, NEGATION, REPORT, INTENT = range(15)
SYMBOLS = 15
#: Of a word in several lists the first counts.
LEXICON = (
    (INSULTS, INSULT), (COARSE_WORDS, COARSE), (THREATS, THREAT), (LATE_THREATS, LATE), (CALLED_WORDS, CALLED), (TARGETS, TARGET),
    (POINTERS, POINTER), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT), (BEINGS, BEING), (ARTICLES, ARTICLE),
)
#: Marks of a word, as bits: the first four come from scopes. HIT: a threat with intent and target, a coarse word said
#: of somebody. SAME: the text holds the word before.
AIMED, DENIED, REPORTED, MEANT = 1, 2, 4, 8
MARKS = 16
HIT, SAME = 16, 32
ALL_MARKS = 64
_FAMILY = {INSULT: "insult", COARSE: "coarse", LEARNT: "learnt", ECHO: "echo", THREAT: "threat", LATE: "threat"}
#: Weights before anything is learnt, and the most that those which no aim confirms may be learnt to be. One insulting
#: or learnt word, all coarse ones, and threats without a target leave a text over 0.3 to be harmless.
STANDING = {"insult_aimed": 1.9, "insult_piled": 0.9, "insult_bare": 0.5, "coarse_aimed": 1.9, "coarse_bare": 0.1, "learnt_aimed": 1.9, "learnt_piled": 0.9, "learnt_bare": 0.5, "echo_aimed": 0.2, "echo_piled": 0.9, "echo_bare": 0.2, "threat_meant": 1.9, "threat_bare": 0.1, "weakened": 0.1}
LONE = {"insult_bare": 0.7, "learnt_bare": 0.7, "coarse_bare": 0.15, "echo_aimed": 0.2, "echo_bare": 0.2, "threat_bare": 0.15, "weakened": 0.1}
STANDING_BASE, MOST_BASE = 0.02, 0.1
PATTERNS = tuple(STANDING)
_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[*b".;:!?\n"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Transducer:
    """After reading symbol s in state q: state follow[q, s] and output output[q, s]. It starts in state 0."""

    follow: np.ndarray
    output: np.ndarray

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """Outputs for rows of symbols, all rows in step."""
        state, out = np.zeros(len(symbols), np.int64), np.empty(symbols.shape, np.int64)
        for i in range(symbols.shape[1]):
            out[:, i] = self.output[state, symbols[:, i]]
            state = self.follow[state, symbols[:, i]]
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what ``second`` makes of the output of ``first``; its states are pairs."""
    n = len(second.follow)
    a, b = np.divmod(np.arange(len(first.follow) * n), n)
    middle = first.output[a]
    return Transducer(first.follow[a] * n + second.follow[b[:, None], middle], second.output[b[:, None], middle])


def scope(triggers: tuple[int, ...], mark: int, reach: int = SCOPE) -> Transducer:
    """Adds a mark to the words up to ``reach`` places behind a trigger; reads and gives symbol * MARKS + marks.
    State k: the mark is added to k more words."""
    states, symbols = np.arange(reach + 1)[:, None], np.arange(SYMBOLS * MARKS)[None, :]
    opens = np.isin(symbols // MARKS, triggers)
    return Transducer(np.where(opens, reach, np.maximum(states - 1, 0)), np.where(states > 0, symbols | mark, symbols))


def marker() -> Transducer:
    """The four scopes, composed; it reads bare symbols."""
    given = Transducer(np.zeros((1, SYMBOLS), np.int64), np.arange(SYMBOLS)[None, :] * MARKS)
    out = given
    for triggers, mark in (((TARGET, CALLED), AIMED), ((NEGATION,), DENIED), ((REPORT,), REPORTED), ((INTENT,), MEANT)):
        out = compose(out, scope(triggers, mark))
    return out


def predicate() -> Transducer:
    """Reads bare symbols; gives 1 for a coarse word that is said of somebody: "you trash", "he is such a pig".
    States: 0, 1 behind a target, 2 where what follows is said of it. Articles change nothing."""
    follow, output = np.zeros((3, SYMBOLS), np.int64), np.zeros((3, SYMBOLS), np.int64)
    follow[:, TARGET], follow[:, CALLED] = 1, 2
    follow[1:, BEING] = 2
    follow[:, ARTICLE] = follow[:, NEGATION] = np.arange(3)
    follow[2, [INSULT, COARSE]] = 2
    output[2, COARSE] = 1
    return Transducer(follow, output)


def labeller() -> Transducer:
    """Reads symbol * ALL_MARKS + marks; gives 0, or 1 + a pattern. States: a bit for each of insult, coarse, learnt,
    echo, a bare threat and something weakened, set once the document has had one. A bare word counts if it is the
    first of its kind, and as piled if another insulting word came before; of coarse words one at least must be a
    plain insult."""
    insult, coarse, learnt, echo, threat, weak = (1 << i for i in range(6))
    bit_of = {INSULT: insult, COARSE: coarse, LEARNT: learnt, ECHO: echo}
    company = {INSULT: insult | coarse | learnt, COARSE: insult | learnt, LEARNT: insult | learnt, ECHO: insult | learnt | echo}
    follow = np.repeat(np.arange(64)[:, None], SYMBOLS * ALL_MARKS, axis=1)
    output = np.zeros((64, SYMBOLS * ALL_MARKS), np.int64)
    number = {p: i + 1 for i, p in enumerate(PATTERNS)}
    for state in range(64):
        for symbol, name in _FAMILY.items():
            for marks in range(ALL_MARKS):
                at, said, bit = symbol * ALL_MARKS + marks, None, 0
                if marks & (DENIED | REPORTED):
                    said, bit = None if state & weak else "weakened", weak
                elif name == "threat":
                    if marks & HIT:
                        said = "threat_meant"
                    else:
                        said, bit = None if state & threat else "threat_bare", threat
                else:
                    bit = bit_of[symbol]
                    if marks & (HIT if symbol == COARSE else AIMED):
                        said = f"{name}_aimed"
                    elif not marks & SAME:
                        said = f"{name}_piled" if state & company[symbol] else None if state & bit else f"{name}_bare"
                if said == "coarse_piled":
                    said = "insult_piled"
                output[state, at] = number[said] if said else 0
                follow[state, at] = state | bit
    return Transducer(follow, output)


class Tokens:
    """Words of a run of texts, A-Z in lower case: hashes, byte spans, the text and the clause of each."""

    def __init__(self, hasher: Hasher, column: pa.Array):
        offsets, data = utf8(column)
        data = _FOLD[data]
        breaks = _WORD_BREAK[data]
        inner = np.zeros(len(data), bool)  # an apostrophe between letters belongs to its word
        inner[1:-1] = (data[1:-1] == 0x27) & _LETTER[data[:-2]] & _LETTER[data[2:]]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~breaks | inner
        starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] |= inside[1:-1][edges]
        ends[edges - 1] |= inside[1:-1][edges - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.hasher = hasher
        self.hashes = hasher.spans(data, self.starts, self.ends)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        stops = np.append(0, np.cumsum(_CLAUSE_END[data]))
        new = np.ones(len(self.starts), bool)
        new[1:] = (stops[self.starts[1:]] > stops[self.ends[:-1]]) | (self.text[1:] != self.text[:-1])
        self.clause = np.cumsum(new) - 1

    def stems(self, chars: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of at least so many characters, hash of their first ones); characters are never cut."""
        begins = np.flatnonzero((self.data & 0xC0) != 0x80)
        nth = np.searchsorted(begins, self.starts) + chars
        ends = np.append(begins, len(self.data))[np.minimum(nth, len(begins))]
        some = np.flatnonzero((nth <= len(begins)) & (ends <= self.ends))
        return some, self.hasher.spans(self.data, self.starts[some], ends[some])


def _hash_words(hasher: Hasher, words: list[str]) -> np.ndarray:
    joined = "".join(words).encode()
    ends = np.cumsum([len(w.encode()) for w in words])
    return hasher.spans(np.frombuffer(joined, np.uint8), np.append(0, ends[:-1]), ends)


@dataclass
class Grammar:
    """Learnt stems by their length, as sorted hashes with their symbols, and weights. What workers get; bounded by
    MAX_FIT_ROWS rows."""

    stems: dict[int, tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    base: float


class Reader:
    """Counts patterns; holds the fixed lexicon and the composed transducers."""

    def __init__(self) -> None:
        self.hasher, self.marker, self.predicate, self.labeller = Hasher(), marker(), predicate(), labeller()
        words = list({w: s for ws, s in reversed(LEXICON) for w in ws}.items())
        hashes = _hash_words(self.hasher, [w for w, _ in words])
        order = np.argsort(hashes)
        self.fixed = hashes[order], np.array([s for _, s in words])[order]

    def symbols(self, tokens: Tokens, stems: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(tokens.hashes), PLAIN)
        for chars, table in sorted(stems.items(), reverse=True):  # the shorter, the stronger
            some, hashes = tokens.stems(chars)
            found = _look_up(table, hashes)
            out[some[found > 0]] = found[found > 0]
        found = _look_up(self.fixed, tokens.hashes)
        return np.where(found > 0, found, out)

    def patterns(self, column: pa.Array, stems: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, clause, pattern) of each match."""
        tokens = Tokens(self.hasher, column)
        symbols = self.symbols(tokens, stems)
        at = np.flatnonzero(np.isin(symbols, list(_FAMILY)))
        # Marks reach SCOPE words: windows around the matches, blank outside the clause, hold all that counts.
        place = at[:, None] + np.arange(-SCOPE, SCOPE + 1)
        safe = np.clip(place, 0, len(symbols) - 1) if len(symbols) else place
        near = np.where((place == safe) & (tokens.clause[safe] == tokens.clause[at][:, None]), symbols[safe], PLAIN)
        own, text = symbols[at], tokens.text[at]
        # "that" and "your" point at people beside an insult, at things beside the others.
        near = np.where(near == POINTER, np.where(np.isin(own, [COARSE, THREAT, LATE]), PLAIN, TARGET)[:, None], near)
        before, behind = self.marker.read(near[:, : SCOPE + 1])[:, -1] % MARKS, self.marker.read(near[:, : SCOPE - 1 : -1])[:, -1] % MARKS
        marks = before | behind
        meant = np.where(own == THREAT, (before & MEANT > 0) & (behind & AIMED > 0), (own == LATE) & (marks & MEANT > 0) & (marks & AIMED > 0))
        hit = meant | ((own == COARSE) & (self.predicate.read(near[:, : SCOPE + 1])[:, -1] > 0))
        read = own * ALL_MARKS + (marks | hit * HIT | _repeats(text, tokens.hashes[at]) * SAME)
        # The last transducer reads a text's matches in order, all texts in step.
        rank = np.arange(len(at)) - np.searchsorted(text, text)
        state, out = np.zeros(len(column), np.int64), np.zeros(len(at), np.int64)
        order = np.argsort(rank, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1):
            out[some] = self.labeller.output[state[text[some]], read[some]]
            state[text[some]] = self.labeller.follow[state[text[some]], read[some]]
        said = out > 0
        return text[said], tokens.clause[at][said], out[said] - 1

    def counts(self, column: pa.Array, stems: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        text, _, pattern = self.patterns(column, stems)
        return np.bincount(text * len(PATTERNS) + pattern, minlength=len(column) * len(PATTERNS)).reshape(-1, len(PATTERNS))


def _repeats(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the same text holds the same word before."""
    order = np.lexsort((hashes, text))
    a, b = order[:-1], order[1:]
    out = np.zeros(len(order), bool)
    out[b] = (text[a] == text[b]) & (hashes[a] == hashes[b])
    return out


def _look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Symbol of each hash, 0 where the table has it not."""
    keys, symbols = table
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, symbols[at], 0)


def _held_stems(reader: Reader, column: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, stem, different words with it) for each text and each of its stems, or of those in ``only``; fixed words hold none."""
    out, first = [], 0
    for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", FIT_SLICE_BYTES):
        tokens = Tokens(reader.hasher, part.column(0))
        free = (_look_up(reader.fixed, tokens.hashes) == 0) & ~_repeats(tokens.text, tokens.hashes)
        texts, keys = [], []
        for chars in STEM_CHARS:
            some, hashes = tokens.stems(chars)
            key = (hashes & ~np.uint64(15)) | np.uint64(chars)
            good = free[some] if only is None else free[some] & np.isin(key, only)
            texts.append(tokens.text[some[good]] + first)
            keys.append(key[good])
        text, key = np.concatenate(texts), np.concatenate(keys)
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.flatnonzero(np.append(len(text) > 0, (text[1:] != text[:-1]) | (key[1:] != key[:-1])))
        out.append((text[new], key[new], np.diff(np.append(new, len(text)))))
        first += part.num_rows
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def learn_stems(reader: Reader, toxic: pa.Array, clean: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Word beginnings that stand almost only in toxic texts (learnt), or of which two or three different words stand
    almost only there (echo).

    Taken by support, of equal ones those of fewer words and then the longest first; each must explain enough toxic texts that neither
    the seed lexicon nor an earlier one explains, so that the common words of copied texts are not learnt."""
    text, key, often = _held_stems(reader, toxic)
    keys, of = np.unique(key, return_inverse=True)
    once = np.bincount(of, minlength=len(keys))
    frequent = keys[once >= MIN_SUPPORT]
    _, clean_key, clean_often = _held_stems(reader, clean, frequent)
    share = len(toxic) / max(1, len(toxic) + len(clean))
    least = math.log(len(keys) + 1) + 2
    weight = lambda n, against: n * math.log(1 / max(share, 1e-6)) + against * math.log(1 - MIN_PRECISION)
    offers = []
    for symbol, times in ((LEARNT, 1), (ECHO, 2), (ECHO, 3)):
        against = np.searchsorted(np.sort(clean_key[clean_often >= times]), np.stack([frequent, frequent + np.uint64(1)]))
        against = dict(zip(frequent.tolist(), (against[1] - against[0]).tolist(), strict=True))
        some = (often >= times) & np.isin(key, frequent)
        order = np.argsort(key[some], kind="stable")
        sorted_key, sorted_text = key[some][order], text[some][order]
        cuts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(sorted_key) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts, len(sorted_key))[1:].tolist(), strict=True):
            k, n = int(sorted_key[a]), b - a
            if n >= MIN_SUPPORT and n >= MIN_PRECISION * (n + against[k]) and weight(n, against[k]) > least:
                offers.append((-n, times, -(k & 15), k, symbol, against[k], sorted_text[a:b]))
    tokens_of = reader.counts(toxic, {})
    explained = tokens_of[:, [PATTERNS.index(f"insult_{how}") for how in ("aimed", "piled", "bare")]].sum(axis=1) > 0
    taken: dict[int, list[tuple[int, int]]] = {}
    for *_, length, k, symbol, against, holders in sorted(offers, key=lambda o: o[:4]):
        fresh = int((~explained[holders]).sum())
        if fresh >= MIN_SUPPORT and weight(fresh, against) > least:
            explained[holders] = True
            taken.setdefault(-length, []).append((k, symbol))
    out = {}
    for chars, pairs in taken.items():
        known = {k for k, _ in pairs}
        hashes = _stem_hashes(reader, toxic, chars, known)
        order = np.argsort([h for h, _ in hashes])
        symbol_of = dict(pairs)
        out[chars] = np.array([h for h, _ in hashes], np.uint64)[order], np.array([symbol_of[k] for _, k in hashes])[order]
    return out


def _stem_hashes(reader: Reader, column: pa.Array, chars: int, known: set[int]) -> list[tuple[int, int]]:
    """(whole hash, key) of the stems with these keys; a key is the hash with its last bits replaced by the length."""
    found = set()
    for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", FIT_SLICE_BYTES):
        _, hashes = Tokens(reader.hasher, part.column(0)).stems(chars)
        keys = (hashes & ~np.uint64(15)) | np.uint64(chars)
        some = np.isin(keys, np.array(sorted(known), np.uint64))
        found.update(zip(hashes[some].tolist(), keys[some].tolist(), strict=True))
    return sorted(found)


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 3000, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights that make the labels likely, by Adam on their logarithms, drawn to the standing ones and bounded by LONE."""
    prior = np.log(np.append(np.array([STANDING[p] for p in PATTERNS]), STANDING_BASE))
    z, wide = prior.copy(), np.column_stack([x, np.ones(len(x))])
    m, v = np.zeros_like(z), np.zeros_like(z)
    most = np.array([LONE.get(p, 4.0) for p in PATTERNS] + [MOST_BASE])
    for step in range(1, rounds + 1):
        a = np.exp(z)
        s = np.minimum(wide @ a, 30.0)
        # d/ds of -log(1 - exp(-s)) for toxic rows, 1 for the others
        slope = np.where(y > 0, -1 / np.expm1(np.maximum(s, 1e-4)), 1.0)
        g = (wide.T @ slope) * a + penalty * (z - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = np.minimum(z - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9), np.log(most))
    return np.exp(z[:-1]), float(np.exp(z[-1]))


def fit(rows: list[tuple[str, int]]) -> Grammar:
    """The grammar for labelled texts. With no toxic or no clean row, the seed lexicon with standing weights."""
    standing = np.array([STANDING[p] for p in PATTERNS])
    if {y for _, y in rows} != {0, 1}:
        return Grammar({}, standing, STANDING_BASE)
    reader = Reader()
    split = lambda some: [pa.array([t for t, y in some if y == label], pa.large_string()) for label in (1, 0)]
    # Stems of the other parts weigh in on each: a stem seen by chance gets no credit from its own rows.
    parts = [rows[i::FOLDS] for i in range(FOLDS)]
    x, y = [], []
    for own in range(FOLDS):
        stems = learn_stems(reader, *split([r for i, part in enumerate(parts) if i != own for r in part]))
        texts = pa.RecordBatch.from_arrays([pa.array([t for t, _ in parts[own]], pa.large_string())], names=["text"])
        x.extend(reader.counts(part.column(0), stems) for part in slices(iter([texts]), "text", FIT_SLICE_BYTES))
        y.extend(label for _, label in parts[own])
    weights, base = fit_weights(np.concatenate(x).astype(float), np.array(y))
    return Grammar(learn_stems(reader, *split(rows)), weights, base)


def labelled_rows(docs: DataFrame, labels: DataFrame, trains: F.Column, column: str, id_column: str) -> list[tuple[str, int]]:
    """At most MAX_FIT_ROWS labelled training rows, the first by a hash of the id, without texts of over MAX_FIT_CHARS;
    of several texts of one id the first in order."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("toxic"), F.max(trains.cast("int")).alias("trains"))
    few = known.where("trains = 1").orderBy(F.xxhash64("id"), "id").limit(MAX_FIT_ROWS)
    sample = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text")).where(F.length("text") <= MAX_FIT_CHARS).join(F.broadcast(few), "id")
    rows = sample.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r.text, int(r.toxic > 0)) for r in sorted(rows, key=lambda r: str(r.id)[::-1])]


def _score(shared, column: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, reader = shared.value, Reader()
        for batch in slices(batches, column):
            texts = batch.column(batch.schema.get_field_index(column))
            text, clause, pattern = reader.patterns(texts, grammar.stems)
            new = np.flatnonzero(np.append(True, clause[1:] != clause[:-1])) if len(clause) else np.zeros(0, np.int64)
            clause_weight = np.add.reduceat(grammar.weights[pattern], new) if len(new) else np.zeros(0)
            clause_score = -np.expm1(-clause_weight)
            harmless = np.full(batch.num_rows, math.exp(-grammar.base))
            np.multiply.at(harmless, text[new], 1 - clause_score)
            hits = np.bincount(text * len(PATTERNS) + pattern, minlength=batch.num_rows * len(PATTERNS)).reshape(-1, len(PATTERNS))
            listed = pa.array([[f"{PATTERNS[i]}:{row[i]}" for i in np.flatnonzero(row)] for row in hits], pa.list_(pa.string()))
            worst = np.zeros(batch.num_rows)
            np.maximum.at(worst, text[new], clause_score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 - harmless), pa.array(worst), listed], names=[*batch.schema.names, *names])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, trains: F.Column | None = None, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents with toxicity (0 to 1), worst_clause (the largest clause score) and toxic_patterns (pattern:count).

    trains picks, by columns of ``labels``, the labelled rows that may be learnt from; None: all. Labels
    with a null id or a null toxic are left out; of several labels of one id the largest counts. Whole
    texts are scored, of any length; null and empty ones match nothing and get the base rate. One
    insulting or learnt word that is not aimed, however often it stands, coarse words alone and threats without
    a target never make a text 0.7, whatever was learnt. Figurative threats ("I will beat you at chess") are not told apart. Labels, language, source and id are no inputs of a
    score. An empty label table leaves the seed lexicon with standing weights; an empty document table
    gives no rows. Repeated rows are scored alike; of several texts of one labelled id the first in order
    is learnt from. Other columns pass through; toxicity, worst_clause and toxic_patterns are replaced.

    Scale: one pass without a shuffle, in slices of bounded size; the fit takes a bounded sample of
    labelled rows, MAX_FIT_ROWS of MAX_FIT_CHARS characters at most, and the broadcast grammar is bounded
    by that sample.
    """
    names = ("toxicity", "worst_clause", "toxic_patterns")
    docs = docs.drop(*names)
    rows = labelled_rows(docs, labels.select(id_column, "toxic"), F.lit(True) if trains is None else trains, column, id_column)
    grammar = docs.sparkSession.sparkContext.broadcast(fit(rows))
    del rows
    give_back()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["toxicity double, worst_clause double, toxic_patterns array<string>"])
    return docs.mapInArrow(_score(grammar, column, names), schema)


def remainder(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted; rows with crc32(doc_id) mod 3 of 1 are never learnt from."""
    scored = score_toxicity(docs.select("doc_id", "text"), labels, remainder() != 1)
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
