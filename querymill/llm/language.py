"""Language of texts and of the segments of mixed texts, by hierarchical discrimination.

A linear machine for each language family decides the family; within it, one-versus-one linear support vector machines decide between
its languages. All machines are linear in the words of a text, so each distinct word is scored once and texts, prefixes and suffixes are
sums; the best place to split a text in two languages is found over all places at once.

The machines are fitted on the driver on a bounded sample of labelled texts (SAMPLE_A_LANGUAGE for each language, those
with the smallest hash) and a few sentences kept here; rows whose label the first fit contradicts are left out of the second, which makes wrong labels
harmless.

A confidence is the probability that the language is right: a logistic function of the mean margin, of the number of words and of how much of the words' letters the
machines know, fitted on cut-outs of one word and more from texts kept out of the fit. decided names the language, or `other` where that probability is below OTHER_BELOW.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = {"germanic": ["en", "de", "nl"], "romance": ["fr", "es", "it"], "slavic": ["ru"]}
LANGUAGES = [x for f in FAMILIES.values() for x in f]
PAIRS = [(a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :]]
SAMPLE_A_LANGUAGE = 700
SEGMENT_WORDS = 5
SPLIT_GAIN = 1.6
HELD_OUT = 5  # one of so many labelled texts is kept out of the fit of the machines, for that of the confidence
OTHER_BELOW = 0.5
DIM = 1 << 17
WORD = re.compile(r"[^\W\d_]+")

# fixed values: codes and English names of the languages
NAMES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german"], "nl": ["nl", "nld", "dut", "dutch"], "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish"], "it": ["it", "ita", "italian"], "ru": ["ru", "rus", "russian"],
}

SEED = {
    "en": "where is the nearest station and how can i get there|what should i do if my house is too cold in the morning|when did they build this and who paid for it|i would like to know why you were not at work|which of these books do you think she has read|how long does it take to learn to drive|is there anything else that we could have done before it was over",
    "de": "wo ist der nächste bahnhof und wie komme ich dorthin|was soll ich tun wenn mein haus am morgen zu kalt ist|wann haben sie das gebaut und wer hat es bezahlt|ich möchte wissen warum du nicht bei der arbeit warst|welches von diesen büchern hat sie schon gelesen|wie lange dauert es bis man fahren kann|gibt es noch etwas das wir vorher hätten machen können",
    "nl": "waar is het dichtstbijzijnde station en hoe kom ik daar|wat moet ik doen als mijn huis in de ochtend te koud is|wanneer hebben ze dit gebouwd en wie heeft het betaald|ik wil graag weten waarom je niet op het werk was|welke van deze boeken heeft zij al gelezen|hoe lang duurt het voordat je kunt rijden|is er nog iets wat wij eerder hadden kunnen doen",
    "fr": "où est la gare la plus proche et comment puis-je y aller|que dois-je faire si ma maison est trop froide le matin|quand ont-ils construit cela et qui l'a payé|je voudrais savoir pourquoi tu n'étais pas au travail|lequel de ces livres a-t-elle déjà lu|combien de temps faut-il pour apprendre à conduire|est-ce qu'il y a autre chose que nous aurions pu faire avant",
    "es": "dónde está la estación más cercana y cómo puedo llegar allí|qué debo hacer si mi casa está demasiado fría por la mañana|cuándo construyeron esto y quién lo pagó|me gustaría saber por qué no estabas en el trabajo|cuál de estos libros ha leído ella ya|cuánto tiempo se tarda en aprender a conducir|hay algo más que hubiéramos podido hacer antes",
    "it": "dove si trova la stazione più vicina e come ci posso arrivare|che cosa devo fare se la mia casa è troppo fredda la mattina|quando hanno costruito questo e chi lo ha pagato|vorrei sapere perché non eri al lavoro|quale di questi libri ha già letto lei|quanto tempo ci vuole per imparare a guidare|c'è qualcos'altro che avremmo potuto fare prima",
    "ru": "где находится ближайшая станция и как туда добраться|что мне делать если в моём доме утром слишком холодно|когда они это построили и кто за это заплатил|я хотел бы знать почему тебя не было на работе|какую из этих книг она уже прочитала|сколько времени нужно чтобы научиться водить|есть ли ещё что-нибудь что мы могли сделать раньше",
}

_NAMED = {n: c for c, names in NAMES.items() for n in names}


def label_language(label: str | None) -> str | None:
    """The language that a label names: a code, a region variant or an English name, in any case; else null."""
    if not label:
        return None
    low = label.strip().lower()
    return _NAMED.get(low) or (_NAMED.get(re.split("[-_]", low)[0]) if re.fullmatch(r"[a-z]{2,3}[-_][a-z0-9]{2,4}", low) else None)


def repair(text: str) -> str:
    """Undoes UTF-8 read as Latin-1 or Windows-1252, once or twice, where that is what happened."""
    for _ in range(2):
        if not any(c in text for c in "ÃÐÑÂ"):
            return text
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            raw = bytes(b for c in text for b in (c.encode("cp1252", "ignore") or c.encode("latin-1", "ignore")))
            fixed = raw.decode("utf-8", "ignore")
            return fixed if len(WORD.findall(fixed)) >= 2 else text
    return text


def words(text: str) -> list[str]:
    return WORD.findall(repair(text).lower())


def _grams(word: str) -> list[int]:
    padded = f"^{word}$"
    parts = [f"w{word}", *[padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)]]
    return [crc32(p.encode()) % DIM for p in parts]


class Machines:
    """Weights of the family machines and of the pair machines; scores of distinct words are kept until there are too many."""

    def __init__(self, weights: np.ndarray, sure: np.ndarray | None = None):
        self.weights = weights
        self.sure = np.array([-8.0, 2.0, 1.2, 8.0]) if sure is None else sure  # of 1, mean margin, log of the number of words, share of known grams
        self.known = (weights != 0).any(axis=1)
        self.clear()

    def __reduce__(self):
        return Machines, (self.weights, self.sure)

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, self.weights.shape[1] + 1), np.float32)

    def word(self, w: str) -> int:
        at = self.ids.get(w)
        if at is None:
            at = self.ids[w] = len(self.ids)
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            grams = _grams(w)
            self.rows[at, :-1] = self.weights[grams].mean(axis=0)
            self.rows[at, -1] = self.known[grams].mean()
        return at

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """(texts, words, machines and the share of known grams) for texts of equally many words."""
        if len(self.ids) > 400_000:
            self.clear()
        ids = np.array([[self.word(w) for w in t] for t in texts])  # first: rows may grow
        return self.rows[ids]


def _languages_of(sums: np.ndarray) -> np.ndarray:
    """The decision for summed scores (…, machines): the family with the highest score, then the language of it that beats the others."""
    family = sums[..., : len(FAMILIES)].argmax(axis=-1)
    out = np.zeros(family.shape, np.int64)
    for k, own in enumerate(FAMILIES.values()):
        wins = np.zeros((*family.shape, len(own)))
        for j, (a, b) in enumerate(PAIRS):
            if a in own:
                s = sums[..., len(FAMILIES) + j]
                wins[..., own.index(a)] += (s > 0) + 1e-3 * np.tanh(s)
                wins[..., own.index(b)] += (s <= 0) - 1e-3 * np.tanh(s)
        out = np.where(family == k, LANGUAGES.index(own[0]) + wins.argmax(axis=-1), out)
    return out


def _by_language(scores: np.ndarray) -> np.ndarray:
    """Additive scores by language: that of its family and the mean of its pair machines."""
    out = np.zeros((*scores.shape[:-1], len(LANGUAGES)), np.float32)
    for k, own in enumerate(FAMILIES.values()):
        for lang in own:
            pairs = [(j, 1 if a == lang else -1) for j, (a, b) in enumerate(PAIRS) if lang in (a, b)]
            side = sum(sign * scores[..., len(FAMILIES) + j] for j, sign in pairs) / max(1, len(pairs))
            out[..., LANGUAGES.index(lang)] = scores[..., k] + side
    return out


def segments(model: Machines, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
    """(language, confidence, first word, last word + 1) of each segment of each text; none for a text without letters. Both sides of a split are split
    again while the gain holds; neighbours of one language are one segment."""
    split = [words(t) for t in texts]
    out = _once(model, split)
    open_ = [k for k, own in enumerate(out) if len(own) > 1]
    while open_:
        parts = [(k, s) for k in open_ for s in out[k]]
        again = _once(model, [split[k][s[2] : s[3]] for k, s in parts])
        before = {k: out[k] for k in open_}
        for k in open_:
            out[k] = []
        for (k, s), own in zip(parts, again):
            for lang, sure, a, b in own if len(own) > 1 else [s]:
                last = out[k][-1] if out[k] else None
                if last and last[0] == lang:
                    out[k][-1] = (lang, max(last[1], sure), last[2], s[2] + b if len(own) > 1 else b)
                else:
                    out[k].append((lang, sure, s[2] + a, s[2] + b) if len(own) > 1 else s)
        open_ = [k for k in open_ if len(out[k]) > len(before[k])]
    return out


def _once(model: Machines, split: list[list[str]]) -> list[list[tuple[str, float, int, int]]]:
    """One segment or two of each text."""
    lengths = np.array([len(x) for x in split])
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in split]
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        for cut in range(0, len(rows), max(1, 40_000 // int(n))):
            some = rows[cut : cut + max(1, 40_000 // int(n))]
            scores = model.scores([split[k] for k in some])
            known = np.cumsum(scores[..., -1], axis=1)
            scores = scores[..., :-1]
            sums = np.cumsum(scores, axis=1)
            by = np.cumsum(_by_language(scores), axis=1)
            single = by[:, -1].max(axis=1)
            at, gain = np.zeros(len(some), int), np.full(len(some), -1.0)
            for k in range(SEGMENT_WORDS, n - SEGMENT_WORDS + 1):
                left, right = by[:, k - 1], by[:, -1] - by[:, k - 1]
                best = left.max(axis=1) + right.max(axis=1) - single
                best[left.argmax(axis=1) == right.argmax(axis=1)] = -1
                at, gain = np.where(best > gain, k, at), np.maximum(gain, best)
            mixed = gain > SPLIT_GAIN
            whole, sure = _languages_of(sums[:, -1]), _confidence(model, by[:, -1], np.full(len(some), n), known[:, -1])
            left = sums[np.arange(len(some)), np.maximum(at, 1) - 1]
            a, b = _languages_of(left), _languages_of(sums[:, -1] - left)
            left_by = by[np.arange(len(some)), np.maximum(at, 1) - 1]
            left_known = known[np.arange(len(some)), np.maximum(at, 1) - 1]
            sure_a, sure_b = _confidence(model, left_by, np.maximum(at, 1), left_known), _confidence(model, by[:, -1] - left_by, np.maximum(n - at, 1), known[:, -1] - left_known)
            for r, k in enumerate(some):
                if mixed[r] and a[r] != b[r]:
                    out[k] = [(LANGUAGES[a[r]], float(sure_a[r]), 0, int(at[r])), (LANGUAGES[b[r]], float(sure_b[r]), int(at[r]), int(n))]
                else:
                    out[k] = [(LANGUAGES[whole[r]], float(sure[r]), 0, int(n))]
    return out


def _evidence(by: np.ndarray, n: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(texts, 4): what the confidence depends on, of summed scores by language, numbers of words and sums of known shares."""
    ranked = np.sort(by / n[:, None], axis=-1)
    return np.stack([np.ones(len(by)), ranked[:, -1] - ranked[:, -2], np.log(n), known / n], axis=1)


def _confidence(model: Machines, by: np.ndarray, n: np.ndarray, known: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_evidence(by, n, known) @ model.sure, -30, 30)))


def cut_outs(model: Machines, held: list[tuple[list[str], str]]) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of runs of 1, 2, 3, 5 and 8 words and of whole texts, and whether the language found in each is that of its text. Texts whose label the whole text
    contradicts aren't used: of those the label may be the wrong one."""
    evidence, right = [], []
    for tokens, lang in held:
        scores = model.scores([tokens])[0]
        by = _by_language(scores[:, :-1])
        if LANGUAGES[int(_languages_of(scores[:, :-1].sum(axis=0)))] != lang:
            continue
        for size in (1, 2, 3, 5, 8, len(tokens)):
            for a in range(0, len(tokens) - size + 1, max(1, size)):
                own = slice(a, a + size)
                evidence.append(_evidence(by[own].sum(axis=0)[None], np.array([size]), scores[own, -1].sum()[None])[0])
                right.append(LANGUAGES[int(_languages_of(scores[own, :-1].sum(axis=0)))] == lang)
    return np.array(evidence).reshape(-1, 4), np.array(right, float)


def calibrate(model: Machines, held: list[tuple[list[str], str]]) -> Machines:
    """The machines with a confidence fitted to held-out texts: logistic regression by Newton's method."""
    x, y = cut_outs(model, held)
    if len(y) < 200 or y.all():
        return model
    w = model.sure.copy() * 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Machines(model.weights, w)


def train(samples: list[tuple[str, str]], epochs: int = 6, seed: int = 3) -> Machines:
    """Hinge loss with AdaGrad for all machines at once, twice: the second time without rows that the first fit contradicts. One of HELD_OUT texts, by its
    checksum, is kept out and fits the confidence; with too few samples for that it keeps its default."""
    seeds = [(words(t), c) for c, rows in SEED.items() for t in rows.split("|")]
    kept = [(words(t), c) for t, c in samples]
    kept = [(w, c) for w, c in kept if w and c in LANGUAGES]
    out = [(w, c) for w, c in kept if crc32(" ".join(w).encode()) % HELD_OUT == 0]
    kept = [(w, c) for w, c in kept if crc32(" ".join(w).encode()) % HELD_OUT]
    model = _fit(seeds * 5 + kept, epochs, seed)
    if kept:
        right = segments(model, [" ".join(w) for w, _ in kept])
        model = _fit(seeds * 5 + [s for s, r in zip(kept, right) if len(r) == 1 and r[0][0] == s[1]], epochs, seed)
    return calibrate(model, out)


def _fit(samples: list[tuple[list[str], str]], epochs: int, seed: int) -> Machines:
    machines = len(FAMILIES) + len(PAIRS)
    vocabulary: dict[str, list[int]] = {}
    ids, targets = [], np.zeros((len(samples), machines))
    for k, (tokens, lang) in enumerate(samples):
        ids.append([vocabulary.setdefault(w, _grams(w)) for w in tokens])
        for j, own in enumerate(FAMILIES.values()):
            targets[k, j] = 1 if lang in own else -1
        for j, (a, b) in enumerate(PAIRS):
            targets[k, len(FAMILIES) + j] = (lang == a) - float(lang == b)
    weights, seen = np.zeros((DIM, machines)), np.full((DIM, machines), 1e-4)
    rng = np.random.default_rng(seed)
    flat = [np.array([g for w in x for g in w]) for x in ids]
    share = [np.array([1 / (len(w) * len(x)) for w in x for _ in w]) for x in ids]
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for cut in range(0, len(order), 64):
            some = order[cut : cut + 64]
            at, part = np.concatenate([flat[k] for k in some]), np.concatenate([share[k] for k in some])
            row = np.repeat(np.arange(len(some)), [len(flat[k]) for k in some])
            where, inverse = np.unique(at, return_inverse=True)
            score = np.stack([np.bincount(row, weights[at, j] * part, len(some)) for j in range(machines)], axis=1)
            y = targets[some]
            push = np.where(y * score < 1, -y, 0)
            step = np.stack([np.bincount(inverse, push[row, j] * part, len(where)) for j in range(machines)], axis=1)
            step += 1e-4 * weights[where]
            seen[where] += step**2
            weights[where] -= 0.6 * step / np.sqrt(seen[where])
    return Machines(weights.astype(np.float32))


def sample_labels(df: DataFrame, text_col: str, label_col: str, per_language: int = SAMPLE_A_LANGUAGE) -> list[tuple[str, str]]:
    """At most per_language labelled texts of each language, those with the smallest hash."""
    low = F.lower(F.trim(F.col(label_col)))
    code = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])[F.regexp_replace(low, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", "$1")]
    rows = df.where(F.col(text_col).isNotNull() & (F.length(text_col) <= 2000)).select(F.col(text_col).alias("text"), code.alias("code")).where("code is not null")
    some = rows.withColumn("at", F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("text"), "text"))).where(F.col("at") <= per_language)
    return sorted((r.text, r.code) for r in some.select("text", "code").collect())


def identify(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Machines) -> DataFrame:
    """(record_id, segment, first_word, end_word, lang, confidence, whole, label_lang, decided): one row for each segment of each text.

    whole tells that the text has only one segment; decided is lang, or other where the confidence is too low; label_lang is the language the label names, or null. Texts that are null, empty or
    without letters have one row without language. Very long texts are read whole. Other columns are ignored, whatever their names."""
    shape = f"record_id {df.schema[id_col].dataType.simpleString()}, segment int, first_word int, end_word int, lang string, confidence double, whole boolean, label_lang string"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).fill_null("").dictionary_encode()
            codes, texts = coded.indices.to_pylist(), coded.dictionary.to_pylist()
            found = [x or [(None, None, 0, 0)] for x in segments(model, texts)]
            names = batch.column(2).dictionary_encode()
            known = [label_language(x) for x in names.dictionary.to_pylist()]
            langs = [None if c is None else known[c] for c in names.indices.to_pylist()]
            rows = [(i, s, a, b, lang, sure, len(found[c]) == 1, langs[i]) for i, c in enumerate(codes) for s, (lang, sure, a, b) in enumerate(found[c])]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], ["record_id", "segment", "first_word", "end_word", "lang", "confidence", "whole", "label_lang"])

    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    decided = F.when(F.col("confidence") < OTHER_BELOW, "other").otherwise(F.col("lang"))
    return rows.mapInArrow(label, shape).withColumn("decided", decided)


def wrong_labels(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Machines) -> DataFrame:
    """(record_id, lang): the languages of the texts whose label is missing, names no language or another one, and of all mixed texts."""
    found = identify(df, id_col, text_col, label_col, model)
    case = (~F.col("whole")) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return found.where(F.col("lang").isNotNull() & case).select("record_id", "lang")
