"""Personal information in free text: a linear-chain conditional random field over word-shape features.

The field is trained on the driver from the labelled table in pii_table (fixed size), with the lexicon of name parts as a feature. To tag,
each distinct token of a batch is turned into its scores once; a text's scores are sums of its tokens' and their neighbours' by
index, and texts of equal length are decoded together by Viterbi in numpy. No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.pii_table import TYPES, expand

LABELS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
N = len(LABELS)
TOKEN = re.compile(r"\s*(?:[^\W_]+|[^\w\s]|_)")
REACH = (-3, -2, -1, 0, 1, 2, 3)
LEXICON_LIMIT = 100_000
_EDGE = "\0"


def _allowed() -> np.ndarray:
    """0 where label b may follow label a, else a large penalty."""
    out = np.zeros((N, N))
    for b, name in enumerate(LABELS):
        if name[0] == "I":
            out[:, b] = -1e4
            out[b, b] = out[b - 1, b] = 0
    return out


ALLOWED = _allowed()
START = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)


def _shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 13)}"
    if word.isalpha():
        return ("X" if word.isupper() else "Xx" if word[0].isupper() else "x") + ("1" if len(word) == 1 else "")
    if word.isalnum():
        return re.sub(r"(.)\1+", r"\1", "".join("d" if c.isdigit() else "x" for c in word)) + str(len(word))
    return word


def features(token: str, given: set[str], family: set[str]) -> tuple[list[str], list[str]]:
    """Features of a token for its own label, and those for its neighbours'."""
    if token == _EDGE:
        return ["edge"], ["edge"]
    word = token.lstrip()
    low, glued = word.lower(), "g" if len(word) == len(token) else "s"
    shape = _shape(word)
    lex = ("G" if low in given else "") + ("F" if low in family else "")
    context = [f"w={low}", f"h={shape.lower()}", f"g={glued}{low if not low.isalnum() else ''}", f"l={lex}"]
    own = [*context, f"H={shape}", f"gh={glued}{shape.lower()}", "1"]
    if low.isalpha():
        own += [f"p3={low[:3]}", f"p4={low[:4]}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"s5={low[-5:]}", f"n={min(len(low), 12)}"]
        context += [f"p4={low[:4]}", f"s4={low[-4:]}"]
    return own, context


class Tagger:
    """Weights of a trained field; scores of distinct tokens are kept until there are too many."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, move: np.ndarray, given: set[str], family: set[str]):
        self.index, self.weights, self.move, self.given, self.family = index, weights, move, given, family
        self.clear()

    def __reduce__(self):
        return Tagger, (self.index, self.weights, self.move, self.given, self.family)

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(REACH), N), np.float32)
        self.token(_EDGE)

    def token(self, token: str) -> int:
        at = self.ids.get(token)
        if at is None:
            at = self.ids[token] = len(self.ids)
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            own, context = features(token, self.given, self.family)
            for k, o in enumerate(REACH):
                rows = [i for f in (own if o == 0 else context) if (i := self.index.get(f"{o}|{f}")) is not None]
                if rows:
                    self.scores[at, k] = self.weights[rows].sum(axis=0)
        return at

    def decode(self, texts: list[str]) -> list[list[int]]:
        """Label numbers of each text's tokens."""
        split = [TOKEN.findall(t) for t in texts]
        if len(self.ids) > 400_000:
            self.clear()
        find, pad = self.ids.get, [self.ids[_EDGE]] * 3
        flat: list[int] = list(pad)
        starts = np.zeros(len(texts), np.int64)
        for k, tokens in enumerate(split):
            starts[k] = len(flat)
            for t in tokens:
                at = find(t)
                flat.append(self.token(t) if at is None else at)
            flat += pad
        ids = np.array(flat)
        emit = np.zeros((len(ids), N), np.float32)
        for k, o in enumerate(REACH):
            a, b = max(0, -o), len(ids) - max(0, o)
            emit[a:b] += self.scores[ids[a + o : b + o], k]
        lengths = np.array([len(x) for x in split])
        out: list[list[int]] = [[]] * len(texts)
        for n in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == n)
            for cut in range(0, len(rows), 4096):
                some = rows[cut : cut + 4096]
                labels = viterbi(emit[starts[some][:, None] + np.arange(n)], self.move)
                for k in np.flatnonzero(labels.any(axis=1)):
                    out[some[k]] = labels[k].tolist()
        return out

    def items(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of each item of each text."""
        found = [spans(t, x) if x else [] for t, x in zip(texts, self.decode(texts))]
        # of a wrongly decoded text an item is kept that is one in the repaired text too
        odd = [k for k, own in enumerate(found) if any(repaired(texts[k][a:b]) != texts[k][a:b] for _, a, b in own)]
        right = [repaired(texts[k]) for k in odd]
        for k, text, labels in zip(odd, right, self.decode(right)):
            whole = {(kind, text[a:b]) for kind, a, b in spans(text, labels)}
            kept = lambda kind, item: repaired(item) == item or (kind, repaired(item)) in whole
            found[k] = [(kind, a, b) for kind, a, b in found[k] if kept(kind, texts[k][a:b])]
        return found


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label sequences of texts of equal length; emit: (texts, tokens, labels)."""
    b, n, _ = emit.shape
    best = emit[:, 0] + START.astype(np.float32)
    move = move.astype(np.float32).T  # to, from
    back = np.zeros((b, n, N), np.int8)
    for t in range(1, n):
        total = best[:, None, :] + move
        arg = total.argmax(axis=2)
        back[:, t] = arg
        best = np.take_along_axis(total, arg[:, :, None], 2)[:, :, 0] + emit[:, t]
    out = np.zeros((b, n), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        out[:, t - 1] = back[np.arange(b), t, out[:, t]]
    return out


def repaired(text: str) -> str:
    """The text with what was UTF-8 and read as cp1252 or Latin-1, once or twice, read again, where that gives characters."""

    def again(run: re.Match) -> str:
        try:
            return b"".join(c.encode("latin-1" if "\x80" <= c <= "\xff" else "cp1252") for c in run[0]).decode("utf-8")
        except UnicodeError:
            return run[0]

    for _ in range(2):
        text = re.sub(r"[^\x00-\x7f]{2,}", again, text)
    return text


def spans(text: str, labels: list[int]) -> list[tuple[str, int, int]]:
    found, at = [], 0
    for token, label in zip(TOKEN.findall(text), labels):
        start = at + len(token) - len(token.lstrip())
        at += len(token)
        if label:
            kind = TYPES[(label - 1) // 2]
            if LABELS[label][0] == "I" and found and found[-1][0] == kind:
                found[-1][2] = at
            else:
                found.append([kind, start, at])
    trimmed = [(k, *_trim(k, text, a, b)) for k, a, b in found]
    return [x for x in trimmed if "\ufffd" not in text[max(0, x[1] - 1) : x[2] + 1] and _sound(x[0], text[x[1] : x[2]])]


# fixed values: how a street with its number first goes on
_WAY = re.compile(r"\d+\w?\s+(?:[\w.'-]+\s+){1,3}?(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|boulevard|blvd)\b\.?(?:,?\s+(?:unit|apt|suite)\b\.?\s*\w+|,?\s*#\s*\w+)?", re.I)


def _trim(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """Cuts what can't begin or end an item of the type."""
    first, last = {"phone": ("+(", ""), "address": ("", "."), "name": ("", ".")}.get(kind, ("", ""))
    while a < b and not (text[a] in first or (text[a].isdigit() if kind == "phone" else text[a].isalnum())):
        a += 1
    while a < b and not (text[b - 1].isalnum() or text[b - 1] in last):
        b -= 1
    item = text[a:b]
    if kind == "email" and (whole := re.search(r"[^\s@]+@[^\s@]+", item)):
        return a + whole.start(), a + whole.end()
    if kind == "name" and (aside := re.search(r"\s+[-–]\s", item)) and aside.start() > 4:
        return a, a + aside.start()
    if kind == "name" and (whole := re.match(r"(?!(?:van|von|de|del|della|da|la|le|al|el|ter|zu)\s)([^\W\d_.'-][\w.'-]*\s+[^,]*?),", item, re.I)):
        return a, a + whole.end(1)  # only a family name comes before a comma
    if kind == "id_number":
        return a, a + len(re.sub(r"(?:\s+[^\W\d_]{2,})+$", "", item))
    if kind == "address":
        if way := _WAY.match(item):
            return a, a + way.end()
        town = re.search(r"\d.*?(,[^\d,]+)$", item, re.S)
        if town and not re.search(r"\b(apt|unit)\b|#", town[1], re.I) and not re.fullmatch(r"\d+\w?( (bis|ter))?", item[: town.start(1)]):
            return a, a + town.start(1)
    return a, b


def _sound(kind: str, item: str) -> bool:
    """What every item of a type has: digits or letters enough."""
    item = repaired(item)
    if re.search(r"[�\x80-\x9f]", item):  # characters are lost
        return False
    digits, letters = sum("0" <= c <= "9" for c in item), sum(c.isalpha() for c in item)
    if kind == "phone":
        return digits >= 9
    if kind == "id_number":
        return digits >= 6 and (digits + letters) >= 8
    if kind == "address":
        return digits >= 1 and letters >= 3
    if kind == "email":
        return letters >= 3 and bool(re.search(r"@|\bat\b", item, re.I))
    if re.match(r"[aeiouyà][\s,-]", item, re.I if item.isupper() else 0) or re.search(r"[a-z]", item, re.I) and re.search(r"[а-яё]", item, re.I):
        return False  # an article or a conjunction is no initial, which has a mark; no name is written in two scripts
    return digits == 0 and not re.search(r"\.\.|[^\w\s.,'-]|_|[.]\w{2}", item) and item.count(",") <= 1 and len(re.findall(r"[^\W\d_]+", item)) >= 2 and letters >= 4


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], given: set[str], family: set[str], epochs: int = 5, rate: float = 0.2, seed: int = 1) -> Tagger:
    """Maximum likelihood by AdaGrad over batches; forward-backward runs over whole batches at once."""
    index: dict[str, int] = {}
    samples = []
    for text, marked in rows:
        tokens, at, labels = TOKEN.findall(text), 0, []
        for token in tokens:
            start = at + len(token) - len(token.lstrip())
            at += len(token)
            span = next((s for s in marked if s[0] <= start < s[1]), None)
            labels.append(0 if span is None else 1 + 2 * TYPES.index(span[2]) + (start > span[0]))
        if tokens:
            parts = [features(t, given, family) for t in [_EDGE] * 3 + tokens + [_EDGE] * 3]
            ids = []
            for t in range(3, len(tokens) + 3):
                ids.append([index.setdefault(f"{o}|{f}", len(index)) for o in REACH for f in parts[t + o][0 if o == 0 else 1]])
            samples.append((ids, labels))
    count, width = len(index), max(len(x) for ids, _ in samples for x in ids)
    weights, move = np.zeros((count + 1, N)), ALLOWED.copy()
    seen, seen_move = np.full((count + 1, N), 1e-6), np.full((N, N), 1e-6)
    rng = np.random.default_rng(seed)
    free = ALLOWED == 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(samples)), key=lambda k: len(samples[k][1]) // 3)
        batches = [order[a : a + 64] for a in range(0, len(order), 64)]
        for k in rng.permutation(len(batches)):
            own = [samples[j] for j in batches[k]]
            b, n = len(own), max(len(y) for _, y in own)
            ids, y, mask = np.full((b, n, width), count), np.zeros((b, n), int), np.zeros((b, n))
            for r, (x, labels) in enumerate(own):
                for t, f in enumerate(x):
                    ids[r, t, : len(f)] = f
                y[r, : len(labels)], mask[r, : len(labels)] = labels, 1
            emit = weights[ids].sum(axis=2)
            gradient, gradient_move = _expected(emit, move, mask)
            rows_, cols = np.nonzero(mask)
            gradient[rows_, cols, y[rows_, cols]] -= 1
            follow = mask[:, 1:] > 0
            np.add.at(gradient_move, (y[:, :-1][follow], y[:, 1:][follow]), -1)
            where, inverse = np.unique(ids, return_inverse=True)
            flat = np.zeros((len(where), N))
            sums = np.repeat(gradient.reshape(b * n, 1, N), width, axis=1).reshape(-1, N)
            for c in range(N):
                flat[:, c] = np.bincount(inverse.ravel(), sums[:, c], len(where))
            flat += 0.001 * weights[where]
            seen[where] += flat**2
            weights[where] -= rate * flat / np.sqrt(seen[where])
            seen_move += gradient_move**2
            move[free] -= (rate * gradient_move / np.sqrt(seen_move))[free]
            weights[count] = 0
    strong = np.abs(weights[:count]).max(axis=1) > 0.01
    kept = {f: i for f, i in index.items() if strong[i]}
    return Tagger({f: k for k, f in enumerate(kept)}, weights[list(kept.values())].astype(np.float32), move, given, family)


def _expected(emit: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected label and transition counts of a batch, by forward-backward with scaling."""
    b, n, _ = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, m = np.exp(emit - top), np.exp(move)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] * np.exp(START)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = (alpha[:, t - 1] @ m) * e[:, t]
        a /= a.sum(axis=1, keepdims=True) + 1e-300
        alpha[:, t] = np.where(mask[:, t : t + 1] > 0, a, alpha[:, t - 1])
    pairs = np.zeros((N, N))
    for t in range(n - 1, 0, -1):
        inside = mask[:, t : t + 1] > 0
        right = e[:, t] * beta[:, t]
        joint = alpha[:, t - 1][:, :, None] * m * right[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True) + 1e-300
        pairs += (joint * inside[:, :, None]).sum(axis=0)
        back = right @ m.T
        back /= back.sum(axis=1, keepdims=True) + 1e-300
        beta[:, t - 1] = np.where(inside, back, 1.0)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True) + 1e-300
    return post * mask[:, :, None], pairs


_TRAINED: dict[tuple, Tagger] = {}


def tagger(lexicon: DataFrame, word_col: str = "name_part", kind_col: str = "kind") -> Tagger:
    """Trains the field with a lexicon of at most LEXICON_LIMIT rows (a larger one is an error; it is a feature, not data)."""
    rows = lexicon.where(F.col(word_col).isNotNull()).select(word_col, kind_col).limit(LEXICON_LIMIT + 1).collect()
    if len(rows) > LEXICON_LIMIT:
        raise ValueError("the lexicon of name parts is larger than LEXICON_LIMIT")
    parts = sorted({(r[0], r[1]) for r in rows}, key=str)
    key = tuple(parts)
    if key not in _TRAINED:
        given, family = ({w.lower() for w, k in parts if k == kind} for kind in ("given", "family"))
        _TRAINED[key] = train(expand(parts), given, family)
    return _TRAINED[key]


def find_pii(df: DataFrame, id_col: str, text_col: str, model: Tagger) -> DataFrame:
    """(record_id, pii_type, surface): one row for each distinct item of each record, as written.

    Null and empty texts have none; very long texts are tagged whole; a text that occurs again in a batch is tagged once. Rows with a null id are tagged
    too. An empty table gives no row. Other columns are ignored, whatever their names."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, texts = _distinct(batch.column(1))
            found = [sorted({(k, t[a:b]) for k, a, b in x}) for t, x in zip(texts, model.items(texts))]
            at = [(i, k, s) for i, c in enumerate(codes.tolist()) for k, s in found[c]]
            ids = batch.column(0).take(pa.array([a[0] for a in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([a[1] for a in at], pa.string()), pa.array([a[2] for a in at], pa.string())], ["record_id", "pii_type", "surface"])

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tag, f"record_id {df.schema[id_col].dataType.simpleString()}, pii_type string, surface string")


def redact(df: DataFrame, id_col: str, text_col: str, model: Tagger) -> DataFrame:
    """(record_id, redacted): every text with each item replaced by its type in brackets; all else stays. Null stays null."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, texts = _distinct(batch.column(1).fill_null(""))
            clean = []
            for t, x in zip(texts, model.items(texts)):
                for kind, a, b in reversed(x):
                    t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                clean.append(t)
            made = pa.array(clean, pa.string()).take(pa.array(codes))
            kept = pa.compute.if_else(batch.column(1).is_valid(), made, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["record_id", "redacted"])

    rows = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mask, f"record_id {df.schema[id_col].dataType.simpleString()}, redacted string")


def _distinct(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = texts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
