"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from .labelled import labelled_sample
from .quality import apply_scores

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled training texts that are drawn to the driver at most.
TRAIN_ROWS = 12_000
#: Parts of the training texts; what is learned from the others tells a part's features and margins.
PARTS = 4
#: A learned lexicon holds so many words at most, each in so many toxic texts at least, with such log odds at least.
LEXICON_WORDS, LEXICON_LEAST, LEXICON_ODDS = 20_000, 3, 2.5

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes ti tuyo vosotros".split())
# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})

_CHUNK = re.compile(r"[^\s]+")
_WORD = re.compile(r"\w+")
_EDGE = "\"'.,;:?()[]{}<>!*#&%-_|"
NAMES = ["log_words", "hits", "odds", "strongest", "distinct", "disguised", "addressed", "spread", "capitals", "shouted", "marks", "exclaimed", "questioned", "mixed", "starred", "stretched", "repeated"]


def plain(chunk: str) -> str:
    """A chunk between white space with disguises undone: signs for letters, signs between letters, stretched letters."""
    return re.sub(r"(.)\1{2,}", r"\1", "".join(c for c in chunk.strip(_EDGE).translate(DISGUISE) if c.isalpha()))


def learn_lexicons(texts: list[str], y: np.ndarray, part: np.ndarray, words: int = LEXICON_WORDS, least: int = LEXICON_LEAST, odds: float = LEXICON_ODDS) -> list[dict[str, float]]:
    """word -> log odds of standing in a toxic text, of words that stand in `least` toxic texts and are telling enough.

    One lexicon for each part, learned from the texts of all others, and last the one of all texts.
    """
    seen = tuple([Counter() for _ in range(PARTS)] for _ in (0, 1))
    for text, label, p in zip(texts, y, part, strict=True):
        if label:
            seen[1][p].update(set(_WORD.findall(text.lower())))
    total = sum(seen[1], Counter())
    able = {w for w, c in total.items() if c >= least}  # others need no count in the many texts that are not toxic
    for text, label, p in zip(texts, y, part, strict=True):
        if not label:
            seen[0][p].update(able.intersection(_WORD.findall(text.lower())))
    counts, lexicons = (sum(seen[0], Counter()), total), []
    for p in [*range(PARTS), PARTS]:
        n = [int(((y == k) & (part != p)).sum()) for k in (0, 1)]
        without = [seen[k][p] if p < PARTS else Counter() for k in (0, 1)]
        c = {w: [counts[k][w] - without[k][w] for k in (0, 1)] for w in able}
        scored = {w: float(np.log((c[w][1] + 0.5) / (n[1] + 1)) - np.log((c[w][0] + 0.5) / (n[0] + 1))) for w in able if c[w][1] >= least}
        best = sorted((w for w in scored if scored[w] >= odds), key=lambda w: (-c[w][1], w))[:words]
        lexicons.append({w: scored[w] for w in best})
    return lexicons


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features NAMES of a whole text; zeros for an empty one."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), len(text)
    at = [i for i, w in enumerate(words) if w in lexicon]
    found = [words[i] for i in at]
    odds = [lexicon[w] for w in found]
    odd_chunks = [c for c in _CHUNK.findall(lower) if not c.isalpha() and not c.strip(_EDGE).isalpha()]
    disguised = sum(p in lexicon for p in map(plain, odd_chunks) if len(p) > 2)
    addressed = sum(any(w in SECOND_PERSON for w in words[max(0, i - 4) : i + 5]) for i in at)
    letters = sum(map(str.isalpha, text)) or 1
    tokens = text.split()
    return [
        float(np.log1p(n)),
        len(found) / n,
        sum(odds) / n,
        max(odds, default=0.0),
        float(len(set(found))),
        disguised / n,
        addressed / n,
        (at[-1] - at[0]) / n if at else 0.0,
        (letters - sum(map(str.islower, text))) / letters,
        sum(1 for w in tokens if len(w) > 2 and w.isupper()) / n,
        (chars - letters - sum(map(str.isspace, text))) / chars,
        text.count("!") / n,
        text.count("?") / n,
        sum(1 for c in odd_chunks if any(map(str.isdigit, c)) and any(map(str.isalpha, c))) / n,
        sum(text.count(c) for c in "*@#$%&") / n,
        len(re.findall(r"(\w)\1{2,}", lower)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


@dataclass
class Trees:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    least: float = 1.0  # of a leaf's second derivatives
    ridge: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)  # (feature or -1, limit, left, right, value)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            nodes: list = []
            self._grow(nodes, binned, p - y, p * (1 - p), np.arange(len(y)), self.depth, margin)
            self.trees.append(nodes)
        return self

    def _grow(self, nodes: list, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, margin: np.ndarray) -> int:
        here, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
        nodes.append(None)
        best = (1e-6, -1, 0)
        if depth:
            for j, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hl < self.least) | (hs - hl < self.least)] = -1
                if gain[k := int(np.argmax(gain))] > best[0]:
                    best = (float(gain[k]), j, k)
        _, j, k = best
        if j < 0:
            value = -self.rate * gs / (hs + self.ridge)
            nodes[here] = (-1, 0.0, 0, 0, float(value))
            margin[rows] += value
        else:
            left = binned[rows, j] <= k
            low = self._grow(nodes, binned, g, h, rows[left], depth - 1, margin)
            high = self._grow(nodes, binned, g, h, rows[~left], depth - 1, margin)
            nodes[here] = (j, float(self.edges[j][k]), low, high, 0.0)
        return here

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            feature, limit, low, high, value = (np.array(c) for c in zip(*nodes, strict=True))
            for _ in range(self.depth):
                f = feature[at]
                step = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at], low[at], high[at])
                at = np.where(f < 0, at, step)
            out += value[at]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: (margins, probabilities), both rising, to interpolate between; equal margins are one block."""
    at, where, n = np.unique(margin, return_inverse=True, return_counts=True)
    labels = np.bincount(where, y, len(at))
    blocks: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, label, count in zip(at, labels, n, strict=True):
        blocks.append([float(label), float(count), float(m * count)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees
    margins: np.ndarray
    levels: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margins(np.array([features(t, self.lexicon) for t in texts]))
        return np.interp(margin, self.margins, self.levels) if len(self.levels) else 1 / (1 + np.exp(-margin))


def fit_model(texts: list[str], y: np.ndarray, trees: Trees | None = None) -> ToxicityModel:
    """Lexicon and trees of all texts.

    Cross-fitted, so that none grades itself: the trees learn from features by the lexicon of the other parts, and the
    calibration from the margins of trees of the other parts.
    """
    part, unfitted = np.arange(len(texts)) % PARTS, trees or Trees()
    lexicons = learn_lexicons(texts, y, part)
    x = np.array([features(t, lexicons[p]) for t, p in zip(texts, part, strict=True)]).reshape(-1, len(NAMES))
    margin = np.zeros(len(texts))
    for p in range(PARTS):
        others = part != p
        margin[~others] = replace(unfitted, edges=[], trees=[]).fit(x[others], y[others]).margins(x[~others])
    margins, levels = isotonic(margin, y) if len(set(y.tolist())) == 2 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicons[-1], replace(unfitted, edges=[], trees=[]).fit(x, y), margins, levels)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every document's columns, and held_out, score (0 to 1) and predicted (score >= threshold).

    The model is fitted on at most train_rows labelled texts, none of them held out; ids, lang, source and labels are no
    features.  Null and empty texts have zero features and are scored like any; a null doc_id is not held out.  Columns
    of docs named held_out, score or predicted are replaced; repeated rows are scored each.
    """
    model = fit_model(*labelled_sample(docs, labels, label, folds, held_out, train_rows))

    return apply_scores(docs, lambda: model.scores, folds, held_out, threshold)
