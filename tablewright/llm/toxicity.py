"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Lexicons are terms (words and word beginnings, after undoing look-alike spellings) that labelled
rows with 1 hold far more often than the others, in two strengths. Trees grow over densities
of the lexicons, their nearness to second-person words, capitals, punctuation and disguised
spellings; an isotonic fit turns the trees' margin into a share.

The three are cross-fitted, in the same way at every size: the sample falls into FOLDS folds, alike in
both labels. A row's features for training come from lexicons of the other folds, its margin
for calibration from trees of the other folds. The model that scores has the lexicons and
trees of all folds. Texts stay with the workers: the driver holds term counts and features.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, held_out, map_rows

#: Words that address the reader, in the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ya du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tus tuyo usted ustedes vosotros os".split())
#: Characters that stand for letters in disguised spellings.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = string.punctuation + "…“”‘’«»¡¿–—·"
INNER = re.compile(r"(?<=\w)[\W_]+(?=\w)")
SHORTEST, LONGEST = 4, 6  # of word beginnings
NEAR = 6

FEATURES = ("strong_density", "weak_density", "log_strong", "log_weak", "strong_share_max", "near_second_person", "second_person_density", "capital_share", "capital_words", "mark_density", "bang_density", "disguised_density", "disguised_hits", "log_words")


def folded(word: str) -> tuple[str, bool]:
    """Lower case without disguise, and whether there was one inside the word."""
    low = word.lower().strip(EDGE)
    if low.isalpha():
        return low, False
    out = INNER.sub("", low.translate(LOOKALIKE))
    return out, out != low and not low.replace(".", "").replace(",", "").isdigit()


def terms_of(text: str | None, known: dict | None = None) -> set[str]:
    """Words and word beginnings; ``known`` remembers the terms of words met before."""
    known = {} if known is None else known
    out: set[str] = set()
    for w in set((text or "").split()):
        t = known.get(w)
        if t is None:
            f, _ = folded(w)
            t = (f, *(f[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(f)) + 1)))
            if len(w) <= 40 and len(known) < 200_000:
                known[w] = t
        out.update(t)
    out.discard("")
    return out


class _Words(dict):
    """word -> class: 2 strong, 1 weak, +4 second person, +8 disguised, +16 all capitals."""

    def __init__(self, strong: frozenset, weak: frozenset) -> None:
        super().__init__()
        both = dict.fromkeys(weak, 1) | dict.fromkeys(strong, 2)
        self.whole = {t: c for t, c in both.items() if not t.endswith("*")}
        self.begin = {t[:-1]: c for t, c in both.items() if t.endswith("*")}
        self.roots = {t[:SHORTEST] for t in self.begin}

    def __missing__(self, word: str) -> int:
        f, disguised = folded(word)
        begin, c = self.begin, self.whole.get(f, 0)
        if f[:SHORTEST] in self.roots:
            for n in range(SHORTEST, LONGEST + 1):
                c = max(c, begin.get(f[:n], 0))
        if f in SECOND_PERSON:
            c += 4
        if disguised:
            c += 8
        if word.isupper() and len(f) > 1:
            c += 16
        if len(self) >= 100_000:
            self.clear()
        if len(word) <= 40:
            self[word] = c
        return c


def features_of(text: str | None, classes: _Words) -> list[float]:
    """In the order of FEATURES; all 0 for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    c = np.fromiter(map(classes.__getitem__, words), np.int64, n)
    strong, weak = np.flatnonzero(c & 2), int((c & 1).sum())
    second = np.flatnonzero(c & 4)
    near = 0
    if len(strong) and len(second):
        at = np.searchsorted(second, strong)
        left = strong - second[np.maximum(at - 1, 0)]
        right = second[np.minimum(at, len(second) - 1)] - strong
        near = int((((left > 0) & (left <= NEAR)) | ((right > 0) & (right <= NEAR))).sum())
    most = 0.0
    if len(strong):  # densest stretch of 50 words
        ends = np.searchsorted(strong, strong + 50)
        most = float((ends - np.arange(len(strong))).max()) / min(n, 50)
    data = text.encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    letters = max(1, len(text) - text.count(" ") - marks)
    bangs = data.count(b"!") + data.count(b"?")
    hidden = c & 8
    return [len(strong) / n, weak / n, math.log1p(len(strong)), math.log1p(weak), most, near / n, len(second) / n, capitals / letters, float((c & 16).astype(bool).mean()), marks / len(text), bangs / len(text), float(hidden.astype(bool).mean()), float(((hidden > 0) & ((c & 3) > 0)).sum()) / n, math.log1p(n)]


FOLDS = 5
LEAST_ODDS, STRONG_ODDS = 0.7, 2.5
LEAST_ROWS = 3  # with label 1 that hold a term


def _low(p, n, of_p, of_n, ln, sqrt):
    """Lower bound of the log odds of a term that p of ``of_p`` and n of ``of_n`` rows hold."""
    return ln((p + 0.5) / (of_p + 1)) - ln((n + 0.5) / (of_n + 1)) - 1.64 * sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def grow_lexicons(terms: list[str], p: np.ndarray, n: np.ndarray, of_p: int, of_n: int, most: int = 4000) -> tuple[frozenset, frozenset]:
    """Strong and weak terms by the lower bound of their log odds; p and n are the rows with label
    1 and 0 that hold each term. The ``most`` that tell most rows apart count, ties in term order."""
    if not of_p or not of_n or not len(terms):
        return frozenset(), frozenset()
    low = _low(p, n, of_p, of_n, np.log, np.sqrt)
    worth = low * np.sqrt(p)
    fit = [i for i in np.flatnonzero((p >= LEAST_ROWS) & (low > LEAST_ODDS)).tolist()]
    fit.sort(key=lambda i: (-worth[i], terms[i]))
    least = max(4, 0.01 * of_p)
    strong = {i for i in fit[:most] if low[i] > STRONG_ODDS and p[i] >= least}
    return frozenset(terms[i] for i in strong), frozenset(terms[i] for i in fit[:most] if i not in strong)


def _term_counts(sample: DataFrame, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Terms and how many rows hold each, by fold and label (an array terms x FOLDS x 2), for terms that
    belong to the lexicon of all folds or of all but one. What reaches the driver is bounded by
    the sample's terms of that kind."""

    def make():
        known: dict = {}

        def work(columns):
            seen: Counter = Counter()
            for fold, label, text in zip(*columns, strict=True):
                seen.update((t, 2 * fold + label) for t in terms_of(text, known))
            return [[t for t, _ in seen], [c for _, c in seen], list(seen.values())]

        return work

    counted = map_rows(sample.select("fold", "label", "text"), "term string, cell int, n int", make)
    by_term = counted.groupBy("term").agg(*(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)))
    zero, one = (reduce(lambda a, b: a + b, (F.col(f"c{2 * k + label}") for k in range(FOLDS))) for label in (0, 1))
    fits = F.lit(False)
    for k in (None, *range(FOLDS)):
        p, n = (one, zero) if k is None else (one - F.col(f"c{2 * k + 1}"), zero - F.col(f"c{2 * k}"))
        of_n, of_p = (sizes.sum(axis=0) - (0 if k is None else sizes[k])).tolist()
        fits |= (p >= LEAST_ROWS) & (_low(p, n, of_p, of_n, F.log, F.sqrt) > LEAST_ODDS - 0.001)
    rows = by_term.where(fits).collect()
    rows.sort(key=lambda r: r["term"])
    return [r["term"] for r in rows], np.array([list(r)[1:] for r in rows], float).reshape(-1, FOLDS, 2)


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, by histograms; depth-limited."""

    start: float = 0.0
    rate: float = 0.1
    trees: list[list[tuple]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, bins: int = 48, least: int = 8, ridge: float = 1.0) -> Trees:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            nodes: list[tuple] = []
            out = np.zeros(len(y))
            self._split(codes, edges, g, h, np.arange(len(y)), depth, least, ridge, nodes, out)
            self.trees.append(nodes)
            margin += self.rate * out
        return self

    def _split(self, codes, edges, g, h, rows, depth, least, ridge, nodes, out) -> int:
        me = len(nodes)
        value = float(-g[rows].sum() / (h[rows].sum() + ridge))
        nodes.append((-1, 0.0, -1, -1, value))
        best = None
        if depth and len(rows) >= 2 * least:
            G, H, whole = g[rows].sum(), h[rows].sum(), None
            whole = G * G / (H + ridge)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, k]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j = int(gain.argmax())
                if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                    best = (gain[j], k, j)
        if best is None:
            out[rows] = value
            return me
        _, k, j = best
        left = codes[rows, k] <= j
        a = self._split(codes, edges, g, h, rows[left], depth - 1, least, ridge, nodes, out)
        b = self._split(codes, edges, g, h, rows[~left], depth - 1, least, ridge, nodes, out)
        nodes[me] = (k, float(edges[k][j]), a, b, value)
        return me

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            f = np.array([n[0] for n in nodes])
            t = np.array([n[1] for n in nodes])
            a = np.array([n[2] for n in nodes])
            b = np.array([n[3] for n in nodes])
            v = np.array([n[4] for n in nodes])
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at], a[at], b[at])
                at = np.where(inner, go, at)
            total += self.rate * v[at]
        return total


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit (pool adjacent violators) of y to the margin."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least margin, largest margin
    for m, v in zip(margin[order], y[order], strict=True):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, n, lo, hi in blocks:
        p = s / n
        xs += [lo, hi] if hi > lo else [lo]
        ys += [p, p] if hi > lo else [p]
    return xs, ys


@dataclass
class Model:
    prior: float
    strong: frozenset = frozenset()
    weak: frozenset = frozenset()
    trees: Trees | None = None
    knots: tuple[list[float], list[float]] = ((), ())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a small share of the trees' own keeps the order inside steps."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        m = self.trees.margin(x)
        own = 1 / (1 + np.exp(-m))
        if not self.knots[0]:
            return np.clip(own, 0, 1)
        step = np.interp(m, *self.knots)
        # strictly between 0 and 1 and on the same side of one half as the calibrated value
        return np.where(step >= 0.5, np.maximum(0.5, 0.98 * step + 0.02 * own), np.minimum(np.nextafter(0.5, 0), 0.98 * step + 0.02 * own))


def _folded_sample(documents: DataFrame, labels: DataFrame, sample: int, label: str) -> DataFrame:
    """doc_id, label, fold and text of the rows to learn from, a row for each document."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    few = few.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample)
    few = few.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id")) % FOLDS).cast("int")).drop("_h")
    texts = documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 12_000, label: str = "toxic") -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fifth, those with the least
    hash of their id, by their whole texts. Rows with a null id or label teach nothing; a null text is an
    empty one; of a document with several labels the greatest counts, of one with several texts the
    least, so the order of rows decides nothing. With fewer than 5 of either label every score is
    their share (0 without any). The driver holds a number for each term and 14 for each row of the sample."""
    rows = cut(_folded_sample(documents, labels, sample, label))
    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "label").count().collect():
        sizes[r["fold"], r["label"]] = r["count"]
    of_n, of_p = sizes.sum(axis=0).tolist()
    if min(of_n, of_p) < FOLDS:
        return Model(of_p / max(1.0, of_n + of_p))
    terms, held = _term_counts(rows, sizes)
    rest = lambda x, k: x.sum(axis=-2) - (0 if k is None else x[..., k, :])
    lexicons = [grow_lexicons(terms, rest(held, k)[:, 1], rest(held, k)[:, 0], rest(sizes, k)[1], rest(sizes, k)[0]) for k in (*range(FOLDS), None)]
    shared = rows.sparkSession.sparkContext.broadcast(lexicons[:FOLDS])

    def make():
        classes = [_Words(*x) for x in shared.value]

        def work(columns):
            return [*columns[:3], [features_of(t, classes[k]) for k, t in zip(columns[2], columns[3], strict=True)]]

        return work

    described = map_rows(rows.select("doc_id", "label", "fold", "text"), f"doc_id {dict(rows.dtypes)['doc_id']}, label int, fold int, x array<double>", make)
    got = sorted(described.collect(), key=lambda r: r["doc_id"])
    x, y, fold = np.array([r["x"] for r in got]), np.array([r["label"] for r in got], float), np.array([r["fold"] for r in got])
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(float(y.mean()), *lexicons[FOLDS], Trees().fit(x, y), isotonic(margin, y))


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score and predicted for each row. Null and empty texts are scored as
    texts without words. Other columns are dropped, whatever their names."""
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        classes = _Words(m.strong, m.weak)

        def work(columns):
            x = np.array([features_of(t, classes) for t in columns[-1]])
            s = m.scores(x)
            return [*columns[:-1], s.tolist(), (s >= 0.5).astype(int).tolist()]

        return work

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double, predicted int"])
    return map_rows(df.select(*(F.col(k) for k in keep), F.col(text).alias("_text")), schema, make)
