"""Quality rules: a learned decision list over text statistics.

Sequential covering on a bounded sample of labelled rows: while rejects are left to
cover, a rule is grown (the threshold test that most raises FOIL gain on the grow part is
added until no reject-free test helps), pruned (last tests are dropped while that raises
(p - n) / (p + n) on the prune part) and kept if its precision there is at least
``precision``. The rules become ordered Spark conditional expressions over the columns
of ``statistics``, so applying them needs no model in the workers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
MARKS = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~"

#: Ratios that rules may test, by name; each is an expression over the counted columns.
RATIOS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(n_letters, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeat_words(words: list, width: int = 5) -> int:
    """Words inside runs of ``width`` words that occur twice or more, first ones included."""
    if len(words) <= width:
        return 0
    runs = list(zip(*(words[i:] for i in range(width)), strict=False))
    first, again = {}, set()
    for i, r in enumerate(runs):
        j = first.setdefault(r, i)
        if j != i:
            again.add(i)
            again.add(j)
    if not again:
        return 0
    total, end = 0, 0
    for i in sorted(again):
        total += i + width - max(i, end)
        end = i + width
    return total


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set = set()
    dup = lines = 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    word_chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    marks = len(data) - len(data.translate(None, MARKS))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return len(words), word_chars, symbols, dup, repeat_words(words), lines, capitals, capitals + small, marks, digits, len(set(words))


COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks", "n_digits", "n_distinct")


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the counts of COUNTED for each row. Words are runs of anything but
    ASCII white space; a null text has none. Other columns are dropped, whatever their names."""
    kinds = dict(df.dtypes)

    def make():
        def work(columns):
            counts = [counts_of(t) for t in columns[-1]]
            return [*columns[:-1], *(list(c) for c in zip(*counts, strict=True))]

        return work

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{c} bigint" for c in COUNTED)])
    return map_rows(df.select(*(F.col(k) for k in keep), F.col(text).alias("_text")), schema, make)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(RATIOS).index(self.name)]
        return v > self.limit if self.above else v <= self.limit


Rule = tuple[Test, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, most_tests: int, cutpoints: int) -> Rule:
    rule: Rule = ()
    here = np.ones(len(x), bool)
    while len(rule) < most_tests:
        p0, n0 = int(y[here].sum()), int((~y[here]).sum())
        if n0 == 0 or p0 == 0:
            break
        best, gain0 = None, 1e-9
        for k, name in enumerate(RATIOS):
            v = x[:, k]
            for limit in np.unique(np.quantile(v[here], np.linspace(0, 1, cutpoints))):
                for above in (True, False):
                    c = here & ((v > limit) if above else (v <= limit))
                    p, n = int((c & y).sum()), int((c & ~y).sum())
                    if p < 2 or p + n == p0 + n0:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > gain0:
                        best, gain0 = Test(name, above, float(limit)), gain
        if best is None:
            break
        rule = (*rule, best)
        here &= best.holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    c = covered(rule, x)
    p, n = int((c & y).sum()), int((c & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _centred(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The same tests with each limit moved to the middle of the gap between the kept rows on its far side and all but the
    last hundredth of the rejects that it covers, so that a rule doesn't hug the rows it was grown on."""
    out = list(rule)
    k = list(RATIOS)
    for i, t in enumerate(rule):
        v = x[:, k.index(t.name)]
        rest = covered(tuple(r for j, r in enumerate(out) if j != i), x)
        inside, outside = v[rest & t.holds(x) & y], v[rest & ~t.holds(x) & ~y]
        if len(inside) and len(outside):
            near, far = (np.quantile(inside, 0.01), outside.max()) if t.above else (np.quantile(inside, 0.99), outside.min())
            if (near > far) == t.above and near != far:
                out[i] = Test(t.name, t.above, float((near + far) / 2))
    return tuple(out)


def learn(x: np.ndarray, rejected: np.ndarray, precision: float = 0.95, most_rules: int = 12, most_tests: int = 3, cutpoints: int = 48) -> list[Rule]:
    """Ordered rules that reject; empty where there is too little to learn from. Row order
    decides which third of the rows prunes, so callers give rows in a fixed order."""
    part = np.arange(len(x)) % 3
    gx, gy, px, py = x[part != 0], rejected[part != 0], x[part == 0], rejected[part == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules and gy.sum() >= 4:
        rule = _grow(gx, gy, most_tests, cutpoints)
        while len(rule) > 1 and _worth(rule[:-1], px, py) >= _worth(rule, px, py):
            rule = rule[:-1]
        if not rule:
            break
        c, g = covered(rule, px), covered(rule, gx)
        p, n = int((c & py).sum() + (g & gy).sum()), int((c & ~py).sum() + (g & ~gy).sum())
        if p < 5 or p / (p + n) < precision or (c.any() and (c & py).sum() < precision * c.sum() - 1):
            break
        rule = _centred(rule, np.concatenate((gx, px)), np.concatenate((gy, py)))
        c, g = covered(rule, px), covered(rule, gx)
        rules.append(rule)
        gx, gy, px, py = gx[~g], gy[~g], px[~c], py[~c]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """First rule that holds decides; kept where none does. An ordered CASE."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 12_000, label: str = "quality") -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, those with the least hash of their id;
    0 marks a reject. Rows with a null id, label or text teach nothing; of a document with several labels
    the least counts, of one with several texts that with the least statistics. Rows are learnt
    from in the order of the hash, so neither their order nor a pattern in the ids decides anything."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label")).withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id").limit(sample)
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    counted = statistics(texts.join(F.broadcast(few), "doc_id"), "text", ("doc_id", "label", "hash"))
    ratios = F.struct(base_failed().alias("base"), *(F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()))
    rows = counted.groupBy("hash", "doc_id", "label").agg(F.min(ratios).alias("x")).where("not x.base").collect()  # base rules go first anyway
    rows.sort(key=lambda r: (r["hash"], r["doc_id"]))
    if not rows:
        return []
    return learn(np.array([[r["x"][n] for n in RATIOS] for r in rows], float), np.array([r["label"] == 0 for r in rows]))


def apply(df: DataFrame, rules: list[Rule], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, base_failed and kept for each row of df, one row for each."""
    return statistics(df, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
