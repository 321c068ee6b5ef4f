"""Spelling variants: words one insertion, deletion or replacement apart, grouped under their commonest form.

One edit leaves one half of a word whole: where it hits the second half, the first one begins the other
word too; where it hits the first half, the second one ends it. Every word gives its two halves to Aho-Corasick
automata, each of which holds a shard of all halves. Words are scanned by the automata that may hold a half of
a near word: a word of a given length is compared with words of three lengths, whose halves it must begin
or end with, so it goes to four shards at most, instead of all of them. A hit counts if
the half stands at the right end and the lengths differ by one at most; then the rest of both words is compared.

A half that more than ``shard`` words share is dealt out to several shards by a hash of the word, to all of which the
words that begin or end with it go. Within a shard the words of a half are kept by the length of their rest and
by their rest without one character, so that a half of many words isn't compared word by word.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import bound_batches, stored
from tablewright.llm.phrases import UPPER

RUN = r"[A-Za-zÀ-ÿ]+"
#: One run in so many loses a character.
SLIP = 31
#: Words of a half up to this number are compared one by one.
FEW = 24


def runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_w: the letter runs of all texts in lower case (A-Z only), some with a character less."""
    # outer: else Spark filters by the array's size first, and works it out once more for that
    found = docs.select(F.col(doc_id).cast("string").alias("_id"), F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("_r"))
    run = F.col("_r")
    low = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))
    hashed = found.select(low.alias("_w"), F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), low).cast("binary")).alias("_h"))
    k = (F.col("_h") % F.char_length("_w")).cast("int")
    return hashed.select(F.when(F.col("_h") % SLIP == 0, F.concat(F.col("_w").substr(F.lit(1), k), F.col("_w").substr(k + 2, F.char_length("_w")))).otherwise(F.col("_w")).alias("_w"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_n: int = 2) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    words = runs(docs, doc_id, text).where(F.char_length("_w") >= least_length)
    return words.groupBy(F.col("_w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _half(word: Column, length: Column, first: bool) -> Column:
    """The half that a word of this length has in common with ``word`` where that begins or ends with it; sides
    are marked, as a half of one side is none of the other."""
    n = F.floor(length / 2).cast("int")
    return F.concat(F.lit("<"), word.substr(F.lit(1), n)) if first else F.concat(F.lit(">"), F.right(word, length - n))


def one_apart(a: str, b: str) -> bool:
    """Exactly one character inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


class Rests:
    """What follows (or precedes) one half in the words that have it."""

    def __init__(self) -> None:
        self.words: list[tuple[str, int, str]] = []  # rest, n, word
        self.by_gap: dict | None = None

    def near(self, rest: str):
        """Words whose rest is one edit away from this one: all if they are few, else those that agree with it in
        one place left out."""
        if len(self.words) <= FEW:
            return [w for w in self.words if one_apart(w[0], rest)]
        if self.by_gap is None:
            self.by_gap = defaultdict(list)
            for w in self.words:
                self.by_gap[w[0]].append(w)
                for i in range(len(w[0])):
                    self.by_gap[i, w[0][:i] + w[0][i + 1 :]].append(w)  # to be replaced at i
                    self.by_gap["-", w[0][:i] + w[0][i + 1 :]].append(w)  # to be deleted anywhere
        found = {}
        for i in range(len(rest)):
            gap = rest[:i] + rest[i + 1 :]
            for k in ((i, gap), gap):
                for w in self.by_gap.get(k, ()):
                    found[w[2]] = w
        for w in self.by_gap.get(("-", rest), ()):
            found[w[2]] = w
        return [w for w in found.values() if one_apart(w[0], rest)]


def scan_shard(table: pa.Table) -> pa.Table:
    """One shard: rows with a half are its patterns, the others the words to scan. For each scanned word with near words
    in this shard: their number and the commonest one."""
    import ahocorasick

    shard, words, ns, halves = (table.column(c).to_pylist() for c in ("shard", "word", "n", "half"))
    automaton, scanned = ahocorasick.Automaton(), {}
    for word, n, half in zip(words, ns, halves, strict=True):
        if half is None:
            scanned[word] = n
            continue
        mark, half = half[0], half[1:]
        held = automaton.get(half, None)
        if held is None:
            automaton.add_word(half, held := (len(half), {"<": Rests(), ">": Rests()}))
        held[1][mark].words.append((word[len(half) :] if mark == "<" else word[: len(word) - len(half)], n, word))
    out: list[list] = [[], [], [], []]
    if len(automaton):
        automaton.make_automaton()
        for word in scanned:
            count, best = 0, None
            for end, (size, sides) in automaton.iter(word):
                hits = []
                if end + 1 == size:  # the half begins the word
                    hits += sides["<"].near(word[size:])
                if end + 1 == len(word):  # it ends the word; found above already if the first halves agree as well
                    hits += (x for x in sides[">"].near(word[: len(word) - size]) if not word.startswith(x[2][: len(x[2]) // 2]))
                for _, n, other in hits:
                    count += 1
                    if best is None or (-n, other) < best:
                        best = (-n, other)
            if count:
                for column, x in zip(out, (word, count, -best[0], best[1]), strict=True):
                    column.append(x)
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def near_words(words: DataFrame, shard: int = 20000) -> DataFrame:
    """word, n_near, best_n, best: the number of each word's near words, and the commonest (ties: the least in
    code-point order); words without any are absent. Words have two characters or more and are distinct."""
    bound_batches(words.sparkSession)
    length = F.char_length("word")
    halves = words.select("word", "n", F.explode(F.array(_half(F.col("word"), length, True), _half(F.col("word"), length, False))).alias("half"))
    shards = max(1, -(-2 * words.count() // shard))
    # halves of more words than a shard holds: no more than there are shards
    crowded = stored(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard).select("half", F.ceil(F.col("c") / shard).cast("int").alias("ways")), "crowded")
    possible = F.array_distinct(F.array(*(_half(F.col("word"), length + d, first) for first in (True, False) for d in (-1, 0, 1))))
    scans = words.select("word", "n", F.explode(possible).alias("half"))
    if crowded.isEmpty():
        halves, scans = halves.withColumn("way", F.lit(0)), scans.withColumn("way", F.lit(0))
    else:
        ways = F.coalesce("ways", F.lit(1))
        halves = halves.join(crowded, "half", "left").withColumn("way", F.pmod(F.xxhash64("word"), ways).cast("int")).drop("ways")
        scans = scans.join(crowded, "half", "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
    number = F.pmod(F.xxhash64("half", "way"), F.lit(shards)).alias("shard")
    rows = halves.select(number, "word", "n", "half").union(scans.select(number, "word", "n", F.lit(None).cast("string").alias("half")).distinct())
    found = rows.groupBy("shard").applyInArrow(scan_shard, "word string, near bigint, best_n bigint, best string")
    best = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(best).alias("_b")).select("word", "n_near", (-F.col("_b.n")).alias("best_n"), F.col("_b.w").alias("best"))


def roots(edges: DataFrame) -> DataFrame:
    """word, root: from each word on by its form until a word has none. A form is ``ratio`` times as frequent as its
    word, so chains have no circle and end after as many steps as the largest count has digits to that base. Only words whose chain
    isn't at its end take part in a step."""
    edges = stored(edges, "forms")
    step = edges.select(F.col("word").alias("at"), F.col("form").alias("next"))
    now, done = edges.select("word", F.col("form").alias("at")), None
    while True:
        moved = stored(now.join(step, "at", "left"), "chains")
        ended = moved.where("next is null").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.union(ended)
        now = moved.where("next is not null").select("word", F.col("next").alias("at"))
        if now.isEmpty():
            return done


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = 10, least_length: int = 7, least_n: int = 2, shard: int = 20000) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``least_length`` letters or more that occurs ``least_n`` times.

    form is the near word with the largest n, if that is ``ratio`` times the word's own or more; root is where forms lead in the end, the
    word itself without one. Null and empty texts have no words, a null id counts as an empty one; rows with repeated ids
    count each; other columns are dropped, whatever their names. Without words there are no rows.
    """
    if ratio < 2 or least_length < 2:
        raise ValueError("ratio and least_length are 2 or more")
    words = stored(vocabulary(docs, doc_id, text, least_length, least_n), "words")
    near = words.join(near_words(words, shard), "word", "left")
    has = F.col("best_n") >= F.col("n") * ratio
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(rows: list[tuple], ratio: int = 10, least_length: int = 7, least_n: int = 2) -> list[tuple]:
    """For tests: the same from (doc_id, text), each word compared with each."""
    import re
    import zlib
    from collections import Counter

    n: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_n}
    letters = {c for x in words for c in x}

    def edits(w):
        return ({w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1)}) - {w}

    near = {w: [x for x in edits(w) if x in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out
