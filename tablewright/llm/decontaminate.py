"""Benchmark passages in documents: a prefix-filtered set join, verified word for word.

Every run of ``width`` consecutive item words is a window (a shorter item is one window
of its own length). A window's words are ordered by how rare they are in the documents;
to hold the whole window a document must hold its rarest word (the prefix of a
containment of 1), and at the window's offset from where the window would begin. A
document word that is some window's prefix word gives start positions; those that
would reach beyond either end fall to the length bound; the second-rarest word has to
stand at its own offset (positional bound); what remains is compared word for word.

The window table goes to the tasks as a broadcast of at most ``block_bytes`` of window text, item ids and
bookkeeping for each of both (in a worker some four times that, as Python's tuples and dicts); a larger
benchmark, a larger item, or a window of very many items is taken in blocks of that size, each
against all documents, and the blocks' hits are merged for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import cut, map_rows

#: Letters A-Z fall to a-z; all other ASCII but letters and digits separates words.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def rarity(docs: DataFrame, vocabulary, text: str) -> dict[bytes, int]:
    """How often each word of the (broadcast) vocabulary occurs in all documents: one number
    for each of its words reaches the driver."""

    def make():
        known = vocabulary.value

        def work(columns):
            seen: Counter = Counter()
            for t in columns[0]:
                seen.update(w for w in words_of(t) if w in known)
            return [list(seen), list(seen.values())]

        return work

    counted = map_rows(docs.select(F.col(text)), "word binary, n bigint", make).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def index_of(windows: dict[tuple[bytes, ...], set], counts: dict[bytes, int]) -> dict:
    """prefix word -> offset, length, and the second-rarest word with its offset -> window -> items."""
    index: dict = defaultdict(lambda: defaultdict(dict))
    for w, items in windows.items():
        order = sorted(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        a, b = order[0], order[min(1, len(w) - 1)]
        index[w[a]][a, len(w), b, w[b]][w] = items
    return {word: [(*key, ws) for key, ws in groups.items()] for word, groups in index.items()}


def occurrences(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    """Spans (from, to) of the windows that occur, and their items."""
    spans, items, n = [], set(), len(words)
    for p in [i for i, w in enumerate(words) if w in index]:
        for offset, length, other_at, other, found in index[words[p]]:
            start = p - offset
            if start >= 0 and start + length <= n and words[start + other_at] == other:
                got = found.get(tuple(words[start : start + length]))
                if got is not None:
                    spans.append((start, start + length))
                    items |= got
    return spans, items


#: Bookkeeping of a window and of an id in it, as counted against a block.
WINDOW_BYTES, ID_BYTES = 200, 80


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_bytes: int):
    """Window tables of bounded size, from a driver that holds one block at a time. Windows and the ids of their items count, so a
    window that many items share goes on in the next block with the ids that are left."""
    block: dict = {}
    size = 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        for w in windows_of(words_of(row["t"]), width):
            if size >= block_bytes:
                yield block
                block, size = {}, 0
            items = block.get(w)
            if items is None:
                items = block[w] = set()
                size += sum(map(len, w)) + WINDOW_BYTES
            if row["i"] not in items:
                items.add(row["i"])
                size += len(row["i"]) + ID_BYTES
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (from, to in words).

    Null texts have no words and null item ids no windows; rows with null or repeated ids are
    kept, a row for each row; other columns are dropped, whatever their names. Without
    items nothing is contaminated. Items that share an id count once.
    """
    spark: SparkSession = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found_schema = f"_id {kind}, n_words bigint, spans array<array<int>>, items array<string>"
    schema = f"`{doc_id}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<array<int>>"

    def digest(n: list, spans: list, items: list) -> list[list]:
        hit = [sum(b - a for a, b in s) for s in spans]
        return [n, hit, list(map(len, items)), [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], [h > 0 for h in hit], spans]

    def against(windows: dict, keyed: DataFrame, out: str, final: bool) -> DataFrame:
        vocabulary = spark.sparkContext.broadcast(frozenset(x for w in windows for x in w))
        index = spark.sparkContext.broadcast(index_of(windows, rarity(plain, vocabulary, "_text") if windows else {}))

        def make():
            table = index.value

            def work(columns):
                n, spans, items = [], [], []
                for t in columns[-1]:
                    words = words_of(t)
                    s, i = occurrences(words, table)
                    n.append(len(words))
                    spans.append(_merged(s))
                    items.append(sorted(i))
                return [*columns[:-1], *(digest(n, spans, items) if final else (n, spans, items))]

            return work

        return map_rows(keyed, out, make)

    blocks = _blocks(benchmark, item_id, item_text, width, block_bytes)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        return against(first, plain, schema, True)
    # rows get a number to merge by; cut, as it must be the same for every block
    keyed = cut(plain.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text"))
    parts = None
    for b in (first, second, *blocks):
        part = cut(against(b, keyed, "_row bigint, " + found_schema, False))
        parts = part if parts is None else parts.union(part)
    found = parts.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).drop("_row")

    def finish():
        def work(columns):
            ids, n, spans, items = columns
            return [ids, *digest(n, [_merged([tuple(x) for x in s or []]) for s in spans], [sorted(set(i or [])) for i in items])]

        return work

    return map_rows(found, schema, finish)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """For tests: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pat.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = [(w[i : i + width], str(k)) for k, t in items if k is not None for w in [split(t)] if w for i in range(max(1, len(w) - width + 1))]
    out = []
    for k, t in docs:
        w, hit, got = split(t), set(), set()
        for win, item in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    got.add(item)
        out.append((k, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
