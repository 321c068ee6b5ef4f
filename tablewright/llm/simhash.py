"""Near-duplicates by SimHash: fingerprints, links within a Hamming radius by BK-trees, components.

Links. Two 64-bit fingerprints that differ in at most r bits agree on all of at least
BANDS - r of BANDS bands, so every choice of that many bands makes a shard key, and a
shard holds the distinct fingerprints that share those bands. With 8 bands and radius 2
a shard leaves 16 bits free: it never has more than 65,536 members, however the texts
are spread. Each shard gets a BK-tree (children keyed by their integer distance to the
parent); members look for neighbours along edges within the radius only. The trees
travel to the tasks with their shards rather than as broadcasts: all trees
together grow with the corpus, so no bound for a broadcast could be shown.

A shard emits a spanning forest of its links, never all pairs, so its output is linear.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, map_rows

BANDS = 8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = hashes[at : at + (1 << 18)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, space-joined; of the whole sequence if it's shorter."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width]))
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (signed 64-bit) for each row. Lower-cases A-Z; words are split at ASCII
    white space; a text without words, null or not, has fingerprint 0."""

    def make():
        def work(columns):
            out = []
            for text in columns[1]:
                fp = fingerprint_of(shingle_hashes(text, width, seed))
                out.append(fp - (1 << 64) if fp >> 63 else fp)
            return [columns[0], out]

        return work

    return map_rows(df.select(F.col(doc_id), F.col(text)), f"`{doc_id}` {dict(df.dtypes)[doc_id]}, fp bigint", make)


def shard_keys(fp: Column, radius: int, bands: int = BANDS) -> Column:
    """An array of (choice of bands, their bits): equal in one element at least for any two
    fingerprints within the radius."""
    edges = np.linspace(0, 64, bands + 1).round().astype(int)
    keys = []
    for i, left_out in enumerate(combinations(range(bands), radius)):
        mask = reduce(lambda m, b: m & ~(((1 << int(edges[b + 1] - edges[b])) - 1) << int(edges[b])), left_out, (1 << 64) - 1)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
    return F.array(*keys)


class BKTree:
    """Nodes in flat lists; edges[n] maps an integer distance to the child at that distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of the value, new or not."""
        if not self.values:
            self.values.append(value)
            self.edges.append({})
            return 0
        n = 0
        while d := (self.values[n] ^ value).bit_count():
            child = self.edges[n].get(d)
            if child is None:
                self.edges[n][d] = child = len(self.values)
                self.values.append(value)
                self.edges.append({})
                return child
            n = child
        return n

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away: by the triangle inequality only edges from
        d - radius to d + radius can lead there."""
        found, todo = [], [0] if self.values else []
        while todo:
            n = todo.pop()
            d = (self.values[n] ^ value).bit_count()
            if d <= radius:
                found.append(n)
            edges = self.edges[n]
            if len(edges) <= 2 * radius + 1:
                todo += [c for e, c in edges.items() if d - radius <= e <= d + radius]
            else:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values of one shard."""
    tree, root, links = BKTree(), [], []

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for value in values:
        near = tree.within(value, radius)
        n = tree.add(value)
        if n == len(root):
            root.append(n)
        for m in near:
            a, b = find(n), find(m)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((tree.values[m], value))
    return links


def links(fps: DataFrame, radius: int = 2, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between the distinct values of column fp, enough to connect all that
    links within the radius connect."""
    spark = fps.sparkSession
    # few and small rows until each becomes one for each choice of bands: deal them out first
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = fps.select("fp").repartition(tasks).select("fp", F.explode(shard_keys(F.col("fp"), radius, bands)).alias("k"))
    shards = keyed.groupBy("k.choice", "k.bits").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def make():
        def work(columns):
            pairs = [p for values in columns[0] for p in forest([v & ((1 << 64) - 1) for v in values], radius)]
            back = lambda v: v - (1 << 64) if v >> 63 else v
            return [[back(min(p)) for p in pairs], [back(max(p)) for p in pairs]]

        return work

    return map_rows(shards, "a bigint, b bigint", make).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b), by
    alternating large-star and small-star rounds; each round is cut in the shared folder.
    Stars are made from minima (partial aggregates), so no neighbourhood is gathered."""
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        state = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Every row gives a row. Null ids stay null and never become a component's id unless a
    component has no other (then it is null); repeated ids are rows of their own. Texts
    without words share fingerprint 0. Other columns are dropped, whatever their names.
    """
    marks = cut(fingerprints(df, doc_id, text, width, seed).select(F.col(doc_id).alias("_id"), "fp"))
    distinct = marks.groupBy("fp").agg(F.min("_id").alias("least"))
    distinct = cut(distinct)
    # a fingerprint without links needs nothing from here on
    roots = components(links(distinct.select("fp"), radius))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(ids, "root").select("fp", "component_id")
    return (
        marks.join(of_fp, "fp", "left")
        .select(F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


#: Of a copy at Jaccard 0.8 a fingerprint of 64 bits differs in 9 to 10 bits, in 19 at most among 2,800
#: random pairs and in 14 at most in 69 pairs of the test documents.
COPY_RADIUS = 24
#: A pair at Jaccard 0.8 shares none of 20 bands of 4 least hashes once in 38,000 times, a closer one less often.
MIN_BANDS, MIN_ROWS = 20, 4


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width, seed))


def least_hashes(hashes: np.ndarray, seed: int) -> list[int]:
    """A number for each of MIN_BANDS bands of MIN_ROWS least hashes (signed 64-bit); none for no hashes."""
    import xxhash

    if not len(hashes):
        return []
    r = np.random.RandomState(seed)
    n = MIN_BANDS * MIN_ROWS
    odd, plus = (r.randint(0, 1 << 63, (n, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096] * odd + plus
        np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=1), out=least)
    bands = least.astype("<u8").reshape(MIN_BANDS, MIN_ROWS)
    return [d - (1 << 64) if (d := xxhash.xxh64_intdigest(b.tobytes())) >> 63 else d for b in bands]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def leaders(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Pairs (leader, member), the lesser id first: each (id, fingerprint), those near the fingerprints' majority
    before others, follows the first leader within the radius or becomes one, so there are fewer
    pairs than members. The text that edited copies come from is mostly nearest to their majority."""
    fps = np.array([fp for _, fp in members], np.uint64)
    ones = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    middle = int(np.packbits(2 * ones > len(members), bitorder="little").view("<u8")[0])
    tree, ids, pairs = BKTree(), [], []
    for i, fp in sorted(members, key=lambda m: ((m[1] ^ middle).bit_count(), m[0])):
        if near := tree.within(fp, radius):
            lead = ids[min(near)]
            pairs.append((min(lead, i), max(lead, i)))
        else:
            tree.add(fp)
            ids.append(i)
    return pairs


def linked(members: list[tuple[int, int, int, np.ndarray]], radius: int, least: float) -> list[tuple[int, int]]:
    """Links (lesser id, greater) that connect all of (id, fingerprint, root, set of hashes) whose roots differ, whose fingerprints
    lie within the radius and whose sets have a Jaccard similarity of ``least`` or more; fewer than members.
    A BK-tree gives the candidates, lists of the members that hold a hash their common hashes."""
    n = len(members)
    sizes = np.array([len(m[3]) for m in members])
    hashes, code = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    holders, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(hashes)))))
    own = np.split(code, np.cumsum(sizes)[:-1])
    tree, at, of, root = BKTree(), [], {}, list(range(n))
    for i, m in enumerate(members):
        of.setdefault(m[2], []).append(i)
        k = tree.add(m[1])
        if k == len(at):
            at.append([])
        at[k].append(i)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for same in of.values():
        for i in same:
            root[i] = same[0]
    most = max(of, key=lambda r: (len(of[r]), r))  # its members are found by the others
    links = []
    for i, m in enumerate(members):
        if m[2] == most:
            continue
        near = [j for k in tree.within(m[1], radius) for j in at[k] if find(j) != find(i)]
        if not near:
            continue
        if sizes[i]:
            both = np.bincount(np.concatenate([holders[starts[h] : starts[h + 1]] for h in own[i].tolist()]), minlength=n)
        else:
            both = np.zeros(n, np.int64)
        near = np.array(near)
        alike = both[near] >= least * (sizes[i] + sizes[near] - both[near])
        for j in near[alike].tolist():
            if find(i) != find(j):
                root[find(j)] = find(i)
                links.append((min(m[0], members[j][0]), max(m[0], members[j][0])))
    return links


#: Members of one band that meet in a task at most twice: larger shards are cut into blocks, and each two blocks meet.
SHARD = 4096


def near_copies(df: DataFrame, key: str, text: str = "text", width: int = 5, least: float = 0.8, radius: int = COPY_RADIUS, seed: int = 42) -> DataFrame:
    """key and root (a key of its component) for each row; the keys are bigint, not null and distinct,
    and df gives the same rows each time it's read.

    Rows are linked if the sets of their shingles of ``width`` words have a Jaccard similarity of
    ``least`` or more; texts without words are copies of each other. Candidates are fingerprints
    of the sets within the radius, found by BK-trees in shards that share a band of least hashes
    (at this radius no choice of the fingerprint's own bands bounds a shard); the similarity of
    each is then counted on the texts. The first pass follows leaders and so has fewer pairs than
    rows; the second tests all candidates that the first has not connected, so none is left out: it
    counts inside the shards, which send only links that connect.
    """

    def make():
        import xxhash

        def work(columns):
            digests, fps, bands = [], [], []
            for t in columns[1]:
                s = shingle_set(t, width, seed)
                fp = fingerprint_of(s)
                digests.append(xxhash.xxh3_128_hexdigest(s.astype("<u8").tobytes()))
                fps.append(fp - (1 << 64) if fp >> 63 else fp)
                bands.append(least_hashes(s, seed))
            return [columns[0], digests, fps, bands]

        return work

    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marks = cut(map_rows(texts, "_key bigint, digest string, fp bigint, bands array<bigint>", make))
    sets = marks.groupBy("digest").agg(F.min("_key").alias("id"))  # a row for each distinct set
    members = cut(marks.join(sets.select(F.col("id").alias("_key")), "_key", "left_semi").select(F.col("_key").alias("id"), "fp", F.posexplode("bands").alias("band", "bits")))

    unsigned = (1 << 64) - 1

    def paired(shards: DataFrame) -> DataFrame:
        def make():
            def work(columns):
                pairs = [p for shard in columns[0] for p in leaders([(m["id"], m["fp"] & unsigned) for m in shard], radius)]
                return [[a for a, _ in pairs], [b for _, b in pairs]]

            return work

        return map_rows(shards, "a bigint, b bigint", make).distinct()

    def connected(members: DataFrame) -> DataFrame:
        """Links among the members of shards with several roots, found where each two blocks of a shard meet."""

        def describe():
            def work(columns):
                return [columns[0], [shingle_set(t, width, seed).astype("<u8").tobytes() for t in columns[1]]]

            return work

        def make():
            def work(columns):
                links = []
                for shard in columns[0]:
                    links += linked([(m["id"], m["fp"] & unsigned, m["root"], np.frombuffer(m["set"], "<u8")) for m in shard], radius, least)
                return [[a for a, _ in links], [b for _, b in links]]

            return work

        asked = texts.join(members.select(F.col("id").alias("_key")).distinct(), "_key", "left_semi")
        described = cut(map_rows(asked, "id bigint, set binary", describe))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        met = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("id", "fp", "root", "band", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        shards = met.join(described, "id").groupBy("band", "bits", "lo", "hi").agg(F.collect_list(F.struct("id", "fp", "root", "set")).alias("m"), F.min("root").alias("r"), F.max("root").alias("s"))
        return map_rows(shards.where("r < s").select("m"), "a bigint, b bigint", make).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        def make():
            def work(columns):
                alike = [jaccard(shingle_set(s, width, seed), shingle_set(t, width, seed)) >= least for s, t in zip(columns[2], columns[3], strict=True)]
                return [*([x for x, y in zip(c, alike, strict=True) if y] for c in columns[:2])]

            return work

        asked = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
        few = cut(texts.join(asked, "_key", "left_semi"))
        both = pairs.join(few.toDF("a", "s"), "a").join(few.toDF("b", "t"), "b")
        return cut(map_rows(both.select("a", "b", "s", "t"), "a bigint, b bigint", make))

    n = F.count("*").over(Window.partitionBy("band", "bits"))
    # blocks of a large shard have leaders of their own here; across blocks the second pass looks
    shards = members.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(n / SHARD))).groupBy("band", "bits", "block")
    first = cut(paired(shards.agg(F.collect_list(F.struct("id", "fp")).alias("m")).where(F.size("m") > 1).select("m")))
    edges = alike(first)
    roots = components(edges)
    labelled = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = labelled.groupBy("band", "bits").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")).where("r < s").select("band", "bits", "blocks")
    second = cut(labelled.join(mixed, ["band", "bits"]))
    if not second.isEmpty():
        roots = components(edges.union(connected(second)))
    of_set = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    return marks.select("_key", "digest").join(of_set, "digest", "left").select(F.col("_key").alias(key), "root")



def brute_force(rows: list[tuple], width: int = 3, radius: int = 2, seed: int = 42) -> dict:
    """For tests: row -> (fingerprint, component) from a direct reading of the definition."""
    import xxhash

    fps = []
    for _, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[a if rows[a][0] > rows[b][0] else b] = b if rows[a][0] > rows[b][0] else a
    return {i: (f"{fps[i]:016x}", rows[find(i)][0]) for i in range(len(rows))}
