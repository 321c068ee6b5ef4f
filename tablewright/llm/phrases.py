"""Collocations: phrases that occur together far more often than their parts let expect.

The runs of 1 to ``max_n`` words inside a piece become rows, which are counted per language with partial sums, one
length after the other: a run is a row only if the two runs of one word less in it occurred often enough, as it can't do so itself
otherwise. That is looked up in a bitmap of hashes of fixed size, in which a chance hit lets a row
pass that is counted and dropped later, so counts are exact whatever the bitmap holds. A phrase's count is joined to those of its two parts at each
cut, the score is exact (decimal) arithmetic, phrases that a phrase of one word more explains are taken out by an anti-join,
and the best of each language are ranked in two steps, so that no task holds a whole language.

Counts of parts are looked up by an ordinary join, but for those of parts that make up a thousandth or
more of all words: there are at most 1,000 of a length, so these few travel to the rows instead of the
rows of "the" meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A part is frequent from this share of all words on.
FREQUENT = 1000
#: Bits of the bitmap of frequent runs: 8 MB, whatever the corpus.
BITS = 1 << 26
#: Rows of a language are ranked in so many portions first.
PORTIONS = 64


def lower_az(text: Column) -> Column:
    """A-Z to a-z, all else as it is; lower() where the text is ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def positions(docs: DataFrame, n: int, lang: str, text: str) -> DataFrame:
    """_lang and _w0 to _w{n-1}: a row for each word with those after it, null beyond the end of its piece."""
    # outer: else Spark filters by the arrays' sizes first, and works them out once more for that
    plain = F.replace(lower_az(F.col(text)), F.lit("\t"), F.lit(" "))
    pieces = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.explode_outer(F.split(plain, r"[.,;:!?\x0A-\x0D]")).alias("_piece"))
    words = pieces.select("_lang", F.array_remove(F.split("_piece", " "), "").alias("_w"))
    at = words.select("_lang", "_w", F.explode_outer(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))).alias("_i"))
    return at.select("_lang", *(F.get("_w", F.col("_i") + k).alias(f"_w{k}") for k in range(n))).where(f"_w{n - 1} is not null")


def _bit(*words: Column) -> Column:
    """Where the run stands in the bitmap."""
    return F.xxhash64("_lang", F.concat_ws(" ", *words)).bitwiseAND(BITS - 1)


def bitmap(runs: DataFrame) -> DataFrame:
    """_slot and _bits, BITS / 64 rows at most, of the phrases in ``runs`` (_lang, _phrase)."""
    at = runs.select(_bit(F.col("_phrase")).alias("_at"))
    return at.groupBy(F.shiftright("_at", 6).alias("_slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))


def _in(rows: DataFrame, words: list[str], often: DataFrame) -> DataFrame:
    at = _bit(*map(F.col, words))
    rows = rows.withColumn("_at", at).withColumn("_slot", F.shiftright("_at", 6))
    return rows.join(F.broadcast(often), "_slot").where(F.expr("shiftright(_bits, cast(_at & 63 as int)) & 1 = 1")).drop("_slot", "_bits", "_at")


def counts(docs: DataFrame, max_n: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """_lang, _phrase, _f and _k (words in it): all words, and the longer runs that occur ``least`` times or more."""
    out = before = None
    for n in range(1, max_n + 1):
        rows, names = positions(docs, n, lang, text), [f"_w{k}" for k in range(n)]
        if n > 1:
            often = bitmap(before.where(F.col("_f") >= least))
            rows = _in(_in(rows, names[:-1], often), names[1:], often)
        found = rows.groupBy("_lang", F.concat_ws(" ", *names).alias("_phrase")).agg(F.count(F.lit(1)).alias("_f"))
        before = stored((found if n == 1 else found.where(F.col("_f") >= least)).withColumn("_k", F.lit(n)), f"runs{n}")
        out = before if out is None else out.unionByName(before)
    return out


def looked_up(rows: DataFrame, part: str, table: DataFrame, frequent: DataFrame, out: str) -> DataFrame:
    """rows with the count of the phrase in column ``part``; every such phrase is in the table."""
    f = frequent.select("_lang", F.col("_phrase").alias(part), F.col("_f").alias("_often"))
    r = table.select("_lang", F.col("_phrase").alias(part), F.col("_f").alias("_seldom"))
    rows = rows.join(F.broadcast(f), ["_lang", part], "left")
    # a frequent part gets a key of its own from the row, so that its rows stay spread
    rows = rows.withColumn("_key", F.when(F.col("_often").isNull(), F.col(part)).otherwise(F.concat(F.lit("\n"), F.col("_phrase"))))
    return rows.join(r.withColumnRenamed(part, "_key"), ["_lang", "_key"], "left").withColumn(out, F.coalesce("_often", "_seldom")).drop("_often", "_seldom", "_key")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, explained: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``max_n`` words of each language.

    a is the phrase's count (``least`` or more), l and r those of its two parts at the lowest-scoring cut
    (ties: the earliest), n the language's words, score floor(1000000 a a / (l r)). A phrase goes if a longer one
    that holds it has ``explained`` percent of its count or more; as counts fall with length, one word more
    is enough to look at. A null language is ``und``, a null or empty text has no words; rows with null or repeated ids
    count each, as ids aren't read; other columns are dropped, whatever their names. Without words there are no rows.
    """
    if max_n < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    table = counts(docs, max_n, least, lang, text)
    n_words = table.where("_k = 1").groupBy("_lang").agg(F.sum("_f").alias("_n"))
    total = n_words.agg(F.sum("_n")).first()[0] or 0
    parts = table.where(F.col("_k") < max_n)
    frequent = parts.where(F.col("_f") * FREQUENT >= max(total, 1))  # at most FREQUENT of a length
    found = table.where("_k > 1")

    split = F.split("_phrase", " ")
    join = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    longer = found.where("_k > 2")
    longer = longer.select("_lang", "_f", F.explode(F.array_distinct(F.array(join(F.lit(1), F.col("_k") - 1), join(F.lit(2), F.col("_k") - 1)))).alias("_phrase"))
    longer = longer.groupBy("_lang", "_phrase").agg(F.max("_f").alias("_longer"))
    kept = found.join(longer, ["_lang", "_phrase"], "left").where(~F.coalesce(F.col("_longer") * 100 >= F.col("_f") * explained, F.lit(False))).drop("_longer")

    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("cast((cast(_f as decimal(15,0)) * cast(_f as decimal(15,0)) * 1000000) div (cast(_l as decimal(15,0)) * cast(_r as decimal(15,0))) as bigint)")
    scored = None
    for k in range(1, max_n):
        at_cut = kept.where(F.col("_k") > k).withColumns({"_left": join(F.lit(1), F.lit(k)), "_right": join(F.lit(k + 1), F.col("_k") - k)})
        at_cut = looked_up(looked_up(at_cut, "_left", parts, frequent, "_l"), "_right", parts, frequent, "_r")
        at_cut = at_cut.select("_lang", "_phrase", "_f", F.struct(score.alias("score"), F.lit(k).alias("k"), F.col("_l").alias("l"), F.col("_r").alias("r")).alias("_cut"))
        scored = at_cut if scored is None else scored.union(at_cut)
    best = scored.groupBy("_lang", "_phrase", "_f").agg(F.min("_cut").alias("_cut")) if max_n > 2 else scored
    best = best.select("_lang", "_phrase", "_f", "_cut.score", "_cut.l", "_cut.r", F.pmod(F.xxhash64("_phrase"), F.lit(PORTIONS)).alias("_portion"))

    order = [F.desc("score"), F.desc("_f"), F.asc("_phrase")]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("_lang", "_portion").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    ranked = ranked.join(n_words, "_lang")
    return ranked.select(F.col("_lang").alias("lang"), "rank", F.col("_phrase").alias("phrase"), F.col("_f").alias("a"), "l", "r", F.col("_n").alias("n"), "score")


def brute_force(rows: list[tuple], max_n: int = 3, least: int = 10, explained: int = 50, top: int = 2000) -> list[tuple]:
    """For tests: the same rows from (lang, text)."""
    import re
    from collections import Counter

    f: Counter = Counter()
    for lang, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, max_n + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    n: Counter = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    best = []
    often = [(lang, q, c) for (lang, q), c in f.items() if c >= least and len(q) > 2]
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = [c for other, q, c in often if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * c >= explained * a for c in inside):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        best.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, at = [], Counter()
    for lang, score, a, p, left, right in sorted(best):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


#: The same in DuckDB SQL, over the table documents.
ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), i AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p FROM i, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w)
), f AS MATERIALIZED (
    SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL
), c AS MATERIALIZED (
    SELECT lang, k, p, string_split(p, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10
), inside AS (
    SELECT lang, array_to_string(list_slice(w, t, t + 1), ' ') AS p, a FROM c, (VALUES (1), (2)) AS ts(t) WHERE k = 3
), dropped AS MATERIALIZED (
    SELECT c.lang, c.p FROM c JOIN inside AS q ON q.lang = c.lang AND q.p = c.p GROUP BY ALL HAVING 100 * max(q.a) >= 50 * max(c.a)
), parts AS (
    SELECT lang, p, a, t, array_to_string(list_slice(w, 1, t), ' ') AS x, array_to_string(list_slice(w, t + 1, k), ' ') AS y
    FROM c ANTI JOIN dropped USING (lang, p), (VALUES (1), (2)) AS ts(t) WHERE t < k
), best AS (
    SELECT parts.*, x.f AS l, y.f AS r, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS score,
           row_number() OVER (PARTITION BY parts.lang, parts.p ORDER BY (1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f), t) AS first
    FROM parts JOIN f AS x ON x.lang = parts.lang AND x.p = parts.x JOIN f AS y ON y.lang = parts.lang AND y.p = parts.y
), ranked AS (
    SELECT lang, p AS phrase, a, l, r, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank
    FROM best WHERE first = 1
)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) AS n ON n.lang = ranked.lang WHERE rank <= 2000
"""
