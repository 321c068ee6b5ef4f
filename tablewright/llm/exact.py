"""Exact duplicates by chunk recipes: DataFrame functions only.

A text (white space brought to single spaces) is cut where its content says so: after a clause whose hash is zero in
its last bits. Distinct chunks, compared as a whole and not by a digest alone, get
identifiers; a text is the ordered list of its chunks' identifiers, and equal texts are equal lists. A chunk
crosses the network once for each input split that holds it, whatever the number of documents; the documents
send their lists only.

A chunk's identifier is its 64-bit hash; where chunks share a hash, all identifiers get a number besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored

#: Pieces are clauses, up to 256 characters each. Marks are ASCII: Java looks such a class up in a table, wider ones cost
#: eight times as much; in scripts with other marks pieces are counted from the last ASCII mark.
PIECE = r"[^.,;:!?]{1,256}+[.,;:!?]{0,16}+|[.,;:!?]{1,256}+"
#: A cut falls behind one in so many clauses; cuts are NEAR clauses apart at least and FAR at most.
ONE_IN, NEAR, FAR = 8, 3, 64
#: Copies of a large group are joined to it in portions of about this size; a group is large from PORTION
#: rows and this share of all rows on, so that there are no more large groups than LARGE.
PORTION, LARGE = 4096, 4096


def normal(text: Column) -> Column:
    """One space in place of each run of white space; empty for null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text)


def chunked(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns kept, _sha (hex SHA-256 of the normal text) and _chunks, which joined give that text. Cuts
    depend on the normal text alone, so equal texts have equal chunks; an empty text has none."""
    out = docs.select(*keep, normal(F.col(text)).alias("_t"))
    out = out.select(*keep, F.sha2("_t", 256).alias("_sha"), F.regexp_extract_all("_t", F.lit(PIECE), F.lit(0)).alias("_pieces"))
    hits = F.expr(f"filter(sequence(1, size(_pieces) - 1), i -> (xxhash64(_pieces[i - 1]) & {ONE_IN - 1}) = 0)")
    none = F.expr("cast(array() as array<int>)")
    out = out.select(*keep, "_sha", "_pieces", F.when(F.size("_pieces") > 1, hits).otherwise(none).alias("_hits"))
    # a hit close behind another one is none; a long way without hits is cut evenly
    apart = F.expr(f"filter(_hits, (at, k) -> k = 0 or at - _hits[k - 1] >= {NEAR})")
    out = out.select(*keep, "_sha", "_pieces", F.concat(F.array(F.lit(0)), apart, F.array(F.size("_pieces"))).alias("_ends"))
    starts = F.expr(f"flatten(transform(slice(_ends, 2, size(_ends)), (end, k) -> sequence(_ends[k], end - 1, {FAR})))")
    out = out.select(*keep, "_sha", "_pieces", F.when(F.size("_pieces") > 0, starts).otherwise(none).alias("_from"))
    return out.select(*keep, "_sha", F.expr("transform(_from, (at, k) -> array_join(slice(_pieces, at + 1, coalesce(get(_from, k + 1), size(_pieces)) - at), ''))").alias("_chunks"))


def clashes(chunks: DataFrame) -> DataFrame:
    """_h of the hashes that several distinct chunks share: each distinct chunk is moved whole and compared with those of its hash."""
    each = chunks.groupBy("_h", "_chunk").agg(F.lit(1).alias("_one"))
    return each.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")


def recipes(docs: DataFrame, doc_id: str, text: str, bits: int) -> DataFrame:
    """_row, _id, _sha and _list, the ordered identifiers of the row's chunks."""
    key = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    parts = chunked(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), ["_id"], "_text")
    # outer: else Spark filters by the array's size first, and works it out anew below for that
    chunks = parts.select(F.explode_outer("_chunks").alias("_chunk")).where("_chunk is not null").select(key(F.col("_chunk")).alias("_h"), "_chunk")
    shared = stored(clashes(chunks), "clashes")
    rows = parts.select(F.monotonically_increasing_id().alias("_row"), "_id", "_sha", "_chunks")
    if shared.isEmpty():
        return rows.select("_row", "_id", "_sha", F.transform("_chunks", key).alias("_list"))
    # the chunks of such a hash are numbered in their own order, all others have number 0
    known = chunks.join(shared, "_h", "left_semi").groupBy("_h", "_chunk").agg(F.lit(1).alias("_one"))
    known = stored(known.select("_h", "_chunk", F.expr("row_number() over (partition by _h order by _chunk)").alias("_no")), "numbers")
    each = rows.select("_row", "_id", "_sha", F.posexplode_outer("_chunks").alias("_at", "_chunk")).withColumn("_h", key(F.col("_chunk")))
    each = each.join(known, ["_h", "_chunk"], "left").groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_sha").alias("_sha"), F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_h", F.coalesce("_no", F.lit(0)).cast("bigint").alias("_no"))))).alias("_c"))
    return each.select("_row", "_id", "_sha", F.flatten(F.transform("_c", lambda c: F.array(c["_h"], c["_no"]))).alias("_list"))


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row; of equal texts the row with the least id
    stays, a null id after all others; of rows that share that id, one.

    Null and empty texts are equal; white space alone is one space, and so another text. Rows with null or
    repeated ids are rows like any other; keep_id is null where all ids of a group are. Other columns are
    dropped, whatever their names. An empty table gives no rows. ``bits`` is the width of a chunk's hash: fewer than 64
    are for tests, results are the same at any width.
    """
    rows = stored(recipes(docs, doc_id, text, bits).withColumn("_key", F.xxhash64("_list")), "recipes")
    groups = stored(rows.groupBy("_key", "_list").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")), "groups")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    large = groups.where((F.col("_n") > PORTION) & (F.col("_n") * LARGE >= total)).groupBy("_key").agg(F.max("_n").alias("_large"))
    portions = F.coalesce(F.ceil(F.col("_large") / PORTION), F.lit(1)).cast("bigint")
    left = rows.join(F.broadcast(large), "_key", "left").withColumn("_portion", F.pmod(F.col("_row"), portions)).drop("_large")
    right = groups.join(F.broadcast(large), "_key", "left").withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("bigint"), portions - 1))).drop("_large")
    out = left.join(right, ["_key", "_portion", "_list"])
    return out.select(F.col("_id").alias(doc_id), F.col("_first.id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_first.row")).alias("kept"), F.col("_sha").alias("text_sha256"))


#: The same in DuckDB SQL, over the table documents.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t
"""
