"""Exact de-duplication by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of their text in bytes; only rows of a length that occurs twice are grouped by a hash of the text's first characters
as well; only rows of such a group that has two members are grouped by the SHA-256 of the whole text. No shuffle carries
a text: what is shuffled is some 60 bytes a row at most.

exact_groups owes the digest of every row to its result, so it takes all three marks in one scan; what it groups are the
lengths of all rows, the prefix hashes of rows that share a length, the digests of rows that share both. drop_exact_copies takes the digest of the survivors of the first two steps alone.

Groups are counted with map-side partial sums before they are compared, so a text that fills a third of the table is
one row a task there. Groups of at least one HOT_SHARE-th of all rows number HOT_SHARE at most; these are broadcast, and only rows of
other groups are dealt by their marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import body, materialize, small_or_shuffled, table

#: Characters in the prefix hash.
PREFIX_CHARS = 256
#: Groups of at least one in so many rows are broadcast: there are so many at most.
HOT_SHARE = 10_000


def marks(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, n_bytes, head (hash of the prefix), digest (SHA-256, binary) of each row."""
    text = docs.select("doc_id", body().alias("text"))
    return text.select(
        "doc_id",
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64(F.substring("text", 1, prefix_chars)).alias("head"),
        F.unhex(F.sha2(F.col("text"), 256)).alias("digest"),
    )


def _shared_heads(counts: DataFrame) -> DataFrame:
    """(n_bytes, head) that several rows have, of counts (n_bytes, head, n): lengths that occur twice first."""
    lengths = counts.groupBy("n_bytes").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("n_bytes")
    return counts.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "head").agg(F.sum("n").alias("n")).where("n > 1").select("n_bytes", "head")


def _of_group(rows: DataFrame, groups: DataFrame, keys: list[str], often: int) -> DataFrame:
    """rows with the other columns of their group, null for rows of none. groups: keys, n and others, materialized.

    Groups of at least `often` rows are broadcast; only rows of none of these are dealt by key, if the other groups are too many to be broadcast.
    """
    hot, rest = F.broadcast(groups.where(F.col("n") >= often)), small_or_shuffled(groups.where(F.col("n") < often))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(rest, keys, "left"))


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, digest, keep_id, group_size, kept.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays; rows
    without a doc_id stay only in a group that has no other rows. Rows that repeat both doc_id and text are one
    document: each counts in group_size and each is marked like the others. An empty table gives an empty result. Only
    doc_id and text are read, so further columns never clash.
    """
    rows = materialize(marks(docs, prefix_chars), "exact-marks")
    often = max(2, rows.count() // HOT_SHARE)
    shared = lambda of, keys: materialize(of.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-shared")
    still = rows
    for keys in (["n_bytes"], ["n_bytes", "head"]):
        still = _of_group(still, shared(still, keys), keys, often).where("n IS NOT NULL").drop("n")
    # copies meet already counted, a row a task for each text
    groups = materialize(still.groupBy("digest").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-groups")
    rows = _of_group(rows, groups, ["digest"], often)
    return rows.select(
        "doc_id",
        "n_bytes",
        "digest",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("top"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs without copies, all columns: of rows with equal texts the one with the largest doc_id stays.

    Null counts as empty; a row without a doc_id stays only if no copy has one. Of rows that repeat both doc_id and
    text the least one stays (by its columns, which must be of types that can be ordered). Digests are taken of texts that share length
    and prefix with another alone. An empty table gives an empty result; columns may have any names.
    """
    marked = docs.select("doc_id", body().alias("text"), F.octet_length(body()).alias("n_bytes"), F.xxhash64(F.substring(body(), 1, prefix_chars)).alias("head"))
    counts = materialize(marked.groupBy("n_bytes", "head").agg(F.count(F.lit(1)).alias("n")), "exact-heads")
    shared = small_or_shuffled(materialize(_shared_heads(counts), "exact-shared"))
    survivors = marked.join(shared, ["n_bytes", "head"], "left_semi").select("doc_id", "n_bytes", "head", F.sha2("text", 256).alias("digest"))
    members = materialize(survivors.groupBy("doc_id", "n_bytes", "head", "digest").agg(F.count(F.lit(1)).alias("times")), "exact-survivors")
    groups = members.groupBy("digest").agg(F.max("doc_id").alias("top"), F.sum("times").alias("n")).where("n > 1")
    often = max(2, members.count() // HOT_SHARE)
    hot, rest = (groups.where(c) for c in (F.col("n") >= often, F.col("n") < often))
    hot = F.broadcast(hot)
    # only rows of other groups are dealt by their digests
    found = members.join(hot, "digest").unionByName(members.join(hot, "digest", "left_anti").join(rest, "digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("top"))
    # a row goes if another one stays for it; of rows that come more than once all go first
    gone = materialize(found.where(~stays | (F.col("times") > 1)).select(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "n_bytes", "head", "digest")], stays.alias("stays")), "exact-dropped")
    text = F.coalesce(docs["text"], F.lit(""))

    def alike(away: DataFrame) -> F.Column:
        """No equality of digests, so that only rows which agree in the other marks take theirs."""
        same = docs["doc_id"].eqNullSafe(away["of_doc_id"]) & (F.octet_length(text) == away["of_n_bytes"]) & (F.xxhash64(F.substring(text, 1, prefix_chars)) == away["of_head"])
        return same & F.startswith(F.sha2(text, 256), away["of_digest"])

    away = small_or_shuffled(gone)
    left = docs.join(away, alike(away), "left_anti")
    again = gone.where("stays")
    if again.isEmpty():
        return left
    again = small_or_shuffled(again)
    row = docs.join(again, alike(again)).select(again["of_doc_id"], again["of_digest"], F.struct(*[docs[c] for c in docs.columns]).alias("row_"))
    return left.unionByName(row.groupBy("of_doc_id", "of_digest").agg(F.min("row_").alias("row_")).select("row_.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
