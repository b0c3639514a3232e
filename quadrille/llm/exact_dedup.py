"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so; its recipe is the ordered list of its chunks' identifiers, and texts are
equal when their recipes are. An identifier is a 64-bit key that is verified: one aggregation over all chunks, with
partial results, shows for each key the least and the greatest SHA-256 of what it stands for, and where they differ the
digest is the identifier instead. Texts and chunks are read once, in the pass that makes the recipes; what is shuffled
afterwards are keys and digests.

Cuts come after `least` characters at a letter, white space and a letter of certain classes, at sentence marks of scripts
without blanks, or between certain signs of encoded data; where a text has none of these, at `most` characters. Equal
texts have equal recipes wherever the cuts fall.

Defined cases: null text equals the empty one (an empty recipe); the largest doc_id of a group stays, null doc_ids below
all others; rows that repeat both doc_id and text share the answer in groups(), while distinct() keeps one row of a group;
texts of any length become lists of chunks of at most `most` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import text_or_empty, with_row, without

#: Keys with several contents that a plan lists one by one; with more of them every identifier is a digest.
LISTED = 1000


def chunks(text: Column, least: int = 1024, most: int = 16384) -> Column:
    """Ordered content-defined chunks, whose concatenation is the text."""
    ends = r"[nst]\s[a-f]|[、。！，？،؟।]|[05Aq+][39Kz/]"
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<={ends})|.{{1,{most}}}"), F.lit(0))


def chunk_key(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _recipes(source: DataFrame, carry: list[str], least: int, most: int, key) -> DataFrame:
    """source's `carry` columns, text_sha256, and recipe: identifiers of its text's chunks in order."""
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    made = cut(
        source.select(
            *carry,
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("text"), least, most), lambda c: F.struct(key(c).alias("key"), digest(c).alias("sha"))).alias("parts"),
        )
    )
    known = made.select(F.explode("parts").alias("p")).groupBy("p.key").agg(F.min("p.sha").alias("low"), F.max("p.sha").alias("high"))
    several = [r["key"] for r in known.where("low <> high").select("key").limit(LISTED + 1).collect()]
    short, long_ = (lambda p: F.unhex(F.lpad(F.hex(p["key"]), 16, "0"))), (lambda p: p["sha"])  # of different lengths, so never equal
    if not several:
        name = short
    elif len(several) <= LISTED:
        name = lambda p: F.when(p["key"].isin(several), long_(p)).otherwise(short(p))
    else:
        name = long_
    return made.select(*carry, "text_sha256", F.transform("parts", name).alias("recipe")).withColumn("rid", F.xxhash64("recipe"))


def groups(docs: DataFrame, least: int = 1024, most: int = 16384, key=chunk_key) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    recipes = _recipes(source, ["doc_id"], least, most, key)
    repeated = recipes.groupBy("rid", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = recipes.join(repeated, ["rid", "recipe"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(alone | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def distinct(docs: DataFrame, least: int = 1024, most: int = 16384, key=chunk_key) -> DataFrame:
    """docs with one row of each group of equal texts: that of the largest doc_id, the last such row of its file or files."""
    rows, row = with_row(docs)
    source = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    recipes = _recipes(source, ["row", "doc_id"], least, most, key).select("rid", "recipe", F.struct("doc_id", "row").alias("at"))
    repeated = recipes.groupBy("rid", "recipe").agg(F.max("at").alias("stays"), F.count("*").alias("n")).where("n > 1")
    dropped = recipes.join(repeated, ["rid", "recipe"]).where("at.row <> stays.row").select(F.col("at.row").alias(row))
    return without(rows, row, cut(dropped)).select(*docs.columns)
