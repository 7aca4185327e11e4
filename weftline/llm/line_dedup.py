"""Line dedup in DataFrame operations only.

Lines are exploded, their normalised keys hashed to 128 bits, distinct documents
counted for each hash, and the positions to drop sent back to their document, whose
remaining lines are joined again in order of position. The hashes are written once and
read for both sides of their join; they, ids and positions alone pass through the shuffles
by hash. A text is shuffled once, by its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST_ID, ascii_lower, col, fresh, materialize

#: What is stripped at both ends of a line: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the lines dropped that min_docs or more documents hold.

    A line's key is the line stripped of BLANKS with A-Z lower-cased. Keys of at least
    min_chars code points that occur in at least min_docs documents lose all their lines
    except those in the smallest id that holds them. Adds n_lines (before dropping) and
    n_dropped, replacing columns of these names.

    Null or empty text is one empty line; a null text stays null. A document is an id
    with a text: rows that repeat both count as one document and are all treated alike;
    rows of one id with different texts count as one document when documents are
    counted, and all of them keep the lines of which this id is the smallest. A null id
    ranks after every other id; ids that aren't integers are an error. Texts of any length
    are cut as a whole. An empty table gives an empty table. Other columns are kept, whatever
    their names.
    """
    if docs.select(col(id_col)).schema[0].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer: the smallest id keeps a line")
    did, text, hashed, its_id, its_hash, drop = fresh(docs, "_id", "_text", "_hash", "_its_id", "_its_hash", "_drop")
    rows = docs.select("*", F.coalesce(col(id_col).cast("long"), F.lit(LAST_ID)).alias(did), F.coalesce(col(text_col), F.lit("")).alias(text)).withColumn(hashed, F.xxhash64(text))
    lines = rows.select(F.col(did).alias("d"), F.col(hashed).alias("h"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("d", "h", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.length("key") >= min_chars)
    lines = materialize(lines.select("d", "h", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b")), "lz4")

    # Two levels: a key that a third of all documents hold meets as one row a task.
    holders = lines.select("a", "b", "d").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("keep"))
    repeated = holders.where(F.col("n") >= min_docs).select(F.col("a").alias("ra"), F.col("b").alias("rb"), "keep")

    # Equal on a alone, b compared as a residual: both sides are then exchanged right below
    # the join, so that the engine can split a partition with a hot key.
    found = lines.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b").bitwiseXOR(F.col("rb")) == 0) & (F.col("d") != F.col("keep")))
    drops = found.groupBy(F.col("d").alias(its_id), F.col("h").alias(its_hash)).agg(F.collect_set("pos").alias(drop))

    joined = rows.join(drops.hint("shuffle_hash"), (F.col(did) == F.col(its_id)) & (F.col(hashed) == F.col(its_hash)), "left")
    parts = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop)), lambda i: parts[i])
    cleaned = F.when(F.col(drop).isNull(), col(text_col)).otherwise(F.array_join(kept, "\n"))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(
        *[cleaned.alias(c) if c == text_col else col(c) for c in own],
        (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
