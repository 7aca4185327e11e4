"""A corpus pipeline of five stages over the documents table, each one operator of weftline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, language_id, line_dedup, near_copies, packing
from weftline.llm._common import handed_on, materialize, remove, scratch, table
from weftline.llm.queries import TEMPER, TOKENIZER

#: The pipeline ends in pieces of packed token sequences, which SQL cannot express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go.

    Learns from the labelled documents of this stage's input that aren't held out. If
    there are none, every document with a letter stays. Null and empty texts and those of
    digits and signs alone go; repeated rows stay or go together, and so do ties, for the
    verdict follows from the text. Texts of any length are read as a whole. A null id is
    never held out. An empty table gives an empty table. All columns are kept, whatever
    their names.
    """
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 5, 0)))
    if not model.families:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    found = language_id.with_language(docs, model)
    return found.where(found["lang_pred"] != language_id.UND).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text.

    Every document stays, with null and empty texts as they are, and so does every line of
    under ten code points. Of documents that share a line, the smallest doc_id keeps it, a
    null id only if no other holds it; rows that repeat an id keep or lose it together.
    Texts of any length are cut as a whole. An empty table gives an empty table. Columns are
    kept in order, also those that are named like what line dedup adds.
    """
    from pyspark.sql import functions as F

    found = line_dedup.drop_repeated_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more. Null and
    empty texts, and those of blanks, are one group. Of repeated rows one stays; a null id
    ranks last, and of rows that tie the hash of the text and then the place in the table
    decide. Texts of any length are compared as a whole. An empty table gives an empty table.
    All columns are kept, whatever their names.
    """
    return near_copies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in the benchmark.

    Null and empty texts have no words and stay. Rows of one text, repeated ones included,
    stay or go together; texts of any length are searched as a whole. An empty table gives an
    empty table, an empty benchmark takes nothing. All columns are kept, whatever their names.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with the sources in the proportions of op3_packing.

    Null and empty texts are the end id alone; a null source is a queue like any other, and
    a table without sources is one queue. Repeated rows and ids, null ones included, are
    packed each; ties are in the order of the table. Texts of any length are cut at the ends
    of sequences. An empty table gives no pieces. Other columns are not looked at.
    """
    return packing.pack(docs, TOKENIZER, targets=TEMPER)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each but the last is written and read again.

    What a stage wrote on its way goes once its result is written, its input once its
    successor's is. What the result reads stays: it goes at the end of a scratch() around
    the call, else as the JVM ends.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir))
            result = made.pop()
        remove(spark, before)
        before = [result]
    handed_on(before)
    return STAGES[-1][1](spark, docs, sf_dir)
