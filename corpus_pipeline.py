"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but
the last return the columns of docs.  NULL texts do not pass the quality rules.  Repeated rows are
copies: one of them stays.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from verdara.llm import fertility, packing, personal, simhash
from verdara.sources.scratch import scratch_dir, stored


def _whole(docs):
    """All columns of a row as one, so that no name clashes with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def _columns(docs):
    return [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]


def quality(spark, docs, sf_dir):
    """Documents that pass the base rules and lie in the fertility bands of their language."""
    rows = docs.select(_whole(docs), "text", "lang")
    measured = stored(fertility.measure(rows).drop("text"))
    judged = fertility.judge(measured, fertility.fit_bands(measured))
    return judged.where("kept").select(_columns(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the least doc_id, NULL ids last.

    Two documents are linked if their SimHash fingerprints over three-word shingles differ in at
    most three bits.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        docs = stored(docs)
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    identity = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                        place.alias("row"))
    found = simhash.near_duplicates(docs.select(identity.alias("_id"), "text"), key="_id", width=3,
                                    distance=3)
    dropped = found.where(F.col("_id") != F.col("component")).select(F.col("_id.row").alias("_row"))
    rows = docs.select(_whole(docs), place.alias("_row"))
    return rows.join(dropped, "_row", "left_anti").select(_columns(docs))


def redact(spark, docs, sf_dir):
    """Documents with their personal data replaced by marks, and n_chars of the new text."""
    rows = docs.select(_whole(docs), "text")
    clean = personal.find(rows, clean="_clean")
    new = {"text": F.col("_clean").alias("text"),
           "n_chars": F.char_length("_clean").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return clean.select(*[new.get(c, own) for c, own in zip(docs.columns, _columns(docs))])


def pack(spark, docs, sf_dir):
    """One row per piece of a document with its place in a bin."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", redact),
          ("packing", pack)]

#: Tokenisers, 64-bit hashes and the random field have no form in DuckDB SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_dir(spark) + "/stage"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
