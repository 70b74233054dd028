"""The corpus pipeline: stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import decontaminate, langid, minhash, mixing, secrets, simhash
from marketspark.llm.common import documents, quoted, stored
from marketspark.session import clean, handed_over, ship_code

#: Bits per symbol from which no learned language explains a text; prose takes 2 to 3, random letters over 5.
FOREIGN_BITS = 5.0
#: Words a shingle, and the share of common shingles from which two documents are near copies.
SHINGLE, LIKE = 5, 0.8
#: Two segments looked up within one bit find all fingerprints within three bits, at the cost of two.
NEAR_BITS = 3
#: Below so many characters one phrase decides, so short texts are not judged by their entropy.
ENOUGH_CHARS = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that cross-parse no better than random letters.

    So null and empty texts go. Repeated rows share one fate; an empty table stays empty; where no document has a
    language nothing can be told and all stay. Columns of any name pass through.
    """
    ship_code(spark)
    names = docs.columns
    model = langid.fit(docs.filter(~langid.held_out()))
    told = langid.predict(docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"), F.col("text").alias("_text")), model, "_text")
    kept = F.col("lang_pred") != "und"
    foreign = (F.col("cross_entropy") > FOREIGN_BITS) & (F.length("_text") >= ENOUGH_CHARS)
    return told.filter(kept & ~foreign if model.langs else F.lit(True)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest id stays, unless it is LIKE a smaller id that stays or went.

    Wordless texts are copies of each other. Fingerprints take the large groups of copies; what they leave is compared by its shingles themselves.
    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    ship_code(spark)
    names = [quoted(c) for c in docs.columns]
    groups = simhash.near_duplicates(docs, distance=NEAR_BITS, width=SHINGLE)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    left = stored(docs.join(gone, "doc_id", "left_anti").select(*names), "copies-gone")
    return left.join(minhash.later_copies(left, LIKE, SHINGLE), "doc_id", "left_anti").select(*names)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage close to a benchmark item go.

    Null and empty texts hold none and stay, repeated rows share one fate, an empty benchmark or table changes
    nothing. Items without an id count; items of fewer than five words go by whole words without edits.
    """
    ship_code(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out of the texts; every document stays, repeated and empty ones too, null texts as null."""
    ship_code(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with words once, those of small sources partly twice (column ``copy``).

    Null and wordless texts have no tokens to mix and go; documents without a source are a source; repeated rows
    count each; an empty table stays empty.
    """
    ship_code(spark)
    return mixing.mix(docs, repeats=2.0, seed=1)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Fitted automata and random embeddings are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage handed over is removed once its result is written."""
    docs = documents(spark, sf_dir)
    before = set(handed_over(spark))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}-{name}")
            *read, _ = [path for path in handed_over(spark) if path not in before]
            clean(spark, read)
    return docs
