"""Training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, mixing, token records.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage a null text counts as an empty one, null ids and sources are values like others, repeated rows are rows of
their own but for the near-duplicate stage, columns beyond those of documents pass through whatever their names, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.llm.decontaminate import contamination
from corpusq.llm.mixing import WORD, mix
from corpusq.llm.quality import fit_quality, held_out, score_quality
from corpusq.llm.shared import shared_dir, written
from corpusq.llm.simhash import grouped_prints
from corpusq.llm.token_records import read_records, write_records


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], list]:
    """docs with every column but the ``used`` ones under a name no operator uses; these names; and the columns named back."""
    names = {c: c if c in used else f"_column_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return renamed, list(names.values()), [F.col(n).alias(c) for c, n in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score under 0.7) go.

    The model is learned from the labelled rows of docs that are not held out; without labels of both kinds the score is a
    constant. An empty text has the score of an even difference of sizes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out()))
    rows, names, back = _apart(docs, "doc_id", "text")
    return score_quality(rows, model, keep=tuple(names)).where("predicted = 1").select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays, the first by doc_id (null last) and text, whatever ids other groups have."""
    rows, names, back = _apart(docs, "doc_id", "text")
    rows = rows.withColumn("_row", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("_id", F.col("doc_id").cast("long"))
    groups = written(grouped_prints(rows, keep=("_row",)).select("doc_id", "_row", "root"), "pipeline-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_kept_id"), F.col("first._row").alias("_kept_row"))
    # the ids grow with the input, so they are never broadcast; rows of one id and text are of one group
    kept = rows.join(first.hint("merge"), (F.col("_row") == F.col("_kept_row")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    if groups.groupBy("doc_id", "_row").count().where("count > 1").limit(1).count() > 0:
        kept = kept.withColumn("_place", F.row_number().over(W.partitionBy("_id", "_row").orderBy("text"))).where("_place = 1").drop("_place")
    return kept.select(*back)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a document or an item without words holds and asks for none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names, back = _apart(docs, "doc_id", "text")
    return contamination(rows, benchmark, keep=tuple(n for n in names if n != "doc_id")).where("not contaminated").select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more cut to the words taken beyond that.

    A document without words takes nothing and so is left out; ``n_chars`` follows the text that is cut.
    """
    rows, names, back = _apart(docs, "doc_id", "source", "text", "n_chars")
    mixed = mix(rows, keep=tuple(n for n in names if n != "doc_id"))
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0).cast("long"))
    rest = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = mixed.withColumn("_taken", F.explode(copies))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int"))
    out = out.withColumn("text", F.when(F.col("_taken") == 0, F.col("text")).otherwise(F.array_join(words, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_taken") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix, written and read back: (doc_id, start, n_tokens, ids_crc32), one for each row, null ids first."""
    import public_tokenizers

    path = shared_dir(spark, "pipeline-records")
    manifest = write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: Compression, SimHash and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
