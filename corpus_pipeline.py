"""From raw documents to token files: language, near-duplicates, benchmark passages, source mix, token ids.

Each stage is a function (spark, docs, sf_dir) of all that the stage before
kept. All but the last return the columns of documents, whatever these are.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import documents, learns
from tillscope.llm.contamination import PASSAGE, find_items
from tillscope.llm.language import identify
from tillscope.llm.mixing import mixed_rows
from tillscope.llm.simhash import one_of_each
from tillscope.llm.token_files import read_tokens, write_tokens


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one value, so that no column of its own meets one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or in none of the languages known; models learn from the documents given."""
    known = docs.where(learns(4, 2)).select("doc_id", "text", "lang")
    return identify(_rows(docs), known, text="doc.text").where("not found.far").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints of 3-word shingles differ in 3 bits or fewer, from document to document."""
    return one_of_each(_rows(docs), "doc.").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark: an occurrence of at least ``PASSAGE`` code points."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_items(_rows(docs), benchmark, text="doc.text")
    return found.where(f"not exists(matches, m -> m.end - m.start >= {PASSAGE})").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights."""
    return mixed_rows(_rows(docs), "doc.").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files, and give the place, number and checksum of each document's ids as read from them."""
    import public_tokenizers

    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: Not every stage could be written in SQL. Tests hold the rows that near_duplicates, decontamination and mixing keep, and
#: the ids that tokens writes, against plain Python, and those of language against its operator, whose models have a test of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
