"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what the next one gets."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaweave.llm.common import packed, publish_by, table, unpacked
from mediaweave.llm.decontam import contamination
from mediaweave.llm.exact import exact_groups
from mediaweave.llm.langid import VOCABULARY, held_out, identify, train
from mediaweave.llm.mixing import mix_sources
from mediaweave.llm.simhash import near_distinct
from mediaweave.sources.shared import published_since, remove

#: A document whose language's posterior probability is not above that has no language.
SURE = 0.5


#: What the stage before has written for itself. Its result has been written when the next one begins.
_spent: list[str] = []


def tidy(stage: Callable, first: bool = False) -> Callable:
    """A stage that begins with deleting the tables that the stage before has written on its way; the first one leaves
    those of the last one, whose result nobody may have read yet."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _spent and not first:
            remove(spark, _spent.pop())
        _spent.clear()
        with published_since() as own:
            found = stage(spark, docs, sf_dir)
        _spent.extend(own)
        return found

    return run_stage


@partial(tidy, first=True)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language that is likelier than all others together."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = identify(packed(docs, "doc_id", "text"), *train(labelled, vocabulary=VOCABULARY))
    return known.filter((F.col("lang_pred") != "und") & (F.col("score") > SURE)).select(*unpacked(docs.columns, "doc_id", "text"))


@tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_groups(packed(docs, "doc_id", "text"), carry=True).filter("kept").select(*unpacked(docs.columns, "doc_id", "text"))


@tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    return near_distinct(docs)


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    found = contamination(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.filter("NOT contaminated").select(*unpacked(docs.columns, "doc_id", "text"))


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of times the mix takes it, those that it doesn't take left out."""
    return mix_sources(docs).filter("repeats > 0")


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminate), ("mixing", mix)]
#: SQL can't express the language model or the XXH64 fingerprints: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Each one's result is written; what it was made from is deleted then."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, written = publish_by(stage(spark, docs, sf_dir))
        if path:
            remove(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
