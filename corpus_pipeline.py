"""A corpus from raw documents: stages that each work on all that the one before kept."""

import public_tokenizers

from marginmill.llm.decontamination import without_contamination
from marginmill.llm.languages import with_language
from marginmill.llm.near_duplicates import without_near_duplicates
from marginmill.llm.packing import pack
from marginmill.llm.pseudonyms import pseudonymise
from marginmill.llm.shared import ship_package, stored


def languages(spark, docs, sf_dir):
    """Documents in a language that can be told; the others go."""
    return with_language(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return without_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without the test phrases of the benchmark: these are cut from their texts."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark, docs, sf_dir):
    """Documents with pseudonyms in place of personal data."""
    return pseudonymise(docs)


def packing(spark, docs, sf_dir):
    """The pieces of all documents, by sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))




def prepared(stage):
    """The stage in a session that is ready for the operators."""

    def run_stage(spark, docs, sf_dir):
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("languages", prepared(languages)),
    ("near duplicates", prepared(near_duplicates)),
    ("decontamination", prepared(decontamination)),
    ("pseudonyms", prepared(pseudonyms)),
    ("packing", prepared(packing)),
]

#: SQL cannot express language models, signatures, keyed permutations and packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
