"""The queries of this subpackage, by name; each applies its operator to its whole table."""

import public_tokenizers

from .archives import page_records
from .decontamination import find_contamination
from .divergence import rate_divergence
from .fingerprints import edited_fingerprints
from .hard_negatives import hard_negatives
from .languages import identify_languages
from .lexical_search import search
from .licences import scan_licences
from .near_duplicates import near_duplicates
from .packing import pack
from .pseudonyms import pseudonym_report
from .quality import score_quality
from .quotations import link_quotations
from .shared import ship_package

TOKENIZER = "word_bpe_49k.json"


def table(spark, directory, name):
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_pseudonyms(spark, directory):
    return pseudonym_report(table(spark, directory, "documents"))


def op2_near_duplicates(spark, directory):
    return near_duplicates(table(spark, directory, "documents"))


def op3_packing(spark, directory):
    return pack(table(spark, directory, "documents"), public_tokenizers.path(TOKENIZER))


def op4_licences(spark, directory):
    return scan_licences(table(spark, directory, "documents"))


def op5_languages(spark, directory):
    return identify_languages(table(spark, directory, "documents"))


def op6_archives(spark, directory):
    return page_records(table(spark, directory, "pages"))


def op7_quotations(spark, directory):
    return link_quotations(table(spark, directory, "conversations"))


def op8_quality(spark, directory):
    return score_quality(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op9_decontamination(spark, directory):
    return find_contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op10_fingerprints(spark, directory):
    return edited_fingerprints(table(spark, directory, "documents"))


def op11_divergence(spark, directory):
    return rate_divergence(table(spark, directory, "documents"))


def op12_hard_negatives(spark, directory):
    return hard_negatives(table(spark, directory, "embeddings"))


def op13_lexical_search(spark, directory):
    return search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


QUERIES = [
    op1_pseudonyms,
    op2_near_duplicates,
    op3_packing,
    op4_licences,
    op5_languages,
    op6_archives,
    op7_quotations,
    op8_quality,
    op9_decontamination,
    op10_fingerprints,
    op11_divergence,
    op12_hard_negatives,
    op13_lexical_search,
]


def registered():
    def sent(query):
        def run(spark, directory):
            ship_package(spark)
            return query(spark, directory)

        return run

    return {f.__name__: sent(f) for f in QUERIES}
