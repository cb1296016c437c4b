"""Registered queries of this subpackage; the entry module adds them."""

from __future__ import annotations

from . import oracles
from .ann import nearest
from .jaccard import near_duplicates
from .langid import identify
from .lengths import length_histogram, token_lengths
from .licenses import scan_licences
from .mixing import plan_mix
from .pieces import encode_pieces
from .quality import quality_rules
from .sharding import shard_by_mixture
from .common import table
from .toxicity import toxicity


def op1_sharding(spark, sf_dir):
    return shard_by_mixture(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return plan_mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op4_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("lost")


def op9_licences(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))


def tokenizer_file(name):
    """Path of a public tokenizer's file; the files stay where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_sentencepiece(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def queries():
    return {
        "op1_sharding": op1_sharding,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op4_jaccard": op4_jaccard,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_neighbours": op7_neighbours,
        "op8_token_counts": op8_token_counts,
        "op9_licences": op9_licences,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql():
    return oracles.oracle_sql()
