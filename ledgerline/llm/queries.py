"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, divergence, line_dedup, neighbours, ngram_join, secrets, spelling, substring_dedup, token_counts, toxicity, url_filter
from .common import read


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages")).drop("trust", "distrust")


def op2_byte_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"))


def op3_neighbours(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


def op4_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_ngram_join(spark, sf_dir):
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.counts(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_chat_format(spark, sf_dir):
    texts, links = chat_format.chain(chat_format.with_planted(read(spark, sf_dir, "conversations")))
    # A chain is one path, so no text is shared by two.
    return chat_format.digests(chat_format.formatted(texts, links, once=False))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.groups(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_byte_bpe, op3_neighbours, op4_toxicity, op5_ngram_join, op6_decontamination, op7_line_dedup, op8_token_counts, op9_substring_dedup, op10_secret_scan, op11_chat_format, op12_source_divergence, op13_spelling_variants)}

ORACLE_SQL = {"op1_url_filter": url_filter.SQL, "op3_neighbours": neighbours.SQL, "op5_ngram_join": ngram_join.SQL, "op7_line_dedup": line_dedup.SQL, "op9_substring_dedup": substring_dedup.SQL, "op11_chat_format": chat_format.SQL, "op12_source_divergence": divergence.SQL, "op13_spelling_variants": spelling.SQL}
