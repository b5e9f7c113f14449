"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, phrases, sharding, stream_dedup, url_filter
from .common import documents, prepare, shared_path

SHARDS = 24


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back."""
    from .token_files import read_token_files, write_token_files
    docs = documents(spark, sf_dir)
    manifest = write_token_files(docs, shared_path(spark, "token-files"), _tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest, with_ids=False)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of all documents."""
    from .toxicity import toxicity_scores
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by their shingle sets."""
    from .jaccard_join import similar_groups
    return similar_groups(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents from the stateful stream."""
    from .stream_dedup import dedup_table
    return dedup_table(documents(spark, sf_dir))


def op5_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from .quality import quality_scores
    docs = documents(spark, sf_dir)
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight."""
    from .sharding import shard_documents
    return shard_documents(documents(spark, sf_dir), [1.0] * SHARDS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through the digest cache."""
    from .token_counts import count_query
    docs = documents(spark, sf_dir)
    return count_query(spark, docs, _tokenizer("byte_bpe_50k.json"))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden-Markov and unigram log probabilities of all documents."""
    from .hmm_scoring import score_documents
    return score_documents(documents(spark, sf_dir))


def op9_contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents."""
    from .decontaminate import contaminated
    docs = documents(spark, sf_dir)
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from .packing import pack_documents
    return pack_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=0, room=2048)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenisers' tokens of all documents, aligned."""
    from .alignment import alignment
    return alignment(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the filter list on all pages."""
    from .url_filter import judge_pages
    prepare(spark)
    return judge_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two or three words of each language."""
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity_chain, op3_jaccard_groups, op4_exact_dedup, op5_quality_network, op6_rendezvous_shards, op7_token_counts,
                                   op8_hmm_scores, op9_contaminated_documents, op10_best_fit_packing, op11_alignment, op12_url_filter, op13_phrases)}
ORACLE: dict[str, str] = {"op4_exact_dedup": stream_dedup.ORACLE_SQL, "op6_rendezvous_shards": sharding.oracle_sql(SHARDS),
                          "op9_contaminated_documents": decontaminate.ORACLE_SQL, "op12_url_filter": url_filter.ORACLE_SQL,
                          "op13_phrases": phrases.ORACLE_SQL}
