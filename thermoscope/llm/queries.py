"""Registered queries of the text operators: whole tables in, contract columns out.

``QUERIES`` maps names to ``fn(spark, sf_dir)``; ``SQL`` holds DuckDB text where
one exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> bytes:
    """Bytes of a public tokenizer file (at most a few MB; read on the driver and broadcast)."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@register
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b token files of all documents, read back."""
    from .token_files import round_trip
    return round_trip(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


@register
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids by the prefix table, decoded again, for all documents."""
    from .piece_codec import digests, encode_texts
    return digests(encode_texts(load(spark, sf_dir, "documents", "doc_id", "text"),
                                tokenizer_file("piece_bpe_32k.model")))


@register
def op6_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by the byte network."""
    from .lang_cnn import identify
    return identify(load(spark, sf_dir, "documents", "doc_id", "text", "lang")).select(
        "doc_id", "held_out", "lang_pred", "score")


@register
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences that repeat an earlier run of sentences."""
    from .sentence_spans import deduplicate
    return deduplicate(load(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without line chunks that stand at an earlier place."""
    from .line_chunks import deduplicate
    return deduplicate(load(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the weak-supervision verdict of every document."""
    from .quality_rules import judge
    return judge(load(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with the item contained in the document."""
    from .decontaminate import contained
    return contained(load(spark, sf_dir, "documents", "doc_id", "text"),
                     load(spark, sf_dir, "benchmark", "item_id", "text"))


SQL["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
         list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
         list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, n.n_item, count(*) AS n_shared
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY ds.doc_id, bs.item_id, n.n_item
HAVING 100 * count(*) >= 80 * n.n_item
"""


@register
def op7_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the host's consensus path."""
    from pyspark.sql import functions as F

    from .html_paths import main_text
    return main_text(load(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn(
        "n_chars", F.length("text").cast("long"))


@register
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and link component of every document."""
    from .ngram_join import link
    return link(load(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op10_prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier 100-byte string, removed."""
    from .prefix_parse import deduplicate
    return deduplicate(load(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for all documents, with corpus counts of the pairs."""
    from .token_align import align
    return align(load(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"),
                 tokenizer_file("piece_bpe_32k.model"))


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, every tenth of them made periodic, and the collapsed texts."""
    from .periodic_runs import collapse, digests, with_planted_runs
    return digests(collapse(with_planted_runs(load(spark, sf_dir, "documents", "doc_id", "text"))))


@register
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from .simhash import link
    return link(load(spark, sf_dir, "documents", "doc_id", "text"))
