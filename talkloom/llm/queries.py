"""The queries of this subpackage: op1 to op13 and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.llm import bpe, chat, collocations, gif, lm_score, mixing, packing, quality, topk, url_filter, vector_code, warc
from talkloom.llm.prefix_join import jaccard_components


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark, sf_dir):
    own = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    return chat.digests(chat.format_chats(turns))


def op3_gif_media(spark, sf_dir):
    return gif.digests(gif.store_texts(read(spark, sf_dir, "documents")))


def op4_exact_topk(spark, sf_dir):
    return topk.exact_topk(read(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark, sf_dir):
    """Target: documents labelled good and not toxic; background: all."""
    labels = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = docs.join(mixing.checked(labels.withColumn("is_target", F.lit(True))), "doc_id", "left")
    return lm_score.cross_entropy_difference(flagged)


def op6_warc_merkle_audit(spark, sf_dir):
    return warc.audit(*warc.replicas(read(spark, sf_dir, "pages")))


def op7_source_mixing(spark, sf_dir):
    return mixing.plan(read(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    """Labelled URLs: pages whose id has a label; bad or toxic ones are to be blocked."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("label"))
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), labels)


def source_targets(spark, sf_dir):
    """What op7 aims at: sizes of documents and sources, and the targets; the columns of its plan that SQL can express."""
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def url_rules(spark, sf_dir):
    """The rules' part of op8: host, path, rule and its verdict, which SQL can express."""
    return url_filter.ruled(read(spark, sf_dir, "pages"))


def op9_bestfit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_vector_codes(spark, sf_dir):
    return vector_code.compress(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_bpe(spark, sf_dir):
    """The public 50,000-token byte-level vocabulary; its file is the driver's, executors get its text."""
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_gif_media, op4_exact_topk, op5_lm_scoring, op6_warc_merkle_audit, op7_source_mixing, source_targets, op8_url_filter, url_rules, op9_bestfit_packing, op10_quality_classifier, op11_vector_codes, op12_collocations, op13_bpe)}
ORACLE: dict[str, str] = {"op2_chat_formatting": chat.DIGESTS_SQL, "op4_exact_topk": topk.TOPK_SQL, "op6_warc_merkle_audit": warc.AUDIT_SQL, "source_targets": mixing.TARGETS_SQL, "url_rules": url_filter.RULES_SQL, "op11_vector_codes": vector_code.COMPRESS_SQL, "op12_collocations": collocations.COLLOCATIONS_SQL}
