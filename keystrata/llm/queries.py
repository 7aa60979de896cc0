"""The registered queries opN_<name> of this subpackage, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import spread, table


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark, sf_dir):
    from . import topk

    df = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.search(df, F.col("vec_id") % 100 == 0)


def op2_urls(spark, sf_dir):
    from . import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"), urlfilter.rules_frame(spark))


def op3_chat(spark, sf_dir):
    from . import toolcalls

    return toolcalls.link(spread(table(spark, sf_dir, "conversations")))


def op4_pieces(spark, sf_dir):
    from . import pieces

    return pieces.encode(spread(table(spark, sf_dir, "documents", "doc_id", "text")), model_path("piece_bpe_32k.model"), digest=True)


def op5_secrets(spark, sf_dir):
    from . import secrets

    return secrets.digest(secrets.scan(spread(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op6_media(spark, sf_dir):
    from . import media

    return media.read_media(media.to_media(spread(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op7_jaccard(spark, sf_dir):
    from . import jaccard

    return jaccard.join(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_toxicity(spark, sf_dir):
    from . import toxicity

    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_wrappers(spark, sf_dir):
    from . import wrappers

    return wrappers.main_text(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op10_packing(spark, sf_dir):
    from . import packing

    return packing.pack_documents(spread(table(spark, sf_dir, "documents", "doc_id", "text")), model_path("byte_bpe_50k.json"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_topk, op2_urls, op3_chat, op4_pieces, op5_secrets, op6_media, op7_jaccard, op8_toxicity, op9_wrappers, op10_packing, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql():
    from . import topk, urlfilter

    return {"op1_topk": topk.ORACLE, "op2_urls": urlfilter.ORACLE}
