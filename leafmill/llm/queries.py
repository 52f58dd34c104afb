"""The registered queries: each operator over its whole table, with production
parameters, reduced to the columns of its contract."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import common

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; LEAFMILL_TOKENIZERS overrides its folder."""
    folder = os.environ.get("LEAFMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as codes, in id order, and read back. Odd rows are as in the operator."""
    from leafmill.llm import dac

    segments = dac.write_segments(
        common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2
    )
    return dac.read_documents(segments)


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its significant passages as first:last words. Odd rows are as in the operator."""
    from leafmill.llm import toxicity

    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_passages",
        F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["first"].cast("string"), p["last"].cast("string"))), ",").alias("passages"),
    )


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to. Odd rows are as in the operator."""
    import public_tokenizers

    from leafmill.llm import bpe

    return bpe.round_trip(
        common.table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. Odd rows are as in the operator."""
    from leafmill.llm import quality

    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences. Odd rows are as in the operator."""
    from leafmill.llm import packing

    cut = packing.pieces(
        common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, 1024
    )
    return packing.pack(cut, 1024)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth id. Odd rows are as in the operator."""
    from leafmill.llm import ann

    vectors = common.table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, factor=0.5)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the groups they are linked to. Odd rows are as in the operator."""
    from leafmill.llm import simhash

    found = simhash.components(common.table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored audio of all texts, read back, with its features and PCM. Odd rows are as in the operator."""
    from leafmill.llm import audio

    return audio.digest(audio.store_texts(common.table(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document; blocks as label:first:last. Odd rows are as in the operator."""
    from leafmill.llm import licenses

    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    place = lambda b: F.concat_ws(":", b["label"], b["first"].cast("string"), b["last"].cast("string"))
    return found.withColumn("blocks", F.array_join(F.transform("blocks", place), ","))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages of lines. Odd rows are as in the operator."""
    from leafmill.llm import lines

    return lines.dedup(common.table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    from leafmill.llm import secrets

    return secrets.digest(secrets.scan(common.table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector, one row for each component;
    a deviation beyond a long is null."""
    from leafmill.llm import whitening

    vectors, form = common.table(spark, sf_dir, "embeddings"), {"scale": 64.0, "offset": 1_000_000}
    whole = whitening.transform(vectors, whitening.fit(vectors, 16, **form), **form)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return whole.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact distance of every vector; numbers beyond a long are null."""
    from leafmill.llm import clustering

    found = clustering.cluster(common.table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, seed=1, scale=64.0)
    text = F.array_join(F.transform("centroid", lambda v: v.cast("string")), ",")
    longs = [F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("distance", "cluster_inertia", "inertia")]
    return found.select("vec_id", "cluster", *longs, F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_codes, op2_toxic_passages, op3_sequence_packing, op4_byte_level_bpe, op5_quality_classifier, op6_nearest_neighbours, op7_simhash_near_dedup, op8_telephony_audio, op9_license_scan, op10_line_dedup, op11_secret_scan, op12_embedding_whitening, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    """The exact operators that SQL expresses; the others hold tokenizers,
    hashes, learned scores or searches, and are tested by brute force."""
    from leafmill.llm import oracles

    return {"op9_license_scan": oracles.license_scan(), "op13_centroid_clustering": oracles.centroid_clustering()}
