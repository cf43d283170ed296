"""The registered queries opN_<name>: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from epiframe.llm import (chat, edit_counts, hnsw, language, line_runs, packing, pieces, projection_dedup, simhash, spelling,
                          stripes, toxicity, url_tree)
from epiframe.llm.common import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_groups(spark, sf_dir):
    """SimHash of 3-word shingles of every document, linked at 2 or fewer differing bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op2_nearest(spark, sf_dir):
    """20 nearest embeddings by inner product of every vec_id divisible by 20, from a graph per shard."""
    vectors = table(spark, sf_dir, "embeddings")
    stored = cut(hnsw.index(vectors, k=20), "hnsw")
    return hnsw.nearest(stored, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def edit_log(docs):
    """Stand-in edits (doc_id, seq, start, stop, insert): three per document, at places a hash picks."""
    n = F.coalesce(F.length("text"), F.lit(0))
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(n).alias("n"), F.max("source").alias("source"))
    seq = one.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = F.pmod(F.xxhash64("doc_id", "seq"), F.col("n") + 1).cast("int")
    return seq.select("doc_id", "seq", start.alias("start"),
                      (start + F.pmod(F.xxhash64("seq", "doc_id"), F.lit(40))).cast("int").alias("stop"),
                      F.concat(F.lit(" see "), F.coalesce("source", F.lit("note")), F.lit(", \n and")).alias("insert"))


@query
def op3_token_counts(spark, sf_dir):
    """Tokens of every whole document, and after the edits of a log, by re-encoding only what they touch."""
    docs = table(spark, sf_dir, "documents")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = cut(edit_counts.trees(docs, ranks, pattern), "trees")
    return edit_counts.recount(docs, state, edit_log(docs), ranks, pattern)


def folds(docs, of: int, held: int):
    """``docs`` plus held_out: whether crc32 of the id as text leaves remainder ``held`` modulo ``of``."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == held, F.lit(False)))


@query
def op4_language(spark, sf_dir):
    """Language of every whole text, learned from the rows of two folds in three."""
    docs = folds(table(spark, sf_dir, "documents"), 3, 1)
    model = language.train(docs.where("not held_out"), public_tokenizers.path("piece_bpe_32k.model"))
    return language.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity of every whole text by weak supervision, labels learned from four folds in five."""
    docs = folds(table(spark, sf_dir, "documents"), 5, 0)
    labels = folds(table(spark, sf_dir, "labels"), 5, 0).where("not held_out")
    scored = toxicity.score_documents(docs, labels, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op6_embedding_dedup(spark, sf_dir):
    """Near-duplicate embeddings (cosine >= 0.9) by sorted projection passes."""
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op7_pieces(spark, sf_dir):
    """SentencePiece ids of every document by merge rounds, an end id last, decoded again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode(table(spark, sf_dir, "documents"), path, with_decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_packing(spark, sf_dir):
    """All documents, cut only where longer than 4096 tokens, packed into sequences of 4096 by linear grouping."""
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096)
    return packing.pack(parts, size=4096)


#: The rules of the URL filter: verdict, host, path.
RULES = [url_tree.Rule("allow", "com", "/"), url_tree.Rule("block", "example.com", "/en/"),
         url_tree.Rule("allow", "www.example.com", "/en/"), url_tree.Rule("block", "net", "/es/"),
         url_tree.Rule("block", "net", "/fr/")]


@query
def op10_url_filter(spark, sf_dir):
    """Verdict on every page url: the longest rule that fits, else its path template's smoothed purity."""
    return url_tree.judge(table(spark, sf_dir, "pages"), RULES)


@query
def op9_chat_format(spark, sf_dir):
    """Every conversation, and conversation -7 of control strings, formatted and read back.

    Rows by turn are one of the layouts: each row becomes a JSON record, whose
    fingerprint selects the mapping."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(tricky).alias("text"))
    rows = rows.unionByName(probe)
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat.digests(chat.format_records(records))


@query
def op11_line_dedup(spark, sf_dir):
    """Lines that several documents hold stay only in the smallest doc_id, by sorted runs of line hashes."""
    rows = line_runs.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_spelling_variants(spark, sf_dir):
    """Words one edit apart in all documents, by dense prefix-suffix tiles, and the form each is a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark, sf_dir):
    """Per language the 2,000 best phrases of 2 to 5 words, counted by stripes of next words."""
    return stripes.collocations(table(spark, sf_dir, "documents"))
