"""The operators as queries over the given tables, with production parameters, and their SQL."""

from pyspark.sql import functions as F

from metaudit.llm import sql
from metaudit.llm.conversation_trie import digested, joined_ends, numbered, prefix_trie
from metaudit.llm.decontamination import contamination
from metaudit.llm.fill_in_middle import fill_in_middle, restored
from metaudit.llm.jaccard_join import similar_groups
from metaudit.llm.language_id import language_ids
from metaudit.llm.ngram_lm import lm_scores
from metaudit.llm.personal_data import KINDS, personal_spans
from metaudit.llm.quality_classifier import quality_scores
from metaudit.llm.quality_rules import repetition_rules
from metaudit.llm.source_mixing import mix_sources
from metaudit.llm.substring_dedup import drop_repeated_passages
from metaudit.llm.texts import held_out
from metaudit.llm.token_counts import token_counts
from metaudit.llm.url_filters import judge_urls

QUERIES, ORACLES = {}, {}

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def register(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    training = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    scores = quality_scores(docs, training)
    return scores.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@register
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_ids(docs, docs.where(~held_out("doc_id", 5, 0)))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


@register
def op3_quality_rules(spark, sf_dir):
    found = repetition_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        "kept")


@register
def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@register
def op9_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@register
def op4_ngram_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = lm_scores(docs, docs.where(~held_out("doc_id", 10, 0)))
    return scores.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@register
def op10_substring_dedup(spark, sf_dir):
    found = drop_repeated_passages(table(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@register
def op6_jaccard_join(spark, sf_dir):
    found = similar_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_copies")


@register
def op5_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@register
def op8_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register
def op13_personal_data(spark, sf_dir):
    found = personal_spans(table(spark, sf_dir, "documents"))
    rules = F.filter("spans", lambda s: s["by"] == "rule")

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(rules, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(named(rules), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def grafted(turns, every=20):
    """Turns (conv, turn, key, words) with the heads of each conversation taken from its base, and all conversations."""
    placed = numbered(turns)
    base = F.col("conv") - F.col("conv") % every
    taken = F.crc32(F.col("conv").cast("string")) % 4
    members = turns.select("conv").distinct()
    heads = placed.where((F.col("conv") % every == 0) & (F.col("position") < 3)).withColumnRenamed("conv", "base")
    heads = members.select("conv", base.alias("base"), taken.alias("h")).join(heads, "base").where("position < h")
    own = placed.where(F.col("position") >= taken)
    shift = F.lit(4).cast("long")
    return (heads.select("conv", F.col("position").alias("turn"), "key", "words")
            .unionByName(own.select("conv", (F.col("position") + shift).alias("turn"), "key", "words"))), members


@register
def op12_conversation_trie(spark, sf_dir):
    turns, members = grafted(digested(table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie(turns, members)
    alone = F.when(F.col("n_ends") == 1, F.col("conv_id").cast("string"))
    single = nodes.where("n_convs = 1").withColumn("ids", alone)
    shared = nodes.where("n_convs > 1").join(joined_ends(ends), ["conv_id", "depth"], "left")
    return single.unionByName(shared).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("ends_sha256"))


ORACLES.update(op3_quality_rules=sql.quality_rules(), op6_jaccard_join=sql.jaccard_join(),
               op9_url_filters=sql.url_filters(URL_RULES), op10_substring_dedup=sql.substring_dedup(),
               op11_fill_in_middle=sql.fill_in_middle(), op12_conversation_trie=sql.conversation_trie())
