"""Queries of the operators on texts, scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.llm import consensus, encoding, language, mixture, pair_defects, pieces, score_fusion
from folioforge.llm.sql import SQL  # noqa: F401  read by __spark_entry__
from folioforge.sources.tables import spread, table


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pieces.oversized(table(spark, sf_dir, "source_documents"), "document", "source_path", "content")
    passages = pieces.oversized(table(spark, sf_dir, "retrieved_passages"), "passage", "chunk_id", "text", dedupe=True)
    return documents.unionByName(passages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item beyond the limit and whether a chosen cut breaks a stretch that no piece can hold, from the pieces themselves."""
    return pieces.cut_kinds(pieces.pieces(_oversized(spark, sf_dir), with_text=False))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item beyond the limit, in order."""
    return pieces.pieces(_oversized(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a candidate that leads almost everywhere, from the fused ranking's standing in the lists."""
    fused = score_fusion.fuse_scores(table(spark, sf_dir, "retrieved_passages"), table(spark, sf_dir, "retrievers"))
    return score_fusion.leads_almost_everywhere(fused)


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking of every question."""
    fused = score_fusion.fuse_scores(table(spark, sf_dir, "retrieved_passages"), table(spark, sf_dir, "retrievers"))
    return fused.select("question_id", "rank", "chunk_id", F.round("fused", 9).alias("fused"), "in_lists", "n_lists")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of question and answer with its defect."""
    traces = table(spark, sf_dir, "run_traces")
    ends = pair_defects.end_counts(spread(traces.select("answer")))
    pairs = spread(traces.select("trace_id", "question", "answer"))
    languages = pair_defects.fit_languages(spread(traces.select("trace_id", "question", "answer", "context_sent_to_model")))
    found = pair_defects.find_defects(pairs, ends, languages)
    return found.filter("defect is not null and trace_id is not null").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces and labels whose consensus is true."""
    items, _ = consensus.fit(consensus.votes_of(table(spark, sf_dir, "answer_judgements")))
    return items.filter("posterior > 0.5").select(F.col("item").alias("trace_id"), "label")


def p6_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every annotator's confusion matrix per label."""
    return consensus.fit(consensus.votes_of(table(spark, sf_dir, "answer_judgements")))[1]


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement per label."""
    return consensus.agreement(consensus.votes_of(table(spark, sf_dir, "answer_judgements")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return encoding.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", ["doc_id"])


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded again from its ids, with whether it is what it was (null and empty texts come back empty)."""
    ids = encoding.encode(table(spark, sf_dir, "documents"), "text", ["doc_id", "text"])
    back = encoding.decode(ids, "ids", ["doc_id", "text"], "decoded")
    return back.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the mixture with its number of repetitions."""
    return mixture.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per listed source."""
    return mixture.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_targets"))[1]


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    texts = spread(documents.select("doc_id", "lang", "text"))
    return language.classify(texts, language.fit(texts))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, and languages of whole sentences besides the main one."""
    return language.found_cases(_classified(spark, sf_dir))


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document with a confidence."""
    return _classified(spark, sf_dir).select("doc_id", "label", F.col("main").alias("lang"), "confidence")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language with a confidence."""
    parts = _classified(spark, sf_dir).select("doc_id", F.explode("segments").alias("s"))
    return parts.select("doc_id", "s.no", "s.lang", "s.confidence", "s.sentences", "s.letters")


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_ranking, p4_found, p6_found, p6_annotators, p6_agreement, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_languages, p9_segments)}
