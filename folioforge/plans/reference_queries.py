"""One query per operator, over the tables of the domain: source_documents are the corpus, gold_questions the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioforge.functions.text import is_heading, paragraphs, sentences, terms
from folioforge.functions.vectors import DIMENSIONS, cosine, hashed_embedding
from folioforge.operators import agent, answers, chunking, evaluate, filters, ranking, runs, sync
from folioforge.operators.incremental import instant
from folioforge.plans.reference_sql import SQL  # noqa: F401  read by __spark_entry__
from folioforge.session import cut
from folioforge.sources.store import stored_table
from folioforge.sources.tables import spread, table

CHUNK_SIZE = 500


def documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.corpus(spread(table(spark, d, "source_documents")))


def chunks(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    return chunking.chunk_table(documents(spark, d), chunking.markdown_chunks(F.col("content"), CHUNK_SIZE), "markdown-aware-v1", keep)


def _stored(spark: SparkSession, d: str, kind: str, build, **settings) -> DataFrame:
    """What follows from the corpus: made by the first query that needs it, see stored_table."""
    layout = {"strategy": "markdown-aware-v1", "chunk_size": CHUNK_SIZE, "version": 1} | settings
    return stored_table(spark, kind, layout, [f"{d}/source_documents.parquet"], build)


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "chunks", lambda: chunks(spark, d, ["status"]))


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The weighted postings, a chunk's own side by side."""
    return _stored(spark, d, "postings", lambda: ranking.weighted_postings(stored_chunks(spark, d)), k1=ranking.K1, b=ranking.B)


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "vectors", lambda: stored_chunks(spark, d).select("chunk_id", "source_path", hashed_embedding(F.col("text")).alias("embedding")), model="hashed", dimensions=DIMENSIONS)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_questions").select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text"))


def ranked_columns(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


# text and chunking -----------------------------------------------------------------------------------------------------
def tokenize_terms(spark, d):
    t = documents(spark, d).select("source_path", terms(F.col("content")).alias("t"))
    return t.select("source_path", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def term_frequency(spark, d):
    return ranking.postings(ranking.chunk_terms(chunks(spark, d))).select("chunk_id", "token", "tf")


def document_frequency(spark, d):
    return ranking.document_frequency(ranking.postings(ranking.chunk_terms(chunks(spark, d))))


def corpus_stats(spark, d):
    return ranking.corpus_stats(ranking.chunk_terms(chunks(spark, d))).select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def fixed_chunks(spark, d):
    made = chunking.chunk_table(documents(spark, d), chunking.fixed_chunks(F.col("content"), CHUNK_SIZE), "fixed-size-v1")
    return made.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def sentence_split(spark, d):
    s = documents(spark, d).select("source_path", F.posexplode(sentences(F.col("content"))).alias("n", "sentence"))
    return s.select("source_path", F.col("n").cast("long").alias("sentence_no"), "sentence")


def paragraph_blocks(spark, d):
    p = documents(spark, d).select("source_path", F.posexplode(paragraphs(F.col("content"))).alias("n", "block"))
    return p.select("source_path", F.col("n").cast("long").alias("block_no"), "block", is_heading(F.col("block")).alias("is_heading"))


def markdown_chunks(spark, d):
    return chunks(spark, d).select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def chunk_offsets(spark, d):
    made = chunking.chunk_table(documents(spark, d), chunking.markdown_chunks(F.col("content"), CHUNK_SIZE), "markdown-aware-v1", with_offsets=True)
    return made.select("chunk_id", F.col("character_start").cast("long").alias("character_start"), F.col("character_end").cast("long").alias("character_end"))


def semantic_units(spark, d):
    u = documents(spark, d).select("source_path", F.posexplode(chunking.semantic_units(F.col("content"))).alias("n", "unit"))
    return u.select("source_path", F.col("n").cast("long").alias("unit_no"), "unit")


def semantic_chunks(spark, d):
    docs = documents(spark, d).withColumn("units", chunking.semantic_units(F.col("content")))
    docs = docs.withColumn("vectors", F.transform("units", lambda u: hashed_embedding(u)))
    made = chunking.chunk_table(docs, chunking.pack_units(F.col("units"), F.col("vectors"), CHUNK_SIZE, 200, 0.3), "semantic-v1")
    return made.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


# filters ---------------------------------------------------------------------------------------------------------------
def _indexed(spark, d):
    return filters.index_columns(table(spark, d, "source_documents"))



def index_metadata(spark, d):
    return _indexed(spark, d).select(
        "source_path", "document_family", "is_current_version", F.col("effective_date_ordinal").cast("long").alias("effective_date_ordinal"),
        F.col("expiry_date_ordinal").cast("long").alias("expiry_date_ordinal"),
    )


def filter_current(spark, d):
    return _indexed(spark, d).filter(filters.compile_filter({"is_current_version": {"$eq": True}})).select("source_path", "document_family")


def filter_exact_version(spark, d):
    return _indexed(spark, d).filter(filters.compile_filter({"$and": [{"status": {"$eq": "current"}}, {"version": {"$eq": "1.2"}}]})).select("source_path", "version")


def filter_as_of(spark, d):
    day = filters.iso_date("2024-06-01")
    spec = {"$and": [{"effective_date": {"$lte": day}}, {"expiry_or_open": {"$gte": day}}]}
    return _indexed(spark, d).filter(filters.compile_filter(spec)).select("source_path", "version")


def filter_or_scope(spark, d):
    spec = {"$or": [{"status": {"$eq": "draft"}}, {"version": {"$lte": "1.5"}}, {"version": {"$gte": "4.5"}}]}
    return _indexed(spark, d).filter(filters.compile_filter(spec)).select("source_path", "status", "version")


def as_of_join(spark, d):
    probes = table(spark, d, "metadata_snapshots").select(F.trim("document_id").alias("family"), F.col("snapshot_date").alias("day")).na.drop().distinct()
    return filters.as_of_join(probes, table(spark, d, "source_documents")).select("family", "day", "source_path", "version")


# ranking ---------------------------------------------------------------------------------------------------------------
def bm25_topk(spark, d):
    return ranked_columns(_keyword(spark, d, questions(spark, d)))


def _keyword(spark, d, q, k=ranking.TOP):
    return ranking.bm25_indexed(q, stored_index(spark, d), k)


def bm25_filtered(spark, d):
    kept = stored_chunks(spark, d).filter(filters.compile_filter({"status": {"$eq": "current"}})).select("chunk_id")
    return ranked_columns(ranking.bm25_indexed(questions(spark, d), stored_index(spark, d).join(kept, "chunk_id", "left_semi")))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label", "vec_id")


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def knn_cosine_topk(spark, d):
    return ranked_columns(ranking.nearest(_vector_queries(spark, d), _vectors(spark, d), 10))


def knn_filtered(spark, d):
    return ranked_columns(ranking.nearest(_vector_queries(spark, d), _vectors(spark, d), 10, filters.compile_filter({"label": {"$gte": 5}})))


def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def semantic_topk(spark, d):
    q = questions(spark, d).select("query_id", hashed_embedding(F.col("text")).alias("embedding"))
    return ranked_columns(ranking.nearest(q, stored_vectors(spark, d).drop("source_path"), 5))


def hybrid_rrf(spark, d):
    return ranked_columns(_hybrid(spark, d, questions(spark, d), 5))


def rerank_overlap(spark, d):
    q = questions(spark, d)
    return ranked_columns(ranking.rerank(_keyword(spark, d, q, ranking.CANDIDATES), q, stored_chunks(spark, d)))


def rerank_hybrid(spark, d):
    q = questions(spark, d)
    return ranked_columns(ranking.rerank(_hybrid(spark, d, q), q, stored_chunks(spark, d)))


def _hybrid(spark, d, q, k=ranking.CANDIDATES):
    return ranking.hybrid_indexed(q, stored_vectors(spark, d), stored_index(spark, d), hashed_embedding, k)


def document_scoped(spark, d):
    q, index = questions(spark, d), stored_index(spark, d)
    return ranked_columns(ranking.scoped(ranking.bm25_indexed(q, index, ranking.CANDIDATES), q, index))


def neighbor_expand(spark, d):
    r = cut(_keyword(spark, d, questions(spark, d)))  # read for the places, the origins and what is there already
    return ranked_columns(ranking.neighbours(r, stored_chunks(spark, d), 1, 3))


def parent_documents(spark, d):
    return ranked_columns(ranking.parents(_keyword(spark, d, questions(spark, d)), documents(spark, d)))


def parent_with_limit(spark, d):
    return ranked_columns(ranking.parents(_keyword(spark, d, questions(spark, d)), documents(spark, d), 1500))


def _responses(spark, d):
    """What a decomposing model may return: the question itself, list marks, quotes, a repetition."""
    g = table(spark, d, "gold_questions")
    text = F.concat_ws("\n", F.concat(F.lit("- "), "question"), F.concat(F.lit('1. "'), "expected_answer", F.lit('"')), F.concat(F.lit("2) "), "concept"), F.concat(F.lit("* "), F.upper("concept")), F.lit("```"), F.concat(F.lit("3. "), "difficulty"))
    return g.select(F.col("id").alias("query_id"), "question", text.alias("response"))


def parse_subqueries(spark, d):
    return ranking.parse_subqueries(_responses(spark, d)).select("query_id", F.col("sub_no").cast("long").alias("sub_no"), "text")


def _decomposed(spark, d):
    every = ranking.with_subqueries(questions(spark, d), ranking.parse_subqueries(_responses(spark, d)))
    return ranking.lists_of(every, _keyword(spark, d, every.select("query_id", "text"), ranking.CANDIDATES))


def _decomposed_hybrid(spark, d):
    every = ranking.with_subqueries(questions(spark, d), ranking.parse_subqueries(_responses(spark, d)))
    return ranking.lists_of_texts(every, lambda q: _hybrid(spark, d, q))


def decompose_rrf(spark, d):
    return ranked_columns(ranking.rrf_tagged(_decomposed(spark, d)))


def decompose_coverage(spark, d):
    tagged = cut(_decomposed(spark, d))  # read by the fusion and the coverage
    return ranked_columns(ranking.with_coverage(tagged, ranking.rrf_tagged(tagged), 1))


def decompose_hybrid_rrf(spark, d):
    return ranked_columns(ranking.rrf_tagged(_decomposed_hybrid(spark, d)))


def decompose_hybrid_coverage(spark, d):
    tagged = cut(_decomposed_hybrid(spark, d))  # read by the fusion and the coverage
    return ranked_columns(ranking.with_coverage(tagged, ranking.rrf_tagged(tagged), 1))


def _followups(spark, d):
    return table(spark, d, "gold_questions").select(F.col("id").alias("query_id"), F.when(F.col("answerable"), F.col("expected_answer")).alias("text"))


def multihop_rrf(spark, d):
    return ranked_columns(ranking.multi_hop(questions(spark, d), _followups(spark, d), lambda q, k: _keyword(spark, d, q, k)))


def multihop_hybrid_rrf(spark, d):
    return ranked_columns(ranking.multi_hop(questions(spark, d), _followups(spark, d), lambda q, k: _hybrid(spark, d, q, k)))


def _first_line(question, evidence):
    """What a model may ask next: the first line of the best passage. A stand-in for the follow-up model."""
    return F.regexp_extract(evidence, r"\A\[Evidence 1\]\n([^\n]*)", 1)


def multihop_evidence_rrf(spark, d):
    """The follow-up is made from the best passages of the first pass."""
    return ranked_columns(ranking.multi_hop_from_evidence(questions(spark, d), stored_chunks(spark, d), lambda q, k: _keyword(spark, d, q, k), _first_line))


def scoped_hybrid_filtered(spark, d):
    """Both passes of the document-scoped hybrid strategy, over current versions only."""
    keep = filters.compile_filter({"status": {"$eq": "current"}})
    return ranked_columns(ranking.retrieve("scoped", questions(spark, d), stored_chunks(spark, d), documents(spark, d), hashed_embedding, keep=keep))


def _passages(spark, d, found, c):
    docs = table(spark, d, "source_documents").select("source_path", "doc_id", "version", "status", F.col("metadata")["department"].alias("department"))
    found = found.join(c.select("chunk_id", "text"), "chunk_id").join(docs, "source_path", "left")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), agent.format_passage().alias("passage"))


def search_documents(spark, d):
    """Over the keyword list alone, as its SQL; search_documents_hybrid is the reference's tool."""
    return _passages(spark, d, _keyword(spark, d, questions(spark, d), agent.clamp(3, 1, 20)), stored_chunks(spark, d))


def search_documents_hybrid(spark, d):
    return _passages(spark, d, _hybrid(spark, d, questions(spark, d), agent.clamp(3, 1, 20)), stored_chunks(spark, d))


# evaluation ------------------------------------------------------------------------------------------------------------
def _pairs(spark, d):
    g = table(spark, d, "gold_questions").select(F.col("id").alias("question_id"), "source_files", "answerable", "concept", "expected_answer")
    t = table(spark, d, "run_traces").select("trace_id", "question_id", "retrieved_chunks", "answer", "error", "context_sent_to_model", "question")
    return t.join(g, "question_id")


def _metrics(spark, d):
    return evaluate.retrieval_metrics(_pairs(spark, d))


def retrieval_metrics(spark, d):
    cols = [F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")]
    return _metrics(spark, d).select("trace_id", *cols)


def retrieval_summary(spark, d):
    s = evaluate.retrieval_summary(_metrics(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def first_relevant_rank(spark, d):
    return evaluate.first_relevant(_pairs(spark, d).filter("answerable")).select("trace_id", F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"))


def concept_scorecard(spark, d):
    c = evaluate.concept_scorecard(_pairs(spark, d))
    return c.withColumn("mrr", F.round("mrr", 6))


def scorecard_report(spark, d):
    return evaluate.format_scorecard(evaluate.concept_scorecard(_pairs(spark, d)))


def unanswered_questions(spark, d):
    """Questions that no trace answered, without an error, from more than its first passage."""
    g, t = table(spark, d, "gold_questions").select(F.col("id").alias("question_id")), table(spark, d, "run_traces")
    return g.join(t.filter("error is null and contains(answer, '[S2]')").select("question_id"), "question_id", "left_anti")


def labeled_context(spark, d):
    ranked = _keyword(spark, d, questions(spark, d)).join(stored_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return answers.labelled_context(ranked)


def citation_validation(spark, d):
    t = table(spark, d, "run_traces").filter("error is null").select("trace_id", "answer", F.transform("retrieved_chunks", lambda x: F.struct(x["rank"].alias("rank"), x["chunk_id"].alias("chunk_id"))).alias("passages"))
    g = answers.ground(t)
    return g.select("trace_id", "grounding_error", F.array_join("cited_chunk_ids", ",").alias("cited"), F.sha2(F.coalesce("final_answer", F.lit("")), 256).alias("final_sha256"))


def answer_metrics(spark, d):
    return evaluate.answer_metrics(_pairs(spark, d)).select("trace_id", "produced_answer", "refused", "citations_valid", "cites_expected_source", "has_error")


def answer_summary(spark, d):
    s = evaluate.answer_summary(evaluate.answer_metrics(_pairs(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def evaluate_retrieval(spark, d):
    """Every question through the keyword retriever, with its metrics."""
    metrics = runs.evaluate_retrieval(table(spark, d, "gold_questions"), _keyword(spark, d, questions(spark, d)))[1]
    cols = [F.round(c, 9).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")]
    return metrics.select("question_id", F.size("retrieved_chunks").cast("long").alias("n_chunks"), *cols)


def _answering(system, user):
    """A stand-in for the answering model: it cites, forgets to cite, cites what it was not given, or fails."""
    n = F.length(user)
    text = F.when(n % 7 == 0, "No label.").when(n % 7 == 1, "From [S9].").otherwise(F.concat(F.lit("The passages [S2] [S1] have "), n.cast("string"), F.lit(" characters.")))
    failed = n % 7 == 2
    return F.struct(F.when(~failed, text).alias("text"), F.when(failed, "TimeoutError: no response").alias("error"))


def answer_runs(spark, d):
    """Every question answered over its best passages, errors in their rows."""
    ranked = _keyword(spark, d, questions(spark, d), 3).join(stored_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    t = runs.answer_questions(questions(spark, d), ranked, _answering, config={"retriever": "keyword"})
    return t.select("question_id", "answer", "error", F.array_join("cited_chunk_ids", ",").alias("cited"), F.sha2(F.coalesce("context_sent_to_model", F.lit("")), 256).alias("context_sha256"))


def _judging(system, user):
    """A stand-in for the judging model: verdicts by the prompt's length, sometimes no JSON, sometimes a failure."""
    n = F.length(user)
    flag = lambda k: F.when(n % k == 0, "true").otherwise("false")
    text = F.concat(F.lit('{"correct": '), flag(2), F.lit(', "citation_supported": '), flag(3), F.lit(', "used_correct_version": '), flag(5), F.lit(', "proper_refusal": '), flag(7), F.lit(', "reason": "by length"}'))
    failed = n % 11 == 1
    return F.struct(F.when(~failed, F.when(n % 11 == 0, "I cannot judge this.").otherwise(text)).alias("text"), F.when(failed, "TimeoutError: no response").alias("error"))


def rejudge(spark, d):
    """Saved traces judged again, over the questions that they cover."""
    verdicts, _ = runs.rejudge(table(spark, d, "gold_questions"), table(spark, d, "run_traces"), _judging)
    return verdicts.select("trace_id", *answers.VERDICTS, "error", "failure_stage")


def _judge_responses(spark, d):
    """Responses as a judging model may write them, from stored verdicts: prose around JSON, strings for booleans, no reason."""
    j = table(spark, d, "answer_judgements")
    body = F.to_json(F.struct("correct", "citation_supported", "used_correct_version", "proper_refusal", "reason"), {"ignoreNullFields": "false"})
    text = (
        F.when(F.col("judgement_id") % 7 == 0, F.lit("I cannot judge this."))
        .when(F.col("judgement_id") % 7 == 1, F.regexp_replace(body, "true", '"true"'))
        .otherwise(F.concat(F.lit("Here is my verdict:\n"), body, F.lit("\nEnd.")))
    )
    return j.select("judgement_id", "question_id", "trace_id", text.alias("response"))


def judge_parse(spark, d):
    return answers.parse_verdicts(_judge_responses(spark, d)).drop("question_id", "trace_id", "response")


def _judged(spark, d):
    g = table(spark, d, "gold_questions").select(F.col("id").alias("question_id"), "answerable")
    t = table(spark, d, "run_traces").select("trace_id", "answer", F.col("error").alias("trace_error"))
    return answers.judge(_judge_responses(spark, d).join(g, "question_id").join(t, "trace_id"))


def judge_decisions(spark, d):
    return _judged(spark, d).select("judgement_id", *answers.VERDICTS, "error", "failure_stage")


def judgement_summary(spark, d):
    s = evaluate.judgement_summary(_judged(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def judge_prompts(spark, d):
    g = table(spark, d, "gold_questions").select(F.col("id").alias("question_id"), "question", "answerable", "expected_answer", "source_files")
    t = table(spark, d, "run_traces").select("trace_id", "question_id", "answer", F.col("context_sent_to_model").alias("context"))
    return t.join(g, "question_id").select("trace_id", F.sha2(answers.judge_prompt(), 256).alias("prompt_sha256"))


def _verdict_sets(spark, d):
    """Two sets of verdicts on traces: the latest by a person and the latest by a model."""
    kinds = table(spark, d, "annotators").select("annotator", "kind")
    j = table(spark, d, "answer_judgements").filter("trace_id is not null").join(F.broadcast(kinds), "annotator")  # annotators is a fixed table
    one = evaluate.latest_per(j, ["trace_id", "kind"])
    return evaluate.paired(one.filter("kind = 'human'"), one.filter("kind = 'model'"), "trace_id")


def judge_agreement(spark, d):
    a = evaluate.agreement(_verdict_sets(spark, d), "trace_id")
    return a.withColumn("agreement_rate", F.round("agreement_rate", 6)).withColumn("kappa", F.round("kappa", 6))


def judge_disagreements(spark, d):
    return evaluate.disagreements(_verdict_sets(spark, d), "trace_id").select("trace_id", "label", "a", "b")


def run_comparison(spark, d):
    c = evaluate.compare_runs(_verdict_sets(spark, d), "trace_id")
    c = c.withColumn("p_value", F.col("p_value") + 1e-12)
    return c.select(*[F.round(x, 6).alias(x) if t == "double" else F.col(x) for x, t in c.dtypes])


def changed_verdicts(spark, d):
    return evaluate.changed(_verdict_sets(spark, d), "trace_id")


def mcnemar(spark, d):
    """p-values of changes per question concept, where counts are small."""
    g = table(spark, d, "run_traces").join(table(spark, d, "gold_questions").select(F.col("id").alias("question_id"), "concept", "difficulty"), "question_id")
    both = evaluate.by_label(_verdict_sets(spark, d), "trace_id").join(g.select("trace_id", "concept", "difficulty"), "trace_id")
    n = both.groupBy("label", "concept", "difficulty").agg(F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"))
    return n.withColumn("p_value", F.round(evaluate.mcnemar(F.col("fixed"), F.col("broken")) + 1e-12, 9))  # exact halves round the same way everywhere


# upkeep ----------------------------------------------------------------------------------------------------------------
def _manifest(spark, d):
    """The latest entry per path."""
    m = table(spark, d, "manifest_entries")
    best = F.struct(F.coalesce(instant(F.col("indexed_at")), F.lit(-(2**63) + 1)).alias("at"), "delivery", "entry_id", F.lower(F.trim("content_sha256")).alias("content_sha256"), F.lower(F.trim("metadata_sha256")).alias("metadata_sha256"), "chunk_ids", "indexed_at")
    latest = m.filter("source_path is not null").groupBy("source_path").agg(F.max(best).alias("b"))
    return latest.select("source_path", "b.content_sha256", "b.metadata_sha256", "b.chunk_ids", "b.indexed_at")


def _shifted_manifest(spark, d):
    """A manifest of the corpus as it may have been before: some paths unknown, contents or metadata other, some paths since gone."""
    h = sync.hashes(table(spark, d, "source_documents"))
    k = F.conv(F.substring(F.md5("source_path"), 1, 6), 16, 10).cast("long")
    kept = h.filter(k % 13 != 0).select(
        "source_path", F.when(k % 5 == 0, F.lit("0")).otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(k % 7 == 0, F.lit("0")).otherwise(F.col("metadata_sha256")).alias("metadata_sha256")
    )
    gone = h.filter(k % 11 == 0).select(F.concat("source_path", F.lit(".old")).alias("source_path"), "content_sha256", "metadata_sha256")
    return kept.unionByName(gone)


def content_hash(spark, d):
    return sync.hashes(table(spark, d, "source_documents")).select("source_path", "content_sha256", "metadata_sha256")


def sync_plan(spark, d):
    return sync.plan(table(spark, d, "source_documents"), _shifted_manifest(spark, d))


def sync_plan_stored(spark, d):
    return sync.plan(table(spark, d, "source_documents"), _manifest(spark, d))


def sync_stale_chunks(spark, d):
    return sync.stale_chunks(_manifest(spark, d), chunks(spark, d))


def _applied(spark, d):
    c = chunks(spark, d)
    # stored vectors are twice the fresh ones, so that a reused vector can be told from a new one
    stored = c.select("chunk_id", "source_path", F.transform(hashed_embedding(F.col("text")), lambda x: 2 * x).alias("embedding"))
    return sync.apply_plan(sync_plan(spark, d), stored, c, hashed_embedding)


def sync_apply_vectors(spark, d):
    """Every chunk after the plan with the norm and the weighted sum of its vector."""
    e = _applied(spark, d)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("chunk_id", "kind", F.round(norm, 6).alias("norm"), weighted.alias("weighted"))


def sync_apply(spark, d):
    """Counts per kind only; sync_apply_vectors has the chunks and their vectors."""
    done = _applied(spark, d)
    return done.groupBy("kind").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("source_path").alias("n_documents"))


def sync_manifest(spark, d):
    docs, old = table(spark, d, "source_documents"), _manifest(spark, d)
    made = sync.new_manifest(docs, sync.plan(docs, old), old, chunks(spark, d), F.lit("2026-01-01T00:00:00+00:00"))
    return made.select("source_path", "document_id", "version", "content_sha256", F.array_join("chunk_ids", ",").alias("chunk_ids"), "indexed_at")


# agent -----------------------------------------------------------------------------------------------------------------
def _histories(spark, d):
    """Message histories of the traces: one search per query used, its result lines, a last call without a result, an answer."""
    t = table(spark, d, "run_traces")
    ident = lambda i: F.concat(F.lit("t"), i.cast("string"))
    none_text, none_use, none_res = F.lit(None).cast("string"), F.lit(None).cast("struct<toolUseId:string,name:string,query:string>"), F.lit(None).cast("struct<toolUseId:string,status:string,text:string>")
    block = lambda text=none_text, use=none_use, res=none_res: F.struct(text.alias("text"), use.alias("toolUse"), res.alias("toolResult"))
    message = lambda role, b: F.struct(F.lit(role).alias("role"), F.array(b).alias("content"))
    lines = F.array_join(F.transform("retrieved_chunks", lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] chunk_id: "), c["chunk_id"])), "\n")
    use = lambda i, q: F.struct(ident(i).alias("toolUseId"), F.lit("search_documents").alias("name"), q.alias("query"))
    result = lambda i: F.struct(ident(i).alias("toolUseId"), F.lit(None).cast("string").alias("status"), F.coalesce(lines, F.lit("")).alias("text"))
    calls = F.flatten(F.transform(F.coalesce("queries_used", F.array().cast("array<string>")), lambda q, i: F.array(message("assistant", block(use=use(i, q))), message("user", block(res=result(i))))))
    open_call = F.array(message("assistant", block(use=use(F.lit(99), F.col("question")))))
    return t.select("trace_id", F.concat(F.array(message("user", block(text=F.col("question")))), calls, open_call).cast(agent.MESSAGES).alias("messages"))


def agent_tool_calls(spark, d):
    c = agent.tool_calls(_histories(spark, d))
    return c.select("trace_id", F.col("call_no").cast("long").alias("call_no"), "name", "query", "status", F.col("result_chars").cast("long").alias("result_chars"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


def agent_first_sighting(spark, d):
    return agent.first_sightings(agent.tool_calls(_histories(spark, d))).select("trace_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "source_path")


def agent_strip_tool_use(spark, d):
    h = _histories(spark, d).select("trace_id", F.size("messages").alias("n"), agent.strip_trailing_tool_use(F.col("messages")).alias("m"))
    said = lambda b: F.concat_ws("/", b["text"], b["toolUse"]["query"], b["toolResult"]["text"])
    whole = F.array_join(F.transform("m", lambda x: F.concat_ws("|", x["role"], F.array_join(F.transform(x["content"], said), ";"))), "\n")
    return h.select("trace_id", F.col("n").cast("long").alias("n_before"), F.size("m").cast("long").alias("n_after"), F.sha2(whole, 256).alias("messages_sha256"))


def list_versions(spark, d):
    return agent.list_versions(table(spark, d, "source_documents")).select("doc_id", F.col("position").cast("long").alias("position"), "line")


def read_document_truncate(spark, d):
    return agent.read_document(table(spark, d, "source_documents"), 1000)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_frequency, document_frequency, corpus_stats, fixed_chunks, sentence_split, paragraph_blocks, markdown_chunks, chunk_offsets, semantic_units,
        semantic_chunks, index_metadata, filter_current, filter_exact_version, filter_as_of, filter_or_scope, as_of_join, bm25_topk, bm25_filtered, knn_cosine_topk, knn_filtered,
        cosine_pairs, semantic_topk, hybrid_rrf, rerank_overlap, rerank_hybrid, document_scoped, neighbor_expand, parent_documents, parent_with_limit, parse_subqueries, decompose_rrf,
        decompose_coverage, decompose_hybrid_rrf, decompose_hybrid_coverage, multihop_rrf, multihop_hybrid_rrf, multihop_evidence_rrf, scoped_hybrid_filtered, evaluate_retrieval, answer_runs, rejudge, search_documents, search_documents_hybrid, retrieval_metrics, retrieval_summary, first_relevant_rank, concept_scorecard, scorecard_report, unanswered_questions,
        labeled_context, citation_validation, answer_metrics, answer_summary, judge_parse, judge_decisions, judgement_summary, judge_prompts, judge_agreement, judge_disagreements,
        run_comparison, changed_verdicts, mcnemar, content_hash, sync_plan, sync_plan_stored, sync_stale_chunks, sync_apply, sync_apply_vectors, sync_manifest, agent_tool_calls, agent_first_sighting,
        agent_strip_tool_use, list_versions, read_document_truncate,
    )
}
