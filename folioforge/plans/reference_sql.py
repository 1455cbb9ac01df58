"""SQL with the same columns and rows as the queries of the operators."""

from __future__ import annotations

from folioforge.functions.text import HEADING, TERM, WS

_NL2 = rf"\n{WS}*\n"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"


def _filled(x: str, v: str) -> str:
    """Stripped, non-blank elements of list x; v names the lambda's variable."""
    return f"list_filter(list_transform({x}, lambda {v}: {_strip(v)}), lambda {v}: {v} <> '')"


def _paras(x: str, v: str = "p") -> str:
    return _filled(f"string_split_regex({x}, '{_NL2}')", v)


def _sents(x: str, v: str = "s") -> str:
    return _filled(rf"string_split(regexp_replace({x}, '([.!?]){WS}+([A-Z0-9*#])', '\1' || chr(1) || '\2', 'g'), chr(1))", v)


_TERMS = lambda x: f"regexp_extract_all(lower({x}), '{TERM}')"

DOCS = f"docs AS (SELECT * REPLACE ({_strip("coalesce(content, '')")} AS content) FROM source_documents)"

SECTIONS = rf"sec AS (SELECT source_path, string_split(regexp_replace(content, '(?m)^({HEADING})$', chr(1) || '\1', 'g'), chr(1)) AS s FROM docs)"

CHUNKS = f"""{DOCS}, {SECTIONS},
blks AS (SELECT source_path, list_concat({_paras('s[1]')}, {_filled('s[2:]', 'x')}) AS bl FROM sec),
blk AS (SELECT source_path, unnest(bl) AS b, generate_subscripts(bl, 1) AS bi FROM blks),
blk2 AS (SELECT *, {_paras('b')} AS ps FROM blk),
blk3 AS (SELECT *, coalesce(regexp_full_match(ps[1], '{HEADING}'), false) AS t FROM blk2),
parts AS (SELECT source_path, bi, b, CASE WHEN length(b) <= 500 THEN [b]
  ELSE list_concat(CASE WHEN t THEN [ps[1]] ELSE [] END, flatten(list_transform(CASE WHEN t THEN ps[2:] ELSE ps END, lambda q: {_sents('q')}))) END AS pl0 FROM blk3),
parts2 AS (SELECT source_path, bi, CASE WHEN len(pl0) = 0 THEN [b] ELSE pl0 END AS pl FROM parts),
pieces AS (SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY bi, pi) AS i, piece
  FROM (SELECT source_path, bi, unnest(pl) AS piece, generate_subscripts(pl, 1) AS pi FROM parts2)),
pack(source_path, i, cur, n) AS (SELECT source_path, i, piece, CAST(0 AS BIGINT) FROM pieces WHERE i = 1
  UNION ALL SELECT p.source_path, p.i, CASE WHEN length(k.cur) + 2 + length(p.piece) > 500 THEN p.piece ELSE k.cur || chr(10) || chr(10) || p.piece END,
    CASE WHEN length(k.cur) + 2 + length(p.piece) > 500 THEN k.n + 1 ELSE k.n END FROM pack k JOIN pieces p ON p.source_path = k.source_path AND p.i = k.i + 1),
chunks AS (SELECT source_path, n AS chunk_index, arg_max(cur, i) AS text, source_path || ':' || format('{{:04d}}', n) AS chunk_id FROM pack GROUP BY source_path, n)"""

POSTINGS = f"""{CHUNKS},
ct AS (SELECT chunk_id, source_path, {_TERMS('text')} AS t FROM chunks),
post AS (SELECT chunk_id, source_path, dl, token, count(*) AS tf FROM (SELECT chunk_id, source_path, len(t) AS dl, unnest(t) AS token FROM ct) GROUP BY ALL),
dfr AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS al FROM ct)"""

QUESTIONS = "qs AS (SELECT id AS query_id, coalesce(question, '') AS text FROM gold_questions)"


def _bm25(queries: str, name: str = "sc", where: str = "") -> str:
    """Scores of a CTE of queries(query_id, text)."""
    return f"""{name}_q AS (SELECT DISTINCT query_id, unnest({_TERMS('text')}) AS token FROM {queries}),
{name} AS (SELECT query_id, post.chunk_id, post.source_path,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / al))), 6) AS score
  FROM {name}_q JOIN post USING (token) JOIN dfr USING (token) CROSS JOIN st {where} GROUP BY ALL)"""


def _top(src: str, name: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {src}) WHERE rank <= {k})"


_BASE = f"WITH RECURSIVE {POSTINGS}, {QUESTIONS}, {_bm25('qs')}"
_OUT = "SELECT query_id, rank, chunk_id, score FROM "

_EMB = f"""ctb AS (SELECT chunk_id, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS bin, sum(tf)::DOUBLE AS c FROM post GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(c * c)) AS nrm FROM ctb GROUP BY 1),
qtb AS (SELECT query_id, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS bin, count(*)::DOUBLE AS c FROM (SELECT query_id, unnest({_TERMS('text')}) AS token FROM qs) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(c * c)) AS nrm FROM qtb GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(qtb.c * ctb.c) AS d FROM qtb JOIN ctb USING (bin) GROUP BY ALL),
sem AS (SELECT q.query_id, c.chunk_id, c.source_path, round(coalesce(d / (qn.nrm * cn.nrm), 0.0), 6) AS score FROM qs q CROSS JOIN chunks c
  LEFT JOIN dots ON dots.query_id = q.query_id AND dots.chunk_id = c.chunk_id LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id)"""

_RESPONSES = """resp AS (SELECT id AS query_id, lower(trim(coalesce(question, ''), E' \\t\\n\\r')) AS q, concat_ws(chr(10), '- ' || question, '1. "' || expected_answer || '"', '2) ' || concept, '* ' || upper(concept), '```', '3. ' || difficulty) AS r FROM gold_questions),
rl AS (SELECT query_id, q, unnest(string_split(r, chr(10))) AS line, generate_subscripts(string_split(r, chr(10)), 1) AS pos FROM resp),
rc AS (SELECT query_id, q, pos, trim(regexp_replace(trim(line, E' \\t\\r'), '^(?:[-*]|\\d+[.)])\\s*', ''), E'` \\t"''') AS text FROM rl),
rd AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) AS k FROM rc WHERE text <> '' AND lower(text) <> q),
subs AS (SELECT * FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS sub_no FROM rd WHERE k = 1) WHERE sub_no <= 3),
ev0 AS (SELECT query_id AS question_id, 0::BIGINT AS list_no, text FROM qs UNION ALL SELECT query_id, sub_no, text FROM subs),
ev AS (SELECT question_id, list_no, text, question_id || '#' || list_no AS query_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, text ORDER BY list_no) AS k FROM ev0) WHERE k = 1)"""

_DECOMPOSED = f"""WITH RECURSIVE {POSTINGS}, {QUESTIONS}, {_RESPONSES}, {_bm25('ev')}, {_top('sc', 'rk', 20)},
tg AS (SELECT question_id AS query_id, list_no, chunk_id, rank, score FROM rk JOIN ev USING (query_id)),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM tg GROUP BY ALL), {_top('fu', 'fr', 5)}"""



def _hybrid(queries: str, k: int = 20) -> str:
    """hy: the semantic and the BM25 list of a CTE of queries(query_id, text), fused."""
    return f"""{_bm25(queries)}, {_EMB.replace('FROM qs', f'FROM {queries}')}, {_top('sc', 'kw', 20)}, {_top('sem', 'se', 20)},
hf AS (SELECT query_id, chunk_id, source_path, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM (SELECT query_id, chunk_id, source_path, rank FROM kw UNION ALL SELECT query_id, chunk_id, source_path, rank FROM se) GROUP BY ALL), {_top('hf', 'hy', k)}"""


_HYBRID_BASE = f"WITH RECURSIVE {POSTINGS}, {QUESTIONS}"
_DECOMPOSED_HYBRID = f"""{_HYBRID_BASE}, {_RESPONSES}, {_hybrid('ev')},
tg AS (SELECT question_id AS query_id, list_no, chunk_id, rank, score FROM hy JOIN ev USING (query_id)),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM tg GROUP BY ALL), {_top('fu', 'fr', 5)}"""

_PAIRS = "pr AS (SELECT t.*, g.source_files, g.answerable, g.concept, g.expected_answer FROM run_traces t JOIN gold_questions g ON t.question_id = g.id)"

_METRICS = f"""{_PAIRS},
u AS (SELECT trace_id, unnest(retrieved_chunks, recursive := true) FROM run_traces),
s1 AS (SELECT trace_id, source_path, min(rank) AS r FROM u GROUP BY ALL),
s2 AS (SELECT trace_id, source_path, row_number() OVER (PARTITION BY trace_id ORDER BY r, source_path NULLS FIRST) AS dr FROM s1),
h AS (SELECT s2.trace_id, dr FROM s2 JOIN pr ON pr.trace_id = s2.trace_id WHERE dr <= 5 AND list_contains(coalesce(source_files, []), source_path)),
ha AS (SELECT trace_id, count(*) AS nh, min(dr) AS f, sum(1 / log2(dr + 1)) AS dcg FROM h GROUP BY 1),
mt AS (SELECT pr.trace_id, answerable, error, len(list_distinct(coalesce(source_files, []))) AS nw, coalesce(nh, 0) AS nh, f, coalesce(dcg, 0.0) AS dcg FROM pr LEFT JOIN ha ON pr.trace_id = ha.trace_id),
me AS (SELECT trace_id, answerable, error, CASE WHEN answerable THEN nh / 5.0::DOUBLE END AS precision_at_k, CASE WHEN answerable AND nw > 0 THEN nh / nw::DOUBLE END AS recall_at_k,
  CASE WHEN answerable THEN coalesce(1 / f::DOUBLE, 0.0::DOUBLE) END AS reciprocal_rank,
  CASE WHEN answerable AND nw > 0 THEN dcg / list_sum(list_transform(range(1, least(5, nw) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_k FROM mt)"""

_ANSWERS = rf"""{_PAIRS},
am AS (SELECT trace_id, answerable, source_files, error, coalesce(answer, '') AS a, coalesce(retrieved_chunks, []) AS rc,
  list_transform(regexp_extract_all(coalesce(answer, ''), '\[S(\d+)\]', 1), lambda x: CAST(x AS INT)) AS lb, regexp_extract_all(coalesce(answer, ''), '\[([^\[\]\s]+\.md:\d+)\]', 1) AS ids FROM pr),
an AS (SELECT *, (len(lb) > 0 OR len(ids) > 0) AND len(list_filter(lb, lambda x: NOT list_contains(list_transform(rc, lambda c: c.rank), x))) = 0
  AND len(list_filter(ids, lambda x: NOT list_contains(list_transform(rc, lambda c: c.chunk_id), x))) = 0 AS valid FROM am),
ao AS (SELECT trace_id, answerable, a <> '' AND a <> 'I don''t know based on the provided context.' AND error IS NULL AS produced_answer,
  a = 'I don''t know based on the provided context.' AND error IS NULL AS refused, valid AS citations_valid,
  valid AND list_has_any(list_transform(list_filter(rc, lambda c: list_contains(lb, c.rank) OR list_contains(ids, c.chunk_id)), lambda c: c.source_path), coalesce(source_files, [])) AS cites_expected_source,
  error IS NOT NULL AS has_error FROM an)"""

_VERDICTS = ("correct", "citation_supported", "used_correct_version", "proper_refusal")
_JUDGE = f"""jr AS (SELECT judgement_id, question_id, trace_id, {', '.join(f"CASE WHEN judgement_id % 7 = 1 AND {v} THEN NULL ELSE {v} END AS {v}" for v in _VERDICTS)}, reason,
  judgement_id % 7 = 0 AS prose FROM answer_judgements),
jp AS (SELECT judgement_id, question_id, trace_id, CASE WHEN prose THEN 'Judge did not return a JSON object'
  WHEN {' OR '.join(f'{v} IS NULL' for v in _VERDICTS)} THEN 'Judge response is missing one or more boolean verdicts'
  WHEN reason IS NULL OR trim(reason) = '' THEN 'Judge response is missing a reason' END AS error, {', '.join(_VERDICTS)}, reason FROM jr),
jq AS (SELECT judgement_id, question_id, trace_id, error, {', '.join(f"error IS NULL AND coalesce({v}, false) AS {v}" for v in _VERDICTS)},
  CASE WHEN error IS NULL THEN reason ELSE 'No semantic judgement was produced.' END AS reason, CASE WHEN error IS NOT NULL THEN 'judge' END AS failure_stage FROM jp)"""
_FIXED = {"correct": "true", "citation_supported": "false", "used_correct_version": "false", "proper_refusal": "true"}
_DECIDED = f"""{_JUDGE},
jd0 AS (SELECT jq.*, g.answerable, t.error AS te, t.error IS NULL AND NOT coalesce(g.answerable, true) AND coalesce(t.answer = 'I don''t know based on the provided context.', false) AS pass
  FROM jq JOIN gold_questions g ON jq.question_id = g.id JOIN run_traces t ON jq.trace_id = t.trace_id),
jd AS (SELECT judgement_id, answerable, {', '.join(f"CASE WHEN te IS NOT NULL THEN false WHEN pass THEN {_FIXED[v]} ELSE {v} END AS {v}" for v in _VERDICTS)},
  CASE WHEN te IS NOT NULL THEN 'Pipeline error: ' || te WHEN pass THEN NULL ELSE error END AS error, CASE WHEN te IS NOT NULL THEN 'pipeline' WHEN pass THEN NULL ELSE failure_stage END AS failure_stage FROM jd0)"""

_SETS = f"""jl AS (SELECT j.*, a.kind, row_number() OVER (PARTITION BY trace_id, a.kind ORDER BY judged_at DESC NULLS LAST, judgement_id DESC) AS k
  FROM answer_judgements j JOIN annotators a ON j.annotator = a.annotator WHERE trace_id IS NOT NULL),
bt AS (SELECT h.trace_id, {', '.join(f'h.{v} AS a_{v}, m.{v} AS b_{v}' for v in _VERDICTS)} FROM jl h JOIN jl m ON h.trace_id = m.trace_id
  WHERE h.k = 1 AND m.k = 1 AND h.kind = 'human' AND m.kind = 'model' AND h.error IS NULL AND m.error IS NULL),
lb AS ({' UNION ALL '.join(f"SELECT trace_id, '{v}' AS label, a_{v} AS a, b_{v} AS b FROM bt" for v in _VERDICTS)})"""


def _pvalue(fixed: str, broken: str) -> str:
    return (
        f"CASE WHEN {fixed} + {broken} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, CAST(least({fixed}, {broken}) AS BIGINT) + 1), "
        f"lambda i: exp(lgamma({fixed} + {broken} + 1) - lgamma(i + 1) - lgamma({fixed} + {broken} - i + 1) - ({fixed} + {broken}) * ln(2.0::DOUBLE))))) END"
    )


_META = "array_to_string(list_transform(list_sort(map_entries(metadata)), lambda e: e.key || '=' || coalesce('''' || e.value || '''', 'null')), chr(31))"
_HASH = f"hs AS (SELECT source_path, doc_id, version, sha256(coalesce(content, '')) AS content_sha256, sha256(coalesce({_META}, '')) AS metadata_sha256 FROM source_documents)"
_SHIFTED = f"""{_HASH}, kk AS (SELECT *, ('0x' || substr(md5(source_path), 1, 6))::BIGINT AS k FROM hs),
mf AS (SELECT source_path, CASE WHEN k % 5 = 0 THEN '0' ELSE content_sha256 END AS c, CASE WHEN k % 7 = 0 THEN '0' ELSE metadata_sha256 END AS m FROM kk WHERE k % 13 <> 0
  UNION ALL SELECT source_path || '.old', content_sha256, metadata_sha256 FROM kk WHERE k % 11 = 0)"""
_MANIFEST = """mf0 AS (SELECT source_path, arg_max({'c': lower(trim(content_sha256)), 'm': lower(trim(metadata_sha256)), 'ids': chunk_ids, 'at': indexed_at}, (CAST(trim(indexed_at) AS TIMESTAMPTZ), delivery, entry_id)) AS b
  FROM manifest_entries WHERE source_path IS NOT NULL GROUP BY 1), mf AS (SELECT source_path, b.c AS c, b.m AS m, b.ids AS ids, b."at" AS ia FROM mf0)"""
_PLAN = """pl AS (SELECT coalesce(hs.source_path, mf.source_path) AS source_path, CASE WHEN hs.source_path IS NULL THEN 'deleted' WHEN mf.source_path IS NULL THEN 'new'
  WHEN mf.c IS DISTINCT FROM hs.content_sha256 THEN 'content' WHEN mf.m IS DISTINCT FROM hs.metadata_sha256 THEN 'metadata' ELSE 'unchanged' END AS kind FROM hs FULL JOIN mf ON hs.source_path = mf.source_path)"""
_CALLS = """cq AS (SELECT trace_id, unnest(coalesce(queries_used, [])) AS query, generate_subscripts(coalesce(queries_used, []), 1) AS call_no,
   coalesce(array_to_string(list_transform(retrieved_chunks, lambda c: '[' || c.rank || '] chunk_id: ' || c.chunk_id), chr(10)), '') AS body FROM run_traces),
ca AS (SELECT trace_id, call_no, 'search_documents' AS name, query, 'success' AS status, length(body) AS result_chars, regexp_extract_all(body, 'chunk_id: (\\S+)', 1) AS ids FROM cq
  UNION ALL SELECT trace_id, len(coalesce(queries_used, [])) + 1, 'search_documents', question, NULL, 0, [] FROM run_traces)"""
_IDX = """ix AS (SELECT *, CASE WHEN effective_date IS NOT NULL THEN coalesce(expiry_date, DATE '9999-12-31') END AS eo FROM source_documents)"""

SQL = {
    "tokenize_terms": f"WITH {DOCS} SELECT source_path, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT source_path, {_TERMS('content')} AS t FROM docs)",
    "term_frequency": f"WITH RECURSIVE {POSTINGS} SELECT chunk_id, token, tf FROM post",
    "document_frequency": f"WITH RECURSIVE {POSTINGS} SELECT token, df FROM dfr",
    "corpus_stats": f"WITH RECURSIVE {POSTINGS} SELECT n AS n_chunks, round(al, 6) AS avg_len FROM st",
    "fixed_chunks": f"""WITH {DOCS}, g AS (SELECT source_path, content, unnest(range(0, length(content), 500)) AS s FROM docs)
SELECT source_path || ':' || format('{{:04d}}', s // 500) AS chunk_id, CAST(s // 500 AS BIGINT) AS chunk_index, substring(content, CAST(s + 1 AS INT), 500) AS text FROM g""",
    "sentence_split": f"WITH {DOCS}, l AS (SELECT source_path, {_sents('content')} AS s FROM docs) SELECT source_path, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sentence_no, unnest(s) AS sentence FROM l",
    "paragraph_blocks": f"""WITH {DOCS}, l AS (SELECT source_path, {_paras('content')} AS s FROM docs), m AS (SELECT source_path, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS block_no, unnest(s) AS block FROM l)
SELECT *, regexp_full_match(block, '{HEADING}') AS is_heading FROM m""",
    "markdown_chunks": f"WITH RECURSIVE {CHUNKS} SELECT chunk_id, chunk_index, text FROM chunks",
    "chunk_offsets": f"""WITH RECURSIVE {CHUNKS},
w(source_path, i, st, en) AS (SELECT c.source_path, c.chunk_index, CASE WHEN strpos(content, text) > 0 THEN strpos(content, text) - 1 ELSE 0 END,
    CASE WHEN strpos(content, text) > 0 THEN strpos(content, text) - 1 ELSE 0 END + length(text) FROM chunks c JOIN docs d ON c.source_path = d.source_path WHERE chunk_index = 0
  UNION ALL SELECT c.source_path, c.chunk_index, CASE WHEN strpos(substring(content, CAST(en + 1 AS INT)), text) > 0 THEN en + strpos(substring(content, CAST(en + 1 AS INT)), text) - 1 ELSE en END,
    CASE WHEN strpos(substring(content, CAST(en + 1 AS INT)), text) > 0 THEN en + strpos(substring(content, CAST(en + 1 AS INT)), text) - 1 ELSE en END + length(text)
  FROM w JOIN chunks c ON c.source_path = w.source_path AND c.chunk_index = w.i + 1 JOIN docs d ON c.source_path = d.source_path)
SELECT source_path || ':' || format('{{:04d}}', i) AS chunk_id, st AS character_start, en AS character_end FROM w""",
    "index_metadata": f"""WITH {_IDX} SELECT source_path, doc_id AS document_family, CASE WHEN version IS NOT NULL THEN coalesce(status = 'current', false) END AS is_current_version,
  CAST(date_diff('day', DATE '0001-01-01', effective_date) + 1 AS BIGINT) AS effective_date_ordinal, CAST(date_diff('day', DATE '0001-01-01', eo) + 1 AS BIGINT) AS expiry_date_ordinal FROM ix""",
    "filter_current": "SELECT source_path, doc_id AS document_family FROM source_documents WHERE version IS NOT NULL AND status = 'current'",
    "filter_exact_version": "SELECT source_path, version FROM source_documents WHERE status = 'current' AND version = '1.2'",
    "filter_as_of": f"WITH {_IDX} SELECT source_path, version FROM ix WHERE effective_date <= DATE '2024-06-01' AND eo >= DATE '2024-06-01'",
    "filter_or_scope": "SELECT source_path, status, version FROM source_documents WHERE status = 'draft' OR version <= '1.5' OR version >= '4.5'",
    "as_of_join": f"""WITH {_IDX}, p AS (SELECT DISTINCT trim(document_id) AS family, snapshot_date AS day FROM metadata_snapshots WHERE document_id IS NOT NULL AND snapshot_date IS NOT NULL)
SELECT family, day, source_path, version FROM p JOIN ix ON family = doc_id AND effective_date <= day AND eo >= day""",
    "bm25_topk": f"{_BASE}, {_top('sc', 'rk', 5)} {_OUT} rk",
    "bm25_filtered": f"{_BASE}, sf AS (SELECT sc.* FROM sc JOIN source_documents d ON sc.source_path = d.source_path WHERE d.status = 'current'), {_top('sf', 'rk', 5)} {_OUT} rk",
    "knn_cosine_topk": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM v q CROSS JOIN v WHERE q.vec_id % 20 = 0), {_top('s', 'rk', 10)} {_OUT} rk""",
    "knn_filtered": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM v q CROSS JOIN v WHERE q.vec_id % 20 = 0 AND v.label >= 5), {_top('s', 'rk', 10)} {_OUT} rk""",
    "cosine_pairs": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    "semantic_topk": f"WITH RECURSIVE {POSTINGS}, {QUESTIONS}, {_EMB}, {_top('sem', 'rk', 5)} {_OUT} rk",
    "hybrid_rrf": f"""{_BASE}, {_EMB}, {_top('sc', 'kw', 20)}, {_top('sem', 'se', 20)},
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM kw UNION ALL SELECT query_id, chunk_id, rank FROM se) GROUP BY ALL), {_top('fu', 'rk', 5)} {_OUT} rk""",
    "rerank_overlap": f"""{_BASE}, {_top('sc', 'kw', 20)}, qt AS (SELECT query_id, list_distinct({_TERMS('text')}) AS q FROM qs), ctd AS (SELECT chunk_id, list_distinct(t) AS c FROM ct),
re AS (SELECT kw.query_id, kw.chunk_id, round(len(list_intersect(q, c)) / len(q)::DOUBLE, 6) AS score FROM kw JOIN qt USING (query_id) JOIN ctd USING (chunk_id)), {_top('re', 'rk', 5)} {_OUT} rk""",
    "document_scoped": f"""{_BASE}, {_top('sc', 'kw', 20)}, ld AS (SELECT query_id, source_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS r FROM kw GROUP BY query_id, source_path),
s2 AS (SELECT sc.* FROM sc JOIN ld ON sc.query_id = ld.query_id AND sc.source_path = ld.source_path WHERE r <= 3), {_top('s2', 'rk', 5)} {_OUT} rk""",
    "neighbor_expand": f"""{_BASE}, {_top('sc', 'kw', 5)}, org AS (SELECT kw.query_id, kw.rank, kw.score, c.source_path, c.chunk_index FROM kw JOIN chunks c USING (chunk_id) WHERE kw.rank <= 3),
nb AS (SELECT o.query_id, o.rank AS fr, o.score, off, c.chunk_id FROM org o CROSS JOIN (VALUES (-1), (1)) x(off) JOIN chunks c ON c.source_path = o.source_path AND c.chunk_index = o.chunk_index + off
  WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = o.query_id AND kw.chunk_id = c.chunk_id)),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY fr, off) AS k FROM nb) WHERE k = 1),
al AS (SELECT query_id, chunk_id, score, 0 AS p, rank AS a, 0 AS b FROM kw UNION ALL SELECT query_id, chunk_id, score, 1, fr, off FROM n1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p, a, b) AS rank, chunk_id, score FROM al""",
    "parent_documents": f"""{_BASE}, {_top('sc', 'kw', 5)}, pa AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_path ORDER BY rank) AS k FROM kw)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, source_path AS chunk_id, score FROM pa WHERE k = 1""",
    "parent_with_limit": f"""{_BASE}, {_top('sc', 'kw', 5)}, pa AS (SELECT kw.*, length(content) <= 1500 AS w, row_number() OVER (PARTITION BY query_id, kw.source_path ORDER BY rank) AS k FROM kw JOIN docs ON docs.source_path = kw.source_path)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, CASE WHEN w THEN source_path ELSE chunk_id END AS chunk_id, score FROM pa WHERE NOT w OR k = 1""",
    "parse_subqueries": f"WITH {QUESTIONS}, {_RESPONSES} SELECT query_id, sub_no, text FROM subs",
    "decompose_rrf": f"{_DECOMPOSED} {_OUT} fr",
    "decompose_coverage": f"""{_DECOMPOSED},
cand AS (SELECT query_id, list_no, rank, chunk_id, score FROM tg WHERE list_no > 0),
f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS o FROM cand WHERE list_no = 1 QUALIFY o <= 1),
f2 AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank) AS o FROM cand c WHERE list_no = 2 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query_id = c.query_id AND f1.chunk_id = c.chunk_id) QUALIFY o <= 1),
f3 AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank) AS o FROM cand c WHERE list_no = 3 AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query_id = c.query_id AND f1.chunk_id = c.chunk_id)
  AND NOT EXISTS (SELECT 1 FROM f2 WHERE f2.query_id = c.query_id AND f2.chunk_id = c.chunk_id) QUALIFY o <= 1),
res AS (SELECT query_id, list_no, rank, chunk_id, score FROM f1 UNION ALL SELECT query_id, list_no, rank, chunk_id, score FROM f2 UNION ALL SELECT query_id, list_no, rank, chunk_id, score FROM f3),
al AS (SELECT * FROM res UNION ALL SELECT query_id, 1000000, rank, chunk_id, score FROM fr WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.query_id = fr.query_id AND res.chunk_id = fr.chunk_id))
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank) AS rank, chunk_id, score FROM al) WHERE rank <= 5""",
    "multihop_rrf": f"""WITH RECURSIVE {POSTINGS}, {QUESTIONS}, fo AS (SELECT g.id AS query_id, g.expected_answer AS text FROM gold_questions g JOIN qs ON g.id = qs.query_id WHERE answerable AND expected_answer IS NOT NULL
  AND trim(expected_answer) <> '' AND lower(trim(expected_answer)) <> lower(trim(qs.text))),
ev AS (SELECT query_id || '#0' AS query_id, query_id AS qid, 0 AS l, text FROM qs UNION ALL SELECT query_id || '#1', query_id, 1, text FROM fo), {_bm25('ev')}, {_top('sc', 'rk', 20)},
tg AS (SELECT qid AS query_id, l, chunk_id, rank, score FROM rk JOIN ev USING (query_id)),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM tg WHERE query_id IN (SELECT query_id FROM fo) GROUP BY ALL), {_top('fu', 'fr', 5)}
{_OUT} fr UNION ALL SELECT query_id, rank, chunk_id, score FROM tg WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM fo)""",
    "search_documents": f"""{_BASE}, {_top('sc', 'kw', 3)}
SELECT kw.query_id, kw.rank, '[' || kw.rank || '] chunk_id: ' || kw.chunk_id || chr(10) || 'source_path: ' || kw.source_path || chr(10) ||
  CASE WHEN concat_ws(' | ', 'doc_id: ' || nullif(doc_id, ''), 'version: ' || nullif(version, ''), 'status: ' || nullif(status, ''), 'department: ' || nullif(metadata['department'], '')) = '' THEN '' ELSE
  concat_ws(' | ', 'doc_id: ' || nullif(doc_id, ''), 'version: ' || nullif(version, ''), 'status: ' || nullif(status, ''), 'department: ' || nullif(metadata['department'], '')) || chr(10) END ||
  'score: ' || printf('%.4f', kw.score + 1e-9) || chr(10) || c.text AS passage
FROM kw JOIN chunks c USING (chunk_id) JOIN source_documents d ON d.source_path = kw.source_path""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT trace_id, round(precision_at_k, 9) AS precision_at_k, round(recall_at_k, 9) AS recall_at_k, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg_at_k, 9) AS ndcg_at_k FROM me",
    "retrieval_summary": f"""WITH {_METRICS} SELECT count(*) AS question_count, count(*) FILTER (WHERE answerable) AS answerable_count, count(*) FILTER (WHERE error IS NOT NULL) AS error_count,
{', '.join(f"round(avg(CASE WHEN error IS NULL THEN coalesce({c}, 0.0::DOUBLE) ELSE 0.0::DOUBLE END) FILTER (WHERE answerable), 6) AS {c}" for c in ('precision_at_k', 'recall_at_k', 'reciprocal_rank', 'ndcg_at_k'))} FROM me""",
    "first_relevant_rank": f"""WITH {_PAIRS}, u AS (SELECT trace_id, source_files, unnest(retrieved_chunks, recursive := true) FROM (SELECT trace_id, source_files, retrieved_chunks FROM pr WHERE answerable)),
r AS (SELECT trace_id, min(rank) AS f FROM u WHERE list_contains(source_files, source_path) GROUP BY 1) SELECT pr.trace_id, CAST(f AS BIGINT) AS first_relevant_rank FROM pr LEFT JOIN r ON pr.trace_id = r.trace_id WHERE answerable""",
    "concept_scorecard": f"""WITH {_PAIRS}, u AS (SELECT trace_id, source_files, unnest(retrieved_chunks, recursive := true) FROM (SELECT trace_id, source_files, retrieved_chunks FROM pr WHERE answerable)),
r AS (SELECT trace_id, min(rank) AS f FROM u WHERE list_contains(source_files, source_path) GROUP BY 1)
SELECT concept, count(*) AS questions, count(*) FILTER (WHERE f = 1) AS hit_at_1, count(*) FILTER (WHERE f <= 5) AS hit_at_k, count(*) FILTER (WHERE f IS NULL) AS missing,
  round(avg(CASE WHEN f <= 5 THEN 1 / f::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mrr FROM pr LEFT JOIN r ON pr.trace_id = r.trace_id WHERE answerable GROUP BY concept""",
    "unanswered_questions": "SELECT id AS question_id FROM gold_questions g WHERE NOT EXISTS (SELECT 1 FROM run_traces t WHERE t.question_id = g.id AND error IS NULL AND contains(answer, '[S2]'))",
    "labeled_context": f"""{_BASE}, {_top('sc', 'kw', 5)} SELECT kw.query_id, string_agg('[S' || rank || ']' || chr(10) || 'Source: ' || kw.source_path || chr(10) || 'Chunk: ' || kw.chunk_id || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS context
FROM kw JOIN chunks c USING (chunk_id) GROUP BY 1""",
    "citation_validation": r"""WITH t AS (SELECT trace_id, answer, coalesce(retrieved_chunks, []) AS rc, list_transform(regexp_extract_all(coalesce(answer, ''), '\[S(\d+)\]', 1), lambda x: CAST(x AS INT)) AS lb FROM run_traces WHERE error IS NULL),
u AS (SELECT *, len(rc) = 0 OR coalesce(answer = 'I don''t know based on the provided context.', false) AS ref, list_sort(list_distinct(list_filter(lb, lambda x: NOT list_contains(list_transform(rc, lambda c: c.rank), x)))) AS bad FROM t),
e AS (SELECT *, CASE WHEN ref THEN NULL WHEN len(lb) = 0 THEN 'Model answer has no context citations' WHEN len(bad) > 0 THEN 'Model answer cited context labels that were not provided: ' || array_to_string(list_transform(bad, lambda x: 'S' || x), ', ') END AS grounding_error FROM u),
x AS (SELECT trace_id, unnest(lb) AS l, generate_subscripts(lb, 1) AS p, rc FROM e WHERE NOT ref AND grounding_error IS NULL),
y AS (SELECT trace_id, list_filter(rc, lambda c: c.rank = l)[1].chunk_id AS c, min(p) AS p FROM x GROUP BY ALL),
z AS (SELECT trace_id, string_agg(c, ',' ORDER BY p) AS cited FROM y GROUP BY 1)
SELECT e.trace_id, grounding_error, coalesce(cited, '') AS cited, sha256(CASE WHEN len(rc) = 0 THEN 'I don''t know based on the provided context.' ELSE coalesce(answer, '') END) AS final_sha256 FROM e LEFT JOIN z ON e.trace_id = z.trace_id""",
    "answer_metrics": f"WITH {_ANSWERS} SELECT trace_id, produced_answer, refused, citations_valid, cites_expected_source, has_error FROM ao",
    "answer_summary": f"""WITH {_ANSWERS} SELECT count(*) AS question_count, count(*) FILTER (WHERE answerable) AS answerable_question_count, count(*) FILTER (WHERE NOT answerable) AS unanswerable_question_count,
count(*) FILTER (WHERE has_error) AS error_count, round(avg(produced_answer::INT::DOUBLE) FILTER (WHERE answerable), 6) AS answer_rate, round(avg(citations_valid::INT::DOUBLE) FILTER (WHERE answerable), 6) AS citation_valid_rate,
round(avg(cites_expected_source::INT::DOUBLE) FILTER (WHERE answerable), 6) AS expected_source_citation_rate, round(avg(refused::INT::DOUBLE) FILTER (WHERE NOT answerable), 6) AS refusal_rate FROM ao""",
    "judge_parse": f"WITH {_JUDGE} SELECT judgement_id, {', '.join(_VERDICTS)}, reason, error, failure_stage FROM jq",
    "judge_decisions": f"WITH {_DECIDED} SELECT judgement_id, {', '.join(_VERDICTS)}, error, failure_stage FROM jd",
    "judgement_summary": f"""WITH {_DECIDED} SELECT count(*) AS question_count, count(*) FILTER (WHERE answerable) AS answerable_question_count, count(*) FILTER (WHERE NOT answerable) AS unanswerable_question_count,
count(*) FILTER (WHERE failure_stage IS NOT NULL) AS error_count, count(*) FILTER (WHERE failure_stage = 'pipeline') AS pipeline_error_count, count(*) FILTER (WHERE failure_stage = 'judge') AS judge_error_count,
count(*) FILTER (WHERE answerable AND error IS NULL) AS judged_answerable_question_count, count(*) FILTER (WHERE NOT answerable AND error IS NULL) AS judged_unanswerable_question_count,
round(avg(correct::INT::DOUBLE) FILTER (WHERE answerable AND error IS NULL), 6) AS correctness_rate, round(avg(citation_supported::INT::DOUBLE) FILTER (WHERE answerable AND error IS NULL), 6) AS citation_supported_rate,
round(avg(used_correct_version::INT::DOUBLE) FILTER (WHERE answerable AND error IS NULL), 6) AS correct_version_rate, round(coalesce(avg(proper_refusal::INT::DOUBLE) FILTER (WHERE NOT answerable AND error IS NULL), 0.0::DOUBLE), 6) AS proper_refusal_rate FROM jd""",
    "judge_prompts": """SELECT t.trace_id, sha256('Question ID: ' || g.id || chr(10) || 'Question: ' || coalesce(g.question, '') || chr(10) || 'Answerable: ' || CASE WHEN answerable THEN 'True' ELSE 'False' END || chr(10) || 'Gold answer: ' || coalesce(expected_answer, '') || chr(10) ||
'Expected source files: ' || CASE WHEN len(source_files) > 0 THEN array_to_string(source_files, ', ') ELSE 'none' END || chr(10) || chr(10) || 'Generated answer:' || chr(10) || coalesce(nullif(t.answer, ''), '(no answer)') || chr(10) || chr(10) ||
'Retrieved context:' || chr(10) || coalesce(nullif(t.context_sent_to_model, ''), '(no context)')) AS prompt_sha256 FROM run_traces t JOIN gold_questions g ON t.question_id = g.id""",
    "judge_agreement": f"""WITH {_SETS}, c AS (SELECT label, count(*) FILTER (WHERE a AND b) AS both_true, count(*) FILTER (WHERE NOT a AND NOT b) AS both_false, count(*) FILTER (WHERE a AND NOT b) AS only_baseline, count(*) FILTER (WHERE NOT a AND b) AS only_comparison FROM lb GROUP BY 1),
o AS (SELECT *, (both_true + both_false + only_baseline + only_comparison)::DOUBLE AS n FROM c), p AS (SELECT *, (both_true + both_false) / n AS po, (both_true + only_baseline) / n * ((both_true + only_comparison) / n) + (both_false + only_comparison) / n * ((both_false + only_baseline) / n) AS pe FROM o)
SELECT label, both_true, both_false, only_baseline, only_comparison, round(po, 6) AS agreement_rate, round((po - pe) / (1 - pe), 6) AS kappa FROM p""",
    "judge_disagreements": f"WITH {_SETS} SELECT trace_id, label, a, b FROM lb WHERE a <> b",
    "changed_verdicts": f"WITH {_SETS} SELECT label, trace_id, CASE WHEN b THEN 'fixed' ELSE 'broken' END AS change FROM lb WHERE a <> b",
    "run_comparison": f"""WITH {_SETS}, c AS (SELECT label, count(*) AS compared, avg(a::INT::DOUBLE) AS baseline_rate, avg(b::INT::DOUBLE) AS comparison_rate, count(*) FILTER (WHERE NOT a AND b) AS fixed_count, count(*) FILTER (WHERE a AND NOT b) AS broken_count FROM lb GROUP BY 1)
SELECT label, compared, round(baseline_rate, 6) AS baseline_rate, round(comparison_rate, 6) AS comparison_rate, fixed_count, broken_count, round(comparison_rate - baseline_rate, 6) AS rate_change, fixed_count + broken_count AS churn,
round({_pvalue('fixed_count', 'broken_count')} + 1e-12, 6) AS p_value FROM c""",
    "mcnemar": f"""WITH {_SETS}, g AS (SELECT label, concept, difficulty, count(*) FILTER (WHERE NOT a AND b) AS fixed, count(*) FILTER (WHERE a AND NOT b) AS broken FROM lb JOIN run_traces t ON lb.trace_id = t.trace_id JOIN gold_questions q ON t.question_id = q.id GROUP BY ALL)
SELECT label, concept, difficulty, fixed, broken, round({_pvalue('fixed', 'broken')} + 1e-12, 9) AS p_value FROM g""",
    "content_hash": f"WITH {_HASH} SELECT source_path, content_sha256, metadata_sha256 FROM hs",
    "sync_plan": f"WITH {_SHIFTED}, {_PLAN} SELECT source_path, kind FROM pl",
    "sync_plan_stored": f"WITH {_HASH}, {_MANIFEST}, {_PLAN} SELECT source_path, kind FROM pl",
    "sync_stale_chunks": f"WITH RECURSIVE {CHUNKS}, {_MANIFEST}, o AS (SELECT DISTINCT source_path, unnest(ids) AS chunk_id FROM mf) SELECT source_path, chunk_id FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)",
    "sync_apply": f"WITH RECURSIVE {CHUNKS}, {_SHIFTED}, {_PLAN} SELECT kind, count(*) AS n_chunks, count(DISTINCT chunks.source_path) AS n_documents FROM chunks JOIN pl ON chunks.source_path = pl.source_path GROUP BY kind",
    "sync_manifest": f"""WITH RECURSIVE {CHUNKS}, {_HASH}, {_MANIFEST}, {_PLAN}, ni AS (SELECT source_path, string_agg(chunk_id, ',' ORDER BY chunk_index) AS ids FROM chunks GROUP BY 1)
SELECT hs.source_path, doc_id AS document_id, version, content_sha256, coalesce(CASE WHEN kind = 'unchanged' THEN array_to_string(mf.ids, ',') ELSE ni.ids END, '') AS chunk_ids,
CASE WHEN kind = 'unchanged' THEN ia ELSE '2026-01-01T00:00:00+00:00' END AS indexed_at FROM hs JOIN pl ON hs.source_path = pl.source_path LEFT JOIN ni ON hs.source_path = ni.source_path LEFT JOIN mf ON hs.source_path = mf.source_path""",
    "agent_tool_calls": f"WITH {_CALLS} SELECT trace_id, call_no, name, query, status, result_chars, array_to_string(ids, ',') AS chunk_ids FROM ca",
    "agent_first_sighting": f"""WITH {_CALLS}, u AS (SELECT trace_id, call_no, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) AS p FROM ca), f AS (SELECT trace_id, chunk_id, min(call_no * 100000 + p) AS at_ FROM u GROUP BY ALL)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY at_) AS rank, chunk_id, regexp_replace(chunk_id, ':[^:]*$', '') AS source_path FROM f""",
    "agent_strip_tool_use": f"""WITH {_CALLS}, sa AS (SELECT trace_id, string_agg('assistant|' || coalesce(query, '') || chr(10) || 'user|' || body, chr(10) ORDER BY call_no) AS s FROM cq GROUP BY 1)
SELECT t.trace_id, 2 + 2 * len(coalesce(queries_used, [])) AS n_before, 1 + 2 * len(coalesce(queries_used, [])) AS n_after,
  sha256('user|' || coalesce(question, '') || coalesce(chr(10) || s, '')) AS messages_sha256 FROM run_traces t LEFT JOIN sa ON sa.trace_id = t.trace_id""",
    "list_versions": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(strftime(effective_date, '%Y-%m-%d'), '') DESC, source_path) AS position,
'- version: ' || coalesce(version, 'unversioned') || ' | status: ' || coalesce(status, 'unknown') || ' | effective_date: ' || coalesce(strftime(effective_date, '%Y-%m-%d'), 'unknown') || ' | expiry_date: ' || coalesce(strftime(expiry_date, '%Y-%m-%d'), 'none') || ' | source_path: ' || source_path AS line
FROM source_documents WHERE doc_id IS NOT NULL""",
    "read_document_truncate": """SELECT source_path, CASE WHEN length(coalesce(content, '')) <= 1000 THEN source_path || ' (' || length(coalesce(content, '')) || ' characters)' || chr(10) || chr(10) || coalesce(content, '')
ELSE source_path || ' (truncated to 1000 of ' || length(content) || ' characters)' || chr(10) || chr(10) || substring(content, 1, 1000) || chr(10) || chr(10) || '[TRUNCATED. Call read_document again with a larger max_chars if the part you need is missing.]' END AS text FROM source_documents""",
}

# the same over the hybrid list: what follows the candidates is as in the queries over the keyword list
SQL |= {
    "rerank_hybrid": f"""{_HYBRID_BASE}, {_hybrid('qs')}, {SQL["rerank_overlap"].split(f"{_top('sc', 'kw', 20)}, ")[1].replace("FROM kw", "FROM hy kw")}""",
    "decompose_hybrid_rrf": f"{_DECOMPOSED_HYBRID} {_OUT} fr",
    "decompose_hybrid_coverage": _DECOMPOSED_HYBRID + SQL["decompose_coverage"].removeprefix(_DECOMPOSED),
    "multihop_hybrid_rrf": SQL["multihop_rrf"].replace(f"{_bm25('ev')}, {_top('sc', 'rk', 20)}", _hybrid("ev")).replace("FROM rk JOIN", "FROM hy JOIN"),
    "search_documents_hybrid": f"{_HYBRID_BASE}, {_hybrid('qs', 3)}{SQL['search_documents'].removeprefix(_BASE + ', ' + _top('sc', 'kw', 3)).replace('FROM kw', 'FROM hy kw')}",
    "sync_apply_vectors": f"""WITH RECURSIVE {POSTINGS}, {_SHIFTED}, {_PLAN}, vb AS (SELECT chunk_id, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS bin, sum(tf)::DOUBLE AS c FROM post GROUP BY ALL),
vn AS (SELECT chunk_id, sqrt(sum(c * c)) AS nrm, sum(c * (bin + 1)) AS w FROM vb GROUP BY 1)
SELECT chunk_id, kind, round(f * coalesce(nrm, 0.0::DOUBLE), 6) AS norm, f * coalesce(w, 0.0::DOUBLE) AS weighted
FROM (SELECT c.chunk_id, kind, CASE WHEN kind IN ('new', 'content') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS f FROM chunks c JOIN pl ON c.source_path = pl.source_path) LEFT JOIN vn USING (chunk_id)""",
}

_PROMPT = SQL["judge_prompts"].split("sha256(", 1)[1].rsplit(") AS prompt_sha256", 1)[0]
_FUSED = "SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM"
SQL |= {
    "multihop_evidence_rrf": f"""{_BASE}, {_top('sc', 'r1', 20)},
fl AS (SELECT r1.query_id, trim(regexp_replace(trim(string_split(c.text, chr(10))[1], E' \\t\\r'), '^(?:[-*]|\\d+[.)])\\s*', ''), E'` \\t"''') AS text, lower(trim(qs.text, E' \\t\\n\\r')) AS q
  FROM r1 JOIN chunks c USING (chunk_id) JOIN qs ON qs.query_id = r1.query_id WHERE rank = 1),
fo AS MATERIALIZED (SELECT query_id, text FROM fl WHERE text <> '' AND lower(text) <> q), {_bm25('fo', 's2')}, {_top('s2', 'r2', 20)},
fu AS ({_FUSED} (SELECT query_id, chunk_id, rank FROM r1 WHERE query_id IN (SELECT query_id FROM fo) UNION ALL SELECT query_id, chunk_id, rank FROM r2) GROUP BY ALL), {_top('fu', 'fr', 5)}
{_OUT} fr UNION ALL SELECT query_id, rank, chunk_id, score FROM r1 WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM fo)""",
    "scoped_hybrid_filtered": f"""{_BASE}, {_EMB}, cur AS (SELECT source_path FROM source_documents WHERE status = 'current'),
f1 AS (SELECT sc.* FROM sc JOIN cur USING (source_path)), f2 AS (SELECT sem.* FROM sem JOIN cur USING (source_path)), {_top('f1', 'kw', 20)}, {_top('f2', 'se', 20)},
hf AS (SELECT query_id, chunk_id, source_path, round(sum(1 / (60 + rank)::DOUBLE), 6) AS score FROM (SELECT query_id, chunk_id, source_path, rank FROM kw UNION ALL SELECT query_id, chunk_id, source_path, rank FROM se) GROUP BY ALL), {_top('hf', 'hy', 20)},
ld AS (SELECT query_id, source_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS r FROM hy GROUP BY query_id, source_path),
g1 AS (SELECT f1.* FROM f1 JOIN ld ON f1.query_id = ld.query_id AND f1.source_path = ld.source_path WHERE r <= 3), g2 AS (SELECT f2.* FROM f2 JOIN ld ON f2.query_id = ld.query_id AND f2.source_path = ld.source_path WHERE r <= 3),
{_top('g1', 'k2', 20)}, {_top('g2', 's2', 20)}, fu AS ({_FUSED} (SELECT query_id, chunk_id, rank FROM k2 UNION ALL SELECT query_id, chunk_id, rank FROM s2) GROUP BY ALL), {_top('fu', 'fr', 5)} {_OUT} fr""",
    "evaluate_retrieval": f"""{_BASE}, {_top('sc', 'kw', 5)},
s1 AS (SELECT query_id, source_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS dr FROM kw GROUP BY query_id, source_path),
nc AS (SELECT query_id, count(*) AS n FROM kw GROUP BY 1),
gq AS (SELECT id, answerable, coalesce(source_files, []) AS sf, len(list_distinct(coalesce(source_files, []))) AS nw FROM gold_questions),
ha AS (SELECT id, count(*) AS nh, min(dr) AS f, sum(1 / log2(dr + 1)) AS dcg FROM gq JOIN s1 ON id = query_id WHERE list_contains(sf, source_path) GROUP BY 1)
SELECT gq.id AS question_id, CAST(coalesce(n, 0) AS BIGINT) AS n_chunks, round(CASE WHEN answerable THEN coalesce(nh, 0) / 5.0::DOUBLE END, 9) AS precision_at_k,
  round(CASE WHEN answerable AND nw > 0 THEN coalesce(nh, 0) / nw::DOUBLE END, 9) AS recall_at_k, round(CASE WHEN answerable THEN coalesce(1 / f::DOUBLE, 0.0::DOUBLE) END, 9) AS reciprocal_rank,
  round(CASE WHEN answerable AND nw > 0 THEN coalesce(dcg, 0.0::DOUBLE) / list_sum(list_transform(range(1, least(5, nw) + 1), lambda i: 1 / log2(i + 1))) END, 9) AS ndcg_at_k
FROM gq LEFT JOIN nc ON nc.query_id = gq.id LEFT JOIN ha ON ha.id = gq.id""",
    "answer_runs": f"""{_BASE}, {_top('sc', 'kw', 3)},
cx AS (SELECT kw.query_id, string_agg('[S' || rank || ']' || chr(10) || 'Source: ' || kw.source_path || chr(10) || 'Chunk: ' || kw.chunk_id || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS context,
  list(kw.chunk_id ORDER BY rank) AS ids FROM kw JOIN chunks c USING (chunk_id) GROUP BY 1),
pm AS (SELECT qs.query_id, context, ids, length('Question:' || chr(10) || text || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer the question now.') AS n FROM qs LEFT JOIN cx ON cx.query_id = qs.query_id),
er AS (SELECT *, CASE WHEN context IS NULL THEN NULL WHEN n % 7 = 2 THEN 'TimeoutError: no response' WHEN n % 7 = 0 THEN 'GroundingError: Model answer has no context citations'
  WHEN n % 7 = 1 THEN 'GroundingError: Model answer cited context labels that were not provided: S9'
  WHEN len(ids) < 2 THEN 'GroundingError: Model answer cited context labels that were not provided: S2' END AS error FROM pm)
SELECT query_id AS question_id, CASE WHEN error IS NULL THEN CASE WHEN context IS NULL THEN 'I don''t know based on the provided context.' ELSE 'The passages [S2] [S1] have ' || n || ' characters.' END END AS answer, error,
  CASE WHEN error IS NULL THEN CASE WHEN context IS NULL THEN '' ELSE ids[2] || ',' || ids[1] END END AS cited, sha256(coalesce(context, '')) AS context_sha256 FROM er""",
    "rejudge": f"""WITH pr AS (SELECT t.trace_id, g.answerable, t.answer, t.error AS te, length({_PROMPT.replace("coalesce(g.question, '')", "coalesce(t.question, '')")}) AS n FROM run_traces t JOIN gold_questions g ON t.question_id = g.id),
k AS (SELECT *, te IS NOT NULL AS failed, te IS NULL AND NOT coalesce(answerable, true) AND coalesce(answer = 'I don''t know based on the provided context.', false) AS pass, n % 11 = 1 AS broke, n % 11 = 0 AS prose FROM pr)
SELECT trace_id, {', '.join(f"CASE WHEN failed THEN false WHEN pass THEN {_FIXED[v]} ELSE NOT broke AND NOT prose AND n % {m} = 0 END AS {v}" for v, m in zip(_VERDICTS, (2, 3, 5, 7)))},
  CASE WHEN failed THEN 'Pipeline error: ' || te WHEN pass THEN NULL WHEN broke THEN 'TimeoutError: no response' WHEN prose THEN 'Judge did not return a JSON object' END AS error,
  CASE WHEN failed THEN 'pipeline' WHEN pass THEN NULL WHEN broke OR prose THEN 'judge' END AS failure_stage FROM k""",
}

_EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_UNITS = rf"""{DOCS}, {SECTIONS},
sx AS (SELECT source_path, unnest({_filled('s', 'x')}) AS sec, generate_subscripts({_filled('s', 'x')}, 1) AS si FROM sec),
ln AS (SELECT source_path, si, string_split_regex(sec, '{_EOL}') AS l FROM sx),
hd AS (SELECT *, regexp_full_match(l[1], '{HEADING}') AS t FROM ln),
bd AS (SELECT source_path, si, t, l[1] AS h, {_strip("array_to_string(CASE WHEN t THEN l[2:] ELSE l END, chr(10))")} AS body FROM hd),
un AS (SELECT source_path, si, list_concat(CASE WHEN t THEN [{_strip('h')}] ELSE [] END, flatten(list_transform({_paras('body')},
  lambda p: CASE WHEN contains(p, '|') OR starts_with(p, '- ') OR starts_with(p, '* ') OR starts_with(p, '1. ') THEN [p] ELSE {_sents('p')} END))) AS u FROM bd),
units AS (SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY si, ui) AS i, unit FROM (SELECT source_path, si, unnest(u) AS unit, generate_subscripts(u, 1) AS ui FROM un))"""
SQL |= {
    "semantic_units": f"WITH {_UNITS} SELECT source_path, CAST(i - 1 AS BIGINT) AS unit_no, unit FROM units",
    "semantic_chunks": f"""WITH RECURSIVE {_UNITS},
ub AS (SELECT source_path, i, ('0x' || substr(md5(token), 1, 7))::BIGINT % 64 AS bin, count(*)::DOUBLE AS c FROM (SELECT source_path, i, unnest({_TERMS('unit')}) AS token FROM units) GROUP BY ALL),
nm AS (SELECT source_path, i, sum(c * c) AS n FROM ub GROUP BY ALL),
dt AS (SELECT b.source_path, b.i, sum(a.c * b.c) AS d FROM ub a JOIN ub b ON a.source_path = b.source_path AND b.i = a.i + 1 AND a.bin = b.bin GROUP BY ALL),
us AS (SELECT u.source_path, u.i, unit, coalesce(d / (sqrt(x.n) * sqrt(y.n)), 0.0::DOUBLE) < 0.3::DOUBLE AND NOT regexp_full_match(unit, '{HEADING}') AS turned FROM units u
  LEFT JOIN dt ON dt.source_path = u.source_path AND dt.i = u.i LEFT JOIN nm x ON x.source_path = u.source_path AND x.i = u.i - 1 LEFT JOIN nm y ON y.source_path = u.source_path AND y.i = u.i),
pk(source_path, i, cur, n) AS (SELECT source_path, i, unit, CAST(0 AS BIGINT) FROM us WHERE i = 1
  UNION ALL SELECT u.source_path, u.i, CASE WHEN length(k.cur) + 2 + length(unit) > 500 OR turned AND length(k.cur) >= 200 THEN unit ELSE k.cur || chr(10) || chr(10) || unit END,
    CASE WHEN length(k.cur) + 2 + length(unit) > 500 OR turned AND length(k.cur) >= 200 THEN k.n + 1 ELSE k.n END FROM pk k JOIN us u ON u.source_path = k.source_path AND u.i = k.i + 1)
SELECT source_path || ':' || format('{{:04d}}', n) AS chunk_id, n AS chunk_index, arg_max(cur, i) AS text FROM pk GROUP BY source_path, n""",
}
