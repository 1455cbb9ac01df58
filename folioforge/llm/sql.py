"""SQL with the results of those queries that SQL can express."""

_LISTS = """
WITH raw AS (SELECT question_id, retriever, chunk_id, arg_max(coalesce(score, 'NaN'::DOUBLE), (coalesce(retrieved_at, TIMESTAMP '0001-01-01'), passage_id)) AS score
             FROM retrieved_passages WHERE question_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
ok AS (SELECT raw.question_id, raw.retriever, raw.chunk_id, CASE WHEN coalesce(r.higher_is_better, true) THEN score ELSE -score END AS s
       FROM raw LEFT JOIN retrievers r ON raw.retriever = r.retriever WHERE NOT isnan(score))"""

SQL = {
    "p2_found": r"""
WITH items AS (SELECT 'document' AS item_kind, source_path AS item_id, content AS text FROM source_documents
               UNION ALL SELECT 'passage', chunk_id, min(text) FROM retrieved_passages GROUP BY chunk_id)
SELECT DISTINCT item_kind, item_id,
  CASE WHEN list_max(list_transform(string_split(translate(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '.!?。！？', '      '), ' '), lambda x: length(x))) > 500
  THEN 'forced' ELSE 'boundary' END AS cut
FROM items WHERE length(text) > 500 AND item_id IS NOT NULL""",
    "p3_found": _LISTS
    + """,
pos AS (SELECT *, rank() OVER (PARTITION BY question_id, retriever ORDER BY s DESC) AS rk, count(*) OVER (PARTITION BY question_id, retriever, s) AS eq FROM ok),
q AS (SELECT question_id, count(DISTINCT retriever) AS nl, count(DISTINCT chunk_id) AS nc FROM ok GROUP BY 1),
c AS (SELECT question_id, chunk_id, count(*) AS il, count(*) FILTER (WHERE rk = 1 AND eq = 1) AS leads, max(rk + eq - 2) AS worst FROM pos GROUP BY 1, 2)
SELECT c.question_id, c.chunk_id FROM c JOIN q USING (question_id) WHERE nl >= 3 AND nc >= 2 AND il = nl AND leads >= nl - 1 AND worst <= 1""",
    "p3_ranking": _LISTS
    + """,
md AS (SELECT *, median(s) OVER (PARTITION BY question_id, retriever) AS med FROM ok),
dv AS (SELECT *, CASE WHEN s = med THEN 0.0::DOUBLE ELSE s - med END AS dev FROM md),
un AS (SELECT *, median(abs(dev)) OVER w AS mad, avg(abs(dev)) OVER w AS mean_dev FROM dv WINDOW w AS (PARTITION BY question_id, retriever)),
zs AS (SELECT *, CASE WHEN dev = 0 THEN 0.0::DOUBLE WHEN mad > 0 THEN dev / (1.4826::DOUBLE * mad) ELSE dev / (1.2533::DOUBLE * mean_dev) END AS z FROM un),
bs AS (SELECT *, greatest(least(1 / (1 + exp(-greatest(least(z, 700.0::DOUBLE), -700.0::DOUBLE))), 1 - 1e-9), 1e-9) AS b FROM zs),
fl AS (SELECT *, ln(min(b) OVER (PARTITION BY question_id, retriever) * 0.5::DOUBLE) AS floor FROM bs),
q AS (SELECT question_id, count(*) AS n_lists, sum(floor) AS all_floor FROM (SELECT DISTINCT question_id, retriever, floor FROM fl) GROUP BY 1),
c AS (SELECT question_id, chunk_id, sum(ln(b) - floor) AS gain, count(*) AS in_lists FROM fl GROUP BY 1, 2),
f AS (SELECT question_id, chunk_id, exp(round((gain + all_floor) / n_lists, 10)) AS fused, in_lists, n_lists FROM c JOIN q USING (question_id))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, chunk_id) AS rank, chunk_id, round(fused, 9) AS fused, in_lists, n_lists FROM f""",
    "p6_agreement": """
WITH one AS (SELECT trace_id, annotator, arg_max({'c': correct, 's': citation_supported, 'p': proper_refusal}, (coalesce(judged_at, TIMESTAMP '0001-01-01'), judgement_id)) AS v
             FROM answer_judgements WHERE error IS NULL AND trace_id IS NOT NULL AND annotator IS NOT NULL GROUP BY 1, 2),
v AS (SELECT trace_id, 'correct' AS label, v.c AS vote FROM one UNION ALL SELECT trace_id, 'citation_supported', v.s FROM one UNION ALL SELECT trace_id, 'proper_refusal', v.p FROM one),
i AS (SELECT label, trace_id, count(*) AS m, count(*) FILTER (WHERE vote) AS t FROM v WHERE vote IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
a AS (SELECT label, count(*) AS items, sum(m)::BIGINT AS votes, sum(t)::DOUBLE AS yes, sum(2 * t * (m - t) / (m - 1)::DOUBLE) AS unlike FROM i GROUP BY 1)
SELECT label, items, votes, 1 - unlike / votes AS observed, CASE WHEN yes > 0 AND yes < votes THEN 1 - unlike / (2 * yes * (votes - yes) / (votes - 1)) ELSE 1.0 END AS alpha FROM a""",
    "p7_round_trip": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, true AS same FROM documents",
}
