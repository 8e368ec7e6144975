"""SQL that the text queries must agree with, written from the problems' statements."""

from __future__ import annotations

SQL: dict[str, str] = {}

COPIES = r"""
v AS (SELECT row_id, id, run, prediction, predicted_paths,
             CASE WHEN prediction IS NOT NULL AND starts_with(ltrim(prediction), '{') AND json_valid(prediction) THEN prediction::JSON END AS j FROM predictions),
c AS (SELECT row_id, id, run,
        CASE WHEN j IS NOT NULL THEN '{' || array_to_string(list_sort(list_transform(json_keys(j), lambda k:
               k || '=' || regexp_replace(lower(regexp_replace(json_extract(j, '$."' || k || '"')::VARCHAR, '\\(["\\/bfnrt]|u[0-9a-fA-F]{4})', ' ', 'g')), '[^\p{L}\p{N}]', '', 'g'))), chr(30))
             ELSE regexp_replace(lower(coalesce(prediction, '')), '[^\p{L}\p{N}]', '', 'g') END AS a,
        regexp_replace(lower(coalesce(predicted_paths, '')), '[^\p{L}\p{N}]', '', 'g') AS b FROM v),
w AS (SELECT row_id, min(row_id) OVER (PARTITION BY id, run, a, b) AS keep_row FROM c)"""
SQL["p2_found"] = f"WITH {COPIES} SELECT keep_row, row_id AS copy_row FROM w WHERE keep_row <> row_id"
SQL["p2_copy_counts"] = f"WITH {COPIES} SELECT keep_row, count(*) AS copies FROM w GROUP BY keep_row"

TERMS = r"""
g AS (SELECT row_id, unnest(graph) AS g FROM rog_webqsp),
t AS (SELECT row_id, trim(g.h, e' \t\r\n') AS h, trim(g.r, e' \t\r\n') AS r, trim(g.t, e' \t\r\n') AS t FROM g),
p AS (SELECT * FROM t WHERE h <> '' AND r <> '' AND t <> ''),
terms AS (SELECT 'entity' AS kind, h AS term, row_id FROM p UNION ALL SELECT 'entity', t, row_id FROM p UNION ALL SELECT 'relation', r, row_id FROM p),
counted AS (SELECT kind, term, count(*) AS occurrences, count(DISTINCT row_id) AS rows FROM terms GROUP BY kind, term),
marked AS (SELECT *, CASE WHEN rows <= 2 THEN 'rare' WHEN rows * 20 >= (SELECT count(*) FROM rog_webqsp) THEN 'common' END AS mark FROM counted)"""
SQL["p3_found"] = f"WITH {TERMS} SELECT kind, term, mark FROM marked WHERE mark IS NOT NULL"
SQL["p3_term_counts"] = f"WITH {TERMS} SELECT kind, term, occurrences, rows, mark FROM marked"

LEAKS = r"""
texts AS (SELECT 'sft' AS corpus, sft_row_id AS k, prompt AS x FROM sft_rows UNION ALL SELECT 'pref', pref_row_id, prompt FROM pref_rows
          UNION ALL SELECT 'item', item_id, question FROM heldout_items),
w AS (SELECT corpus, k, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM texts WHERE x IS NOT NULL),
runs AS (SELECT corpus, k, array_to_string(w[i:i + 9], ' ') AS run FROM (SELECT corpus, k, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10)),
leaks AS (SELECT DISTINCT a.corpus, a.k AS train_row, b.k AS item_id FROM runs a JOIN runs b ON a.run = b.run AND b.corpus = 'item' WHERE a.corpus <> 'item')"""
SQL["p4_found"] = f"WITH {LEAKS} SELECT corpus, train_row, item_id FROM leaks"
SQL["p4_leaks_per_item"] = f"WITH {LEAKS} SELECT corpus, item_id, count(*) AS train_rows FROM leaks GROUP BY corpus, item_id"

SQL["p4_verified"] = f"""WITH {LEAKS},
gold AS (SELECT DISTINCT id AS qid, array_to_string(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}]+'), ' ') AS a FROM (SELECT id, unnest(ground_truth) AS a FROM predictions)),
held AS (SELECT l.*, gold.a, contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || gold.a || ' ') AS there
  FROM leaks l JOIN heldout_items i USING (item_id) JOIN w t ON t.corpus = l.corpus AND t.k = l.train_row LEFT JOIN gold ON gold.qid = i.qid AND gold.a <> '')
SELECT corpus, train_row, item_id, count(a)::INT AS gold_answers, coalesce(count(*) FILTER (WHERE there), 0)::INT AS answers_found FROM held GROUP BY ALL"""

OVERLAPS = r"""
q AS (SELECT row_id, split, question, 'webqsp' AS source FROM rog_webqsp UNION ALL SELECT row_id, split, question, 'cwq' FROM rog_cwq),
s AS (SELECT row_id, split, source, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS w FROM q WHERE question IS NOT NULL),
n AS (SELECT *, len(w) AS n FROM s WHERE len(w) > 0),
e AS (SELECT row_id, split, n, unnest(w) AS x FROM n),
both_ AS (SELECT a.row_id AS t, b.row_id AS h, a.n AS tn, b.n AS hn, count(*) AS o FROM e a JOIN e b ON a.x = b.x
          WHERE a.split = 'train' AND b.split IN ('validation', 'test') GROUP BY ALL),
pairs AS (SELECT t, h FROM both_ WHERE o * 5 >= (tn + hn - o) * 4)"""
SQL["p7_found"] = f"WITH {OVERLAPS} SELECT least(t, h) AS row_a, greatest(t, h) AS row_b FROM pairs"
SQL["p7_report"] = f"""WITH {OVERLAPS} SELECT b.source AS held_source, b.split AS held_split, a.source AS train_source, count(*) AS pairs,
count(DISTINCT h) AS held_rows, count(DISTINCT t) AS train_rows FROM pairs JOIN n a ON a.row_id = t JOIN n b ON b.row_id = h GROUP BY ALL"""

#: What must hold of every source: no SQL counts tokens or draws copies, but it says of whom the checks are due.
SQL["p9_checks"] = "SELECT size, source, true AS within_cap, true AS even, true AS reached FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL), (SELECT unnest(['all shares met', 'twice all']) AS size)"
