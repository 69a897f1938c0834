"""DuckDB oracle SQL for the registered queries (same driver tables, same bindings).

Lambdas are written ``lambda x: ...`` (DuckDB list functions, 1-based index).
"""

from __future__ import annotations

# ---- shared CTEs --------------------------------------------------------------------

BASE = """base AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS img_vec,
         list_transform(embedding::DOUBLE[],
             lambda x, i: 0.8 * x + 0.6 * (embedding::DOUBLE[])[(i % len(embedding)) + 1]) AS txt_vec,
         1 AS img_mask,
         CASE WHEN vec_id % 70 = 0 THEN 0 ELSE 1 END AS txt_mask
  FROM embeddings)"""

# sum fusion of the gated base vectors, three views per record
VIEWS = BASE + """,
views AS (
  SELECT id, label, 'i' AS modality, list_transform(img_vec, lambda x: x * img_mask) AS vec FROM base
  UNION ALL
  SELECT id, label, 't', list_transform(txt_vec, lambda x: x * txt_mask) FROM base
  UNION ALL
  SELECT id, label, 'it', list_transform(list_zip(img_vec, txt_vec),
                                         lambda p: p[1] * img_mask + p[2] * txt_mask) FROM base)"""

UNIT = VIEWS + """,
normed AS (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM views),
unit AS (
  SELECT id, label, modality,
         CASE WHEN n > 0 THEN list_transform(vec, lambda x: x / n) ELSE vec END AS vec
  FROM normed)"""


def _rv(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x, 6) + 0.0)"


def _knn(q_filter: str, c_filter: str, k: int, metric: str = "ip", exclude_self: bool = False) -> str:
    if metric == "ip":
        score, order = "round(list_dot_product(q.vec, c.vec), 6) + 0.0", "score DESC"
    else:
        score = "round(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0"
        order = "score ASC"
    cond = f"{q_filter} AND {c_filter}" + (" AND q.id <> c.id" if exclude_self else "")
    return f"""WITH {UNIT},
scored AS (
  SELECT q.id AS qid, q.modality AS q_mod, c.modality AS c_mod, c.id AS doc_id, {score} AS score
  FROM unit q JOIN unit c ON {cond})
SELECT qid, q_mod, c_mod, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid, q_mod, c_mod ORDER BY {order}, doc_id) AS INTEGER) AS rank
  FROM scored) WHERE rank <= {k}"""


SQL = {
    "l2_normalize": f"WITH {UNIT} SELECT id, modality, {_rv('vec')} AS vec FROM unit",
    "l2_normalize_eps": f"""WITH {VIEWS},
normed AS (SELECT *, greatest(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 1e-6) AS n FROM views)
SELECT id, modality, {_rv('list_transform(vec, lambda x: x / n)')} AS vec FROM normed""",
    "pair_cosine": f"""WITH {BASE},
n AS (SELECT id, img_vec, txt_vec,
             sqrt(list_sum(list_transform(img_vec, lambda x: x * x))) AS ni,
             sqrt(list_sum(list_transform(txt_vec, lambda x: x * x))) AS nt FROM base),
u AS (SELECT id,
             CASE WHEN ni > 0 THEN list_transform(img_vec, lambda x: x / ni) ELSE img_vec END AS iu,
             CASE WHEN nt > 0 THEN list_transform(txt_vec, lambda x: x / nt) ELSE txt_vec END AS tu FROM n)
SELECT id, round(list_dot_product(iu, tu), 6) + 0.0 AS cosine FROM u""",
    "fuse_sum": f"""WITH {BASE}
SELECT id, {_rv('list_transform(list_zip(img_vec, txt_vec), lambda p: p[1] * img_mask + p[2] * txt_mask)')} AS vec
FROM base""",
    "fuse_weighted": f"""WITH {BASE}
SELECT id, {_rv('list_transform(list_zip(img_vec, txt_vec), lambda p: 0.7 * (p[2] * txt_mask) + (1.0 - 0.7) * (p[1] * img_mask))')} AS vec
FROM base""",
    "mask_gate": f"WITH {BASE} SELECT id, txt_mask, {_rv('list_transform(txt_vec, lambda x: x * txt_mask)')} AS vec FROM base",
    "dim_check": """SELECT CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim,
       count(*) AS n_rows,
       CASE WHEN min(len(embedding)) = max(len(embedding)) THEN 'ok' ELSE 'ragged' END AS status
FROM embeddings""",
    "knn_exact": _knn("q.modality = 'it'", "c.modality = 'it'", 10),
    "knn_l2": _knn("q.modality = 't'", "c.modality = 't'", 10, metric="l2"),
    "knn_block": _knn("TRUE", "TRUE", 10, exclude_self=True),
}


# ---- judgments ------------------------------------------------------------------------

LINES = """lines AS (
  SELECT vec_id AS line_no,
         concat_ws(' ', vec_id::VARCHAR, '0', vec_id::VARCHAR, (label % 3)::VARCHAR, (label % 2)::VARCHAR) AS value
  FROM embeddings)"""


def _parsed(src: str = "lines") -> str:
    return f"""toks AS (
  SELECT line_no, value, string_split(trim(regexp_replace(value, '\\s+', ' ', 'g')), ' ') AS parts FROM {src}),
toks2 AS (SELECT *, CAST(CASE WHEN parts[1] = '' THEN 0 ELSE len(parts) END AS INTEGER) AS n_fields FROM toks),
parsed AS (
  SELECT line_no, parts[1] AS qid, parts[3] AS doc_id, CAST(parts[4] AS INTEGER) AS rel,
         coalesce(parts[5], '0') AS task_id
  FROM toks2 WHERE n_fields >= 4),
judg AS (SELECT DISTINCT qid, doc_id FROM parsed WHERE rel > 0),
tasks AS (SELECT qid, arg_max(task_id, line_no) AS task_id FROM parsed GROUP BY qid)"""


KS = [1, 5, 10, 50, 100]
_HITS = ", ".join(f"CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END AS hit_{k}" for k in KS)
_SUMS = ", ".join(f"CAST(sum(hit_{k}) AS BIGINT) AS hits_{k}" for k in KS)
_MOD = "CASE {c} WHEN 'i' THEN 'img_only' WHEN 't' THEN 'txt_only' WHEN 'it' THEN 'img_txt' END"


def _ranked(relevance: str, c_filter: str = "TRUE", exclude_self: bool = False) -> str:
    """CTEs ending in ``perq`` (qid, q_mod, c_mod, first_rank, hit_k.., rr).

    relevance 'label': same label; 'judg': judged pairs (ids as strings).
    """
    if relevance == "label":
        rel, join = "q.label = c.label", ""
    else:
        rel = "(j.qid IS NOT NULL)"
        join = "LEFT JOIN judg j ON j.qid = q.id::VARCHAR AND j.doc_id = c.id::VARCHAR"
    cond = c_filter + (" AND q.id <> c.id" if exclude_self else "")
    return f"""scored AS (
  SELECT q.id AS qid, q.modality AS q_mod, c.modality AS c_mod, c.id AS doc_id, {rel} AS rel,
         round(list_dot_product(q.vec, c.vec), 6) + 0.0 AS score
  FROM unit q JOIN unit c ON {cond} {join}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, q_mod, c_mod ORDER BY score DESC, doc_id) AS rk FROM scored),
fr AS (SELECT qid, q_mod, c_mod, min(CASE WHEN rel THEN rk END) AS first_rank FROM ranked GROUP BY qid, q_mod, c_mod),
perq AS (SELECT *, {_HITS}, CASE WHEN first_rank <= 1000 THEN 1.0 / first_rank ELSE 0.0 END AS rr FROM fr)"""


def _grid(c_filter: str = "TRUE") -> str:
    return f"""WITH {UNIT}, {_ranked('label', c_filter, exclude_self=True)}
SELECT q_mod, c_mod, count(*) AS n, {_SUMS}, round(avg(rr), 6) + 0.0 AS mrr FROM perq GROUP BY q_mod, c_mod"""


_REPORT = f"""WITH {UNIT}, {LINES}, {_parsed()}, {_ranked('judg')},
pt AS (SELECT perq.*, CAST(coalesce(t.task_id, '0') AS INTEGER) AS task_id
       FROM perq LEFT JOIN tasks t ON t.qid = perq.qid::VARCHAR),
report AS (
  SELECT task_id,
         CASE WHEN task_id = 0 THEN 'Image-to-Text Retrieval' ELSE 'Unknown Task ' || task_id::VARCHAR END AS task,
         'embeddings' AS dataset, 'test' AS split, 'embeddings' AS cand_pool,
         {_MOD.format(c='q_mod')} AS query_modality, {_MOD.format(c='c_mod')} AS candidate_modality,
         count(*) AS n, {_SUMS}, avg(rr) AS mrr
  FROM pt GROUP BY task_id, q_mod, c_mod)"""

CORPUS = """corpus AS (
  SELECT conv_id AS id,
         list(text ORDER BY turn) FILTER (WHERE role = 'user') AS questions,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS caption
  FROM conversations GROUP BY conv_id)"""

SQL.update({
    "qrels_parse": f"WITH {LINES}, {_parsed()} SELECT line_no, qid, doc_id, rel, task_id FROM parsed",
    "qrels_rejects": f"""WITH {LINES},
all_lines AS (SELECT line_no, value FROM lines
              UNION ALL
              SELECT line_no + {1 << 40}, regexp_extract(value, '^(\\S+ \\S+ \\S+)', 1) FROM lines),
{_parsed('all_lines')}
SELECT line_no, value, n_fields FROM toks2 WHERE n_fields < 4""",
    "qrels_generate": """SELECT 'test' AS split, vec_id AS id,
       concat_ws(' ', vec_id::VARCHAR, '0', vec_id::VARCHAR, '1', '0') AS value FROM embeddings""",
    "qrel_sets": f"""WITH {LINES}, {_parsed()}
SELECT qid, list_sort(list(doc_id)) AS doc_ids, count(*) AS n_docs FROM judg GROUP BY qid""",
    "task_last_wins": f"""WITH {LINES},
all_lines AS (SELECT line_no, value FROM lines
              UNION ALL
              SELECT line_no + {1 << 40}, regexp_replace(value || ' extra', ' (\\d+) extra$', ' 9\\1') FROM lines),
{_parsed('all_lines')}
SELECT qid, task_id FROM tasks""",
    "hit_at_k": f"WITH {UNIT}, {_ranked('label', exclude_self=True)} SELECT qid, q_mod, c_mod, first_rank, "
                + ", ".join(f"hit_{k}" for k in KS) + " FROM perq",
    "mrr": f"WITH {UNIT}, {_ranked('label', exclude_self=True)} SELECT qid, q_mod, c_mod, round(rr, 6) + 0.0 AS rr FROM perq",
    "eval_grid": _grid(),
    "grid_missing_modality": _grid("c.modality IN ('i', 'it')"),
    "eval_report": _REPORT + " SELECT * REPLACE (round(mrr, 6) + 0.0 AS mrr) FROM report",
    "eval_report_wide": _REPORT + """
SELECT task_id AS "TaskID", task AS "Task", dataset AS "Dataset", split AS "Split", cand_pool AS "CandPool",
       query_modality AS "QueryModality", candidate_modality AS "CandidateModality", """
    + ", ".join(f'round((hits_{k} / n)::DECIMAL(24, 12), 4)::DOUBLE AS "Recall@{k}"' for k in KS)
    + """, round(mrr::DECIMAL(24, 12), 4)::DOUBLE AS "MRR"
FROM report""",
    "unjudged_queries": f"""WITH {UNIT}, {LINES}, {_parsed()}, {_ranked('judg')},
jq AS (SELECT DISTINCT qid, 1 AS judged FROM judg)
SELECT q_mod, c_mod, count(*) AS n, count(judged) AS n_judged,
       CAST(sum(CASE WHEN judged IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unjudged,
       round(avg(rr), 6) + 0.0 AS mrr
FROM perq LEFT JOIN jq ON jq.qid = perq.qid::VARCHAR GROUP BY q_mod, c_mod""",
    "relevant_hits": f"""WITH {UNIT}, {LINES}, {_parsed()}, {_ranked('judg')}
SELECT qid, q_mod, c_mod, doc_id, CAST(rk AS INTEGER) AS rank FROM ranked WHERE rk <= 10 AND rel""",
    "pool_build": f"WITH {UNIT} SELECT id AS doc_id, modality AS c_mod, {_rv('vec')} AS vec FROM unit",
    "pool_counts": f"""WITH {LINES}, {_parsed()}
SELECT 'i' AS modality, count(*) AS n FROM embeddings
UNION ALL SELECT 't', count(*) FROM embeddings
UNION ALL SELECT 'it', count(*) FROM embeddings
UNION ALL SELECT 'judged_queries', count(DISTINCT qid) FROM judg""",
    "duplicate_ids": """SELECT doc_id, count(*) AS count FROM (
  SELECT vec_id AS doc_id FROM embeddings UNION ALL SELECT DISTINCT conv_id FROM conversations)
GROUP BY doc_id HAVING count(*) > 1""",
    "modality_fanout": f"""WITH {CORPUS}
SELECT id, 0 AS view_pos, 'i' AS modality, '' AS txt, 0 AS txt_mask,
       CASE WHEN caption IS NULL THEN 0 ELSE 1 END AS img_mask FROM corpus
UNION ALL
SELECT id, 1, 't', coalesce(caption, ''), CASE WHEN caption IS NULL OR caption = '' THEN 0 ELSE 1 END, 0 FROM corpus
UNION ALL
SELECT id, 2, 'it', coalesce(caption, ''), CASE WHEN caption IS NULL OR caption = '' THEN 0 ELSE 1 END,
       CASE WHEN caption IS NULL THEN 0 ELSE 1 END FROM corpus""",
})


# ---- views and pairs ------------------------------------------------------------------

def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT"


VQ = "list_filter(list_transform(questions, lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: q IS NOT NULL AND q <> '')"
FIRST_Q = f"coalesce(({VQ})[1], '')"


def _sampled(key: str, seed: str) -> str:
    return f"CASE WHEN len({VQ}) > 0 THEN ({VQ})[({_draw(key, seed)} % len({VQ})) + 1] ELSE '' END"


def _cand(mode: str) -> str:
    txt = {"it": "caption", "i": "''", "t": "caption"}.get(mode, "''")
    has = {"it": "CASE WHEN caption IS NULL THEN 0 ELSE 1 END", "i": "CASE WHEN caption IS NULL THEN 0 ELSE 1 END"}
    return f"SELECT id, '{mode}' AS modality, {txt} AS txt, {has.get(mode, '0')} AS has_img FROM corpus"


def _query(mode: str) -> str:
    txt = {"it": FIRST_Q, "i": "''", "t": FIRST_Q}[mode]
    has = "CASE WHEN caption IS NULL THEN 0 ELSE 1 END" if mode in ("it", "i") else "0"
    return f"SELECT id, '{mode}' AS modality, {txt} AS txt, {has} AS has_img FROM corpus"


QITEMS = f"""qv AS ({_query('it')} UNION ALL {_query('i')} UNION ALL {_query('t')}),
qitems AS (SELECT id, modality, coalesce(txt, '') AS txt,
                  CASE WHEN txt IS NULL OR txt = '' THEN 0 ELSE 1 END AS txt_mask, has_img AS img_mask FROM qv)"""

MODES = "['img_txt', 'img_only', 'txt_only']"


def _pairs(fixed_target: bool, validation: bool = False) -> str:
    t_mode = "'img_txt'" if fixed_target else f"{MODES}[({_draw('id::VARCHAR', chr(39) + '42' + chr(39), chr(39) + '0' + chr(39), chr(39) + 'target' + chr(39))} % 3) + 1]"
    q_mode = f"""{MODES}[({_draw('id::VARCHAR', "'42'", "'0'", "'query'")} % 3) + 1]"""
    if validation:
        q_mode = t_mode = "'img_txt'"
    return f"""p0 AS (
  SELECT id, caption, caption IS NOT NULL AS has_image,
         {_sampled("concat_ws('-', id::VARCHAR, '0')", "'42'")} AS q,
         {q_mode} AS q_mode,
         {t_mode} AS t_mode
  FROM corpus),
pairs AS (
  SELECT id, q_mode, t_mode,
         CASE q_mode WHEN 'img_txt' THEN q WHEN 'img_only' THEN '' ELSE q END AS q_txt,
         CASE WHEN q_mode = 'txt_only' OR NOT has_image THEN 0 ELSE 1 END AS q_has_img,
         CASE t_mode WHEN 'img_txt' THEN caption WHEN 'img_only' THEN '' ELSE caption END AS c_txt,
         CASE WHEN t_mode = 'txt_only' OR NOT has_image THEN 0 ELSE 1 END AS c_has_img
  FROM p0)"""


def _batches(src: str, id_col: str, bs: int, seed: int, epoch: int, name: str = "b") -> str:
    return f"""{name}_d AS (SELECT *, {_draw(f'{id_col}::VARCHAR', f"'{seed}'", f"'{epoch}'")} AS _draw FROM {src}),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY _draw, {id_col}) - 1 AS _rn FROM {name}_d),
{name} AS (SELECT * EXCLUDE (_draw, _rn), _rn // {bs} AS batch_id, CAST(_rn % {bs} AS INTEGER) AS pos FROM {name}_r)"""


def _eps(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda y: y * y))), 1e-6))"


def _contrastive(global_: bool) -> str:
    if global_:
        step = "b2 AS (SELECT *, batch_id // 4 AS step_id, CAST(batch_id % 4 AS INTEGER) AS rnk FROM b),"
        q = f"SELECT batch_id, step_id AS g, pos, rnk * 32 + pos AS target, {_eps('list_transform(img_vec, lambda x: x * img_mask)')} AS qv FROM b2"
        p = f"SELECT step_id AS g, rnk * 32 + pos AS col, {_eps('list_transform(txt_vec, lambda x: x * txt_mask)')} AS pv FROM b2"
    else:
        step = ""
        q = f"SELECT batch_id, batch_id AS g, pos, pos AS target, {_eps('list_transform(img_vec, lambda x: x * img_mask)')} AS qv FROM b"
        p = f"SELECT batch_id AS g, pos AS col, {_eps('list_transform(txt_vec, lambda x: x * txt_mask)')} AS pv FROM b"
    return f"""WITH {BASE}, {_batches('base', 'id', 32, 42, 0)}, {step}
q AS ({q}), p AS ({p}),
s AS (SELECT q.batch_id, q.pos, q.target, p.col, list_dot_product(q.qv, p.pv) * 100.0 AS s FROM q JOIN p ON q.g = p.g),
s2 AS (SELECT *, max(s) OVER (PARTITION BY batch_id, pos) AS m FROM s),
pq AS (SELECT batch_id, pos, max(m) + ln(sum(exp(s - m))) - max(CASE WHEN col = target THEN s END) AS loss,
              CASE WHEN min(col) FILTER (WHERE s = m) = max(target) THEN 1.0 ELSE 0.0 END AS correct
       FROM s2 GROUP BY batch_id, pos)
SELECT batch_id, count(*) AS n, round(avg(loss), 6) + 0.0 AS loss, round(avg(correct), 6) + 0.0 AS accuracy
FROM pq GROUP BY batch_id"""


def _it_hits(k: int) -> str:
    return f"""scored AS (
  SELECT q.id AS qid, q.modality AS q_mod, c.modality AS c_mod, c.id AS doc_id,
         round(list_dot_product(q.vec, c.vec), 6) + 0.0 AS score
  FROM unit q JOIN unit c ON q.modality = 'it' AND c.modality = 'it'),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, q_mod, c_mod ORDER BY score DESC, doc_id)
                                       AS INTEGER) AS rank FROM scored) WHERE rank <= {k})"""


SQL.update({
    "candidate_view": f"WITH {CORPUS} {_cand('it')} UNION ALL {_cand('i')} UNION ALL {_cand('t')} UNION ALL {_cand('unknown')}",
    "query_view": f"WITH {CORPUS} {_query('it')} UNION ALL {_query('i')} UNION ALL {_query('t')}",
    "first_question": f"WITH {CORPUS} SELECT id, {FIRST_Q} AS question FROM corpus",
    "sampled_question": f"WITH {CORPUS} SELECT id, {_sampled('id::VARCHAR', chr(39) + '42' + chr(39))} AS question FROM corpus",
    "mask_columns": f"WITH {CORPUS}, {QITEMS} SELECT id, modality, txt, txt_mask, img_mask FROM qitems",
    "valid_queries": f"""WITH {CORPUS}, {QITEMS}
SELECT id, modality, CASE WHEN txt_mask = 1 OR img_mask = 1 THEN 'ok' ELSE 'rejected' END AS status FROM qitems""",
    "train_pairs": f"WITH {CORPUS}, {_pairs(False)} SELECT * FROM pairs",
    "train_pairs_fixed_target": f"WITH {CORPUS}, {_pairs(True)} SELECT * FROM pairs",
    "pair_flatten": f"""WITH {CORPUS}, {_pairs(False)}, {_batches('pairs', 'id', 8, 42, 0)}
SELECT batch_id, pos * 2 AS idx, 'query' AS role, coalesce(q_txt, '') AS txt,
       CASE WHEN q_txt IS NULL OR q_txt = '' THEN 0 ELSE 1 END AS txt_mask, q_has_img AS img_mask FROM b
UNION ALL
SELECT batch_id, pos * 2 + 1, 'pos_cand', coalesce(c_txt, ''),
       CASE WHEN c_txt IS NULL OR c_txt = '' THEN 0 ELSE 1 END, c_has_img FROM b""",
    "epoch_batches": f"""WITH e AS (SELECT vec_id FROM embeddings), {_batches('e', 'vec_id', 32, 42, 1)}
SELECT vec_id, batch_id, pos FROM b""",
    "contrastive_eval": _contrastive(False),
    "contrastive_eval_global": _contrastive(True),
    "argmax_accuracy": """SELECT count(*) AS n,
       CAST(sum(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1.0 ELSE 0.0 END) AS accuracy
FROM (SELECT embedding AS l, label FROM embeddings)""",
    "content_lookup": f"""WITH {UNIT}, {CORPUS}, {_it_hits(10)}
SELECT h.*, CASE WHEN c.id IS NULL THEN 'missing' ELSE 'found' END AS type,
       CASE WHEN c.id IS NULL THEN 'Content not found for ID: ' || h.doc_id::VARCHAR ELSE c.caption END AS text_content
FROM hits h LEFT JOIN corpus c ON c.id = h.doc_id""",
    "search_cards": f"""WITH {UNIT}, {CORPUS}, {_it_hits(7)},
cards AS (
  SELECT h.qid, h.rank AS slot, h.doc_id, h.score,
         CASE WHEN c.id IS NULL THEN 'missing' ELSE 'found' END AS type,
         printf('ID: %s, Score: %s', h.doc_id::VARCHAR, round(h.score::DECIMAL(18, 6), 4)::VARCHAR) || chr(10) ||
         coalesce(CASE WHEN c.id IS NULL THEN 'Content not found for ID: ' || h.doc_id::VARCHAR ELSE c.caption END, 'None')
           AS text
  FROM hits h LEFT JOIN corpus c ON c.id = h.doc_id),
slots AS (SELECT u.id AS qid, CAST(s.slot AS INTEGER) AS slot FROM unit u, range(1, 11) s(slot) WHERE u.modality = 'it')
SELECT s.qid, s.slot, c.doc_id, c.score, c.type, coalesce(c.text, '') AS text
FROM slots s LEFT JOIN cards c ON c.qid = s.qid AND c.slot = s.slot""",
    "hit_vectors": f"""WITH {UNIT},
scored AS (
  SELECT q.id AS qid, q.modality AS q_mod, c.modality AS c_mod, c.id AS doc_id,
         round(list_dot_product(q.vec, c.vec), 6) + 0.0 AS score
  FROM unit q JOIN unit c ON TRUE),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, q_mod, c_mod ORDER BY score DESC, doc_id)
                                       AS INTEGER) AS rank FROM scored) WHERE rank <= 5)
SELECT h.qid, h.q_mod, h.c_mod, h.rank, h.doc_id,
       round(sqrt(list_sum(list_transform(v.vec, lambda x: x * x))), 6) + 0.0 AS norm
FROM hits h JOIN views v ON v.id = h.doc_id AND v.modality = h.c_mod""",
})


# ---- run log ---------------------------------------------------------------------------

ES = """es AS (
  SELECT user_id AS run_id, CAST(day(ts) AS INTEGER) AS epoch, event_type AS metric,
         sum(value::DECIMAL(38, 12))::DOUBLE / count(*) AS value,
         CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'train' WHEN 'purchase' THEN 'val'
                         WHEN 'signup' THEN 'val' WHEN 'error' THEN 'test' ELSE 'train' END AS phase
  FROM events GROUP BY user_id, day(ts), event_type)"""

BEST = """best AS (
  SELECT run_id, epoch AS best_epoch, value AS best_loss FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value ASC, epoch DESC) AS rn
    FROM es WHERE metric = 'error') WHERE rn = 1)"""

SQL.update({
    "rolling_meter": """SELECT event_type AS metric, event_id AS step, value, count(*) OVER w AS window_n,
       list_sort(list(value) OVER w)[CAST(ceil(count(*) OVER w / 2) AS INTEGER)] AS median,
       round((sum(value::DECIMAL(38, 12)) OVER w)::DOUBLE / count(*) OVER w, 6) + 0.0 AS avg,
       max(value) OVER w AS max
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "cumulative_avg": """SELECT event_type AS metric, event_id AS step, value, count(*) OVER w AS count,
       round((sum(value::DECIMAL(38, 12)) OVER w)::DOUBLE / count(*) OVER w, 6) + 0.0 AS cum_avg
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "running_best": f"""WITH {ES}
SELECT run_id, metric, epoch, round(value, 6) + 0.0 AS value, round(min(value) OVER w, 6) + 0.0 AS best_so_far,
       value <= min(value) OVER w AS is_best
FROM es WINDOW w AS (PARTITION BY run_id, metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "global_avg": """SELECT user_id AS run_id, event_type AS metric, count(*) AS count,
       round(sum(value::DECIMAL(38, 12))::DOUBLE, 6) + 0.0 AS total,
       round(sum(value::DECIMAL(38, 12))::DOUBLE / count(*), 6) + 0.0 AS global_avg
FROM events GROUP BY user_id, event_type""",
    "epoch_means": """SELECT user_id AS run_id, CAST(day(ts) AS INTEGER) AS epoch, event_type AS metric, count(*) AS n,
       round(sum(value::DECIMAL(38, 12))::DOUBLE / count(*), 6) + 0.0 AS mean
FROM events GROUP BY user_id, day(ts), event_type""",
    "best_epoch": f"WITH {ES}, {BEST} SELECT run_id, best_epoch, round(best_loss, 6) + 0.0 AS best_loss FROM best",
    "run_stats_wide": f"""WITH {ES}, {BEST}
SELECT es.run_id, es.epoch,
       """ + ",\n       ".join(
        f"max(CASE WHEN phase || '_' || metric = '{c}' THEN round(value, 6) + 0.0 END) AS {c}"
        for c in sorted(["train_click", "train_view", "val_purchase", "val_signup", "test_error"])) + """,
       max(best.best_epoch) AS best_epoch
FROM es LEFT JOIN best ON best.run_id = es.run_id GROUP BY es.run_id, es.epoch""",
})


# ---- encoders -----------------------------------------------------------------------

def _hash_encode(src: str, id_col: str, text_col: str, salt: str, name: str) -> str:
    """Signed feature hashing of whitespace tokens into 64 buckets (same rule as the encoder)."""
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest(regexp_split_to_array(coalesce({text_col}, ''), '[ \\t\\n\\r\\f\\v]+')) AS tok
             FROM {src}),
{name}_h AS (SELECT id, ('0x' || substr(md5('{salt}' || tok), 1, 8))::BIGINT AS hv FROM {name}_t WHERE tok <> ''),
{name}_a AS (SELECT id, hv % 64 AS bucket, sum(CASE WHEN (hv // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v
             FROM {name}_h GROUP BY id, hv % 64),
{name}_g AS (SELECT s.{id_col} AS id, r.bucket FROM {src} s, range(0, 64) r(bucket)),
{name} AS (SELECT g.id, list(coalesce(a.v, 0)::FLOAT ORDER BY g.bucket) AS vec
           FROM {name}_g g LEFT JOIN {name}_a a ON a.id = g.id AND a.bucket = g.bucket GROUP BY g.id)"""


_MLP = """list_transform(range(64), lambda k: list_dot_product(
    list_transform(range(64), lambda j: greatest(list_dot_product(x,
        list_transform(range(128), lambda i: sin(i * 131 + j * 17) * 0.1)) + cos(j) * 0.01, 0.0)),
    list_transform(range(64), lambda j: sin(j * 29 + k * 53 + 7) * 0.1)) + cos(k * 3) * 0.01)"""

_FP16 = """list_transform(embedding, lambda x: (CASE WHEN x = 0 THEN 0.0 ELSE
    round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10)
    END)::FLOAT)"""

SQL.update({
    "encode_batch": f"WITH {_hash_encode('documents', 'doc_id', 'text', '', 'enc')} SELECT id AS doc_id, vec FROM enc",
    "encode_fused": f"""WITH {CORPUS}, {_hash_encode('corpus', 'id', 'caption', '', 'te')},
{_hash_encode('corpus', 'id', 'caption', 'img:', 'ie')},
b AS (SELECT c.id, te.vec::DOUBLE[] AS t, ie.vec::DOUBLE[] AS im,
             CASE WHEN c.caption IS NULL OR c.caption = '' THEN 0 ELSE 1 END AS tm,
             CASE WHEN c.caption IS NULL THEN 0 ELSE 1 END AS imm
      FROM corpus c JOIN te ON te.id = c.id JOIN ie ON ie.id = c.id)
SELECT id, 'i' AS modality, {_rv('list_transform(im, lambda x: x * imm)')} AS vec FROM b
UNION ALL SELECT id, 't', {_rv('list_transform(t, lambda x: x * tm)')} FROM b
UNION ALL SELECT id, 'it', {_rv('list_transform(list_zip(im, t), lambda p: p[1] * imm + p[2] * tm)')} FROM b""",
    "fuse_mlp": f"""WITH {BASE},
xs AS (SELECT id, list_concat(list_transform(txt_vec, lambda v: v * txt_mask),
                              list_transform(img_vec, lambda v: v * img_mask)) AS x FROM base)
SELECT id, {_rv(_MLP)} AS vec FROM xs""",
    "quantize_fp16": f"SELECT vec_id, {_FP16} AS vec FROM embeddings",
})

SQL.update({
    "knn_ivf_full_probe": _knn("TRUE", "TRUE", 10),
    "knn_ivf_exact": _knn("TRUE", "TRUE", 10),
    "knn_pq_exact": _knn("TRUE", "TRUE", 10),
    "knn_sq8_exact": _knn("TRUE", "TRUE", 10),
    "stream_search": _knn("q.modality = 'it'", "c.modality = 'it'", 10),
    "pool_append": _knn("q.modality = 'it'", "c.modality = 'it'", 10),
})


# ---- corpus to report ------------------------------------------------------------------

_CORPUS_REPORT = f"""WITH {CORPUS},
cq AS (SELECT id, caption, {FIRST_Q} AS q FROM corpus),
{_hash_encode('cq', 'id', 'caption', '', 'ce')},
{_hash_encode('cq', 'id', 'q', '', 'qe')},
{_hash_encode('cq', 'id', 'caption', 'img:', 'ie')},
b AS (SELECT cq.id, ce.vec::DOUBLE[] AS cv, qe.vec::DOUBLE[] AS qv, ie.vec::DOUBLE[] AS iv,
             CASE WHEN cq.caption IS NULL OR cq.caption = '' THEN 0 ELSE 1 END AS cm,
             CASE WHEN cq.q = '' THEN 0 ELSE 1 END AS qm,
             CASE WHEN cq.caption IS NULL THEN 0 ELSE 1 END AS im
      FROM cq JOIN ce ON ce.id = cq.id JOIN qe ON qe.id = cq.id JOIN ie ON ie.id = cq.id),
sv AS (
  SELECT 'cand' AS side, id, 'i' AS modality, list_transform(iv, lambda x: x * im) AS vec FROM b
  UNION ALL SELECT 'cand', id, 't', list_transform(cv, lambda x: x * cm) FROM b
  UNION ALL SELECT 'cand', id, 'it', list_transform(list_zip(iv, cv), lambda p: p[1] * im + p[2] * cm) FROM b
  UNION ALL SELECT 'query', id, 'i', list_transform(iv, lambda x: x * im) FROM b
  UNION ALL SELECT 'query', id, 't', list_transform(qv, lambda x: x * qm) FROM b
  UNION ALL SELECT 'query', id, 'it', list_transform(list_zip(iv, qv), lambda p: p[1] * im + p[2] * qm) FROM b),
nv AS (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM sv),
uv AS (SELECT side, id, modality, CASE WHEN n > 0 THEN list_transform(vec, lambda x: x / n) ELSE vec END AS vec
       FROM nv),
scored AS (
  SELECT q.id AS qid, q.modality AS q_mod, c.modality AS c_mod, c.id AS doc_id, q.id = c.id AS rel,
         round(list_dot_product(q.vec, c.vec), 6) + 0.0 AS score
  FROM uv q JOIN uv c ON q.side = 'query' AND c.side = 'cand'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, q_mod, c_mod ORDER BY score DESC, doc_id) AS rk FROM scored),
fr AS (SELECT qid, q_mod, c_mod, min(CASE WHEN rel THEN rk END) AS first_rank FROM ranked GROUP BY qid, q_mod, c_mod),
perq AS (SELECT *, {_HITS}, CASE WHEN first_rank <= 1000 THEN 1.0 / first_rank ELSE 0.0 END AS rr FROM fr)
SELECT 0 AS task_id, 'Image-to-Text Retrieval' AS task, 'conversations' AS dataset, 'test' AS split,
       'conversations' AS cand_pool, {_MOD.format(c='q_mod')} AS query_modality,
       {_MOD.format(c='c_mod')} AS candidate_modality, count(*) AS n, {_SUMS}, round(avg(rr), 6) + 0.0 AS mrr
FROM perq GROUP BY q_mod, c_mod"""

SQL.update({"corpus_eval_report": _CORPUS_REPORT})

SQL.update({"eval_report_tsv": SQL["eval_report_wide"]})


# ---- contrastive evaluation on real pairs ---------------------------------------------

_PAIR_CONTRASTIVE = f"""WITH {CORPUS}, {_pairs(False, validation=True)}, {_batches('pairs', 'id', 8, 42, 0)},
items AS (
  SELECT b.batch_id, b.pos, 'query' AS role, coalesce(b.q_txt, '') AS txt,
         CASE WHEN b.q_txt IS NULL OR b.q_txt = '' THEN 0 ELSE 1 END AS tm, b.q_has_img AS im,
         CASE WHEN b.q_has_img = 1 THEN c.caption ELSE '' END AS imtext
  FROM b JOIN corpus c ON c.id = b.id
  UNION ALL
  SELECT b.batch_id, b.pos, 'pos_cand', coalesce(b.c_txt, ''),
         CASE WHEN b.c_txt IS NULL OR b.c_txt = '' THEN 0 ELSE 1 END, b.c_has_img,
         CASE WHEN b.c_has_img = 1 THEN c.caption ELSE '' END
  FROM b JOIN corpus c ON c.id = b.id),
ik AS (SELECT *, batch_id::VARCHAR || '-' || pos::VARCHAR || '-' || role AS ikey FROM items),
{_hash_encode('ik', 'ikey', 'txt', '', 'te')},
{_hash_encode('ik', 'ikey', 'imtext', 'img:', 'ie')},
raw AS (SELECT ik.batch_id, ik.pos, ik.role, ik.im, ik.tm, ie.vec::DOUBLE[] AS iv, te.vec::DOUBLE[] AS tv
        FROM ik JOIN te ON te.id = ik.ikey JOIN ie ON ie.id = ik.ikey),
fv AS (SELECT batch_id, pos, role, list_transform(list_zip(iv, tv), lambda p: p[1] * im + p[2] * tm) AS v FROM raw),
q AS (SELECT batch_id, batch_id AS g, pos, pos AS target, {_eps('v')} AS qv FROM fv WHERE role = 'query'),
p AS (SELECT batch_id AS g, pos AS col, {_eps('v')} AS pv FROM fv WHERE role = 'pos_cand'),
s AS (SELECT q.batch_id, q.pos, q.target, p.col, list_dot_product(q.qv, p.pv) * 100.0 AS s FROM q JOIN p ON q.g = p.g),
s2 AS (SELECT *, max(s) OVER (PARTITION BY batch_id, pos) AS m FROM s),
pq AS (SELECT batch_id, pos, max(m) + ln(sum(exp(s - m))) - max(CASE WHEN col = target THEN s END) AS loss,
              CASE WHEN min(col) FILTER (WHERE s = m) = max(target) THEN 1.0 ELSE 0.0 END AS correct
       FROM s2 GROUP BY batch_id, pos)
SELECT batch_id, count(*) AS n, round(avg(loss), 6) + 0.0 AS loss, round(avg(correct), 6) + 0.0 AS accuracy
FROM pq GROUP BY batch_id"""

SQL.update({"pair_contrastive_eval": _PAIR_CONTRASTIVE})


# ---- round trips through files, by split --------------------------------------------------

_SPLIT = "CASE WHEN vec_id % 10 = 0 THEN 'validation' WHEN vec_id % 10 = 1 THEN 'test' ELSE 'train' END"

SQL.update({
    # the first document is judged twice, the second has rel 0; the last line has the task
    "qrels_files": f"""SELECT {_SPLIT} AS split, vec_id::VARCHAR AS qid,
       array_to_string(list_sort(list_distinct([vec_id::VARCHAR, (2 * vec_id + 1)::VARCHAR])), ',') AS doc_ids,
       CAST(2 AS BIGINT) AS n_docs, (label % 5)::VARCHAR AS task_id FROM embeddings""",
    "embedding_store": f"""WITH h AS (SELECT vec_id AS id, list_transform({_FP16}, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM h),
u AS (SELECT id, CASE WHEN s > 0 THEN list_transform(v, lambda x: x / s) ELSE v END AS v FROM n),
scored AS (SELECT q.id AS qid, 'i' AS q_mod, 'i' AS c_mod, c.id AS doc_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score
           FROM u q CROSS JOIN u c)
SELECT qid, q_mod, c_mod, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10""",
})

SQL.update({
    "embedding_store_splits": f"""WITH h AS (SELECT vec_id AS id, {_SPLIT} AS split, list_transform({_FP16}, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT id, split, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM h),
u AS (SELECT id, split, CASE WHEN s > 0 THEN list_transform(v, lambda x: x / s) ELSE v END AS v FROM n),
scored AS (SELECT q.split, q.id AS qid, 'i' AS q_mod, 'i' AS c_mod, c.id AS doc_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score
           FROM u q CROSS JOIN u c)
SELECT split, qid, q_mod, c_mod, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10""",
})
