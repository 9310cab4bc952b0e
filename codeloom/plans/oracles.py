"""The queries of plans.queries as DuckDB SQL."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KB = """
kb AS (SELECT doc_id AS id, source AS repository, 'doc/' || doc_id AS relative_path, lang AS language,
       ['declaration_block', 'function', 'method', 'global', 'type'][CAST(doc_id % 5 + 1 AS INT)] AS kind, 'doc_' || doc_id AS qualified_name, 1 AS start_line,
       CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS INT) AS end_line, text
       FROM documents)"""
_KEYS = "id, repository, relative_path, language, kind, qualified_name, start_line, end_line"
_ORDER = "repository, relative_path, start_line, end_line, qualified_name, kind, id"


def _grams(table: str, id_: str, n: int = 2, text: str = "text") -> str:
    """(id, i, h): hashed word n-grams of a table's texts."""
    return f"""(SELECT {id_} AS id, i, substr(md5(array_to_string(w[i:i + {n - 1}], ' ')), 1, 16) AS h
        FROM (SELECT {id_}, regexp_extract_all({text}, '[a-zA-Z0-9_]+') AS w FROM {table}), unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS t(i) WHERE len(w) > 0)"""


def _digest(n: int) -> str:
    return f"(SELECT id, count(*) AS n, md5(string_agg(h, ',' ORDER BY i)) AS d FROM {_grams('documents', 'doc_id', n)} GROUP BY id)"


TEXT_FINGERPRINT = f"""
SELECT doc_id, coalesce(a.n, -1) AS n, a.d AS digest, b.d AS digest3
FROM documents LEFT JOIN {_digest(2)} a ON a.id = doc_id LEFT JOIN {_digest(3)} b ON b.id = doc_id"""

_TIE = "CASE kind WHEN 'declaration_block' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 WHEN 'global' THEN 3 WHEN 'type' THEN 4 ELSE 99 END AS kp, greatest(0, CASE WHEN end_line = 0 THEN 0 ELSE end_line - start_line END) AS span"


def _retrieval(shots: int, k: int | None, query: str = "text", grams: str | None = None, wanted: str | None = None) -> str:
    """CTEs up to `rows` (query_id, rank, id, score, n, size): prefilter, unrolled greedy rounds, backfill."""
    cte = f"""{_KB},
u AS (SELECT *, {_TIE} FROM kb),
cf AS MATERIALIZED (SELECT DISTINCT id, h FROM {grams or _grams('documents', 'doc_id')}),
has AS (SELECT DISTINCT id FROM cf),
qf AS MATERIALIZED (SELECT DISTINCT id AS q, h FROM {wanted or _grams('benchmark', 'item_id', text=query)}),
size AS (SELECT q, count(*) AS size FROM qf GROUP BY q),
shared AS MATERIALIZED (SELECT q, cf.id, h FROM qf JOIN cf USING (h)),
n AS (SELECT q, id, count(*) AS n FROM shared GROUP BY ALL),
every AS (SELECT size.q, u.id, kp, span, qualified_name, coalesce(n, 0) AS n FROM size, u JOIN has ON has.id = u.id LEFT JOIN n ON n.q = size.q AND n.id = u.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, kp, span, qualified_name, id) AS rk FROM every),
pool AS MATERIALIZED (SELECT * FROM ranked{f' WHERE rk <= {k}' if k else ''}),
r0 AS (SELECT q, h FROM qf),
s0 AS (SELECT q, id, 0 AS rank, 0.0 AS score FROM pool WHERE false)"""
    for j in range(1, shots + 1):
        cte += f""",
g{j} AS (SELECT p.q, p.id, kp, span, qualified_name, count(*) AS gain FROM pool p JOIN shared s ON s.q = p.q AND s.id = p.id JOIN r{j - 1} r ON r.q = s.q AND r.h = s.h
    WHERE NOT EXISTS (FROM s{j - 1} c WHERE c.q = p.q AND c.id = p.id) GROUP BY ALL),
b{j} AS MATERIALIZED (SELECT q, id, gain FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gain DESC, kp, span, qualified_name, id) AS o FROM g{j}) WHERE o = 1),
s{j} AS MATERIALIZED (FROM s{j - 1} UNION ALL SELECT q, id, {j}, CAST(gain AS DOUBLE) / (SELECT count(*) FROM r{j - 1} r WHERE r.q = b{j}.q) FROM b{j}),
r{j} AS MATERIALIZED (FROM r{j - 1} r WHERE NOT EXISTS (FROM b{j} b JOIN shared s ON s.q = b.q AND s.id = b.id WHERE b.q = r.q AND s.h = r.h))"""
    return (
        cte
        + f""",
fill AS (SELECT q, id, coalesce((SELECT max(rank) FROM s{shots} c WHERE c.q = p.q), 0) + row_number() OVER (PARTITION BY q ORDER BY rk) AS rank, 0.0 AS score
    FROM pool p WHERE NOT EXISTS (FROM s{shots} c WHERE c.q = p.q AND c.id = p.id)),
chosen AS (SELECT q, id, rank, score FROM s{shots} UNION ALL SELECT q, id, rank, score FROM fill WHERE rank <= {shots}),
rows AS (SELECT c.q AS query_id, CAST(c.rank AS INT) AS rank, c.id, c.score, p.n, size.size FROM chosen c JOIN pool p ON p.q = c.q AND p.id = c.id JOIN size ON size.q = c.q)"""
    )


def _retrieved(k: int | None) -> str:
    return f"WITH {_retrieval(3, k)} SELECT query_id, rank, id, kind, qualified_name, score, CAST(n AS DOUBLE) / size AS containment FROM rows JOIN kb USING (id)"


PREFILTER = f"""
WITH {_KB}, u AS (SELECT *, {_TIE} FROM kb), cf AS (SELECT DISTINCT id, h FROM {_grams('documents', 'doc_id')}), qf AS (SELECT DISTINCT id AS q, h FROM {_grams('benchmark', 'item_id')}),
size AS (SELECT q, count(*) AS size FROM qf GROUP BY q), n AS (SELECT q, cf.id, count(*) AS n FROM qf JOIN cf USING (h) GROUP BY ALL),
r AS (SELECT n.*, row_number() OVER (PARTITION BY q ORDER BY n DESC, kp, span, qualified_name, n.id) AS rk FROM n JOIN u ON u.id = n.id)
SELECT q AS query_id, id, CAST(rk AS INT) AS rk, n, CAST(n AS DOUBLE) / size AS containment FROM r JOIN size USING (q) WHERE rk <= 5"""

_TAIL = "array_to_string(list_slice(l, greatest(len(l) - {k} + 1, 1), len(l)), chr(10))"
_LINES = "CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"

HIT_RATE = f"""
WITH {_retrieval(3, 20, query=_TAIL.format(k=5).replace('l)', 'l)')).replace("FROM benchmark)", f"FROM (SELECT *, {_LINES} AS l FROM benchmark))")},
hits AS (SELECT item_id, coalesce(bool_or(contains(kb.text, b.text)) AND b.text <> '', false) AS hit FROM benchmark b LEFT JOIN rows ON query_id = item_id LEFT JOIN kb ON kb.id = rows.id GROUP BY item_id, b.text)
SELECT count(*) AS tasks, count_if(hit) AS hits, round(count_if(hit) / count(*), 9) AS hit_rate FROM hits"""

UPSERT = """
WITH s AS (SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0),
fresh AS (SELECT doc_id, row_number() OVER (ORDER BY source, 'doc/' || doc_id, ['declaration_block', 'function', 'method', 'global', 'type'][CAST(doc_id % 5 + 1 AS INT)], 'doc_' || doc_id) + (SELECT max(id) FROM s) AS id FROM b WHERE doc_id % 2 = 1)
SELECT id, 'doc_' || id AS qualified_name, CASE WHEN id % 3 = 0 THEN 'change 1' END AS new_text FROM s
UNION ALL SELECT id, 'doc_' || doc_id, 'change 1' FROM fresh"""

_TURNS = r"""
c AS (SELECT * FROM conversations WHERE strlen(text) = length(text)),
j AS (SELECT c.conv_id * 100 + c.turn AS sample_index, c.conv_id, c.text, a.text AS groundtruth FROM c JOIN c a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn),
t AS (SELECT *, CASE WHEN conv_id % 7 > 1 THEN 'repo' || conv_id % 7 ELSE 'UNKNOWN' END AS repository,
    CASE WHEN sample_index % 11 <> 0 THEN text END AS p_no, CASE WHEN sample_index % 3 = 0 THEN groundtruth WHEN sample_index % 13 <> 0 THEN text END AS p_with, sample_index % 4 <> 0 AS used,
    ['ok', 'no_reference_candidates', 'reference_budget_zero', 'invalid_prompt_context', 'runtime_error'][CAST(sample_index % 5 + 1 AS INT)] AS status FROM j),
l AS (SELECT *, string_split(regexp_replace(groundtruth, '\r\n?', chr(10), 'g'), chr(10))[1] AS g1, string_split(regexp_replace(p_no, '\r\n?', chr(10), 'g'), chr(10))[1] AS n1,
    string_split(regexp_replace(p_with, '\r\n?', chr(10), 'g'), chr(10))[1] AS w1 FROM t),
q AS (SELECT *, regexp_replace(g1, '[\s\x0b\x1c-\x1f]+', '', 'g') AS g, regexp_replace(n1, '[\s\x0b\x1c-\x1f]+', '', 'g') AS n, regexp_replace(w1, '[\s\x0b\x1c-\x1f]+', '', 'g') AS w FROM l)"""


def _es(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


_SIDES = {"no_reference": "n", "with_reference": "w"}
_SCORED = ", ".join(
    f"CAST({v} = g AS DOUBLE) AS em_{s}, {_es(v, 'g')} AS es_{s}, CAST({v}1 = g1 AS DOUBLE) AS strict_em_{s}, {_es(v + '1', 'g1')} AS strict_es_{s}" for s, v in _SIDES.items()
)
_CHANGES = ", ".join(f"{m}_with_reference - {m}_no_reference AS {m}_improvement_abs" for m in ("em", "es", "strict_em", "strict_es"))
_SCORES = f"{_TURNS}, z AS (SELECT *, {_SCORED} FROM q), v AS (SELECT *, {_CHANGES} FROM z)"
_METRIC_COLUMNS = [f"{m}_{s}" for m in ("em", "es", "strict_em", "strict_es") for s in ("no_reference", "with_reference", "improvement_abs")]

EDIT_SIMILARITY = f"WITH {_TURNS} SELECT sample_index, {_es('g1', 'n1')} AS es FROM q WHERE n1 IS NOT NULL"
SCORE_RECORDS = f"WITH {_SCORES} SELECT sample_index, g AS normalized_groundtruth, {', '.join(f'round({c}, 9) AS {c}' for c in _METRIC_COLUMNS)} FROM v"

_OK = "(em_no_reference IS NOT NULL AND es_no_reference IS NOT NULL)"
_USED = "(used AND em_with_reference IS NOT NULL AND es_with_reference IS NOT NULL)"


def _stat(name: str, column: str, where: str, how: str = "avg") -> str:
    return f"round({how}(CAST({column} AS DOUBLE)) FILTER ({where}), 9) AS {name}"


def _summary() -> str:
    out = [
        "'code' AS prompt_mode", "'strict' AS prompt_builder_requested",
        "min_by(CASE WHEN sample_index % 9 = 0 THEN 'strict_fallback_context8' ELSE 'strict' END, sample_index) AS prompt_builder", "'line' AS stop_policy", "'beam' AS decode_policy",
        "4 AS beam_size", "5 AS reference_shots", "64 AS max_new_tokens", "'beam' AS generation_policy", "'line' AS stop_boundary",
        "'exact match after removing all whitespace characters' AS metric_definition_em", "'edit similarity after removing all whitespace characters' AS metric_definition_es",
        "'exact match on the first generated line' AS strict_metric_definition_em", "'edit similarity on the first generated line' AS strict_metric_definition_es", "'reference_applied' AS metric_scope",
        "CAST(0.25 AS DOUBLE) AS target_em_no_reference", "CAST(0.5877 AS DOUBLE) AS target_es_no_reference", "count(*) AS samples_total", f"count_if({_OK}) AS samples_valid",
        "count_if(sample_index % 6 > 0) AS samples_with_reference_candidates", f"count_if({_USED}) AS samples_with_reference_applied",
    ]
    out += [f"count_if(status = '{s}') AS samples_{s}" for s in ("no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "runtime_error")]
    for m in ("em", "es"):
        out += [f"count_if({_USED} AND {m}_improvement_abs {op} 0) AS {m}_{name}_count" for name, op in (("improved", ">"), ("worse", "<"), ("same", "="))]
        out += [_stat(f"{label}_{c}", c, _USED, how) for c in (f"{m}_no_reference", f"{m}_with_reference", f"{m}_improvement_abs") for label, how in (("mean", "avg"), ("median", "median"))]
        for label, how in (("mean", "avg"), ("median", "median")):
            out += [_stat(f"all_valid_{label}_{m}_no_reference", f"{m}_no_reference", _OK, how), _stat(f"all_valid_strict_{label}_{m}_no_reference", f"strict_{m}_no_reference", _OK, how)]
            out += [_stat(f"strict_{label}_{m}_{s}", f"strict_{m}_{s}", _USED, how) for s in _SIDES]
    out += [
        f"round(0.25 - avg(em_no_reference) FILTER ({_USED}), 9) AS gap_to_target_em", f"round(0.5877 - avg(es_no_reference) FILTER ({_USED}), 9) AS gap_to_target_es",
        _stat("empty_prediction_rate_no_reference", "(sample_index % 8 = 0)", _OK), _stat("empty_prediction_rate_with_reference", "(sample_index % 10 = 0)", _USED),
        _stat("docstring_found_rate", "(sample_index % 2 = 0)", _OK), _stat("prompt_extraction_fallback_rate", "(sample_index % 9 = 0)", _OK),
        _stat("mean_groundtruth_token_count", "length(groundtruth)", _OK), _stat("mean_reference_token_count", "sample_index % 50", _USED), _stat("mean_reference_used_count", "sample_index % 5", _USED),
        _stat("mean_prediction_token_count_no_reference", "length(text)", _OK), _stat("mean_prediction_token_count_with_reference", "sample_index % 40", _USED),
    ]
    return f"WITH {_SCORES} SELECT {', '.join(out)} FROM v"


_BY_REPOSITORY = ["em_no_reference", "em_with_reference", "es_no_reference", "es_with_reference", "em_improvement_abs", "es_improvement_abs"]
SUMMARY_BY_REPOSITORY = f"WITH {_SCORES} SELECT repository, count(*) AS samples, count_if({_USED}) AS applied_samples, {', '.join(_stat(f'mean_{c}', c, _USED) for c in _BY_REPOSITORY)} FROM v GROUP BY repository"


def _shards() -> str:
    plain, helped, fallback = "p_no IS NOT NULL", "p_with IS NOT NULL", "(sample_index % 9 = 0)"
    out = ["count(*) AS samples_total", f"count_if({plain}) AS samples_generated_no_reference", f"count_if({helped}) AS samples_generated_with_reference", "count_if(sample_index % 6 > 0) AS samples_with_reference_candidates"]
    out += [f"count_if(status = '{s}') AS samples_{s}" for s in ("no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "runtime_error")]
    out += [_stat("empty_prediction_rate_no_reference", "(sample_index % 8 = 0)", plain), _stat("empty_prediction_rate_with_reference", "(sample_index % 10 = 0)", helped)]
    out += [_stat("docstring_found_rate", "(sample_index % 2 = 0)", plain), _stat("prompt_extraction_fallback_rate", fallback, plain)]
    for name, value, where in (
        ("groundtruth_token_count", "length(groundtruth)", plain), ("prompt_token_count_used_no_reference", "sample_index % 30", plain), ("prompt_token_count_used_with_reference", "sample_index % 20", helped),
        ("reference_token_count", "sample_index % 50", helped), ("reference_used_count", "sample_index % 5", helped), ("prediction_token_count_no_reference", "length(text)", plain),
        ("prediction_token_count_with_reference", "sample_index % 40", helped),
    ):
        out.append(_stat(f"mean_{name}", value, where))
    return f"WITH {_TURNS} SELECT CAST(sample_index % 4 AS INT) AS shard_rank, {', '.join(out)} FROM t GROUP BY ALL"


_PPL = """p AS (SELECT event_id AS sample_index, CAST(event_id % 4 AS INT) AS shard_rank, CASE WHEN event_id % 9 = 0 OR event_type = '' THEN 'UNKNOWN' ELSE coalesce(event_type, 'UNKNOWN') END AS repository,
    CASE WHEN event_id % 17 <> 0 THEN event_id % 97 / 8.0 END AS a, CASE WHEN event_id % 5 <> 0 THEN event_id % 89 / 16.0 END AS b, event_id % 3 <> 0 AS used,
    ['ok', 'no_reference_candidates', 'reference_budget_zero', 'invalid_prompt_context', 'invalid_groundtruth', 'runtime_error'][CAST(event_id % 6 + 1 AS INT)] AS status FROM events)"""
_P_OK, _P_USED = "a IS NOT NULL", "(used AND a IS NOT NULL AND b IS NOT NULL)"
_P_COUNTS = [f"count_if(status = '{s}') AS samples_{s}" for s in ("no_reference_candidates", "reference_budget_zero", "invalid_prompt_context", "invalid_groundtruth", "runtime_error")]
_P_HEAD = ["count(*) AS samples_total", f"count_if({_P_OK}) AS samples_valid", "count_if(sample_index % 6 > 0) AS samples_with_reference_candidates", f"count_if({_P_USED}) AS samples_with_reference_applied", *_P_COUNTS]
_P_MEANS = [_stat("mean_log_ppl_no_reference", "a", _P_USED), _stat("mean_log_ppl_with_reference", "b", _P_USED), _stat("mean_log_ppl_improvement_abs", "a - b", _P_USED)]
_P_ALL = [
    "5 AS reference_shots", "5 AS prompt_tail_lines", "'reference_applied' AS metric_scope", *_P_HEAD, *[f"count_if({_P_USED} AND a - b {op} 0) AS {n}_count" for n, op in (("improved", ">"), ("worse", "<"), ("same", "="))],
    *_P_MEANS, _stat("all_valid_mean_log_ppl_no_reference", "a", _P_OK),
    *[_stat(f"mean_{n}", f"sample_index % {m}", _P_OK) for n, m in (("groundtruth_token_count", 31), ("prompt_tail_line_count_observed", 6), ("prompt_tail_token_count_full", 90), ("prompt_token_count_used_no_reference", 80))],
    *[_stat(f"mean_{n}", f"sample_index % {m}", _P_USED) for n, m in (("prompt_token_count_used_with_reference", 70), ("reference_token_count", 60), ("reference_used_count", 5))],
]
PPL_BY_REPOSITORY = f"""WITH {_PPL} SELECT repository, count(*) AS samples, count_if({_P_USED}) AS applied_samples, {', '.join(_P_MEANS)}, count_if({_P_USED} AND a - b > 0) AS improved_count,
    {_stat('mean_groundtruth_token_count', 'sample_index % 31', 'true')}, {_stat('mean_reference_token_count', 'sample_index % 60', _P_USED)}, {_stat('mean_prompt_tail_token_count_full', 'sample_index % 90', 'true')} FROM p GROUP BY repository"""

PACKING = """
WITH s AS (SELECT l_orderkey AS id, l_linenumber AS pos, max('p' || l_partkey) AS path, max(CAST(l_quantity AS INT)) AS len FROM lineitem GROUP BY ALL),
a AS (SELECT *, sum(len) OVER (PARTITION BY id) AS total, coalesce(sum(len) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CAST(id % 150 AS INT) AS prompt FROM s),
b AS (SELECT *, least(prompt, greatest(140 - least(90, total, 140), 0)) AS kept FROM a),
c AS (SELECT *, least(len, greatest(least(90, greatest(140 - kept, 0)) - before, 0)) AS take FROM b)
SELECT id AS sample_index, CAST(sum(take) AS BIGINT) AS reference_token_count, CAST(any_value(total) AS BIGINT) AS reference_token_count_total_considered, count_if(take > 0) AS reference_used_count,
    count_if(take > 0 AND take < len) > 0 AS reference_partially_truncated, sum(take) > 0 AS reference_applied, coalesce(string_agg(path, ',' ORDER BY pos) FILTER (take > 0), '') AS used_reference_paths,
    coalesce(string_agg(path, ',' ORDER BY pos) FILTER (take <= 0), '') AS omitted_reference_paths, count_if(take <= 0) AS reference_omitted_count,
    max(path) FILTER (take > 0 AND take < len) AS reference_truncated_path, CAST(coalesce(max(take) FILTER (take > 0 AND take < len), 0) AS BIGINT) AS reference_truncated_tokens_kept,
    coalesce(max(len) FILTER (take > 0 AND take < len), 0) AS reference_truncated_tokens_total, 90 AS reference_budget_tokens_effective, CAST(any_value(kept) AS BIGINT) AS prompt_token_count_used,
    any_value(prompt) AS prompt_token_count_full, any_value(kept) < any_value(prompt) AS prompt_was_truncated, CAST(sum(take) + any_value(kept) AS BIGINT) AS prefix_token_count_total
FROM c GROUP BY id"""

CALIBRATION = """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS run_dir, CAST(row_number() OVER (ORDER BY CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 / 8.0 ELSE 0 END DESC, s_suppkey % 3 / 4.0 DESC, s_suppkey % 4 ASC,
    s_suppkey % 3 DESC, s_suppkey % 2 DESC, s_suppkey) AS INT) AS rank FROM supplier"""

SEGMENTS = f"""
WITH {_KB}, x AS (SELECT *, ' int f(int a) ' || '{{ ' || text AS t FROM kb)
SELECT id, '/* Retrieved reference 1: ' || repository || '/' || relative_path || ' | ' || kind || ' */' || chr(10) || CASE WHEN contains(kind, 'function') THEN 'int f(int a);' ELSE regexp_replace(t, '^[\\s]+|[\\s]+$', '', 'g') END || chr(10) || chr(10) AS segment,
    repository || '/' || relative_path AS path FROM x"""

TAIL = f"""
WITH x AS (SELECT doc_id, text, {_LINES} AS l FROM documents)
SELECT doc_id, md5({_TAIL.format(k=3)}) AS tail, CAST(least(len(l), 2) AS INT) AS n,
    CAST(length({_TAIL.format(k=2)}) + CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INT) AS chars FROM x"""

EXTENSION = """
WITH x AS (SELECT p_partkey, ['.c', '.java', '.hpp', '.C', '.h', ''][CAST(p_partkey % 6 + 1 AS INT)] AS ext FROM part)
SELECT p_partkey, ext, CASE WHEN ext IN ('.c', '.hpp', '.h') THEN 'C' WHEN ext = '.java' THEN 'Java' END AS language FROM x"""

FOLD = """
WITH RECURSIVE x AS (SELECT l_orderkey, list(md5('0' || md5(l_returnflag)) ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, k, 0 AS i, '0' AS h FROM x UNION ALL SELECT l_orderkey, k, i + 1, md5(h || k[i + 1]) FROM f WHERE i < len(k))
SELECT l_orderkey, substr(h, 1, 16) AS fp FROM f WHERE i = len(k)"""

INGEST = r"""
WITH d AS (SELECT source AS repository, 'd' || doc_id || '.c' AS relative_path, doc_id FROM documents)
SELECT repository, relative_path, 'function' AS kind, 'read_' || doc_id AS qualified_name, 1 AS start_line, 6 AS end_line, CAST(14 AS BIGINT) AS n_fp FROM d
UNION ALL SELECT repository, relative_path, 'declaration_block', 'read_' || doc_id || '::declblock#1', 3, 4, 5 FROM d
UNION ALL SELECT repository, relative_path, 'global', 'global::size_' || doc_id, 7, 7, 2 FROM d"""

ORACLES: dict[str, str] = {
    "text_fingerprint": TEXT_FINGERPRINT,
    "search_substring": f"WITH {_KB} SELECT {_KEYS} FROM kb WHERE contains(translate(text, '{_UP}', '{_LOW}'), 'licensed under')",
    "search_limit": f"WITH {_KB} SELECT {_KEYS} FROM kb WHERE language = 'en' AND kind = 'function' AND text IS NOT NULL ORDER BY {_ORDER} LIMIT 25",
    "scan_filtered_ordered": f"WITH {_KB} SELECT {_KEYS} FROM kb WHERE language = 'de' AND repository = 'src0' ORDER BY {_ORDER} LIMIT 20",
    "candidate_scan": f"WITH {_KB}, g AS (SELECT id, count(*) AS n FROM {_grams('documents', 'doc_id')} GROUP BY id) SELECT {', '.join('kb.' + k for k in _KEYS.split(', '))}, coalesce(n, -1) AS n_fp FROM kb LEFT JOIN g ON g.id = kb.id WHERE language IN ('fr', 'es')",
    "lookup_ids": f"WITH {_KB} SELECT {_KEYS} FROM kb WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "stats_grouping_sets": f"WITH {_KB} SELECT CASE grouping(language, repository, kind) WHEN 7 THEN 'total' WHEN 3 THEN 'language' WHEN 5 THEN 'repository' ELSE 'kind' END AS dimension, coalesce(language, repository, kind) AS value, count(*) AS n FROM kb GROUP BY GROUPING SETS ((), (language), (repository), (kind))",
    "retrieve_prefilter_topk": PREFILTER,
    "retrieve_greedy": _retrieved(20),
    "retrieve_unbounded": _retrieved(None),
    "hit_rate": HIT_RATE,
    "upsert_last_wins": UPSERT,
    "edit_similarity_ascii": EDIT_SIMILARITY,
    "score_records": SCORE_RECORDS,
    "summary_overall": _summary(),
    "summary_by_repository": SUMMARY_BY_REPOSITORY,
    "ppl_summary": f"WITH {_PPL} SELECT {', '.join(_P_ALL)} FROM p",
    "ppl_by_repository": PPL_BY_REPOSITORY,
    "ppl_shard_summaries": f"WITH {_PPL} SELECT shard_rank, {', '.join([*_P_HEAD, *_P_MEANS])} FROM p GROUP BY shard_rank",
    "shard_summaries": _shards(),
    "merge_shards": "SELECT CAST(event_id % 4 AS INT) AS shard_rank, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY ALL",
    "split_filter": "WITH x AS (SELECT event_id AS sample_index, CASE WHEN event_id % 2 = 0 THEN 't' || event_id ELSE CAST(event_id * 3 AS VARCHAR) END AS task_id FROM events) SELECT * FROM x WHERE coalesce(try_cast(task_id AS BIGINT), sample_index) % 7 = 3",
    "resume_anti_join": "SELECT event_id AS sample_index FROM events WHERE NOT (event_id % 3 = 0 OR event_id < 100)",
    "duplicate_task_check": "SELECT conv_id AS task_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "augment_join": f"WITH {_PPL} SELECT sample_index, o_orderstatus AS prompt, CAST(sample_index AS VARCHAR) AS task_id, CAST(a - b AS DOUBLE) AS change FROM orders JOIN p ON sample_index = o_orderkey",
    "calibration_rank": CALIBRATION,
    "reference_packing": PACKING,
    "reference_segments": SEGMENTS,
    "tail_line_queries": TAIL,
    "log_ppl": "SELECT vec_id, round(CASE WHEN len(embedding) > 0 THEN -list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) END, 9) AS log_ppl FROM embeddings",
    "extension_language": EXTENSION,
    "structure_fold": FOLD,
    "ingest_units": INGEST,
    "merged_summary_overall": _summary(),
    "merged_ppl_summary": f"WITH {_PPL} SELECT {', '.join(_P_ALL)} FROM p",
    "order_medians": "SELECT "
    + ", ".join(f"round(median({c}), 9) AS {n}" for n, c in (("price", "CAST(l_extendedprice AS DOUBLE)"), ("quantity", "CAST(l_quantity AS DOUBLE)"), ("discount", "CAST(l_discount AS DOUBLE)"), ("nothing", "CAST(NULL AS DOUBLE)")))
    + ", "
    + ", ".join(f"round(median(CAST(l_extendedprice AS DOUBLE)) FILTER (WHERE l_returnflag = '{f}'), 9) AS price_{f.lower()}" for f in "ANR")
    + " FROM lineitem",
}
