"""The queries of plans.more_queries as DuckDB SQL; what made sources hold comes from plans.templates, which is written by hand."""

from __future__ import annotations

from . import oracles as O
from .templates import FILES, PROMPTS, TREES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    show = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


_UNITS = f"""u AS (SELECT * FROM {_values([(k, f[0], f[1], *u) for k, f in enumerate(FILES) for u in f[3]])} AS v(k, language, ext, kind, name, a, b)),
found AS (SELECT source AS repository, 'd' || doc_id || ext AS relative_path, language, kind, replace(name, '~', CAST(doc_id AS VARCHAR)) AS qualified_name, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line
    FROM documents JOIN u ON k = doc_id % {len(FILES)})"""

COUNTS = f"""WITH {_UNITS}, f AS (SELECT source AS repository, count(*) AS files FROM documents GROUP BY source), n AS (SELECT repository, count(*) AS entries FROM found GROUP BY repository)
SELECT repository, files, CAST(0 AS BIGINT) AS bad_archives, entries, entries AS distinct_entries, CAST(0 AS BIGINT) AS errors FROM f JOIN n USING (repository)"""

HOLDERS = f"""WITH {_UNITS} SELECT repository, relative_path, kind, qualified_name, start_line, end_line, qualified_name AS symbol_name FROM found WHERE kind = 'type' AND starts_with(qualified_name, 'Holder_') AND NOT contains(qualified_name, '::')"""

STATS = f"""WITH {_UNITS} SELECT CASE grouping(language, repository, kind) WHEN 7 THEN 'total' WHEN 3 THEN 'language' WHEN 5 THEN 'repository' ELSE 'kind' END AS dimension, coalesce(language, repository, kind) AS value, count(*) AS n
FROM found GROUP BY GROUPING SETS ((), (language), (repository), (kind))"""


def _hash(tree: tuple) -> str:
    """SQL of a node's whole digest."""
    kind, children = tree
    if not children:
        return f"md5('0' || md5({quoted(kind)}))"
    out = "'0'"
    for c in children:
        out = f"md5({out} || {_hash(c)})"
    return out


def _post_order(tree: tuple) -> list[str]:
    return [h for c in tree[1] for h in _post_order(c)] + [f"substr({_hash(tree)}, 1, 16)"]


_SHAPES = "(" + " UNION ALL ".join(f"SELECT {k} AS k, {i} AS i, {h} AS h" for k, t in enumerate(TREES) for i, h in enumerate(_post_order(t[2]))) + ")"
STRUCTURE = f"""WITH s AS (SELECT k, count(*) AS n, md5(string_agg(h, ',' ORDER BY i)) AS digest FROM {_SHAPES} GROUP BY k) SELECT doc_id, n, digest FROM documents JOIN s ON k = doc_id % {len(TREES)}"""


def _by_shape(table: str, id_: str) -> str:
    return f"(SELECT {id_} AS id, i, h FROM {table} JOIN {_SHAPES} AS s ON s.k = {id_} % {len(TREES)})"


KNOWLEDGE = (
    "WITH " + O._retrieval(3, 20, grams=_by_shape("documents", "doc_id"), wanted=_by_shape("benchmark", "item_id"))
    + " SELECT query_id, rank, id, kind, qualified_name, score, CAST(n AS DOUBLE) / size AS containment FROM rows JOIN kb USING (id)"
)

PROMPT = f"""WITH p AS (SELECT * FROM {_values([(k, p[2], p[3], p[4], p[5], p[6]) for k, p in enumerate(PROMPTS)])} AS v(k, t, mode, found, kind, local)),
x AS (SELECT doc_id, replace(t, '~', CAST(doc_id AS VARCHAR)) AS t, mode, found, kind, local FROM documents JOIN p ON k = doc_id % {len(PROMPTS)})
SELECT doc_id, md5(t) AS digest, mode AS prompt_extraction_mode_used, found AS docstring_found, kind AS declaration_context_type, CAST(local AS INT) AS local_context_lines_used,
    CAST(CASE WHEN kind = 'empty' THEN 0 + length(t) ELSE length(t) END AS INT) AS prompt_char_count FROM x"""

SETS = """WITH x AS (SELECT l_orderkey, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linenumber <= 3)) AS c, list_distinct(list(CAST(l_suppkey AS VARCHAR)) FILTER (l_linenumber >= 2)) AS r,
    coalesce(max(l_returnflag) FILTER (l_linenumber = 1), '') AS a, coalesce(max(l_returnflag) FILTER (l_linenumber = 2), '') AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN coalesce(len(r), 0) = 0 THEN 0.0 ELSE CAST(coalesce(len(list_intersect(c, r)), 0) AS DOUBLE) / len(r) END, 9) AS coverage,
    coalesce(array_to_string(list_sort(list_filter(r, lambda v: NOT coalesce(list_contains(c, v), false))), ','), '') AS residual,
    a || CASE WHEN b <> '' AND b <> a THEN (CASE WHEN a <> '' THEN ',' ELSE '' END) || b ELSE '' END || CASE WHEN a <> 'A' AND b <> 'A' THEN (CASE WHEN a <> '' OR b <> '' THEN ',' ELSE '' END) || 'A' ELSE '' END AS names FROM x"""

_HEX = "lpad(lower(to_hex(CAST({} AS UBIGINT))), 16, '0')"
JSON_FP = f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN {_HEX.format(chr(39) + '1844674407370955' + chr(39) + ' || lpad(CAST(p_partkey % 1600 AS VARCHAR), 4, chr(48))')} || ',' || {_HEX.format('p_partkey')} END AS fp FROM part"

STATUS = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'runtime_error' WHEN event_id % 11 = 0 THEN 'invalid_prompt_context' WHEN event_id % 13 = 0 THEN 'invalid_groundtruth'
    WHEN event_id % 5 = 0 THEN 'no_reference_candidates' WHEN event_id % 7 <= 1 THEN 'reference_budget_zero' ELSE 'ok' END AS status FROM events"""

UNSUPPORTED = """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id FROM nation), r AS (SELECT unnest([1, 2]) AS rank),
t AS (SELECT query_id, 'structure' AS how, CAST(rank AS INT) AS rank, false AS scored FROM n, r WHERE query_id % 3 = 0)
SELECT * FROM t UNION ALL SELECT query_id, 'text', CAST(rank AS INT), false FROM n, r WHERE query_id % 3 = 2"""

TRUNCATION = """WITH l AS (SELECT l_orderkey AS id, l_linenumber AS pos, max(CAST(l_quantity AS INT)) AS len FROM lineitem GROUP BY ALL),
r AS (SELECT id, pos, 'p' || pos AS path, sum(len) OVER w - len AS low, sum(len) OVER w AS high FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)),
s AS (SELECT id, max(high) AS plow, max(high) + id % 60 AS target, max(high) + id % 60 + id % 23 AS total FROM r GROUP BY id),
t AS (SELECT s.*, i, i * 4 AS a, least(i * 4 + 4, total) AS b, greatest(CAST(ceil(total / 4.0) AS BIGINT), 1) AS n FROM s, unnest(range(0, greatest(CAST(ceil(total / 4.0) AS BIGINT), 1))) AS u(i)),
k AS (SELECT *, i >= n - 40 AS kept, greatest(n - 40, 0) * 4 AS start FROM t),
c AS (SELECT r.id, r.pos, path, low, high, any_value(start) AS start, count(*) FILTER (b > low AND b <= high) AS whole, count(*) FILTER (kept AND b > low AND a < high) AS meets FROM r JOIN k ON k.id = r.id GROUP BY ALL),
f AS (SELECT *, whole = 0 OR high <= start OR (meets = 0 AND NOT (low < start AND start < high)) AS gone, whole > 0 AND high > start AND low < start AND start < high AS cut FROM c),
q AS (SELECT id, count(*) FILTER (NOT gone) AS used, count(*) FILTER (gone) AS omitted, count(*) FILTER (cut) AS cuts, first(path ORDER BY pos) FILTER (cut) AS cut_path, first(meets ORDER BY pos) FILTER (cut) AS cut_kept,
    first(whole ORDER BY pos) FILTER (cut) AS cut_whole, string_agg(path, ',' ORDER BY pos) FILTER (NOT gone) AS used_paths, string_agg(path, ',' ORDER BY pos) FILTER (gone) AS omitted_paths FROM f GROUP BY id),
g AS (SELECT id, count(*) FILTER (b > target) AS truth, count(*) FILTER (kept AND b <= target) AS prefix, count(*) FILTER (b > plow AND b <= target) AS pfull, count(*) FILTER (kept AND b > plow AND b <= target) AS pused,
    count(*) FILTER (b <= plow) AS refs FROM k GROUP BY id)
SELECT id AS sample_index, CASE WHEN truth = 0 OR truth >= 40 THEN 'invalid_groundtruth' ELSE 'ok' END AS status, truth AS groundtruth_token_count, prefix AS prefix_token_count, pfull AS prompt_token_count_full, pused AS prompt_token_count_used,
    prefix - pused AS reference_token_count, refs AS reference_token_count_total_considered, used AS reference_used_count, omitted AS reference_omitted_count, used > 0 OR prefix - pused > 0 AS reference_applied, cuts > 0 AS reference_partially_truncated,
    cut_path AS reference_truncated_path, coalesce(cut_kept, 0) AS reference_truncated_tokens_kept, coalesce(cut_whole, 0) AS reference_truncated_tokens_total, coalesce(used_paths, '') AS used_reference_paths,
    coalesce(omitted_paths, '') AS omitted_reference_paths, pused < pfull AS prompt_was_truncated FROM g JOIN q USING (id)"""

_STRICT = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN event_id + 0.5 WHEN 3 THEN 1.0 END AS as_float, CASE event_id % 6 WHEN 0 THEN event_id WHEN 3 THEN 1 END AS as_int FROM events"""

ORACLES: dict[str, str] = {
    "parse_units": f"WITH {_UNITS} SELECT * FROM found",
    "ingest_counts": COUNTS,
    "resume_by_filter": O.ORACLES["resume_anti_join"],
    "facade_search": HOLDERS,
    "facade_stats": STATS,
    "structure_fingerprints": STRUCTURE,
    "knowledge_retrieve": KNOWLEDGE,
    "syntax_check": "SELECT doc_id, doc_id % 6 NOT IN (1, 5) AS ok FROM documents",
    "fingerprint_scan": f"WITH {O._KB}, g AS (SELECT id, count(*) AS n FROM {O._grams('documents', 'doc_id')} GROUP BY id) SELECT {', '.join('kb.' + k for k in O._KEYS.split(', '))}, coalesce(n, -1) AS n_fp FROM kb LEFT JOIN g ON g.id = kb.id WHERE language = 'de' AND kind = 'method'",
    "set_functions": SETS,
    "json_fingerprints": JSON_FP,
    "comparison_statuses": STATUS,
    "stop_reasons": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'eos' WHEN event_id % 3 = 0 THEN 'newline' WHEN event_id % 65 >= 60 THEN 'max_new_tokens' ELSE 'unknown' END AS reason FROM events",
    "locations": f"WITH {O._KB} SELECT id, relative_path || ':' || start_line || '-' || end_line AS location FROM kb",
    "prompt_templates": PROMPT,
    "score_join": O.SCORE_RECORDS,
    "shard_files": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, event_id AS sample_index, CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 97 AS DOUBLE) / 8 END AS log_ppl FROM events",
    "task_files": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sample_index, md5(text) AS prompt, lang AS groundtruth, 'information' AS retrieval_mode, 'a.c' AS path, CAST(0.5 AS DOUBLE) AS score FROM documents ORDER BY doc_id LIMIT 300",
    "first_references": "WITH x AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE least(len(p), 2) END AS n, CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE array_to_string(p[1:2], ',') END AS parts FROM x",
    "calibration_files": f"WITH c AS ({O.CALIBRATION}) SELECT run_dir, rank, CASE CAST(run_dir AS BIGINT) % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'plus_local8' ELSE 'plus_local16' END AS prompt_builder, (SELECT run_dir FROM c WHERE rank = 1) AS best, CAST((SELECT count(*) FROM c) AS INT) AS runs FROM c",
    "run_metadata": "SELECT 'runs/' || max(r_regionkey) AS run_dir, 'in.jsonl' AS input_path, 'out.jsonl' AS output_jsonl, CAST(4 AS BIGINT) AS num_gpus FROM region",
    "strict_numbers": _STRICT,
    "strict_means": f"SELECT round(avg(as_int), 9) AS mean_int, count(as_int) AS ints, round(avg(as_float), 9) AS mean_float, count(as_float) AS floats FROM ({_STRICT})",
    "unsupported_queries": UNSUPPORTED,
    "left_truncation": TRUNCATION,
}
