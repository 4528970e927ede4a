"""The queries once more, as SQL over the warehouse tables."""

from __future__ import annotations

from docmerge.functions.keys import SECTION_LABELS
from docmerge.plans.prompts import NO_TEXT_REQUEST, TEXT_PREFIX, system_prompt
from docmerge.sources.tables import ORDER_TEMPLATE

_S = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SI = _S[1:-1]

# Files of the documents table, with their group key.
FILES_SQL = rf"""
named AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, doc_id AS file_seq, lang AS session_id, text,
    CASE doc_id % 5 WHEN 0 THEN source || 'x-' || doc_id || '.txt'
      WHEN 1 THEN source || 'x (' || doc_id || ').txt'
      WHEN 2 THEN source || 'x_' || doc_id || '.md'
      WHEN 3 THEN source || 'x_copy.txt'
      ELSE source || 'x copy ' || doc_id || '.txt' END AS file_name
  FROM documents),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_name,
      '\.[^.]+$', ''), '[{_SI}\-_.]*[\[(]?[0-9]+[\])]?{_S}*$', ''),
      '(?i)[{_SI}\-_.]*copy{_S}*$', ''), '[{_SI}\-_]+$', '') AS k
  FROM named),
files AS (SELECT *, CASE WHEN k = '' THEN file_name ELSE k END AS group_id FROM keyed)"""

_RES = """
res AS (
  SELECT 'cust' || o_custkey || 'x' AS group_id, CAST(o_custkey AS VARCHAR) AS session_id,
    CAST(o_orderkey AS VARCHAR) AS file_id, 'cust' || o_custkey || 'x-' || o_orderkey || '.txt' AS file_name,
    o_orderkey AS file_seq, (o_orderkey % 17 <> 0 AND o_custkey % 101 <> 0) AS success,
    c_name AS customer, c_mktsegment AS segment, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_ENT = """
ent AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS file_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
      l_extendedprice, l_quantity) - 1 AS entry_idx,
    CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag, l_linestatus AS linestatus,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty, CAST(l_partkey AS VARCHAR) AS part
  FROM lineitem)"""


def _stack(source: str, ids: str, keys: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, {i} AS key_pos, '{k}' AS key, {k} AS value FROM {source}" for i, k in enumerate(keys)
    )


_HKEYS = ("customer", "segment", "status", "priority")
_EKEYS = ("line", "flag", "linestatus", "qty", "part")
_HCELLS = f"hcells AS ({_stack('res', 'group_id, file_id, file_name, file_seq, success', _HKEYS)})"
_ECELLS = f"ecells AS ({_stack('ent', 'file_id, entry_idx', _EKEYS)})"

_NESTED = f"""{_RES}, {_ENT},
ok AS (SELECT * FROM res WHERE success),
head AS (
  SELECT group_id, count(*) AS n_sources, min(file_seq) AS group_seq,
    {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)},
    min(status) = max(status) AS status_consistent, min(priority) = max(priority) AS priority_consistent
  FROM ok GROUP BY group_id),
lines AS (
  SELECT ok.group_id, ok.file_seq, ent.*,
    row_number() OVER (PARTITION BY ok.group_id ORDER BY ok.file_seq, ent.entry_idx) - 1 AS pos,
    count(*) OVER (PARTITION BY ok.group_id) AS n_rows
  FROM ok JOIN ent USING (file_id)),
rows AS (
  SELECT head.*, coalesce(pos, 0) AS entry_idx, coalesce(n_rows, 0) AS n_rows, line, flag, linestatus, qty, part
  FROM head LEFT JOIN lines USING (group_id))"""

_FLAT = f"""{_RES}, {_ENT},
ok AS (SELECT * FROM res WHERE success),
head AS (
  SELECT group_id, count(*) AS n_sources, min(file_seq) AS group_seq,
    {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)},
    min(status) = max(status) AS status_consistent, min(priority) = max(priority) AS priority_consistent
  FROM ok GROUP BY group_id),
lines AS (
  SELECT group_id, count(DISTINCT file_id) AS n_files, count(*) AS n_lines, min(file_seq) AS line_seq,
    {', '.join(f'arg_min({k}, (file_seq, entry_idx)) AS {k}' for k in _EKEYS)},
    min(line) = max(line) AS line_consistent, min(qty) = max(qty) AS qty_consistent
  FROM ok JOIN ent USING (file_id) GROUP BY group_id)"""

_VERSIONS = """
versions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS file_id, 'g' || a AS group_id, a AS attempt, o_orderkey AS k,
    ((o_orderkey + a) % 4 <> 0) AS success, (o_orderkey * a) % 6 AS n_fields,
    CASE WHEN (o_orderkey + a) % 4 = 0 THEN 'attempt ' || a || ' failed' END AS error
  FROM orders, (SELECT unnest([1, 2, 3])::INTEGER AS a)
  WHERE a = 1 OR (a = 2 AND o_orderkey % 3 = 0) OR (a = 3 AND o_orderkey % 7 = 0))"""

_RAW_KEYS = """
base AS (
  SELECT p_partkey AS key_id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE p_name END AS base FROM part),
raw AS (
  SELECT key_id, CASE key_id % 8 WHEN 0 THEN base WHEN 1 THEN '1-' || base WHEN 2 THEN '12—' || base || '{'
    WHEN 3 THEN '检验结果4-' || base || '{:' WHEN 4 THEN '血常规-' || base || ','''
    WHEN 5 THEN '基本信息-2-' || base || ' ' WHEN 6 THEN translate(base, 'ABCDEabcde#', 'ＡＢＣＤＥａｂｃｄｅ＃')
    ELSE '　' || base || '　:' END AS raw_key FROM base)"""

_PREFIX = rf"^(?:(?:检验结果|检验)?[0-9]+[-—–]|(?:{'|'.join(SECTION_LABELS)})-)+"
_TAIL = rf"[{{:''\"\,}}{_SI}]+$".replace(r"\"", '"').replace(r"\,", ",")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


ORACLES: dict[str, str] = {
    "group_files": f"WITH {FILES_SQL} SELECT group_id, count(*) AS file_count, min(file_seq) AS group_seq FROM files GROUP BY group_id",
    "group_manifest_merge": f"WITH {FILES_SQL} SELECT group_id, count(DISTINCT file_id) AS file_count, min(file_seq) AS group_seq FROM files GROUP BY group_id",
    "group_manifest_appended": f"""WITH {FILES_SQL} SELECT group_id, count(*) + count(*) FILTER (session_id IN ('en', 'de')) AS file_count
        FROM files GROUP BY group_id""",
    "assign_group": f"""WITH {FILES_SQL} SELECT file_id,
        CASE WHEN file_seq IN (SELECT doc_id FROM labels) THEN group_id ELSE 'group-unknown' END AS group_id FROM files""",
    "fallback_groups": f"""WITH {_RES} SELECT group_id, arg_max(split_part(file_name, '.', 1), file_seq) AS group_key,
        CAST(1 AS BIGINT) AS file_count, min(file_seq) AS group_seq FROM res GROUP BY group_id""",
    "accumulate_group_counts": f"WITH {FILES_SQL} SELECT group_id, count(*) AS file_count, min(file_seq) AS group_seq FROM files GROUP BY group_id",
    "filter_groups": f"""WITH {FILES_SQL} SELECT group_id, count(*) AS file_count FROM files
        WHERE group_id IN (SELECT group_id FROM files JOIN labels ON file_seq = doc_id WHERE toxic = 1) GROUP BY group_id""",
    "batch_numbers": f"""WITH {FILES_SQL}, n AS (SELECT session_id, count(*) AS c FROM files GROUP BY session_id)
        SELECT session_id, file_id, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY file_seq) - 1)
          / CASE WHEN c <= 100 THEN 5 WHEN c <= 200 THEN 8 ELSE 10 END) AS BIGINT) AS batch_no FROM files JOIN n USING (session_id)""",
    "check_limits": """WITH t AS (SELECT count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total,
          CAST(max(octet_length(encode(text))) AS BIGINT) AS largest FROM documents),
        v AS (SELECT 'file_count' AS limit_name, n AS value, CAST(500 AS BIGINT) AS allowed FROM t
          UNION ALL SELECT 'total_bytes', total, 2147483648 FROM t UNION ALL SELECT 'file_bytes', largest, 104857600 FROM t)
        SELECT 'all' AS session_id, * FROM v WHERE value > allowed""",
    "file_verdicts": r"""WITH n AS (SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS f FROM pages),
        e AS (SELECT page_id, lower(split_part(f, '.', -1)) AS ext FROM n)
        SELECT page_id, ext, CASE WHEN ext NOT IN ('txt','md','jpg','jpeg','png','gif','webp') THEN 'unsupported type' END AS reject_reason FROM e""",
    "normalize_keys": f"""WITH {_RAW_KEYS},
        packed AS (SELECT key_id, {_trim('raw_key')} AS trimmed,
          regexp_replace(translate(raw_key, 'ＡＢＣＤＥａｂｃｄｅ＃', 'ABCDEabcde#'), '{_S}+', '', 'g') AS p FROM raw),
        bare AS (SELECT key_id, trimmed, {_trim(f"regexp_replace(regexp_replace(p, '{_PREFIX}', ''), '{_TAIL}', '')")} AS b FROM packed)
        SELECT key_id, CASE WHEN b = '' THEN trimmed ELSE b END AS key FROM bare""",
    "valid_keys": r"""WITH k AS (SELECT p_partkey AS key_id, p_name, CAST(p_partkey AS VARCHAR) AS n,
          CAST(round(p_retailprice * 100) AS BIGINT) // 100 || '.' || lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS cents FROM part),
        raw AS (SELECT key_id, CASE key_id % 12 WHEN 0 THEN cents || 'L/L' WHEN 1 THEN cents || '%{' WHEN 2 THEN cents
          WHEN 3 THEN '16.22.' || (key_id % 256) || '.45' WHEN 4 THEN '2024/01/15' WHEN 5 THEN '08:30' WHEN 6 THEN n
          WHEN 7 THEN p_name[1:1] WHEN 8 THEN 'T' WHEN 9 THEN '↑' WHEN 10 THEN n || 'mmol(' || cents || ')' ELSE p_name END AS k FROM k)
        SELECT key_id, NOT (k = '' OR regexp_matches(k, '^[)*+,\\.><↑→↓\-—]$')
          OR (regexp_matches(k, '^[A-Za-z]$') AND k NOT IN ('T', 'N', 'M')) OR regexp_matches(k, '^[0-9]+$')
          OR regexp_matches(k, '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}') OR regexp_matches(k, '^[0-9]{1,2}:[0-9]{2}')
          OR (regexp_matches(k, '^[0-9]+\.[0-9]+') AND regexp_matches(k, '[a-zA-Z]'))
          OR (regexp_matches(k, '^[0-9]+\.?[0-9]*[a-zA-Z]+') AND regexp_matches(k, '[({]'))
          OR regexp_matches(k, '^[0-9]+\.?[0-9]*%') OR regexp_matches(k, '^[0-9]+\.[0-9]+$')
          OR regexp_matches(k, '^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$')) AS valid FROM raw""",
    "key_checks": f"""WITH {_RAW_KEYS} SELECT key_id, {_trim(f"regexp_replace(raw_key, '{_TAIL}', '')")} AS bare,
        {_trim(f"regexp_replace(':; -' || raw_key, '^[{_SI}:;|，、-]+', '')")} AS led,
        len(string_split(repeat(raw_key || '-', key_id % 7), '-')) > 5 AS joined FROM raw""",
    "to_cells": f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS}
        SELECT file_id, 'header' AS origin, CAST(0 AS BIGINT) AS entry_idx, key_pos, key, value FROM hcells
        UNION ALL SELECT file_id, 'entry', entry_idx, key_pos, key, value FROM ecells JOIN res USING (file_id)""",
    "extraction_summary": f"""WITH {_RES} SELECT count(*) AS total, count(*) FILTER (success) AS succeeded,
        count(*) FILTER (NOT success) AS failed FROM res""",
    "session_progress": f"""WITH {_RES} SELECT session_id, count(*) FILTER (success) AS completed,
        count(*) FILTER (NOT success) AS failed, count(*) AS total FROM res GROUP BY session_id""",
    "header_union": f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS}
        SELECT key, min(file_seq) AS first_file_seq FROM hcells WHERE success GROUP BY key
        UNION ALL SELECT key, min(file_seq) FROM ecells JOIN res USING (file_id) WHERE success GROUP BY key""",
    "key_counts": f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS}
        SELECT key, count(*) AS count FROM hcells WHERE success GROUP BY key
        UNION ALL SELECT key, count(*) FROM ecells JOIN res USING (file_id) WHERE success GROUP BY key""",
    "field_samples": f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS}, c AS (SELECT key, value, file_seq, 0 AS entry_idx FROM hcells
          UNION ALL SELECT key, value, file_seq, entry_idx FROM ecells JOIN res USING (file_id)),
        r AS (SELECT key, value[1:80] AS v, row_number() OVER (PARTITION BY key ORDER BY file_seq, entry_idx) AS n FROM c)
        SELECT key, max(v) FILTER (n = 1) AS sample1, max(v) FILTER (n = 2) AS sample2, max(v) FILTER (n = 3) AS sample3
        FROM r GROUP BY key""",
    "value_preview": f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS} SELECT key, file_name, value FROM hcells
        UNION ALL SELECT key, file_name, value FROM ecells JOIN res USING (file_id)""",
    "preview_file_count": f"WITH {_RES} SELECT count(DISTINCT file_id) AS file_count FROM res",
    "merge_header": f"""WITH {_RES}, {_HCELLS} SELECT group_id, key, arg_min(value, file_seq) AS value,
        min(value) = max(value) AS consistent FROM hcells WHERE success GROUP BY group_id, key""",
    "detect_conflicts": f"""WITH {_RES}, {_HCELLS}, v AS (SELECT group_id, key, value, min(file_seq) AS seen_file_seq
          FROM hcells WHERE success GROUP BY group_id, key, value)
        SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY group_id, key) > 1""",
    "source_files": f"WITH {_RES} SELECT group_id, file_name, min(file_seq) AS seen_file_seq FROM res WHERE success GROUP BY ALL",
    "merge_start": f"WITH {_RES} SELECT group_id, count(*) AS file_count, count(*) FILTER (success) AS success_count FROM res GROUP BY group_id",
    "merge_nested": f"""WITH {_NESTED} SELECT CASE WHEN n_rows > 1 THEN group_id || '-' || entry_idx ELSE group_id END AS row_id,
        group_id, group_seq, entry_idx, CASE WHEN n_rows > 1 THEN group_id || ' #' || (entry_idx + 1) ELSE group_id END AS label,
        n_sources, n_sources > 1 OR n_rows > 1 AS is_merged, 'programmatic' AS merge_method, customer, segment, status, priority,
        line, flag, linestatus, qty, part, status_consistent, priority_consistent, true AS line_consistent FROM rows""",
    "merge_flat": f"""WITH {_FLAT}, objects AS (SELECT group_id, sum(greatest(n, 1)) AS n_objects FROM
          (SELECT group_id, file_id, count(ent.file_id) AS n FROM ok LEFT JOIN ent USING (file_id) GROUP BY ALL) GROUP BY group_id)
        SELECT group_id AS row_id, group_id, group_seq, CAST(0 AS BIGINT) AS entry_idx, group_id AS label, n_sources,
        n_objects > 1 AS is_merged, 'programmatic' AS merge_method, customer, segment, status, priority, line, flag, linestatus, qty, part,
        status_consistent, priority_consistent, line_consistent
        FROM head JOIN objects USING (group_id) LEFT JOIN lines USING (group_id)""",
    "merge_flat_strict": f"""WITH {_FLAT} SELECT group_id AS row_id, group_id, line_seq AS group_seq, CAST(0 AS BIGINT) AS entry_idx,
        group_id AS label, n_files AS n_sources, n_lines > 1 AS is_merged, 'programmatic' AS merge_method,
        line, flag, linestatus, qty, part, line_consistent, qty_consistent FROM lines""",
    "number_rows": f"""WITH {_RES}, {_ENT}, p AS (SELECT file_id, entry_idx, group_id,
          row_number() OVER (PARTITION BY group_id ORDER BY file_seq, entry_idx) - 1 AS i,
          count(*) OVER (PARTITION BY group_id) AS n FROM res JOIN ent USING (file_id))
        SELECT file_id, entry_idx, CASE WHEN n > 1 THEN group_id || '-' || i ELSE group_id END AS row_id,
          CASE WHEN n > 1 THEN group_id || ' #' || (i + 1) ELSE group_id END AS label FROM p""",
    "replace_group_rows": f"""WITH {_RES} SELECT group_id, {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)}
        FROM res WHERE success AND (segment <> 'AUTOMOBILE' OR status <> 'P') GROUP BY group_id""",
    "export_selection": f"""WITH {_RES} SELECT group_id, arg_min(priority, file_seq) AS priority, arg_min(customer, file_seq) AS customer,
        CAST(NULL AS VARCHAR) AS remarks FROM res WHERE success GROUP BY group_id""",
    "preview_rows": f"""WITH {_RES} SELECT group_id, min(file_seq) AS group_seq, {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)}
        FROM res WHERE success GROUP BY group_id ORDER BY group_seq LIMIT 5""",
    "resolve_template": f"""WITH {_RES} SELECT file_id, 'c/customer' AS key, customer AS value FROM res
        UNION ALL SELECT file_id, 'state/status', status FROM res UNION ALL SELECT file_id, 'priority', priority FROM res
        UNION ALL SELECT file_id, 'remarks', NULL FROM res""",
    "resolve_template_cells": f"""WITH {_RES}, {_ENT} SELECT file_id, CAST(0 AS BIGINT) AS entry_idx, 'c/customer' AS key, customer AS value FROM res
        UNION ALL SELECT file_id, 0, 'state/status', status FROM res UNION ALL SELECT file_id, 0, 'priority', priority FROM res
        UNION ALL SELECT file_id, entry_idx, 'amount/qty', qty FROM ent JOIN res USING (file_id)""",
    "template_mismatch": f"""WITH {_RES} SELECT file_id, CASE WHEN success THEN 'segment,priority' ELSE '' END AS extra,
        CASE WHEN success THEN 'remarks' ELSE '' END AS missing, NOT success AS matched FROM res""",
    "infer_template": """WITH f AS (SELECT arg_min(p_name, p_partkey) AS p_name, arg_min(p_brand, p_partkey) AS p_brand,
          arg_min(p_type, p_partkey) AS p_type, CAST(arg_min(p_size, p_partkey) AS VARCHAR) AS p_size,
          CAST(arg_min(p_retailprice, p_partkey) AS VARCHAR) AS p_retailprice FROM part)
        SELECT 0 AS pos, 'p_name' AS key, 'string' AS type, p_name AS example FROM f
        UNION ALL SELECT 1, 'p_brand', 'string', p_brand FROM f UNION ALL SELECT 2, 'p_type', 'string', p_type FROM f
        UNION ALL SELECT 3, 'p_size', 'number', p_size FROM f UNION ALL SELECT 4, 'p_retailprice', 'number', p_retailprice FROM f""",
    "pivot_wide": f"""WITH {_NESTED}, f AS (SELECT group_id, flag, linestatus, arg_min(qty, entry_idx) AS qty, arg_min(part, entry_idx) AS part
          FROM rows GROUP BY ALL)
        SELECT h.group_id, h.group_seq, h.group_id AS _label, h.customer, h.segment, h.status, h.priority,
        {', '.join(f"max({v}) FILTER (flag = '{a}' AND linestatus = '{b}') AS " + f'"{a}_{b}_{v}"' for a in 'ANR' for b in 'FO' for v in ('qty', 'part'))}
        FROM head h JOIN f USING (group_id) GROUP BY ALL""",
    "pivot_cells": f"""WITH {_NESTED},
        p1 AS (SELECT group_id, coalesce(flag, '') AS f, coalesce(linestatus, '') AS s, min(entry_idx) AS i FROM rows GROUP BY ALL),
        p2 AS (SELECT group_id, coalesce(line, '') AS l, min(entry_idx) AS i FROM rows GROUP BY ALL),
        w AS (SELECT p1.group_id, 0 AS preset, CASE WHEN f = '' THEN '' ELSE f || '_' END || CASE WHEN s = '' THEN '(empty)' ELSE s END AS n, p1.i, qty, part
          FROM p1 JOIN rows ON p1.group_id = rows.group_id AND p1.i = rows.entry_idx),
        c AS (SELECT group_id, preset, i, n || '_qty' AS name, qty AS value FROM w
          UNION ALL SELECT group_id, preset, i, n || '_part', part FROM w
          UNION ALL SELECT p2.group_id, 1, p2.i, CASE WHEN l = '' THEN '(empty)' ELSE l END || '_qty', qty
          FROM p2 JOIN rows ON p2.group_id = rows.group_id AND p2.i = rows.entry_idx)
        SELECT group_id, name, value FROM c QUALIFY row_number() OVER (PARTITION BY group_id, name ORDER BY preset DESC, i DESC) = 1""",
    "pivot_column_names": f"""WITH {_NESTED} SELECT DISTINCT CASE WHEN flag IS NULL THEN '(empty)' ELSE flag || '_' || linestatus END || v AS name
        FROM rows, (SELECT unnest(['_qty', '_part']) AS v)""",
    "flatten_dot": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "flatten_hyphen": """SELECT o_orderkey, 'state-code' AS key, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'state-more-level', o_orderpriority FROM orders
        UNION ALL SELECT o_orderkey, 'ids', o_orderkey || '; ' || o_custkey FROM orders
        UNION ALL SELECT o_orderkey, 'even', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 2 = 0""",
    "flatten_dotted": """SELECT o_orderkey, 'state.code' AS key, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'state.more.level', o_orderpriority FROM orders
        UNION ALL SELECT o_orderkey, 'ids', '[' || o_orderkey || ',' || o_custkey || ']' FROM orders
        UNION ALL SELECT o_orderkey, 'even', CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END FROM orders""",
    "flatten_preview": """SELECT o_orderkey, 'dose' AS key, o_custkey || ' ' || o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'more.level', o_orderpriority FROM orders""",
    "needs_flatten": """SELECT o_orderkey, true AS nested FROM orders UNION ALL SELECT -o_orderkey - 1, false FROM orders""",
    "sheet_rows": """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS "meta.deep.kind", CAST(n AS VARCHAR) AS "parts.n", name AS "parts.name",
        event_type || ', x' AS tags FROM (SELECT event_id, event_type, 'user' AS name, user_id AS n FROM events
          UNION ALL SELECT event_id, event_type, 'event', event_id FROM events)""",
    "latest_results": f"WITH {_VERSIONS} SELECT file_id, attempt, success FROM versions QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY attempt DESC) = 1",
    "best_results": f"""WITH {_VERSIONS} SELECT file_id, attempt, success, n_fields FROM versions QUALIFY row_number() OVER
        (PARTITION BY file_id ORDER BY success DESC, CASE WHEN success THEN n_fields ELSE 0 END DESC, attempt) = 1""",
    "pending_files": f"WITH {FILES_SQL} SELECT file_id, file_name FROM files WHERE file_seq NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "inherit_group": f"""WITH {_RES}, {_VERSIONS}, last AS (SELECT file_id, arg_max(group_id, attempt) AS g FROM versions WHERE attempt > 1 GROUP BY file_id)
        SELECT file_id, coalesce(g, group_id) AS group_id FROM res LEFT JOIN last USING (file_id)""",
    "resume_plan": f"""WITH {FILES_SQL}, s AS (SELECT file_id, file_seq IN (SELECT doc_id FROM labels) AS kept FROM files)
        SELECT file_id, CASE WHEN kept THEN 'work' ELSE 'gone' END AS state,
        CASE WHEN NOT kept THEN 'source file is no longer available' END AS error FROM s""",
    "overlay_retry": f"""WITH {_VERSIONS}, a AS (SELECT * FROM versions WHERE attempt = 1), b AS (SELECT * FROM versions WHERE attempt = 2)
        SELECT a.file_id, a.group_id, CASE WHEN b.success THEN b.attempt ELSE a.attempt END AS attempt,
        coalesce(b.success, false) OR a.success AS success, CASE WHEN b.success THEN b.n_fields ELSE a.n_fields END AS n_fields,
        CASE WHEN b.file_id IS NULL THEN a.error ELSE b.error END AS error FROM a LEFT JOIN b USING (file_id)""",
    "all_results": f"WITH {_VERSIONS} SELECT file_id, attempt, CASE WHEN attempt > 1 THEN error END AS error FROM versions WHERE NOT success",
    "expire_sessions": """SELECT o_custkey AS session_id, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey
        HAVING min(o_orderdate) >= TIMESTAMP '1995-06-02 00:00:00' - INTERVAL 180 DAY""",
    "session_latest": """SELECT o_orderkey AS session_id, 'extracting' AS status, o_orderdate AS created_at FROM orders
        WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""",
    "csv_escape": r"""WITH g AS (SELECT doc_id, lang, '''-' || n_chars AS signed,
          CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END AS t FROM documents)
        SELECT doc_id, lang || ',' || signed || ',' || CASE WHEN regexp_matches(t, '[,"\n\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS line FROM g""",
    "infer_types": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' ELSE 'string' END AS type FROM part""",
    "normalize_values": """SELECT o_orderkey, 'dose' AS key, o_custkey || ' mg' AS value, o_custkey || ' mg' AS shown FROM orders
        UNION ALL SELECT o_orderkey, 'list', o_orderstatus || '; ' || o_orderpriority, o_orderstatus || ', , ' || o_orderpriority FROM orders
        UNION ALL SELECT o_orderkey, 'other', '{"z":' || o_orderkey || ',"a":"b"}', '[object Object]' FROM orders
        UNION ALL SELECT o_orderkey, 'flag', CAST(o_orderkey % 2 = 0 AS VARCHAR), CAST(o_orderkey % 2 = 0 AS VARCHAR) FROM orders""",
    "data_urls": "SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url, length(text) > 0 AS valid FROM documents",
    "private_hosts": """SELECT page_id, false AS private FROM pages UNION ALL SELECT -page_id - 1, true FROM pages""",
    "parse_response": """SELECT CAST(o_orderkey AS VARCHAR) AS file_id,
        CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE 0 END AS layer,
        CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3, 5) THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3, 5) THEN o_orderpriority END AS priority FROM orders""",
    "validate_flat": """SELECT o_orderkey, CAST(NULL AS VARCHAR) AS reject_reason, o_orderstatus AS code, o_orderpriority AS level,
        o_orderkey || '; ' || o_custkey AS ids, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS even FROM orders""",
    "validate_schema_guided": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_entries' END AS reject_reason,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN o_orderstatus END AS status,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(2 AS BIGINT) END AS n_entries,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS line, CAST(NULL AS VARCHAR) AS junk FROM orders""",
    "entries_from_response": """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS n_entries,
        CASE WHEN o_orderkey % 4 <> 3 THEN o_orderstatus END AS status,
        CAST(CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS BIGINT) AS n_conflicts,
        CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderstatus || '|' || o_orderpriority END AS conflict_values FROM orders""",
    "merge_prompt": f"""WITH {_RES}, p AS (SELECT * FROM res WHERE success)
        SELECT group_id, count(*) AS n_files, '[' || chr(10) || string_agg('{{"file_name":"' || file_name || '","extracted_data":{{"customer":"' || customer
          || '","segment":"' || segment || '","status":"' || status || '","priority":"' || priority || '"}}}}', ',' || chr(10) ORDER BY file_seq)
          || chr(10) || ']' AS files FROM p GROUP BY group_id""",
    "conversation_prompts": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS g,
          length('{"file_name":' || CAST(to_json(role) AS VARCHAR) || ',"extracted_data":' || CAST(json_object('text', text) AS VARCHAR) || '}') AS n FROM conversations)
        SELECT g AS group_id, count(*) AS n_files,
          CAST(sum(n) + 2 * (count(*) - 1) + length('Group ' || CAST(to_json(g) AS VARCHAR) || ':' || chr(10) || '[' || chr(10) || chr(10) || ']') AS BIGINT) AS chars
        FROM t GROUP BY g""",
    "extraction_prompt_sizes": f"""WITH {FILES_SQL} SELECT file_id, md5(CASE WHEN coalesce(text, '') = '' THEN '{NO_TEXT_REQUEST}'
          ELSE replace('{TEXT_PREFIX.replace(chr(10), "~")}', '~', chr(10)) || text END) AS prompt_md5,
        CAST({len(system_prompt(ORDER_TEMPLATE))} AS BIGINT) AS system_chars, length(text) AS text_chars FROM files""",
    "extract_documents": f"""WITH {FILES_SQL} SELECT file_id, group_id, true AS success, CAST(length(text) AS VARCHAR) AS chars,
        CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS VARCHAR) AS lines, 1 AS attempt FROM files""",
    "merge_groups_with_model": f"""WITH {_RES} SELECT group_id, CAST(0 AS BIGINT) AS entry_idx,
        {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)}, CASE WHEN count(*) > 1 THEN 'ai' ELSE 'single' END AS merge_method
        FROM res WHERE success GROUP BY group_id""",
    "merge_groups_refused": f"""WITH {_RES}, g AS (SELECT group_id, count(*) AS n, arg_min(status, file_seq) AS s, arg_min(priority, file_seq) AS p
          FROM res WHERE success GROUP BY group_id)
        SELECT group_id, CASE WHEN n > 1 AND s = 'P' THEN NULL ELSE s END AS status, CASE WHEN n = 1 THEN p END AS priority,
          CASE WHEN n > 1 AND s <> 'P' THEN 'priority' ELSE '' END AS lost,
          CASE WHEN n = 1 THEN 'single' WHEN s = 'P' THEN 'error' ELSE 'ai' END AS merge_method, n > 1 AND s = 'P' AS failed FROM g""",
    "run_report": """SELECT event_type AS event, count(*) AS n_events, count(*) FILTER (json_extract_string(props, '$.success') = 'true') AS n_success,
          count(*) FILTER (event_type = 'error' OR json_extract_string(props, '$.success') = 'false') AS n_failed,
          CAST(coalesce(sum(len(json_keys(props, '$.data'))), 0) AS BIGINT) AS n_fields, CAST(coalesce(sum(json_array_length(props, '$.conflicts')), 0) AS BIGINT) AS n_conflicts
        FROM events GROUP BY event_type""",
    "progress_eta": """SELECT user_id AS session_id, avg(event_id) AS mean_ms, greatest(1000 - count(*), 0) AS remaining,
        avg(event_id) * greatest(1000 - count(*), 0) AS eta_ms FROM events GROUP BY user_id""",
    "stream_progress": "SELECT event_type AS event, count(*) AS count FROM events GROUP BY event_type",
    "stream_group_counts": "SELECT source || 'x' AS group_id, count(*) AS file_count FROM documents GROUP BY source",
    "stream_dedup": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS file_id FROM orders",
}


# Answers of the stand-in models, by the length of the prompt.
PROMPT_CHARS_SQL = f"CASE WHEN coalesce(text, '') = '' THEN {len(NO_TEXT_REQUEST)} ELSE {len(TEXT_PREFIX)} + length(text) END"
_PROMPT = f"{FILES_SQL}, p AS (SELECT *, {PROMPT_CHARS_SQL} AS n FROM files)"
ORACLES |= {
    "messy_cells": """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS file_id, * FROM orders)
        SELECT file_id, '状态' AS key, o_orderstatus AS value FROM o WHERE o_orderkey % 3 = 2
        UNION ALL SELECT file_id, 'priority', o_orderpriority FROM o
        UNION ALL SELECT file_id, 'twice', CASE WHEN o_orderkey % 2 = 0 THEN '{"k":1,"k":2}' ELSE 'once' END FROM o
        UNION ALL SELECT file_id, 'list', o_orderkey || '; ' || o_orderstatus FROM o""",
    "messy_merge": """WITH o AS (SELECT *, CASE WHEN year(o_orderdate) <> 1995 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'group-unknown' END AS group_id FROM orders)
        SELECT group_id, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 = 2) AS state, arg_min(o_orderpriority, o_orderkey) AS priority,
          min(o_orderstatus) FILTER (o_orderkey % 3 = 2) = max(o_orderstatus) FILTER (o_orderkey % 3 = 2) AS consistent, count(*) AS n_sources FROM o GROUP BY group_id""",
    "field_counts": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 + 1 AS n FROM orders)
        SELECT k AS o_orderkey, CASE WHEN k % 2 = 0 THEN 3 WHEN k % 3 <> 0 THEN n ELSE 0 END AS n_fields,
          CASE WHEN k % 5 = 0 THEN '—' WHEN k % 2 = 0 THEN '3' WHEN k % 3 <> 0 THEN n || '×2' ELSE '—' END AS label FROM o""",
    "repaired_names": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '检验 ' || p_name ELSE p_name || ' é' END AS name FROM part",
    "chosen_rows": f"""WITH {_RES} SELECT group_id AS row_id, arg_min(customer, file_seq) AS "Kunde", arg_min(segment, file_seq) AS segment, arg_min(status, file_seq) AS "Stand",
        arg_min(priority, file_seq) AS priority FROM res WHERE success GROUP BY group_id HAVING arg_min(segment, file_seq) = 'BUILDING'""",
    "declared_columns": """WITH r AS (SELECT p_partkey AS pos, p_brand AS key, CASE p_partkey % 5 WHEN 1 THEN 'number' ELSE 'string' END AS type, p_name AS description
          FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0)
        SELECT key, arg_min(type, pos) AS type, arg_min(description, pos) AS description FROM r GROUP BY key""",
    "align_with_model": f"""WITH {_RES}, g AS (SELECT group_id, count(*) AS n, arg_min(status, file_seq) AS s, arg_min(customer, file_seq) AS c FROM res WHERE success GROUP BY group_id)
        SELECT group_id, CASE WHEN n = 1 OR s <> 'P' THEN c END AS buyer, CASE WHEN n = 1 OR s <> 'P' THEN s END AS state, CASE WHEN n = 1 OR s <> 'P' THEN 2 END AS attempt,
          CASE WHEN n = 1 OR s <> 'P' THEN 'ai' ELSE 'error' END AS merge_method, n > 1 AND s = 'P' AS failed FROM g""",
    "align_prompt": f"""WITH {_RES}, g AS (SELECT group_id, {', '.join(f'arg_min({k}, file_seq) AS {k}' for k in _HKEYS)} FROM res WHERE success GROUP BY group_id)
        SELECT group_id, md5('Group "' || group_id || '":' || chr(10) || '[{{"customer":"' || customer || '","segment":"' || segment || '","status":"' || status || '","priority":"' || priority
          || '"}}]' || chr(10) || chr(10) || 'Columns:' || chr(10) || '- buyer (who buys)' || chr(10) || '- state') AS prompt_md5 FROM g""",
    "extract_retried": f"""WITH {_PROMPT} SELECT file_id, true AS success, CAST(length(text) AS VARCHAR) AS chars, CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END AS attempt,
        CAST(NULL AS VARCHAR) AS error FROM p""",
    "extract_fallback": f"""WITH {_PROMPT} SELECT file_id, n % 3 <> 0 AS success, CASE WHEN n % 3 <> 0 THEN CAST(length(text) AS VARCHAR) END AS chars, 3 AS attempt,
        n % 3 = 0 AS failed FROM p""",
}
ORACLES["stream_file_status"] = """SELECT CAST(user_id AS VARCHAR) AS file_id, arg_max(event_type, (ts, event_type)) AS status, count(*) AS n_events,
    count(*) FILTER (event_type = 'file_retry') AS n_retries FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
ORACLES["stream_versions"] = "SELECT CAST(doc_id AS VARCHAR) AS file_id, true AS success, CAST(length(text) AS VARCHAR) AS chars FROM documents"
ORACLES["reject_reasons"] = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'no_json' WHEN 1 THEN 'empty' WHEN 2 THEN 'too_few_fields' WHEN 3 THEN 'joined_header_keys'
      WHEN 5 THEN 'too_few_fields' END AS reject_reason,
    CASE o_orderkey % 6 WHEN 4 THEN '{"box-a-b":' || o_orderkey || ',"box-c":"1; 2"}' END AS data_json FROM orders"""
ORACLES["reject_reasons_guided"] = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no_json' WHEN 1 THEN 'no_entries' WHEN 2 THEN 'all_null' WHEN 3 THEN 'all_null' END AS reject_reason,
    CASE o_orderkey % 5 WHEN 4 THEN '{"status":"' || o_orderstatus || '"}' END AS header_json, CASE o_orderkey % 5 WHEN 4 THEN '{"line":1}|{"line":null}' END AS entries FROM orders"""
ORACLES["template_prompt"] = f"""WITH {_RES}, {_ENT}, {_HCELLS}, {_ECELLS}, c AS (SELECT key, value, file_seq, 0 AS entry_idx FROM hcells
      UNION ALL SELECT key, value, file_seq, entry_idx FROM ecells JOIN res USING (file_id)),
    r AS (SELECT key, value[1:80] AS v, row_number() OVER (PARTITION BY key ORDER BY file_seq, entry_idx) AS n FROM c),
    l AS (SELECT '- ' || key || ': ' || string_agg(v, ' | ' ORDER BY n) AS line FROM r WHERE n <= 3 GROUP BY key)
    SELECT 'Fields:' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS user_prompt FROM l"""
ORACLES["template_from_answers"] = """SELECT DISTINCT p_brand AS key, 'string' AS type FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 4 <> 0"""
_SPELLED = f"""WITH {_RES} SELECT group_id, arg_min(status, file_seq) AS status, arg_min(customer, file_seq) AS customer, min(status) = max(status) AS consistent,
    NULL AS "bare", count(DISTINCT file_name) AS n_sources FROM res WHERE success GROUP BY group_id"""
ORACLES["merge_nested_spelled"] = ORACLES["merge_flat_spelled"] = _SPELLED
# Merging in parts gives the records of merging at once.
ORACLES["merge_groups_in_parts"] = ORACLES["merge_groups_with_model"]


def oracle_sql() -> dict[str, str]:
    from docmerge import flow_queries

    return ORACLES | flow_queries.oracle_sql()
