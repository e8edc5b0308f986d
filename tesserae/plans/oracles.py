"""DuckDB SQL for the queries of ``catalogue``; the same constants, written out as SQL needs them."""

from __future__ import annotations

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def words(t: str = "text") -> str:
    return f"list_filter(string_split_regex({t}, '{SPACE}+'), lambda w: w <> '')"


def strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def lines(t: str = "text") -> str:
    parts = f"string_split_regex({t}, '{LINE}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def alnum(t: str = "text") -> str:
    return rf"length(regexp_replace({t}, '[^\p{{L}}\p{{N}}]', '', 'g'))"


def draw(key: str, label: str) -> str:
    return f"('0x' || left(md5({key}::VARCHAR || ':{label}'), 8))::BIGINT"


GATE = f"(len({lines()}) >= 2 AND length(text) >= 30 AND {alnum()} / greatest(length(text), 1) >= 0.25)"
EXACT = f"md5(array_to_string({words()}, ' '))"
AUDIT = """
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS samples, coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum(tokens), 0)::BIGINT AS tokens
FROM (SELECT source, length(text) AS chars, len({w}) + 1 AS tokens FROM {rows}) GROUP BY ROLLUP (source)"""
SIGNED = f"""
SELECT doc_id, source, array_to_string(w, ' ') AS whole, md5(array_to_string(w, ' ')) AS exact,
       CASE WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))] ELSE [
         left(md5(array_to_string([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3, 2)], ' ')), 16),
         left(md5(array_to_string([array_to_string(w[i:i+4], ' ') for i in range(2, len(w) - 3, 2)], ' ')), 16)] END AS bands
FROM (SELECT doc_id, source, {words()} AS w FROM documents)"""
#: A row goes if an earlier one shares a key; on these tables that keeps the rows that the sequential pass keeps.
NEAR = f"""
WITH s AS ({SIGNED}), k AS (SELECT doc_id, unnest(list_distinct([exact] || bands)) AS key FROM s),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS least FROM k)
SELECT doc_id FROM f GROUP BY doc_id HAVING bool_and(least = doc_id)"""
TURNS = """(SELECT a.conv_id, a.text AS a, b.text AS b FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 WHERE a.turn = 0)"""
IDS = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: ('0x' || left(md5(w), 8))::BIGINT % 31990 + 10) || [0::BIGINT]"
STREAM = f"""stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM (
  SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM (SELECT doc_id, {IDS} AS ids FROM documents)))"""
PACKED = f"""{STREAM}, packed AS (SELECT pos // 256 AS chunk, list(id ORDER BY pos) AS tokens FROM stream GROUP BY 1 HAVING count(*) = 256)"""
LOSSES = "(SELECT event_id, value / 100 AS loss, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)"
CHECKPOINTS = """(SELECT 'checkpoint_step_' || s || '.pt' AS name, (2800000000 + s)::BIGINT AS size FROM range(50000, 75001, 1000) r(s)
  UNION ALL SELECT * FROM (VALUES ('latest_checkpoint.pt', 5::BIGINT), ('checkpoint_step_x.pt', 6), ('notes.txt', 7), ('checkpoint_chunk1.pt', 8)))"""
PLAN = rf"""(SELECT name, size, step, CASE WHEN name IN ('latest_checkpoint.pt', 'checkpoint_chunk1.pt') THEN 'keep'
  WHEN NOT (starts_with(name, 'checkpoint_step_') AND ends_with(name, '.pt')) THEN 'ignore' WHEN step IS NULL THEN 'skip'
  WHEN step IN (55000, 61000, 67000, 73000) OR step >= 67000 THEN 'keep' ELSE 'delete' END AS action
  FROM (SELECT *, try_cast(regexp_extract(name, '^checkpoint_step_(.*)\.pt$', 1) AS BIGINT) AS step FROM {CHECKPOINTS}))"""
HF = "h" + "f_"
TOKEN = f"' {HF}' || md5(doc_id::VARCHAR) || ' '"
PLANTED = f"""(SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN {TOKEN} || 'again' || {TOKEN} ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' {HF}{"x" * 32} ' ELSE '' END AS text FROM documents)"""
FIM_N = f"len({lines()})"
MODELS = "(VALUES ('250M', 32000, 1024, 16, 16, 4, 2816), ('500M', 32000, 1280, 26, 16, 4, 3584), ('1B', 32000, 1536, 38, 16, 4, 4096)) m(name, v, h, l, a, k, f)"

SQL: dict[str, str] = {
    "flagship_audit": f"WITH g AS (SELECT *, min(doc_id) OVER (PARTITION BY {EXACT}) AS first FROM documents WHERE {GATE}), kept AS (SELECT * FROM g WHERE doc_id = first) "
    + AUDIT.format(w=words(), rows="kept"),
    "text_stats": f"SELECT doc_id, length(text) AS chars, len({words()})::BIGINT AS words, len({lines()})::BIGINT AS lines, {alnum()}::BIGINT AS alnum FROM documents",
    "quality_gate": f"SELECT doc_id FROM documents WHERE {GATE}",
    "quality_attrition": f"SELECT source, count(*) AS total, count(*) FILTER ({GATE}) AS kept FROM documents GROUP BY source",
    "bracket_balance": r"""
SELECT doc_id, o = '' OR list_reduce([''] || list_filter(string_split(o, ''), lambda c: c <> ''), lambda s, c: CASE WHEN s = '!' THEN s WHEN c IN ('(', '[', '{') THEN c || s
  WHEN left(s, 1) = CASE c WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{' END THEN substr(s, 2) ELSE '!' END) = '' AS balanced
FROM (SELECT doc_id, regexp_replace(text, '[^(){}\[\]]', '', 'g') AS o FROM documents)""",
    "code_route": "SELECT source, bool_or(regexp_matches(source, 'starcoder|codeparrot|python|stack')) AS pure_code, count(*) AS n FROM (SELECT CASE WHEN ends_with(source, '1') THEN 'python-' || source ELSE source END AS source FROM documents) GROUP BY source",
    "dedup_signatures": f"SELECT doc_id, exact, array_to_string(bands, ',') AS bands FROM ({SIGNED})",
    "dedup_exact": f"SELECT {EXACT} AS exact, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "dedup_near": NEAR,
    "dedup_attrition": f"SELECT d.source, count(*) AS total, count(n.doc_id) AS kept FROM documents d LEFT JOIN ({NEAR}) n ON d.doc_id = n.doc_id GROUP BY 1",
    "source_budget": "SELECT n AS source, floor(2350000000 * 4 * w::DOUBLE)::BIGINT AS budget_chars FROM (VALUES ('starcoder-python', 0.53), ('codeparrot-clean', 0.21), ('fineweb-edu', 0.10), ('tiny-textbooks', 0.075), ('evol-codealpaca', 0.05), ('glaive-function-calling', 0.025), ('commitpackft-python', 0.01)) t(n, w)",
    "source_registry": """SELECT n AS name, coalesce(r, 'codeparrot/codeparrot-clean-train') AS repository, s AS subset, coalesce(f, 'content') AS format FROM (VALUES ('starcoder-python', 'bigcode/starcoderdata', 'python', 'content'),
 ('codeparrot-clean', 'codeparrot/codeparrot-clean-train', NULL, 'content'), ('fineweb-edu', NULL, NULL, NULL), ('tiny-textbooks', 'nampdn-ai/tiny-textbooks', NULL, 'text'), ('evol-codealpaca', 'theblackcat102/evol-codealpaca-v1', NULL, 'instruction_output'),
 ('glaive-function-calling', 'glaiveai/glaive-function-calling-v2', NULL, 'system_and_chat'), ('commitpackft-python', 'bigcode/commitpackft', 'python', 'diff')) t(n, r, s, f)""",
    "budgeted_prefix": """
WITH b AS (SELECT source, sum(length(text)) // 2 AS budget FROM documents GROUP BY source), r AS (
  SELECT doc_id, source, length(text) AS n, row_number() OVER w AS nth,
         coalesce(sum(CASE WHEN length(text) > 20 THEN length(text) ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, source, chars_before FROM r JOIN b USING (source) WHERE n > 20 AND (chars_before < budget OR nth = 1)""",
    "acquired_volume": "SELECT source, sum(length(text))::BIGINT AS chars, (sum(length(text)) // 4)::BIGINT AS approx_tokens FROM documents GROUP BY source",
    "format_chat": f"SELECT conv_id, {strip("coalesce(a, 'None') || chr(10) || chr(10) || coalesce(b, 'None')")} AS text FROM {TURNS}",
    "format_instruction": f"SELECT conv_id, {strip("'### Instruction:' || chr(10) || coalesce(a, 'None') || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(b, 'None')")} AS text FROM {TURNS}",
    "format_diff": f"SELECT conv_id, {strip("'<|fim_prefix|>' || coalesce(nullif(a, ''), '') || '<|fim_middle|>' || coalesce(nullif(b, ''), '')")} AS text FROM {TURNS}",
    "format_problem": f"SELECT conv_id, {strip("'### Problem:' || chr(10) || coalesce(a, 'None') || chr(10) || chr(10) || '### Solution:' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '[]' ELSE coalesce(b, 'None') END")} AS text FROM {TURNS}",
    "format_content": f"SELECT conv_id, coalesce(nullif(b, ''), '') AS text FROM {TURNS}",
    "infill_prompt": f"SELECT conv_id, '<|fim_prefix|>' || a || '<|fim_suffix|>' || b || '<|fim_middle|>' AS text FROM {TURNS} WHERE b IS NOT NULL",
    "eval_text": f"SELECT conv_id, a || chr(10) || b AS text FROM {TURNS} WHERE length(a || chr(10) || b) > 20",
    "decode_records": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '[1, 2] ' || chr(10) || ' ' || lang ELSE '' END AS text FROM documents",
    "jsonl_round_trip": "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source",
    "fim_transform": f"""
WITH d AS (SELECT doc_id, text, {lines()} AS l FROM documents), s AS (
  SELECT *, len(l) AS n, {draw('doc_id', 'fim:0')} < 2147483648 AND length(text) >= 50 AND len(l) >= 3 AS cut FROM d), a AS (
  SELECT *, CASE WHEN cut THEN 1 + {draw('doc_id', 'fim:1')} % (n - 2) END AS p FROM s), b AS (
  SELECT *, CASE WHEN cut THEN p + 1 + {draw('doc_id', 'fim:2')} % (n - 1 - p) END AS q FROM a)
SELECT doc_id, CASE WHEN cut THEN '<|fim_prefix|>' || array_to_string(l[1:p], chr(10)) || '<|fim_suffix|>' || array_to_string(l[q+1:n], chr(10)) || '<|fim_middle|>' || array_to_string(l[p+1:q], chr(10)) ELSE text END AS text FROM b""",
    "letter_run_counts": r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{L}+')) AS token FROM documents) GROUP BY token",
    "pack_sequences": f"WITH {PACKED} SELECT chunk, chunk // 100 + 1 AS shard, md5(array_to_string(tokens, ',')) AS digest FROM packed",
    "pack_overlapping": f"""WITH {STREAM}, n AS (SELECT count(*) AS n FROM stream), c AS (SELECT unnest(range((n - 1) // 256)) AS chunk FROM n)
SELECT chunk, md5(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos < (chunk + 1) * 256)) AS x, md5(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos > chunk * 256)) AS y
FROM c JOIN stream ON pos BETWEEN chunk * 256 AND (chunk + 1) * 256 GROUP BY chunk""",
    "next_token_pairs": f"WITH {PACKED} SELECT chunk, 255::BIGINT AS n, list_sum([abs(tokens[i+1] - tokens[i]) for i in range(1, 256)])::BIGINT AS moved FROM packed",
    "shard_round_trip": f"WITH {PACKED} SELECT chunk // 100 + 1 AS shard, count(*) AS sequences FROM packed GROUP BY 1",
    "corpus_audit": AUDIT.format(w=words(), rows="documents"),
    "epoch_arithmetic": f"SELECT source, round(32768000.0::DOUBLE / greatest(tokens, 1), 6) AS epochs FROM ({AUDIT.format(w=words(), rows='documents')})",
    "batch_losses": f"SELECT count(*) AS batches, round(avg(m), 9) AS loss FROM (SELECT avg(loss) AS m FROM {LOSSES} GROUP BY i // 16)",
    "step_losses": f"SELECT i // 16 AS step, round(avg(loss), 9) AS loss FROM {LOSSES} GROUP BY 1",
    "perplexity_gap": f"""WITH m AS (SELECT i % 2 AS held, avg(loss) AS m FROM {LOSSES} GROUP BY 1, (i // 2) // 16), l AS (SELECT avg(m) FILTER (held = 0) AS t, avg(m) FILTER (held = 1) AS v FROM m)
SELECT round(exp(t), 6) AS train_ppl, round(exp(least(v, 20.0)), 6) AS val_ppl, round(v - t, 9) AS gap FROM l""",
    "held_out_rows": f'SELECT event_id, i AS "index" FROM {LOSSES} WHERE i >= 499',
    "second_half": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r >= n // 2",
    "seeded_shuffle": "SELECT doc_id, md5('7:' || doc_id::VARCHAR) AS place FROM documents ORDER BY place LIMIT 100",
    "epoch_cycle": "SELECT s AS step, s // 62 AS epoch, s % 62 * 16 AS position FROM range(1000) r(s)",
    "lr_schedule": "SELECT s AS step, round(CASE WHEN s < 500 THEN 0.0006::DOUBLE * s / 500 WHEN s >= 4482 THEN 0.00006::DOUBLE ELSE 0.00006::DOUBLE + 0.00027::DOUBLE * (1 + cos(pi() * (s - 500) / 3982.0::DOUBLE)) END, 12) AS lr FROM range(5001) r(s)",
    "model_sizes": f"""SELECT name, p AS parameters, 6.0::DOUBLE * p * 256 * 2048 AS flops, round(1 / sqrt(2.0::DOUBLE * l), 9) AS scale, 524288::BIGINT AS tokens_per_step, 2349858816::BIGINT AS total_tokens
FROM (SELECT *, (v::BIGINT * h * 2 + l * (2 * h * a * (h // a) + 2 * h * k * (h // a) + 3 * h * f + 2 * h) + h)::BIGINT AS p FROM {MODELS})""",
    "run_costs": """SELECT device, round(h, 6) AS hours, round(h * rate, 6) AS cost, round(t * 0.5, 6) AS throughput FROM (SELECT *, 2349858816::DOUBLE / t / 3600 AS h FROM
 (SELECT d AS device, r::DOUBLE AS rate, t::DOUBLE AS t FROM (VALUES ('T4', 0.55, 6685.0::DOUBLE), ('L40S', 2.89, 151e6 / 3600), ('PRO 6000', 4.64, 300e6 / 3600), ('PRO 6000 spot', 2.05, 300e6 / 3600)) v(d, r, t)))""",
    "rope_angles": "SELECT p AS position, i, round(cos(p * pow(10000.0::DOUBLE, -2.0::DOUBLE * i / 64)), 9) AS cos, round(sin(p * pow(10000.0::DOUBLE, -2.0::DOUBLE * i / 64)), 9) AS sin FROM range(128) a(p), range(32) b(i)",
    "rms_norm": """SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / r) * (x / r))), 6) AS power, round(e[4] / r, 6) AS fourth
FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e) + 1e-6::DOUBLE) AS r FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
    "softmax_tokens": """SELECT vec_id, round(1 / list_sum(list_transform(e, lambda x: exp(x / 0.2::DOUBLE - m / 0.2::DOUBLE))), 6) AS top, list_position(e, m)::BIGINT - 1 AS token,
 round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - e[6], 6) AS loss FROM (SELECT *, list_max(e) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
    "retention_plan": f"SELECT * FROM {PLAN}",
    "retention_totals": f"SELECT count(*) FILTER (action = 'delete') AS deleted, round(sum(size) FILTER (action = 'delete') / 1073741824.0::DOUBLE, 6) AS freed_gib FROM {PLAN}",
    "save_cadence": "SELECT s AS step, s % 5 = 0 OR s = 1 AS logs, s % 100 = 0 OR s = 4482 AS saves, s % 1000 = 0 AS uploads FROM range(1, 4483) r(s)",
    "save_triggers": "SELECT event_id, (event_id > 0 AND event_id % 100 = 0) OR value >= 200 AS saves FROM events",
    "credential_scan": f"SELECT doc_id, (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + coalesce(len(list_distinct(regexp_extract_all(text, 'AKIA[0-9A-Z]{{16}}'))), 0))::BIGINT AS leaks, "
    f"array_to_string(list_concat(CASE WHEN doc_id % 7 = 0 THEN ['{HF}' || left(md5(doc_id::VARCHAR), 3) || '...' || right(md5(doc_id::VARCHAR), 4)] ELSE [] END, "
    "list_transform(list_distinct(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')), lambda m: left(m, 6) || '...' || right(m, 4))), ',') AS masked FROM documents",
    "credential_redact": rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '{HF}[a-f0-9]{{32}}', 'os.environ.get("HF_TOKEN", "<REDACTED_SECRET>")', 'g'), 'AKIA[0-9A-Z]{{16}}', 'os.environ.get("HF_TOKEN", "<REDACTED_SECRET>")', 'g') AS text FROM {PLANTED}""",
    "graph_upsert": "SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1",
    "graph_orphans": "SELECT DISTINCT e AS endpoint FROM (SELECT o_custkey AS e FROM orders UNION ALL SELECT o_custkey + 1 FROM orders) WHERE e NOT IN (SELECT o_custkey FROM orders)",
    "stream_exact_dedup": f"SELECT DISTINCT {EXACT} AS digest FROM documents",
    "stream_step_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(event_id) AS steps, round(avg(value), 6) AS loss FROM events GROUP BY 1",
}
