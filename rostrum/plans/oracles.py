"""Reference SQL (DuckDB) for the queries, written independently of the operators."""

from __future__ import annotations

from rostrum.limits import (
    ANSWER_ERROR, NO_ANSWER, NO_CHATS, NO_SNIPPETS, NO_TRANSCRIPT,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


K = "CAST(props::JSON->>'$.k' AS INTEGER)"
MILLIS = "(epoch_us(ts) // 1000)"
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
NAME = f"""CASE event_type
  WHEN 'click' THEN 'chunk_' || user_id || '_' || event_id || '_' || {MILLIS} || '.webm'
  WHEN 'view' THEN 'audio/' || event_id || '.part.mp3'
  WHEN 'signup' THEN '.webm'
  ELSE 'recording-' || {ISO} || '.webm' END"""
FILE_ID = f"""user_id || '_' || {MILLIS} || '_' || CASE event_type
  WHEN 'click' THEN 'chunk_' || user_id || '_' || event_id || '_' || {MILLIS}
  WHEN 'view' THEN event_id || '.part'
  WHEN 'signup' THEN '.webm'
  ELSE 'recording-' || {ISO} END"""
FORMATS = """CASE event_type WHEN 'click' THEN ['matroska', 'webm']
  WHEN 'view' THEN ['mov', 'mp4', 'm4a', '3gp'] ELSE []::VARCHAR[] END"""
MESSAGE = f"""'{{"jobId":' || to_json(user_id::VARCHAR) || ',"fileId":' || to_json({FILE_ID})
  || ',"metadata":{{"originalFileName":' || to_json({NAME})
  || ',"mimetype":' || to_json('audio/' || event_type)
  || ',"formatNames":' || to_json({FORMATS})
  || ',"size":' || CAST(trunc(value * 131072) AS BIGINT)
  || ',"duration":' || round(value, 2)
  || ',"uploadTimestamp":' || to_json({ISO}) || '}}}}'"""

UPLOADS = f"""uploads AS (
  SELECT event_id, event_type = 'error' AS failed,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN NULL ELSE user_id::VARCHAR END AS job_id,
    k <> 0 AS has_file,
    CASE WHEN k = 0 THEN NULL ELSE CAST(trunc(value * 131072) AS BIGINT) END AS size_bytes,
    k <> 3 AS metadata_ok,
    CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN 0.0
      WHEN k = 6 THEN value * 4 + 900 ELSE value * 4 END AS duration_s
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) % 100 AS k FROM events WHERE event_type IN ('click', 'view', 'error'))),
validated AS (
  SELECT event_id, failed,
    CASE WHEN size_bytes > 26214400 THEN 'file_too_large'
         WHEN NOT has_file THEN 'no_audio_file'
         WHEN job_id IS NULL OR job_id = '' THEN 'no_session'
         WHEN NOT metadata_ok THEN 'unreadable_metadata'
         WHEN duration_s IS NULL OR duration_s = 0 THEN 'no_duration'
         WHEN duration_s > 900 THEN 'too_long' END AS reject_reason
  FROM uploads)"""

MEETINGS = """opened AS (
  SELECT user_id AS job_id, min(ts) AS created_at FROM events
  WHERE event_type IN ('signup', 'click', 'view') GROUP BY 1),
stopped AS (
  SELECT o.job_id, min(e.ts) AS stop_ts FROM opened o
  JOIN events e ON e.user_id = o.job_id AND e.event_type = 'purchase'
    AND e.event_id % 7 = 0 AND e.ts > o.created_at GROUP BY 1),
meetings AS (
  SELECT o.job_id, o.created_at,
    CASE WHEN s.stop_ts IS NULL THEN 'in-progress' ELSE 'completed' END AS status, s.stop_ts
  FROM opened o LEFT JOIN stopped s USING (job_id))"""

PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS user_chat,
    CASE WHEN next_role = 'assistant' THEN next_text END AS ai_chat
  FROM (SELECT conv_id, turn, role, text,
          lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WHERE role <> 'system'
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""

SINGLES = "('like', 'um', 'uh', 'ah')"
BARE = "lower(regexp_replace({}, '[,.;!?]+$', ''))"
LINES = f"""raw_lines AS (
  SELECT doc_id, i AS line_no,
    trim(regexp_replace(parts[i], '\\s+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
words AS (
  SELECT doc_id, line_no, i AS word_no, w[i] AS word
  FROM (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM raw_lines),
    LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
marked AS (
  SELECT *, {BARE.format('word')} IN {SINGLES}
    OR (lower(word) = 'you' AND coalesce({BARE.format('lead(word) OVER w')}, '') = 'know')
    OR ({BARE.format('word')} = 'know' AND coalesce(lower(lag(word) OVER w), '') = 'you') AS filler
  FROM words WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY word_no)),
kept AS (
  SELECT doc_id, line_no, word_no, filler,
    CASE WHEN filler THEN regexp_extract(word, '[.;!?]$', 0) ELSE word END AS word
  FROM marked),
joined AS (
  SELECT doc_id, line_no, bool_or(filler) AS touched,
    coalesce(string_agg(word, ' ' ORDER BY word_no) FILTER (WHERE word <> ''), '') AS line
  FROM kept GROUP BY 1, 2),
lines AS (
  SELECT doc_id, line_no, line FROM (
    SELECT doc_id, line_no,
      CASE WHEN touched THEN trim(regexp_replace(line, ' +([.,;!?])', '\\1', 'g'), ' ') ELSE line END AS line
    FROM joined)
  WHERE line <> '' AND NOT regexp_matches(line, '^[\\[(][^\\])]*[\\])]$'))"""

CHUNKS = LINES + """,
split_lines AS (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM lines),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS n,
    array_to_string(w[i * 140 + 1 : i * 140 + 140], ' ') AS line,
    least(140, len(w) - i * 140) AS words
  FROM split_lines, LATERAL (SELECT unnest(range(0, (len(w) - 1) // 140 + 1)) AS i)),
packed AS (
  SELECT doc_id, n, 0::BIGINT AS chunk_idx, words AS used FROM pieces WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.n,
    CASE WHEN k.used + p.words <= 140 THEN k.chunk_idx ELSE k.chunk_idx + 1 END,
    CASE WHEN k.used + p.words <= 140 THEN k.used + p.words ELSE p.words END
  FROM packed k JOIN pieces p ON p.doc_id = k.doc_id AND p.n = k.n + 1),
chunks AS (
  SELECT k.doc_id, k.chunk_idx, sum(p.words)::BIGINT AS words,
    string_agg('- ' || p.line || chr(10), '' ORDER BY p.n) AS text
  FROM packed k JOIN pieces p ON p.doc_id = k.doc_id AND p.n = k.n GROUP BY 1, 2),
flat AS (
  SELECT *, trim(regexp_replace(regexp_replace(text, '(?m)^- ', '', 'g'), '\\s+', ' ', 'g'), ' ') AS body
  FROM chunks),
summarised AS (
  SELECT doc_id, chunk_idx, words, text,
    CASE WHEN regexp_extract(body, '(?s)^\\s*(.*?[.!?])(?:\\s|$)', 1) <> ''
      THEN regexp_extract(body, '(?s)^\\s*(.*?[.!?])(?:\\s|$)', 1) ELSE body END AS summary
  FROM flat)"""
WITH_CHUNKS = "WITH RECURSIVE " + CHUNKS


def _features(name: str, source: str, keys: str, text: str) -> str:
    return f"""{name}_tokens AS (
  SELECT {keys}, unnest(string_split(lower(regexp_replace({text}, '[^\\p{{L}}]+', ' ', 'g')), ' ')) AS t
  FROM {source}),
{name} AS (
  SELECT {keys}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 768 AS bucket, count(*) AS tf
  FROM {name}_tokens WHERE t <> '' GROUP BY ALL),
{name}_norm AS (SELECT {keys}, sqrt(sum(tf * tf)) AS norm FROM {name} GROUP BY ALL)"""


def _hits(name: str, prompts: str, candidates: str, k: int, before: bool = True) -> str:
    earlier = "c{0}.turn < p{0}.prompt_turn" if before else "true"
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY conv_id, prompt_turn ORDER BY score DESC, turn) AS rank
    FROM (
      SELECT pn.conv_id, pn.prompt_turn, cn.turn,
        round(coalesce(d.dot, 0) / (pn.norm * cn.norm), 6) AS score
      FROM {prompts}_norm pn
      JOIN {candidates}_norm cn ON cn.conv_id = pn.conv_id AND {earlier.format('n')}
      LEFT JOIN (
        SELECT p.conv_id, p.prompt_turn, c.turn, sum(p.tf * c.tf)::DOUBLE AS dot
        FROM {prompts} p JOIN {candidates} c ON c.conv_id = p.conv_id AND c.bucket = p.bucket
        WHERE {earlier.format('')} GROUP BY ALL) d
      ON d.conv_id = pn.conv_id AND d.prompt_turn = pn.prompt_turn AND d.turn = cn.turn))
  WHERE rank <= {k})"""


PROMPTS = """prompts AS (
  SELECT conv_id, turn AS prompt_turn, text AS question FROM conversations WHERE role = 'user'),
spoken AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'system')"""
PROMPT_FEATURES = _features("pf", "prompts", "conv_id, prompt_turn", "question")
SNIPPETS = ",\n".join([
    _features("sf", "spoken", "conv_id, turn", "text"), _hits("snippet_hits", "pf", "sf", 5),
])
COMBINED = PAIRS + """,
combined AS (
  SELECT conv_id, turn, 'User: ' || user_chat || chr(10) || 'AI response: ' || ai_chat AS text
  FROM pairs WHERE ai_chat IS NOT NULL)"""
CHAT_HITS = ",\n".join([
    COMBINED, _features("cf", "combined", "conv_id, turn", "text"),
    _hits("chat_hits", "pf", "cf", 3),
])

CLEAN = """attempts AS (
  SELECT conv_id, turn, attempt, (length(text) + attempt) % 6 AS c,
    '{"summary":' || to_json(role) || ',"refined_text":' || to_json('- ' || text) || '}' AS item
  FROM conversations, (SELECT unnest([1, 2, 3, 4]) AS attempt) WHERE role = 'assistant'),
responses AS (
  SELECT conv_id, turn, attempt, CASE c
    WHEN 0 THEN '```json' || chr(10) || '[' || item || ']' || chr(10) || '```'
    WHEN 1 THEN 'no array here' WHEN 2 THEN '[' || item || '] and [2]'
    WHEN 3 THEN '[' || item || ',]' WHEN 4 THEN 'Sure: []'
    ELSE '[' || item || ',' || chr(10) || item || ']' END AS response
  FROM attempts),
spans AS (
  SELECT *, regexp_extract(response, '(?s)\\[.*\\]', 0) AS span FROM responses WHERE attempt <= 3),
valid AS (
  -- json_valid lets a comma before the closing bracket pass; strict JSON does not.
  SELECT *, span <> '' AND json_valid(span) AND NOT regexp_matches(span, ',\\s*\\]$') AS ok
  FROM spans),
resolved AS (
  SELECT conv_id, turn, min(attempt) FILTER (WHERE ok) AS attempt,
    arg_min(span, attempt) FILTER (WHERE ok) AS span
  FROM valid GROUP BY 1, 2)"""
CLEAN_CHUNKS = CLEAN + """,
clean_chunks AS (
  SELECT conv_id, turn, i AS chunk_idx, span::JSON->>('$[' || i || '].summary') AS summary,
    span::JSON->>('$[' || i || '].refined_text') AS refined_text
  FROM resolved, LATERAL (SELECT unnest(range(0, json_array_length(span::JSON)::BIGINT)) AS i)
  WHERE attempt IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "audio_manifest": """
SELECT event_id, user_id AS job_id, ts, CAST(trunc(value * 131072) AS BIGINT) AS size_bytes,
  value * 4 AS duration_s
FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "audio_validation": f"WITH {UPLOADS} SELECT event_id, reject_reason FROM validated",
    "dead_letter": f"""WITH {UPLOADS}
SELECT coalesce(reject_reason, 'transcription_failed') AS reject_reason, count(*) AS n
FROM validated WHERE reject_reason IS NOT NULL OR failed GROUP BY 1""",
    "retry_dead_letter": f"""WITH {UPLOADS}
SELECT event_id FROM validated WHERE reject_reason IS NULL AND failed""",
    "format_names": f"""
SELECT event_id, array_to_string({FORMATS}, '|') AS formats, len({FORMATS}) AS n_formats FROM events""",
    "object_id": f"SELECT event_id, {FILE_ID} AS file_id FROM events",
    "chunk_name_parse": f"""
SELECT event_id,
  CASE WHEN event_type = 'click' THEN user_id::VARCHAR END AS job_id,
  CASE WHEN event_type = 'click' THEN event_id END AS chunk_no,
  CASE WHEN event_type = 'click' THEN date_trunc('millisecond', ts) END AS captured_at,
  CASE WHEN event_type NOT IN ('click', 'view', 'signup') THEN date_trunc('millisecond', ts) END AS recorded_at
FROM events""",
    "build_job_message": f"SELECT event_id, {MESSAGE} AS message FROM events",
    "decode_job_message": f"""
SELECT event_id, {K}::BIGINT AS k, event_type <> 'error' AS decoded,
  CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS job_id,
  CASE WHEN event_type <> 'error' THEN {FILE_ID} END AS file_id,
  CASE WHEN event_type NOT IN ('error', 'view') THEN {NAME} END AS file_name,
  CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(trunc(value * 131072) AS BIGINT) END AS size_bytes,
  CASE WHEN event_type NOT IN ('error', 'view') THEN array_to_string({FORMATS}, '|') END AS formats,
  CASE WHEN event_type NOT IN ('error', 'view') THEN {ISO} END AS uploaded
FROM events""",
    "prompt_validation": """
SELECT conv_id, turn, turn % 4 <> 2 AND turn % 6 <> 3 AND text <> '' AS valid
FROM conversations WHERE role = 'user'""",
    "nonblank_text": """
SELECT lang, count(*) FILTER (WHERE regexp_matches(line, '\\S')) AS n_spoken,
  count(*) FILTER (WHERE NOT regexp_matches(line, '\\S')) AS n_blank
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""",
    "constraint_report": """
SELECT 'meeting_job_missing' AS check_name, count(*) FILTER (WHERE user_id IS NULL) AS n_bad FROM events
UNION ALL
SELECT 'meeting_status_invalid', count(*) FROM events WHERE event_type = 'error'
UNION ALL
SELECT 'meeting_job_repeated', count(*) FROM (
  SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'chat_job_missing', count(*) FROM conversations WHERE role = 'user' AND conv_id IS NULL
UNION ALL
SELECT 'chat_text_missing', count(*) FROM conversations
WHERE role = 'user' AND (turn % 4 = 2 OR coalesce(text, '') = '')""",
    "meetings": f"WITH {MEETINGS} SELECT job_id, created_at, status FROM meetings",
    "meeting_status": f"""WITH {MEETINGS}
SELECT e.event_id, e.user_id AS job_id, m.status FROM events e
LEFT JOIN meetings m ON m.job_id = e.user_id WHERE e.event_type IN ('click', 'view', 'error')""",
    "drop_completed": f"""WITH {MEETINGS}
SELECT e.event_id, e.user_id AS job_id FROM events e
WHERE e.event_type IN ('click', 'view') AND NOT EXISTS (
  SELECT 1 FROM meetings m WHERE m.job_id = e.user_id AND m.status = 'completed')""",
    "late_drop": f"""WITH {MEETINGS}
SELECT e.event_id, e.user_id AS job_id FROM events e LEFT JOIN stopped s ON s.job_id = e.user_id
WHERE e.event_type IN ('click', 'view') AND (s.stop_ts IS NULL OR e.ts <= s.stop_ts)""",
    "late_drop_grace": f"""WITH {MEETINGS}
SELECT e.event_id, e.user_id AS job_id FROM events e LEFT JOIN stopped s ON s.job_id = e.user_id
WHERE e.event_type IN ('click', 'view')
  AND (s.stop_ts IS NULL OR e.ts <= s.stop_ts + INTERVAL 6 HOUR)""",
    "chunk_number": """
SELECT event_id, user_id AS job_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chunk_no
FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "job_progress": """
SELECT user_id AS job_id, count(*) AS chunks_seen,
  count(*) FILTER (WHERE event_type = 'error') AS pending,
  bool_and(event_type <> 'error') AS all_done,
  sum(CAST(trunc(value * 131072) AS BIGINT))::BIGINT AS bytes
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1""",
    "tumbling_10m": """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, user_id AS job_id, count(*) AS n
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
    "pause_segments": """
SELECT job_id, min(ts) AS segment_start, max(ts) + INTERVAL 30 MINUTE AS segment_end, count(*) AS n
FROM (SELECT job_id, ts, sum(opens) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg
  FROM (SELECT user_id AS job_id, ts,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE
      THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY job_id, seg""",
    "transcript_append": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_no, text
FROM conversations WHERE role <> 'system' AND regexp_matches(text, '\\S')""",
    "full_transcript": f"""
WITH heard AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_no, text
  FROM conversations WHERE role <> 'system' AND regexp_matches(text, '\\S'))
SELECT c.conv_id, coalesce(h.chunk_no, 0) AS chunk_no, coalesce(h.text, {_q(NO_TRANSCRIPT)}) AS text
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN heard h USING (conv_id)""",
    "one_transcript": """
SELECT conv_id, count(*) AS n_chunks, string_agg(text, ' ' ORDER BY turn) AS transcript
FROM conversations WHERE role <> 'system' AND regexp_matches(text, '\\S')
  AND conv_id = (SELECT min(conv_id) FROM conversations WHERE role <> 'system') GROUP BY 1""",
    "running_progress": """
SELECT conv_id, count(*) AS n_fragments, sum(length(text))::BIGINT AS n_chars
FROM conversations WHERE role <> 'system' GROUP BY 1""",
    "stored_points": f"""{WITH_CHUNKS}
SELECT d.source AS job_id, count(*) AS n, 0::BIGINT AS n_empty, 0::BIGINT AS n_wrong_width,
  0::BIGINT AS n_no_direction, count(*) AS n_usable, false AS none_left
FROM chunks c JOIN documents d USING (doc_id) WHERE regexp_matches(c.text, '\\p{{L}}') GROUP BY 1""",
    "dense_embedding": f"""WITH {_features('f', 'conversations', 'conv_id, turn', 'text')}
SELECT conv_id, turn, bucket, 768::BIGINT AS width, round((tf / norm)::FLOAT::DOUBLE, 6) AS weight
FROM f JOIN f_norm USING (conv_id, turn)""",
    "one_search": """
WITH asked AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT * FROM (
  SELECT e.label::BIGINT AS job_id, e.vec_id,
    round(list_cosine_similarity(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e JOIN asked a ON a.label = e.label)
ORDER BY score DESC, vec_id LIMIT 5""",
    "chat_pairs": f"WITH {PAIRS} SELECT conv_id, turn, user_chat, ai_chat FROM pairs",
    "chat_answer_update": """
SELECT u.conv_id, u.turn, u.text AS user_chat, a.text AS ai_chat FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "chat_update_errors": """
SELECT a.conv_id, a.turn - 1 AS turn FROM conversations a WHERE a.role = 'assistant' AND NOT EXISTS (
  SELECT 1 FROM conversations u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1
    AND u.role = 'user' AND length(u.text) % 3 <> 0)""",
    "chat_history_page": f"""WITH {PAIRS}
SELECT conv_id, turn, user_chat, ai_chat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
FROM (SELECT p.*, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.turn DESC) AS back
  FROM pairs p JOIN (SELECT conv_id, max(turn) AS last FROM pairs GROUP BY 1) c USING (conv_id)
  WHERE p.turn < c.last)
WHERE back <= 5""",
    "chat_history_all": f"""WITH {PAIRS}
SELECT conv_id, turn, user_chat, ai_chat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs)
WHERE back <= 5""",
    "chat_vectors": f"""WITH {COMBINED}, {_features('cf', 'combined', 'conv_id, turn', 'text')}
SELECT sha256(c.conv_id || '|' || c.turn || '|chat') AS id, c.conv_id AS job_id,
  c.turn::VARCHAR AS chat_id,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c.turn), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp,
  md5(c.text) AS text_md5, count(f.bucket) AS n_buckets, round(sqrt(sum(f.tf * f.tf)), 6) AS norm
FROM combined c LEFT JOIN cf f ON f.conv_id = c.conv_id AND f.turn = c.turn
GROUP BY c.conv_id, c.turn, c.text""",
    "chat_vector_orphans": f"""WITH {PAIRS}
SELECT conv_id, turn, 'orphan' AS kind FROM pairs
WHERE ai_chat IS NOT NULL AND length(user_chat) % 11 = 0
UNION ALL
SELECT conv_id, turn, 'unembedded' FROM pairs WHERE ai_chat IS NULL AND length(user_chat) % 11 <> 0""",
    "refine_text": f"""WITH {LINES}
SELECT d.doc_id, count(l.line) AS n_lines,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '')) AS lines_md5
FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1""",
    "chunk_text": f"{WITH_CHUNKS} SELECT doc_id, chunk_idx, words, md5(text) AS text_md5 FROM chunks",
    "chunk_summary": f"{WITH_CHUNKS} SELECT doc_id, chunk_idx, summary FROM summarised",
    "chunk_contract": f"""{WITH_CHUNKS},
offered AS (
  SELECT doc_id, chunk_idx, summary, text FROM summarised
  UNION ALL
  SELECT doc_id, -1, CASE WHEN doc_id % 5 <> 0 THEN source END,
    CASE WHEN doc_id % 2 = 0 THEN '- ' || text WHEN doc_id % 7 <> 0 THEN text END FROM documents),
bodies AS (
  SELECT *, trim(regexp_replace(regexp_replace(text, '(?m)^- ', '', 'g'), '\\s+', ' ', 'g'), ' ') AS body
  FROM offered)
SELECT doc_id, chunk_idx, CASE
  WHEN summary IS NULL THEN 'missing_summary'
  WHEN text IS NULL THEN 'missing_text'
  WHEN body <> '' AND len(string_split(body, ' ')) > 140 THEN 'too_many_words'
  WHEN text = '' OR len(list_filter(string_split(text, chr(10)), lambda x: x <> '' AND x[1:2] <> '- ')) > 0
    THEN 'line_prefix'
  WHEN regexp_matches(text, '(?m)^- \\p{{L}}[\\p{{L}}\\p{{N}} ]{{0,30}}: ') THEN 'speaker_label' END AS reject_reason
FROM bodies""",
    "chunk_profile": f"""{WITH_CHUNKS}
SELECT n_chunks, count(*) AS n_docs, n_chunks BETWEEN 9 AND 12 AS typical
FROM (SELECT d.doc_id, count(c.chunk_idx) AS n_chunks FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY 1)
GROUP BY 1""",
    "job_counts": f"""{WITH_CHUNKS},
per_doc AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '\\p{{L}}')) AS v
  FROM chunks GROUP BY 1)
SELECT d.source, coalesce(sum(p.n), 0)::BIGINT AS n_chunks, coalesce(sum(p.v), 0)::BIGINT AS n_vectors,
  sum(length(d.text))::BIGINT AS n_chars
FROM documents d LEFT JOIN per_doc p USING (doc_id) GROUP BY 1""",
    "vector_contract": """
WITH v AS (SELECT label::BIGINT AS job_id, CASE vec_id % 17 WHEN 3 THEN 'empty' WHEN 9 THEN 'empty'
    WHEN 5 THEN 'short' WHEN 7 THEN 'zero' ELSE 'good' END AS kind FROM embeddings)
SELECT job_id, count(*) AS n, count(*) FILTER (WHERE kind = 'empty') AS n_empty,
  count(*) FILTER (WHERE kind = 'short') AS n_wrong_width,
  count(*) FILTER (WHERE kind = 'zero') AS n_no_direction,
  count(*) FILTER (WHERE kind = 'good') AS n_usable,
  count(*) FILTER (WHERE kind <> 'empty') = 0 AS none_left
FROM v GROUP BY 1""",
    "vector_upsert": f"""{WITH_CHUNKS}
SELECT sha256(d.source || '|' || c.doc_id || '|' || c.chunk_idx) AS id, d.source AS job_id,
  'rec-' || c.doc_id || '-' || (c.doc_id % 2) || '.webm' AS filename,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.doc_id + 60 * (c.doc_id % 2)) AS upload_timestamp,
  md5(c.text) AS text_md5, c.summary
FROM summarised c JOIN documents d USING (doc_id)""",
    "hash_embedding": f"""WITH {_features('f', 'conversations', 'conv_id, turn', 'text')}
SELECT conv_id, turn, bucket, round(tf / norm, 6) AS weight FROM f JOIN f_norm USING (conv_id, turn)""",
    "topk_chunks": """
SELECT job_id, prompt_id, vec_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT p.label::BIGINT AS job_id, p.vec_id AS prompt_id, c.vec_id,
      round(list_cosine_similarity(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
    FROM embeddings p JOIN embeddings c ON c.label = p.label AND c.vec_id <> p.vec_id))
WHERE rank <= 5""",
    "text_topk": f"""WITH {PROMPTS}, {PROMPT_FEATURES}, {SNIPPETS}
SELECT conv_id, prompt_turn, turn, rank, score FROM snippet_hits""",
    "text_topk_all": f"""WITH {PROMPTS}, {PROMPT_FEATURES}, {_features("sf", "spoken", "conv_id, turn", "text")},
{_hits("snippet_hits", "pf", "sf", 5, before=False)}
SELECT conv_id, prompt_turn, turn, rank, score FROM snippet_hits""",
    "topk_chats": f"""WITH {PROMPTS}, {PROMPT_FEATURES}, {CHAT_HITS}
SELECT conv_id, prompt_turn, turn, rank, score FROM chat_hits""",
    "rag_context": f"""WITH {PROMPTS}, {PROMPT_FEATURES}, {SNIPPETS}, {CHAT_HITS},
s AS (
  SELECT h.conv_id, h.prompt_turn,
    string_agg('Transcription Snippet: ' || t.text, chr(10) ORDER BY h.rank) AS txt
  FROM snippet_hits h JOIN spoken t USING (conv_id, turn) GROUP BY 1, 2),
c AS (
  SELECT h.conv_id, h.prompt_turn,
    string_agg('User: ' || to_json(p.user_chat) || chr(10) || 'AI: ' || p.ai_chat, chr(10) ORDER BY h.rank) AS txt
  FROM chat_hits h JOIN pairs p USING (conv_id, turn) GROUP BY 1, 2)
SELECT p.conv_id, p.prompt_turn,
  '# Meeting Transcription Context:' || chr(10) || coalesce(s.txt, {_q(NO_SNIPPETS)}) || chr(10) || chr(10)
  || '# Relevant Chat History:' || chr(10) || coalesce(c.txt, {_q(NO_CHATS)}) || chr(10) || chr(10)
  || '# User''s Question:' || chr(10) || p.question AS context
FROM prompts p LEFT JOIN s USING (conv_id, prompt_turn) LEFT JOIN c USING (conv_id, prompt_turn)""",
    "clean_resolution": f"""WITH {CLEAN}
SELECT conv_id, turn, attempt::BIGINT AS attempt,
  CASE WHEN attempt IS NULL THEN 'dead' ELSE 'ok' END AS outcome,
  coalesce(json_array_length(span::JSON)::BIGINT, 0) AS n_chunks
FROM resolved""",
    "clean_chunks": f"""WITH {CLEAN_CHUNKS}
SELECT conv_id, turn, chunk_idx, summary, refined_text FROM clean_chunks""",
    "unembedded_transcripts": f"""WITH {CLEAN_CHUNKS}
SELECT conv_id, turn FROM conversations a WHERE role = 'assistant' AND NOT EXISTS (
  SELECT 1 FROM clean_chunks c WHERE c.conv_id = a.conv_id AND c.turn = a.turn
    AND regexp_matches(c.refined_text, '\\p{{L}}'))""",
    "answer_resolution": f"""
WITH a AS (
  SELECT conv_id, turn, attempt, (length(text) + 2 * attempt) % 5 AS c, text
  FROM conversations, (SELECT unnest([1, 2]) AS attempt) WHERE role = 'user'),
r AS (
  SELECT conv_id, turn, min(attempt) FILTER (WHERE c > 2) AS attempt,
    arg_min(attempt || ': ' || text, attempt) FILTER (WHERE c > 2) AS answer,
    bool_or(c = 1) FILTER (WHERE attempt = 2) AS failed
  FROM a GROUP BY 1, 2)
SELECT conv_id, turn, attempt::BIGINT AS attempt,
  coalesce(answer, CASE WHEN failed THEN {_q(ANSWER_ERROR)} ELSE {_q(NO_ANSWER)} END) AS answer
FROM r""",
    "stream_reassembly": """
SELECT conv_id, turn, string_agg(w[i + 1] || ' ', '' ORDER BY i) AS text
FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
  LATERAL (SELECT unnest(range(0, len(w))) AS i)
GROUP BY 1, 2""",
    "stream_accept": f"""WITH {UPLOADS}
SELECT user_id::VARCHAR AS job_id, {FILE_ID} AS file_id
FROM events JOIN validated v USING (event_id) WHERE v.reject_reason IS NULL""",
    "stream_ingest": f"""WITH {UPLOADS}
SELECT user_id::VARCHAR AS job_id, {FILE_ID} AS file_id, {NAME} AS file_name,
  CAST(trunc(value * 131072) AS BIGINT) AS size_bytes
FROM events JOIN validated v USING (event_id) WHERE v.reject_reason IS NULL""",
    "stream_dedup": "SELECT event_id, user_id AS job_id FROM events",
    "stream_transcript": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_no, md5(text) AS text_md5
FROM conversations WHERE role <> 'system' AND regexp_matches(text, '\\S')""",
    "stream_slices": """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, user_id AS job_id, count(*) AS n
FROM events GROUP BY 1, 2""",
}
ORACLES["stream_once"] = ORACLES["stream_ingest"]
ORACLES["merge_points"] = f"""{WITH_CHUNKS},
written AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 2 THEN 2 WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS seq
  FROM documents)
SELECT sha256(d.source || '|' || c.doc_id || '|' || c.chunk_idx) AS id, d.source AS job_id,
  'rec-' || c.doc_id || '-' || d.seq || '.webm' AS filename,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.doc_id + 60 * d.seq) AS upload_timestamp,
  md5(c.text) AS text_md5, c.summary
FROM summarised c JOIN written d USING (doc_id)"""
ORACLES["topk_pruned"] = ORACLES["topk_chunks"]
ORACLES["text_topk_index"] = ORACLES["text_topk_all"]
ORACLES["stream_late_drop"] = ORACLES["late_drop"]
ORACLES["stream_timely_slices"] = ORACLES["late_drop"]
ORACLES["stream_meeting_state"] = f"WITH {MEETINGS} SELECT job_id, created_at, status, stop_ts FROM meetings"
ORACLES["stream_running_transcript"] = ORACLES["stream_transcript"]
ORACLES["stream_sessions"] = ORACLES["pause_segments"]
ORACLES["chunk_long"] = ORACLES["chunk_text"]
ORACLES["meeting_status_skewed"] = f"""WITH moved AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, ts, event_type FROM events),
{MEETINGS.replace("events", "moved")}
SELECT e.event_id, e.user_id AS job_id, m.status FROM moved e
LEFT JOIN meetings m ON m.job_id = e.user_id WHERE e.event_type IN ('click', 'view', 'error')"""
ORACLES["one_history_page"] = f"""WITH {PAIRS},
asked AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM pairs GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 1)
SELECT conv_id, turn, user_chat, ai_chat FROM (
  SELECT p.* FROM pairs p JOIN asked a ON a.conv_id = p.conv_id AND p.turn < a.last
  ORDER BY p.turn DESC LIMIT 5)"""
ORACLES["stream_sessions_corrected"] = ORACLES["pause_segments"]
ORACLES["recording_points"] = f"""{WITH_CHUNKS},
recorded AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts, n_chars % 50 = 0 AS stops
  FROM documents),
first_slice AS (SELECT source, min(ts) AS created_at FROM recorded WHERE NOT stops GROUP BY 1),
first_stop AS (
  SELECT r.source, min(r.ts) AS stop_ts FROM recorded r JOIN first_slice f USING (source)
  WHERE r.stops AND r.ts > f.created_at GROUP BY 1),
timely AS (
  SELECT r.* FROM recorded r LEFT JOIN first_stop s USING (source)
  WHERE NOT r.stops AND (s.stop_ts IS NULL OR r.ts <= s.stop_ts)),
{_features("cf", "chunks", "doc_id, chunk_idx", "text")}
SELECT sha256(t.source || '|' || c.doc_id || '|' || c.chunk_idx) AS id, t.source AS job_id,
  'rec-' || c.doc_id || '.webm' AS filename, t.ts AS upload_timestamp, md5(c.text) AS text_md5, c.summary,
  (SELECT count(*) FROM cf WHERE cf.doc_id = c.doc_id AND cf.chunk_idx = c.chunk_idx) AS n_buckets
FROM summarised c JOIN timely t USING (doc_id) WHERE n_buckets > 0"""
ORACLES["stream_recordings"] = ORACLES["recording_points"]
ORACLES["cleaned_points"] = f"""WITH {CLEAN_CHUNKS},
bodies AS (
  SELECT *, trim(regexp_replace(regexp_replace(refined_text, '(?m)^- ', '', 'g'), '\\s+', ' ', 'g'), ' ') AS body
  FROM clean_chunks),
kept AS (
  SELECT * FROM bodies
  WHERE summary IS NOT NULL AND refined_text <> '' AND len(string_split(body, ' ')) <= 140
    AND len(list_filter(string_split(refined_text, chr(10)), lambda x: x <> '' AND x[1:2] <> '- ')) = 0
    AND NOT regexp_matches(refined_text, '(?m)^- \\p{{L}}[\\p{{L}}\\p{{N}} ]{{0,30}}: ')),
{_features("kf", "kept", "conv_id, turn, chunk_idx", "refined_text")}
SELECT sha256(k.conv_id || '|' || k.turn || '|' || k.chunk_idx) AS id, k.conv_id AS job_id,
  'rec-' || k.turn || '.webm' AS filename,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k.turn) AS upload_timestamp,
  md5(k.refined_text) AS text_md5, k.summary, count(f.bucket) AS n_buckets
FROM kept k LEFT JOIN kf f USING (conv_id, turn, chunk_idx)
GROUP BY k.conv_id, k.turn, k.chunk_idx, k.refined_text, k.summary HAVING count(f.bucket) > 0"""
