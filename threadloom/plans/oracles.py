"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

from ..functions.texts import STOP_WORDS
from ..operators.payloads import CLIPBOARD_PREAMBLE, INJECT_PREAMBLE
from .queries import DECORATED, JSON_NODES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOPS = ", ".join(_text(w) for w in dict.fromkeys(STOP_WORDS))
ROUNDS = 20

MESSAGES = f"msg AS MATERIALIZED (SELECT conv_id, turn, role, {DECORATED} AS content FROM conversations)"

SUMMARY = """CASE WHEN octet_length(encode(x)) <= 120 THEN x ELSE (
  SELECT string_agg(c, '' ORDER BY i) FILTER (WHERE total <= 120) || CASE WHEN max(total) FILTER (WHERE total <= 120) < 120 THEN chr(65533) ELSE '' END
  FROM (SELECT i, c, sum(octet_length(encode(c))) OVER (ORDER BY i) AS total FROM (SELECT unnest(string_split(left(x, 121), '')) AS c, generate_subscripts(string_split(left(x, 121), ''), 1) AS i))) || '...' END"""

SUMMARIES = f"sums AS MATERIALIZED (SELECT conv_id, turn, {SUMMARY} AS summary FROM (SELECT conv_id, turn, regexp_replace(content, '(?s)```.*?```', '', 'g') AS x FROM msg))"

BLOCKS = """blocks AS MATERIALIZED (SELECT conv_id, turn, ord, rtrim(l, ' ' || chr(13)) AS language, rtrim(c, chr(10) || chr(13)) AS code FROM (
  SELECT conv_id, turn, CAST(unnest(range(len(ls))) AS BIGINT) AS ord, unnest(ls) AS l, unnest(cs) AS c FROM (
    SELECT conv_id, turn, regexp_extract_all(content, '(?s)```([^\\n]*)\\n(.*?)```', 1) AS ls, regexp_extract_all(content, '(?s)```([^\\n]*)\\n(.*?)```', 2) AS cs FROM msg)))"""

LINKS = """link AS MATERIALIZED (SELECT conv_id, turn, CAST(unnest(range(len(a))) AS BIGINT) AS ord, unnest(a) AS link FROM (
  SELECT conv_id, turn, list_concat(p, list_filter(b, lambda x, i: NOT list_contains(p, x) AND list_position(b, x) = i)) AS a FROM (
    SELECT conv_id, turn, list_filter(regexp_extract_all(content, '\\]\\(([^)]*)\\)', 1), lambda x: octet_length(encode(x)) > 4) AS p,
      regexp_extract_all(content, 'https?://[^ \\n)"]*') AS b FROM msg)))"""

# -- words and stems ---------------------------------------------------------------------------------------------------

WORDS = f"""kept AS MATERIALIZED (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS BIGINT) AS pos, word FROM (
  SELECT conv_id, turn, i, lower(w) AS word FROM (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (
    SELECT conv_id, turn, regexp_extract_all(content, '[A-Za-z]+') AS ws FROM msg))) WHERE length(word) > 2 AND word NOT IN ({STOPS}))"""


def _shape(word: str) -> str:
    return f"list_reduce(string_split({word}, ''), lambda a, ch: a || CASE WHEN ch IN ('a','e','i','o','u') OR (ch = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END, '')"


def _cases(rules: list[tuple[str, str, str]], otherwise: str = "b") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in rules) + f" ELSE {otherwise} END"


def _measure(cut: int | str) -> str:
    return f"len(regexp_extract_all(left(p, length(b) - {cut}), 'vc'))"


def _stage(name: str, before: str, expression: str, extra: str = "") -> str:
    return f"{name} AS MATERIALIZED (SELECT word, {expression} AS b{extra} FROM (SELECT *, {_shape('b')} AS p FROM {before}))"


def _suffix_stage(name: str, before: str, rules: str) -> str:
    pairs = [r.split(">") for r in rules.split()]
    made = [(f"b LIKE '%{s}'", f"CASE WHEN {_measure(len(s))} > 0 THEN left(b, length(b) - {len(s)}) || '{t}' ELSE b END") for s, t in pairs]
    return _stage(name, before, _cases(made))


def _stems() -> str:
    has_vowel = lambda n: f"left(p, length(b) - {n}) LIKE '%v%'"
    fourth = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
    ends = [(f"b LIKE '%{s}'", f"CASE WHEN {_measure(len(s) - (s in ('sion', 'tion')))} > 1 THEN left(b, length(b) - {len(s) - (s in ('sion', 'tion'))}) ELSE b END") for s in fourth]
    short = "(right(p, 3) = 'cvc' AND right(b, 1) NOT IN ('w', 'x', 'y'))"
    short_before_e = "(right(left(p, length(b) - 1), 3) = 'cvc' AND substr(b, length(b) - 1, 1) NOT IN ('w', 'x', 'y'))"
    doubled = "(length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND right(p, 1) = 'c')"
    stages = [
        "s0 AS MATERIALIZED (SELECT word, word AS b FROM (SELECT DISTINCT word FROM kept))",
        f"s1 AS MATERIALIZED (SELECT word, {_cases([('b LIKE ' + _text('%sses'), 'left(b, length(b) - 2)'), ('b LIKE ' + _text('%ies'), 'left(b, length(b) - 1)'), ('b LIKE ' + _text('%ss'), 'b'), ('b LIKE ' + _text('%s'), 'left(b, length(b) - 1)')])} AS b FROM s0)",
        _stage("s2", "s1", _cases([("b LIKE '%eed'", f"CASE WHEN {_measure(3)} > 0 THEN left(b, length(b) - 1) ELSE b END"), ("b LIKE '%ed' AND " + has_vowel(2), "left(b, length(b) - 2)"), ("b LIKE '%ing' AND " + has_vowel(3), "left(b, length(b) - 3)")]), f", (b NOT LIKE '%eed' AND ((b LIKE '%ed' AND {has_vowel(2)}) OR (b LIKE '%ing' AND {has_vowel(3)}))) AS cut"),
        _stage("s3", "s2", _cases([("NOT cut", "b"), ("b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz'", "b || 'e'"), (doubled, "CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END"), (f"{_measure(0)} = 1 AND {short}", "b || 'e'")])),
        _stage("s4", "s3", _cases([("b LIKE '%y' AND " + has_vowel(1), "left(b, length(b) - 1) || 'i'")])),
        _suffix_stage("s5", "s4", "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble"),
        _suffix_stage("s6", "s5", "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"),
        _stage("s7", "s6", _cases(ends)),
        _stage("s8", "s7", _cases([(f"b LIKE '%e' AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {short_before_e}))", "left(b, length(b) - 1)")])),
        _stage("s9", "s8", _cases([(f"b LIKE '%ll' AND {_measure(1)} > 1", "left(b, length(b) - 1)")])),
    ]
    return ", ".join(stages)


STEMS = _stems()
TOKENS = """tok AS MATERIALIZED (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS BIGINT) AS pos, word, b AS stem
  FROM kept JOIN s9 USING (word) WHERE length(b) > 1)"""
PAIRS = """pair AS MATERIALIZED (SELECT conv_id, turn, src, dst, CAST(count(*) AS BIGINT) AS weight FROM (
  SELECT x.conv_id, x.turn, x.stem AS src, y.stem AS dst FROM tok x JOIN tok y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.pos - x.pos IN (-2, -1, 1, 2) AND x.stem <> y.stem) GROUP BY ALL)"""


def _ranks() -> str:
    stages = [
        "share AS MATERIALIZED (SELECT *, weight / sum(weight) OVER (PARTITION BY conv_id, turn, src) AS w FROM pair)",
        "r0 AS MATERIALIZED (SELECT DISTINCT conv_id, turn, stem, CAST(1 AS DOUBLE) AS score, false AS done FROM tok)",
    ]
    for k in range(ROUNDS):
        stages.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT conv_id, turn, stem, new AS score, done OR max(abs(new - old)) OVER (PARTITION BY conv_id, turn) < 1e-4 AS done FROM (
  SELECT r.conv_id, r.turn, r.stem, r.done, r.score AS old, CASE WHEN r.done THEN r.score ELSE 0.15 + 0.85 * coalesce(g.s, 0) END AS new FROM r{k} r LEFT JOIN (
    SELECT h.conv_id, h.turn, h.dst, sum(q.score * h.w) AS s FROM share h JOIN r{k} q ON q.conv_id = h.conv_id AND q.turn = h.turn AND q.stem = h.src GROUP BY ALL) g
    ON g.conv_id = r.conv_id AND g.turn = r.turn AND g.dst = r.stem))"""
        )
    return ", ".join(stages)


RANKS = _ranks()
TOP = f"""top AS MATERIALIZED (SELECT conv_id, turn, stem, CAST(n - 1 AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, stem) AS n FROM r{ROUNDS}) WHERE n <= 5)"""
FORMS = """form AS MATERIALIZED (SELECT conv_id, turn, stem, upper(word[1]) || word[2:] AS form FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, stem ORDER BY n DESC, word) AS r FROM (SELECT conv_id, turn, stem, word, count(*) AS n FROM tok GROUP BY ALL)) WHERE r = 1)"""
# Runs of best stems without equal neighbours; odd places of a run open a phrase, even ones close it.
PHRASES = """island AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS place FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR before <> pos - 1 OR stem_before = stem THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM (
    SELECT t.*, lag(pos) OVER w AS before, lag(t.stem) OVER w AS stem_before FROM tok t JOIN top USING (conv_id, turn, stem) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)))),
 phrase AS MATERIALIZED (SELECT conv_id, turn, min(pos) AS pos, string_agg(form, ' ' ORDER BY pos) AS phrase, string_agg(stem, '_' ORDER BY pos) AS key FROM island JOIN form USING (conv_id, turn, stem) GROUP BY conv_id, turn, run, (place + 1) // 2),
 word AS MATERIALIZED (SELECT conv_id, turn, CAST(n - 1 AS BIGINT) AS ord, phrase, key FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM (SELECT conv_id, turn, phrase, min(pos) AS pos, arg_min(key, pos) AS key FROM phrase GROUP BY ALL)) WHERE n <= 5)"""

TOKEN_STEPS = f"{MESSAGES}, {WORDS}, {STEMS}, {TOKENS}"
RANK_STEPS = f"{TOKEN_STEPS}, {PAIRS}, {RANKS}, {TOP}, {FORMS}, {PHRASES}"

DOCUMENT_MESSAGES = "msg AS MATERIALIZED (SELECT doc_id AS conv_id, 0 AS turn, text AS content FROM documents)"
DOCUMENT_STEPS = RANK_STEPS.replace(MESSAGES, DOCUMENT_MESSAGES)
DOCUMENT_TOKENS = TOKEN_STEPS.replace(MESSAGES, DOCUMENT_MESSAGES)

# -- graph -------------------------------------------------------------------------------------------------------------

GRAPH_STEPS = f"""{RANK_STEPS}, {SUMMARIES}, {BLOCKS}, {LINKS},
 task AS MATERIALIZED (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_no FROM msg),
 item AS MATERIALIZED (
  SELECT conv_id, turn, 0 AS kind, CAST(0 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS language, summary AS content, CAST(NULL AS VARCHAR) AS key FROM sums
  UNION ALL SELECT conv_id, turn, 1, ord, nullif(language, ''), code, NULL FROM blocks
  UNION ALL SELECT conv_id, turn, 2, ord, NULL, link, NULL FROM link
  UNION ALL SELECT conv_id, turn, 3, ord, NULL, phrase, key FROM word),
 flagged AS MATERIALIZED (SELECT *, kind < 3 OR row_number() OVER (PARTITION BY conv_id, kind, key ORDER BY turn, ord) = 1 AS fresh FROM item JOIN task USING (conv_id, turn)),
 counted AS MATERIALIZED (SELECT *, CASE WHEN kind = 0 THEN 't' || msg_no ELSE 'a' || CAST(sum(CASE WHEN kind > 0 AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, kind, ord) - 1 AS BIGINT) END AS own FROM flagged),
 placed AS MATERIALIZED (SELECT c.*, CASE WHEN c.kind = 3 THEN f.own ELSE c.own END AS id FROM counted c LEFT JOIN (SELECT conv_id, key, own FROM counted WHERE kind = 3 AND fresh) f ON f.conv_id = c.conv_id AND f.key = c.key),
 node AS MATERIALIZED (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, ord) - 1 AS BIGINT) AS node_seq, id,
  CASE kind WHEN 0 THEN 'task' ELSE 'artifact' END AS type, CASE kind WHEN 1 THEN 'code' WHEN 2 THEN 'link' WHEN 3 THEN 'variable' END AS subtype,
  CASE WHEN kind = 0 THEN nullif(role, '') END AS role, language, content FROM placed WHERE fresh),
 edge AS MATERIALIZED (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind, ord) - 1 AS BIGINT) AS edge_seq,
  't' || CASE WHEN kind = 0 THEN msg_no - 1 ELSE msg_no END AS source, id AS target,
  CASE kind WHEN 0 THEN 'sequence' WHEN 1 THEN 'contains' WHEN 2 THEN 'references' ELSE 'mentions' END AS relation FROM placed WHERE kind > 0 OR msg_no > 0)"""


def _graph(select: str) -> str:
    return f"WITH {GRAPH_STEPS} {select}"


def _field(name: str, first: bool = False) -> str:
    comma = "" if first else ","
    return f"CASE WHEN {name} IS NULL THEN '' ELSE '{comma}\"{name}\":' || CAST(to_json({name}) AS VARCHAR) END"


_NODE_JSON = "'{' || " + " || ".join(_field(f, f == "id") for f in ("id", "type", "subtype", "role", "language", "content")) + " || '}'"
_EDGE_JSON = "'{' || " + " || ".join(_field(f, f == "source") for f in ("source", "target", "relation")) + " || '}'"
_JSON = f"""gj AS MATERIALIZED (SELECT conv_id, '{{"nodes":[' || ns || '],"edges":[' || coalesce(es, '') || ']}}' AS graph_json FROM
  (SELECT conv_id, string_agg({_NODE_JSON}, ',' ORDER BY node_seq) AS ns FROM node GROUP BY conv_id)
  LEFT JOIN (SELECT conv_id, string_agg({_EDGE_JSON}, ',' ORDER BY edge_seq) AS es FROM edge GROUP BY conv_id) USING (conv_id))"""


def _pretty(fields: tuple[str, ...]) -> str:
    parts = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '      \"{f}\": ' || CAST(to_json({f}) AS VARCHAR) END" for f in fields)
    return f"'    {{' || chr(10) || concat_ws(',' || chr(10), {parts}) || chr(10) || '    }}'"


_BREAK = "',' || chr(10)"
_CLIPBOARD = f"""SELECT conv_id, {_text(CLIPBOARD_PREAMBLE)} || '{{' || chr(10) || '  "nodes": [' || chr(10) || ns || chr(10) || '  ],' || chr(10) || '  "edges": ' ||
  CASE WHEN es IS NULL THEN '[]' ELSE '[' || chr(10) || es || chr(10) || '  ]' END || chr(10) || '}}' || chr(10) AS payload FROM
  (SELECT conv_id, string_agg({_pretty(("id", "type", "subtype", "role", "language", "content"))}, {_BREAK} ORDER BY node_seq) AS ns FROM node GROUP BY conv_id)
  LEFT JOIN (SELECT conv_id, string_agg({_pretty(("source", "target", "relation"))}, {_BREAK} ORDER BY edge_seq) AS es FROM edge GROUP BY conv_id) USING (conv_id)"""

_COUNTS = "SELECT conv_id, CAST(n AS BIGINT) AS nodes, CAST(coalesce(e, 0) AS BIGINT) AS edges FROM (SELECT conv_id, count(*) AS n FROM node GROUP BY 1) LEFT JOIN (SELECT conv_id, count(*) AS e FROM edge GROUP BY 1) USING (conv_id)"
_DEGREE = "SELECT conv_id, id, CAST(coalesce(d, 0) AS BIGINT) AS degree FROM node LEFT JOIN (SELECT conv_id, id, count(*) AS d FROM (SELECT conv_id, source AS id FROM edge UNION ALL SELECT conv_id, target FROM edge) GROUP BY ALL) USING (conv_id, id)"
_TYPE = "CASE coalesce(nullif(role, ''), nullif(subtype, ''), nullif(type, ''), 'artifact') WHEN 'code' THEN 'artifact' ELSE coalesce(nullif(role, ''), nullif(subtype, ''), nullif(type, ''), 'artifact') END"

_FILTERED = f"""SELECT edge.* FROM edge JOIN (SELECT conv_id, id AS source, {_TYPE} AS s FROM node) USING (conv_id, source)
  JOIN (SELECT conv_id, id AS target, {_TYPE} AS t FROM node) USING (conv_id, target) WHERE s NOT IN ('link', 'artifact', 'system') AND t NOT IN ('link', 'artifact', 'system')"""


def _labels(rows: str, keys: str) -> str:
    """CTEs from rows(keys, text) to tl(keys, label)."""
    return f"""ident AS MATERIALIZED (SELECT {keys}, i, w FROM (SELECT {keys}, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (
   SELECT {keys}, regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b') AS ws FROM {rows})) WHERE NOT (length(w) <= 3 AND w = lower(w))),
  points AS (SELECT {keys}, lower(w) AS w, min(i) AS i, sum(5 + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 10 ELSE 0 END
   + CASE WHEN regexp_matches(w, '[0-9_]') OR (regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]')) THEN 15 ELSE 0 END + least(length(w), 10)) AS s FROM ident GROUP BY {keys}, lower(w)),
  best AS (SELECT {keys}, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY n) AS label FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, i) AS n FROM points) WHERE n <= 2 GROUP BY {keys}),
  tl AS MATERIALIZED (SELECT {keys}, coalesce(label, left(array_to_string(string_split(text, ' ')[1:2], ' '), 20)) AS label FROM {rows} LEFT JOIN best USING ({keys}))"""


_HOST = "lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:\\s]+)', 1))"
_PATH = "regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:\\s]+(?::[0-9]*)?/+([^/?#]+)', 1)"
_URL = """CASE WHEN domain IN ('github', 'google', 'wikipedia', 'npmjs', 'youtube') AND seg <> '' THEN upper(seg[1]) || seg[2:] ELSE upper(domain[1]) || domain[2:] END"""


def _url_parts(rows: str, keys: str) -> str:
    return f"""up AS MATERIALIZED (SELECT {keys}, host, seg, CASE WHEN len(parts) > 1 THEN parts[-2] ELSE parts[1] END AS domain FROM (
   SELECT {keys}, host, seg, string_split(regexp_replace(host, '^www\\.', ''), '.') AS parts FROM (SELECT {keys}, {_HOST} AS host, {_PATH} AS seg FROM {rows})))"""


_PAGE_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1))"
_CONFIG = lambda chat, claude: f"CASE WHEN contains(h, 'chatgpt.com') OR contains(h, 'chat.openai.com') THEN {chat} WHEN contains(h, 'claude.ai') THEN {claude} END"
_TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

ORACLES = {
    "read_messages": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, role, text AS content FROM conversations WHERE role <> 'system'",
    "latest_snapshot": """SELECT conv_id, extracted_at, graph_json FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY extracted_at DESC, graph_json DESC) AS n FROM (
      SELECT conv_id, turn % 4 AS extracted_at, turn || ':' || text AS graph_json FROM conversations)) WHERE n = 1""",
    "read_graph_json_nodes": _graph("SELECT * FROM node"),
    "read_graph_json_edges": _graph("SELECT * FROM edge"),
    "graph_json": f"WITH {GRAPH_STEPS}, {_JSON} SELECT * FROM gj",
    "rejected_payloads": """SELECT DISTINCT conv_id, CASE conv_id % 7 WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'no payload' WHEN 3 THEN 'no messages' WHEN 4 THEN 'no roles' END AS reason
      FROM conversations WHERE conv_id % 7 BETWEEN 1 AND 4""",
    "stored_graph_nodes": _graph("SELECT * FROM node"),
    "graph_json_or_reason": f"""WITH {GRAPH_STEPS}, {_JSON} SELECT conv_id, CASE WHEN n <= {JSON_NODES} THEN graph_json END AS graph_json, n AS nodes, CASE WHEN n > {JSON_NODES} THEN 'Graph too large: ' || n || ' nodes' END AS reason
      FROM (SELECT conv_id, count(*) AS n FROM node GROUP BY 1) JOIN gj USING (conv_id)""",
    "extraction_outcome": """SELECT page_id, CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS message_count, CASE WHEN n IS NULL THEN 'No conversation found on this page' END AS reason
      FROM pages LEFT JOIN (SELECT conv_id AS page_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (page_id)""",
    "detect_platform": f"""SELECT page_id, CASE WHEN contains(h, 'chat.openai') OR contains(h, 'chatgpt') THEN 'chatgpt' WHEN contains(h, 'claude') THEN 'claude' WHEN contains(h, 'gemini') THEN 'gemini' ELSE 'generic' END AS platform
      FROM (SELECT page_id, {_PAGE_HOST} AS h FROM pages)""",
    "platform_config": f"""SELECT page_id, {_CONFIG("'main'", "'.flex-1.overflow-y-auto, main'")} AS container,
      {_CONFIG("'[data-message-author-role]'", "'[data-is-streaming], .font-claude-message, .font-user-message'")} AS message_block,
      {_CONFIG("'data-message-author-role'", "NULL")} AS role_attribute FROM (SELECT page_id, {_PAGE_HOST} AS h FROM pages)""",
    "resolve_role": """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(role), 'user|human') THEN 'user' WHEN regexp_matches(lower(role), 'assistant|model|bot|system') THEN 'assistant' WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM conversations""",
    "parse_transcript": f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, content
      FROM (SELECT conv_id, turn, role, {_TRIMMED} AS content FROM conversations) WHERE content <> ''""",
    "task_summary": f"WITH {MESSAGES}, {SUMMARIES} SELECT * FROM sums",
    "code_blocks": f"WITH {MESSAGES}, {BLOCKS} SELECT * FROM blocks",
    "links": f"WITH {MESSAGES}, {LINKS} SELECT * FROM link",
    "bold_terms": f"""WITH {MESSAGES} SELECT conv_id, turn, CAST(unnest(range(len(t))) AS BIGINT) AS ord, unnest(t) AS term FROM (
      SELECT conv_id, turn, list_filter(regexp_extract_all(content, '(?s)\\*\\*(.*?)\\*\\*', 1), lambda x: x <> '' AND octet_length(encode(x)) < 80) AS t FROM msg)""",
    "document_bold_terms": """SELECT doc_id, CAST(unnest(range(len(t))) AS BIGINT) AS ord, unnest(t) AS term FROM (
      SELECT doc_id, list_filter(regexp_extract_all(text, '(?s)\\*\\*(.*?)\\*\\*', 1), lambda x: x <> '' AND octet_length(encode(x)) < 80) AS t FROM documents)""",
    "remove_stopwords": f"WITH {MESSAGES}, {WORDS} SELECT * FROM kept",
    "stem_words": f"WITH {MESSAGES}, {WORDS}, {STEMS} SELECT word, b AS stem FROM s9",
    "tokens": f"WITH {TOKEN_STEPS} SELECT * FROM tok",
    "cooccurrence": f"WITH {TOKEN_STEPS}, {PAIRS} SELECT * FROM pair",
    "textrank_scores": f"WITH {TOKEN_STEPS}, {PAIRS}, {RANKS} SELECT conv_id, turn, stem, round(score, 6) AS score FROM r{ROUNDS}",
    "top_stems": f"WITH {TOKEN_STEPS}, {PAIRS}, {RANKS}, {TOP} SELECT conv_id, turn, rank, stem FROM top",
    "surface_forms": f"WITH {TOKEN_STEPS}, {FORMS} SELECT * FROM form",
    "keyword_phrases": f"WITH {RANK_STEPS} SELECT conv_id, turn, phrase, key FROM word",
    "keywords": f"WITH {RANK_STEPS} SELECT conv_id, turn, ord, phrase FROM word",
    "document_cooccurrence": f"WITH {DOCUMENT_TOKENS}, {PAIRS} SELECT conv_id AS doc_id, src, dst, weight FROM pair",
    "textrank_by_joins": f"WITH {TOKEN_STEPS}, {PAIRS}, {RANKS} SELECT conv_id, turn, stem, round(score, 6) AS score FROM r{ROUNDS}",
    "document_textrank_scores": f"WITH {DOCUMENT_TOKENS}, {PAIRS}, {RANKS} SELECT conv_id AS doc_id, stem, round(score, 6) AS score FROM r{ROUNDS}",
    "document_keywords": f"WITH {DOCUMENT_STEPS} SELECT conv_id AS doc_id, ord, phrase FROM word",
    "task_nodes": _graph("SELECT conv_id, node_seq, id, role, content FROM node WHERE type = 'task'"),
    "sequence_edges": _graph("SELECT * FROM edge WHERE relation = 'sequence'"),
    "code_nodes": _graph("SELECT conv_id, node_seq, id, subtype, language, content FROM node WHERE subtype = 'code'"),
    "contains_edges": _graph("SELECT * FROM edge WHERE relation = 'contains'"),
    "link_nodes": _graph("SELECT conv_id, node_seq, id, subtype, language, content FROM node WHERE subtype = 'link'"),
    "references_edges": _graph("SELECT * FROM edge WHERE relation = 'references'"),
    "entity_registry": _graph("SELECT conv_id, key AS entity_key, id AS node_id, content AS phrase FROM placed WHERE kind = 3 AND fresh"),
    "mentions_edges": _graph("SELECT * FROM edge WHERE relation = 'mentions'"),
    "artifact_ids": _graph("SELECT conv_id, node_seq, id FROM node WHERE type = 'artifact'"),
    "graph_nodes": _graph("SELECT * FROM node"),
    "graph_edges": _graph("SELECT * FROM edge"),
    "graph_counts": _graph(_COUNTS),
    "clustered_graph_counts": _graph(_COUNTS),
    "node_degree": _graph(_DEGREE),
    "clustered_node_degree": _graph(_DEGREE),
    "display_type": _graph(f"SELECT conv_id, id, {_TYPE} AS display_type FROM node"),
    "text_label": f"WITH {MESSAGES}, src AS (SELECT conv_id, turn, content AS text FROM msg), {_labels('src', 'conv_id, turn')} SELECT * FROM tl",
    "url_label": f"WITH {MESSAGES}, {LINKS}, {_url_parts('link', 'conv_id, turn, ord')} SELECT conv_id, turn, ord, {_URL} AS label FROM up",
    "node_labels": f"""WITH {GRAPH_STEPS}, typed AS MATERIALIZED (SELECT conv_id, id, {_TYPE} AS display_type, content AS text, content AS link FROM node), {_labels('typed', 'conv_id, id')}, {_url_parts('typed', 'conv_id, id')}
      SELECT conv_id, id, display_type, CASE WHEN text = '' THEN upper(display_type[1]) || display_type[2:] WHEN display_type = 'link' AND host <> '' THEN {_URL} ELSE label END AS label
      FROM typed JOIN tl USING (conv_id, id) JOIN up USING (conv_id, id)""",
    "edge_elements": _graph("SELECT conv_id, source || '-' || target || '-' || edge_seq AS id, source, target, relation AS label FROM edge"),
    "filter_graph_nodes": _graph("SELECT * FROM node WHERE coalesce(subtype, '') <> 'variable'"),
    "filter_graph_edges": _graph("SELECT * FROM edge WHERE relation <> 'mentions'"),
    "filter_types_nodes": _graph(f"SELECT * FROM node WHERE {_TYPE} NOT IN ('link', 'artifact', 'system')"),
    "filter_types_edges": _graph(_FILTERED),
    "clustered_filter_edges": _graph(_FILTERED),
    "graph_stream_nodes": _graph("SELECT * FROM node"),
    "graph_stream_edges": _graph("SELECT * FROM edge"),
    "inject_payload": f"WITH {GRAPH_STEPS}, {_JSON} SELECT conv_id, {_text(INJECT_PREAMBLE)} || graph_json AS payload FROM gj",
    "clipboard_payload": _graph(_CLIPBOARD),
    "route_payloads": """SELECT conv_id, target, platform, CASE asked WHEN 'chatgpt' THEN 'https://chatgpt.com/' WHEN 'claude' THEN 'https://claude.ai/new' WHEN 'gemini' THEN 'https://gemini.google.com/app' END AS url,
      CASE WHEN asked = 'other' THEN 'error' ELSE 'ok' END AS status, CASE WHEN asked = 'other' THEN 'Unknown platform: other' END AS reason FROM (
      SELECT conv_id, target, 'claude' AS platform, coalesce(target, 'claude') AS asked FROM (
      SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'other' END AS target FROM conversations WHERE turn = 0))""",
}
