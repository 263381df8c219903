"""Queries on the validators.  Each stand-in table is one SQL text, valid in both engines, with faults planted by number;
the validators find them with DataFrames, the statements beside them with conditions written out."""

from __future__ import annotations

from ..operators import validate
from .common import table

_Q = "CAST({} AS STRING)"
_FOUR = "(SELECT 0 AS m UNION ALL SELECT 1 AS m UNION ALL SELECT 2 AS m UNION ALL SELECT 3 AS m)"


def _view(spark, d, text):
    names = ("documents", "conversations", "nation", "supplier")
    return spark.sql(text, **{n: table(spark, d, n) for n in names if "{" + n + "}" in text})


def _sql(text: str) -> str:
    return text.format(documents="documents", conversations="conversations", nation="nation", supplier="supplier")


def _ctes(**views: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_sql(t)})" for n, t in views.items())


def _rules(rows: str, key: str, rules: dict[str, str]) -> str:
    """Rows that break a rule (null breaks it)."""
    return " UNION ALL ".join(f"SELECT '{c}' AS code, {key} AS key FROM {rows} WHERE ({r}) IS NOT TRUE" for c, r in rules.items())


def _dup(rows: str, key: str, code: str = "E-DUP") -> str:
    return f"SELECT '{code}' AS code, {key} AS key FROM {rows} GROUP BY ALL HAVING count(*) > 1"


def _shown(found):
    return found.select("code", "key")


_K3 = "scenario || '|' || question || '|' || mode"

# --- annotations ---
_ANN = f"""SELECT source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN n % 47 = 0 THEN 'C9' WHEN m = 3 THEN 'FULL_HISTORY' ELSE 'C' || CAST(m AS STRING) END AS mode, reachable,
  CASE WHEN m = 3 THEN CASE WHEN n % 31 = 0 THEN true END WHEN reachable THEN doc_id % 2 = 0 WHEN n % 29 = 0 THEN false END AS retrieval_success,
  CASE WHEN n % 37 = 0 THEN 'unknown' WHEN n % 5 = 0 THEN 'complete' WHEN n % 5 = 1 THEN 'partial' WHEN n % 5 = 2 THEN 'incorrect' ELSE 'correct_abstention' END AS answer_class,
  CASE WHEN n % 41 = 0 THEN 'other' WHEN n % 43 = 0 OR NOT reachable THEN 'abstention' ELSE 'complete_answer' END AS expected_behavior
FROM (SELECT source, doc_id, m, doc_id * 4 + m AS n, doc_id % 3 <> 0 AND m > 0 AS reachable FROM {{documents}} CROSS JOIN {_FOUR} f
  UNION ALL SELECT source, doc_id, 1, doc_id * 4 + 1, doc_id % 3 <> 0 FROM {{documents}} WHERE doc_id % 73 = 0) x"""
_RET = f"""SELECT source AS scenario, CAST(doc_id AS STRING) AS question, 'C' || CAST(m AS STRING) AS mode, CASE WHEN doc_id % 59 = 0 THEN false ELSE doc_id % 3 <> 0 AND m > 0 END AS reachable,
  CASE WHEN doc_id % 3 <> 0 AND m > 0 THEN doc_id % 2 = 0 AND doc_id % 61 <> 0 END AS retrieval_success FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < 3 AND doc_id % 53 <> 0"""
_INP = f"""SELECT source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN m = 3 THEN 'FULL_HISTORY' ELSE 'C' || CAST(m AS STRING) END AS mode, doc_id % 3 <> 0 AND m > 0 AS reachable,
  CASE WHEN m < 3 AND doc_id % 3 <> 0 AND m > 0 THEN doc_id % 2 = 0 END AS retrieval_success FROM {{documents}} CROSS JOIN {_FOUR} f WHERE doc_id % 67 <> 0
UNION ALL SELECT source, 'extra' || CAST(doc_id AS STRING), 'C0', false, NULL FROM {{documents}} WHERE doc_id % 71 = 0"""
PER_MODE = 14


def validate_annotations(spark, d):
    """Annotations in themselves, in number, and against the retrieval and the inputs."""
    return _shown(validate.annotations(_view(spark, d, _ANN), _view(spark, d, _RET), _view(spark, d, _INP), PER_MODE))


def _against(rows: str, source: str, missing: str, match: str, fields: list[str], extra: str = "", key: str = "scenario, question, mode", show: str = _K3) -> str:
    on = f"USING ({key})"
    pre = show if extra else show
    parts = [f"SELECT '{missing}' AS code, {pre} AS key FROM {rows} a LEFT JOIN (SELECT *, 1 AS there FROM {source}) b {on} WHERE there IS NULL"]
    parts += [f"SELECT '{match}', {pre} FROM {rows} a JOIN {source} b {on} WHERE a.{f} IS DISTINCT FROM b.{f}" for f in fields]
    if extra:
        parts.append(f"SELECT '{extra}', {pre} FROM {source} b LEFT JOIN (SELECT *, 1 AS there FROM {rows}) a {on} WHERE there IS NULL")
    return " UNION ALL ".join(parts)


_KNOWN = "mode NOT IN ('C0', 'C1', 'C2', 'FULL_HISTORY') OR"
_ANN_SQL = f"""{_ctes(ann=_ANN, ret=_RET, inp=_INP)}, con AS (SELECT * FROM ann WHERE mode IN ('C0', 'C1', 'C2'))
{_rules('ann', _K3, {
    'E-VALUE': "mode IN ('C0', 'C1', 'C2', 'FULL_HISTORY')", 'E-VALUE-CLASS': f"{_KNOWN} answer_class IN ('complete', 'partial', 'incorrect', 'correct_abstention')", 'E-VALUE-BEHAVIOR': f"{_KNOWN} expected_behavior IN ('complete_answer', 'abstention')",
    'E-RETRIEVAL-NULL': f"{_KNOWN} reachable OR retrieval_success IS NULL", 'E-DIAGNOSTIC': f"{_KNOWN} mode <> 'FULL_HISTORY' OR retrieval_success IS NULL", 'E-ABSTENTION': f"{_KNOWN} answer_class <> 'correct_abstention' OR NOT reachable",
    'E-EXPECTED': f"{_KNOWN} expected_behavior NOT IN ('complete_answer', 'abstention') OR expected_behavior = CASE WHEN reachable THEN 'complete_answer' ELSE 'abstention' END"})}
UNION ALL SELECT 'E-DUP', {_K3} FROM ann GROUP BY scenario, question, mode HAVING count(*) > 1
UNION ALL SELECT 'E-COUNT', m FROM (VALUES ('C0'), ('C1'), ('C2'), ('FULL_HISTORY')) v(m) WHERE (SELECT count(*) FROM ann WHERE mode = m) <> {PER_MODE}
UNION ALL {_against('con', 'ret', 'E-RETRIEVAL-MISSING', 'E-RETRIEVAL-MATCH', ['reachable', 'retrieval_success'])}
UNION ALL {_against('ann', 'inp', 'E-INPUT-MISSING', 'E-INPUT-MATCH', ['reachable', 'retrieval_success'], 'E-INPUT-MISSING')}"""

# --- scenarios ---
_SES = """SELECT scenario, session, place, CASE WHEN (c * 7 + s) % 19 = 0 THEN place + 1 ELSE place END AS ord FROM (
  SELECT CAST(c AS STRING) AS scenario, CAST(c AS STRING) || '-S' || CAST(s AS STRING) AS session, c, s, row_number() OVER (PARTITION BY c ORDER BY s) AS place
  FROM (SELECT DISTINCT conv_id AS c, CAST(floor(turn / 2) AS BIGINT) AS s FROM {conversations}) x) y"""
_MES = """SELECT CAST(conv_id AS STRING) AS scenario, CAST(conv_id AS STRING) || '-S' || CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING) AS session,
  CAST(conv_id AS STRING) || '-m' || CAST(CASE WHEN (conv_id + turn) % 41 = 0 THEN 0 ELSE turn END AS STRING) AS message, turn % 2 + 1 AS place, CASE WHEN (conv_id + turn) % 23 = 0 THEN 3 ELSE turn % 2 + 1 END AS ord,
  role, CASE WHEN (conv_id + turn) % 29 = 0 THEN ' ' ELSE text END AS content,
  CAST(conv_id AS STRING) || '-S' || CAST(CAST(floor((CASE WHEN (conv_id + turn) % 31 = 0 THEN turn + 2 ELSE turn END) / 2) AS BIGINT) AS STRING) AS declared FROM {conversations}"""
_PER = f"""SELECT scenario, 'C2' AS condition, session FROM ({_SES}) a WHERE length(session) % 4 <> 3 OR place > 1
UNION ALL SELECT scenario, 'C1', max(session) FROM ({_SES}) b GROUP BY scenario
UNION ALL SELECT DISTINCT CAST(conv_id AS STRING), 'C0', 'nowhere' FROM {{conversations}} WHERE conv_id % 17 = 0"""
SESSIONS = 3


def _scenario(spark, d):
    up = lambda x: x.withColumnRenamed("ord", "order")
    return up(_view(spark, d, _SES)), up(_view(spark, d, _MES)), _view(spark, d, _PER)


def validate_scenario(spark, d):
    """Sessions, messages and perimeters of conversations."""
    return _shown(validate.scenario(*_scenario(spark, d), SESSIONS))


_SK = "scenario || '|' || session"
_SCE_SQL = f"""{_ctes(ses=_SES, mes=_MES, per=_PER)}, canon AS (SELECT scenario, 'C1' AS condition, arg_max(session, place) AS session FROM ses GROUP BY scenario UNION ALL SELECT scenario, 'C2', session FROM ses)
SELECT 'E-COUNT' AS code, scenario AS key FROM ses GROUP BY scenario HAVING count(*) <> {SESSIONS}
UNION ALL {_rules('ses', _SK, {'E-ORDER': 'ord = place'})}
UNION ALL SELECT 'E-COUNT-MESSAGES', {_SK} FROM ses WHERE (scenario, session) NOT IN (SELECT scenario, session FROM mes)
UNION ALL {_rules('mes', f"{_SK} || '|' || message", {'E-ORDER': 'ord = place', 'E-FIELD-ROLE': "role IN ('user', 'assistant')", 'E-FIELD-CONTENT': "trim(content) <> ''", 'E-EVIDENCE-SESSION': 'declared IS NOT DISTINCT FROM session'})}
UNION ALL SELECT 'E-DUP', {_SK} FROM ses GROUP BY scenario, session HAVING count(*) > 1
UNION ALL SELECT 'E-DUP', scenario || '|' || message FROM mes GROUP BY scenario, message HAVING count(*) > 1
UNION ALL SELECT 'E-PERIMETER-UNKNOWN', scenario || '|' || condition || '|' || session FROM per WHERE (scenario, session) NOT IN (SELECT scenario, session FROM ses)
UNION ALL SELECT 'E-PERIMETER', scenario || '|' || condition || '|' || session FROM per WHERE (scenario, condition, session) NOT IN (SELECT * FROM canon)
UNION ALL SELECT 'E-PERIMETER', scenario || '|' || condition || '|' || session FROM canon WHERE (scenario, condition, session) NOT IN (SELECT * FROM per)"""

# --- questions ---
CATEGORIES = ["fact", "change", "cross_session_link", "absent_information"]
_CAT = "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'fact' WHEN (conv_id + turn) % 5 = 1 THEN 'change' WHEN (conv_id + turn) % 5 = 2 THEN 'cross_session_link' WHEN (conv_id + turn) % 5 = 3 THEN 'absent_information' ELSE CASE WHEN (conv_id + turn) % 10 = 4 THEN 'other' ELSE 'fact' END END"
_QUE = f"""SELECT CAST(conv_id AS STRING) AS scenario, CAST(turn AS STRING) AS question, {_CAT} AS category, CASE WHEN (conv_id + turn) % 37 = 0 THEN '' ELSE text END AS text, ({_CAT}) <> 'absent_information' OR conv_id % 7 = 0 AS present,
  CASE WHEN conv_id % 2 = 0 THEN 'not given' END AS note, false AS c0, (conv_id + turn) % 2 = 0 AS c1, (conv_id + turn) % 11 <> 0 AS c2 FROM {{conversations}} WHERE role = 'user'
UNION ALL SELECT CAST(conv_id AS STRING), CAST(turn AS STRING), 'fact', text, true, NULL, false, false, false FROM {{conversations}} WHERE role = 'user' AND (conv_id + turn) % 43 = 0"""
_EVI = """SELECT CAST(conv_id AS STRING) AS scenario, CAST(turn AS STRING) AS question, CAST(conv_id AS STRING) || '-m' || CAST(turn - 1 AS STRING) AS message FROM {conversations} WHERE role = 'user' AND (conv_id + turn) % 5 <> 3
UNION ALL SELECT CAST(conv_id AS STRING), CAST(turn AS STRING), CAST(conv_id AS STRING) || '-m' || CAST(turn - 3 AS STRING) FROM {conversations} WHERE role = 'user' AND (conv_id + turn) % 3 = 0
UNION ALL SELECT CAST(conv_id AS STRING), CAST(turn AS STRING), CAST(conv_id AS STRING) || '-m' || CAST(turn - 1 AS STRING) FROM {conversations} WHERE role = 'user' AND (conv_id + turn) % 13 = 0"""
_CLEAN = "SELECT DISTINCT CAST(conv_id AS STRING) AS scenario, CAST(conv_id AS STRING) || '-m' || CAST(turn AS STRING) AS message, CAST(conv_id AS STRING) || '-S' || CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING) AS session FROM {conversations}"
_TOT = "SELECT CAST(conv_id AS STRING) AS scenario, condition, CAST(conv_id % 3 AS BIGINT) AS n FROM (SELECT DISTINCT conv_id FROM {conversations}) x CROSS JOIN (SELECT 'C1' AS condition UNION ALL SELECT 'C2' AS condition) c"


def validate_questions(spark, d):
    """Questions, their evidence and the reachability that they declare."""
    v = lambda t: _view(spark, d, t)
    return _shown(validate.questions(v(_QUE), v(_EVI), v(_CLEAN), v(_PER), CATEGORIES, v(_TOT)))


_QK = "scenario || '|' || question"
_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)
_QUE_SQL = f"""{_ctes(que=_QUE, evi=_EVI, cle=_CLEAN, per=_PER, tot=_TOT)},
  ev AS (SELECT evi.*, session FROM evi LEFT JOIN cle USING (scenario, message)),
  hs AS (SELECT *, (scenario, question) IN (SELECT scenario, question FROM evi) AS has FROM que),
  gr AS (SELECT *, present AND EXISTS (SELECT 1 FROM ev WHERE ev.scenario = g.scenario AND ev.question = g.question AND session IS NOT NULL)
      AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.scenario = g.scenario AND ev.question = g.question AND session IS NOT NULL AND (g.scenario, g.condition, session) NOT IN (SELECT * FROM per)) AS computed
    FROM (SELECT scenario, question, present, 'C0' AS condition, c0 AS declared FROM que UNION ALL SELECT scenario, question, present, 'C1', c1 FROM que UNION ALL SELECT scenario, question, present, 'C2', c2 FROM que) g),
  co AS (SELECT scenario, condition, count(*) AS n FROM gr WHERE declared GROUP BY ALL)
SELECT 'E-DUP' AS code, {_QK} AS key FROM que GROUP BY scenario, question HAVING count(*) > 1
UNION ALL SELECT 'E-DUP-EVIDENCE', {_QK} || '|' || message FROM evi GROUP BY scenario, question, message HAVING count(*) > 1
UNION ALL {_rules('hs', _QK, {'E-CATEGORY': f'category IN ({_CATS})', 'E-FIELD': "trim(text) <> ''", 'E-ABSENT': "(category = 'absent_information') <> present", 'E-ABSENT-EVIDENCE': 'present = has', 'E-ABSENT-NOTE': "present OR trim(coalesce(note, '')) <> ''"})}
UNION ALL SELECT 'E-EVIDENCE-MISSING', {_QK} || '|' || message FROM ev WHERE session IS NULL
UNION ALL SELECT 'E-REACH', {_QK} || '|' || condition FROM gr WHERE declared <> computed
UNION ALL SELECT 'E-CROSS', {_QK} FROM que WHERE category = 'cross_session_link' AND (SELECT count(DISTINCT session) FROM ev WHERE ev.scenario = que.scenario AND ev.question = que.question) < 2
UNION ALL SELECT 'E-CATEGORY-MISSING', s.scenario || '|' || c FROM (SELECT DISTINCT scenario FROM que) s CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}) v(c) WHERE (s.scenario, c) NOT IN (SELECT scenario, category FROM que)
UNION ALL {_against('tot', 'co', 'E-COVERAGE', 'E-COVERAGE', ['n'], 'E-COVERAGE', 'scenario, condition', "scenario || '|' || condition")}"""

# --- operations, states ---
_BASE = "SELECT source AS scenario, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM {documents}"
_OPS = f"""SELECT scenario, place, 'op' || CAST(CASE WHEN doc_id % 79 = 0 THEN doc_id + 20 ELSE doc_id END AS STRING) AS op, CASE WHEN doc_id % 9 = 0 THEN 'MOVE' WHEN doc_id % 4 = 0 THEN 'ADD' WHEN doc_id % 4 = 1 THEN 'UPDATE' WHEN doc_id % 4 = 2 THEN 'DELETE' ELSE CASE WHEN scenario = 'src3' THEN 'ADD' ELSE 'NOOP' END END AS kind,
  'k' || CAST(doc_id % 3 AS STRING) AS claim_key, CAST(floor(place / 4) AS BIGINT) - CASE WHEN doc_id % 31 = 0 THEN 2 ELSE 0 END AS session_order,
  CASE WHEN doc_id % 4 IN (1, 2) AND doc_id % 11 <> 0 OR doc_id % 23 = 0 THEN 'op' || CAST(doc_id - CASE WHEN doc_id % 2 = 0 THEN 60 ELSE 20 END AS STRING) END AS supersedes,
  CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE 'm' || CAST(doc_id AS STRING) END AS message FROM ({_BASE}) b"""
_OPM = f"SELECT scenario, 'm' || CAST(doc_id AS STRING) AS message, CAST(floor(place / 4) AS BIGINT) AS session_order FROM ({_BASE}) b"
_STA = f"""SELECT scenario, 'e' || CAST(doc_id AS STRING) AS entry, 'k' || CAST(CASE WHEN doc_id % 50 = 0 THEN 9 ELSE doc_id % 2 END AS STRING) AS claim_key, CASE WHEN doc_id % 4 = 0 THEN 'attivo' WHEN doc_id % 4 = 1 THEN 'superato' WHEN doc_id % 4 = 2 THEN 'ritirato' ELSE 'altro' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'op' || CAST(doc_id AS STRING) WHEN doc_id % 7 = 0 THEN 'op-1' END AS superseded_by FROM ({_BASE}) b"""


def validate_operations(spark, d):
    """Expected operations: kinds, targets, order and provenance."""
    return _shown(validate.operations(_view(spark, d, _OPS), _view(spark, d, _OPM)))


def validate_state(spark, d):
    """Expected entries against the operations."""
    return _shown(validate.expected_state(_view(spark, d, _STA), _view(spark, d, _OPS)))


_OK = "scenario || '|' || op"
_OPS_SQL = f"""{_ctes(ops=_OPS, opm=_OPM)},
  x AS (SELECT o.*, p.claim_key AS pk, p.op IS NOT NULL AS there, m.session_order AS mo, lag(o.session_order) OVER (PARTITION BY o.scenario ORDER BY o.place) AS bef
    FROM ops o LEFT JOIN ops p ON p.scenario = o.scenario AND p.op = o.supersedes LEFT JOIN opm m ON m.scenario = o.scenario AND m.message = o.message)
SELECT 'E-DUP' AS code, {_OK} AS key FROM ops GROUP BY scenario, op HAVING count(*) > 1
UNION ALL {_rules('x', _OK, {'E-OPS-KIND': "kind IN ('ADD', 'UPDATE', 'DELETE', 'NOOP')", 'E-OPS-TARGET': "kind NOT IN ('UPDATE', 'DELETE') OR supersedes IS NOT NULL", 'E-OPS-NO-TARGET': "kind NOT IN ('ADD', 'NOOP') OR supersedes IS NULL", 'E-OPS-UNKNOWN': 'supersedes IS NULL OR there', 'E-OPS-KEY': 'NOT there OR pk = claim_key', 'E-OPS-ORDER': 'bef IS NULL OR bef <= session_order', 'E-PROVENANCE': 'mo IS NOT NULL', 'E-PROVENANCE-SESSION': 'mo IS NULL OR mo = session_order'})}
UNION ALL SELECT 'E-OPS', s.scenario || '|' || k FROM (SELECT DISTINCT scenario FROM ops) s CROSS JOIN (VALUES ('ADD'), ('UPDATE'), ('DELETE'), ('NOOP')) v(k) WHERE (s.scenario, k) NOT IN (SELECT scenario, kind FROM ops)"""
_STA_SQL = f"""{_ctes(sta=_STA, ops=_OPS)}, x AS (SELECT *, superseded_by IS NULL OR (scenario, superseded_by) IN (SELECT scenario, op FROM ops) AS known FROM sta)
{_rules('x', "scenario || '|' || entry", {'E-STATE': "status IN ('attivo', 'superato', 'ritirato')", 'E-STATE-ACTIVE': "status <> 'attivo' OR superseded_by IS NULL", 'E-STATE-BY': "status NOT IN ('superato', 'ritirato') OR superseded_by IS NOT NULL", 'E-STATE-UNKNOWN': 'known'})}
UNION ALL SELECT DISTINCT 'E-STATE-CLAIM', scenario || '|' || claim_key FROM ops WHERE (scenario, claim_key) NOT IN (SELECT scenario, claim_key FROM sta)
UNION ALL SELECT DISTINCT 'E-STATE-CLAIM', scenario || '|' || claim_key FROM sta WHERE (scenario, claim_key) NOT IN (SELECT scenario, claim_key FROM ops)"""

# --- graph annotations ---
_ENT = "SELECT CAST(n_regionkey AS STRING) AS scenario, n_name AS entity FROM {nation} UNION ALL SELECT CAST(n_regionkey AS STRING), n_name FROM {nation} WHERE n_nationkey % 12 = 5"
_REL = "SELECT CAST(a.n_regionkey AS STRING) AS scenario, 'r' || CAST(CASE WHEN s_suppkey % 29 = 3 THEN s_suppkey + 1000000 ELSE s_suppkey END AS STRING) AS relation, a.n_name AS subject, b.n_name AS object, s_suppkey % 7 AS n_sources FROM {supplier} JOIN {nation} a ON a.n_nationkey = s_nationkey JOIN {nation} b ON b.n_nationkey = (s_nationkey + 5) % 25"
_CHA = "SELECT CAST(n_regionkey AS STRING) AS scenario, 'q' || CAST(CAST(floor(s_suppkey / 4) AS BIGINT) AS STRING) AS question, s_suppkey AS place, 'r' || CAST(s_suppkey AS STRING) AS relation FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"


def validate_graph(spark, d):
    """Entities, relations and explanatory chains."""
    return _shown(validate.graph_annotation(_view(spark, d, _ENT), _view(spark, d, _REL), _view(spark, d, _CHA)))


_GRA_SQL = f"""{_ctes(ent=_ENT, rel=_REL, cha=_CHA)},
  nx AS (SELECT c.*, r.subject, r.object, lead(c.relation) OVER w AS nr, lead(r.subject) OVER w AS ns, lead(r.object) OVER w AS no FROM cha c LEFT JOIN rel r USING (scenario, relation) WINDOW w AS (PARTITION BY c.scenario, c.question ORDER BY c.place))
SELECT 'E-DUP-ENTITY' AS code, scenario || '|' || entity AS key FROM ent GROUP BY scenario, entity HAVING count(*) > 1
UNION ALL SELECT 'E-DUP', scenario || '|' || relation FROM rel GROUP BY scenario, relation HAVING count(*) > 1
UNION ALL SELECT 'E-GRAPH', scenario || '|' || relation || '|' || e FROM (SELECT scenario, relation, unnest([subject, object]) AS e FROM rel) WHERE (scenario, e) NOT IN (SELECT scenario, entity FROM ent)
UNION ALL SELECT 'E-GRAPH-SOURCE', scenario || '|' || relation FROM rel WHERE n_sources <= 0
UNION ALL SELECT 'E-GRAPH-UNKNOWN', scenario || '|' || question || '|' || relation FROM nx WHERE subject IS NULL
UNION ALL SELECT 'E-GRAPH-CHAIN', scenario || '|' || question || '|' || relation || '|' || nr FROM nx WHERE subject IS NOT NULL AND ns IS NOT NULL AND subject NOT IN (ns, no) AND object NOT IN (ns, no)"""

# --- inputs ---
_PROMPT = "'Context:' || chr(10) || context || chr(10) || CASE WHEN doc_id % 27 = 0 THEN 'Question: again ' ELSE '' END || CASE WHEN doc_id % 21 = 0 THEN 'answer ' || CAST(doc_id AS STRING) ELSE '' END || chr(10) || 'Question: ' || qt || CASE WHEN doc_id % 33 = 0 THEN '!' ELSE '' END"
_GBASE = f"SELECT source AS scenario, CAST(doc_id AS STRING) AS question, CASE WHEN m = 0 THEN 'T' WHEN m = 1 THEN 'U' ELSE 'FULL_HISTORY' END AS mode, doc_id, m, text AS context, n_chars, 'what of ' || CAST(doc_id AS STRING) || '?' AS qt FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < 3"
_GIN = f"""SELECT scenario, question, mode, CASE WHEN doc_id % 15 = 0 THEN 'x' ELSE 'i' || question END AS item_ids, CAST(n_chars % 300 + CASE WHEN doc_id % 25 = 0 THEN 1 ELSE 0 END AS BIGINT) AS context_tokens, m < 2 OR doc_id % 35 = 0 AS budget_applies, m < 2 OR doc_id % 45 = 0 AS retrieval_used,
  {_PROMPT} AS prompt, qt AS question_text, 'answer ' || question AS expected_answer, CASE WHEN doc_id % 55 = 0 THEN 'already' END AS model_answer FROM ({_GBASE}) g WHERE doc_id % 65 <> 0"""
_GRE = f"""SELECT scenario, question, mode, 'i' || question AS item_ids, CAST(n_chars % 300 AS BIGINT) AS context_tokens, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(250 AS BIGINT) END AS budget, doc_id % 6 = 0 AS first_over,
  CASE WHEN doc_id % 75 = 0 THEN 'other line' ELSE context END AS context, CAST(n_chars % 300 + CASE WHEN doc_id % 85 = 0 THEN 2 ELSE 0 END AS BIGINT) AS counted FROM ({_GBASE}) g WHERE doc_id % 95 <> 0"""


def validate_generation_inputs(spark, d):
    """Prompts about to be sent against the saved retrieval."""
    return _shown(validate.generation_inputs(_view(spark, d, _GIN), _view(spark, d, _GRE)))


_FULL = "mode = 'FULL_HISTORY'"
_GIN_SQL = f"""{_ctes(gin=_GIN, gre=_GRE)},
  x AS (SELECT g.*, r.item_ids AS ri, r.context_tokens AS rt, budget, first_over, context, counted, r.item_ids IS NOT NULL AS there FROM gin g LEFT JOIN gre r USING (scenario, question, mode))
SELECT 'E-INPUT-MISSING' AS code, {_K3} AS key FROM gre WHERE (scenario, question, mode) NOT IN (SELECT scenario, question, mode FROM gin)
UNION ALL SELECT 'E-DUP', {_K3} FROM gin GROUP BY scenario, question, mode HAVING count(*) > 1
UNION ALL {_rules('x', _K3, {
    'E-RETRIEVAL-MISSING': 'there', 'E-CONTEXT': 'NOT there OR item_ids = ri', 'E-TOKENS': f'NOT there OR {_FULL} OR context_tokens = rt', 'E-RECOUNT': f'NOT there OR {_FULL} OR counted = context_tokens', 'E-BUDGET': f'NOT there OR {_FULL} OR budget IS NULL OR counted <= budget OR first_over',
    'E-UNLIMITED': f'NOT there OR {_FULL} OR budget IS NOT NULL OR (NOT budget_applies AND retrieval_used)', 'E-LINES': "NOT there OR contains(prompt, context)", 'E-FULL-HISTORY': f'NOT ({_FULL}) OR (NOT budget_applies AND NOT retrieval_used)',
    'E-LEAK': 'NOT contains(prompt, expected_answer)', 'E-ONE-QUESTION': "(length(prompt) - length(replace(prompt, 'Question:', ''))) = 9", 'E-LAST': 'ends_with(prompt, question_text)', 'E-ANSWER': 'model_answer IS NULL'})}"""

# --- evaluations ---
_EVA = f"""SELECT scenario, question, mode, CAST(n_chars % 300 AS BIGINT) AS context_tokens, 'i' || question AS item_ids, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(200 AS BIGINT) END AS budget, CASE WHEN doc_id % 77 = 0 THEN 'odd' WHEN doc_id % 3 = 0 THEN 'complete' WHEN doc_id % 3 = 1 THEN 'partial' ELSE 'incorrect' END AS answer_class,
  doc_id % 2 = 0 AS supported, doc_id % 6 = 0 AS counts, CASE WHEN doc_id % 39 = 0 THEN 'approved' ELSE 'proposed' END AS source, doc_id % 51 = 0 AS obsolete, CASE WHEN doc_id % 87 = 0 THEN 'm2' ELSE 'm1' END AS model FROM ({_GBASE}) g WHERE doc_id % 65 <> 0"""
_EAN = f"""SELECT scenario, question, mode, 'm1' AS model, CASE WHEN doc_id % 69 = 0 THEN '' ELSE 'a' END AS answer, CASE WHEN doc_id % 57 = 0 THEN 'timeout' END AS error FROM ({_GBASE}) g WHERE doc_id % 95 <> 0
UNION ALL SELECT scenario, question, mode, 'm9', 'a', NULL FROM ({_GBASE}) h WHERE doc_id % 99 = 1"""
_ERE = f"SELECT scenario, question, mode, CAST(n_chars % 300 + CASE WHEN doc_id % 63 = 0 THEN 1 ELSE 0 END AS BIGINT) AS context_tokens, CASE WHEN doc_id % 81 = 0 THEN 'z' ELSE 'i' || question END AS item_ids, CASE WHEN doc_id % 18 = 0 THEN NULL ELSE CAST(200 AS BIGINT) END AS budget FROM ({_GBASE}) g WHERE doc_id % 91 <> 0"
_ESU = f"SELECT scenario, mode, answer_class, count(*) + CASE WHEN scenario = 'src5' THEN 1 ELSE 0 END AS n FROM ({_EVA}) e WHERE scenario <> 'src7' OR mode <> 'T' GROUP BY scenario, mode, answer_class"
CLASSES = ["complete", "partial", "incorrect"]


def validate_evaluations(spark, d):
    """Evaluations against answers, retrieval and the published summary."""
    v = lambda t: _view(spark, d, t)
    return _shown(validate.evaluations(v(_EVA), v(_EAN), v(_ERE), v(_ESU), CLASSES, "m1"))


_EVA_SQL = f"""{_ctes(eva=_EVA, ean=_EAN, ere=_ERE, esu=_ESU)}, mine AS (SELECT scenario, mode, answer_class, count(*) AS n FROM eva GROUP BY ALL)
SELECT 'E-DUP' AS code, {_K3} AS key FROM eva GROUP BY scenario, question, mode HAVING count(*) > 1
UNION ALL SELECT 'E-DUP-ANSWER', {_K3} FROM ean GROUP BY scenario, question, mode HAVING count(*) > 1
UNION ALL {_rules('ean', _K3, {'E-CALL': 'error IS NULL', 'E-EMPTY': "answer <> ''", 'E-MODEL': "model = 'm1'"})}
UNION ALL {_against('eva', 'ean', 'E-ANSWER-MISSING', 'E-ANSWER-MATCH', ['model'], 'E-EVAL-MISSING')}
UNION ALL {_against('eva', 'ere', 'E-RETRIEVAL-MISSING', 'E-RETRIEVAL-MATCH', ['context_tokens', 'item_ids', 'budget'])}
UNION ALL {_rules('eva', _K3, {'E-COUNTS': "counts = (answer_class = 'complete' AND supported)", 'E-CLASS': "answer_class IN ('complete', 'partial', 'incorrect')", 'E-PROPOSED': "source = 'proposed'", 'E-OBSOLETE': "NOT obsolete OR answer_class <> 'complete'"})}
UNION ALL {_against('esu', 'mine', 'E-SUMMARY', 'E-SUMMARY', ['n'], 'E-SUMMARY', 'scenario, mode, answer_class', "scenario || '|' || mode || '|' || answer_class")}"""

# --- requests and plans ---
_REQ = f"""SELECT CAST(CASE WHEN doc_id % 83 = 0 THEN 0 ELSE doc_id END AS STRING) || '-' || CAST(m AS STRING) AS request, CASE WHEN doc_id % 17 = 0 THEN 'evaluation' WHEN doc_id < 40 THEN 'development' ELSE 'evaluation' END AS split, CASE WHEN m = 0 THEN 'sufficient' ELSE 'insufficient' END AS condition,
  doc_id AS episode, CAST(doc_id AS STRING) AS question, text || CASE WHEN doc_id % 19 = 0 THEN ' gemma3' ELSE '' END AS prompt, sha2_input, CASE WHEN m = 0 THEN 'a,t,b' WHEN doc_id % 29 = 0 THEN 'b,a' WHEN doc_id % 37 = 0 THEN 'a,t,b' ELSE 'a,b' END AS block, 't' AS target
FROM (SELECT doc_id, m, text, text || CASE WHEN doc_id % 19 = 0 THEN ' gemma3' ELSE '' END || CASE WHEN doc_id % 23 = 0 THEN '?' ELSE '' END AS sha2_input FROM {{documents}} CROSS JOIN {_FOUR} f WHERE m < 2) x"""
PER_CELL = {"development|sufficient": 40, "development|insufficient": 38, "evaluation|sufficient": 100}


def validate_requests(spark, d):
    """Requests: unique, in their split, in number, hashed, and paired."""
    r = _view(spark, d, _REQ).selectExpr("request", "split", "condition", "episode", "question", "prompt", "sha2(sha2_input, 256) AS prompt_sha256", "split(block, ',') AS members", "target")
    return _shown(validate.requests(r, {"development": (0, 39), "evaluation": (40, 10**12)}, PER_CELL, ["gemma3", "llama3"]))


_REQ_SQL = f"""{_ctes(req=_REQ)}, p AS (SELECT a.question, a.block AS f, b.block AS n FROM req a JOIN req b USING (question) WHERE a.condition = 'sufficient' AND b.condition = 'insufficient')
SELECT 'E-DUP' AS code, request AS key FROM req GROUP BY request HAVING count(*) > 1
UNION ALL SELECT 'E-DUP-QUESTION', split || '|' || condition || '|' || question FROM req GROUP BY split, condition, question HAVING count(*) > 1
UNION ALL SELECT 'E-COUNT', c FROM (VALUES {', '.join(f"('{c}', {n})" for c, n in PER_CELL.items())}) v(c, n) WHERE (SELECT count(*) FROM req WHERE split || '|' || condition = c) <> n
UNION ALL {_rules('req', 'request', {'E-SPLIT': "split = CASE WHEN episode < 40 THEN 'development' ELSE 'evaluation' END", 'E-MODEL': "NOT contains(prompt, 'gemma3') AND NOT contains(prompt, 'llama3')", 'E-HASH': 'prompt = sha2_input'})}
UNION ALL SELECT 'E-PAIR', question FROM p WHERE n <> 'a,b'"""

_CEL = "SELECT 'c' || CAST(doc_id AS STRING) AS cell, doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, lang || CAST(n_chars % 50 AS STRING) AS prompt_sha256 FROM {documents}"
_PLA = f"""SELECT cell, CASE WHEN pos % 89 = 0 THEN 'skip' WHEN first = pos THEN 'call' ELSE CASE WHEN pos % 43 = 0 THEN 'call' ELSE 'reuse' END END AS kind,
  CASE WHEN first <> pos AND pos % 43 <> 0 THEN 'c' || CAST(CASE WHEN pos % 31 = 0 THEN pos + 1 WHEN pos % 37 = 0 THEN -1 ELSE first END AS STRING) END AS reused_from
FROM (SELECT *, min(pos) OVER (PARTITION BY model, prompt_sha256) AS first FROM ({_CEL}) c) x WHERE pos % 97 <> 0
UNION ALL SELECT 'ghost' || CAST(doc_id AS STRING), 'call', NULL FROM {{documents}} WHERE doc_id % 101 = 0
UNION ALL SELECT cell, 'call', NULL FROM ({_CEL}) e WHERE pos % 103 = 5"""


def validate_reuse(spark, d):
    """A plan of calls and reuses against its cells."""
    return _shown(validate.reuse(_view(spark, d, _PLA), _view(spark, d, _CEL)))


_PLA_SQL = f"""{_ctes(cel=_CEL, pla=_PLA)},
  x AS (SELECT p.cell, p.kind, c.pos, c.model, c.prompt_sha256, s.cell IS NOT NULL AS there, s.pos AS sp, s.model AS sm, s.prompt_sha256 AS ss, q.kind AS sk
    FROM pla p LEFT JOIN cel c ON c.cell = p.cell LEFT JOIN (cel s JOIN pla q ON q.cell = s.cell) ON s.cell = p.reused_from)
SELECT 'E-DUP' AS code, cell AS key FROM pla GROUP BY cell HAVING count(*) > 1
UNION ALL SELECT 'E-REF', cell FROM pla WHERE cell NOT IN (SELECT cell FROM cel)
UNION ALL SELECT 'E-PLAN-MISSING', cell FROM cel WHERE cell NOT IN (SELECT cell FROM pla)
UNION ALL {_rules('x', 'cell', {'E-KIND': "kind IN ('call', 'reuse')", 'E-REUSE-SOURCE': "kind <> 'reuse' OR coalesce(sk, '') = 'call'", 'E-REUSE-MODEL': "kind <> 'reuse' OR sm IS NULL OR sm = model", 'E-REUSE-INPUT': "kind <> 'reuse' OR ss IS NULL OR ss = prompt_sha256", 'E-REUSE-ORDER': "kind <> 'reuse' OR sp IS NULL OR sp < pos"})}
UNION ALL SELECT 'E-CALLED-TWICE', coalesce(model, 'null') || '|' || coalesce(prompt_sha256, 'null') FROM x WHERE kind = 'call' GROUP BY model, prompt_sha256 HAVING count(*) > 1"""

QUERIES = {
    "validate_annotations": (validate_annotations, _ANN_SQL),
    "validate_scenario": (validate_scenario, _SCE_SQL),
    "validate_questions": (validate_questions, _QUE_SQL),
    "validate_operations": (validate_operations, _OPS_SQL),
    "validate_state": (validate_state, _STA_SQL),
    "validate_graph": (validate_graph, _GRA_SQL),
    "validate_generation_inputs": (validate_generation_inputs, _GIN_SQL),
    "validate_evaluations": (validate_evaluations, _EVA_SQL),
    "validate_requests": (validate_requests, _REQ_SQL),
    "validate_reuse": (validate_reuse, _PLA_SQL),
}
