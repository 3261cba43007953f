"""DuckDB oracle SQL for every registered query.

The SQL is written independently of the Spark code: fixtures are rebuilt
from the base tables with DuckDB string functions, and rewards are computed
with RE2 regexes or from the fixture's variant number, not by calling the
library. Lambdas use DuckDB's ``lambda x: ...`` form.
"""

from __future__ import annotations

import re

from .. import constants as K

W = K.REASONING_START + "Let me think step by step." + K.REASONING_END


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _dec2(expr: str) -> str:
    return f"(CAST(({expr}) // 100 AS VARCHAR) || '.' || lpad(CAST(({expr}) % 100 AS VARCHAR), 2, '0'))"


def _thousands(expr: str) -> str:
    return (f"(CASE WHEN {expr} >= 1000 THEN CAST({expr} // 1000 AS VARCHAR) || ',' || "
            f"lpad(CAST({expr} % 1000 AS VARCHAR), 3, '0') ELSE CAST({expr} AS VARCHAR) END)")


def _sol(body: str) -> str:
    return f"({q(W + K.SOLUTION_START)} || {body} || {q(K.SOLUTION_END)})"


MATH_ROWS = f"""
math_rows AS (
  SELECT o_orderkey // 4 AS prompt_id, CAST(o_orderkey % 4 AS INTEGER) AS gen_idx,
         CAST(o_orderkey % 12 AS INTEGER) AS variant, CAST(o_custkey AS VARCHAR) AS answer,
         CASE o_orderkey % 12
           WHEN 0 THEN {_sol('CAST(o_custkey AS VARCHAR)')}
           WHEN 1 THEN {q(W + K.SOLUTION_START + ' ')} || CAST(o_custkey AS VARCHAR) || {q(' ' + K.SOLUTION_END + K.DEFAULT_EOS)}
           WHEN 2 THEN {_sol(_dec2('o_custkey * 105'))}
           WHEN 3 THEN {_sol(_dec2('o_custkey * 115'))}
           WHEN 4 THEN {_sol('CAST(o_custkey * 2 AS VARCHAR)')}
           WHEN 5 THEN {_sol(q('forty two'))}
           WHEN 6 THEN {q(W)} || CAST(o_custkey AS VARCHAR)
           WHEN 7 THEN {_sol('CAST(o_custkey AS VARCHAR)')} || {q(K.SOLUTION_START)} || CAST(o_custkey AS VARCHAR) || {q(K.SOLUTION_END)}
           WHEN 8 THEN {_sol(_thousands('o_custkey'))}
           WHEN 9 THEN {_sol('CAST(o_custkey AS VARCHAR)')} || {q(chr(10) + 'Hope this helps.')}
           WHEN 10 THEN {q(K.REASONING_START + 'Let me think.' + K.SOLUTION_START)} || CAST(o_custkey AS VARCHAR) || {q(K.SOLUTION_END)}
           ELSE {_sol(q('0'))}
         END AS completion,
         o_orderdate AS event_time
  FROM orders
)"""

# RE2 versions of the two patterns (RE2 '$' with m-flag stops at '\n' only).
FORMAT_RE = K.FORMAT_PATTERN.replace("(?dms)", "(?ms)")
NUMBER_RE = K.NUMBER_PATTERN.replace("(?dms)", "(?ms)")
FLOAT_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _pystrip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _pyfloat(x: str) -> str:
    s = _pystrip(x)
    return f"(CASE WHEN regexp_matches({s}, {q(FLOAT_RE)}) THEN TRY_CAST({s} AS DOUBLE) END)"


def _count(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)})"


MATH_SCORED = f"""
guesses AS (
  SELECT *,
    CASE WHEN regexp_matches(completion, {q(FORMAT_RE)}) THEN regexp_extract(completion, {q(FORMAT_RE)}, 1) END AS g_fmt,
    CASE WHEN regexp_matches(completion, {q(NUMBER_RE)}) THEN regexp_extract(completion, {q(NUMBER_RE)}, 1) END AS g_num
  FROM math_rows
),
scored AS (
  SELECT prompt_id, gen_idx, variant,
    CAST(CASE WHEN g_fmt IS NOT NULL THEN 3.0 ELSE 0.0 END AS DOUBLE) AS format_exact,
    CAST(CASE WHEN {_count('completion', K.REASONING_END)} = 1 THEN 0.5 ELSE -1.0 END
     + CASE WHEN {_count('completion', K.SOLUTION_START)} = 1 THEN 0.5 ELSE -1.0 END
     + CASE WHEN {_count('completion', K.SOLUTION_END)} = 1 THEN 0.5 ELSE -1.0 END AS DOUBLE) AS format_approx,
    CAST(CASE WHEN g_fmt IS NULL THEN -2.0
         WHEN g_fmt = answer THEN 5.0
         WHEN {_pystrip('g_fmt')} = {_pystrip('answer')} THEN 3.5
         WHEN {_pyfloat('g_fmt')} IS NULL OR {_pyfloat('answer')} IS NULL OR {_pyfloat('answer')} = 0 THEN -4.5
         WHEN {_pyfloat('g_fmt')} / {_pyfloat('answer')} BETWEEN 0.9 AND 1.1 THEN 2.0
         WHEN {_pyfloat('g_fmt')} / {_pyfloat('answer')} BETWEEN 0.8 AND 1.2 THEN 1.5
         ELSE -2.5 END AS DOUBLE) AS answer_reward,
    CAST(CASE WHEN g_num IS NULL THEN -2.5
         WHEN {_pyfloat("replace(g_num, ',', '')")} IS NULL OR {_pyfloat('answer')} IS NULL THEN 0.0
         WHEN {_pyfloat("replace(g_num, ',', '')")} = {_pyfloat('answer')} THEN 3.5
         ELSE -1.5 END AS DOUBLE) AS number_reward
  FROM guesses
),
totals AS (
  SELECT *, format_exact + format_approx + answer_reward + number_reward AS reward FROM scored
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["math_rewards"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, gen_idx, format_exact, format_approx, answer_reward, number_reward, reward FROM totals"""

SQL["group_normalize"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, gen_idx, reward,
  round(CASE WHEN max(reward) OVER w = min(reward) OVER w THEN reward - avg(reward) OVER w
        ELSE (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) END, 6) AS advantage
FROM totals WINDOW w AS (PARTITION BY prompt_id)"""

SQL["group_rank"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, gen_idx, reward,
  CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY reward DESC, gen_idx) AS INTEGER) AS rank
FROM totals"""

ODD_GROUPS = """WITH odd AS (SELECT l_orderkey AS order_key, l_linenumber AS line,
  CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 11 <> 1 THEN l_orderkey // 40 END AS BIGINT) AS grp,
  CASE WHEN l_orderkey % 13 <> 2 THEN CAST(l_quantity AS DOUBLE) END AS reward, CAST(l_linenumber // 2 AS BIGINT) AS tie FROM lineitem)
"""

SQL["group_rank_odd"] = ODD_GROUPS + """SELECT grp, reward, tie,
  CAST(row_number() OVER (PARTITION BY grp ORDER BY reward DESC NULLS LAST, tie) AS INTEGER) AS rank FROM odd"""

SQL["group_normalize_odd"] = ODD_GROUPS + """SELECT order_key, line, grp, round(CASE WHEN max(reward) OVER w = min(reward) OVER w THEN reward - avg(reward) OVER w
  ELSE (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) END, 6) AS advantage FROM odd WINDOW w AS (PARTITION BY grp)"""

SQL["group_stats"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, round(coalesce(avg(reward), 0.0), 6) AS mean_reward,
  round(stddev_pop(reward), 6) AS std_reward, count(*) AS n
FROM totals GROUP BY prompt_id"""

SQL["math_reward_total"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT variant, count(*) AS n, round(avg(reward), 6) AS mean_reward,
  round(stddev_pop(reward), 6) AS std_reward, min(reward) AS min_reward, max(reward) AS max_reward
FROM totals GROUP BY variant"""

SQL["flagship_advantages"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, gen_idx, format_exact, format_approx, answer_reward, number_reward, reward,
  round(CASE WHEN max(reward) OVER w = min(reward) OVER w THEN reward - avg(reward) OVER w
        ELSE (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) END, 6) AS advantage,
  CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY reward DESC, gen_idx) AS INTEGER) AS rank
FROM totals WINDOW w AS (PARTITION BY prompt_id)"""


# ------------------------------------------------------------------ corpus
TOK = "'[\\p{L}\\p{N}]+'"


def _toks(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), {TOK})"


EMAIL_SOURCE = """
email_source AS (
  SELECT 'm' || CAST(doc_id AS VARCHAR) AS message_id,
         split_part(text, chr(10), 1) AS subject,
         lang || '@ex.com' AS "from",
         ['u' || CAST(doc_id % 7 AS VARCHAR) || '@ex.com', 'u' || CAST((doc_id + 3) % 11 AS VARCHAR) || '@ex.com'] AS "to",
         CASE doc_id % 3 WHEN 0 THEN ['u' || CAST(doc_id % 5 AS VARCHAR) || '@ex.com', '']
                         WHEN 1 THEN [NULL::VARCHAR] ELSE []::VARCHAR[] END AS cc,
         CASE WHEN doc_id % 97 = 0 THEN list_transform(range(1, 32), lambda n: 'b' || CAST(n AS VARCHAR) || '@ex.com')
              WHEN doc_id % 4 = 0 THEN ['u' || CAST(doc_id % 13 AS VARCHAR) || '@ex.com']
              ELSE []::VARCHAR[] END AS bcc,
         TIMESTAMP '2001-01-01 00:00:00' + to_hours(doc_id) AS date,
         text AS body, source || '/' || CAST(doc_id AS VARCHAR) AS file_name, doc_id AS ordinal
  FROM documents
),
cleaned AS (
  SELECT * REPLACE (list_filter("to", lambda x: x IS NOT NULL AND x <> '') AS "to",
                    list_filter(cc, lambda x: x IS NOT NULL AND x <> '') AS cc,
                    list_filter(bcc, lambda x: x IS NOT NULL AND x <> '') AS bcc)
  FROM email_source
),
staged AS (
  SELECT *, CASE WHEN body IS NULL THEN 'invalid' WHEN length(body) > 5000 THEN 'skipped'
                 WHEN len("to") + len(cc) + len(bcc) > 30 THEN 'skipped' ELSE 'candidate' END AS stage_outcome
  FROM cleaned
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject, body, "from" ORDER BY ordinal) AS rn,
            count(*) OVER (PARTITION BY subject, body, "from") - 1 AS dropped_copies
  FROM staged WHERE stage_outcome = 'candidate'
),
kept AS (SELECT * FROM ranked WHERE rn = 1),
emails AS (
  SELECT ordinal AS id, message_id, subject, "from" AS from_address,
         strftime(date, '%Y-%m-%d %H:%M:%S') AS date, body, file_name FROM kept
),
recip_items AS (
  SELECT message_id, unnest(list_concat(
           list_transform("to", lambda a, i: {'addr': a, 'rtype': 'to', 'pos': i - 1}),
           list_transform(cc, lambda a, i: {'addr': a, 'rtype': 'cc', 'pos': i - 1}),
           list_transform(bcc, lambda a, i: {'addr': a, 'rtype': 'bcc', 'pos': i - 1}))) AS r
  FROM kept
),
recipients AS (
  SELECT message_id AS email_id, r.addr AS recipient_address, r.rtype AS recipient_type, CAST(r.pos AS INTEGER) AS position
  FROM recip_items
)"""

SCENARIOS = f"""
scen_tok AS (SELECT item_id, text, {_toks('text')} AS tok FROM benchmark),
scenarios AS (
  SELECT item_id AS id, 'Which message mentions ' || tok[2] || '?' AS question, substr(text, 1, 40) AS answer,
         list_slice(['m' || CAST((item_id * 13) % 200 AS VARCHAR), 'm' || CAST((item_id * 17) % 200 AS VARCHAR),
                     'm' || CAST((item_id * 19) % 200 AS VARCHAR)], 1, CAST(item_id % 3 + 1 AS INTEGER)) AS message_ids,
         CAST((item_id % 10) / 10.0 AS FLOAT) AS how_realistic,
         'u' || CAST(item_id % 7 AS VARCHAR) || '@ex.com' AS inbox_address,
         strftime(DATE '2001-01-01' + CAST((item_id * 37) % 420 AS INTEGER), '%Y-%m-%d') AS query_date,
         CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'train' END AS split,
         [tok[2], concat_ws(' ', tok[4], tok[5])] AS keywords
  FROM scen_tok
)"""

POSTINGS = f"""
fields AS (
  SELECT message_id, 'subject' AS field, {_toks('subject')} AS toks FROM emails
  UNION ALL SELECT message_id, 'body' AS field, {_toks('body')} AS toks FROM emails
),
postings AS (
  SELECT unnest(toks) AS term, message_id, field, unnest(range(len(toks))) AS pos FROM fields
)"""


def _search_ctes(req_sql: str) -> str:
    return f"""
req AS ({req_sql}),
kw AS (SELECT request_id, unnest(keywords) AS keyword, unnest(range(len(keywords))) AS kw_idx FROM req),
kwt AS (SELECT request_id, kw_idx, {_toks('keyword')} AS toks FROM kw),
terms AS (SELECT request_id, kw_idx, len(toks) AS n_terms, unnest(toks) AS term, unnest(range(len(toks))) AS term_idx FROM kwt),
hits AS (SELECT t.request_id, t.kw_idx, t.n_terms, p.message_id, p.field, p.pos - t.term_idx AS start
         FROM postings p JOIN terms t ON p.term = t.term),
ph AS (SELECT request_id, kw_idx, message_id, field, start, n_terms FROM hits
       GROUP BY request_id, kw_idx, message_id, field, start, n_terms HAVING count(*) = n_terms),
mm AS (SELECT d.request_id, d.message_id FROM (SELECT DISTINCT request_id, kw_idx, message_id FROM ph) d
       JOIN req r ON r.request_id = d.request_id
       GROUP BY d.request_id, d.message_id, len(r.keywords) HAVING count(*) = len(r.keywords)),
cand AS (
  SELECT m.request_id, m.message_id, e.date, r.max_results FROM mm m
  JOIN req r ON r.request_id = m.request_id JOIN emails e ON e.message_id = m.message_id
  WHERE (r.from_addr IS NULL OR e.from_address = r.from_addr)
    AND (r.sent_after IS NULL OR e.date >= r.sent_after || ' 00:00:00')
    AND (r.sent_before IS NULL OR e.date < r.sent_before || ' 00:00:00')
    AND (e.from_address = r.inbox OR EXISTS (SELECT 1 FROM recipients x WHERE x.email_id = m.message_id AND x.recipient_address = r.inbox))
    AND (r.to_addr IS NULL OR EXISTS (SELECT 1 FROM recipients x WHERE x.email_id = m.message_id AND x.recipient_address = r.to_addr))
),
results AS (
  SELECT * FROM (SELECT request_id, message_id, date, max_results,
                        CAST(row_number() OVER (PARTITION BY request_id ORDER BY date DESC, message_id) AS INTEGER) AS rank
                 FROM cand) WHERE rank <= max_results
)"""


SEARCH_REQ = """SELECT id AS request_id, inbox_address AS inbox, keywords,
  CASE WHEN id % 5 = 0 THEN 'en@ex.com' END AS from_addr, CASE WHEN id % 6 = 1 THEN 'u3@ex.com' END AS to_addr,
  CASE WHEN id % 3 = 0 THEN '2001-01-10' END AS sent_after, CASE WHEN id % 7 NOT IN (3, 4) THEN query_date END AS sent_before,
  CASE WHEN id % 9 <> 5 THEN CAST(id % 10 + 1 AS INTEGER) ELSE 10 END AS max_results FROM scenarios"""
SCENARIO_REQ = """SELECT id AS request_id, inbox_address AS inbox, keywords, NULL::VARCHAR AS from_addr,
  NULL::VARCHAR AS to_addr, NULL::VARCHAR AS sent_after, query_date AS sent_before, 10 AS max_results FROM scenarios"""

SQL["email_filters"] = with_(EMAIL_SOURCE) + """
SELECT message_id, CAST(len("to") + len(cc) + len(bcc) AS INTEGER) AS n_recipients, CAST(length(body) AS INTEGER) AS body_chars
FROM staged WHERE stage_outcome = 'candidate'"""

SQL["email_dedup"] = with_(EMAIL_SOURCE) + "SELECT message_id, ordinal, dropped_copies FROM kept"

SQL["email_outcomes"] = with_(EMAIL_SOURCE) + """
SELECT stage_outcome AS outcome, count(*) AS n FROM staged WHERE stage_outcome <> 'candidate' GROUP BY 1
UNION ALL SELECT 'kept', count(*) FROM kept
UNION ALL SELECT 'duplicate', CAST(coalesce(sum(dropped_copies), 0) AS BIGINT) FROM kept"""

SQL["email_build"] = with_(EMAIL_SOURCE) + "SELECT * FROM emails"

SQL["recipients_build"] = with_(EMAIL_SOURCE) + "SELECT * FROM recipients"

SQL["unique_check"] = with_(EMAIL_SOURCE) + """
SELECT substr(message_id, 1, 3) AS message_id, count(*) AS n FROM emails GROUP BY 1 HAVING count(*) > 1"""

SQL["corpus_counts"] = with_(EMAIL_SOURCE) + """
SELECT 'emails' AS table_name, count(*) AS n FROM emails
UNION ALL SELECT 'recipients', count(*) FROM recipients"""

SQL["read_email"] = with_(EMAIL_SOURCE, SCENARIOS) + """,
ids AS (SELECT DISTINCT unnest(message_ids) AS message_id FROM scenarios)
SELECT e.message_id, e.date, e.subject, e.from_address,
  coalesce((SELECT string_agg(recipient_address, ',' ORDER BY position) FROM recipients r
            WHERE r.email_id = e.message_id AND lower(r.recipient_type) = 'to'), '') AS to_addresses,
  coalesce((SELECT string_agg(recipient_address, ',' ORDER BY position) FROM recipients r
            WHERE r.email_id = e.message_id AND lower(r.recipient_type) = 'cc'), '') AS cc_addresses,
  coalesce((SELECT string_agg(recipient_address, ',' ORDER BY position) FROM recipients r
            WHERE r.email_id = e.message_id AND lower(r.recipient_type) = 'bcc'), '') AS bcc_addresses,
  CAST(length(e.body) AS INTEGER) AS body_chars, e.file_name
FROM emails e WHERE e.message_id IN (SELECT message_id FROM ids)"""

SQL["index_postings"] = with_(EMAIL_SOURCE, POSTINGS) + """
SELECT term, message_id, field, CAST(pos AS INTEGER) AS pos FROM postings"""

SQL["corpus_search"] = with_(EMAIL_SOURCE, SCENARIOS, POSTINGS, _search_ctes(SEARCH_REQ)) + """
SELECT request_id, rank, message_id, date FROM results"""

SQL["scenario_search"] = with_(EMAIL_SOURCE, SCENARIOS, POSTINGS, _search_ctes(SCENARIO_REQ)) + """
SELECT request_id, rank, message_id, date FROM results"""

SQL["search_snippets"] = with_(EMAIL_SOURCE, SCENARIOS, POSTINGS, _search_ctes(SCENARIO_REQ)) + f""",
cov AS (SELECT p.request_id, p.message_id, p.field, unnest(range(p.start, p.start + p.n_terms)) AS hpos
        FROM ph p WHERE (p.request_id, p.message_id) IN (SELECT (request_id, message_id) FROM results)),
pf AS (SELECT request_id, message_id, field, min(hpos) AS first, list(DISTINCT hpos) AS hset FROM cov GROUP BY ALL),
best AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY request_id, message_id
                                                     ORDER BY CASE WHEN field = 'subject' THEN 0 ELSE 1 END) = 1),
bs AS (SELECT b.*, CASE WHEN b.field = 'subject' THEN e.subject ELSE e.body END AS src
       FROM best b JOIN emails e ON e.message_id = b.message_id),
bt AS (SELECT *, regexp_extract_all(src, {TOK}) AS toks, string_split_regex(src, {TOK}) AS gaps FROM bs)
SELECT r.request_id, r.rank, r.message_id, bt.field,
  (CASE WHEN bt.first > 0 THEN ' ... ' ELSE '' END)
  || array_to_string(list_transform(list_slice(bt.toks, bt.first + 1, bt.first + 15),
       lambda t, i: (CASE WHEN i > 1 THEN bt.gaps[bt.first + i] ELSE '' END)
         || CASE WHEN list_contains(bt.hset, bt.first + i - 1) AND (i = 1 OR NOT list_contains(bt.hset, bt.first + i - 2)) THEN '<b>' ELSE '' END
         || t || CASE WHEN list_contains(bt.hset, bt.first + i - 1) AND (i = 15 OR NOT list_contains(bt.hset, bt.first + i)) THEN '</b>' ELSE '' END), '')
  || (CASE WHEN bt.first + 15 < len(bt.toks) THEN ' ... ' ELSE '' END) AS snippet
FROM results r LEFT JOIN bt ON bt.request_id = r.request_id AND bt.message_id = r.message_id"""

SQL["inbox_semi_join"] = with_(EMAIL_SOURCE, SCENARIOS) + """,
parties AS (SELECT DISTINCT message_id, party FROM (
  SELECT message_id, from_address AS party FROM emails
  UNION ALL SELECT email_id, recipient_address FROM recipients))
SELECT s.id AS request_id, count(*) AS n_messages FROM scenarios s JOIN parties p ON p.party = s.inbox_address
GROUP BY s.id"""

SQL["search_filters"] = with_(EMAIL_SOURCE, SCENARIOS) + f""",
req AS ({SEARCH_REQ})
SELECT r.request_id, count(*) AS n_messages FROM req r JOIN emails e
  ON (r.from_addr IS NULL OR e.from_address = r.from_addr)
  AND (r.sent_after IS NULL OR e.date >= r.sent_after || ' 00:00:00')
  AND (r.sent_before IS NULL OR e.date < r.sent_before || ' 00:00:00')
  AND (r.to_addr IS NULL OR EXISTS (SELECT 1 FROM recipients x WHERE x.email_id = e.message_id AND x.recipient_address = r.to_addr))
  AND (e.from_address = r.inbox OR EXISTS (SELECT 1 FROM recipients x WHERE x.email_id = e.message_id AND x.recipient_address = r.inbox))
GROUP BY r.request_id"""

SQL["rejected_requests"] = with_(SCENARIOS) + """
SELECT id AS request_id, CASE WHEN id % 8 IN (1, 3) THEN 'no keywords' WHEN id % 8 = 2 THEN 'keyword without searchable token'
  ELSE 'max_results must be <= 10' END AS reject_reason FROM scenarios WHERE id % 8 IN (1, 2, 3, 4)"""


# --------------------------------------------------------- extraction rewards
IE_EXPECTED = """
ie AS (SELECT o_orderkey AS row_id, o_orderkey // 4 AS prompt_id, CAST(o_orderkey % 10 AS INTEGER) AS variant,
              CASE WHEN o_orderkey % 3 = 0 THEN 12 ELSE 13 END AS n_used FROM orders),
ie_exp AS (
  SELECT row_id, prompt_id, variant, n_used,
    CAST(CASE WHEN variant IN (0, 1, 3, 4, 5) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS validity,
    CAST(CASE WHEN variant IN (0, 1, 3, 5) THEN 1.0
              WHEN variant = 2 THEN CAST(n_used - 1 AS DOUBLE) / n_used
              WHEN variant = 4 THEN (n_used - 1 + 0.8) / n_used ELSE 0.0 END AS DOUBLE) AS field_mean,
    CAST(CASE WHEN variant IN (0, 1, 2, 3, 4) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS constraints,
    CAST(CASE WHEN variant IN (0, 1, 5) THEN 0.1 ELSE 0.0 END AS DOUBLE) AS format
  FROM ie
),
ie_rew AS (
  SELECT *, least(1.0, greatest(0.0, 0.5 * validity + 0.4 * field_mean + 0.1 * constraints + 0.05 * format)) AS reward
  FROM ie_exp
)"""

SQL["ie_rewards"] = with_(IE_EXPECTED) + """
SELECT row_id, validity, round(field_mean, 6) AS field_mean, constraints, format, round(reward, 6) AS reward FROM ie_rew"""

SQL["ie_validity"] = with_(IE_EXPECTED) + "SELECT row_id, validity FROM ie_exp"
SQL["ie_field_mean"] = with_(IE_EXPECTED) + "SELECT row_id, round(field_mean, 6) AS field_mean FROM ie_exp"
SQL["ie_constraints"] = with_(IE_EXPECTED) + "SELECT row_id, constraints FROM ie_exp"
SQL["ie_format"] = with_(IE_EXPECTED) + "SELECT row_id, format FROM ie_exp"

_FIELD_LIST = "[" + ", ".join(q(f) for f in K.RELEVANT_FIELDS) + "]"

SQL["ie_field_scores"] = with_(IE_EXPECTED) + f""",
f AS (SELECT row_id, variant, n_used, unnest({_FIELD_LIST}) AS field FROM ie_exp WHERE variant <= 5)
SELECT row_id, field,
  CAST(CASE WHEN variant = 2 AND field = 'claims' THEN 0.0 WHEN variant = 4 AND field = 'filing_date' THEN 0.8
            ELSE 1.0 END AS DOUBLE) AS sim
FROM f WHERE field <> 'abandon_date' AND NOT (field = 'summary' AND n_used = 12)"""

SQL["parse_outcomes"] = with_(IE_EXPECTED) + """
SELECT row_id,
  CASE variant WHEN 1 THEN 'span' WHEN 6 THEN 'span_invalid' WHEN 7 THEN 'not_object' WHEN 8 THEN 'no_brace'
               WHEN 9 THEN 'unbalanced' ELSE 'whole' END AS outcome,
  CAST(CASE variant WHEN 2 THEN 13 WHEN 3 THEN 15 WHEN 0 THEN 14 WHEN 1 THEN 14 WHEN 4 THEN 14 WHEN 5 THEN 14 END AS INTEGER) AS n_keys
FROM ie_exp"""

SQL["date_profile"] = with_(IE_EXPECTED) + """,
f AS (SELECT variant, unnest(['filing_date', 'date_published', 'patent_issue_date', 'abandon_date']) AS field
      FROM ie_exp WHERE variant <= 5)
SELECT field, CASE WHEN field = 'abandon_date' THEN 'absent' WHEN field = 'filing_date' AND variant = 4 THEN 'slash'
                   ELSE 'iso' END AS format, count(*) AS n
FROM f GROUP BY ALL"""

SQL["reward_join"] = with_(IE_EXPECTED) + """
SELECT row_id, prompt_id, round(reward, 6) AS reward,
  round(CASE WHEN max(reward) OVER w = min(reward) OVER w THEN reward - avg(reward) OVER w
        ELSE (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) END, 6) AS advantage
FROM ie_rew WINDOW w AS (PARTITION BY prompt_id)"""

SQL["normalize_text"] = """
SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 4000) AS norm
FROM documents"""


# ------------------------------------------------------- prompts and chat
from ..operators.prompts import extraction_prompt_parts  # noqa: E402

_HEAD, _TAIL = extraction_prompt_parts()
NL = "chr(10)"

IE_GOLD = """
gold AS (
  SELECT o_orderkey AS row_id,
    '{"publication_number":"US' || CAST(o_orderkey AS VARCHAR) || 'A1"'
    || ',"application_number":"' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '"'
    || ',"patent_number":"' || CAST(o_orderkey * 7 AS VARCHAR) || '"'
    || ',"date_published":"' || strftime(CASE WHEN o_orderkey % 10 = 5 THEN CAST(o_orderdate AS DATE) - 30
                                              ELSE CAST(o_orderdate AS DATE) + 30 END, '%Y-%m-%d') || '"'
    || ',"filing_date":"' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || '"'
    || ',"patent_issue_date":"' || strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d') || '"'
    || ',"abandon_date":""'
    || ',"decision":"' || CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END || '"'
    || ',"main_cpc_label":"' || o_orderpriority || '"'
    || ',"main_ipcr_label":"G06F' || CAST(o_orderkey % 100 AS VARCHAR) || '"'
    || ',"title":"Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || CAST(o_custkey AS VARCHAR) || '"'
    || ',"abstract":"Total price ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '"'
    || ',"summary":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"Summary of order ' || CAST(o_orderkey AS VARCHAR) || '"' END
    || ',"claims":["Claim about part ' || CAST(o_orderkey % 50 AS VARCHAR) || '","Second claim for ' || CAST(o_custkey AS VARCHAR) || '"]}'
    AS gold_json
  FROM orders
),
manifest AS (
  SELECT 'patent_' || CAST(d.doc_id AS VARCHAR) AS patent_id, d.doc_id, d.text, g.gold_json
  FROM documents d JOIN gold g ON g.row_id = d.doc_id
)"""

REASONING = f"""
r0 AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS problem,
         CASE doc_id % 5 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN 'forty'
              WHEN 2 THEN CAST(doc_id % 10 AS VARCHAR) || 'd' WHEN 3 THEN ' ' || CAST(doc_id % 10 AS VARCHAR) || ' '
              ELSE '' END AS expected_answer
       FROM documents),
reasoning AS (
  SELECT doc_id, problem, expected_answer,
    CASE WHEN doc_id % 7 = 3 THEN text
         WHEN doc_id % 5 = 0 THEN '  <think>' || text || '</think>' || {NL} || {NL}
         ELSE '<think>' || {NL} || text || {NL} || '</think>' || {NL} || 'The answer is ' || expected_answer END AS generated_solution,
    CASE WHEN doc_id % 3 = 0 THEN problem || {NL} || '#### ' || expected_answer ELSE problem END AS solution
  FROM r0
)"""

NUMERIC = ("(regexp_matches(trim(expected_answer), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
           "AND TRY_CAST(trim(expected_answer) AS DOUBLE) IS NOT NULL)")

CHAT = f"""
conv AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m
         FROM conversations GROUP BY conv_id),
rendered AS (
  SELECT conv_id,
    CASE WHEN m[1].role = 'system' THEN m[1].content || {q(K.DEFAULT_EOS)} ELSE {q(K.MATH_SYSTEM_PROMPT + K.DEFAULT_EOS)} END
    || array_to_string(list_transform(CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END,
         lambda x: CASE WHEN x.role = 'user' THEN x.content WHEN x.role = 'assistant' THEN x.content || {q(K.DEFAULT_EOS)}
                        ELSE '' END), '') AS body
  FROM conv
),
ntok AS (SELECT conv_id, CAST(len(regexp_extract_all(body, '\\S+')) AS INTEGER) AS n_tokens FROM rendered)"""

SQL["extraction_prompt"] = f"SELECT doc_id, {q(_HEAD)} || text || {q(_TAIL)} AS prompt FROM documents"

SQL["sft_samples"] = with_(IE_GOLD) + f"""
SELECT patent_id, {q(_HEAD)} || text || {q(_TAIL)} || {q(K.SFT_ANSWER_OPEN)} || gold_json || {q(K.SFT_ANSWER_CLOSE)} AS text
FROM manifest"""

SQL["training_rows"] = with_(IE_GOLD) + f"""
SELECT {q(_HEAD)} || text || {q(_TAIL)} AS prompt, gold_json, patent_id FROM manifest"""

SQL["numeric_filter"] = with_(REASONING) + f"SELECT doc_id, expected_answer FROM reasoning WHERE {NUMERIC}"

SQL["reasoning_messages"] = with_(REASONING) + f"""
SELECT doc_id, 3 AS n_messages, {q(K.MATH_SYSTEM_PROMPT)} AS system_content, problem AS user_content,
  {q(K.REASONING_START)} || regexp_replace(replace(replace(generated_solution, '<think>', ''), '</think>', ''), '^\\s+|\\s+$', '', 'g')
  || {q(K.REASONING_END + K.SOLUTION_START)} || expected_answer || {q(K.SOLUTION_END)} AS assistant_content
FROM reasoning WHERE {NUMERIC}"""

SQL["chat_template"] = with_(CHAT) + f"SELECT conv_id, body || {q(K.REASONING_START)} AS text FROM rendered"

SQL["token_budget_filter"] = with_(CHAT) + f"SELECT conv_id, n_tokens FROM ntok WHERE n_tokens <= {2048 / 2}"

SQL["quantile_length_filter"] = with_(CHAT) + """
SELECT conv_id, n_tokens FROM ntok WHERE n_tokens <= (SELECT floor(quantile_cont(n_tokens, 0.9)) FROM ntok)"""

SQL["flatten_messages"] = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"

_AFTER = "(length(generated_solution) - strpos(reverse(generated_solution), reverse('</think>')) + 2)"
SQL["split_reasoning"] = with_(REASONING) + f"""
SELECT doc_id,
  regexp_replace(CASE WHEN contains(generated_solution, '</think>') THEN substr(generated_solution, 1, {_AFTER} - 1) ELSE '' END,
                 '^\\n+|\\n+$', '', 'g') AS thinking,
  regexp_replace(CASE WHEN contains(generated_solution, '</think>') THEN substr(generated_solution, {_AFTER}) ELSE generated_solution END,
                 '^\\n+|\\n+$', '', 'g') AS content
FROM reasoning"""

SQL["hash_answer"] = with_(REASONING) + """
SELECT doc_id, solution AS answer,
  CASE WHEN contains(solution, '####') THEN regexp_replace(split_part(solution, '####', 2), '^\\s+|\\s+$', '', 'g') END AS marked_answer
FROM reasoning"""

SQL["prompt_messages"] = with_(REASONING) + """
SELECT doc_id, 2 AS n_messages, 'system' AS first_role, problem AS user_content, solution AS answer FROM reasoning"""

SQL["transcript_preview"] = """
SELECT conv_id, turn, role,
  CASE WHEN role = 'system' AND length(text) > 100 THEN substr(text, 1, 100) || '...'
       WHEN role = 'tool' AND length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
FROM conversations"""

_AG_HEAD, _AG_REST = K.AGENT_SYSTEM_PROMPT.split("{max_turns}")
_AG_MID, _AG_TAIL = _AG_REST.split("{inbox}")
_AG_MID2, _AG_TAIL2 = _AG_TAIL.split("{query_date}")
SQL["agent_prompt"] = with_(SCENARIOS) + f"""
SELECT id, {q(_AG_HEAD + str(K.MAX_TURNS) + _AG_MID)} || inbox_address || {q(_AG_MID2)} || query_date || {q(_AG_TAIL2)}
  AS system_content, question AS user_content FROM scenarios"""

SQL["pack_sequences"] = """
WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_tokens FROM documents),
s AS (SELECT doc_id, n_tokens, CAST(coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t)
SELECT doc_id, n_tokens, start, start // 2048 AS first_block, (start + greatest(n_tokens - 1, 0)) // 2048 AS last_block FROM s"""


# ------------------------------------------------------------ patent records
PATENTS = """
patents AS (
  SELECT o_orderkey AS record_id,
    'record_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '.json' AS file_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'US' || CAST(o_orderkey AS VARCHAR) || 'A1' END AS publication_number,
    CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS application_number,
    CAST(o_orderkey * 7 AS VARCHAR) AS patent_number,
    strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS date_published,
    strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS filing_date,
    strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d') AS patent_issue_date,
    CASE WHEN o_orderkey % 4 <> 0 THEN '' END AS abandon_date,
    CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END AS decision,
    o_orderpriority AS main_cpc_label,
    'G06F' || CAST(o_orderkey % 100 AS VARCHAR) AS main_ipcr_label,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Order ' || CAST(o_orderkey AS VARCHAR) || ' for "customer" ' || CAST(o_custkey AS VARCHAR) || ' & co'
         WHEN o_orderkey % 17 = 4 THEN NULL
         ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || CAST(o_custkey AS VARCHAR) END AS title,
    CASE WHEN o_orderkey % 11 <> 3 THEN 'Total price ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' <USD>' END AS abstract,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Summary of order ' || CAST(o_orderkey AS VARCHAR) END AS summary,
    CASE WHEN o_orderkey % 2 = 0 THEN ['Claim about part ' || CAST(o_orderkey % 50 AS VARCHAR),
                                      'Second claim for ''c' || CAST(o_custkey AS VARCHAR) || ''' &copy; &nbsp;&#x27;'] END AS claims_list,
    CASE WHEN o_orderkey % 2 = 1 THEN 'Single claim text for ' || CAST(o_orderkey AS VARCHAR) END AS claims_text,
    CASE WHEN o_orderkey % 5 <> 1 THEN d.text END AS description,
    CASE WHEN o_orderkey % 5 = 1 AND d.text IS NOT NULL THEN string_split(d.text, chr(10)) END AS description_list,
    CASE WHEN o_orderkey % 6 = 3 THEN 'Cleo ' || CAST(o_custkey AS VARCHAR) END AS inventors_text,
    CASE WHEN o_orderkey % 2 = 0 THEN ['Ann ' || CAST(o_custkey AS VARCHAR), 'Bob ' || CAST(o_orderkey AS VARCHAR)] END AS inventors,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Applicant ' || CAST(o_custkey AS VARCHAR) END AS applicant,
    CASE WHEN o_orderkey % 5 = 2 THEN strftime(CAST(o_orderdate AS DATE) + 60, '%Y-%m-%d') END AS publication_date,
    CASE WHEN o_orderkey % 3 = 0 THEN ['figs/fig_' || CAST(o_orderkey AS VARCHAR) || '_1.png',
                                      'figs/sub/fig_' || CAST(o_orderkey AS VARCHAR) || '_2.png'] END AS figures
  FROM orders LEFT JOIN documents d ON d.doc_id = o_orderkey
)"""


def _unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&#x27;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _san(x: str) -> str:
    x = _unescape(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"replace({x}, chr(0), '')"


_LABEL_JSON = ("'{' || concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN '\"{f}\":' || CAST(to_json({f}) AS VARCHAR) END" for f in K.PROJECTED_FIELDS)
    + ") || '}'")

SPLIT = """
ps AS (SELECT record_id, publication_number, file_name, row_number() OVER (ORDER BY file_name) - 1 AS position,
              count(*) OVER () AS n FROM patents),
splits AS (SELECT record_id, publication_number, position,
                  CASE WHEN position < CAST(floor(0.85::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split,
                  'patent_' || coalesce(publication_number, CAST(position AS VARCHAR)) AS stem FROM ps),
listing AS (SELECT record_id, stem, CASE WHEN split = 'train' THEN 'Train_data' ELSE 'Val_data' END AS folder FROM splits),
pdfs AS (SELECT stem, folder || '/pdfs/' || stem || '.pdf' AS path FROM listing WHERE record_id % 7 <> 1),
labels AS (SELECT record_id, stem, folder || '/labels/' || stem || '.json' AS path FROM listing WHERE record_id % 11 <> 2),
pairs AS (SELECT p.stem AS patent_id, p.path AS pdf_path, l.path AS gold_json_path FROM pdfs p JOIN labels l ON l.stem = p.stem)"""

SQL["relevant_fields"] = with_(PATENTS) + "SELECT record_id, " + ", ".join(K.PROJECTED_FIELDS) + " FROM patents"

SQL["sanitize_text"] = f"SELECT page_id, {_san('html')} AS text FROM pages"

SQL["render_document"] = with_(PATENTS) + f"""
SELECT record_id, array_to_string(
  [{_san(q(K.NO_TITLE) if False else 'coalesce(title, ' + q(K.NO_TITLE) + ')')},
   'Patent Number: ' || coalesce(patent_number, 'N/A'),
   'Application Number: ' || coalesce(application_number, 'N/A'),
   'Publication Date: ' || coalesce(publication_date, 'N/A'),
   'Applicant: ' || coalesce(applicant, 'N/A'),
   'Inventors: ' || CASE WHEN inventors IS NOT NULL THEN array_to_string(inventors, ', ') ELSE coalesce(inventors_text, 'N/A') END,
   {q(K.COVER_NOTE)}, 'Abstract', {_san('coalesce(abstract, ' + q(K.NO_ABSTRACT) + ')')}]
  || CASE WHEN summary IS NOT NULL THEN ['Summary', {_san('summary')}] ELSE []::VARCHAR[] END
  || ['Claims']
  || CASE WHEN claims_list IS NOT NULL THEN list_transform(claims_list, lambda x, i: 'Claim ' || CAST(i AS VARCHAR) || '. ' || {_san('x')})
          WHEN claims_text IS NOT NULL THEN [{_san('claims_text')}] ELSE []::VARCHAR[] END
  || CASE WHEN len(description_list) > 0 THEN ['Detailed Description'] || list_transform(description_list, lambda p: {_san('p')})
          WHEN coalesce(description, '') <> '' THEN ['Detailed Description']
          || list_transform(string_split(description, chr(10) || chr(10)), lambda p: {_san('p')}) ELSE []::VARCHAR[] END
  || CASE WHEN coalesce(len(figures), 0) > 0 THEN ['Figures'] || list_transform(figures, lambda f: regexp_extract(f, '([^/]*)$', 1))
          ELSE []::VARCHAR[] END, chr(10)) AS text
FROM patents"""

SQL["positional_split"] = with_(PATENTS, SPLIT) + "SELECT record_id, split, position, stem FROM splits"

SQL["pair_by_stem"] = with_(PATENTS, SPLIT) + "SELECT * FROM pairs"

SQL["label_records"] = with_(PATENTS, SPLIT) + f"""
SELECT s.stem AS file_stem, {_LABEL_JSON} AS json FROM patents p JOIN (SELECT record_id, stem FROM splits) s ON s.record_id = p.record_id"""

SQL["gold_lookup"] = with_(PATENTS, SPLIT) + f""",
contents AS (SELECT l.path, {_LABEL_JSON} AS content FROM patents p JOIN labels l ON l.record_id = p.record_id)
SELECT pr.patent_id, c.content AS gold_json FROM pairs pr JOIN contents c ON c.path = pr.gold_json_path"""


SQL["gold_missing"] = with_(PATENTS, SPLIT) + """
SELECT patent_id, 'label file missing' AS reason FROM pairs WHERE substr(md5(patent_id), 1, 1) IN ('0', '1')"""


# ---------------------------------------------- guess / judge / trajectories
_WORDS = "[" + ", ".join(q(w) for w in K.GUESS_WORDS) + "]"

GUESS = f"""
g0 AS (SELECT o_orderkey AS row_id, {_WORDS}[o_orderkey % 20 + 1] AS answer, {_WORDS}[(o_orderkey + 7) % 20 + 1] AS other,
              o_orderkey % 6 AS v FROM orders),
guess_rows AS (
  SELECT row_id, answer,
    CASE v WHEN 0 THEN '<guess>' || answer || '</guess>'
           WHEN 1 THEN '<guess> ' || upper(answer) || ' </guess>'
           WHEN 2 THEN 'I think <guess>' || other || '</guess> no, <guess>' || answer || '</guess>'
           WHEN 3 THEN 'no tags ' || answer
           WHEN 4 THEN '<guess>' || other || '</guess>'
           ELSE '<guess>abc123</guess>' END AS completion
  FROM g0
)"""

SQL["guess_reward"] = with_(GUESS) + r"""
SELECT row_id,
  CAST(CASE WHEN len(regexp_extract_all(completion, '<guess>\s*([a-zA-Z]+)\s*</guess>', 1)) > 0
            AND lower(regexp_extract_all(completion, '<guess>\s*([a-zA-Z]+)\s*</guess>', 1)[-1]) = answer THEN 1.0 ELSE 0.0 END
     + 0.1 * CASE WHEN len(regexp_extract_all(completion, '<guess>\s*([a-zA-Z]+)\s*</guess>', 1)) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward
FROM guess_rows"""

SQL["synthetic_tasks"] = f"""
SELECT o_orderkey, {q(K.GUESS_SYSTEM_PROMPT + chr(10) + chr(10) + K.GUESS_TASK)} AS prompt,
  {_WORDS}[CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '42'), 1, 8))::UBIGINT % 20 AS INTEGER) + 1] AS answer
FROM orders"""

TRAJ = """
trows AS (
  SELECT conv_id AS traj_id, turn, role, text AS content,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0 THEN 'search_inbox'
         WHEN role = 'assistant' AND (conv_id + turn) % 3 = 1 THEN 'return_final_answer' END AS name,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos
  FROM conversations
),
tcalls AS (
  SELECT *, CASE WHEN name IS NOT NULL THEN 'call_' || CAST(traj_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) END AS tool_call_id,
    CASE WHEN name = 'search_inbox' THEN 'w' || CAST(traj_id % 9 AS VARCHAR) || ',t' || CAST(turn AS VARCHAR) END AS keywords,
    CASE WHEN name = 'return_final_answer' AND traj_id % 17 <> 5 THEN 'answer ' || CAST(traj_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS answer,
    CASE WHEN name = 'return_final_answer' AND traj_id % 17 <> 5 THEN 'm' || CAST(traj_id % 7 AS VARCHAR) || ',m' || CAST((traj_id + turn) % 5 AS VARCHAR) END AS source_ids,
    CASE WHEN name = 'return_final_answer' AND traj_id % 17 <> 5 THEN ['m' || CAST(traj_id % 7 AS VARCHAR), 'm' || CAST((traj_id + turn) % 5 AS VARCHAR)] END AS source_list
  FROM trows
),
finals AS (SELECT * FROM tcalls WHERE name = 'return_final_answer'
           QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY pos) = 1),
tmeta AS (
  SELECT c.conv_id AS traj_id, c.conv_id // 4 AS group_id, c.conv_id // 8 AS step,
    CASE WHEN c.conv_id % 10 < 8 THEN 'train' ELSE 'val' END AS split,
    CAST(((c.conv_id * 37) % 100) / 100.0 AS DOUBLE) AS reward,
    ['m' || CAST(c.conv_id % 7 AS VARCHAR), 'm' || CAST(c.conv_id % 3 AS VARCHAR)] AS expected_ids,
    c.conv_id % 5 <> 0 AND c.conv_id % 35 NOT IN (1, 2, 6, 7, 8) AS parse_ok,
    c.conv_id % 5 <> 0 AND c.conv_id % 35 NOT IN (1, 2, 6, 7, 8) AND (c.conv_id % 35 IN (3, 4) OR coalesce(l.quality = 1, false)) AS accept
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN labels l ON l.doc_id = c.conv_id
)"""

SQL["trajectory_messages"] = with_(TRAJ) + "SELECT traj_id, pos, role, name AS tool_name, tool_call_id FROM tcalls"

SQL["tool_calls"] = with_(TRAJ) + """
SELECT traj_id, pos, name AS tool_name, keywords, answer, source_ids FROM tcalls WHERE name IS NOT NULL"""

SQL["final_answers"] = with_(TRAJ) + "SELECT traj_id, pos, answer, source_ids FROM finals"

SQL["turn_cap"] = with_(TRAJ) + """,
tc AS (SELECT traj_id, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY pos) AS t FROM trows)
SELECT traj_id, CAST(count(*) FILTER (WHERE t <= 6) AS INTEGER) AS n_messages FROM tc GROUP BY traj_id"""

SQL["source_coverage"] = with_(TRAJ) + """
SELECT f.traj_id, CAST(len(list_distinct(coalesce(f.source_list, []::VARCHAR[]))) AS INTEGER) AS n_used,
  CAST(len(list_distinct(m.expected_ids)) AS INTEGER) AS n_expected,
  CAST(len(list_intersect(list_distinct(coalesce(f.source_list, []::VARCHAR[])), list_distinct(m.expected_ids))) AS INTEGER) AS n_hit,
  round(len(list_intersect(list_distinct(coalesce(f.source_list, []::VARCHAR[])), list_distinct(m.expected_ids))) / nullif(len(list_distinct(coalesce(f.source_list, []::VARCHAR[]))), 0), 6) AS precision,
  round(len(list_intersect(list_distinct(coalesce(f.source_list, []::VARCHAR[])), list_distinct(m.expected_ids))) / len(list_distinct(m.expected_ids)), 6) AS recall
FROM finals f JOIN tmeta m ON m.traj_id = f.traj_id"""

SQL["group_prefix"] = with_(TRAJ) + """,
sizes AS (SELECT traj_id // 4 AS group_id, count(*) AS n_traj, min(n) AS min_len
          FROM (SELECT traj_id, count(*) AS n FROM trows GROUP BY traj_id) GROUP BY 1),
pp AS (SELECT traj_id // 4 AS group_id, pos, count(DISTINCT role || chr(1) || content) AS n_sig, count(*) AS n
       FROM trows GROUP BY 1, 2),
br AS (SELECT pp.group_id, min(pos) AS first_break FROM pp JOIN sizes s ON s.group_id = pp.group_id
       WHERE pp.n_sig > 1 OR pp.n < s.n_traj GROUP BY pp.group_id)
SELECT s.group_id, CAST(coalesce(br.first_break, s.min_len) AS BIGINT) AS prefix_len
FROM sizes s LEFT JOIN br ON br.group_id = s.group_id"""

SQL["judge_verdicts"] = with_(TRAJ) + """
SELECT traj_id, parse_ok, accept, CAST(CASE WHEN accept THEN 1.0 ELSE 0.0 END AS DOUBLE) AS correct FROM tmeta"""

SQL["validation_metrics"] = with_(TRAJ) + """
SELECT split, step, round(avg(CASE WHEN accept THEN 1.0 ELSE 0.0 END), 6) AS mean_correct, count(*) AS n
FROM tmeta GROUP BY split, step"""

SQL["trajectory_rank"] = with_(TRAJ) + """
SELECT traj_id, group_id, reward,
  CAST(row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, traj_id) AS INTEGER) AS rank FROM tmeta"""

SQL["ranking_preview"] = with_(TRAJ) + """,
lasts AS (SELECT conv_id AS traj_id, max_by(text, turn) AS content FROM conversations GROUP BY 1)
SELECT m.traj_id, group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, m.traj_id) AS INTEGER) AS rank, reward,
  substr(l.content, 1, 50) || '...' AS response FROM tmeta m LEFT JOIN lasts l ON l.traj_id = m.traj_id"""

SQL["judge_prompt"] = with_(TRAJ, SCENARIOS) + f"""
SELECT f.traj_id, {q(K.JUDGE_SYSTEM_PROMPT)} AS system_content,
  'Question: ' || s.question || chr(10) || 'Reference answer: ' || s.answer || chr(10) || 'AI answer: ' || coalesce(f.answer, '') AS user_content
FROM finals f JOIN scenarios s ON s.id = f.traj_id // 4"""

SQL["validation_plan"] = with_(SCENARIOS) + """
SELECT id, CAST(unnest(range(0, 51, 5)) AS INTEGER) AS step FROM scenarios WHERE split = 'test'"""

SQL["failure_budget"] = with_(TRAJ) + """
SELECT step, count(*) FILTER (WHERE NOT parse_ok) AS n_failed, count(DISTINCT group_id) AS n_items,
  count(DISTINCT group_id) * 4 AS budget, count(*) FILTER (WHERE NOT parse_ok) <= count(DISTINCT group_id) * 4 AS within_budget
FROM tmeta GROUP BY step"""

SQL["fan_out"] = with_(SCENARIOS) + "SELECT id, CAST(unnest(range(0, 4)) AS INTEGER) AS gen_idx FROM scenarios"

SQL["zero_fraction"] = """
WITH z AS (SELECT vec_id, len(list_filter(embedding, lambda x: vec_id % 50 = 0 OR abs(CAST(x AS DOUBLE)) < 0.05)) / len(embedding) AS f
           FROM embeddings)
SELECT vec_id, round(f, 6) AS zero_frac, f = 1.0 AS all_zero FROM z"""


# --------------------------------------------------- sampling and sources
SQL["seeded_shuffle"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '42'), o_orderkey) - 1 AS position
FROM orders"""

SQL["hash_split"] = """
SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '3407'), 1, 8))::UBIGINT % 100 < 1
                        THEN 'test' ELSE 'train' END AS split
FROM orders"""

SQL["epoch_batches"] = with_(SCENARIOS) + """,
tr AS (SELECT id FROM scenarios WHERE split = 'train'),
n AS (SELECT count(*) AS n FROM tr),
e AS (SELECT id, unnest(range(0, 20)) AS epoch FROM tr),
p AS (SELECT id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(CAST(epoch AS VARCHAR) || ':' || CAST(id AS VARCHAR) || '42'), id) - 1 AS pos FROM e)
SELECT id, CAST(epoch AS INTEGER) AS epoch, epoch * (((SELECT n FROM n) + 1) // 2) + pos // 2 AS step,
  pos // 2 AS epoch_step, CAST(pos % 2 AS INTEGER) AS slot
FROM p WHERE epoch * (((SELECT n FROM n) + 1) // 2) + pos // 2 <= 50"""

SQL["mini_batches"] = with_(IE_GOLD) + """,
p AS (SELECT patent_id, row_number() OVER (ORDER BY md5(patent_id || '42'), patent_id) - 1 AS position FROM manifest)
SELECT position // 2 AS batch_id, count(*) AS n, string_agg(patent_id, ',' ORDER BY position) AS patent_ids
FROM p GROUP BY 1"""

SQL["head_limit"] = with_(IE_GOLD) + "SELECT patent_id FROM manifest ORDER BY patent_id LIMIT 128"

SQL["scenario_select"] = with_(SCENARIOS) + """
SELECT id, question FROM scenarios WHERE split = 'train' AND len(message_ids) <= 1
ORDER BY md5(CAST(id AS VARCHAR) || '42'), id LIMIT 50"""

SQL["scenario_validation"] = with_(SCENARIOS) + """
SELECT id, CASE WHEN id % 11 = 5 THEN false WHEN id % 9 = 4 THEN false ELSE true END AS valid,
  CASE WHEN id % 11 = 5 THEN 'split not in train/test' WHEN id % 9 = 4 THEN 'how_realistic not a number' END AS reason
FROM scenarios"""

SQL["math_source"] = with_(REASONING) + """
SELECT r.doc_id, r.expected_answer, r.problem, r.generated_solution
FROM reasoning r JOIN documents d ON d.doc_id = r.doc_id WHERE d.lang = 'en' AND r.doc_id % 2 = 0"""

SQL["email_source"] = with_(EMAIL_SOURCE) + """
SELECT message_id, subject, "from", CAST(len("to") AS INTEGER) AS n_to, CAST(len(cc) AS INTEGER) AS n_cc,
  CAST(len(bcc) AS INTEGER) AS n_bcc, strftime(date, '%Y-%m-%d %H:%M:%S') AS date
FROM email_source"""


# ------------------------------------------------------------------ streaming
SQL["stream_scores"] = SQL["math_rewards"]

SQL["stream_group_stats"] = with_(MATH_ROWS, MATH_SCORED) + """
SELECT prompt_id, strftime(date_trunc('hour', TIMESTAMP '2001-01-01 00:00:00' + to_seconds(prompt_id * 10)), '%Y-%m-%d %H:%M:%S') AS window_start,
  round(avg(reward), 6) AS mean_reward, round(stddev_pop(reward), 6) AS std_reward, count(*) AS n
FROM totals GROUP BY prompt_id"""

SQL["stream_index"] = with_(EMAIL_SOURCE) + f""",
final AS (SELECT message_id, CASE WHEN id % 5 = 1 AND id % 3 <> 0 THEN 'updated ' || subject ELSE subject END AS subject, body
          FROM emails WHERE id % 7 <> 2),
fields AS (
  SELECT message_id, 'subject' AS field, {_toks('subject')} AS toks FROM final
  UNION ALL SELECT message_id, 'body' AS field, {_toks('body')} AS toks FROM final
)
SELECT unnest(toks) AS term, message_id, field, CAST(unnest(range(len(toks))) AS INTEGER) AS pos FROM fields"""

SQL["manifest_scan"] = with_(PATENTS, SPLIT) + """
SELECT pr.patent_id, pr.pdf_path, pr.gold_json_path, CAST(length(coalesce(d.text, '')) AS INTEGER) AS n_chars, s.split
FROM pairs pr JOIN splits s ON s.stem = pr.patent_id LEFT JOIN documents d ON d.doc_id = s.record_id"""

for _rule in ("format_exact", "format_approx", "answer_reward", "number_reward"):
    SQL[_rule] = with_(MATH_ROWS, MATH_SCORED) + f"\nSELECT prompt_id, gen_idx, {_rule} FROM scored"

_ROOM = 2048 - len(_HEAD.split()) - len(_TAIL.split())
SQL["prompt_truncation"] = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS toks, string_split_regex(text, '\\S+') AS gaps FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(least(len(toks), {_ROOM}) AS INTEGER) AS n_kept,
  {q(_HEAD)} || CASE WHEN len(toks) <= {_ROOM} THEN text
    ELSE array_to_string(list_transform(toks[1:{_ROOM}], lambda t, i: gaps[i] || t), '') END || {q(_TAIL)} AS prompt,
  2048 AS max_completion_tokens FROM t"""

SQL["packed_blocks"] = SQL["pack_sequences"].replace("SELECT doc_id, n_tokens, start, start // 2048", ", p AS (SELECT doc_id, n_tokens, start, start // 2048").rstrip() + """),
b AS (SELECT *, unnest(range(first_block, last_block + 1)) AS block FROM p WHERE n_tokens > 0),
c AS (SELECT block, doc_id, greatest(start, block * 2048) AS lo, least(start + n_tokens, (block + 1) * 2048) AS hi, start FROM b)
SELECT block, CAST(sum(hi - lo) AS BIGINT) AS n_tokens,
  string_agg(concat_ws(':', doc_id, lo - start, hi - lo), ',' ORDER BY lo, doc_id) AS pieces FROM c GROUP BY block"""

SQL["parse_outcome_counts"] = "WITH o AS (" + SQL["parse_outcomes"] + ") SELECT row_id // 4 AS prompt_id, outcome, count(*) AS n FROM o GROUP BY ALL"

SQL["without_prefix"] = "WITH g AS (" + SQL["group_prefix"] + """), t AS (SELECT conv_id AS traj_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT traj_id, prefix_len, CAST(n - prefix_len AS INTEGER) AS n_left FROM t JOIN g ON g.group_id = traj_id // 4"""

# ------------------------------------------------------ files, sinks and hooks
_PAGES = """WITH f AS (SELECT page_id, url, html, to_json({'page_id': page_id, 'url': url, 'html': html})::VARCHAR AS j FROM pages),
files AS (SELECT page_id, url, html, CASE page_id % 9 WHEN 4 THEN left(j, length(j) - 1) WHEN 5 THEN '[' || j || ']' ELSE j END || chr(10) AS content FROM f)
"""
SQL["raw_scan"] = "SELECT page_id, url FROM pages WHERE page_id % 9 NOT IN (4, 5)"
SQL["raw_rejected"] = """SELECT CASE page_id % 9 WHEN 4 THEN 'invalid JSON' ELSE 'JSON value is not an object' END AS reason, count(*) AS n
FROM pages WHERE page_id % 9 IN (4, 5) GROUP BY 1"""
SQL["raw_scan_first"] = "SELECT least(20, count(*)) AS n_files FROM pages"
SQL["label_contents"] = _PAGES + "SELECT md5(left(content, length(content) - 1)) AS content_md5, CAST(length(content) - 1 AS INTEGER) AS n_chars FROM files"
SQL["file_listing"] = _PAGES + "SELECT count(*) AS n_files, count(*) AS n_stems, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM files"
SQL["training_sink"] = SQL["training_rows"]
SQL["build_once"] = "SELECT page_id, url, 1 AS built FROM pages"
SQL["required_columns"] = "WITH m AS (" + SQL["training_rows"] + """)
SELECT m.patent_id, CAST(length(d.text) AS INTEGER) AS n_chars FROM m JOIN documents d ON 'patent_' || CAST(d.doc_id AS VARCHAR) = m.patent_id"""
SQL["reward_registry"] = with_(MATH_ROWS, MATH_SCORED) + """,
r AS (SELECT t.prompt_id, t.gen_idx, t.format_approx, CASE WHEN contains(m.completion, m.answer) THEN CAST(length(m.completion) AS DOUBLE) ELSE -1.0 END AS length_reward
      FROM totals t JOIN math_rows m ON m.prompt_id = t.prompt_id AND m.gen_idx = t.gen_idx)
SELECT prompt_id, gen_idx, format_approx, length_reward, format_approx + 0.5 * length_reward AS reward FROM r"""
SQL["map_batches"] = "SELECT conv_id, turn, substr(text, 1, 10) AS head, length(text) AS n FROM conversations"
SQL["extract_hook"] = r"""SELECT CAST(page_id AS VARCHAR) AS path,
  CASE WHEN NOT regexp_matches(substr(html, 1, 40), '[^\x00-\x7F]') THEN substr(html, 1, 40) WHEN strlen(html) % 5 <> 0 THEN 'fallback' END AS text,
  CASE WHEN regexp_matches(substr(html, 1, 40), '[^\x00-\x7F]') AND strlen(html) % 5 = 0 THEN 'unreadable' END AS error FROM pages"""
SQL["token_counter"] = r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS n_tokens FROM conversations"

SQL["batch_scorer"] = with_(MATH_ROWS.replace("math_rows AS (", "stored AS (") + """,
firsts AS (SELECT prompt_id, min_by(answer, gen_idx) AS gold, min(gen_idx) AS low FROM stored GROUP BY 1),
math_rows AS (SELECT s.* REPLACE (f.gold AS answer, CASE WHEN s.prompt_id % 3 = 2 THEN 'Working.' || chr(10) || s.completion ELSE s.completion END AS completion,
    CAST(row_number() OVER (PARTITION BY s.prompt_id ORDER BY s.gen_idx) - 1 AS INTEGER) AS gen_idx)
  FROM stored s JOIN firsts f ON f.prompt_id = s.prompt_id)""", MATH_SCORED) + """
SELECT prompt_id, gen_idx, format_exact, answer_reward, number_reward, reward FROM totals"""

SQL["batch_unscored"] = with_(MATH_ROWS) + """,
k AS (SELECT DISTINCT prompt_id AS p FROM math_rows),
w AS (SELECT p, CASE WHEN p % 7 = 3 AND p % 11 = 6 THEN NULL WHEN p % 7 = 3 THEN 'no prompt' WHEN p % 11 = 6 THEN 'no gold'
                     WHEN p % 5 = 2 THEN 'no completions' END AS reason FROM k)
SELECT p AS prompt_id, reason FROM w WHERE reason IS NOT NULL"""

# every pair of a used field is equal but a missing key (0) and a date with other
# separators (eight of ten characters match: 0.8)
SQL["pair_similarity"] = with_(IE_GOLD) + f""",
f AS (SELECT row_id % 10 AS variant, unnest({_FIELD_LIST}) AS field, gold_json FROM gold WHERE row_id % 10 <= 5),
v AS (SELECT variant, field, lower(CASE WHEN field = 'claims' THEN array_to_string(CAST(json_extract(gold_json, '$.claims') AS VARCHAR[]), ' ')
        ELSE json_extract_string(gold_json, '$.' || field) END) AS gold_norm FROM f),
p AS (SELECT gold_norm, CASE WHEN variant = 2 AND field = 'claims' THEN '' WHEN variant = 4 AND field = 'filing_date' THEN replace(gold_norm, '-', '/')
        ELSE gold_norm END AS pred_norm FROM v WHERE gold_norm <> ''),
begun AS (SELECT gold_norm, substr(gold_norm, 1, length(gold_norm) % 7 + 2) AS pred_norm FROM p WHERE pred_norm = gold_norm)
SELECT DISTINCT gold_norm, pred_norm, CASE WHEN pred_norm = gold_norm THEN 1.0::DOUBLE WHEN pred_norm = '' THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS sim FROM p
UNION SELECT gold_norm, pred_norm, round(2.0::DOUBLE * length(pred_norm) / (length(gold_norm) + length(pred_norm)), 6) FROM begun"""
