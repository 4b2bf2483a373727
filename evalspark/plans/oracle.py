"""The registered queries as plain SQL over the given tables, for checking results.

Written for DuckDB, from the definitions rather than from the Spark plans: similarities
come from joined word counts, verdicts from JSON functions, labels from explicit pairs.
"""

from __future__ import annotations

# Fixed values, written out here so that an error in the package shows.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASK = {
    "full": "Judge each answer against the ground truth. Return only valid JSON.",
    "agents": "Judge both answers against the ground truth. Return only valid JSON.",
    "baseline": "Is the Answer factually correct according to the ground truth? Return only valid JSON.",
}
LISTED = ("src0", "src3", "src7", "src11", "src15")

_BLANKS = "'" + WHITESPACE + "'"
_NOT_WORD = r"'[^\p{L}\p{N}]+'"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _clean(x: str) -> str:
    blocks = f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')"
    return _strip(f"regexp_replace({blocks}, '(?s)^.*?</think>', '')")


def _failed(x: str) -> str:
    return f"coalesce({_strip(x)} = '' OR starts_with({x}, 'ERROR:'), true)"


def _attempted(x: str) -> str:
    return f"coalesce({_strip(x)} <> '' AND lower({_strip(x)}) <> 'nan', false)"


def _pct(num: str, den: str) -> str:
    return f"(({num})::DOUBLE * 100::DOUBLE / nullif(({den})::DOUBLE, 0))"


def _ratio(num: str, den: str) -> str:
    return f"(({num})::DOUBLE / nullif(({den})::DOUBLE, 0))"


def _shorten(x: str, n: int, mark: str = "...") -> str:
    line = f"replace(coalesce({x}, 'nan'), chr(10), ' ')"
    return f"substring({line}, 1, {n}) || CASE WHEN length({line}) > {n} THEN '{mark}' ELSE '' END"


_QUESTION = "'Which ' || lang || ' text has ' || n_chars::VARCHAR || ' characters?'"


def _longer(n: int) -> str:
    return f"array_to_string([w for w in string_split(text, ' ') if length(w) > {n}], ' ')"


_SOURCE = f"""
firsts AS (
  SELECT doc_id, w, min(i) AS i FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS w,
           generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
  GROUP BY doc_id, w),
distinct_words AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS ground_truth FROM firsts GROUP BY doc_id),
labelled AS (
  SELECT d.*, l.quality, l.toxic, g.ground_truth, {_QUESTION} AS question,
         l.quality = 1 AS good, l.toxic = 0 AS harmless
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN distinct_words g USING (doc_id)),
worded AS (
  SELECT *, CASE WHEN good AND harmless THEN 'BOTH_CORRECT' WHEN good THEN 'A_CORRECT'
                 WHEN harmless THEN 'B_CORRECT' ELSE 'BOTH_WRONG' END AS word,
         CASE WHEN doc_id % 3 = 0 THEN '"' ELSE '' END AS q
  FROM labelled),
bodies AS (
  SELECT *, '{{"answer_a_correct": '
      || CASE WHEN doc_id % 19 = 4 THEN 'null' ELSE q || good::VARCHAR || q END
      || ', "answer_b_correct": ' || q || harmless::VARCHAR || q
      || ', "baseline_correct": ' || q || (good AND harmless)::VARCHAR || q || ', '
      || CASE WHEN doc_id % 23 = 7 THEN '' ELSE '"selection_status": "'
           || CASE WHEN doc_id % 17 = 3 THEN 'UNSURE' WHEN doc_id % 13 = 5 THEN lower(word)
                   ELSE word END || '", ' END
      || '"selected_answer": "' || CASE word WHEN 'BOTH_CORRECT' THEN 'BOTH'
           WHEN 'A_CORRECT' THEN 'A' WHEN 'B_CORRECT' THEN 'B' ELSE 'NONE' END
      || '", "reason": "quality ' || quality::VARCHAR || ' toxic ' || toxic::VARCHAR || '"'
      || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}}' END AS body
  FROM worded),
replies AS (
  SELECT doc_id AS row_id, question, source AS category, ground_truth,
    CASE WHEN doc_id % 29 = 28 THEN 'ERROR: timeout 503' WHEN doc_id % 31 = 30 THEN ''
         ELSE {_longer(3)} END AS reply_a,
    CASE doc_id % 5 WHEN 0 THEN '<think>{{' || lang || '}}</think>' || text
         WHEN 1 THEN source || '</think>' || text
         WHEN 2 THEN ' ' || chr(9) || text || ' ' || chr(10) ELSE text END AS reply_b,
    CASE WHEN doc_id % 7 = 6 THEN NULL WHEN doc_id % 37 = 36 THEN 'ERROR: tokens per day'
         ELSE CASE WHEN doc_id % 4 = 3 THEN '<think>' ELSE '' END || {_longer(2)}
         END AS reply_base,
    CASE WHEN doc_id % 43 = 42 THEN 'ERROR: 503 service unavailable'
         WHEN quality IS NULL THEN 'No verdict on this ' || lang
         ELSE CASE WHEN doc_id % 5 = 0 THEN '<think>x {{ y</think>' || chr(10) ELSE '' END
           || CASE WHEN doc_id % 2 = 1 THEN 'Verdict: ' ELSE '' END
           || body || CASE WHEN doc_id % 41 = 40 THEN ' ' || body ELSE '' END
           || CASE WHEN doc_id % 2 = 1 THEN ' (end)' ELSE '' END END AS verdict
  FROM bodies),
answers AS (
  SELECT row_id, question, category, ground_truth, verdict,
         {_clean('reply_a')} AS answer_a, {_clean('reply_b')} AS answer_b,
         {_clean('reply_base')} AS base_answer
  FROM replies)"""


def _flag(key: str, truthy: bool) -> str:
    kind, text = f"json_type(o, '$.{key}')", f"json_extract_string(o, '$.{key}')"
    string = f"{text} <> ''" if truthy else (
        f"CASE lower({_strip(text)}) WHEN 'true' THEN true WHEN 'false' THEN false END"
    )
    return f"""CASE WHEN {kind} = 'BOOLEAN' THEN {text} = 'true'
      WHEN {kind} = 'NULL' THEN false
      WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN try_cast({text} AS DOUBLE) <> 0
      WHEN {kind} = 'VARCHAR' THEN {string} END"""


def _enum(key: str) -> str:
    return f"upper(json_extract_string(o, '$.{key}'))"


def _said(truthy: bool) -> str:
    span = f"nullif(regexp_extract({_clean('verdict')}, '(?s)\\{{.*\\}}'), '')"
    return f"""
spans AS (SELECT row_id, {span} AS span FROM replies),
objects AS (SELECT row_id, CASE WHEN json_valid(span) THEN span END AS o FROM spans),
said AS (
  SELECT row_id, {_flag('answer_a_correct', truthy)} AS said_a,
         {_flag('answer_b_correct', truthy)} AS said_b,
         {_enum('selection_status')} AS said_status, {_enum('selected_answer')} AS said_selected,
         coalesce(json_extract_string(o, '$.reason'), '') AS said_reason,
         coalesce({_flag('baseline_correct', truthy)}, false) AS said_base
  FROM objects),
parsed AS (
  SELECT *, said_a IS NOT NULL AND said_b IS NOT NULL AND said_status IS NOT NULL
            AND said_selected IS NOT NULL AS parsed FROM said)"""


_COSINES = f"""
sides AS (
  SELECT row_id, 'a' AS side, answer_a AS t FROM answers
  UNION ALL SELECT row_id, 'b', answer_b FROM answers
  UNION ALL SELECT row_id, 'g', ground_truth FROM answers
  UNION ALL SELECT row_id, 'q', base_answer FROM answers),
tokens AS (
  SELECT row_id, side, unnest(string_split_regex(lower(t), {_NOT_WORD})) AS w FROM sides),
word_counts AS (
  SELECT row_id, w, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b,
         count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'q') AS q
  FROM tokens WHERE w <> '' GROUP BY row_id, w),
products AS (
  SELECT row_id, sum(a * a) AS aa, sum(b * b) AS bb, sum(g * g) AS gg, sum(q * q) AS qq,
         sum(a * b) AS ab, sum(a * g) AS ag, sum(b * g) AS bg, sum(q * g) AS qg
  FROM word_counts GROUP BY row_id),
cosines AS (
  SELECT row_id,
    coalesce(ab::DOUBLE / nullif(sqrt(aa::DOUBLE * bb::DOUBLE), 0), 0) AS ab,
    coalesce(ag::DOUBLE / nullif(sqrt(aa::DOUBLE * gg::DOUBLE), 0), 0) AS ag,
    coalesce(bg::DOUBLE / nullif(sqrt(bb::DOUBLE * gg::DOUBLE), 0), 0) AS bg,
    coalesce(qg::DOUBLE / nullif(sqrt(qq::DOUBLE * gg::DOUBLE), 0), 0) AS qg
  FROM answers LEFT JOIN products USING (row_id))"""

_RESOLVE = f"""
states AS (
  SELECT *, {_failed('answer_a')} OR {_failed('answer_b')} AS pair_failed,
         {_attempted('base_answer')} AS attempted, {_failed('base_answer')} AS base_failed
  FROM answers JOIN parsed USING (row_id) JOIN cosines USING (row_id)),
graded AS (
  SELECT *, pair_failed OR starts_with(verdict, 'ERROR:') AS judge_failed FROM states),
flags AS (
  SELECT *,
    CASE WHEN judge_failed THEN false WHEN parsed THEN said_a ELSE ag > 0.85 END AS a_correct,
    CASE WHEN judge_failed THEN false WHEN parsed THEN said_b ELSE bg > 0.85 END AS b_correct,
    CASE WHEN attempted THEN NOT base_failed AND qg > 0.85 END AS base_correct
  FROM graded),
worked AS (
  SELECT *,
    CASE WHEN judge_failed THEN 'JUDGE_ERROR' WHEN parsed THEN said_status
         WHEN a_correct AND b_correct THEN 'BOTH_CORRECT' WHEN a_correct THEN 'A_CORRECT'
         WHEN b_correct THEN 'B_CORRECT' ELSE 'BOTH_WRONG' END AS status
  FROM flags),
results AS (
  SELECT row_id, question, category, answer_a, answer_b, ground_truth, base_answer,
    CASE WHEN pair_failed THEN 0.0::DOUBLE ELSE round(ab, 6) END AS similarity,
    NOT pair_failed AND ab < 0.85 AS semantic_disagreement, a_correct, b_correct,
    a_correct <> b_correct AS factual_disagreement, status,
    CASE WHEN judge_failed THEN 'NONE' WHEN parsed THEN said_selected
         WHEN status = 'BOTH_CORRECT' THEN 'BOTH' WHEN status = 'A_CORRECT' THEN 'A'
         WHEN status = 'B_CORRECT' THEN 'B' ELSE 'NONE' END AS selected,
    CASE WHEN pair_failed
           THEN 'ERROR: Skipped: one or both agent answers contained an error.'
         WHEN judge_failed THEN verdict WHEN parsed THEN said_reason
         ELSE 'Fallback semantic similarity evaluation used.' END AS reason,
    CASE status WHEN 'A_CORRECT' THEN answer_a WHEN 'B_CORRECT' THEN answer_b
         WHEN 'BOTH_CORRECT' THEN 'BOTH_CORRECT' ELSE 'NO_CORRECT_ANSWER' END AS final_answer,
    status IN ('A_CORRECT', 'B_CORRECT', 'BOTH_CORRECT') AS ensemble_correct,
    base_correct,
    CASE WHEN attempted THEN CASE WHEN parsed AND NOT judge_failed
      THEN said_base AND NOT base_failed ELSE base_correct END END AS base_judged
  FROM worked),
valid AS (
  SELECT * FROM results WHERE NOT {_failed('answer_a')} AND NOT {_failed('answer_b')})"""

_REFERENCES = f"""
reference_sets AS (
  SELECT question, arg_max(text, doc_id) AS text
  FROM (SELECT doc_id, text, {_QUESTION} AS question FROM documents) GROUP BY question),
lines AS (
  SELECT question, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM reference_sets),
usable AS (
  SELECT question FROM lines GROUP BY question
  HAVING bool_or(contains(line, ',')) AND bool_or(NOT contains(line, ','))),
line_counts AS (
  SELECT question, i, w, count(*) AS n FROM (
    SELECT question, i, unnest(string_split_regex(lower(line), {_NOT_WORD})) AS w FROM lines)
  WHERE w <> '' GROUP BY ALL),
line_squares AS (SELECT question, i, sum(n * n) AS square FROM line_counts GROUP BY ALL),
candidates AS (
  SELECT row_id, question, 'agentA' AS who, answer_a AS t, a_correct AS judge FROM results
  UNION ALL SELECT row_id, question, 'agentB', answer_b, b_correct FROM results
  UNION ALL SELECT row_id, question, 'baseline', base_answer, base_judged FROM results),
rated AS (
  SELECT * FROM candidates SEMI JOIN usable USING (question)
  WHERE NOT {_failed('t')} AND {_attempted('t')}),
answer_counts AS (
  SELECT row_id, who, question, w, count(*) AS n FROM (
    SELECT row_id, who, question,
           unnest(string_split_regex(lower(t), {_NOT_WORD})) AS w FROM rated)
  WHERE w <> '' GROUP BY ALL),
closeness AS (
  SELECT row_id, who, question, i, sum(x.n * y.n) AS dot
  FROM answer_counts x JOIN line_counts y USING (question, w) GROUP BY ALL),
best AS (
  SELECT row_id, who, contains(line, ',') AS side,
         max(dot::DOUBLE / sqrt(square::DOUBLE)) AS closest
  FROM closeness JOIN line_squares USING (question, i) JOIN lines USING (question, i)
  GROUP BY ALL),
judgments AS (
  SELECT row_id, who, coalesce(judge, false) AS judge,
         coalesce(c.closest, 0) > coalesce(w.closest, 0) AS ref
  FROM rated LEFT JOIN (SELECT * FROM best WHERE side) c USING (row_id, who)
             LEFT JOIN (SELECT * FROM best WHERE NOT side) w USING (row_id, who))"""

_LATE = f"""
late_source AS (
  SELECT l.doc_id AS row_id, l.ground_truth,
    CASE WHEN l.doc_id % 3 = 1 THEN 'ERROR: timed out' ELSE {_clean('l.text')} END AS base_answer,
    CASE WHEN l.quality IS NOT NULL THEN l.good END AS said
  FROM labelled l),
late_tokens AS (
  SELECT row_id, side, unnest(string_split_regex(lower(t), {_NOT_WORD})) AS w FROM (
    SELECT row_id, 'g' AS side, ground_truth AS t FROM late_source
    UNION ALL SELECT row_id, 'q', base_answer FROM late_source)),
late_products AS (
  SELECT row_id, sum(g * g) AS gg, sum(q * q) AS qq, sum(g * q) AS qg FROM (
    SELECT row_id, w, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'q') AS q
    FROM late_tokens WHERE w <> '' GROUP BY row_id, w) GROUP BY row_id),
late_graded AS (
  SELECT row_id, base_answer, said, {_failed('base_answer')} AS failed,
    coalesce(qg::DOUBLE / nullif(sqrt(qq::DOUBLE * gg::DOUBLE), 0), 0) > 0.85 AS close
  FROM late_source LEFT JOIN late_products USING (row_id)
  WHERE {_attempted('base_answer')}),
late AS (
  SELECT row_id, base_answer, NOT failed AND close AS base_correct,
         NOT failed AND coalesce(said, close) AS base_judged FROM late_graded)"""


def _needs(prefix: str = "") -> str:
    p = prefix
    return (
        f"(NOT {_attempted(p + 'base_answer')} AND {p}status NOT IN ('', 'nan', 'JUDGE_ERROR')"
        f" AND NOT starts_with({p}answer_a, 'ERROR:') AND NOT starts_with({p}answer_b, 'ERROR:'))"
    )


_MERGED = f"""
merged AS (
  SELECT r.row_id, r.status, r.answer_a, r.answer_b,
    CASE WHEN l.row_id IS NOT NULL AND {_needs('r.')} THEN l.base_answer
         ELSE r.base_answer END AS base_answer,
    CASE WHEN l.row_id IS NOT NULL AND {_needs('r.')} THEN l.base_correct
         ELSE r.base_correct END AS base_correct,
    CASE WHEN l.row_id IS NOT NULL AND {_needs('r.')} THEN l.base_judged
         ELSE r.base_judged END AS base_judged
  FROM results r LEFT JOIN (SELECT late.* FROM late JOIN documents ON row_id = doc_id WHERE lang <> 'de') l
    ON r.row_id = l.row_id)"""


def _with(*parts: str, truthy: bool = False) -> str:
    return "WITH " + ",".join(parts) + "\n"


_ALL = _with(_SOURCE, _said(False), _COSINES, _RESOLVE)
_ALL_TRUTHY = _with(_SOURCE, _said(True), _COSINES, _RESOLVE)
_RATERS = _with(_SOURCE, _said(False), _COSINES, _RESOLVE, _REFERENCES)
_FILLS = _with(_SOURCE, _said(False), _COSINES, _RESOLVE, _LATE, _MERGED)


def _erfc(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {x} * 0.5::DOUBLE))"
    series = f"{ERFC_COEFFICIENTS[-1]}::DOUBLE"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        series = f"({series} * {t} + ({c}::DOUBLE))"
    return f"({t} * exp({series} - {x} * {x}))"


_TESTS = f"""
margins AS (
  SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM tables),
possible AS (
  SELECT key, a AS seen, r1, c1, n,
         unnest(generate_series(greatest(0, r1 + c1 - n), least(r1, c1))) AS k FROM margins),
weights AS (
  SELECT key, k, seen, -(lgamma(k + 1) + lgamma(r1 - k + 1) + lgamma(c1 - k + 1)
                         + lgamma(n - r1 - c1 + k + 1)) AS lw FROM possible),
relative AS (
  SELECT key, lw, max(lw) OVER (PARTITION BY key) AS top,
         max(lw) FILTER (k = seen) OVER (PARTITION BY key) AS own FROM weights),
fisher AS (
  SELECT key, round(sum(CASE WHEN lw <= own + 1e-7 THEN exp(lw - top) ELSE 0 END)
                    / sum(exp(lw - top)), 4) AS fisher_p FROM relative GROUP BY key),
chi AS (
  SELECT key, n::DOUBLE * power(greatest(0, abs(a::DOUBLE * d - b::DOUBLE * c) - n / 2.0), 2)
    / nullif(r1::DOUBLE * (c + d) * c1 * (b + d), 0) AS chi FROM margins),
tested AS (
  SELECT m.*, fisher_p, {_ratio(_ratio('a', 'a + b'), _ratio('c', 'c + d'))} AS relative_risk,
         {_ratio('a::DOUBLE * d', 'b::DOUBLE * c')} AS odds_ratio,
         round(chi, 6) AS chi_square,
         round({_erfc('sqrt(chi / 2)')}, 4) AS chi_square_p
  FROM margins m JOIN fisher USING (key) JOIN chi USING (key))"""

_DISAGREE_COUNTS = """SELECT {key} AS key,
  count(*) FILTER (semantic_disagreement AND status = 'BOTH_WRONG') AS a,
  count(*) FILTER (semantic_disagreement AND status <> 'BOTH_WRONG') AS b,
  count(*) FILTER (NOT semantic_disagreement AND status = 'BOTH_WRONG') AS c,
  count(*) FILTER (NOT semantic_disagreement AND status <> 'BOTH_WRONG') AS d,
  count(*) FILTER (semantic_disagreement AND NOT ensemble_correct) AS lost_apart,
  count(*) FILTER (NOT semantic_disagreement AND NOT ensemble_correct) AS lost_together
  FROM valid"""

_GROUP = """SELECT {grp} AS grp, count(*) AS n,
  count(*) FILTER (status = 'BOTH_WRONG') AS both_wrong,
  count(*) FILTER (NOT ensemble_correct) AS ensemble_wrong,
  count(*) FILTER (NOT a_correct) + count(*) FILTER (NOT b_correct) AS agent_wrong
  FROM valid"""

_BASE_COUNTED = f"{_attempted('base_answer')} AND NOT starts_with(base_answer, 'ERROR:')"
_AGAINST_BASE = f"""SELECT count(*) AS valid,
  count(*) FILTER (ensemble_correct) AS ensemble_n,
  count(*) FILTER ({_attempted('base_answer')}) AS attempted,
  count(*) FILTER ({_BASE_COUNTED} AND base_correct) AS similar_n,
  count(*) FILTER ({_BASE_COUNTED} AND base_judged) AS judged_n,
  count(*) FILTER (NOT {_attempted('base_answer')}) AS pending FROM valid"""


def _head(scope: str, where: str) -> str:
    return f"""SELECT '{scope}' AS scope, valid, ensemble_n, attempted, pending,
      {_pct('ensemble_n', 'valid')} AS ensemble_pct,
      CASE WHEN pending = 0 THEN {_pct('judged_n', 'valid')} END AS judged_pct,
      CASE WHEN pending = 0 THEN {_pct('similar_n', 'valid')} END AS similar_pct,
      CASE WHEN pending = 0 THEN {_pct('ensemble_n - judged_n', 'valid')} END AS difference_pp
      FROM ({_AGAINST_BASE} {where})"""


def _prompt(kind: str) -> str:
    pair = "'Answer A: ' || answer_a || {g} || 'Answer B: ' || answer_b || {g} || "
    middle = {
        "full": pair + f"'Baseline Answer: ' || CASE WHEN {_failed('base_answer')} THEN"
        " '(no baseline answer available)' ELSE base_answer END || {g} || ",
        "agents": pair,
        "baseline": "'Answer: ' || base_answer || {g} || ",
    }[kind].format(g="chr(10) || chr(10)")
    where = f"WHERE NOT {_failed('base_answer')}" if kind == "baseline" else ""
    gap = "chr(10) || chr(10)"
    return f"""{_with(_SOURCE)} SELECT row_id, '{kind}' AS kind,
      'Question: ' || question || {gap} || {middle}
      'Ground Truth: ' || ground_truth || {gap} || '{ASK[kind]}' AS prompt FROM answers {where}"""


_RESOLVED = """SELECT row_id, a_correct, b_correct, factual_disagreement, status, selected,
  reason, final_answer, ensemble_correct, base_judged FROM results"""

_CALLS = """WITH calls AS (
  SELECT lower(CASE WHEN event_type = 'error' THEN CASE event_id % 5
    WHEN 0 THEN 'Tokens per day limit (TPD) reached' WHEN 1 THEN 'HTTP 429: rate limit'
    WHEN 2 THEN 'Request timed out' WHEN 3 THEN 'Model not found'
    ELSE 'httpd failed' END END) AS m FROM events)
SELECT CASE WHEN m IS NULL THEN 'ok' WHEN contains(m, 'tokens per day') OR {word} THEN 'quota'
  WHEN regexp_matches(m, 'rate_limit|rate limit|429|500|502|503|timeout|timed out|connection|temporarily unavailable')
  THEN 'transient' ELSE 'other' END AS error_class, count(*) AS n
FROM calls GROUP BY 1"""

_AGREEMENT = f"""SELECT grp, n, tt + ff AS agree, {_pct('tt + ff', 'n')} AS agree_pct,
  CASE WHEN tt + tf > 0 AND ft + ff > 0 AND tt + ft > 0 AND tf + ff > 0 THEN
    (((tt + ff)::DOUBLE / n::DOUBLE) - pe) / nullif(1 - pe, 0) END AS kappa,
  '[[' || tt || ',' || tf || '],[' || ft || ',' || ff || ']]' AS cm
FROM (SELECT *, ((tt + tf)::DOUBLE * (tt + ft)::DOUBLE + (ff + ft)::DOUBLE * (ff + tf)::DOUBLE)
              / (n::DOUBLE * n::DOUBLE) AS pe
  FROM (SELECT coalesce(CASE WHEN who LIKE 'agent%' THEN 'agents' WHEN who IS NOT NULL
                        THEN 'baseline' END, 'overall') AS grp, count(*) AS n,
    count(*) FILTER (ref AND judge) AS tt, count(*) FILTER (ref AND NOT judge) AS tf,
    count(*) FILTER (NOT ref AND judge) AS ft, count(*) FILTER (NOT ref AND NOT judge) AS ff
  FROM (SELECT who, judge, ref FROM judgments UNION ALL
        SELECT NULL, judge, ref FROM judgments) GROUP BY 1))"""

_AUDIT = f"""{_RATERS},
marked AS (
  SELECT r.*, row_id IN (SELECT row_id FROM judgments WHERE judge <> ref) AS differs,
         list_position(['A_CORRECT', 'B_CORRECT', 'BOTH_CORRECT', 'BOTH_WRONG'], status) AS s
  FROM results r),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY differs, status ORDER BY row_id) AS place
  FROM marked WHERE s IS NOT NULL),
picked AS (
  SELECT * FROM placed WHERE place <= CASE WHEN differs THEN 5 ELSE 3 END
  ORDER BY differs DESC, s, row_id LIMIT 30),
correct_lines AS (
  SELECT question, string_agg(line, ' | ' ORDER BY i) AS c FROM lines
  WHERE contains(line, ',') GROUP BY question)
SELECT row_id AS row, category, {_shorten('question', 120)} AS question,
  {_shorten('answer_a', 160)} AS answer_a, {_shorten('answer_b', 160)} AS answer_b,
  {_shorten('base_answer', 160)} AS base_answer, {_shorten('ground_truth', 120)} AS ground_truth,
  {_shorten("coalesce(c, '')", 200)} AS correct_answers, a_correct AS judge_a_correct,
  b_correct AS judge_b_correct, base_judged AS base_correct_judged, status AS judge_status,
  {_shorten('reason', 200)} AS judge_reason, differs AS ref_disagreed_somewhere
FROM picked LEFT JOIN correct_lines USING (question)"""

_CATEGORY = f"""SELECT *, {_pct('correct', 'n')} AS rate FROM (
  SELECT category, count(*) AS n, count(*) FILTER (ensemble_correct) AS correct
  FROM valid GROUP BY category) WHERE n >= 10"""

_SUMMARY_COUNTS = f"""SELECT (SELECT count(*) FROM results) AS total, count(*) AS valid,
  count(*) FILTER (semantic_disagreement) AS semantic_n,
  count(*) FILTER (factual_disagreement) AS factual_n,
  count(*) FILTER (a_correct) AS a_correct_n, count(*) FILTER (b_correct) AS b_correct_n,
  count(*) FILTER (status = 'BOTH_CORRECT') AS both_correct_n,
  count(*) FILTER (status = 'BOTH_WRONG') AS both_wrong_n,
  count(*) FILTER (final_answer = 'NO_CORRECT_ANSWER') AS abstained_n,
  count(*) FILTER (ensemble_correct) AS ensemble_n,
  count(*) FILTER (NOT semantic_disagreement) AS agree_n,
  count(*) FILTER (semantic_disagreement AND NOT ensemble_correct) AS semantic_wrong_n,
  count(*) FILTER (factual_disagreement AND NOT ensemble_correct) AS factual_wrong_n,
  count(*) FILTER (NOT semantic_disagreement AND status = 'BOTH_WRONG') AS agree_both_wrong_n,
  count(*) FILTER (semantic_disagreement AND status = 'BOTH_WRONG') AS disagree_both_wrong_n
  FROM valid"""

_SUMMARY_RATES = ", ".join(
    f"{_pct(num, den)} AS {name}"
    for name, num, den in (
        ("semantic_pct", "semantic_n", "valid"),
        ("factual_pct", "factual_n", "valid"),
        ("a_correct_pct", "a_correct_n", "valid"),
        ("b_correct_pct", "b_correct_n", "valid"),
        ("both_correct_pct", "both_correct_n", "valid"),
        ("both_wrong_pct", "both_wrong_n", "valid"),
        ("abstained_pct", "abstained_n", "valid"),
        ("ensemble_pct", "ensemble_n", "valid"),
        ("semantic_precision", "semantic_wrong_n", "semantic_n"),
        ("factual_precision", "factual_wrong_n", "factual_n"),
        ("agree_both_wrong_pct", "agree_both_wrong_n", "agree_n"),
        ("disagree_both_wrong_pct", "disagree_both_wrong_n", "semantic_n"),
    )
)

_EXPECTED = """CASE WHEN a_correct AND b_correct THEN 'BOTH_CORRECT' WHEN a_correct
  THEN 'A_CORRECT' WHEN b_correct THEN 'B_CORRECT' ELSE 'BOTH_WRONG' END"""

_PRIOR = """SELECT row_id, question, status FROM results
  WHERE row_id < coalesce((SELECT min(row_id) FROM results WHERE status = 'JUDGE_ERROR'),
                          9223372036854775807)"""

ORACLE: dict[str, str] = {
    "head_rows": _with(_SOURCE) + "SELECT row_id, question, ground_truth FROM replies"
    " ORDER BY row_id LIMIT 20",
    "clean_output": _with(_SOURCE) + f"SELECT row_id, {_clean('reply_a')} AS reply_a,"
    f" {_clean('reply_b')} AS reply_b, {_clean('reply_base')} AS reply_base,"
    f" {_clean('verdict')} AS verdict FROM replies",
    "truncated_reasoning": _with(_SOURCE) + "SELECT row_id,"
    " starts_with(answer_b, '<think>') AS b_truncated,"
    " starts_with(base_answer, '<think>') AS base_truncated FROM answers",
    "bool_parse": """SELECT doc_id AS row_id,
        CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS tri, doc_id % 5 = 0 AS two
        FROM documents""",
    "error_triage": _CALLS.format(word=r"regexp_matches(m, '\btpd\b')"),
    "error_triage_letters": _CALLS.format(word="contains(m, 'tpd')"),
    "judge_requests": _prompt("full"),
    "judge_requests_agents": _prompt("agents"),
    "judge_requests_baseline": _prompt("baseline"),
    "verdict_parse": _with(_SOURCE, _said(False)) + "SELECT * FROM parsed",
    "verdict_parse_truthy": _with(_SOURCE, _said(True)) + "SELECT * FROM parsed",
    "verdict_resolve": _ALL + _RESOLVED,
    "verdict_resolve_truthy": _ALL_TRUTHY + _RESOLVED,
    "result_table": _ALL + "SELECT * FROM results",
    "pair_similarity": _ALL + "SELECT row_id, similarity, semantic_disagreement FROM results",
    "base_similarity_grade": _ALL + "SELECT row_id, base_correct FROM results",
    "pair_similarity_vec": """SELECT x.vec_id,
        round(coalesce(list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])
          / nullif(sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])
          * list_inner_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 0), 0), 6)
          AS similarity
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "answer_validity": _ALL + f"""SELECT row_id, {_failed('answer_a')} AS a_failed,
        {_failed('answer_b')} AS b_failed,
        NOT {_failed('answer_a')} AND NOT {_failed('answer_b')} AS valid,
        {_attempted('base_answer')} AS base_attempted, {_failed('base_answer')} AS base_failed
        FROM results""",
    "eval_summary": _ALL + f"SELECT *, {_SUMMARY_RATES} FROM ({_SUMMARY_COUNTS})",
    "base_metrics": _ALL + f"""SELECT *, CASE WHEN pending = 0 AND attempted > 0
          THEN ensemble_pct - similar_pct END AS difference_similar_pp,
        CASE WHEN pending = 0 AND attempted > 0
          THEN ensemble_pct - judged_pct END AS difference_judged_pp
        FROM (SELECT *, {_pct('similar_n', 'attempted')} AS similar_pct,
          {_pct('judged_n', 'attempted')} AS judged_pct,
          {_pct('ensemble_n', 'valid')} AS ensemble_pct FROM ({_AGAINST_BASE}))""",
    "head_to_head": _ALL + _head("all", "") + " UNION ALL "
    + _head("complete", "WHERE base_answer IS NOT NULL"),
    "data_quality": _ALL + f"""SELECT (SELECT count(*) FROM results) AS total,
        count(*) AS valid, (SELECT count(*) FROM results) - count(*) AS dropped,
        count(*) FILTER (status = 'JUDGE_ERROR') AS judge_errors,
        count(*) FILTER (starts_with(base_answer, 'ERROR:')) AS base_errors FROM valid""",
    "operational_rates": _ALL + f"""SELECT *, judged - fallback AS clean_parse,
        {_pct('judged - fallback', 'judged')} AS clean_parse_pct,
        {_pct('fallback', 'judged')} AS fallback_pct,
        {_pct('judge_errors', 'total')} AS judge_error_pct
        FROM (SELECT count(*) AS total, count(*) FILTER (status <> 'JUDGE_ERROR') AS judged,
          count(*) FILTER (contains(lower(reason), 'fallback semantic similarity')) AS fallback,
          count(*) FILTER (status = 'JUDGE_ERROR') AS judge_errors FROM results)""",
    "disagreement_groups": _ALL + f"""SELECT *, {_pct('both_wrong', 'n')} AS both_wrong_pct,
        {_pct('ensemble_wrong', 'n')} AS ensemble_wrong_pct,
        {_pct('agent_wrong', 'n * 2')} AS agent_wrong_pct
        FROM ({_GROUP.format(grp="CASE WHEN semantic_disagreement THEN 'disagree' ELSE 'agree' END")}
              GROUP BY 1 UNION ALL {_GROUP.format(grp="'all'")})""",
    "persona_compare": _ALL + f"""SELECT *,
        {_pct('same_verdict', 'n')} AS same_verdict_pct,
        {_pct('a_correct - b_correct', 'n')} AS a_minus_b_pp
        FROM (SELECT count(*) AS n, count(*) FILTER (valid.a_correct) AS a_correct,
          count(*) FILTER (valid.b_correct) AS b_correct,
          count(*) FILTER (valid.a_correct = valid.b_correct) AS same_verdict,
          count(*) FILTER (valid.a_correct AND valid.b_correct) AS both_right,
          count(*) FILTER (NOT valid.a_correct AND NOT valid.b_correct) AS both_wrong,
          count(*) FILTER (valid.a_correct <> valid.b_correct) AS exactly_one_right,
          count(*) FILTER (selected = 'A') AS pick_a, count(*) FILTER (selected = 'B') AS pick_b,
          count(*) FILTER (selected = 'BOTH') AS pick_both,
          count(*) FILTER (selected = 'NONE') AS pick_none,
          round(avg(similarity), 6) AS mean_similarity FROM valid)""",
    "disagreement_breakdown": _ALL + """SELECT semantic_disagreement,
        a_correct::INT + b_correct::INT AS n_right, count(*) AS n FROM valid GROUP BY 1, 2""",
    "consensus_split": _ALL + f"""SELECT *,
        {_pct('consensus', 'both_wrong')} AS consensus_of_wrong_pct,
        {_pct('divergent', 'both_wrong')} AS divergent_of_wrong_pct,
        {_pct('consensus', 'n')} AS consensus_of_all_pct,
        {_pct('divergent', 'n')} AS divergent_of_all_pct
        FROM (SELECT count(*) AS n, count(*) FILTER (status = 'BOTH_WRONG') AS both_wrong,
          count(*) FILTER (status = 'BOTH_WRONG' AND NOT semantic_disagreement) AS consensus,
          count(*) FILTER (status = 'BOTH_WRONG' AND semantic_disagreement) AS divergent
          FROM valid)""",
    "category_rank": _ALL + f"""SELECT * FROM (SELECT *, 'best' AS "end" FROM ({_CATEGORY})
          ORDER BY rate DESC, category LIMIT 5)
        UNION ALL SELECT * FROM (SELECT *, 'worst' AS "end" FROM ({_CATEGORY})
          ORDER BY rate, category LIMIT 5)""",
    "consensus_concentration": _ALL + f"""SELECT *, {_pct('consensus', 'n')} AS rate
        FROM (SELECT category, count(*) AS n,
          count(*) FILTER (status = 'BOTH_WRONG' AND NOT semantic_disagreement) AS consensus
          FROM valid GROUP BY category) WHERE n >= 5 ORDER BY rate DESC, category LIMIT 8""",
    "error_examples": _ALL + f"""SELECT category, row_id, question,
        {_shorten('answer_a', 170, ' [...]')} AS wrong, ground_truth AS truth
        FROM valid WHERE status = 'BOTH_WRONG' AND NOT semantic_disagreement
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY row_id) = 1""",
    "risk_association": f"""{_ALL}, tables AS (
        {_DISAGREE_COUNTS.format(key='category')} GROUP BY 1
        UNION ALL {_DISAGREE_COUNTS.format(key="'ALL'")}), {_TESTS}
        SELECT key AS segment, a, b, c, d, fisher_p, relative_risk, odds_ratio, chi_square,
          chi_square_p,
          {_ratio(_ratio('lost_apart', 'a + b'), _ratio('lost_together', 'c + d'))}
            AS ensemble_relative_risk FROM tested""",
    "bucket_association": f"""{_ALL}, counted AS (
        SELECT category IN {LISTED} AS inside,
          status = 'BOTH_WRONG' AND NOT semantic_disagreement AS shared,
          status = 'BOTH_WRONG' AND semantic_disagreement AS apart FROM valid),
        tables AS (SELECT 1 AS key, count(*) FILTER (inside AND shared) AS a,
          count(*) FILTER (inside AND NOT shared) AS b,
          count(*) FILTER (NOT inside AND shared) AS c,
          count(*) FILTER (NOT inside AND NOT shared) AS d FROM counted), {_TESTS}
        SELECT *, {_pct('consensus', 'n')} AS consensus_pct,
          {_pct('divergent', 'n')} AS divergent_pct FROM (
          SELECT CASE WHEN inside THEN 'listed' ELSE 'other' END AS bucket, count(*) AS n,
            count(*) FILTER (shared) AS consensus, count(*) FILTER (apart) AS divergent,
            (SELECT chi_square_p FROM tested) AS chi_square_p,
            (SELECT fisher_p FROM tested) AS fisher_p FROM counted GROUP BY 1)""",
    "verdict_consistency": f"""{_ALL}, checked AS (
        SELECT *, {_EXPECTED} AS expected FROM results WHERE status <> 'JUDGE_ERROR'),
        broken AS (SELECT status <> expected AS bad_status,
          upper(selected) <> CASE expected WHEN 'BOTH_CORRECT' THEN 'BOTH' WHEN 'A_CORRECT'
            THEN 'A' WHEN 'B_CORRECT' THEN 'B' ELSE 'NONE' END AS bad_selected,
          factual_disagreement <> (a_correct <> b_correct) AS bad_factual,
          ensemble_correct <> (expected <> 'BOTH_WRONG') AS bad_ensemble FROM checked)
        SELECT *, {_pct('consistent', 'judged')} AS consistent_pct FROM (
          SELECT count(*) AS judged, count(*) FILTER (NOT (bad_status OR bad_selected
              OR bad_factual OR bad_ensemble)) AS consistent,
            count(*) FILTER (bad_status) AS bad_status,
            count(*) FILTER (bad_selected) AS bad_selected,
            count(*) FILTER (bad_factual) AS bad_factual,
            count(*) FILTER (bad_ensemble) AS bad_ensemble FROM broken)""",
    "category_lookup": _with(_SOURCE) + """, known AS (
        SELECT question, arg_max(category, row_id) AS category FROM replies
        SEMI JOIN labels ON row_id = doc_id GROUP BY question)
        SELECT row_id, question, known.category FROM replies LEFT JOIN known USING (question)""",
    "baseline_grade": _FILLS + """SELECT s.row_id, base_correct, base_judged
        FROM late_source s LEFT JOIN late USING (row_id)""",
    "pending_fill": _ALL + f"SELECT row_id, question FROM results WHERE {_needs()}",
    "fill_merge": _FILLS + "SELECT row_id, status, base_answer, base_correct, base_judged"
    " FROM merged",
    "remaining_work": _FILLS + f"SELECT count(*) AS remaining FROM merged WHERE {_needs()}",
    "deferred_baseline": _ALL + """SELECT row_id, status, NULL::VARCHAR AS base_answer,
        NULL::BOOLEAN AS base_correct, NULL::BOOLEAN AS base_judged FROM results""",
    "resume_prefix": _ALL + _PRIOR,
    "resume_mismatch": _ALL + f"""SELECT (SELECT count(*) FROM results) AS prior,
        count(*) FILTER (WHERE NOT EXISTS
          (SELECT 1 FROM ({_PRIOR}) p WHERE p.question LIKE 'Which en%')) AS kept,
        count(*) AS kept_unchanged FROM ({_PRIOR})""",
    "reference_label": _RATERS + """SELECT row_id,
        bool_or(ref) FILTER (who = 'agentA') AS "ref_agentA",
        bool_or(ref) FILTER (who = 'agentB') AS "ref_agentB",
        bool_or(ref) FILTER (who = 'baseline') AS ref_baseline
        FROM results LEFT JOIN judgments USING (row_id) GROUP BY row_id""",
    "rater_long": _RATERS + "SELECT row_id, who, judge, ref FROM judgments",
    "rater_agreement": _RATERS + _AGREEMENT,
    "audit_sample": _AUDIT,
    "reference_label_vec": """WITH pairs AS (
        SELECT x.vec_id, x.vec_id // 10 AS question, x.label < 5 AS judge,
          y.label % 2 = 0 AS even,
          list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[])
          / sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])
          * list_inner_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS c
        FROM embeddings x JOIN embeddings y ON y.vec_id // 10 + 1 = x.vec_id // 10)
      SELECT vec_id AS row_id, question, judge,
        max(c) FILTER (even) > max(c) FILTER (NOT even) AS ref
      FROM pairs GROUP BY vec_id, question, judge
      HAVING bool_or(even) AND bool_or(NOT even)""",
    "question_positions": """SELECT row_number() OVER () - 1 AS row_id, doc_id, lang,
        length(text)::INT AS n_letters FROM documents""",
}

# A run as it may have been stored, with its late baseline replies.
_STORED = f"""WITH flags AS (
  SELECT d.*, doc_id % 100 / 100.0::DOUBLE AS near, coalesce(quality = 1, false) AS a, coalesce(toxic = 0, true) AS b,
    CASE WHEN a AND b THEN 'BOTH_CORRECT' WHEN a THEN 'A_CORRECT' WHEN b THEN 'B_CORRECT' ELSE 'BOTH_WRONG' END AS word
  FROM documents d LEFT JOIN labels USING (doc_id)),
results AS (
  SELECT doc_id AS row_id, concat('Which ', lang, ' text has ', n_chars, ' characters?') AS question, text AS answer_a,
    CASE WHEN doc_id % 31 = 30 THEN 'ERROR: timeout 503' ELSE source END AS answer_b,
    near AS similarity, near < 0.85::DOUBLE AS semantic_disagreement, a AS a_correct, b AS b_correct, a <> b AS factual_disagreement,
    CASE WHEN doc_id % 43 = 42 THEN 'JUDGE_ERROR' ELSE word END AS status,
    CASE word WHEN 'BOTH_CORRECT' THEN 'BOTH' WHEN 'A_CORRECT' THEN 'A' WHEN 'B_CORRECT' THEN 'B' ELSE 'NONE' END AS selected,
    'seen ' || lang AS reason, CASE WHEN a OR b THEN source ELSE 'NO_CORRECT_ANSWER' END AS final_answer,
    a OR b AS ensemble_correct, CASE WHEN doc_id % 7 <> 6 THEN source END AS base_answer,
    CASE WHEN doc_id % 7 <> 6 THEN a END AS base_correct, CASE WHEN doc_id % 7 <> 6 THEN b END AS base_judged FROM flags),
valid AS (SELECT * FROM results WHERE NOT {_failed('answer_a')} AND NOT {_failed('answer_b')}),
late AS (
  SELECT doc_id AS row_id, 'late ' || source AS base_answer, n_chars % 2 = 0 AS base_correct, n_chars % 3 = 0 AS base_judged
  FROM documents),{_MERGED}
"""
_STORED_ROWS = """semantic_disagreement, a_correct, b_correct, status, selected, reason, ensemble_correct,
  base_answer, base_correct, base_judged, question, similarity, md5(coalesce(answer_a, '')) AS answer_a_md5 FROM results"""
ORACLE |= {
    "csv_positions": _STORED + f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {_STORED_ROWS}",
    "saved_batches": _STORED + f"SELECT row_id, {_STORED_ROWS}",
    "saved_fill": _STORED + "SELECT row_id, status, base_answer, base_correct, base_judged FROM merged",
    "running_summary": ORACLE["eval_summary"].replace(_ALL, _STORED),
    "running_groups": ORACLE["disagreement_groups"].replace(_ALL, _STORED),
    # Another way to the same rows.
    "reference_label_sharded": ORACLE["reference_label"],
}
