r"""DuckDB SQL of the queries in plans.queries, written apart from the expressions it checks.

RE2 has no look-around, so guards consume one character; \b is ASCII there, so word guards are spelt out.
"""

from __future__ import annotations

from vellum.functions import patterns as R
from vellum.plans.queries import GOLDEN, PARSED

EMAIL, FULL_DATE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", R.FULL_DATE.removeprefix(R.P)
NAMED = "(?i)" + R.NAMED_DATE.removeprefix(R.I)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pronouns() -> str:
    s = "text"
    edge = r"[^\p{L}\p{N}_]"
    for pattern, to in R.PRONOUNS:
        word = pattern.removeprefix(r"\b").removesuffix(r"\b").removesuffix(r"\.?")
        for _ in range(2):  # neighbours share a guard
            s = f"regexp_replace({s}, '(^|{edge}){word}($|{edge})', '\\1{to}\\2', 'g')"
    return f"SELECT doc_id, sha256(regexp_replace({s}, '  +', ' ', 'g')) AS text_sha256 FROM documents"


#: Everything up to the ranking.
BASE = r"""
cand AS (SELECT doc_id, text, n_chars, printf('Candidate_%02d', row_number() OVER (ORDER BY doc_id)) AS candidate_id FROM documents),
tax AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark WHERE item_id < 3)
  WHERE length(w) >= 3 AND w NOT LIKE '%s'),
job AS (SELECT w FROM tax, benchmark WHERE item_id = 0 AND regexp_matches(lower(text), '(^|[^a-z0-9-])' || w || '($|[^a-z0-9-])')),
known AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '[^\s]')),
has AS (SELECT doc_id, w FROM documents, tax WHERE regexp_matches(lower(text), '(^|[^a-zA-Z0-9.+#])' || w || '($|[^a-zA-Z0-9.+#])')),
quality AS (SELECT k.doc_id, count(h.w) AS n,
    round(0.08 + 0.15 + CASE WHEN count(h.w) >= 15 THEN 0.20 WHEN count(h.w) >= 8 THEN 0.12 WHEN count(h.w) >= 3 THEN 0.06 ELSE 0 END, 4) AS q
  FROM known k LEFT JOIN has h USING (doc_id) GROUP BY k.doc_id),
skill AS (SELECT c.doc_id, c.candidate_id,
    coalesce(list(j.w ORDER BY j.w) FILTER (WHERE h.w IS NOT NULL AND k.doc_id IS NOT NULL), []) AS matched,
    coalesce(list(j.w ORDER BY j.w) FILTER (WHERE h.w IS NULL OR k.doc_id IS NULL), []) AS missing, count(j.w) AS total
  FROM cand c CROSS JOIN job j LEFT JOIN has h ON h.doc_id = c.doc_id AND h.w = j.w LEFT JOIN known k ON k.doc_id = c.doc_id GROUP BY c.doc_id, c.candidate_id),
one AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
sem AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS semantic_score FROM embeddings, one),
mixed AS (SELECT s.*, coalesce(e.semantic_score, 0.5)::DOUBLE AS sem, coalesce(q.q, 0.5)::DOUBLE AS q, len(matched)::DOUBLE / total AS kw, q.doc_id IS NOT NULL AS parsed
  FROM skill s LEFT JOIN sem e ON e.vec_id = s.doc_id LEFT JOIN quality q ON q.doc_id = s.doc_id),
scored AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.65::DOUBLE * sem + 0.35::DOUBLE * kw) * (0.85::DOUBLE + 0.15::DOUBLE * q))) AS raw FROM mixed),
ranked AS (SELECT *, round(raw, 6) AS final_score, round(sem, 6) AS semantic_score, round(kw, 6) AS keyword_score, round(q, 6) AS quality_score,
    (row_number() OVER (ORDER BY raw DESC, candidate_id))::INT AS rank FROM scored),
judged AS (SELECT *, CASE WHEN final_score >= 0.75 THEN 'Strong Match' WHEN final_score >= 0.60 THEN 'Good Match'
    WHEN final_score >= 0.45 THEN 'Partial Match' ELSE 'Weak Match' END AS verdict, count(*) OVER () AS n_all FROM ranked),
pct AS (SELECT *, CAST(round_even(keyword_score * 100, 0) AS INT) || '%' AS rate FROM judged),
strong AS (SELECT *, list_filter([CASE WHEN len(missing) = 0 THEN 'Complete skill match — all required skills present'
      WHEN keyword_score >= 0.7 THEN 'Strong skill match — ' || rate || ' of required skills present' END,
    CASE WHEN semantic_score >= 0.7 THEN 'High semantic relevance — CV content closely matches job requirements' END,
    CASE WHEN quality_score >= 0.8 THEN 'Well-structured CV indicating attention to detail' END], lambda x: x IS NOT NULL) AS strengths FROM pct),
told AS (SELECT *, coalesce(strengths[1], 'Strong overall profile') AS top,
    'Ranked #' || rank || CASE WHEN n_all > 1 THEN ' of ' || n_all ELSE '' END || ' — ' || CASE verdict
      WHEN 'Strong Match' THEN 'strong skill alignment with the job requirements' WHEN 'Good Match' THEN 'good overall fit, limited experience on record'
      WHEN 'Partial Match' THEN 'partial match, significant gaps in required skills' ELSE 'weak match, skills are largely misaligned with requirements' END AS headline FROM strong),
final AS (SELECT *, CASE
    WHEN verdict = 'Strong Match' AND len(missing) > 0 THEN 'Recommended for interview. ' || top || '. Suggest probing ' || missing[1] || ' in the interview.'
    WHEN verdict = 'Strong Match' THEN 'Recommended for interview. ' || top || '. Candidate meets all listed requirements.'
    WHEN verdict = 'Good Match' AND len(missing) > 0 THEN 'Consider for interview. Good overall fit. May need support with ' || array_to_string(missing[1:2], ', ') || '.'
    WHEN verdict = 'Good Match' THEN 'Consider for interview. Good overall fit. Candidate meets all listed requirements.'
    WHEN verdict = 'Partial Match' AND len(missing) > 0 THEN 'Review manually. Has potential but significant gaps in ' || array_to_string(missing[1:3], ', ') || '.'
    WHEN verdict = 'Partial Match' THEN 'Review manually. Has potential but no specific skill gaps identified.'
    WHEN len(missing) > 0 THEN 'Not recommended at this stage. Significant skill gaps: ' || array_to_string(missing[1:3], ', ') || '.'
    ELSE 'Not recommended at this stage. Overall profile does not match the job requirements.' END AS recommendation FROM told)"""

CHECKS = """
a AS (SELECT count(*) AS n, max(final_score) - min(final_score) AS spread, max(quality_score) - min(quality_score) AS wide,
    count(*) FILTER (WHERE len(matched) = 0 AND total > 0) AS zero, count(*) FILTER (WHERE NOT parsed) AS lost FROM ranked),
top AS (SELECT abs(semantic_score - keyword_score) > 0.40 AS far FROM ranked WHERE rank = 1),
both_ AS (SELECT r.rank::DOUBLE AS y, c.n_chars::DOUBLE AS x FROM ranked r JOIN cand c USING (candidate_id) JOIN known k ON k.doc_id = c.doc_id),
r AS (SELECT count(*) AS n, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) AS r FROM both_)"""


def q(body: str, *more: str) -> str:
    return f"WITH {', '.join([BASE, *more])} {body}"


def flag(check: str, label: str, when: str, source: str = "a") -> str:
    return q(f"SELECT '{check}' AS check_id, '{label}' AS label, ({when}) AS flagged, CASE WHEN {when} THEN 'FLAGGED' ELSE 'OK' END AS status FROM {source}", CHECKS)


def values(rows: list[tuple], names: str) -> str:
    told = lambda v: text(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS x({names})"


_GAPS = """list_concat(list_concat(list_transform(missing[1:5], lambda s: 'Missing ' || s || ' — listed as required in JD'),
    CASE WHEN len(missing) > 5 THEN ['...and ' || (len(missing) - 5) || ' more skill' || CASE WHEN len(missing) - 5 <> 1 THEN 's' ELSE '' END || ' not found in CV'] ELSE [] END),
  list_concat(CASE WHEN parsed THEN ['Limited professional experience (under 1 year)'] ELSE [] END,
  list_concat(CASE WHEN len(missing) = 0 AND keyword_score < 0.3 THEN ['Low skill overlap with job requirements'] ELSE [] END,
  CASE WHEN quality_score < 0.5 THEN ['CV may be incomplete or poorly structured'] ELSE [] END)))"""
_N = "total || ' required skill' || CASE WHEN total <> 1 THEN 's' ELSE '' END"

EMAILS = f"len(regexp_extract_all(text, '{EMAIL}'))"

ORACLES: dict[str, str] = {
    "judge_documents": q("SELECT rank, candidate_id, printf('%.4f', final_score)::DOUBLE AS final_score, verdict, headline, recommendation FROM final"),
    "candidate_cards": q("""SELECT candidate_id, rank, verdict, headline, CASE verdict WHEN 'Strong Match' THEN 'strong' WHEN 'Good Match' THEN 'good' WHEN 'Partial Match' THEN 'partial' ELSE 'weak' END AS badge,
  CAST(round_even(printf('%.4f', final_score)::DOUBLE * 100, 0) AS INT) || '%' AS score, CASE WHEN final_score >= 0.75 THEN 'excellent' WHEN final_score >= 0.55 THEN 'good' WHEN final_score >= 0.40 THEN 'fair' ELSE 'poor' END AS band,
  lag(candidate_id) OVER (ORDER BY rank) AS prev_id, lead(candidate_id) OVER (ORDER BY rank) AS next_id FROM final"""),
    "redact_email": f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[EMAIL_REDACTED]', 'g')) AS text_sha256, {EMAILS}::BIGINT AS n FROM documents",
    "redact_dates": f"""WITH a AS (SELECT doc_id, regexp_replace(text, '{FULL_DATE}', '[DATE_REDACTED]', 'g') AS t, len(regexp_extract_all(text, '{FULL_DATE}')) AS n FROM documents)
SELECT doc_id, sha256(regexp_replace(t, '{NAMED}', '[DATE_REDACTED]', 'g')) AS text_sha256, (n + len(regexp_extract_all(t, '{NAMED}')))::BIGINT AS n FROM a""",
    "neutral_pronouns": _pronouns(),
    "redact_page_urls": r"SELECT page_id, regexp_replace(url, '(?i)https?://[^\s,]+', '[URL_REDACTED]', 'g') AS text, len(regexp_extract_all(url, '(?i)https?://[^\s,]+'))::BIGINT AS n FROM pages",
    "golden_redaction": values([(g[0], g[3]) for g in GOLDEN], 'case_, text').replace("SELECT *", 'SELECT case_ AS "case", text'),
    "golden_parsing": values(list(PARSED), "c, summary, skills, months, roles, education, certifications, languages, quality_score").replace("SELECT *", 'SELECT c AS "case", summary, skills, months, roles, education, certifications, languages, quality_score::DOUBLE AS quality_score'),
    "exact_dedup": r"""WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first, doc_id <> min(doc_id) OVER (PARTITION BY h) AS is_duplicate FROM d""",
    "skills_by_document": q("SELECT doc_id, w AS skill FROM has"),
    "taxonomy_match": r"""WITH b AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3) AS w FROM benchmark),
n AS (SELECT unnest(w) AS n FROM b UNION SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
p AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9.+#]+|[^a-zA-Z0-9.+#]+') AS p FROM documents),
f AS (SELECT doc_id, unnest(p) AS n FROM p UNION SELECT doc_id, unnest(list_transform(range(2, len(p)), lambda i: p[i - 1] || p[i] || p[i + 1])) FROM p)
SELECT doc_id, count(*) AS n_names, sha256(string_agg(upper(n), ',' ORDER BY upper(n))) AS names_sha256 FROM f SEMI JOIN n USING (n) GROUP BY doc_id""",
    "parse_periods": """WITH c AS (SELECT DISTINCT change_id AS k FROM client_changes WHERE change_id IS NOT NULL),
m AS (SELECT k, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'] AS names, k % 360 AS a, k % 360 + k % 50 AS b FROM c),
p AS (SELECT k, CASE k % 3 WHEN 0 THEN k % 50 WHEN 1 THEN 12 * (k % 5) ELSE k % 40 END AS months,
  CASE k % 3 WHEN 0 THEN names[a % 12 + 1] || ' ' || (1990 + a // 12) || ' - ' || names[b % 12 + 1] || ' ' || (1990 + b // 12)
    WHEN 1 THEN (1990 + k % 30) || ' - ' || (1990 + k % 30 + k % 5) ELSE (k % 40) || ' months' END AS period FROM m)
SELECT (k // 20)::VARCHAR AS candidate_id, count(*)::INT AS n_roles, sum(months)::INT AS months, string_agg(period || '=' || months, '|' ORDER BY k) AS periods, 'English' AS languages
FROM p GROUP BY k // 20""",
    "jd_skills": q("SELECT item_id, w AS skill FROM benchmark, tax WHERE regexp_matches(lower(text), '(^|[^a-z0-9-])' || w || '($|[^a-z0-9-])')"),
    "keyword_score": q("""SELECT d.doc_id, coalesce(string_agg(j.w, ',' ORDER BY j.w) FILTER (WHERE h.w IS NOT NULL), '') AS matched,
  coalesce(string_agg(j.w, ',' ORDER BY j.w) FILTER (WHERE h.w IS NULL), '') AS missing, round(count(h.w)::DOUBLE / count(*), 6) AS keyword_score
FROM documents d CROSS JOIN job j LEFT JOIN has h ON h.doc_id = d.doc_id AND h.w = j.w GROUP BY d.doc_id"""),
    "semantic_score": q("SELECT * FROM sem"),
    "rank_candidates": q("SELECT candidate_id, rank, final_score, semantic_score, keyword_score, quality_score, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, total::INT AS jd_skill_count FROM ranked"),
    "explain_lists": q(f"""SELECT candidate_id, verdict, array_to_string(strengths, '|') AS strengths, array_to_string({_GAPS}, '|') AS gaps, recommendation, rate AS match_rate,
  CASE WHEN len(matched) = total THEN 'Candidate has all ' || {_N} || '.' ELSE 'Candidate has ' || len(matched) || ' of ' || {_N} || '. Missing: ' || array_to_string(missing[1:3], ', ')
    || CASE WHEN len(missing) > 3 THEN ', and ' || (len(missing) - 3) || ' more' ELSE '' END || '.' END AS skills_summary,
  CASE WHEN parsed THEN 'No experience entries could be extracted from this CV.' ELSE 'Detailed experience data unavailable — parsed CV not found.' END AS experience_summary,
  CASE WHEN len(matched) = total THEN 'Matched all ' || {_N} ELSE 'Matched ' || len(matched) || ' of ' || {_N} END AS keyword_note,
  CASE WHEN semantic_score >= 0.8 THEN 'Excellent' WHEN semantic_score >= 0.6 THEN 'Good' WHEN semantic_score >= 0.4 THEN 'Fair' ELSE 'Poor' END AS semantic_label FROM final"""),
    "verdict_histogram": q("""SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'Strong Match') AS n_strong, count(*) FILTER (WHERE verdict = 'Good Match') AS n_good,
  count(*) FILTER (WHERE verdict = 'Partial Match') AS n_partial, count(*) FILTER (WHERE verdict = 'Weak Match') AS n_weak, ((200 * sum(CAST(printf('%.4f', final_score)::DECIMAL(18, 4) * 10000 AS BIGINT)) + count(*)) // (2 * count(*)))::DOUBLE / 1000000 AS avg_score,
  count(*) FILTER (WHERE verdict IN ('Strong Match', 'Good Match')) AS n_recommended, round(count(*) FILTER (WHERE verdict IN ('Strong Match', 'Good Match'))::DOUBLE / count(*), 6) AS recommended_share FROM judged"""),
    "score_distribution": q("SELECT 'score_distribution' AS check_id, false AS flagged, printf('%.4f', min(final_score))::DOUBLE AS min, printf('%.4f', max(final_score))::DOUBLE AS max, printf('%.4f', avg(final_score))::DOUBLE AS mean, printf('%.4f', stddev_pop(final_score))::DOUBLE AS stddev, printf('%.4f', max(final_score) - min(final_score))::DOUBLE AS spread FROM ranked"),
    "score_compression": flag("score_compression", "Score Compression", "n >= 2 AND spread < 0.10"),
    "quality_spread": flag("quality_score_spread", "CV Quality Score Influence", "n >= 2 AND wide > 0.50"),
    "skill_gap": flag("skill_gap_disparity", "Skill-Gap Disparity", "zero > 0"),
    "semantic_gap": flag("semantic_keyword_gap", "Semantic vs Keyword Gap", "far", "top"),
    "parsed_coverage": flag("parsed_coverage", "Parsed Data Coverage", "unlabelled > 0", "(SELECT count(*) AS unlabelled FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM labels))"),
    "experience_correlation": q("SELECT 'experience_correlation' AS check_id, n >= 3 AND abs(r) > 0.85 AS flagged, printf('%.4f', r)::DOUBLE AS pearson_r, n AS candidates_analysed, CASE WHEN r < 0 THEN 'higher' ELSE 'lower' END AS correlation_direction FROM r", CHECKS),
    "zero_match": q("SELECT candidate_id, rank, len(matched)::INT AS matched_count, len(missing)::INT AS missing_count, total::INT AS jd_skill_count FROM ranked WHERE len(matched) = 0 AND total > 0"),
    "bias_summary": q("""SELECT 7::BIGINT AS total_checks, f AS flags_raised, f > 0 AS overall_flag, CASE WHEN f > 0 THEN 'BIAS RISK DETECTED' ELSE 'NO BIAS SIGNALS DETECTED' END AS overall_label
FROM (SELECT (a.n >= 2 AND spread < 0.10)::BIGINT + (a.n >= 2 AND wide > 0.50)::BIGINT + (zero > 0)::BIGINT + far::BIGINT + (lost > 0)::BIGINT + (r.n >= 3 AND abs(r.r) > 0.85)::BIGINT AS f FROM a, top, r)""", CHECKS),
    "ranked_without_record": q("SELECT candidate_id FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "audit_event_log": q(f"""SELECT event_type, stage, severity, count(*) AS n, min(k)::INT AS first, max(k)::INT AS last FROM (
  SELECT event_type, stage, severity, row_number() OVER (ORDER BY g, key, event_type) AS k FROM (
    SELECT 1 AS g, '' AS key, 'PIPELINE_START' AS event_type, 'main' AS stage, 'INFO' AS severity
    UNION ALL SELECT 2, candidate_id, 'CV_RECEIVED', 'module0', 'INFO' FROM cand
    UNION ALL SELECT 3, candidate_id, 'PII_REMOVED', 'module0', CASE WHEN {EMAILS} > 0 THEN 'WARNING' ELSE 'INFO' END FROM cand
    UNION ALL SELECT 4, candidate_id, 'CV_PARSED', 'module0b', 'WARNING' FROM ranked WHERE parsed
    UNION ALL SELECT 5, printf('%012d', rank), 'CANDIDATE_RANKED', 'module1', 'INFO' FROM ranked
    UNION ALL SELECT 6, printf('%012d', rank), 'EXPLANATION_WRITTEN', 'module2', 'INFO' FROM ranked
    UNION ALL SELECT 7, candidate_id, 'DATA_RETAINED', 'module3', 'INFO' FROM cand
    UNION ALL SELECT 8, '1' || candidate_id, 'WARNING', 'module0', 'WARNING' FROM cand WHERE {EMAILS} > 0
    UNION ALL SELECT 8, '2' || candidate_id, 'WARNING', 'module0b', 'WARNING' FROM ranked WHERE parsed
    UNION ALL SELECT 9, '', 'PIPELINE_COMPLETE', 'module3', 'INFO')) GROUP BY event_type, stage, severity"""),
    "event_summary": """SELECT count(*) AS total_events, count(*) FILTER (WHERE event_type = 'view') AS pii_removal_events, count(*) FILTER (WHERE event_type = 'click') AS cv_parsed_events,
  count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS ranking_events, 0::BIGINT AS explanation_events, 0::BIGINT AS data_retained_events,
  count(*) FILTER (WHERE value > 100) AS warnings, 0::BIGINT AS errors FROM events""",
    "gdpr_checks": q(f"""SELECT x.* FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {EMAILS} > 0) AS p FROM cand) c, LATERAL (VALUES
  (1, 'article_5', p > 0, CASE WHEN p > 0 THEN 'Vault records found for ' || n || ' candidate(s). PII categories identified and removed before ranking.' ELSE 'Vault is empty or pii_categories_found is missing — cannot confirm PII was properly identified and removed.' END),
  (2, 'article_13', true, 'Explanation generated for ' || n || ' candidate(s). Each explanation includes score breakdown, verdict, and recommendation.'),
  (3, 'article_17', false, '2 raw CV file(s) still present in raw_cvs/. Original CVs must be deleted manually to satisfy Art. 17. Action required: delete all files from raw_cvs/ after processing.'),
  (4, 'article_22', true, 'All ' || n || ' explanation(s) contain human-review language in their recommendations.'),
  (5, 'article_25', true, 'Anonymization applied to ' || n || ' CV(s) by module0 (vault records present). Ranking performed on anonymized text for ' || n || ' candidate(s). Privacy-by-design order confirmed.'),
  (6, 'article_30', true, 'Full audit log generated at audit/audit_log.json (run ID: RUN_1). Records of all processing activities are maintained.')) AS x(ord, article, satisfied, evidence)"""),
    "prev_next": q("SELECT candidate_id, rank, lag(candidate_id) OVER (ORDER BY rank) AS prev_id, lead(candidate_id) OVER (ORDER BY rank) AS next_id FROM ranked"),
    "verdict_filter": q("SELECT candidate_id, rank FROM judged WHERE verdict = 'Weak Match'"),
    "csv_export": q("""SELECT rank::VARCHAR AS "Rank", candidate_id AS "Candidate ID", printf('%.4f', final_score) AS "Final Score", verdict AS "Verdict", printf('%.4f', semantic_score) AS "Semantic Score",
  printf('%.4f', keyword_score) AS "Keyword Score", printf('%.4f', quality_score) AS "Quality Score", array_to_string(matched, '; ') AS "Matched Skills", array_to_string(missing, '; ') AS "Missing Skills",
  recommendation AS "Recommendation" FROM final"""),
    "latest_run": "SELECT strftime(ts, '%Y-%m-%d') AS run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS total_cvs FROM events GROUP BY 1 ORDER BY started_at DESC, run_id DESC LIMIT 20",
    "upsert_merge": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS first_seen
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "upsert_changes": """WITH n AS (
  SELECT client_id, arg_max(struct_pack(segment, city, balance), (seq, change_id, valid_at)) AS last, arg_min(source, (seq, change_id, valid_at)) FILTER (WHERE source IS NOT NULL) AS first
  FROM client_changes GROUP BY client_id)
SELECT coalesce(c.client_id, n.client_id) AS client_id, coalesce(c.source, n.first) AS source, CASE WHEN n.last IS NULL THEN c.segment ELSE n.last.segment END AS segment,
  CASE WHEN n.last IS NULL THEN c.city ELSE n.last.city END AS city, CASE WHEN n.last IS NULL THEN c.balance ELSE n.last.balance END AS balance
FROM clients c FULL JOIN n ON c.client_id IS NOT DISTINCT FROM n.client_id""",
    "store_history": """WITH o AS (SELECT *, o_orderstatus <> 'F' AS late FROM orders)
SELECT o_orderpriority AS run_id, o_custkey::VARCHAR AS candidate_id, arg_max(o_totalprice, (late, o_orderkey)) AS final_score,
  arg_max(o_orderstatus, (late, o_orderkey)) AS verdict, arg_min(o_orderkey, (late, o_orderkey))::VARCHAR AS ranked_at FROM o GROUP BY ALL""",
    "dashboard_stats": q("""SELECT 'RUN_1' AS run_id, (SELECT count(*) FROM ranked) AS total_cvs, 'completed' AS run_status, 'a' AS started_at, 'b' AS finished_at, candidate_id AS top_candidate, final_score AS top_score,
  (SELECT (a.n >= 2 AND spread < 0.10)::BIGINT + (a.n >= 2 AND wide > 0.50)::BIGINT + (zero > 0)::BIGINT + far::BIGINT + (lost > 0)::BIGINT + (r.n >= 3 AND abs(r.r) > 0.85)::BIGINT FROM a, top, r) AS flags_raised
FROM ranked WHERE rank = 1""", CHECKS),
    "record_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "audit_tree": f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place,
  sha256('0:' || concat_ws('|', event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S'), props)) AS digest FROM events),
{', '.join(f"l{k} AS (SELECT place // 256 AS place, sha256('1:' || string_agg(digest, '' ORDER BY place)) AS digest FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY place // 256)" for k in range(1, 5))}
{' UNION ALL '.join(f"SELECT {k} AS level, place::BIGINT AS place, digest FROM l{k}" for k in range(5))}""",
    "audit_overview": q(f"""SELECT candidate_id, {EMAILS.replace('text', 'c.text')}::INT AS pii_count, r.rank, r.final_score, j.verdict,
  CASE WHEN r.parsed THEN round(r.q, 4) END AS quality_score FROM cand c JOIN ranked r USING (candidate_id) JOIN judged j USING (candidate_id)"""),
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
