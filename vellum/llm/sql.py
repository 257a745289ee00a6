"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from vellum.llm import codes, licences, retention, urls
from vellum.llm.licence_texts import LICENCES, SPELLINGS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licences() -> str:
    def canonical(column: str) -> str:
        s = f"chr(10) || lower(coalesce({column}, ''))"
        return f"replace(regexp_replace(regexp_replace({s}, {text(licences.COPYRIGHT_LINE)}, chr(10), 'g'), {text(licences.NOT_WORD)}, ' ', 'g'), ' ', '  ')"

    def spelt(column: str) -> str:
        s = f"'  ' || {column} || '  '"
        for variant, standard in SPELLINGS:
            s = f"replace({s}, {text(f' {variant.replace(" ", "  ")} ')}, {text(f' {standard.replace(" ", "  ")} ')})"
        return s

    known = ", ".join(f"({text(k)}, {text(v)})" for k, v in LICENCES.items())
    final = lambda: f"trim(replace({spelt('c')}, '  ', ' '))"
    return f"""
WITH known0 AS (SELECT * FROM (VALUES {known}) AS k(licence_id, text)),
known1 AS (SELECT licence_id, {canonical('text')} AS c FROM known0),
known AS (SELECT sha256({final()}) AS h, min(licence_id) AS licence_id FROM known1 GROUP BY 1),
docs AS (SELECT doc_id, {canonical('text')} AS c FROM documents),
done AS (SELECT doc_id, {final()} AS c FROM docs)
SELECT doc_id, length(c)::BIGINT AS n_canonical_chars, sha256(c) AS canonical_sha256, licence_id
FROM done LEFT JOIN known ON sha256(c) = h"""


def _chat() -> str:
    escaped = lambda c: f"replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '\"', chr(92) || 'q')"
    extra = r"\### Assistant: </turn> ok"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {text(extra)}), (-7, 1, 'assistant', {text(extra)})) AS x(conv_id, turn, role, text)),
d AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length({escaped('role')}) + length({escaped('text')}) + length('<turn role="">') + length('</turn>') + 3) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  chars::BIGINT AS formatted_chars FROM d"""


def _urls() -> str:
    fold = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"
    rules = ", ".join(f"({text(r)}, {text(r.partition('/')[0])}, {text('/' + r.partition('/')[2])}, {text(v)})" for r, v in urls.RULES)
    listed = ", ".join(f"({text(u)})" for u in urls.LISTED)
    return f"""
WITH p AS (SELECT page_id, url, {fold("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {rules}) AS x(rule, site, start, verdict)),
l AS (SELECT * FROM (VALUES {listed}) AS x(site)),
f AS (SELECT DISTINCT url, first_value(rule) OVER w AS rule, first_value(verdict) OVER w AS verdict FROM p JOIN r
  ON (p.host = r.site OR ends_with(p.host, '.' || r.site)) AND starts_with(p.path, r.start)
  WINDOW w AS (PARTITION BY url ORDER BY length(rule) DESC, rule DESC)),
b AS (SELECT DISTINCT url FROM p JOIN l ON p.host = l.site OR ends_with(p.host, '.' || l.site))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN b.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN f ON p.url = f.url LEFT JOIN b ON p.url = b.url"""


def crc32(value: str) -> str:
    """crc32 of an SQL text; the table follows from the polynomial."""

    def entry(k: int) -> int:
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        return k

    table = ", ".join(str(entry(k)) for k in range(256))
    step = f"lambda c, b: xor(c >> 8, ([{table}]::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _retention() -> str:
    return f"""
WITH own AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
hashed AS (SELECT *, {crc32('click_id::VARCHAR')} AS h FROM own),
known AS (
  SELECT client_id, epoch_us(ts) AS ts, kind = '{retention.START_KIND}' AS starts,
    arrived_at + to_days(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END::INT) < TIMESTAMP '{retention.CUTOFF}' AS early,
    coalesce(floor(100 * value + 0.5)::BIGINT, 0) AS cents FROM hashed),
seen AS (SELECT 0 AS state, * FROM known WHERE early UNION ALL SELECT 1, * FROM known),
starts AS (SELECT state, client_id, min(ts) AS since FROM seen WHERE starts GROUP BY ALL),
both_states AS (SELECT client_id, count(*) = 2 AND min(since // {retention.WEEK}) <> max(since // {retention.WEEK}) AS moved FROM starts GROUP BY ALL),
named AS (SELECT client_id, min(source) AS segment FROM clients GROUP BY ALL),
spent AS (
  SELECT state, client_id, since, (ts - since) // {retention.WEEK} AS period, sum(cents) AS cents
  FROM seen JOIN starts USING (state, client_id) WHERE ts >= since GROUP BY ALL)
SELECT state::INT AS state, coalesce(segment, '') AS segment, (since // {retention.WEEK})::BIGINT AS cohort, period::BIGINT AS period, count(*)::BIGINT AS users,
  sum({crc32('client_id::VARCHAR')})::BIGINT AS users_crc32, count(*) FILTER (WHERE moved)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM spent LEFT JOIN named USING (client_id) JOIN both_states USING (client_id) GROUP BY ALL"""


def _codes() -> str:
    cut = f"lambda p: list_transform(range(1, len(embedding) // {codes.PARTS} + 1), lambda k: floor({codes.SCALE} * embedding[p * (len(embedding) // {codes.PARTS}) + k]::DOUBLE)::BIGINT)"
    steps = []
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v FROM (
    SELECT rid, x.part, entry, x.v, list_sum(list_transform(list_zip(x.v, b.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d
    FROM parts x JOIN book{k} b ON x.part = b.part) GROUP BY rid, part)""")
        if k < codes.ROUNDS:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, floor(sum(c) / count(*))::BIGINT AS c FROM (
        SELECT part, entry, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS pos FROM near{k}) GROUP BY part, entry, pos) GROUP BY part, entry) m
  ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(range(0, {codes.PARTS}), {cut}) AS cut FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, unnest(range(0, {codes.PARTS})) AS part, unnest(cut) AS v FROM kept),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= {codes.ENTRIES}),
{','.join(steps)},
done AS (SELECT rid, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{codes.ROUNDS} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS sha FROM book{codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha FROM books) AS codebooks_sha256 FROM kept JOIN done USING (rid)"""


ORACLES: dict[str, str] = {
    "op1_licences": _licences(), "op2_chat": _chat(), "op9_urls": _urls(), "op11_retention": _retention(), "op13_codes": _codes(),
}
