"""SQL that says what some of the queries return, in another way than they find it."""

from __future__ import annotations

from loglattice.llm.common import UPPER


def substring_sql(window: int = 35) -> str:
    """Words covered by a window whose sequence occurs more than once."""
    return rf"""
  WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {window - 2})) AS t(i)),
  again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  starts AS (SELECT doc_id, i FROM win SEMI JOIN again USING (s)),
  words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
  marked AS (SELECT words.*, coalesce(j - i < {window}, FALSE) AS gone FROM words ASOF LEFT JOIN starts ON words.doc_id = starts.doc_id AND words.j >= starts.i),
  kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS left_over FROM marked GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
  FROM d LEFT JOIN kept USING (doc_id)"""


def url_sql(rules, ratio: float = 2.0, damping: float = 0.85, rounds: int = 12) -> str:
    """Rules by the longest match, and the rounds of both propagations one after the other."""
    listed = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in rules)
    host = lambda c: rf"translate(regexp_extract(coalesce({c}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"
    steps = "".join(
        f""",
  r{i} AS (SELECT kind, host, sum(rank) AS rank FROM (
             SELECT kind, dst AS host, rank * w * {damping} AS rank FROM r{i - 1} JOIN ways ON r{i - 1}.kind = ways.k AND r{i - 1}.host = ways.src
             UNION ALL SELECT kind, host, rank FROM r0) GROUP BY kind, host)"""
        for i in range(1, rounds + 1)
    )
    return rf"""
  WITH p AS (SELECT page_id, html, {host('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  rules(rule, verdict, rh, rp) AS (VALUES {listed}),
  fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
           FROM (SELECT DISTINCT host, path FROM p), rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
  seeds AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b
            FROM p LEFT JOIN fits USING (host, path) GROUP BY host),
  sums AS (SELECT sum(a) AS ta, sum(b) AS tb FROM seeds),
  links AS (SELECT host AS src, {host('u')} AS dst FROM
            (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1)) AS u FROM p)),
  names AS (SELECT DISTINCT array_to_string(string_split(host, '.')[i:], '.') AS h FROM (SELECT DISTINCT host FROM p WHERE host <> ''),
            unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)),
  up AS (SELECT h AS src, substr(h, instr(h, '.') + 1) AS dst FROM names WHERE instr(h, '.') > 0 AND instr(substr(h, instr(h, '.') + 1), '.') > 0),
  edges AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM links WHERE src <> dst AND src <> '' AND dst <> ''
            UNION ALL SELECT * FROM up UNION ALL SELECT dst, src FROM up) GROUP BY src, dst),
  twoway AS (SELECT 'trust' AS k, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
  ways AS (SELECT *, n / sum(n) OVER (PARTITION BY k, src) AS w FROM twoway),
  r0 AS (SELECT 'trust' AS kind, host, a / ta * {1 - damping} AS rank FROM seeds, sums WHERE a > 0
         UNION ALL SELECT 'distrust', host, b / tb * {1 - damping} FROM seeds, sums WHERE b > 0){steps},
  held AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank * ta ELSE 0 END) AS t, sum(CASE WHEN kind = 'distrust' THEN rank * tb ELSE 0 END) AS d
           FROM r{rounds}, sums GROUP BY host)
  SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN d > t * {ratio} THEN 'block' ELSE 'allow' END) AS verdict
  FROM p LEFT JOIN fits USING (host, path) LEFT JOIN held USING (host)"""


def chat_sql(marks: str) -> str:
    """Digests of the turns as given, and the lengths that the marks and escape signs add to them."""
    signs = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    control = r"\\|###|</turn>"
    return rf"""
  WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL VALUES (-7, 0, 'user', '{marks}'), (-7, 1, 'assistant', '{marks}'))
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
         CAST(sum(4 + length(role) + {signs('role', control + '|:')} + 2 + length(text) + {signs('text', control)} + 8) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id"""
