"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

import math

from .quality_rules import Rules
from .secret_scan import ACCESS, ALLOWED, CLASSES, HEX, KINDS, MIN_ASSIGNED, UNIT
from .url_filter import RULES, UPPER

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _words(text: str) -> str:
    return WORDS.format(text=text)


# All pairs of documents that share a shingle, and everything that links reach.
NEAR_DEDUP = f"""WITH RECURSIVE words AS (
  SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')")} AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reached.doc_id, y FROM reached JOIN ways ON r = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


def _rule(column: str) -> str:
    """The longest rule of an address; ``column`` is 'name' or 'verdict'."""
    ordered = sorted(RULES, key=lambda r: (len(r.name), len(r.host)), reverse=True)
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{getattr(r, column)}'"
        for r in ordered
    )
    return f"CASE {cases} END"


# The pages hold no canonical or refresh links, and addresses that differ in parameters or fragments
# have the same rule, so here aliases bring no verdict that the rules do not.
URL_FILTER = f"""WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, {_rule('name')} AS rule, coalesce({_rule('verdict')}, 'allow') AS verdict
FROM parts"""

QUALITY_RULES = f"""WITH words AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM words, unnest(range(1, len(w) - 1)) t(i) WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice CROSS JOIN range(3) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
judged AS (
  SELECT *, n_words < {Rules().min_words} OR 100 * n_repeat_words > {Rules().max_repeat_pct} * n_words AS base_failed
  FROM counts),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged WHERE host IS NOT NULL GROUP BY host),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1
                 ELSE {Rules().weak_prior} END AS weight FROM moments),
rejected AS (
  SELECT host FROM hosts CROSS JOIN prior WHERE (f + m * weight) / (n + weight) > {Rules().max_host_rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM rejected)) AS kept
FROM judged"""

WARC = """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS first FROM payloads)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts"""



def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN_SQL = f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _places(name: str, pattern: str, source: str = "texts") -> str:
    """CTE ``name``: matches of a pattern and their positions; pieces and matches follow each other."""
    return f"""{name} AS (
  SELECT doc_id, m, sum(length(s) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS start
  FROM (
    SELECT doc_id, k, ms[k] AS m, ss[k] AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ss
          FROM {source} WHERE regexp_matches(t, '{pattern}')) l,
         unnest(range(1, len(ms) + 1)) u(k)) p)"""


def _high(name: str, source: str, how) -> str:
    """CTE ``name``: from the first to the last window of high entropy in each candidate."""
    limit = math.floor((math.log2(how.window) - how.bits) * how.window * UNIT)
    wanted = ["true", *[f"regexp_matches(m, '{need}')" for need in how.needs]]
    return f"""{name} AS (
  SELECT doc_id, start + min(i) AS start, start + max(i) + {how.window} AS stop
  FROM (
    SELECT doc_id, start, m, i, sum(CAST(round(n * log2(n) * {UNIT}) AS BIGINT)) AS total
    FROM (
      SELECT doc_id, start, m, i, ch, count(*) AS n
      FROM (
        SELECT doc_id, start, m, i, unnest(string_split(substr(m, CAST(i AS INTEGER) + 1, {how.window}), '')) AS ch
        FROM {source}, unnest(range(0, length(m) - {how.window} + 1)) u(i)
        WHERE {" AND ".join(wanted)}) chars
      GROUP BY ALL) counts
    GROUP BY ALL) windows
  WHERE total <= {limit} GROUP BY doc_id, windows.start, m)"""


def _listed(spans: str) -> str:
    kinds = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS))
    return (
        f"SELECT doc_id, string_agg(CASE kind {kinds} END || ':' || CAST(start AS BIGINT) || ':' || "
        f"CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop) AS listed FROM {spans} GROUP BY doc_id"
    )


def _without_allowed(text: str) -> str:
    for part in ALLOWED:
        text = f"regexp_replace({text}, '{_any_case(part)}', '{' ' * len(part)}', 'g')"
    return text


_RUNS = ", ".join(_places(f"run{k}", c.run, "plain") for k, c in enumerate(CLASSES))
_HIGHS = ", ".join(_high(f"high{k}", f"run{k}", c) for k, c in enumerate(CLASSES))
_ALL_HIGH = " UNION ".join(f"SELECT * FROM high{k}" for k in range(len(CLASSES)))

SECRET_SCAN = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_places("assigned", ASSIGN_SQL)},
{_places("accessed", ACCESS)},
{_places("hexed", HEX)},
base AS (
  SELECT doc_id, start, 0 AS kind, start + length(m) AS stop FROM assigned
  WHERE length(regexp_extract(m, '{ASSIGN_SQL}', 2)) >= {MIN_ASSIGNED}
  UNION ALL SELECT doc_id, start, 1, start + length(m) FROM accessed
  UNION ALL SELECT doc_id, start, 2, start + length(m) FROM hexed),
plain AS (SELECT doc_id, {_without_allowed("t")} AS t FROM texts),
{_RUNS}, {_HIGHS},
high AS ({_ALL_HIGH}),
-- Edges of the base spans inside each span of high entropy, between its own ends.
edges AS (
  SELECT e.doc_id, e.start, e.stop, b.start AS lo, b.stop AS hi
  FROM high e JOIN base b ON b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop
  UNION ALL SELECT doc_id, start, stop, start, start FROM high
  UNION ALL SELECT doc_id, start, stop, stop, stop FROM high),
beside AS (
  SELECT DISTINCT doc_id, past AS start, lo AS stop
  FROM (
    SELECT doc_id, lo, max(greatest(hi, start)) OVER (
      PARTITION BY doc_id, start, stop ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
    FROM edges) p
  WHERE past < lo),
spans AS (
  SELECT doc_id, start, kind, stop FROM base
  UNION ALL
  SELECT doc_id, start, {len(KINDS) - 1}, stop FROM beside),
base_listed AS ({_listed("base")}),
all_listed AS ({_listed("spans")}),
counts AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h
  FROM base GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base_listed.listed, '')) AS base_sha256, coalesce(all_listed.listed, '') AS spans
FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN base_listed USING (doc_id) LEFT JOIN all_listed USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op1_near_dedup": NEAR_DEDUP,
    "op5_url_filter": URL_FILTER,
    "op6_quality_rules": QUALITY_RULES,
    "op9_secret_scan": SECRET_SCAN,
    "op10_warc": WARC,
}
