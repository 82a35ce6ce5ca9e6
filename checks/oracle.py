"""DuckDB SQL that must give the same rows as the query of the same name in the catalog.

Each statement restates the definition of its operator directly, also where that is quadratic:
it runs on small tables only.
"""

from __future__ import annotations

from checks.catalog import AS_OF, FIXED_TIME, SIZE_LIMIT
from semblance.functions.code import CODE_TOKEN_PATTERN, OPERATORS
from semblance.functions.text import BLANKS, QUOTED_PATTERN, TERM_PATTERN, TOKEN_PATTERN, WORD
from semblance.settings import ARTICLE_HOSTS, NOTEBOOK_SEPARATOR, PYTHON_KEYWORDS

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(q(v) for v in values)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SUBS = """subs AS (SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, text AS raw_text,
  doc_id AS ingest_order FROM documents)"""
TARGETS = "targets AS (SELECT corpus_id, arg_min(name, ingest_order) AS target FROM subs GROUP BY corpus_id)"
PAIRS = """pairs AS (SELECT s.corpus_id, t.target, s.name AS other FROM subs s
  JOIN targets t ON s.corpus_id = t.corpus_id AND s.name <> t.target)"""
REMOVED = """removed AS (SELECT 'removed' AS corpus_id, CAST(item_id AS VARCHAR) AS name, text AS raw_text FROM benchmark)"""
CACHED = """cached AS (SELECT s.corpus_id, s.name, CASE WHEN l.quality = 0 THEN 'old ' || s.raw_text ELSE s.raw_text END AS raw_text
  FROM subs s JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.name UNION ALL SELECT * FROM removed)"""
MEMBERS = """members AS (SELECT 'conv' || conv_id || '.zip' AS archive,
  CASE conv_id % 3 WHEN 0 THEN 'box/' || role || '/' || turn || '.txt'
    WHEN 1 THEN role || '/' || turn || '.txt' ELSE turn || '.txt' END AS member_path,
  turn AS member_no, text AS content FROM conversations)"""


def strip_sql(x: str) -> str:
    doc = r"(?m)^[ \t]*(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"
    return rf"regexp_replace(regexp_replace({x}, '#[^\n]*', '', 'g'), {q(doc)}, '', 'g')"


def ws_sql(x: str) -> str:
    one = rf"regexp_replace({x}, {q('[' + BLANKS + ']+')}, ' ', 'g')"
    two = rf"regexp_replace({one}, '[ \n]*\n[ \n]*', chr(10), 'g')"
    return f"trim({two}, ' ' || chr(10))"


def anon_sql(x: str) -> str:
    strings = f"regexp_replace({x}, {q(QUOTED_PATTERN)}, {q(chr(39) + 'STR' + chr(39))}, 'g')"
    number = rf"(^|[^{WORD}.])[0-9][{WORD}]*(?:\.[0-9][{WORD}]*)?"
    numbers = rf"regexp_replace({strings}, {q(number)}, '\10', 'g')"
    return rf"regexp_replace({numbers}, '\b(?:True|False)\b', '0', 'g')"


def processed_sql(x: str) -> str:
    return anon_sql(ws_sql(strip_sql(x)))


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {q(TOKEN_PATTERN)}, 1)"


def nonblank_sql(x: str) -> str:
    return f"regexp_matches({x}, {q('[^' + chr(92) + 'n' + BLANKS + ']')})"


def hash_sql(x: str) -> str:
    return f"substring(md5({x}), 1, 16)"


# ---- sources and sinks ----

ORACLE["src_submissions"] = """SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, length(text)::BIGINT AS n_chars FROM documents"""
ORACLE["src_features"] = f"""SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name,
  len({tokens_sql(processed_sql('text'))})::BIGINT AS n_tokens FROM documents WHERE strlen(text) <= 5242880"""
ORACLE["notebook_cells"] = f"""SELECT conv_id, turn, CASE WHEN role = 'system' THEN ''
  ELSE role || chr(10) || text || replace({q(NOTEBOOK_SEPARATOR.replace(chr(10), '~'))}, '~', chr(10)) || 'again ' || text END AS code
  FROM conversations"""


def decode_sql(x: str) -> str:
    """The character references that occur in the pages, the ampersand last."""
    for reference, sign in (
        ("&#8217;", "\u2019"), ("&#x27;", "'"), ("&eacute;", "\u00e9"), ("&mdash;", "\u2014"), ("&nbsp;", "\u00a0"),
        ("&hellip;", "\u2026"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"),
    ):
        x = f"replace({x}, {q(reference)}, {q(sign)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def trim_sql(x: str) -> str:
    edge = rf"^[\n{BLANKS}]+|[\n{BLANKS}]+$"
    return f"regexp_replace({x}, {q(edge)}, '', 'g')"


def clean_sql(x: str) -> str:
    drop = rf"[^{WORD}\n{BLANKS}-]"
    return f"substring({trim_sql(f'regexp_replace({x}, {q(drop)}, {q(str())}, {q(chr(103))})')}, 1, 100)"


ORACLE["page_articles"] = rf"""WITH p AS (SELECT page_id, url, replace(html, '</article>',
    '<p>It&#8217;s a caf&eacute; &mdash; &#x27;ok&#x27;&nbsp;&hellip;</p></article><article>Second</article>') AS html FROM pages),
  v AS (SELECT *, regexp_replace(html,
    '(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<!--[\s\S]*?-->|<aside[\s\S]*?</aside>|<nav[\s\S]*?</nav>|<footer[\s\S]*?</footer>', '', 'g') AS visible,
    nullif({trim_sql(decode_sql("regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)"))}, '') AS title FROM p),
  b AS (SELECT *, array_to_string(regexp_extract_all(visible, '(?i)<article[^>]*>([\s\S]*?)</article>', 1), chr(10)) AS body FROM v),
  t AS (SELECT *, nullif({ws_sql(decode_sql(
      "regexp_replace(regexp_replace(body, '(?i)</?(?:p|br|hr|h[1-6]|li|ul|ol|div|section|table|tr)(?: [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"))}, '') AS plain FROM b),
  r AS (SELECT page_id, {clean_sql("coalesce(title, split_part(regexp_extract(url, '[^/]*$'), '?', 1))")} AS name,
    concat_ws(chr(10) || chr(10), '# ' || title, '**Authors:** A. ' || split_part(url, '/', 3) || ', Bo',
      '**Published:** 2024-' || page_id, chr(10) || plain) AS raw_text FROM t)
  SELECT * FROM r WHERE {nonblank_sql('raw_text')}"""
ORACLE["buffer_rows"] = f"""SELECT 'b1' AS buffer_id, CAST(doc_id AS VARCHAR) AS name, length(text)::BIGINT AS n_chars,
  epoch_us(TIMESTAMP '{FIXED_TIME}')::BIGINT AS created_us,
  epoch_us(TIMESTAMP '{FIXED_TIME}' + INTERVAL 1 HOUR)::BIGINT AS expires_us FROM documents"""
ORACLE["buffer_live"] = f"""SELECT event_id, epoch_us(ts + INTERVAL 1 HOUR)::BIGINT AS expires_us FROM events
  WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '{AS_OF}'"""
ORACLE["feature_upsert"] = with_ctes(SUBS, REMOVED, CACHED) + f""",
  upd AS (SELECT s.corpus_id, s.name, s.raw_text FROM subs s JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.name AND l.toxic = 1)
  SELECT c.corpus_id, c.name, {processed_sql('coalesce(u.raw_text, c.raw_text)')} AS processed_text
  FROM cached c LEFT JOIN upd u ON c.corpus_id = u.corpus_id AND c.name = u.name"""
ORACLE["workspace_delete"] = """SELECT CAST(event_id AS VARCHAR) AS instance_id, CAST(user_id AS VARCHAR) AS username, event_type AS name
  FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id + 1 = e.event_id AND d.user_id = e.user_id)"""
ORACLE["workspace_update"] = """SELECT CAST(e.event_id AS VARCHAR) AS instance_id, CAST(e.user_id AS VARCHAR) AS username,
  CASE WHEN d.event_id IS NOT NULL THEN 'u/|' || d.event_id ELSE e.event_type || '|' || e.props || '|' || e.event_type END AS urls
  FROM events e LEFT JOIN events d ON d.event_id + 1 = e.event_id AND d.user_id = e.user_id"""
ORACLE["namespace_drop"] = "SELECT CAST(label AS VARCHAR) AS namespace, vec_id FROM embeddings WHERE label <> 3"

# ---- filters and projections ----

PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^.*//', '') AS path, regexp_extract(url, '[^/]*$') AS last FROM pages)"
MEMBER_HIT = r"""(path LIKE '%/en/%' OR path LIKE '%.org/__/1%' OR regexp_matches(path, '^m\.th[a-h]') OR contains(path, '.net'))"""
ORACLE["path_filter_exclude"] = with_ctes(PATHS) + rf"""SELECT page_id, NOT {MEMBER_HIT} AND NOT ends_with(path, '/') AS member_kept,
  NOT (length(last) = 2 OR contains(last, '??') OR contains(last, '.net') OR starts_with(last, '1') OR contains(last, '1*'))
  AND len(list_filter(string_split(path, '/')[:-2], lambda d: length(d) = 2 OR contains(d, '??') OR contains(d, '.net')
    OR starts_with(d, '1') OR contains(d, '1*'))) = 0 AS file_kept FROM paths"""
ORACLE["path_filter_include"] = with_ctes(PATHS) + f"""SELECT page_id, starts_with(last, '1') OR contains(last, '1*') AS file_kept,
  false AS none_kept, true AS all_kept FROM paths WHERE {MEMBER_HIT} AND NOT ends_with(path, '/')"""
ORACLE["nonblank_docs"] = f"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
  SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, count(*)::BIGINT AS n_lines, sum(line_no)::BIGINT AS line_sum
  FROM l WHERE {nonblank_sql('line')} GROUP BY source, doc_id"""
ORACLE["size_guard"] = f"""SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name,
  CASE WHEN strlen(text) > {SIZE_LIMIT} THEN 'too large: ' || strlen(text) || ' > {SIZE_LIMIT} bytes' END AS error FROM documents"""
for key, expr in {
    "strip_comments": strip_sql("text"),
    "normalize_ws": ws_sql("text"),
    "anon_literals": anon_sql("text"),
}.items():
    ORACLE[key] = f"SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, {expr} AS text FROM documents"
ORACLE["content_hash"] = f"SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, {hash_sql('text')} AS hash FROM documents"
ORACLE["token_stream"] = f"""WITH t AS (SELECT source, doc_id, {tokens_sql('text')} AS toks FROM documents)
  SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS name, (generate_subscripts(toks, 1) - 1)::BIGINT AS pos, unnest(toks) AS token FROM t"""
CHUNKS = f"""toks AS (SELECT corpus_id AS namespace, name, {hash_sql('raw_text')} AS content_hash, {tokens_sql('raw_text')} AS toks FROM subs),
  starts AS (SELECT *, unnest(range(0, greatest(len(toks), 1), 462)) AS s FROM toks WHERE len(toks) > 0),
  chunks AS (SELECT namespace, name, (s // 462)::BIGINT AS chunk_no, content_hash, array_to_string(toks[s + 1 : s + 512], ' ') AS text
    FROM starts WHERE s = 0 OR len(toks) - s > 50)"""
ORACLE["chunk_docs"] = with_ctes(SUBS, CHUNKS) + "SELECT * FROM chunks"
ORACLE["chunk_manifest"] = with_ctes(SUBS, CHUNKS) + "SELECT DISTINCT namespace, name, content_hash FROM chunks"
URLS = """base AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS slug FROM pages),
  lists AS (SELECT page_id, [url, 'https://github.com/team/' || slug || '.git',
    'https://github.com/team/' || slug || '/blob/main/a.py?raw=1', 'https://github.com/team/' || slug || '/tree/main',
    'https://Writer.Medium.com/' || slug, 'https://host.example/get/' || slug || '.pdf?x=1'] AS l FROM base),
  urls AS (SELECT page_id, (generate_subscripts(l, 1) - 1)::BIGINT AS variant, unnest(l) AS url FROM lists)"""
IS_ARTICLE = "(" + " OR ".join(f"contains(lower(url), {q(h)})" for h in ARTICLE_HOSTS) + ")"
ORACLE["url_kind"] = with_ctes(URLS) + f"""SELECT page_id, variant,
  CASE WHEN {IS_ARTICLE} THEN 'article' WHEN contains(url, 'github.com') AND NOT contains(url, '/blob/') AND NOT contains(url, '/tree/')
    AND NOT contains(url, 'raw.githubusercontent.com') THEN 'repo' ELSE 'file' END AS kind,
  CASE WHEN NOT {IS_ARTICLE} AND contains(url, 'github.com') AND contains(url, '/blob/')
    THEN replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') ELSE url END AS fetched FROM urls"""
ORACLE["url_filename"] = with_ctes(URLS) + rf"""SELECT page_id, variant,
  CASE WHEN variant = 5 THEN page_id || '.pdf' ELSE split_part(regexp_extract(url, '[^/]*$'), '?', 1) END AS filename,
  replace(regexp_extract(url, '[^/]*$'), '.git', '') AS repo, {clean_sql('url')} AS clean,
  regexp_replace(url, '\.[^.]*$', '') AS stem FROM urls"""
ORACLE["url_box"] = "SELECT page_id, unnest([url, lower(url)]) AS url FROM pages"
ORACLE["missing_targets"] = with_ctes(SUBS) + """, asked AS (SELECT 'src' || item_id AS corpus_id, CAST(item_id AS VARCHAR) AS target FROM benchmark
  UNION ALL SELECT 'src' || item_id, CAST(item_id + 1 AS VARCHAR) FROM benchmark)
  SELECT corpus_id, target, CASE WHEN corpus_id IN (SELECT corpus_id FROM subs) THEN 'Target ''' || target || ''' not found'
    ELSE 'No submissions provided' END AS reason FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.corpus_id = a.corpus_id AND s.name = a.target)"""
ORACLE["pair_lookup"] = """WITH subs AS (SELECT source AS corpus_id, (doc_id % 2) || '/' || doc_id AS name, text FROM documents
    UNION ALL SELECT source || '/' || (doc_id % 2), CAST(doc_id AS VARCHAR), text FROM documents),
  asked AS (SELECT 'src' || item_id AS corpus_id, (item_id % 2) || '/' || item_id AS file1, (item_id % 2) || '/' || (item_id + 20) AS file2 FROM benchmark
    UNION ALL SELECT 'src' || item_id || '/' || (item_id % 2), CAST(item_id AS VARCHAR), CAST(item_id + 20 AS VARCHAR) FROM benchmark),
  m AS (SELECT corpus_id, file1, unnest([file1, file2]) AS name FROM asked)
  SELECT m.corpus_id, CASE WHEN s.name IS NOT NULL THEN file1 END AS file1, m.name,
    CASE WHEN s.name IS NULL THEN 'File ' || chr(39) || m.name || chr(39) || ' not found' ELSE CAST(length(s.text) AS VARCHAR) END AS note
  FROM m LEFT JOIN subs s ON s.corpus_id = m.corpus_id AND s.name = m.name"""

# ---- corpus building ----

HEADED = "'# === ' || member_path || ' ===' || chr(10) || content"
ORACLE["zip_rollup"] = with_ctes(MEMBERS) + f""",
  kept AS (SELECT * FROM members WHERE NOT contains(member_path, '.pdf') AND NOT contains(member_path, '__MACOSX')),
  tops AS (SELECT archive, count(DISTINCT split_part(member_path, '/', 1)) AS n FROM kept GROUP BY archive),
  named AS (SELECT k.*, CASE WHEN n = 1 AND split_part(member_path, '/', 2) <> '' THEN split_part(member_path, '/', 2)
    ELSE split_part(member_path, '/', 1) END AS name FROM kept k JOIN tops t ON k.archive = t.archive)
  SELECT archive, name, CASE WHEN count(*) = 1 AND min(member_path) = name THEN min(content)
    ELSE string_agg({HEADED}, chr(10) || chr(10) ORDER BY member_path) END AS raw_text, count(*)::BIGINT AS n_members
  FROM named WHERE {nonblank_sql('content')} GROUP BY archive, name"""
ORACLE["archive_single"] = with_ctes(MEMBERS) + f"""SELECT replace(archive, '.zip', '') AS name,
  string_agg({HEADED}, chr(10) || chr(10) ORDER BY member_no) AS raw_text, count(*)::BIGINT AS n_members
  FROM members WHERE {nonblank_sql('content')} GROUP BY archive"""
ORACLE["archive_limit"] = with_ctes(MEMBERS) + f""", c AS (SELECT *, sum(strlen({HEADED}) + 2) OVER (PARTITION BY archive) AS whole,
    sum(strlen({HEADED}) + 2) OVER (PARTITION BY archive ORDER BY member_no) AS upto FROM members WHERE {nonblank_sql('content')}),
  d AS (SELECT *, CASE WHEN whole > {SIZE_LIMIT} THEN (upto - 1) // {SIZE_LIMIT} ELSE 0 END::BIGINT AS part_no FROM c)
  SELECT archive, part_no, (sum(length({HEADED})) + 2 * (count(*) - 1))::BIGINT AS n_chars, count(*)::BIGINT AS n_members FROM d GROUP BY archive, part_no"""
ORACLE["archives_merged"] = with_ctes(MEMBERS) + f""",
  kept AS (SELECT *, CAST(regexp_extract(archive, '[0-9]+') AS BIGINT) AS conv FROM members),
  tops AS (SELECT archive, count(DISTINCT split_part(member_path, '/', 1)) AS n FROM kept GROUP BY archive),
  named AS (SELECT k.*, CASE WHEN n = 1 AND split_part(member_path, '/', 2) <> '' THEN split_part(member_path, '/', 2)
    ELSE split_part(member_path, '/', 1) END AS name FROM kept k JOIN tops t ON k.archive = t.archive),
  last AS (SELECT name, max(conv) AS conv FROM named GROUP BY name)
  SELECT name, 0::BIGINT AS part_no, CASE WHEN count(*) = 1 AND min(member_path) = name THEN min(content)
    ELSE string_agg({HEADED}, chr(10) || chr(10) ORDER BY member_path) END AS raw_text
  FROM named JOIN last USING (name, conv) WHERE {nonblank_sql('content')} GROUP BY name"""
ORACLE["last_wins"] = """SELECT conv_id, role, turn, text FROM conversations c
  WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = c.role)"""
ORACLE["extract_counts"] = with_ctes(MEMBERS) + f""",
  tops AS (SELECT archive, count(DISTINCT split_part(member_path, '/', 1)) AS n FROM members GROUP BY archive)
  SELECT m.archive, count(DISTINCT CASE WHEN n = 1 AND split_part(member_path, '/', 2) <> '' THEN split_part(member_path, '/', 2)
    ELSE split_part(member_path, '/', 1) END)::BIGINT AS n_submissions
  FROM members m JOIN tops t ON m.archive = t.archive WHERE {nonblank_sql('content')} GROUP BY m.archive"""
ORACLE["default_target"] = with_ctes(SUBS, TARGETS) + "SELECT * FROM targets"

# ---- pairs and metrics ----

ORACLE["target_pairs"] = with_ctes(SUBS, TARGETS, PAIRS) + "SELECT * FROM pairs"
TFIDF = f"""words AS (SELECT corpus_id, name, unnest(regexp_extract_all(lower(raw_text), {q(TERM_PATTERN)})) AS term FROM subs),
  tf AS (SELECT corpus_id, name, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
  df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY ALL),
  nd AS (SELECT corpus_id, count(*) AS n FROM subs GROUP BY ALL),
  w AS (SELECT tf.*, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS raw_w FROM tf JOIN df USING (corpus_id, term) JOIN nd USING (corpus_id)),
  len AS (SELECT corpus_id, name, sqrt(sum(raw_w * raw_w)) AS l FROM w GROUP BY ALL),
  weights AS (SELECT corpus_id, name, term, tf, raw_w / l AS weight FROM w JOIN len USING (corpus_id, name)),
  dots AS (SELECT a.corpus_id, a.name AS target, b.name AS other, sum(a.weight * b.weight) AS c FROM weights a
    JOIN targets t ON t.corpus_id = a.corpus_id AND t.target = a.name
    JOIN weights b ON b.corpus_id = a.corpus_id AND b.term = a.term GROUP BY ALL),
  cosines AS (SELECT p.*, coalesce(c, 0.0) AS cosine FROM pairs p LEFT JOIN dots USING (corpus_id, target, other))"""
BASE = with_ctes(SUBS, TARGETS, PAIRS)
ORACLE["tfidf_weights"] = BASE + "," + TFIDF + " SELECT corpus_id, name, term, tf, round(weight, 6) AS weight FROM weights"
ORACLE["tfidf_cosine"] = BASE + "," + TFIDF + " SELECT corpus_id, target, other, round(cosine, 6) AS cosine FROM cosines"
ORACLE["flagship"] = BASE + "," + TFIDF + """ SELECT corpus_id, target, other, round(cosine, 6) AS cosine, round(cosine, 6) AS overall,
  CASE WHEN cosine > 0.7 THEN 'red' WHEN cosine > 0.4 THEN 'orange' ELSE 'green' END AS band,
  row_number() OVER (PARTITION BY corpus_id, target ORDER BY round(cosine, 9) DESC, other)::BIGINT AS rank FROM cosines"""


def dice_ctes(items: str, both_empty: str, prefix: str, source: str = "subs") -> str:
    """Bags of ``items`` per submission and the Dice coefficient of each pair."""
    return f"""{prefix}l AS (SELECT corpus_id, name, {items} AS l FROM {source}),
  {prefix}b AS (SELECT corpus_id, name, x, count(*) AS n FROM (SELECT corpus_id, name, unnest(l) AS x FROM {prefix}l) GROUP BY ALL),
  {prefix}o AS (SELECT p.corpus_id, p.other, sum(least(a.n, b.n)) AS ov FROM pairs p
    JOIN {prefix}b a ON a.corpus_id = p.corpus_id AND a.name = p.target
    JOIN {prefix}b b ON b.corpus_id = p.corpus_id AND b.name = p.other AND b.x = a.x GROUP BY ALL),
  {prefix}d AS (SELECT p.*, CASE WHEN len(a.l) + len(b.l) = 0 THEN {both_empty}
      ELSE 2.0 * coalesce(ov, 0) / (len(a.l) + len(b.l)) END::DOUBLE AS score FROM pairs p
    JOIN {prefix}l a ON a.corpus_id = p.corpus_id AND a.name = p.target
    JOIN {prefix}l b ON b.corpus_id = p.corpus_id AND b.name = p.other
    LEFT JOIN {prefix}o o ON o.corpus_id = p.corpus_id AND o.other = p.other)"""


def chars_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\s\S]')"


def score_query(ctes: str, prefix: str, name: str) -> str:
    return BASE + "," + ctes + f" SELECT corpus_id, target, other, round(score, 6) AS {name} FROM {prefix}d"


ORACLE["raw_bound"] = score_query(dice_ctes(chars_sql("raw_text"), "1", "c"), "c", "bound")
ORACLE["processed_bound"] = score_query(dice_ctes(chars_sql(processed_sql("raw_text")), "1", "c"), "c", "bound")
ORACLE["token_dice"] = score_query(dice_ctes(tokens_sql(processed_sql("raw_text")), "0", "w"), "w", "dice")


def is_string(t: str) -> str:
    return f"(regexp_matches({t}, '^[\"'']') AND length({t}) > 1)"


def is_number(t: str) -> str:
    return f"(regexp_matches({t}, '^[0-9]') OR {t} IN ('True', 'False'))"


def is_name(t: str) -> str:
    start = f"^[{WORD}]"
    return f"(regexp_matches({t}, {q(start)}) AND NOT regexp_matches({t}, '^[0-9]') AND {t} NOT IN ({words(PYTHON_KEYWORDS)}))"


IS_CALL = f"({is_name('token')} AND coalesce(after = '(', false) AND NOT coalesce(before IN ('def', 'class'), false))"
SHAPE = f"""CASE WHEN {is_string('token')} THEN 'STR' WHEN {is_number('token')} THEN '0' WHEN {IS_CALL} THEN 'CALL'
  WHEN {is_name('token')} THEN 'W' ELSE token END"""


def code_ctes(source: str, text: str, keys: str, prefix: str, strip: bool = True) -> str:
    """Code tokens of a text with their neighbours."""
    return f"""{prefix}k AS (SELECT {keys}, regexp_extract_all({strip_sql(text) if strip else text}, {q(CODE_TOKEN_PATTERN)}) AS toks FROM {source}),
  {prefix}u AS (SELECT {keys}, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM {prefix}k),
  {prefix}t AS (SELECT *, lag(token) OVER w AS before, lag(token, 2) OVER w AS before2, lead(token) OVER w AS after FROM {prefix}u
    WINDOW w AS (PARTITION BY {keys} ORDER BY pos))"""


SHAPES = code_ctes("subs", "raw_text", "corpus_id, name", "x") + f""",
  seq AS (SELECT corpus_id, name, list({SHAPE} ORDER BY pos) AS s FROM xt WHERE token <> chr(10) GROUP BY ALL),
  shapes AS (SELECT subs.corpus_id, subs.name, CASE WHEN s IS NULL THEN [] WHEN len(s) < 3 THEN [array_to_string(s, ' ')]
    ELSE list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2]) END AS g
    FROM subs LEFT JOIN seq USING (corpus_id, name))"""
SHAPE_DICE = SHAPES + "," + dice_ctes("g", "0", "s", "shapes")
ORACLE["shape_similarity"] = score_query(SHAPE_DICE, "s", "ast")

# ---- source code made from documents ----

MODULES = f"""lines0 AS (SELECT corpus_id, name, list_filter(string_split(raw_text, chr(10)), lambda x: {nonblank_sql('x')}) AS l FROM subs),
  lines1 AS (SELECT corpus_id, name, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM lines0),
  lines2 AS (SELECT *, regexp_extract_all(line, {q(f'[{WORD}]+')}) AS ws, 'part_' || (i % 7) AS label FROM lines1),
  lines3 AS (SELECT *, 'return lib.' || array_to_string(ws, '.') AS body FROM lines2),
  parts AS (SELECT corpus_id, name, i, CASE WHEN i = 0 THEN 'class Paper:~    def title(self):~        ' || body
    WHEN i % 3 = 0 THEN 'async def ' || label || '(arg):~    ' || body
    WHEN i % 3 = 1 THEN 'def ' || label || '(arg):~    ' || body || '~    def note():~        return lib.' || coalesce(ws[-1], 'end')
    ELSE 'def ' || label || '(arg, kind: Dict[str, int] = pick(1), size=' || length(line) || '):~    text = ' || repeat('"', 3) || '~def ghost(x):~  '
      || array_to_string(ws, ' ') || '~' || repeat('"', 3) || '~    keep = lambda row, *rest, top=pick(2): (row, top, kind)~    ' || body || '~' END AS part FROM lines3),
  code AS (SELECT corpus_id, name, replace(coalesce(string_agg(part, '~' ORDER BY i), ''), '~', chr(10)) AS raw_text
    FROM subs LEFT JOIN parts USING (corpus_id, name) GROUP BY ALL)"""
FLOW = "CASE token WHEN 'if' THEN 'If' WHEN 'elif' THEN 'If' WHEN 'for' THEN 'For' WHEN 'while' THEN 'While' WHEN 'try' THEN 'Try' END"
ORACLE["processed_text"] = BASE + "," + MODULES + f" SELECT corpus_id, name, {processed_sql('raw_text')} AS text FROM code"
ORACLE["structure_profile"] = BASE + "," + MODULES + "," + code_ctes("code", "raw_text", "corpus_id, name", "x") + f""",
  fam AS (SELECT corpus_id, name, 'node_types' AS family, {SHAPE} AS item FROM xt WHERE token <> chr(10)
    UNION ALL SELECT corpus_id, name, 'function_calls', 'FUNC_CALL' FROM xt WHERE {IS_CALL}
    UNION ALL SELECT corpus_id, name, 'control_flow', {FLOW} FROM xt
      WHERE (before IS NULL OR before IN (chr(10), ';')) AND {FLOW} IS NOT NULL
    UNION ALL SELECT corpus_id, name, 'operators', token FROM xt WHERE token IN ({words(OPERATORS)}))
  SELECT corpus_id, name, family, item, count(*)::BIGINT AS n FROM fam GROUP BY ALL"""
BLOCK_SQL = rf"""cl0 AS (SELECT corpus_id, name, string_split(raw_text, chr(10)) AS l FROM code),
  cl2 AS (SELECT corpus_id, name, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM cl0),
  cl3 AS (SELECT *, coalesce(sum(len(string_split(line, repeat('"', 3))) - 1) OVER (PARTITION BY corpus_id, name ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS quoted FROM cl2),
  cl1 AS (SELECT corpus_id, name, line_no, CASE WHEN quoted THEN ')' ELSE line END AS line FROM cl3),
  vis AS (SELECT *, length(regexp_extract(line, '^[ \t]*')) AS indent, regexp_extract(line, '^[ \t]*(async[ \t]+)?(def|class)[ \t]+([{WORD}]+)', 2) AS kw,
    regexp_extract(line, '^[ \t]*(async[ \t]+)?(def|class)[ \t]+([{WORD}]+)', 1) AS pre,
    regexp_extract(line, '^[ \t]*(async[ \t]+)?(def|class)[ \t]+([{WORD}]+)', 3) AS nm
    FROM cl1 WHERE regexp_matches(line, '^[{BLANKS}]*[^{BLANKS}#]')),
  hd AS (SELECT h.*, CASE WHEN kw = 'class' THEN 'class' WHEN pre <> '' THEN 'async' ELSE 'func' END AS kind,
    (SELECT min(v.line_no) FROM vis v WHERE v.corpus_id = h.corpus_id AND v.name = h.name AND v.line_no > h.line_no
      AND v.indent <= h.indent AND NOT regexp_matches(v.line, '^[ \t]*[)\]}}]')) AS stop,
    (SELECT arg_min(v.indent, v.line_no) FROM vis v WHERE v.corpus_id = h.corpus_id AND v.name = h.name AND v.line_no > h.line_no) AS body
    FROM vis h WHERE kw <> ''),
  he AS (SELECT h.*, (SELECT max(v.line_no) FROM vis v WHERE v.corpus_id = h.corpus_id AND v.name = h.name
      AND (h.stop IS NULL OR v.line_no < h.stop)) AS end_line FROM hd h),
  ch AS (SELECT h.*, p.kind AS pkind, p.nm AS pnm FROM he h LEFT JOIN he p ON p.corpus_id = h.corpus_id AND p.name = h.name
    AND p.line_no < h.line_no AND p.end_line >= h.line_no AND p.indent = 0 AND h.indent = p.body AND h.indent > 0 AND h.kind <> 'class'),
  bl AS (SELECT corpus_id, name, CASE WHEN pkind IS NULL THEN kind || ':' || nm WHEN pkind = 'class' THEN 'class:' || pnm || '.' || nm
      ELSE pkind || ':' || pnm || '.' || kind || ':' || nm END AS block,
    CASE WHEN kind = 'class' THEN 'class' WHEN pkind = 'class' THEN CASE kind WHEN 'async' THEN 'async_method' ELSE 'method' END
      WHEN kind = 'async' THEN 'async_function' ELSE 'function' END AS type, line_no AS start_line, end_line
    FROM ch WHERE indent = 0 OR pkind IS NOT NULL),
  blocks AS (SELECT b.*, array_to_string(l[start_line : end_line], chr(10)) AS source FROM bl b JOIN cl0 USING (corpus_id, name)
    QUALIFY row_number() OVER (PARTITION BY corpus_id, name, block ORDER BY start_line DESC) = 1)"""
CODE = BASE + "," + MODULES + "," + BLOCK_SQL
ORACLE["code_blocks"] = CODE + """ SELECT corpus_id, name, block, type, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, source FROM blocks"""
# The blocks hold no comment.
NORM_SQL = code_ctes("blocks", "source", "corpus_id, name, block", "n", strip=False) + f""",
  nv AS (SELECT corpus_id, name, block, pos, token, lag(token) OVER w AS before, lag(token, 2) OVER w AS before2, lead(token) OVER w AS after,
    sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w AS depth FROM nu WHERE token <> chr(10)
    WINDOW w AS (PARTITION BY corpus_id, name, block ORDER BY pos)),
  nr AS (SELECT *, max(CASE WHEN token IN ('(', '[', '{{') THEN pos END) OVER d AS opened,
    max(CASE WHEN token = '(' AND before2 = 'def' THEN pos END) OVER d AS header,
    max(CASE WHEN token = 'lambda' THEN pos END) OVER d AS lam, max(CASE WHEN token IN (':', '(', '[', '{{') THEN pos END) OVER d AS colon FROM nv
    WINDOW d AS (PARTITION BY corpus_id, name, block, depth ORDER BY pos)),
  nq AS (SELECT *, depth > 0 AND coalesce(header = opened, false) AS in_def, lam IS NOT NULL AND lam > coalesce(colon, -1) AS in_lambda,
    CASE WHEN before IN ('*', '**') THEN before2 ELSE before END AS lead FROM nr),
  ro AS (SELECT *, CASE WHEN {is_string('token')} THEN 'STR' WHEN {is_number('token')} THEN '0' WHEN NOT {is_name('token')} THEN token
      WHEN before = 'def' AND coalesce(before2, '') <> 'async' THEN 'FUNC'
      WHEN in_def AND NOT in_lambda AND lead IN ('(', ',') THEN 'ARG' WHEN in_lambda AND lead IN ('lambda', ',') THEN 'ARG'
      WHEN before IN ('def', 'class', '.') THEN token
      WHEN before IN ('(', ',') AND after = '=' AND depth > 0 THEN token END AS fixed FROM nq),
  fp AS (SELECT corpus_id, name, block, token, min(pos) AS fp FROM ro WHERE fixed IS NULL GROUP BY ALL),
  vr AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, name, block ORDER BY fp) - 1 AS v FROM fp),
  nn AS (SELECT ro.corpus_id, ro.name, ro.block, pos, CASE WHEN fixed IS NULL THEN 'VAR_' || v ELSE fixed END AS t
    FROM ro LEFT JOIN vr ON fixed IS NULL AND vr.corpus_id = ro.corpus_id AND vr.name = ro.name AND vr.block = ro.block AND vr.token = ro.token),
  norms AS (SELECT corpus_id, name, block, list(t ORDER BY pos) AS nl FROM nn GROUP BY ALL)"""
ORACLE["block_norm"] = CODE + "," + NORM_SQL + " SELECT corpus_id, name, block, array_to_string(nl, ' ') AS norm FROM norms"
MATCH_SQL = NORM_SQL + """,
  bg AS (SELECT corpus_id, name, block, CASE WHEN len(nl) < 3 THEN [array_to_string(nl, ' ')]
    ELSE list_transform(range(1, len(nl) - 1), lambda i: nl[i] || ' ' || nl[i + 1] || ' ' || nl[i + 2]) END AS g FROM norms),
  bc AS (SELECT corpus_id, name, block, len(g) AS sz, x, count(*) AS n FROM (SELECT *, unnest(g) AS x FROM bg) GROUP BY ALL),
  bo AS (SELECT a.corpus_id, a.name AS target, a.block AS block1, b.name AS other, b.block AS block2,
      2.0 * sum(least(a.n, b.n)) / (a.sz + b.sz) AS sim FROM bc a JOIN targets t ON t.corpus_id = a.corpus_id AND t.target = a.name
    JOIN bc b ON b.corpus_id = a.corpus_id AND b.name <> a.name AND b.x = a.x GROUP BY a.corpus_id, a.name, a.block, b.name, b.block, a.sz, b.sz),
  bm AS (SELECT o.corpus_id, target, other, block1, l.start_line::BIGINT AS start1, l.end_line::BIGINT AS end1, block2,
      r.start_line::BIGINT AS start2, r.end_line::BIGINT AS end2, round(sim, 4) AS similarity, l.type, l.source AS source1, r.source AS source2 FROM bo o
    JOIN blocks l ON l.corpus_id = o.corpus_id AND l.name = target AND l.block = block1
    JOIN blocks r ON r.corpus_id = o.corpus_id AND r.name = other AND r.block = block2 WHERE sim >= 0.6)"""
ORACLE["block_matches"] = CODE + "," + MATCH_SQL + """ SELECT *,
  CASE WHEN similarity > 0.8 THEN 'red' WHEN similarity > 0.6 THEN 'orange' ELSE 'green' END AS band FROM bm"""
ORACLE["top_regions"] = CODE + "," + MATCH_SQL + """ SELECT *,
  row_number() OVER (PARTITION BY corpus_id, target, other ORDER BY similarity DESC, block1, block2)::BIGINT AS rank FROM bm QUALIFY rank <= 20"""


def run_ctes(source: str) -> str:
    """All equal 10-grams of a pair; those in a row on one diagonal are a run."""
    return f"""rl0 AS (SELECT corpus_id, name, string_split(raw_text, chr(10)) AS l FROM {source}),
  rl1 AS (SELECT corpus_id, name, generate_subscripts(l, 1) AS line, unnest(l) AS t FROM rl0),
  rl2 AS (SELECT corpus_id, name, line, {tokens_sql('t')} AS toks FROM rl1),
  rl3 AS (SELECT corpus_id, name, line, generate_subscripts(toks, 1) AS i, unnest(toks) AS token FROM rl2),
  rt AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, name ORDER BY line, i) - 1 AS pos FROM rl3),
  rd AS (SELECT corpus_id, name, list(token ORDER BY pos) AS toks FROM rt GROUP BY ALL),
  rg AS (SELECT rt.corpus_id, rt.name, pos, line, array_to_string(toks[pos + 1 : pos + 10], ' ') AS gram FROM rt JOIN rd USING (corpus_id, name)
    WHERE pos + 10 <= len(toks)),
  rm AS (SELECT a.corpus_id, a.name AS target, b.name AS other, a.pos AS p1, a.line AS l1, b.pos AS p2, b.line AS l2 FROM rg a
    JOIN targets t ON t.corpus_id = a.corpus_id AND t.target = a.name
    JOIN rg b ON b.corpus_id = a.corpus_id AND b.name <> a.name AND b.gram = a.gram),
  ri AS (SELECT *, p1 - row_number() OVER (PARTITION BY corpus_id, target, other, p1 - p2 ORDER BY p1) AS isl FROM rm),
  runs AS (SELECT corpus_id, target, other, min(p1)::BIGINT AS pos1, min(l1)::BIGINT AS line1, min(p2)::BIGINT AS pos2, min(l2)::BIGINT AS line2,
    (count(*) + 9)::BIGINT AS token_count FROM ri GROUP BY corpus_id, target, other, p1 - p2, isl)"""


ORACLE["token_runs"] = BASE + "," + run_ctes("subs") + """ SELECT r.*,
  substring(array_to_string(d.toks[pos1 + 1 : pos1 + token_count], ''), 1, 500) AS matched_text
  FROM runs r JOIN rd d ON d.corpus_id = r.corpus_id AND d.name = r.target"""
ORACLE["token_matches"] = BASE + "," + run_ctes("subs") + """ SELECT r.*,
  substring(array_to_string(d.toks[pos1 + 1 : pos1 + token_count], ''), 1, 500) AS matched_text,
  row_number() OVER (PARTITION BY r.corpus_id, target, other ORDER BY token_count DESC, pos1, pos2)::BIGINT AS rank
  FROM runs r JOIN rd d ON d.corpus_id = r.corpus_id AND d.name = r.target QUALIFY rank <= 10"""
# The longest match from each place of the other text on, at its leftmost place in the target.
LONGEST = """sp AS (SELECT corpus_id, target, other, pos1, pos2, token_count, unnest(range(pos2, pos2 + token_count - 9)) AS p FROM runs),
  ms AS (SELECT corpus_id, target, other, p, pos2 + token_count - p AS n, pos1 + p - pos2 AS at FROM sp),
  mb AS (SELECT corpus_id, target, other, p, max(n) AS n FROM ms GROUP BY ALL),
  longest AS (SELECT b.corpus_id, b.target, b.other, min(m.at)::BIGINT AS pos1, b.p::BIGINT AS pos2, b.n::BIGINT AS token_count
    FROM mb b JOIN ms m USING (corpus_id, target, other, p, n)
    LEFT JOIN mb f ON f.corpus_id = b.corpus_id AND f.target = b.target AND f.other = b.other AND f.p = b.p - 1
    WHERE f.n IS NULL OR b.n >= f.n GROUP BY ALL)"""
ORACLE["longest_matches"] = BASE + "," + run_ctes("subs") + "," + LONGEST + " SELECT * FROM longest"
ORACLE["best_matches"] = BASE + "," + run_ctes("subs") + "," + LONGEST + """ SELECT *,
  row_number() OVER (PARTITION BY corpus_id, target, other ORDER BY token_count DESC, pos1, pos2)::BIGINT AS rank FROM longest QUALIFY rank <= 10"""
ORACLE["token_ratio"] = (
    BASE + f", ps AS (SELECT corpus_id, name, {processed_sql('raw_text')} AS raw_text FROM subs),"
    + dice_ctes(tokens_sql("raw_text"), "0", "w", "ps") + "," + run_ctes("ps") + """,
  spots AS (SELECT DISTINCT corpus_id, target, other, 1 AS side, unnest(range(pos1, pos1 + token_count)) AS at FROM runs
    UNION SELECT DISTINCT corpus_id, target, other, 2, unnest(range(pos2, pos2 + token_count)) FROM runs),
  cov AS (SELECT corpus_id, target, other, count(*) AS n FROM spots GROUP BY ALL)
  SELECT d.corpus_id, d.target, d.other, round(d.score, 6) AS token,
    round(CASE WHEN len(a.l) + len(b.l) = 0 THEN 0 ELSE coalesce(c.n, 0) / (len(a.l) + len(b.l)) END::DOUBLE, 6) AS cover
  FROM wd d JOIN wl a ON a.corpus_id = d.corpus_id AND a.name = d.target JOIN wl b ON b.corpus_id = d.corpus_id AND b.name = d.other
  LEFT JOIN cov c ON c.corpus_id = d.corpus_id AND c.target = d.target AND c.other = d.other"""
)
ORACLE["region_stats"] = CODE + "," + MATCH_SQL + "," + run_ctes("code") + """,
  nb AS (SELECT corpus_id, name, count(*) AS n FROM blocks GROUP BY ALL),
  cb AS (SELECT corpus_id, other, count(*) AS n FROM bm GROUP BY ALL), cr AS (SELECT corpus_id, other, count(*) AS n FROM runs GROUP BY ALL)
  SELECT p.*, coalesce(a.n, 0)::BIGINT AS file1_blocks, coalesce(b.n, 0)::BIGINT AS file2_blocks,
    coalesce(m.n, 0)::BIGINT AS total_function_matches, coalesce(u.n, 0)::BIGINT AS total_token_matches FROM pairs p
  LEFT JOIN nb a ON a.corpus_id = p.corpus_id AND a.name = p.target LEFT JOIN nb b ON b.corpus_id = p.corpus_id AND b.name = p.other
  LEFT JOIN cb m ON m.corpus_id = p.corpus_id AND m.other = p.other LEFT JOIN cr u ON u.corpus_id = p.corpus_id AND u.other = p.other"""

# ---- vectors ----

VECTORS = """vec AS (SELECT CAST(label AS VARCHAR) AS namespace, CAST(vec_id // 4 AS VARCHAR) AS name, vec_id % 4 AS chunk_no, vec_id,
  embedding::DOUBLE[] AS e FROM embeddings),
  first AS (SELECT namespace, min(vec_id) AS vec_id FROM vec GROUP BY ALL),
  qu AS (SELECT v.* FROM vec v JOIN first f ON f.namespace = v.namespace AND f.vec_id = v.vec_id),
  sc AS (SELECT q.namespace, q.name AS query, q.vec_id AS qid, v.name, v.chunk_no, v.vec_id, list_cosine_similarity(v.e, q.e) AS score
    FROM qu q JOIN vec v ON v.namespace = q.namespace),
  top AS (SELECT namespace, query, name, chunk_no, score,
    row_number() OVER (PARTITION BY namespace ORDER BY score DESC, name, chunk_no) AS rank FROM sc QUALIFY rank <= 10)"""
ORACLE["vector_cosine"] = with_ctes(VECTORS) + """SELECT namespace AS corpus_id, CAST(qid AS VARCHAR) AS target, CAST(vec_id AS VARCHAR) AS other,
  round(score, 6) AS vector FROM sc WHERE vec_id <> qid"""
ORACLE["vector_topk"] = with_ctes(VECTORS) + """SELECT namespace, query, name, chunk_no::BIGINT AS chunk_no, round(score, 6) AS score, rank::BIGINT AS rank FROM top"""
ORACLE["vector_index_topk"] = ORACLE["vector_topk"]
ORACLE["file_scores"] = with_ctes(VECTORS) + """SELECT namespace, query, name, round(min(score), 6) AS score FROM top GROUP BY ALL"""

# ---- incremental work ----

CACHE = with_ctes(SUBS, REMOVED, CACHED)
ORACLE["cache_new"] = CACHE + "SELECT corpus_id, name FROM subs EXCEPT SELECT corpus_id, name FROM cached"
ORACLE["cache_valid"] = CACHE + "SELECT corpus_id, name FROM cached INTERSECT SELECT corpus_id, name FROM subs"
ORACLE["cache_merged"] = CACHE + f""", m AS (SELECT s.corpus_id, s.name, {processed_sql('coalesce(c.raw_text, s.raw_text)')} AS p
    FROM subs s LEFT JOIN cached c ON c.corpus_id = s.corpus_id AND c.name = s.name)
  SELECT corpus_id, name, {hash_sql('p')} AS hash, len({tokens_sql('p')})::BIGINT AS n_tokens FROM m"""
ORACLE["cache_status"] = CACHE + """SELECT CASE WHEN c.name IS NULL THEN 'new' WHEN s.name IS NULL THEN 'stale' ELSE 'cached' END AS status,
  count(*)::BIGINT AS n FROM subs s FULL JOIN cached c ON c.corpus_id = s.corpus_id AND c.name = s.name GROUP BY 1"""
ORACLE["changed_files"] = CACHE + f"""SELECT s.corpus_id, s.name, {hash_sql('s.raw_text')} AS content_hash,
  CASE WHEN c.name IS NULL THEN 'new' ELSE 'changed' END AS status FROM subs s LEFT JOIN cached c ON c.corpus_id = s.corpus_id AND c.name = s.name
  WHERE c.name IS NULL OR md5(c.raw_text) <> md5(s.raw_text)"""

# ---- harvest and workspaces ----

MESSAGES = """msg AS (SELECT page_id AS msg_id, split_part(url, '/', 3) AS host, regexp_extract(split_part(url, '/', 3), '[^.]*$') AS channel_id,
    url, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages),
  tags AS (SELECT * FROM (SELECT DISTINCT channel_id FROM msg), (VALUES ('en', 20), ('fr', -1), ('es', -1), ('de', -1)) v(tag, mark)),
  after AS (SELECT t.channel_id, t.tag, m.msg_id, host, url, 'new on #' || lang || ': ' || lower(url) || ' mirror http://' || host || '/all, again' AS low,
    row_number() OVER (PARTITION BY t.channel_id, t.tag ORDER BY m.msg_id DESC) AS rank
    FROM msg m JOIN tags t ON t.channel_id = m.channel_id WHERE m.msg_id > t.mark)"""
ORACLE["latest_messages"] = with_ctes(MESSAGES) + "SELECT channel_id, tag, msg_id, rank::BIGINT AS rank FROM after WHERE rank <= 30"
FOUND = """, found AS (SELECT channel_id, tag, msg_id, rank, unnest([url, 'http://' || host || '/all,', url]) AS url, unnest([0, 1, 2]) AS place
    FROM after WHERE contains(low, tag)),
  fresh AS (SELECT channel_id, tag, url, msg_id, place::BIGINT AS "at" FROM found
    QUALIFY row_number() OVER (PARTITION BY channel_id, tag, url ORDER BY rank, place) = 1)"""
ORACLE["tag_urls"] = with_ctes(MESSAGES) + FOUND + " SELECT * FROM fresh"
ORACLE["cache_upsert"] = with_ctes(MESSAGES) + FOUND + f""",
  old AS (SELECT channel_id, tag, u AS url, min(msg_id) AS pos FROM (SELECT channel_id, msg_id, unnest([url, 'http://' || host || '/all,']) AS u FROM msg),
    (VALUES ('en'), ('fr')) v(tag) GROUP BY ALL),
  merged AS (SELECT channel_id, tag, url, 0::BIGINT AS age, -msg_id AS p1, "at" AS p2 FROM fresh UNION ALL
    SELECT channel_id, tag, url, 1, pos, 0 FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.channel_id = o.channel_id AND f.tag = o.tag AND f.url = o.url)),
  newest AS (SELECT channel_id, tag, max(msg_id) AS id FROM after GROUP BY ALL),
  hit AS (SELECT DISTINCT channel_id, tag FROM fresh)
  SELECT m.*, CASE WHEN h.tag IS NOT NULL THEN CAST(n.id AS VARCHAR) WHEN m.tag = 'en' THEN '20' END AS last_message_id,
    epoch_us(CASE WHEN h.tag IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{FIXED_TIME}' END)::BIGINT AS scraped_us
  FROM merged m LEFT JOIN newest n ON n.channel_id = m.channel_id AND n.tag = m.tag LEFT JOIN hit h ON h.channel_id = m.channel_id AND h.tag = m.tag"""
ORACLE["url_merge"] = """SELECT page_id, concat_ws(' ', url, split_part(url, '/', 3), url, 'old', 'old',
  CASE WHEN lower(url) <> url THEN lower(url) END) AS merged FROM pages"""
ORACLE["url_changed"] = """SELECT page_id, true AS changed, lower(url) <> url AS changed_again FROM pages"""
ORACLE["workspaces_newest"] = """SELECT CAST(user_id AS VARCHAR) AS username, CAST(event_id AS VARCHAR) AS instance_id, event_type AS name,
  epoch_us(ts)::BIGINT AS created_us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::BIGINT AS rank FROM events"""
ORACLE["history_by_user"] = """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS username, NULL::VARCHAR AS asked, event_id, ts FROM events
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'click', event_id, ts FROM events WHERE event_type = 'click')
  SELECT username, asked, event_id, epoch_us(ts)::BIGINT AS created_us,
    row_number() OVER (PARTITION BY username, asked ORDER BY ts DESC, event_id)::BIGINT AS rank FROM a"""

# ---- reports ----

SCORES = BASE + "," + SHAPE_DICE + "," + dice_ctes(tokens_sql("raw_text"), "0", "w") + "," + TFIDF + """,
  sco AS (SELECT p.*, s.score AS ast, t.score AS token, c.cosine AS cosine FROM pairs p
    JOIN sd s USING (corpus_id, target, other) JOIN wd t USING (corpus_id, target, other) JOIN cosines c USING (corpus_id, target, other))"""


def best_sql(values: str) -> str:
    return f"""ov AS (SELECT corpus_id, target, other, v, count(*) AS n FROM (SELECT corpus_id, target, other, unnest({values}) AS v FROM sco) GROUP BY ALL),
  best AS (SELECT corpus_id, target, other, v AS overall FROM ov QUALIFY row_number() OVER (PARTITION BY corpus_id, target, other ORDER BY n DESC, v DESC) = 1)"""


ORACLE["overall_match"] = SCORES + "," + best_sql("[round(ast, 1), round(token, 1), round(cosine, 1)]") + " SELECT * FROM best"
ORACLE["ranked_report"] = SCORES + "," + best_sql("[ast, token, cosine]") + """ SELECT s.corpus_id, s.target, s.other,
  round(ast, 6) AS ast, round(token, 6) AS token, round(cosine, 6) AS cosine, round(overall, 6) AS overall,
  CASE WHEN overall > 0.7 THEN 'red' WHEN overall > 0.4 THEN 'orange' ELSE 'green' END AS band,
  row_number() OVER (PARTITION BY s.corpus_id, s.target ORDER BY round(overall, 9) DESC, other)::BIGINT AS rank
  FROM sco s JOIN best USING (corpus_id, target, other)"""
ORACLE["score_bands"] = BASE + "," + dice_ctes(tokens_sql("raw_text"), "0", "w") + """ SELECT corpus_id, target, other,
  CASE WHEN score > 0.7 THEN 'red' WHEN score > 0.4 THEN 'orange' ELSE 'green' END AS overall_band,
  CASE WHEN score > 0.8 THEN 'red' WHEN score > 0.6 THEN 'orange' ELSE 'green' END AS block_band FROM wd"""


def lcs_ctes(text: str, prefix: str) -> str:
    """``2 * LCS / (length + length)`` of each pair, one row of the table per step."""
    return f"""{prefix}c AS (SELECT p.corpus_id, p.target, p.other, string_split(a.{text}, '') AS x, string_split(b.{text}, '') AS y FROM pairs p
    JOIN texts a ON a.corpus_id = p.corpus_id AND a.name = p.target JOIN texts b ON b.corpus_id = p.corpus_id AND b.name = p.other),
  {prefix}r AS (SELECT *, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS row FROM {prefix}c
    UNION ALL SELECT corpus_id, target, other, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(list_transform(
      range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE greatest(row[k], row[k - 1] + (x[i + 1] = y[k - 1])::INT) END)))
      FROM {prefix}r WHERE i < len(x)),
  {prefix}s AS (SELECT corpus_id, target, other, CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE 2.0 * row[-1] / (len(x) + len(y)) END::DOUBLE AS ratio
    FROM {prefix}r WHERE i = len(x))"""


PART_SUBS = """subs AS (SELECT p_brand AS corpus_id, CAST(p_partkey AS VARCHAR) AS name, p_name AS raw_text, p_partkey AS ingest_order FROM part)"""
PROCESSED = processed_sql("raw_text")
ORACLE["analyze_names"] = (
    with_ctes(PART_SUBS, TARGETS, PAIRS, f"texts AS (SELECT corpus_id, name, raw_text, {PROCESSED} AS processed FROM subs)",
              "ps AS (SELECT corpus_id, name, processed AS raw_text FROM texts)",
              SHAPE_DICE, dice_ctes(tokens_sql("raw_text"), "0", "w", "ps"),
              TFIDF.replace("lower(raw_text)", f"lower({PROCESSED})"), run_ctes("ps"),
              lcs_ctes("raw_text", "q"), lcs_ctes("processed", "z")).replace("WITH ", "WITH RECURSIVE ", 1) + """,
  spots AS (SELECT DISTINCT corpus_id, target, other, 1 AS side, unnest(range(pos1, pos1 + token_count)) AS at FROM runs
    UNION SELECT DISTINCT corpus_id, target, other, 2, unnest(range(pos2, pos2 + token_count)) FROM runs),
  cov AS (SELECT corpus_id, target, other, count(*) AS n FROM spots GROUP BY ALL)
  SELECT d.corpus_id, d.target, d.other, round(r.ratio, 6) AS raw, round(p.ratio, 6) AS processed, round(s.score, 6) AS ast, round(d.score, 6) AS token,
    round(CASE WHEN len(x.l) + len(y.l) = 0 THEN 0 ELSE coalesce(c.n, 0) / (len(x.l) + len(y.l)) END::DOUBLE, 6) AS cover, round(k.cosine, 6) AS cosine
  FROM wd d JOIN qs r USING (corpus_id, target, other) JOIN zs p USING (corpus_id, target, other) JOIN sd s USING (corpus_id, target, other)
  JOIN cosines k USING (corpus_id, target, other) LEFT JOIN cov c USING (corpus_id, target, other)
  JOIN wl x ON x.corpus_id = d.corpus_id AND x.name = d.target JOIN wl y ON y.corpus_id = d.corpus_id AND y.name = d.other"""
)
# Every common stretch is a candidate; the best one is taken, and all that share a token with it go.
GREEDY = """greedy AS (SELECT corpus_id, target, other, c, c[:0] AS tiles FROM cand UNION ALL SELECT corpus_id, target, other,
    list_filter(c, lambda t: (t.i >= c[1].i + c[1].n OR c[1].i >= t.i + t.n) AND (t.j >= c[1].j + c[1].n OR c[1].j >= t.j + t.n)),
    list_append(tiles, c[1]) FROM greedy WHERE len(c) > 0),
  made AS (SELECT p.corpus_id, p.target, p.other, len(a.w) + len(b.w) AS total, g.tiles,
    coalesce(list_sum(list_transform(g.tiles, lambda t: t.n)), 0)::BIGINT AS tiled FROM pairs p
    JOIN tk a ON a.corpus_id = p.corpus_id AND a.name = p.target JOIN tk b ON b.corpus_id = p.corpus_id AND b.name = p.other
    LEFT JOIN (SELECT * FROM greedy WHERE len(c) = 0) g ON g.corpus_id = p.corpus_id AND g.target = p.target AND g.other = p.other)"""
TILE_RATIO = "tiled, round(CASE WHEN total = 0 THEN 0 ELSE 2.0 * tiled / total END::DOUBLE, 6) AS tile_ratio FROM made"
TILE_TOKENS = f"tk AS (SELECT corpus_id, name, {tokens_sql('raw_text')} AS w FROM subs)"
ORACLE["token_tiles"] = with_ctes(
    PART_SUBS, TARGETS, PAIRS, TILE_TOKENS,
    "tp AS (SELECT p.*, a.w AS x, b.w AS y FROM pairs p JOIN tk a ON a.corpus_id = p.corpus_id AND a.name = p.target"
    " JOIN tk b ON b.corpus_id = p.corpus_id AND b.name = p.other)",
    "t1 AS (SELECT *, unnest(range(0, len(x))) AS i FROM tp)", "t2 AS (SELECT *, unnest(range(0, len(y))) AS j FROM t1)",
    "t3 AS (SELECT *, unnest(range(2, least(len(x) - i, len(y) - j) + 1)) AS n FROM t2)",
    "cand AS (SELECT corpus_id, target, other, list({'i': i, 'j': j, 'n': n} ORDER BY n DESC, i, j) AS c FROM t3"
    " WHERE x[i + 1 : i + n] = y[j + 1 : j + n] GROUP BY ALL)",
    GREEDY,
).replace("WITH ", "WITH RECURSIVE ", 1) + """ SELECT corpus_id, target, other,
  coalesce(array_to_string(list_transform(tiles, lambda t: t.i || ':' || t.j || ':' || t.n), ' '), '') AS tiles, """ + TILE_RATIO
# Common stretches of long texts lie in their runs.
ORACLE["tile_ratio"] = (BASE + "," + run_ctes("subs")).replace("WITH ", "WITH RECURSIVE ", 1) + "," + TILE_TOKENS + """,
  c1 AS (SELECT corpus_id, target, other, pos1, pos2, token_count, unnest(range(0, token_count - 9)) AS o FROM runs),
  c2 AS (SELECT corpus_id, target, other, pos1 + o AS i, pos2 + o AS j, unnest(range(10, token_count - o + 1)) AS n FROM c1),
  cand AS (SELECT corpus_id, target, other, list({'i': i, 'j': j, 'n': n} ORDER BY n DESC, i, j) AS c FROM c2 GROUP BY ALL),
  """ + GREEDY + " SELECT corpus_id, target, other, " + TILE_RATIO
ORACLE["best_names"] = with_ctes(
    PART_SUBS, TARGETS, PAIRS, "texts AS (SELECT corpus_id, name, raw_text FROM subs)", lcs_ctes("raw_text", "q")
).replace("WITH ", "WITH RECURSIVE ", 1) + """ SELECT corpus_id, target, other, round(ratio, 6) AS ratio,
  row_number() OVER (PARTITION BY corpus_id, target ORDER BY ratio DESC, other)::BIGINT AS rank,
  count(*) OVER (PARTITION BY corpus_id, target)::BIGINT AS n_pairs FROM qs QUALIFY rank <= 3"""
# The parent of a token is the last one before it that is less deep.
TREES = ["""subs AS (SELECT p_brand AS corpus_id, CAST(p_partkey AS VARCHAR) AS name, p_partkey AS ingest_order,
    string_split(p_name, ' ')[1] AS w1, coalesce(string_split(p_name, ' ')[2], 'none') AS w2, string_split(p_type, ' ')[-1] AS l, p_size::VARCHAR AS z,
    CASE p_partkey % 3 WHEN 0 THEN 'def ' || w1 || '(' || w2 || ', ' || l || '):' || chr(10) || '    return ' || l || '(' || z || ')'
      WHEN 1 THEN 'def ' || w1 || '(' || l || '):' || chr(10) || '    if ' || w2 || ':' || chr(10) || '        return ' || l || '(' || chr(10) || z || ')' || chr(10)
      ELSE w1 || '(' || w2 || '(' || l || '), [' || z || '])' || chr(10) || chr(10) || 'end' END AS raw_text FROM part)""",
    TARGETS, PAIRS,
    r"""tr0 AS (SELECT corpus_id, name, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM
    (SELECT corpus_id, name, regexp_extract_all(chr(10) || raw_text, '\n *|[A-Za-z]+|[0-9]+|[^\s]') AS t FROM subs)),
  tr1 AS (SELECT *, sum(CASE WHEN t IN ('(', '[') THEN 1 WHEN t IN (')', ']') THEN -1 ELSE 0 END) OVER w AS inside,
    lag(t) OVER w AS b FROM tr0 WINDOW w AS (PARTITION BY corpus_id, name ORDER BY pos)),
  tr2 AS (SELECT *, starts_with(t, chr(10)) AS feed, last_value(CASE WHEN starts_with(t, chr(10)) AND inside = 0 THEN length(t) - 1 END IGNORE NULLS)
    OVER (PARTITION BY corpus_id, name ORDER BY pos) // 4 AS level FROM tr1),
  tr3 AS (SELECT corpus_id, name, pos, CASE WHEN regexp_matches(t, '^[0-9]') THEN '0' ELSE t END AS label,
    CASE WHEN starts_with(b, chr(10)) AND inside - (t IN ('(', '['))::INT = 0 THEN level ELSE level + 1 + inside - (t IN ('(', '['))::INT END AS depth
    FROM tr2 WHERE NOT feed),
  tr4 AS (SELECT a.*, (SELECT max(p.pos) FROM tr3 p WHERE p.corpus_id = a.corpus_id AND p.name = a.name AND p.pos < a.pos AND p.depth < a.depth) AS parent FROM tr3 a),
  tr5 AS (SELECT corpus_id, name, coalesce(parent, 0) AS parent, ['*', '*'] || list(label ORDER BY pos) || ['*', '*'] AS row FROM tr4 GROUP BY ALL),
  tr6 AS (SELECT corpus_id, name, pos, parent, label FROM tr4 UNION ALL SELECT DISTINCT corpus_id, name, 0, NULL, '*' FROM tr4),
  tr7 AS (SELECT n.corpus_id, n.name, coalesce(u.label, '*') || ' ' || n.label || ' ' AS head, coalesce(c.row, ['*', '*', '*']) AS row FROM tr6 n
    LEFT JOIN tr3 u ON u.corpus_id = n.corpus_id AND u.name = n.name AND u.pos = n.parent
    LEFT JOIN tr5 c ON c.corpus_id = n.corpus_id AND c.name = n.name AND c.parent = n.pos),
  tg AS (SELECT corpus_id, name, flatten(list(list_transform(range(1, len(row) - 1), lambda i: head || array_to_string(row[i : i + 2], ' ')))) AS g
    FROM tr7 GROUP BY ALL)"""]
ORACLE["tree_grams"] = with_ctes(*TREES) + "SELECT corpus_id, name, array_to_string(list_sort(g), ';') AS grams FROM tg"
ORACLE["tree_similarity"] = with_ctes(*TREES, dice_ctes("g", "0", "y", "tg")) + "SELECT corpus_id, target, other, round(score, 6) AS tree FROM yd"
# The two words of a name are its two parts, with a blank line between.
PARTED = f"subs0 AS (SELECT p_brand AS corpus_id, CAST(p_partkey AS VARCHAR) AS name, replace(p_name, ' ', chr(10) || chr(10)) AS raw_text, p_partkey AS ingest_order FROM part)"
ORACLE["analyze_parts"] = ORACLE["analyze_names"].replace(PART_SUBS, PARTED + ", subs AS (SELECT * FROM subs0)", 1)
ONE_BUFFER = "subs AS (SELECT 'buffer' AS corpus_id, p_partkey || '.txt' AS name, p_name AS raw_text, p_partkey AS ingest_order FROM part)"
ORACLE["buffer_report"] = (
    ORACLE["analyze_names"].replace(PART_SUBS, ONE_BUFFER, 1).replace(
        "SELECT d.corpus_id, d.target, d.other, round(r.ratio, 6) AS raw", "_all AS (SELECT d.corpus_id, d.target, d.other, r.ratio AS raw", 1
    ).replace("cov AS (SELECT corpus_id, target, other, count(*) AS n FROM spots GROUP BY ALL)\n  _all", "cov AS (SELECT corpus_id, target, other, count(*) AS n FROM spots GROUP BY ALL),\n  sco", 1)
    .replace("round(p.ratio, 6) AS processed, round(s.score, 6) AS ast, round(d.score, 6) AS token", "p.ratio AS processed, s.score AS ast, d.score AS token", 1)
    + "), " + best_sql("[raw, processed, ast, token]") + """ SELECT s.target, s.other, round(raw, 6) AS raw, round(processed, 6) AS processed,
  round(ast, 6) AS ast, round(token, 6) AS token, round(overall, 6) AS overall,
  CASE WHEN overall > 0.7 THEN 'red' WHEN overall > 0.4 THEN 'orange' ELSE 'green' END AS band,
  row_number() OVER (PARTITION BY s.corpus_id, s.target ORDER BY round(overall, 9) DESC, other)::BIGINT AS rank
  FROM sco s JOIN best USING (corpus_id, target, other)"""
)
# Sentences are taken one after the other; the next chunk goes back by whole sentences.
SENTENCE_TOKENS = r"regexp_extract_all(x, '([\p{L}\p{N}_]+|[^\n\t\x0B\x0C\r\x1C-\x1F\x85\p{Z}\p{L}\p{N}_])')"
ORACLE["chunk_sentences"] = "WITH RECURSIVE " + SUBS + rf""",
  se0 AS (SELECT corpus_id, name, raw_text, list_filter(list_transform(regexp_extract_all(raw_text, '[^.!?\n]+[.!?]*|[.!?]+'),
    lambda x: {SENTENCE_TOKENS}), lambda t: len(t) > 0) AS s FROM subs),
  se1 AS (SELECT corpus_id, name, raw_text, flatten(list_transform(s, lambda t: list_transform(range(0, (len(t) + 99) // 100),
    lambda i: t[i * 100 + 1 : i * 100 + 100]))) AS u FROM se0),
  se2 AS (SELECT *, list_transform(range(0, len(u) + 1), lambda k: coalesce(list_sum(list_transform(u[1:k], lambda t: len(t))), 0)) AS off FROM se1 WHERE len(u) > 0),
  se3 AS (SELECT corpus_id, name, raw_text, u, off, 0 AS a, list_max(list_filter(range(0, len(u) + 1), lambda k: off[k + 1] <= off[1] + 100)) AS b, 0 AS no FROM se2
    UNION ALL SELECT corpus_id, name, raw_text, u, off, a2, list_max(list_filter(range(0, len(u) + 1), lambda k: off[k + 1] <= off[a2 + 1] + 100)), no + 1
    FROM (SELECT *, list_min(list_filter(range(a + 1, b + 1), lambda k: off[b + 1] - off[k + 1] <= 20 AND off[b + 2] - off[k + 1] <= 100)) AS a2
      FROM se3 WHERE b < len(u)))
  SELECT corpus_id AS namespace, name, no::BIGINT AS chunk_no, {hash_sql('raw_text')} AS content_hash,
    array_to_string(flatten(u[a + 1 : b]), ' ') AS text FROM se3"""
