"""DuckDB SQL for the core queries, written apart from the DataFrame code."""

from __future__ import annotations

T1 = """
src AS (SELECT doc_id, text, source, source || '/' || lang || '/b' || (doc_id % 8) || '/' || doc_id || '.txt' AS tail FROM documents),
t1 AS (
  SELECT 'live/' || tail AS path, sha256(text) AS digest, octet_length(encode(text))::BIGINT AS size, (1700000000 + doc_id) * 1000000000 AS mod_ns, 0 AS flag, doc_id, source, 'live/' AS top FROM src
  UNION ALL SELECT 'backup/' || tail, sha256(text), octet_length(encode(text))::BIGINT, (1700000000 + doc_id) * 1000000000, 0, doc_id, source, 'backup/' FROM src WHERE doc_id % 2 = 0
  UNION ALL SELECT 'old/' || tail, sha256(CASE WHEN doc_id % 40 = 0 THEN text || '!' ELSE text END), octet_length(encode(CASE WHEN doc_id % 40 = 0 THEN text || '!' ELSE text END))::BIGINT,
    (1700000000 + doc_id) * 1000000000, CASE WHEN doc_id % 16 = 0 THEN 1 ELSE 0 END, doc_id, source, 'old/' FROM src WHERE doc_id % 4 = 0)"""

T2 = T1 + """,
t2 AS (
  SELECT path, digest, size, mod_ns, CASE WHEN top = 'live/' AND doc_id % 97 = 0 THEN 3 WHEN top = 'backup/' AND doc_id % 106 = 0 THEN 7 WHEN top = 'backup/' AND doc_id % 53 = 0 THEN 4 ELSE flag END AS flag FROM t1
  UNION ALL SELECT 'live/' || source || '/Thumbs.db', sha256('thumbs'), 6, 1700000000000000000, 0 FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT 'live/' || source || '/empty', sha256('live/' || source || '/empty'), 0, 1700000000000000000, 0 FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT 'live/' || source || '/.git/objects/' || doc_id, digest, size, mod_ns, 0 FROM t1 WHERE top = 'live/' AND doc_id % 10 = 0)"""

T3 = T2 + """,
l0 AS (SELECT path, digest, size, mod_ns, coalesce(TRY_CAST(regexp_extract(path, '([0-9]+)(\\.txt)?$', 1) AS BIGINT), 1) AS i FROM t2 WHERE flag & 4 = 0),
t3 AS (
  SELECT path, CASE WHEN i % 17 = 0 THEN sha256(digest || '+') ELSE digest END AS digest, CASE WHEN i % 17 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN i % 13 = 0 THEN mod_ns + 1000000000 ELSE mod_ns END AS mod_ns FROM l0 WHERE i % 11 <> 0
  UNION ALL SELECT 'new/' || doc_id, sha256(text), octet_length(encode(text))::BIGINT, 1800000000000000000 FROM documents WHERE doc_id % 19 = 0),
m_same AS (SELECT o.path, o.digest, o.size, o.mod_ns, o.flag | 16 AS flag FROM t2 o WHERE o.flag & 4 = 0 AND EXISTS (SELECT 1 FROM t3 n WHERE n.path = o.path AND n.size = o.size AND n.mod_ns = o.mod_ns)),
m_stale AS (SELECT n.path, n.digest, n.size, n.mod_ns, 0 AS flag FROM t3 n WHERE NOT EXISTS (SELECT 1 FROM t2 o WHERE o.flag & 4 = 0 AND n.path = o.path AND n.size = o.size AND n.mod_ns = o.mod_ns)),
m_gone AS (SELECT o.path, o.digest, o.size, o.mod_ns, o.flag | 4 AS flag FROM t2 o WHERE o.flag & 3 <> 0 AND (o.flag & 4 <> 0 OR NOT EXISTS (SELECT 1 FROM t3 n WHERE n.path = o.path AND n.size = o.size AND n.mod_ns = o.mod_ns)))"""


def _steps(p: str) -> str:
    """All prefixes of a path that end in a slash."""
    return f"[array_to_string(string_split({p}, '/')[1:k], '/') || '/' FOR k IN range(1, len(string_split({p}, '/')))]"


def _key(p: str) -> str:
    """Sort key of a path: a letter for the kind before every name, names parted by the least character."""
    names = f"string_split(rtrim({p}, '/'), '/')"
    return f"CASE WHEN {p} = '.' THEN [] ELSE [{{'is_file': CASE WHEN k = len({names}) AND NOT ends_with({p}, '/') THEN 1 ELSE 0 END, 'name': {names}[k]}} FOR k IN range(1, len({names}) + 1)] END"


def _anc(t: str) -> str:
    """(f.*, dir) for every directory above each existing file of a table."""
    return f"SELECT f.*, unnest(list_prepend('.', {_steps('f.path')})) AS dir FROM {t} f WHERE f.flag & 4 = 0"


def content(t: str) -> str:
    return f"""
an AS ({_anc(t)}),
tot AS (SELECT digest, size, count(*) FILTER (flag & 15 IN (0, 3)) AS n_total FROM {t} GROUP BY ALL),
dc AS (SELECT an.dir, an.digest, an.size, bool_or(an.flag & 3 = 3) AS keep,
         count(*) FILTER (NOT (an.size = 0 OR lower(regexp_extract(an.path, '([^/]+)$', 1)) IN ('thumbs.db', 'desktop.ini'))) AS n_real,
         any_value(tot.n_total) - count(*) FILTER (an.flag & 15 IN (0, 3)) AS n_outside
       FROM an JOIN tot USING (digest, size) GROUP BY an.dir, an.digest, an.size),
vd AS (SELECT dir, bool_or(keep) AS keep, count(*) FILTER (n_real > 0 AND n_outside > 0) AS n_safe, count(*) FILTER (n_real > 0 AND n_outside <= 0) AS n_lost FROM dc GROUP BY dir),
ve AS (SELECT *, NOT keep AND n_lost <= 10 AND n_safe > n_lost * n_lost AND dir <> '.' AND NOT regexp_matches(dir, '^(.*/)?\\.(git|svn)/.') AS is_dup FROM vd),
mx AS (SELECT dir, n_safe, n_lost FROM ve a WHERE is_dup AND NOT EXISTS (
         SELECT 1 FROM ve b WHERE b.is_dup AND b.dir <> a.dir AND starts_with(a.dir, b.dir)))"""


def stats(t: str) -> str:
    return f"""
sa AS ({_anc(t)}),
ds AS (SELECT dir, count(*) AS total_files, count(DISTINCT digest) AS unique_files FROM sa GROUP BY dir),
dt AS (SELECT d.dir, (SELECT count(*) FROM ds x WHERE x.dir <> d.dir AND x.dir <> '.' AND (d.dir = '.' OR starts_with(x.dir, d.dir))) AS total_dirs, total_files, unique_files FROM ds d)"""


ATOM = r"CASE WHEN regexp_matches({0}, '^(.*/)?\.(git|svn)/') THEN regexp_extract({0}, '^((?:[^/]+/)*?\.(?:git|svn)/)', 1) END"
PARENT = "CASE WHEN contains(rtrim({0}, '/'), '/') THEN regexp_replace(rtrim({0}, '/'), '[^/]+$', '') ELSE '.' END"
BASE = "regexp_extract(rtrim({0}, '/'), '([^/]+)$', 1)"

CANDIDATES = """
want AS (SELECT dc.dir, digest, size FROM dc JOIN mx USING (dir) WHERE n_real > 0 AND n_outside > 0),
place AS (SELECT DISTINCT digest, size, """ + PARENT.format("path") + """ AS own FROM {t} WHERE flag & 15 IN (0, 3)),
lifted AS (SELECT DISTINCT dir, digest, size, coalesce(""" + ATOM.format("own") + """, own) AS spot FROM want JOIN place USING (digest, size) WHERE NOT starts_with(own, dir)),
cand AS (SELECT DISTINCT dir, digest, size, unnest(CASE WHEN spot = '.' THEN ['.'] ELSE list_prepend('.', """ + _steps("spot") + """) END) AS alt FROM lifted)"""

_COMMON = "list_extract([x FOR x IN list_prepend('.', " + _steps("dir") + ") IF list_contains(CASE WHEN alt = '.' THEN ['.'] ELSE list_prepend('.', " + _steps("alt") + ") END, x)], -1)"
_SLASHES = "(length({0}) - length(replace({0}, '/', '')))"
SCORES = f"""
cn AS (SELECT dir, alt, count(*) AS n_safe FROM cand GROUP BY ALL),
rest AS (SELECT dir, count(*) AS n_rest FROM (SELECT DISTINCT dir, digest, size FROM cand) GROUP BY dir),
pre AS (SELECT cn.dir, alt, n_safe, n_rest, unique_files AS u, total_files AS f, total_dirs AS t, {_SLASHES.format('cn.dir')} + {_SLASHES.format('alt')} AS both_slashes,
    {_COMMON.replace('dir,', 'cn.dir,')} AS root FROM cn JOIN rest USING (dir) JOIN dt ON dt.dir = cn.alt),
sc AS (SELECT dir, alt, n_safe, n_rest,
    (0.625::DOUBLE * ((n_safe::DOUBLE / n_rest) * (n_safe::DOUBLE / u)) + (n_safe::DOUBLE / f) / 8 + (1 / (1 + t::DOUBLE)) / 8
     + (1 / ({_SLASHES.format('dir')} - CASE WHEN root = '.' THEN 0 ELSE {_SLASHES.format('root')} END)::DOUBLE) / 8) / CASE WHEN alt = '.' OR starts_with(dir, alt) THEN 2 ELSE 1 END AS score
  FROM pre)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


# Samples are 0.75 s apart, so every one but the first has the weight 0.075 and the fold is a weighted sum.
EWMA = """WITH s AS (
  SELECT user_id % 50 AS scan, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n, event_id % 7 + 1 AS files, (event_id % 1000) * 97 AS bytes FROM events),
w AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE 0.75 / 10 END * power(1 - 0.75::DOUBLE / 10, max(n) OVER (PARTITION BY scan) - n) / 0.75 AS weight FROM s)
SELECT scan, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, round(sum(weight * files ORDER BY n), 6) AS fps, round(sum(weight * bytes ORDER BY n), 4) AS bps FROM w GROUP BY scan"""

FLAG_TEXT = "CASE WHEN flag & 8 <> 0 OR flag & 3 = 0 THEN '' ELSE ['D', 'J', 'K'][flag & 3] || CASE WHEN flag & 4 <> 0 THEN 'X' ELSE '' END END"

# Paths of the tree are plain ASCII, so their width is their length, and times are whole seconds.
INDEX_LINES = f"""
e AS (SELECT *, row_number() OVER o AS n, lag(mod_ns) OVER o AS before, 8 + length(path) // 8 * 8 + 16 AS used FROM t2 WHERE flag & 4 = 0 OR flag & 3 <> 0
      WINDOW o AS (PARTITION BY digest, size ORDER BY {_key('path')}, flag & 4, mod_ns, flag & 3)),
a AS (SELECT *, greatest(104, max(used) OVER (PARTITION BY digest, size)) AS align FROM e),
entry AS (SELECT n, {FLAG_TEXT} || chr(9) || path || CASE WHEN before IS DISTINCT FROM mod_ns THEN chr(9) || '//' || repeat(chr(9), ((align - used) // 8 + 1)::INT) || strftime(make_timestamp(mod_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS line FROM a)"""

ORACLE_SQL = {
    "digest_groups": _with(T2) + f"SELECT digest, size, count(*) AS n, arg_min(path, {_key('path')}) AS first FROM t2 GROUP BY digest, size",
    "files_sorted": _with(T2) + f"SELECT path, digest, size, mod_ns, flag, row_number() OVER (PARTITION BY {PARENT.format('path')} ORDER BY {_key('path')}, flag & 4, mod_ns, flag & 3, size) AS n FROM t2",
    "dir_stats": _with(T2, stats("t2")) + f"SELECT dir, CASE WHEN dir <> '.' THEN {PARENT.format('dir')} END AS parent, CASE WHEN dir <> '.' THEN {BASE.format('dir')} END AS base, {ATOM.format('dir')} AS atom, total_dirs, total_files, unique_files FROM dt",
    "atoms": _with(T2) + f"SELECT path, {ATOM.format('path')} AS atom FROM t2",
    "ancestors": _with(T2) + f"SELECT path, unnest(list_prepend('.', {_steps('path')})) AS dir FROM t2",
    "unique_dirs": _with(T2) + f"SELECT DISTINCT dir FROM ({_anc('t2')})",
    "path_parts": _with(T2) + f"SELECT path, {PARENT.format('path')} AS parent, {BASE.format('path')} AS base, ends_with(path, '/') AS is_dir FROM t2",
    "path_dist": _with(T1, f"p AS (SELECT path AS dir, replace(path, 'live/', 'old/') AS a0, doc_id FROM t1 WHERE top = 'live/'), q AS (SELECT dir, CASE WHEN doc_id % 2 = 0 THEN a0 ELSE {PARENT.format('dir')} END AS alt FROM p), r AS (SELECT dir, alt, {_COMMON} AS root FROM q)")
    + f"SELECT dir AS a, alt AS b, root, {_SLASHES.format('dir')} + {_SLASHES.format('alt')} - 2 * CASE WHEN root = '.' THEN 0 ELSE {_SLASHES.format('root')} END AS dist FROM r",
    "path_rank": _with(T2, f"d AS (SELECT DISTINCT {PARENT.format('path')} AS path FROM t2 UNION SELECT path FROM t2)") + f"SELECT path, row_number() OVER (PARTITION BY {PARENT.format('path')} ORDER BY {_key('path')}) AS n FROM d WHERE path <> '.'",
    "flag_predicates": _with(T2) + f"SELECT path, flag, flag & 3 = 1 AS is_dup, flag & 3 = 2 AS is_junk, flag & 3 = 3 AS is_keep, flag & 4 <> 0 AS is_gone, flag & 3 IN (1, 2) AS may_remove, flag & 15 IN (0, 3) AS is_safe, flag & 4 = 0 OR flag & 3 <> 0 AS is_stored, {FLAG_TEXT} AS text FROM t2",
    "ignorable": _with(T2) + f"SELECT path, size FROM t2 WHERE size = 0 OR lower({BASE.format('path')}) IN ('thumbs.db', 'desktop.ini')",
    "file_lookup": _with(T2) + "SELECT path, digest, size, mod_ns, flag FROM t2 WHERE path = 'live/src0/Thumbs.db' AND flag & 4 = 0",
    "mark_keep": _with(T2) + "SELECT path, CASE WHEN starts_with(path, 'live/src1/') AND flag & 7 = 0 THEN flag | 3 ELSE flag END AS flag FROM t2",
    "mark_dup": _with(T2) + "SELECT path, CASE WHEN starts_with(path, 'backup/') AND flag & 7 = 0 THEN flag | 1 ELSE flag END AS flag FROM t2",
    "mark_junk": _with(T2) + "SELECT path, CASE WHEN (path = 'live/src0/Thumbs.db' OR starts_with(path, 'old/src2/')) AND flag & 7 = 0 THEN flag | 2 ELSE flag END AS flag FROM t2",
    "rescan_same": _with(T3) + "SELECT * FROM m_same",
    "rescan_stale": _with(T3) + "SELECT path, size, mod_ns FROM m_stale",
    "rescan_gone": _with(T3) + "SELECT * FROM m_gone",
    "rescan_merge": _with(T3) + "SELECT * FROM m_same UNION ALL SELECT * FROM m_stale UNION ALL SELECT * FROM m_gone",
    "dup_verdicts": _with(T2, content("t2")) + "SELECT dir, keep, n_safe, n_lost, is_dup FROM ve",
    "dups_maximal": _with(T1, content("t1")) + "SELECT dir, n_safe, n_lost FROM mx",
    "dups_flagged": _with(T2, content("t2")) + "SELECT dir, n_safe, n_lost FROM mx",
    "dups_limit": _with(T1, content("t1")) + f"SELECT dir, n_safe, n_lost FROM mx ORDER BY {_key('dir')} LIMIT 5",
    "dup_lost": _with(T2, content("t2")) + "SELECT an.dir, an.path, an.digest, an.size, an.mod_ns, an.flag FROM an JOIN mx ON an.dir = mx.dir JOIN dc ON dc.dir = an.dir AND dc.digest = an.digest AND dc.size = an.size WHERE dc.n_real > 0 AND dc.n_outside <= 0 AND NOT (an.size = 0 OR lower(regexp_extract(an.path, '([^/]+)$', 1)) IN ('thumbs.db', 'desktop.ini'))",
    "dup_ignored": _with(T2, content("t2")) + "SELECT an.dir, an.path, an.digest, an.size, an.mod_ns, an.flag FROM an JOIN mx ON an.dir = mx.dir WHERE an.size = 0 OR lower(regexp_extract(an.path, '([^/]+)$', 1)) IN ('thumbs.db', 'desktop.ini')",
    "alt_candidates": _with(T2, content("t2"), CANDIDATES.replace("{t}", "t2")) + "SELECT dir, alt, count(*) AS n FROM cand GROUP BY ALL",
    "alt_scores": _with(T2, content("t2"), CANDIDATES.replace("{t}", "t2"), stats("t2"), SCORES) + "SELECT dir, alt, n_safe, n_rest, round(score, 9) AS score FROM sc",
    "alt_best": _with(T2, content("t2"), CANDIDATES.replace("{t}", "t2"), stats("t2"), SCORES) + f"SELECT dir, alt, round(score, 9) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, {_key('alt')}) = 1",
    "index_parse": _with(T2) + "SELECT path, digest, size, mod_ns, flag FROM t2 WHERE flag & 4 = 0 OR flag & 3 <> 0",
    "index_lines": _with(T2, INDEX_LINES) + "SELECT n, line FROM entry UNION ALL SELECT max(n) + 1, chr(9) || chr(9) || digest || chr(9) || size FROM e GROUP BY digest, size",
    "hash_compare": _with(T1) + f"SELECT {PARENT.format('path')} AS dir, count(*) AS n, count(DISTINCT digest) AS n_distinct, CASE WHEN count(*) >= 2 THEN count(DISTINCT digest) = 1 END AS identical FROM t1 GROUP BY 1",
    "progress_ewma": EWMA,
    "wide_groups": "SELECT 'u' || user_id % 20 || '/' || event_type AS dir, count(*) AS total_files, count(DISTINCT sha256(props || '|' || event_type || '|' || user_id % 50)) AS unique_files FROM events GROUP BY 1",
}
