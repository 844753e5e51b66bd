"""DuckDB SQL for the queries of the code-quality engine.

It shares no pattern with the engine. The sample project's parts are taken from answers; what follows from them (metrics, cycles by
reachability, the policy, the gate) and all that is found in documents is worked out here by other formulations.
"""

from __future__ import annotations

from sparkquill import answers, sample
from sparkquill.operators import copies
from sparkquill.plans import gate
from sparkquill.sample import quoted, values_sql

ISSUE = "path, line, rule_id, category, severity, confidence, found, message"


def _values(rows) -> str:
    """Rows as a VALUES list; null, numbers and strings."""
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else quoted(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n"


_RAW = f"""sample(path, content) AS ({values_sql(sample.FILES)}),
docs AS (SELECT 'corpus/' || coalesce(source, 'none') || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS content FROM documents),
raw AS (SELECT * FROM sample UNION ALL SELECT * FROM docs)"""
_FILES = f"""{_RAW},
traits(path, lang, file_class, layer) AS ({_values(answers.TRAITS)}),
dirs AS (SELECT path, content, list_filter(string_split(lower(path), '/')[:-2], lambda d: d <> '') AS d FROM docs),
files AS (
  SELECT path, content, lang, file_class, layer FROM sample JOIN traits USING (path)
  UNION ALL SELECT path, content, 'other',
    CASE WHEN list_has_any(d, ['test', 'tests', '__tests__', 'spec']) THEN 'test' WHEN list_has_any(d, ['generated', 'gen', 'dist', 'build']) THEN 'generated' WHEN list_has_any(d, ['migration', 'migrations']) THEN 'migration' ELSE 'doc' END,
    CASE WHEN list_has_any(d, ['domain', 'entities']) THEN 'domain' WHEN list_has_any(d, ['application', 'service', 'services', 'usecase', 'usecases']) THEN 'application'
         WHEN list_has_any(d, ['infrastructure', 'infra', 'persistence', 'repositories']) THEN 'infrastructure' WHEN list_has_any(d, ['presentation', 'controller', 'controllers', 'view', 'views', 'api', 'ui']) THEN 'presentation' ELSE 'none' END
  FROM dirs)"""


def _code(source: str) -> str:
    """content without the comments that the sample is known to have."""
    out = "content"
    for path, comment, left in answers.COMMENTS:
        out = f"CASE WHEN path = {quoted(path)} THEN replace({out}, {quoted(comment)}, {quoted(left)}) ELSE {out} END"
    return f"(SELECT path, {out} AS content FROM {source})"


#: Red lines and the licence rule in texts: rule, category, severity, message, pattern. Gaps between words may hold line ends.
_GAP, _Q, _NQ = r"[ \t\n\r\f\v]*", r"[\x22\x27]", r"[^\x22\x27\n]"
_WORD = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[aA][pP][iI]_?[kK][eE][yY]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN])"
_CALLED = rf"\b(eval|exec|os\.system)\({_GAP}([^)\x22\x27\s]|\x22[^\x22\n]*\x22{_GAP}[^)\x22\s]|\x27[^\x27\n]*\x27{_GAP}[^)\x27\s])"
_LOGGED = rf"(?i)\b(logging|logger|log|console)[.\w]*\("
_IN_TEXTS = (
    ("hardcoded_secret", "security", "block", "a secret is written into the code", rf"\b{_WORD}{_GAP}(:|=){_GAP}{_Q}{_NQ}{{6,}}{_Q}"),
    ("sql_concatenation", "security", "block", "a statement is put together from strings", rf"(?i){_Q}{_GAP}(select|insert|update|delete)\b{_NQ}*{_Q}{_GAP}(\+|%)"),
    ("sql_concatenation", "security", "block", "a statement is put together from strings", rf"(?i){_Q}{_GAP}(select|insert|update|delete)\b[^\x22\x27]*{_Q}{_GAP}(\+|%)"),
    ("dangerous_call", "security", "block", "input may be run as code", rf"{_CALLED}[^)\n]*\)"),
    ("dangerous_call", "security", "block", "input may be run as code", rf"{_CALLED}[^)]*\)"),
    ("sensitive_log", "security", "block", "sensitive data may reach a log", rf"{_LOGGED}[^)\n]*\b{_WORD}\b[^)\n]*\)"),
    ("sensitive_log", "security", "block", "sensitive data may reach a log", rf"{_LOGGED}[^)]*\b{_WORD}\b[^)]*\)"),
    ("empty_handler", "security", "block", "an error is swallowed", rf"\bcatch{_GAP}(\([^)]*\))?{_GAP}\{{{_GAP}\}}"),
    ("empty_handler", "security", "block", "an error is swallowed", rf"\bexcept\b[^:\n]*:{_GAP}(pass\b|\.\.\.)"),
    ("ANY_LICENSE", "custom", "info", "licence line", r"\b[lL][iI][cC][eE][nN][sS][eE][dD]? [uU][nN][dD][eE][rR]\b"),
)
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"
_TEXT_ISSUES = (
    "hits AS ("
    + " UNION ALL ".join(
        f"SELECT path, '{rule}' AS rule_id, '{category}' AS category, '{severity}' AS severity, '{message}' AS message, regexp_extract_all(content, {quoted(p)}) AS f, string_split_regex(content, {quoted(p)}) AS pieces FROM docs WHERE regexp_matches(content, {quoted(p)})"
        for rule, category, severity, message, p in _IN_TEXTS
    )
    + f"""),
placed AS (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM hits),
text_issues AS (
  SELECT DISTINCT path, CAST(1 + {_NL.format("array_to_string(pieces[1:k], '')")} + {_NL.format("array_to_string(f[1:k - 1], '')")} AS INTEGER) AS line, rule_id, category, severity, 70 AS confidence, f[k] AS found, message FROM placed)"""
)
_LINES = f"""known(path, line, rule_id, category, severity, confidence, found, message) AS ({_values(answers.LINES)}),
line_issues AS (SELECT {ISSUE} FROM known UNION ALL SELECT {ISSUE} FROM text_issues)"""
_PART = "path, lang, kind, name, line, complexity, nesting, n_params, n_methods"
_PARTS = f"parts({_PART}) AS ({_values(answers.PARTS)})"
_PLAIN = f"parts({_PART}) AS ({_values([r for r in answers.PARTS if r[1] != 'python'] + list(answers.PYTHON_BY_PATTERNS))})"
_METRICS = """measured AS (
  SELECT path, lang, line, coalesce(name, '') AS found, kind, unnest([{'c': 'complexity', 'v': complexity, 'most': 10}, {'c': 'params', 'v': n_params, 'most': 5},
    {'c': 'nesting', 'v': CASE WHEN lang = 'python' THEN nesting END, 'most': 4}, {'c': 'methods', 'v': CASE WHEN lang IN ('python', 'java', 'csharp') THEN n_methods END, 'most': 20}]) AS m FROM parts),
part_issues AS (
  SELECT path, CAST(line AS INTEGER) AS line, 'too_high_' || m.c AS rule_id, m.c AS category, 'warn' AS severity, CASE WHEN lang = 'python' AND %(trees)s AND path NOT IN (SELECT path FROM parts WHERE kind = 'unparsable') THEN 90 ELSE 80 END AS confidence, found, CAST(m.v AS VARCHAR) || ' is over the limit' AS message
  FROM measured WHERE m.v > m.most
  UNION ALL SELECT path, CAST(line AS INTEGER), 'empty_handler', 'security', 'block', 90, '', 'an error is swallowed' FROM parts WHERE kind = 'empty_handler'
  UNION ALL SELECT path, CAST(line AS INTEGER), kind, 'exception_handling', 'warn', 90, '', CASE kind WHEN 'bare_except' THEN 'catches everything' ELSE 'catches more than it can handle' END FROM parts WHERE kind IN ('bare_except', 'broad_catch')),
told(path, line, origin) AS (%(reached)s),
placed_issues AS (
  SELECT path, line, rule_id, category, severity, CASE WHEN %(trees)s AND rule_id = 'dangerous_call' AND origin IS NOT NULL THEN 90 ELSE confidence END AS confidence, found,
    CASE WHEN %(trees)s AND rule_id = 'dangerous_call' AND origin IS NOT NULL THEN message || ': ' || origin ELSE message END AS message
  FROM line_issues LEFT JOIN told USING (path, line) WHERE NOT (%(trees)s AND rule_id IN ('empty_handler', 'bare_except', 'broad_catch') AND path LIKE '%%.py' AND path NOT IN (SELECT path FROM parts WHERE kind = 'unparsable'))
    AND NOT (rule_id IN ('bare_except', 'broad_catch') AND path IN (SELECT s.path FROM sample s WHERE regexp_matches(string_split(s.content, chr(10))[line], 'catch[^{}]*[{][^{}]*\\bthrow\\b')))),
long_files AS (
  SELECT path, 1 AS line, 'too_high_lines' AS rule_id, 'lines' AS category, 'warn' AS severity, 80 AS confidence, '' AS found, CAST(len(string_split(content, chr(10))) AS VARCHAR) || ' is over the limit' AS message
  FROM raw WHERE len(string_split(content, chr(10))) > 500)"""
_BLOCKS = """trimmed AS (
  SELECT path, stands, line, row_number() OVER (PARTITION BY path ORDER BY stands) AS k FROM (
    SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS stands, trim(unnest(string_split(content, chr(10)))) AS line FROM {0}) WHERE line <> ''),
blocks AS (
  SELECT path, stands, k, count(*) OVER w AS n, md5(string_agg(line, chr(10)) OVER w) AS hash FROM trimmed
  WINDOW w AS (PARTITION BY path ORDER BY k ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
dup_blocks AS (
  SELECT hash, count(*) AS occurrences, count(DISTINCT path) AS n_files, min(path) AS first_path FROM blocks WHERE n = 6 GROUP BY 1 HAVING count(*) > 1)"""
_DUPLICATES = _BLOCKS.format("(SELECT f.path, f.content FROM files f WHERE file_class NOT IN ('generated', 'migration'))") + """,
runs AS (
  SELECT path, stands, k, hash, occurrences, k - row_number() OVER (PARTITION BY path ORDER BY k) AS island FROM blocks JOIN dup_blocks USING (hash) WHERE n = 6),
duplicate_issues AS (
  SELECT path, CAST(arg_min(stands, k) AS INTEGER) AS line, 'duplicate_block' AS rule_id, 'duplicate_code' AS category, 'warn' AS severity, 80 AS confidence, arg_min(hash, k) AS found,
    'stands ' || CAST(min(occurrences) AS VARCHAR) || ' times' || CASE WHEN count(*) > 1 THEN ', ' || CAST(count(*) + 5 AS VARCHAR) || ' lines long' ELSE '' END AS message
  FROM runs GROUP BY path, island)"""
#: Tokens of the sample's code and of words, each with its line; names as distances within 40 tokens; the least of 21 hashes, the later of equals.
_LITERAL = r"\x22\x22\x22(?:[^\x22]|\x22[^\x22]|\x22\x22[^\x22])*\x22\x22\x22|\x22(?:[^\x22\\\n]|\\[^\n])*\x22|\x27(?:[^\x27\\\n]|\\[^\n])*\x27"
_KEPT = {**{lang: copies.BRACES for lang in ("javascript", "java", "go", "csharp", "cpp", "rust")}, **copies.WORDS}
_COPIES = f"""coded AS (
  SELECT path, lang, regexp_extract_all(content, {quoted(_LITERAL + "|[A-Za-z_][A-Za-z0-9_]*|[0-9][0-9A-Za-z_.]*|[^ ]")}) AS m FROM {_code("sample")} JOIN traits USING (path) WHERE lang <> 'other'
  UNION ALL SELECT path, 'other', regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+|\\n') FROM raw LEFT JOIN traits USING (path) WHERE coalesce(lang, 'other') = 'other'),
keywords AS ({" UNION ALL ".join(f"SELECT '{lang}' AS lang, unnest({sorted(words)}) AS t" for lang, words in _KEPT.items())}),
pieces AS (SELECT path, lang, generate_subscripts(m, 1) AS j, unnest(m) AS t FROM coded),
on_lines AS (SELECT *, 1 + coalesce(sum({_NL.format("t")}) OVER (PARTITION BY path ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM pieces),
signs AS (
  SELECT path, lang, row_number() OVER (PARTITION BY path ORDER BY j) AS k, line, lang <> 'other' AND regexp_matches(t, '^[A-Za-z_]') AND w.t IS NULL AS named,
    CASE WHEN lang = 'other' THEN regexp_replace(t, '[0-9]+', '0', 'g') WHEN regexp_matches(t, '^[0-9]') THEN '0' WHEN length(t) > 1 AND t[1] IN (chr(34), chr(39)) THEN repeat(chr(34), 2) ELSE t END AS t
  FROM on_lines LEFT JOIN keywords w USING (lang, t) WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]')),
named AS (SELECT *, CASE WHEN named THEN lag(k) OVER (PARTITION BY path, named, t ORDER BY k) END AS prev FROM signs),
starts AS (SELECT path, k, unnest(range(k, k + 40)) AS pos FROM named WHERE lang <> 'other'),
grams AS (
  SELECT path, k, arg_min(line, pos) AS line, arg_max(line, pos) AS last, string_agg(CASE WHEN named THEN 'v' || CASE WHEN prev >= s.k THEN pos - prev ELSE 0 END ELSE t END, ' ' ORDER BY pos) AS gram, count(DISTINCT t) AS varied
  FROM starts s JOIN (SELECT path, k AS pos, line, named, prev, t FROM named) USING (path, pos) GROUP BY path, k HAVING count(*) = 40
  UNION ALL SELECT path, k, line, last, gram, len(list_distinct(string_split(gram, ' '))) FROM (
    SELECT path, k, line, last_value(line) OVER w AS last, string_agg(t, ' ') OVER w AS gram, count(*) OVER w AS n FROM named WHERE lang = 'other'
    WINDOW w AS (PARTITION BY path ORDER BY k ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)) WHERE n = 40),
digests AS (SELECT path, k, line, last, md5(gram) AS hash, varied, count(*) OVER (PARTITION BY path) AS total FROM grams),
windows AS (
  SELECT path, least(total, 21) AS wanted, count(*) OVER w AS n, min(hash || lpad(CAST(999999999 - k AS VARCHAR), 9, '0')) OVER w AS least FROM digests
  WINDOW w AS (PARTITION BY path ORDER BY k ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)),
picked AS (SELECT DISTINCT path, 999999999 - CAST(least[33:] AS INTEGER) AS k FROM windows WHERE n = wanted),
prints AS (SELECT path, line, last, hash, row_number() OVER (PARTITION BY path ORDER BY k) AS pos FROM picked JOIN digests USING (path, k) WHERE varied >= 8 %s),
shared AS (SELECT hash, count(*) AS n_places FROM prints GROUP BY hash HAVING count(*) > 1),
alike AS (SELECT *, pos - row_number() OVER (PARTITION BY path ORDER BY pos) AS island FROM prints JOIN shared USING (hash)),
renamed AS (
  SELECT path, CAST(arg_min(line, pos) AS INTEGER) AS line, CAST(max(last) AS INTEGER) AS last_line, min(n_places) AS n_places, arg_min(hash, pos) AS hash FROM alike GROUP BY path, island)"""
_RENAMED = _COPIES % "AND path IN (SELECT path FROM traits WHERE lang <> 'other' AND file_class NOT IN ('generated', 'migration'))" + """,
exact AS (SELECT path, min(stands) AS line, max(stands) + 5 AS last_line FROM runs GROUP BY path, island),
renamed_issues AS (
  SELECT path, line, 'renamed_copy' AS rule_id, 'duplicate_code' AS category, 'warn' AS severity, 80 AS confidence, hash AS found,
    'to line ' || CAST(last_line AS VARCHAR) || ' stands ' || CAST(n_places AS VARCHAR) || ' times but for names and literals' AS message
  FROM renamed r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.path = r.path AND 2 * (least(r.last_line, e.last_line) - greatest(r.line, e.line) + 1) >= r.last_line - r.line + 1))"""
_EDGES = f"edges(src, dst) AS ({_values(answers.EDGES)})"


def _cycles(edges: str) -> str:
    """Components by what reaches what; of each, paths from the least node that repeat nothing, until they are back."""
    return f"""reached(src, dst) AS (SELECT src, dst FROM {edges} UNION SELECT r.src, e.dst FROM reached r JOIN {edges} e ON e.src = r.dst),
member AS (
  SELECT a.src AS node, min(a.dst) AS component FROM reached a JOIN reached b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src),
walks AS (
  SELECT component, node, [node] AS path FROM member WHERE node = component
  UNION ALL SELECT w.component, e.dst, list_append(path, e.dst) FROM walks w JOIN {edges} e ON e.src = w.node JOIN member m ON m.node = e.dst AND m.component = w.component
  WHERE (w.node <> w.component OR len(path) = 1) AND (e.dst = w.component OR NOT list_contains(path, e.dst))),
shortest AS (
  SELECT component, path FROM walks WHERE len(path) > 1 AND node = component QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1),
circles AS (
  SELECT m.node, m.component, (SELECT count(*) FROM member x WHERE x.component = m.component) AS n_nodes, CAST(len(s.path) - 1 AS INTEGER) AS length, array_to_string(s.path, '>') AS cycle
  FROM member m JOIN shortest s USING (component))"""


_GRAPH = f"""{_EDGES},
{_cycles("edges")},
violations(src, dst, src_layer, dst_layer) AS ({_values(answers.VIOLATIONS)}),
graph_issues AS (
  SELECT node AS path, CAST(NULL AS INTEGER) AS line, 'dependency_cycle' AS rule_id, 'architecture' AS category, 'block' AS severity, 95 AS confidence, cycle AS found, CAST(n_nodes AS VARCHAR) || ' files or packages import each other in a circle' AS message FROM circles WHERE node NOT LIKE '%/'
  UNION ALL SELECT src, NULL, 'layer_violation', 'architecture', 'block', 80, dst, src_layer || ' imports ' || dst_layer FROM violations)"""
_NAMING = f"naming({ISSUE}) AS ({_values(answers.NAMING)})"
_OFF = f"off(file_class, category) AS ({values_sql(gate.SWITCHED_OFF)})"


def _issues(team: bool = False, trees: bool = False, where: str = "true") -> str:
    plain = f"""SELECT {ISSUE} FROM placed_issues UNION ALL SELECT {ISSUE} FROM part_issues UNION ALL SELECT {ISSUE} FROM long_files
  UNION ALL SELECT {ISSUE} FROM duplicate_issues UNION ALL SELECT {ISSUE} FROM renamed_issues UNION ALL SELECT {ISSUE} FROM graph_issues""" + f" UNION ALL SELECT {ISSUE} FROM naming" * team
    return _with(_FILES, _OFF, _TEXT_ISSUES, _LINES, _PARTS if trees else _PLAIN, _METRICS % {"trees": str(trees).lower(), "reached": _values(answers.REACHED)}, _DUPLICATES, _RENAMED, _GRAPH, _NAMING, f"""plain AS ({plain}),
issues AS (
  SELECT p.* FROM plain p JOIN files f USING (path) WHERE {where} AND (p.category = 'security' OR NOT EXISTS (SELECT 1 FROM off WHERE off.file_class = f.file_class AND off.category = p.category)))""", recursive=True)


_DEPTHS = """braces AS (SELECT path, generate_subscripts(b, 1) AS k, unnest(b) AS brace FROM (SELECT path, regexp_extract_all(content, '[{}]') AS b FROM texts)),
depths AS (
  SELECT s.path, CAST(coalesce(max(depth), 0) AS INTEGER) AS max_depth FROM texts s LEFT JOIN (
    SELECT path, greatest(0, sum(CASE brace WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY k)) AS depth FROM braces) x ON s.path = x.path GROUP BY s.path)"""
_RULES = f"catalog AS (SELECT unnest(json_extract(CAST({quoted(sample.RULES_JSON)} AS JSON), '$.rules[*]')) AS r)"
_RULE = ", ".join(f"r->>'{c}' AS {c}" for c in ("id", "description", "severity", "target", "pattern", "message", "suggestion"))


def _hits(rule: str) -> str:
    return _with(_RAW, _TEXT_ISSUES, _LINES) + f"SELECT path, found, count(*) AS n FROM line_issues WHERE rule_id = '{rule}' GROUP BY ALL"


def _part(kind: str, columns: str, trees: bool = True) -> str:
    """By trees only what trees gave."""
    only = " AND lang = 'python' AND path NOT IN (SELECT path FROM parts WHERE kind = 'unparsable')" * trees
    whole = ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c not in ("name", "lang") else c for c in columns.split(", "))
    return _with(_PARTS if trees else _PLAIN) + f"SELECT path, {whole} FROM parts WHERE kind = '{kind}'{only}"


_CHANGED = f"path IN (SELECT x FROM ({values_sql(sample.CHANGED)}) AS c(x))"
_TEXTS = f"texts AS (SELECT path, content FROM {_code('sample')} UNION ALL SELECT CAST(page_id AS VARCHAR), coalesce(html, '') FROM pages)"
ORACLE_SQL: dict[str, str] = {
    "scan_files": _with(_FILES) + "SELECT path, lang, file_class, layer, CAST(length(content) AS INTEGER) AS n_chars FROM files",
    "scan_diff": _issues(trees=True, where=_CHANGED) + f"SELECT {ISSUE} FROM issues",
    "scan_team": _issues(team=True) + f"SELECT {ISSUE} FROM issues",
    "load_rules": _with(_FILES, _RULES) + f"""SELECT {_RULE}, CASE r->>'target' WHEN 'domain' THEN (SELECT count(*) FROM files WHERE layer = 'domain') WHEN 'python' THEN (SELECT count(*) FROM files WHERE lang = 'python')
  WHEN '*.ts' THEN (SELECT count(*) FROM files WHERE path LIKE '%.ts') ELSE (SELECT count(*) FROM files) END AS n_files FROM catalog""",
    "detect_language": _with(_FILES) + "SELECT lang, count(*) AS n_files FROM files GROUP BY lang",
    "classify_file": _with(_FILES) + "SELECT file_class, count(*) AS n_files FROM files GROUP BY file_class",
    "classify_layer": _with(_FILES) + "SELECT layer, count(*) AS n_files FROM files GROUP BY layer",
    "class_policy": _with(_FILES, _OFF) + "SELECT file_class, count(*) AS n_files, (SELECT count(*) FROM off WHERE off.file_class = files.file_class) AS n_off FROM files GROUP BY file_class",
    "rule_scope": _with(_FILES) + "SELECT 'DOMAIN_HAS_NO_CLOCK' AS id, path FROM files WHERE layer = 'domain' UNION ALL SELECT 'PY_RUN_IS_NAMED', path FROM files WHERE lang = 'python' UNION ALL SELECT 'ANY_LICENSE', path FROM files",
    "rule_scope_glob": _with(_FILES) + "SELECT 'TS_HOSTS_BY_NAME' AS id, path FROM files WHERE path LIKE '%.ts'",
    "custom_rules": _with(_RAW, _TEXT_ISSUES, _LINES) + f"SELECT {ISSUE} FROM line_issues WHERE category = 'custom'",
    "constraint_view": _with(_FILES, _RULES) + f"""SELECT path, id, '[' || upper(severity) || '] ' || target || ': ' || description || ' - ' || suggestion AS line FROM (SELECT {_RULE} FROM catalog) JOIN files
  ON CASE target WHEN 'domain' THEN layer = 'domain' WHEN 'python' THEN lang = 'python' WHEN '*.ts' THEN path LIKE '%.ts' ELSE true END WHERE id <> 'BROKEN'""",
    "strip_comments": _with(_RAW) + f"SELECT path, md5(content) AS stripped_md5, CAST(length(content) AS INTEGER) AS n_chars FROM {_code('raw')}",
    "three_scan_security": _with(_RAW, _TEXT_ISSUES, _LINES) + f"SELECT {ISSUE} FROM line_issues WHERE category = 'security'",
    "red_lines": _with(_RAW, _TEXT_ISSUES, _LINES) + "SELECT rule_id, confidence, count(*) AS n_issues, count(DISTINCT path) AS n_files FROM line_issues WHERE category = 'security' GROUP BY ALL",
    "secrets": _hits("hardcoded_secret"),
    "sql_concat": _hits("sql_concatenation"),
    "dangerous_calls": _hits("dangerous_call"),
    "log_leak": _hits("sensitive_log"),
    "empty_handlers": _hits("empty_handler"),
    "external_input": f"SELECT path, CAST(line AS INTEGER) AS line, origin FROM ({_values(answers.REACHED)}) AS r(path, line, origin) UNION ALL SELECT 'tools/clean.py', 8, 'constant'",
    "exception_handling": _with(_RAW, _TEXT_ISSUES, _LINES) + f"SELECT {ISSUE} FROM line_issues WHERE category = 'exception_handling' OR rule_id = 'empty_handler'",
    "file_size": _with(_RAW) + "SELECT path, CAST(length(content) AS INTEGER) AS n_chars, CAST(len(string_split(content, chr(10))) AS INTEGER) AS n_lines FROM raw",
    "complexity_regex": _part("function", "lang, name, line, complexity", trees=False),
    "param_count_regex": _part("function", "lang, name, line, n_params", trees=False),
    "class_methods_regex": _part("class", "lang, name, line, n_methods", trees=False),
    "nesting_braces": _with(_RAW, _TEXTS, _DEPTHS) + "SELECT * FROM depths",
    "dup_blocks": _with(_RAW, _BLOCKS.format("raw")) + "SELECT * FROM dup_blocks",
    "dup_files": _with(_RAW) + "SELECT md5(content) AS hash, count(*) AS copies, min(path) AS first_path FROM raw GROUP BY 1 HAVING count(*) > 1",
    "renamed_copies": _with(_FILES, _COPIES % "") + "SELECT path, line, last_line, n_places, hash FROM renamed",
    "naming_consistency": _with(_NAMING) + f"SELECT {ISSUE} FROM naming",
    "dep_edges": _with(_EDGES) + "SELECT * FROM edges",
    "dep_cycles": _with(_EDGES, _cycles("edges"), recursive=True) + "SELECT node AS path, component, n_nodes, length, cycle FROM circles",
    "event_cycles": _with(
        "steps AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)",
        "counts AS (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)",
        "often AS (SELECT src, dst FROM counts WHERE n > (SELECT avg(n) FROM counts))",
        _cycles("often"),
        recursive=True,
    ) + "SELECT node AS event_type, component, n_nodes, length, cycle FROM circles",
    "layer_violations": _with(f"violations(src, dst, src_layer, dst_layer) AS ({_values(answers.VIOLATIONS)})") + "SELECT * FROM violations",
    "all_issues": _issues() + f"SELECT {ISSUE} FROM issues",
    "issues_by_severity": _issues() + "SELECT severity, count(*) AS n_issues, count(DISTINCT path) AS n_files, min(confidence) AS least_confidence FROM issues GROUP BY severity",
    "gate_exit_code": _issues() + "SELECT coalesce(max(CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END), 0) AS exit_code FROM issues",
    "issue_json": _issues() + "SELECT CAST(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in ISSUE.split(", ")) + ")) AS VARCHAR) AS issue FROM issues",
    "all_issues_ast": _issues(team=True, trees=True) + f"SELECT {ISSUE} FROM issues",
    "complexity_ast": _part("function", "name, line, complexity"),
    "nesting_ast": _part("function", "name, line, nesting"),
    "param_count_ast": _part("function", "name, line, n_params"),
    "class_methods_ast": _part("class", "name, line, n_methods"),
    "empty_handlers_ast": _part("empty_handler", "line"),
}
