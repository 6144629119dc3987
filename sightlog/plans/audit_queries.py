"""Queries of the corpus audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import text as tx
from sightlog.operators import audit as au
from sightlog.operators import labels as lb
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.sources import tables as src

# One small C file per order and one Python file per customer; the order or customer key chooses
# the kind of fault, so the expected findings follow from the key.
C_TEXT = """CASE o_orderkey % 7
 WHEN 0 THEN 'int a(void) {\n  char *p = malloc(10);\n  free(p);\n  free(p);\n}\n'
 WHEN 1 THEN 'void b(char *s) {\n  strcpy(buf, s); sprintf (t, "x"); // strcpy(x)\n  // gets(a)\n  * gets(b)\n  gets(buf);\n}\n'
 WHEN 2 THEN 'int c(void) {\n  int *q = malloc(4);\n  free(q);\n  q[0] = 1;\n}\n'
 WHEN 3 THEN 'int d(void) {\n  char *z = malloc(3);\n  return 0;\n}\n'
 WHEN 4 THEN 'void e(char *u) {\n  printf(u);\n  printf("%s", u);\n  fprintf(stderr, "a,(b", u);\n  fprintf(out, u, 1);\n}\n'
 WHEN 5 THEN 'int f(void) {\n  char *k = malloc(1);\n  free(k);\n  k = malloc(2);\n  free(k);\n}\n'
 ELSE 'class X;\nvoid g(void) {\n  X *o = new X();\n  delete o;\n}\n' END"""
C_PATH = "concat('src/o', o_orderkey, '.c')"
C_EXPECT = """SELECT {path} AS path, rule_id, severity, line, col FROM orders JOIN (VALUES
 (0, 'c-double-free', 'CRITICAL', 4, 2), (2, 'c-use-after-free', 'CRITICAL', 4, 0), (2, 'c-memory-leak', 'MEDIUM', 2, 0), (3, 'c-memory-leak', 'MEDIUM', 2, 0),
 (4, 'c-format-string', 'HIGH', 2, 2), (4, 'c-format-string', 'HIGH', 5, 2), (6, 'c-use-after-free', 'CRITICAL', 4, 0), (6, 'c-memory-leak', 'MEDIUM', 3, 0)) v(m, rule_id, severity, line, col) ON o_orderkey % 7 = m""".format(path=C_PATH)
C_LINES = """SELECT {path} AS path, rule_id, severity, line, col FROM orders JOIN (VALUES
 (1, 'c-unsafe-api-strcpy', 'HIGH', 2, 2), (1, 'c-unsafe-api-sprintf', 'HIGH', 2, 18), (1, 'c-unsafe-api-gets', 'CRITICAL', 5, 2)) v(m, rule_id, severity, line, col) ON o_orderkey % 7 = m""".format(path=C_PATH)

PY_TEXT = """CASE c_custkey % 11
 WHEN 0 THEN 'import os\nos.system("ls")\neval(x)\n'
 WHEN 1 THEN 'import pickle as p\np.loads(x)\nimport yaml\nyaml.load(y)\n'
 WHEN 2 THEN 'import subprocess\nsubprocess.run(a, shell=True)\nsubprocess.run(a, shell=False)\n'
 WHEN 3 THEN 'from hashlib import md5\nmd5(b"")\nimport hashlib\nhashlib.new("SHA1")\nhashlib.new("sha256")\n'
 WHEN 4 THEN 'from tempfile import mktemp\nmktemp()\nrequests.get(u, verify=False)\n'
 WHEN 5 THEN 'import os\nos.chmod(p, 511)\nos.chmod(p, 384)\n'
 WHEN 6 THEN 'cur.execute(f"select {x}")\ncur.execute("select {}".format(x))\ncur.execute("select 1")\n'
 WHEN 7 THEN 'api_token = "abc"\nname = "x"\nsecret = f()\ntry:\n    f()\nexcept:\n    pass\n'
 WHEN 8 THEN 'def f():\n    h = open("x")\n    return 1\ntry:\n    g()\nexcept Exception:\n    pass\n'
 WHEN 9 THEN 'def broken(:\n' END"""
PY_PATH = "concat('app/c', c_custkey, '.py')"
PY_EXPECT = """SELECT {path} AS path, rule_id, severity, line, col FROM customer JOIN (VALUES
 (0, 'python-dangerous-os-system', 'CRITICAL', 2, 0), (0, 'python-dangerous-eval', 'CRITICAL', 3, 0),
 (1, 'python-deserialization-pickle-loads', 'CRITICAL', 2, 0), (1, 'python-deserialization-yaml-load', 'HIGH', 4, 0),
 (2, 'python-subprocess-shell', 'CRITICAL', 2, 0), (3, 'python-weak-hash', 'MEDIUM', 2, 0), (3, 'python-weak-hash', 'MEDIUM', 4, 0),
 (4, 'python-unsafe-tempfile', 'HIGH', 2, 0), (4, 'python-no-tls-verify', 'HIGH', 3, 0), (5, 'python-world-writable', 'MEDIUM', 2, 0),
 (6, 'python-sql-injection', 'CRITICAL', 1, 0), (6, 'python-sql-injection', 'CRITICAL', 2, 0), (7, 'python-hardcoded-secret', 'HIGH', 1, 0),
 (7, 'python-bare-except', 'MEDIUM', 6, 0), (8, 'python-resource-leak', 'MEDIUM', 1, 0), (8, 'python-swallowed-exception', 'LOW', 6, 0),
 (9, 'python-syntax-error', 'INFO', 1, 0), (10, 'audit-read-error', 'INFO', 0, 0)) v(m, rule_id, severity, line, col) ON c_custkey % 11 = m""".format(path=PY_PATH)


def c_files(spark, sf):
    return src.spread(src.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(
        F.expr(C_PATH).alias("path"), F.lit("c/c++").alias("language"), F.expr(C_TEXT).alias("content")
    )


def python_files(spark, sf):
    return src.spread(src.table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(
        F.expr(PY_PATH).alias("path"), F.lit("python").alias("language"), F.expr(PY_TEXT).alias("content")
    )


def rules(name: str, *ids: str) -> None:
    """One query per group of syntax rules over the Python corpus."""
    wanted = ", ".join(f"'{i}'" for i in ids)

    @query(name, f"SELECT * FROM ({PY_EXPECT}) WHERE rule_id IN ({wanted})")
    def run(spark, sf):
        return au.syntax_findings(python_files(spark, sf)).filter(F.col("rule_id").isin(*ids))


@query("au1_unsafe_calls", C_LINES)
def unsafe_calls(spark, sf):
    return au.unsafe_calls(c_files(spark, sf))


@query("jo19_findings_by_rule", f"SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS n FROM ({C_LINES}) GROUP BY ALL")
def findings_by_rule(spark, sf):
    return au.unsafe_calls(c_files(spark, sf)).groupBy("rule_id", "severity").agg(lb.count_rows("n"))


@query("au2_format_arguments", f"SELECT * FROM ({C_EXPECT}) WHERE rule_id = 'c-format-string'")
def format_arguments(spark, sf):
    return au.format_arguments(c_files(spark, sf))


@query("au3_memory_rules", f"SELECT * FROM ({C_EXPECT}) WHERE rule_id <> 'c-format-string'")
def memory_rules(spark, sf):
    return au.memory_findings(c_files(spark, sf))


rules(
    "au4_dangerous_calls", "python-dangerous-os-system", "python-dangerous-eval", "python-deserialization-pickle-loads",
    "python-deserialization-yaml-load", "python-subprocess-shell", "python-weak-hash", "python-unsafe-tempfile",
    "python-no-tls-verify", "python-world-writable", "python-sql-injection",
)
rules("au5_assigned_secrets", "python-hardcoded-secret")
rules("au6_except_and_open", "python-bare-except", "python-swallowed-exception", "python-resource-leak")
rules("au7_import_aliases", "python-deserialization-pickle-loads", "python-weak-hash", "python-unsafe-tempfile")
rules("au8_unparsable_files", "python-syntax-error", "audit-read-error")

RE2_SECRET = r"(\b\w*(?:password|passwd|pwd|secret|token|api_key|apikey|private_key|access_key|auth_token))\s*=\s*[\"''][^\"''\n]*[\"'']"


@query(
    "au5_secrets_in_text",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS INT) AS line, unnest(regexp_extract_all(raw, '(?i){RE2_SECRET}', 1)) AS name FROM l""",
)
def secrets_in_text(spark, sf):
    return au.secret_lines(src.table(spark, sf, "documents"), "doc_id", "text")


FOUND = f"found AS ({C_EXPECT} UNION ALL {C_LINES} UNION ALL {PY_EXPECT})"


def all_findings(spark, sf):
    return au.audit(c_files(spark, sf).unionByName(python_files(spark, sf)))


@query("ud4_rule_visitor", f"WITH {FOUND} SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY rule_id")
def rule_visitor(spark, sf):
    return all_findings(spark, sf).groupBy("rule_id").agg(lb.count_rows("n"))


RANK = case("severity", {s: i for i, s in enumerate(vocab.SEVERITIES)}, "-1")
SEV = f"sev AS (SELECT * FROM (VALUES {', '.join(f'({s!r}, {i})' for i, s in enumerate(vocab.SEVERITIES))}) v(severity, rank))"


@query("fn16_severity_rank", f"WITH {FOUND} SELECT path, rule_id, line, {RANK} AS rank, {RANK} >= 2 AS at_least_medium FROM found")
def severity_rank(spark, sf):
    f = all_findings(spark, sf)
    rank = tx.severity_rank(F.col("severity"))
    return f.select("path", "rule_id", "line", rank.alias("rank"), (rank >= 2).alias("at_least_medium"))


@query("ag13_severity_counts", f"WITH {FOUND}, {SEV} SELECT s.severity, CAST(count(f.path) AS BIGINT) AS n FROM sev s LEFT JOIN found f USING (severity) GROUP BY 1")
def severity_counts(spark, sf):
    return au.severity_counts(all_findings(spark, sf)).select("severity", "n")


@query(
    "au9_gate",
    f"""WITH {FOUND}, {SEV}, n AS (SELECT s.severity, rank, count(f.path) AS n FROM sev s LEFT JOIN found f USING (severity) GROUP BY ALL),
l AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 100000000 WHEN 'MEDIUM' THEN 3 END AS lim FROM n)
SELECT severity, CAST(n AS BIGINT) AS n, CAST(lim AS BIGINT) AS "limit", coalesce(n > lim, false) AS over_limit, rank >= 3 AND n > 0 AS at_threshold FROM l""",
)
def audit_gate(spark, sf):
    config = au.gate_config({"severity_threshold": "high", "max_high": "100000000", "max_medium": 3, "unknown": 1})
    return au.gate(all_findings(spark, sf), config)


def corpus(spark, sf):
    return c_files(spark, sf).unionByName(python_files(spark, sf))


def records(spark, sf):
    return au.finding_records(all_findings(spark, sf), corpus(spark, sf))


TITLES = ", ".join(f"""('{r}', '{t}', '{d.replace("'", "''")}', '{x}')""" for r, (t, d, x) in vocab.AUDIT_TEXTS.items())
CODE = f"code AS (SELECT {C_PATH} AS path, 'c/c++' AS language, {C_TEXT} AS content FROM orders UNION ALL SELECT {PY_PATH}, 'python', {PY_TEXT} FROM customer)"
RECORDS = f"""{FOUND}, {CODE}, tt AS (SELECT * FROM (VALUES {TITLES}) v(rule, title, description, fix)),
rec AS (SELECT f.path, f.rule_id, f.severity, f.line, f.col, CASE WHEN content IS NULL THEN 'unknown' ELSE language END AS language,
  title || CASE WHEN starts_with(rule_id, 'c-unsafe-api-') THEN ': ' || replace(rule_id, 'c-unsafe-api-', '') ELSE '' END AS title, description,
  CASE WHEN line > 0 THEN coalesce(trim(CASE WHEN language = 'c/c++' THEN regexp_replace(string_split(content, chr(10))[line], '//.*', '') ELSE string_split(content, chr(10))[line] END), '') ELSE '' END AS snippet, fix AS fix_suggestion
  FROM found f JOIN code USING (path) JOIN tt ON tt.rule = CASE WHEN starts_with(rule_id, 'c-unsafe-api-') THEN 'c-unsafe-api' ELSE rule_id END)"""


@query("sk6_finding_records", f"WITH {RECORDS} SELECT * FROM rec")
def finding_records(spark, sf):
    return records(spark, sf)


REPORT = f"""{RECORDS}, {SEV}, n AS (SELECT s.severity, rank, count(f.path) AS n FROM sev s LEFT JOIN found f USING (severity) GROUP BY ALL),
lim AS (SELECT severity, n, rank FROM n WHERE severity IN ('CRITICAL', 'HIGH') AND n > 0)"""


@query(
    "sk6_report_lines",
    f"""WITH {REPORT}
SELECT 0 AS part, 0 AS pos, concat('Files scanned: ', (SELECT count(*) FROM code), ' | Findings: ', (SELECT count(*) FROM found)) AS text, '' AS path, 0 AS line, 0 AS col, '' AS rule_id
UNION ALL SELECT 0, 5 - rank, concat('  ', severity, ': ', n), '', 0, 0, '' FROM n
UNION ALL SELECT 1, 0, 'AUDIT FAILED', '', 0, 0, '' UNION ALL SELECT 1, 5 - rank, concat('  - ', severity, ' findings ', n, ' > max 0'), '', 0, 0, '' FROM lim
UNION ALL SELECT 2, 0, concat('[', severity, '] ', rule_id, ' at ', path, ':', line, ':', col, ': ', title), path, line, col, rule_id FROM rec""",
)
def report_lines(spark, sf):
    return au.report_lines(records(spark, sf), corpus(spark, sf), au.gate_config())


@query(
    "sk6_report_json",
    f"""WITH {REPORT}
SELECT 2 AS part, path, line, col, rule_id, to_json({{'rule_id': rule_id, 'severity': severity, 'title': title, 'description': description, 'location': {{'file': path, 'line': line, 'column': col}}, 'language': language, 'snippet': snippet, 'fix_suggestion': fix_suggestion}})::VARCHAR AS text FROM rec
UNION ALL SELECT 0, '', 0, 0, '', to_json({{'severity': severity, 'n': n}})::VARCHAR FROM n UNION ALL SELECT 0, '', 0, 0, '', to_json({{'files_scanned': (SELECT count(*) FROM code), 'total_findings': (SELECT count(*) FROM found)}})::VARCHAR
UNION ALL SELECT 1, '', 0, 0, '', '{{"failed":true}}' UNION ALL SELECT 1, '', 0, 0, '', to_json({{'violation': concat(severity, ' findings ', n, ' > max 0')}})::VARCHAR FROM lim""",
)
def report_json(spark, sf):
    return au.report_lines(records(spark, sf), corpus(spark, sf), au.gate_config(), "json").drop("pos")


LISTING = """CASE p_partkey % 9 WHEN 0 THEN concat('src/', p_name, '.py') WHEN 1 THEN concat('build/', p_partkey, '.py') WHEN 2 THEN concat('lib/venv/x', p_partkey, '.c')
 WHEN 3 THEN concat('pkg.egg-info/', p_partkey, '.H') WHEN 4 THEN concat('a/', p_partkey, '.txt') WHEN 5 THEN concat('a/b/', p_partkey, '.HPP') WHEN 6 THEN concat('a/', p_partkey, '.egg-info') WHEN 7 THEN concat('vendor/', p_partkey, '.cc') ELSE concat('a/.py') END"""


@query(
    "sc10_file_discovery",
    f"""WITH l AS (SELECT DISTINCT {LISTING} AS path, p_partkey % 9 AS m FROM part) SELECT DISTINCT path, CASE WHEN m = 0 THEN 'python' ELSE 'c/c++' END AS language FROM l WHERE m IN (0, 3, 5)""",
)
def file_discovery(spark, sf):
    listing = src.table(spark, sf, "part").select(F.expr(LISTING).alias("path"))
    return au.discover(listing, exclude=vocab.AUDIT_EXCLUDES + ["vendor"])


@query(
    "fn19_call_arguments",
    "SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), ' f(a, \"x)\", b)', ' ' || o_orderstatus] AS args FROM orders",
)
def call_arguments(spark, sf):
    rest = F.concat(F.col("o_custkey"), F.lit(', f(a, "x)", b), '), F.col("o_orderstatus"), F.lit("); next(1, 2)"))
    o = src.table(spark, sf, "orders").select("o_orderkey", rest.alias("rest"))
    return o.select("o_orderkey", au.call_arguments(F.col("rest")).alias("args"))
