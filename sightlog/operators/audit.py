"""Rule audit of a corpus of source files: C rules as column expressions, Python rules as a table joined with facts of the syntax tree."""

from __future__ import annotations

import ast
import fnmatch
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx
from sightlog.session import materialise

FINDING = ["path", "rule_id", "severity", "line", "col"]
FINDING_SCHEMA = "path STRING, rule_id STRING, severity STRING, line INT, col INT"


# --- discovery and configuration -----------------------------------------------------------


def _matches(path: Column, patterns: list[str]) -> Column:
    """A pattern fits the path, its name, one of its parts, or its leading parts.

    All patterns become one expression per kind of test.
    """
    if not patterns:
        return F.lit(False)
    globs = "|".join(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$") for p in patterns)
    leads = "|".join(re.escape(p.rstrip("/")) for p in patterns)
    parts = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in patterns]))
    return parts | path.rlike(f"^({globs})") | F.substring_index(path, "/", -1).rlike(f"^({globs})") | path.rlike(f"^({leads})(/|$)")


def discover(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Distinct paths with a known extension; an exclusion wins over an inclusion."""
    include = ["."] if include is None else include
    exclude = vocab.AUDIT_EXCLUDES if exclude is None else exclude
    known = {e: lang for lang, exts in vocab.AUDIT_EXTENSIONS.items() for e in exts}
    ext = F.lower(F.regexp_extract("path", r"([^/])(\.[^./]+)$", 2))
    wanted = ~_matches(F.col("path"), exclude)
    if include and include != ["."]:
        wanted = wanted & _matches(F.col("path"), include)
    payload = [c for c in files.columns if c != "path"]
    # the rules run once per distinct path
    paths = files.groupBy("path").agg(F.min(F.struct(*payload)).alias("p")) if payload else files.distinct()
    kept = paths.filter(F.lower("path").rlike(r"[^/]\.(" + "|".join(e[1:] for e in known) + ")$")).filter(wanted)
    return kept.select("path", *[F.col("p")[c].alias(c) for c in payload], vocab.lookup(ext, known).alias("language"))


# --- fixed values: gate defaults -------------------------------------------------------------
GATE_DEFAULTS = {"severity_threshold": "MEDIUM", "max_critical": 0, "max_high": 0, "max_medium": None}


def gate_config(settings: dict | None = None) -> dict:
    """Given settings over the defaults; severities are case-insensitive, limits are numbers."""
    out = dict(GATE_DEFAULTS)
    for key, value in (settings or {}).items():
        if key in out:
            out[key] = value.upper() if key == "severity_threshold" else int(value)
    if out["severity_threshold"] not in vocab.SEVERITIES:
        raise ValueError(f"unknown severity {out['severity_threshold']}")
    return out


def fixed_table(spark, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of fixed words and numbers as part of the plan, so that no job has to send it."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, rows))} AS t({columns})")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row per severity, all five present."""
    spark = findings.sparkSession
    dim = fixed_table(spark, [(s, i) for i, s in enumerate(vocab.SEVERITIES)], "severity, rank")
    n = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(F.broadcast(n), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def gate(findings: DataFrame, config: dict) -> DataFrame:
    """Verdict per check: a limit fails when it is exceeded; any finding at or above the threshold fails."""
    counts = severity_counts(findings)
    limit = vocab.lookup(F.col("severity"), {
        s: config[k] for s, k in (("CRITICAL", "max_critical"), ("HIGH", "max_high"), ("MEDIUM", "max_medium")) if config[k] is not None
    })
    floor = vocab.SEVERITIES.index(config["severity_threshold"])
    return counts.withColumn("limit", limit.cast("bigint")).select(
        "severity", "n", "limit",
        F.coalesce(F.col("n") > F.col("limit"), F.lit(False)).alias("over_limit"),
        ((F.col("rank") >= floor) & (F.col("n") > 0)).alias("at_threshold"),
    )


def finding_records(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with language, title, description, the line they stand on and advice.

    A C line is shown without its comment. Findings meet their file by its path; which side moves is left to the optimiser.
    """
    c = F.col
    texts = {rule: i for i, rule in enumerate(vocab.AUDIT_TEXTS)}
    rule = F.when(c("rule_id").startswith("c-unsafe-api-"), F.lit("c-unsafe-api")).otherwise(c("rule_id"))
    told = lambda i: vocab.lookup(rule, {r: vocab.AUDIT_TEXTS[r][i] for r in texts}, "")
    name = F.when(c("rule_id").startswith("c-unsafe-api-"), F.concat(F.lit(": "), F.substring_index("rule_id", "-", -1))).otherwise("")
    raw = F.get(F.split("content", LINE_END), c("line") - 1)
    shown = F.when(c("language") == "c/c++", F.regexp_replace(raw, "//.*", "")).otherwise(raw)
    known = files.select("path", "language", "content")
    return findings.join(known, "path", "left").select(
        *FINDING, F.when(c("content").isNull(), "unknown").otherwise(c("language")).alias("language"), F.concat(told(0), name).alias("title"), told(1).alias("description"),
        F.when(c("line") > 0, F.coalesce(tx.strip(shown), F.lit(""))).otherwise("").alias("snippet"), told(2).alias("fix_suggestion"),
    )


def report_lines(records: DataFrame, files: DataFrame, config: dict, form: str = "console") -> DataFrame:
    """The report as ordered lines (part, pos, path, line, col, rule_id, text), to be written in that order: totals, counts, verdict with the
    limits that are exceeded, findings. Forms: console, markdown, json (one object per line). Head lines come from the small count
    table, findings stay distributed. How long the scan took is no part of it."""
    # records feed the head, the verdict and the body: the scan itself should run once
    records = materialise(records)
    verdicts = materialise(gate(records, config))
    c, lit = F.col, F.lit
    rank = vocab.lookup(c("severity"), {s: 4 - i for i, s in enumerate(vocab.SEVERITIES)})
    blank = {"path": lit(""), "line": lit(0), "col": lit(0), "rule_id": lit("")}
    at = lambda part, pos, text: (lit(part).alias("part"), (lit(pos) if isinstance(pos, int) else pos).alias("pos"), text.alias("text"))
    totals = files.agg(F.count(lit(1)).alias("scanned")).join(verdicts.agg(F.sum("n").alias("total")), how="cross")
    failed = verdicts.agg(F.bool_or(c("over_limit") | c("at_threshold")).alias("failed"))
    over = verdicts.filter("over_limit")
    exceeded = F.concat(c("severity"), lit(" findings "), c("n"), lit(" > max "), c("limit"))
    where = F.concat_ws(":", "path", "line", "col")
    if form == "json":
        head = [
            totals.select(*at(0, 0, F.to_json(F.struct(c("scanned").alias("files_scanned"), c("total").alias("total_findings"))))),
            verdicts.select(*at(0, 1 + rank, F.to_json(F.struct("severity", "n")))),
            failed.select(*at(1, 0, F.to_json(F.struct("failed")))), over.select(*at(1, 1 + rank, F.to_json(F.struct(exceeded.alias("violation"))))),
        ]
        location = F.struct(c("path").alias("file"), "line", c("col").alias("column")).alias("location")
        body = F.to_json(F.struct("rule_id", "severity", "title", "description", location, "language", "snippet", "fix_suggestion"))
    elif form == "markdown":
        head = [
            totals.select(*at(0, 0, F.concat(lit("# Code Audit Report\n\n- **Files scanned:** "), "scanned", lit("\n- **Total findings:** "), "total", lit("\n\n## Severity Counts\n\n| Severity | Count |\n|----------|-------|")))),
            verdicts.select(*at(0, 1 + rank, F.concat(lit("| "), "severity", lit(" | "), "n", lit(" |")))),
            failed.select(*at(1, 0, F.concat(lit("\n## Threshold Check\n\n"), F.when(c("failed"), "**FAILED** — audit thresholds exceeded.").otherwise("**PASSED** — no threshold violations.")))),
            over.select(*at(1, 1 + rank, F.concat(lit("- "), exceeded))),
            totals.select(*at(1, 9, F.concat(lit("\n## Findings\n"), F.when(c("total") == 0, "\nNo findings.").otherwise("")))),
        ]
        entry = [("Location", where), ("Title", c("title")), ("Description", c("description")), ("Snippet", F.concat(lit("`"), "snippet", lit("`"))), ("Fix suggestion", c("fix_suggestion"))]
        body = F.concat(lit("### "), "rule_id", lit(" — "), "severity", lit("\n\n"), F.concat_ws("\n", *[F.concat(lit(f"- **{k}:** "), v) for k, v in entry]), lit("\n"))
    else:
        head = [
            totals.select(*at(0, 0, F.concat(lit("Files scanned: "), "scanned", lit(" | Findings: "), "total"))),
            verdicts.select(*at(0, 1 + rank, F.concat(lit("  "), "severity", lit(": "), "n"))),
            failed.select(*at(1, 0, F.when(c("failed"), "AUDIT FAILED").otherwise("AUDIT PASSED"))), over.select(*at(1, 1 + rank, F.concat(lit("  - "), exceeded))),
        ]
        body = F.concat(lit("["), "severity", lit("] "), "rule_id", lit(" at "), where, lit(": "), "title")
    rows = records.select(lit(2).alias("part"), lit(0).alias("pos"), body.alias("text"), "path", "line", "col", "rule_id")
    return reduce(DataFrame.unionByName, [h.withColumns(blank) for h in head]).unionByName(rows)


# --- lines -----------------------------------------------------------------------------------------

#: Every end of a line that source code knows, the same for all rules.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
COMMENT = r"//[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*"
UNSAFE = rf"\b({'|'.join(vocab.UNSAFE_C_CALLS)})\s*\("


def code_lines(content: Column) -> Column:
    """The lines of a C file without what follows //."""
    return F.split(F.regexp_replace(content, COMMENT, ""), LINE_END)


def with_match(files: DataFrame, pattern: str) -> DataFrame:
    """(path, content) of files whose whole text holds a match of ``pattern``, so that other files are not cut into lines.

    For patterns whose matches in a line are matches in the text, too. A generator keeps the test behind the spread of the rows.
    """
    return g.keep_value(files.select("path", "content"), "_text", F.when(F.col("content").rlike(pattern), F.col("content"))).select("path", F.col("_text").alias("content"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line, code) of C files, without empty lines and lines of a block comment."""
    lines = files.select("path", F.posexplode(code_lines(F.col("content"))).alias("no", "code"))
    return lines.select("path", (F.col("no") + 1).alias("line"), "code").filter(~tx.strip(F.col("code")).rlike(r"^(\*|$)"))


def hits_in(lines: DataFrame, pattern: str) -> DataFrame:
    """One row per match of ``pattern`` (without groups of its own but the first) in ``code``: hit, name, col and the code after it."""
    hits = F.regexp_extract_all("code", F.lit(f"({pattern})"), F.lit(1))
    found = lines.select("*", F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0)).alias("hits"))
    # text before the k-th hit: the parts between hits and the earlier hits themselves; only lines with a hit are split
    hits = found.select("*", F.split("code", pattern).alias("gaps"), F.posexplode("hits").alias("k", "hit"))
    col = F.length(F.array_join(F.slice("gaps", F.lit(1), F.col("k") + 1), "")) + F.length(
        F.array_join(F.slice("hits", F.lit(1), F.col("k")), "")
    )
    hits = hits.withColumn("col", col.cast("int")).withColumn("name", F.regexp_extract("hit", pattern, 1))
    return hits.withColumn("rest", F.substring("code", F.col("col") + F.length("hit") + 1, F.length("code"))).drop("gaps", "hits", "k")


def unsafe_calls(files: DataFrame) -> DataFrame:
    """Unsafe C calls with line and column; what follows // does not count, nor do comment lines."""
    calls = hits_in(numbered_lines(with_match(files, UNSAFE)).filter(F.col("code").contains("(")), UNSAFE)
    severity = F.when(F.col("name") == "gets", "CRITICAL").otherwise("HIGH")
    return calls.select("path", F.concat(F.lit("c-unsafe-api-"), "name").alias("rule_id"), severity.alias("severity"), "line", "col")


SECRET = rf"\b(\w*{vocab.SECRET_NAME})\s*=\s*[\"'][^\"'\n]*[\"']"


def secret_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Names that look like a credential and are assigned a string literal, in any text."""
    # most lines assign nothing: they are left out before the pattern is tried at each of their words
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("no", "raw")).filter(F.col("raw").contains("="))
    names = F.regexp_extract_all("raw", F.lit(SECRET), F.lit(1))
    return lines.select(key, (F.col("no") + 1).alias("line"), F.explode(names).alias("name"))


# --- format arguments ------------------------------------------------------------------------------

FORMAT_CALL = r"\b(f?printf|f?scanf|snprintf|syslog)\s*\("
LITERAL = r'"(?:[^"\\]|\\.)*"'
TOKEN = r'"(?:[^"\\]|\\.)*+(?:"|$)|[(),]|[^"(),]+'


def call_arguments(rest: Column) -> Column:
    """Arguments up to the closing bracket of a call, from the text after its opening bracket; brackets and strings
    nest. An unclosed call gives the arguments that are complete."""
    tokens = F.regexp_extract_all(rest, F.lit(f"({TOKEN})"), F.lit(1))
    nothing = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), nothing.alias("args"), F.lit(False).alias("closed"))

    def state(depth, text, args, closed):
        return F.struct(depth.alias("depth"), text.alias("text"), args.alias("args"), closed.alias("closed"))

    def step(acc: Column, token: Column) -> Column:
        flat, more = acc["depth"] == 0, F.concat(acc["args"], F.array(acc["text"]))
        last = F.when(F.trim(acc["text"]) != "", more).otherwise(acc["args"])
        nested = acc["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        return (
            F.when(acc["closed"], acc)
            .when((token == ")") & flat, state(acc["depth"], F.lit(""), last, F.lit(True)))
            .when((token == ",") & flat, state(acc["depth"], F.lit(""), more, F.lit(False)))
            .otherwise(state(nested, F.concat(acc["text"], token), acc["args"], F.lit(False)))
        )

    return F.aggregate(tokens, start, step)["args"]


def format_arguments(files: DataFrame) -> DataFrame:
    """Calls whose format argument is a variable."""
    calls = hits_in(numbered_lines(with_match(files, FORMAT_CALL)).filter(F.col("code").contains("(")), FORMAT_CALL).withColumn("args", call_arguments(F.col("rest")))
    wanted = tx.strip(F.get("args", F.when(F.col("name").startswith("f"), 1).otherwise(0)))
    named = calls.filter(wanted.rlike(r"^[A-Za-z_]\w*\b") & ~wanted.rlike("^" + LITERAL))
    return named.select("path", F.lit("c-format-string").alias("rule_id"), F.lit("HIGH").alias("severity"), "line", "col")


# --- memory: events of each variable in each function ------------------------------------------------

# --- fixed values: patterns for C ------------------------------------------------------------------
ALLOCATION = r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*=?\s*(?:\([^)]*\))?\s*\b(?:malloc|calloc|realloc|strdup|new)\b"
FREE, DELETE = r"\bfree\s*\(\s*([A-Za-z_]\w*)\s*\)", r"\bdelete\b(?:\s*\[\])?\s*([A-Za-z_]\w*)"
ASSIGNMENT = r"(?:^|[^=])\b([A-Za-z_]\w*)\s*=(?!=)"
FUNCTION = (
    r"^\s*(?:static\s+|inline\s+|const\s+|volatile\s+|unsigned\s+|signed\s+)*"
    r"(?:[\w\*]+(?:\s+const)?\s+)+([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:const\s*)?\{?\s*$"
)
MENTION = r"\b([A-Za-z_]\w*)\b(?!\s*\()"
#: Words without which nothing is allocated or released.
ALLOCATORS, RELEASES = ("malloc", "calloc", "realloc", "strdup", "new"), ("free", "delete")


def function_spans(lines: Column) -> Column:
    """(first, last, closed) line numbers of functions in an array of lines: from a header to where its braces are level."""
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("depth"), F.array().cast("array<struct<first:int,last:int,closed:boolean>>").alias("done"))
    count = lambda line, brace: F.length(line) - F.length(F.replace(line, F.lit(brace), F.lit("")))
    # a step names its line many times, and a lambda repeats what it names: the tests on text are made once per line before, and
    # lines that are no header and leave the braces as they are take no step
    level = lambda line: F.when(line.contains("{") | line.contains("}"), count(line, "{") - count(line, "}")).otherwise(0)
    header = lambda line: line.contains("(") & line.contains(")") & line.rlike(FUNCTION)
    marks = F.transform(lines, lambda line, i: F.struct((i + 1).alias("no"), level(line).alias("level"), header(line).alias("header")))

    def step(acc: Column, mark: Column) -> Column:
        first = F.when(acc["first"] > 0, acc["first"]).when(mark["header"], mark["no"]).otherwise(0)
        depth = F.when(first > 0, acc["depth"] + mark["level"]).otherwise(0)
        over = (first > 0) & (depth <= 0)
        span = F.struct(first.alias("first"), mark["no"].alias("last"), F.lit(True).alias("closed"))
        done = F.when(over, F.concat(acc["done"], F.array(span))).otherwise(acc["done"])
        return F.struct(F.when(over, 0).otherwise(first).alias("first"), F.when(over, 0).otherwise(depth).alias("depth"), done.alias("done"))

    def end(acc: Column) -> Column:
        rest = F.struct(acc["first"].alias("first"), F.size(lines).alias("last"), F.lit(False).alias("closed"))
        return F.when(acc["first"] > 0, F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(F.filter(marks, lambda m: m["header"] | (m["level"] != 0)), start, step, end)


def memory_events(files: DataFrame) -> DataFrame:
    """(path, first, closed, var, line, kind, col): what each line does to a variable. ``kind`` is also the order within a
    line: 1 allocation, 2 free, 3 delete, 4 assignment, 5 mention. Assignments and mentions count for variables that the function releases."""
    # nothing is found in a file that neither allocates nor releases, and a line without a pattern's word does not meet it
    has = lambda text, words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    none = F.array().cast("array<string>")
    told = g.keep_value(files.select("path", "content"), "text", F.when(has(F.col("content"), ALLOCATORS + RELEASES), F.col("content")))
    whole = told.select("path", code_lines(F.col("text")).alias("lines"))
    spans = whole.withColumn("spans", function_spans(F.col("lines"))).select("path", "lines", F.explode("spans").alias("f"))
    body = spans.select("path", "f.first", "f.closed", F.slice("lines", F.col("f.first"), F.col("f.last") - F.col("f.first") + 1).alias("body"))
    every = lambda c, pattern, words: F.when(has(c, words), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))).otherwise(none)
    released = F.flatten(F.transform("body", lambda c: F.concat(every(c, FREE, RELEASES[:1]), every(c, DELETE, RELEASES[1:]))))
    lines = body.withColumn("released", F.array_distinct(released)).select("path", "first", "closed", "released", F.posexplode("body").alias("at", "code"))
    lines = lines.withColumn("line", F.col("first") + F.col("at"))
    c = F.col("code")
    for name, pattern in (("free", FREE), ("delete", DELETE)):
        lines = lines.withColumn(f"{name}_hits", every(c, f"({pattern})", (name,))).withColumn(f"{name}_gaps", F.when(F.size(f"{name}_hits") > 0, F.split("code", pattern)))

    def event(kind: int, var: Column, col: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), var.alias("var"), col.cast("int").alias("col"))

    def named(kind: int, names: Column) -> Column:
        return F.transform(names, lambda var: event(kind, var, F.lit(0)))

    def placed(kind: int, name: str, pattern: str) -> Column:
        hits, gaps = f"{name}_hits", f"{name}_gaps"
        before = lambda k: F.length(F.array_join(F.slice(gaps, F.lit(1), k + 1), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), k), ""))
        return F.transform(hits, lambda hit, k: event(kind, F.regexp_extract(hit, pattern, 1), before(k)))

    assigned = every(c, r"\b([A-Za-z_]\w*)\s*=(?!=)", "=")
    mentioned = F.array_intersect(F.array_except(F.regexp_extract_all("code", F.lit(MENTION), F.lit(1)), assigned), F.col("released"))
    uses = F.when((F.size("released") > 0) & (F.size("free_hits") == 0), mentioned).otherwise(none)
    # an assignment changes a variable that is gone, so only one that the function releases
    renewed = F.when(F.size("released") > 0, F.filter(every(c, ASSIGNMENT, "="), lambda var: F.array_contains("released", var))).otherwise(none)
    events = F.concat(named(1, every(c, ALLOCATION, ALLOCATORS)), placed(2, "free", FREE), placed(3, "delete", DELETE), named(4, renewed), named(5, uses))
    return lines.select("path", "first", "closed", "line", F.inline(events))


def memory_findings(files: DataFrame) -> DataFrame:
    """Memory that is released twice, used after its release, or never released before its function ends.

    A variable is new, held or gone; an assignment to a gone one makes it new. Each variable of a function
    folds its own events, so the work is spread over variables and no task holds a file.
    """
    events = memory_events(files).groupBy("path", "first", "closed", "var").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "col"))).alias("e"))
    finding = "array<struct<rule_id:string,severity:string,line:int,col:int>>"
    start = F.struct(F.lit(None).cast("int").alias("held"), F.lit(False).alias("gone"), F.lit(False).alias("again"), F.array().cast(finding).alias("out"))

    def found(rule: Column, severity: str, line: Column, col: Column) -> Column:
        return F.array(F.struct(rule.alias("rule_id"), F.lit(severity).alias("severity"), line.alias("line"), col.alias("col"))).cast(finding)

    def step(acc: Column, e: Column) -> Column:
        kind, gone = e["kind"], acc["gone"]
        taken = (kind == 1) & (acc["held"].isNull() | acc["again"])
        release = kind.isin(2, 3)
        twice = F.when(kind == 2, "c-double-free").otherwise("c-double-delete")
        new = F.when(release & gone, found(twice, "CRITICAL", e["line"], e["col"])).when(
            (kind == 5) & gone, found(F.lit("c-use-after-free"), "CRITICAL", e["line"], F.lit(0))
        )
        return F.struct(
            F.when(taken, e["line"]).otherwise(acc["held"]).alias("held"),
            F.when(release, True).when(taken | kind.isin(4, 5), False).otherwise(gone).alias("gone"),
            (acc["again"] | ((kind == 4) & gone)).alias("again"),
            F.when(new.isNull(), acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"),
        )

    folded = events.withColumn("s", F.aggregate("e", start, step)).select("path", "closed", "s")
    leak = F.when(F.col("closed") & F.col("s.held").isNotNull() & ~F.col("s.gone"), found(F.lit("c-memory-leak"), "MEDIUM", F.col("s.held"), F.lit(0)))
    every = F.concat("s.out", F.coalesce(leak, F.array().cast(finding)))
    return folded.select("path", every.alias("found")).select("path", F.inline("found")).select(*FINDING)


# --- Python: facts of the syntax tree, rules as a table ---------------------------------------------

# --- fixed values: rules on names ------------------------------------------------------------------
DANGEROUS = {
    "eval": "CRITICAL",
    "exec": "CRITICAL",
    "compile": "HIGH",
    "__import__": "HIGH",
    "input": "MEDIUM",
    "os.system": "CRITICAL",
    "os.popen": "CRITICAL",
}
DESERIALISERS = {
    "pickle.loads": "CRITICAL",
    "cPickle.loads": "CRITICAL",
    "_pickle.loads": "CRITICAL",
    "yaml.load": "HIGH",
    "marshal.loads": "HIGH",
}
SHELL_CALLS = ["subprocess.call", "subprocess.run", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call"]
WEAK_HASHES = ["md5", "sha1"]
SQL_METHODS = ["execute", "executemany", "executescript", "raw"]
OPENERS = ["open", "io.open"]

ANY = "*"
#: (kind of fact, name or ANY, mark that the fact needs or "", rule, severity)
RULES = [
    *(("call", n, "", f"python-dangerous-{n.replace('.', '-')}", s) for n, s in DANGEROUS.items()),
    *(("call", n, "", f"python-deserialization-{n.replace('.', '-')}", s) for n, s in DESERIALISERS.items()),
    *(("call", n, "shell=True", "python-subprocess-shell", "CRITICAL") for n in SHELL_CALLS),
    *(("call", f"hashlib.{n}", "", "python-weak-hash", "MEDIUM") for n in WEAK_HASHES),
    *(("call", "hashlib.new", f"0={n}", "python-weak-hash", "MEDIUM") for n in WEAK_HASHES),
    ("call", "tempfile.mktemp", "", "python-unsafe-tempfile", "HIGH"),
    ("call", ANY, "verify=False", "python-no-tls-verify", "HIGH"),
    ("call", "os.chmod", "world", "python-world-writable", "MEDIUM"),
    *(("method", n, "built", "python-sql-injection", "CRITICAL") for n in SQL_METHODS),
    ("text", ANY, "secret", "python-hardcoded-secret", "HIGH"),
    ("left", ANY, "", "python-resource-leak", "MEDIUM"),
    ("handler", "", "", "python-bare-except", "MEDIUM"),
    ("handler", "Exception", "quiet", "python-swallowed-exception", "LOW"),
    ("broken", ANY, "", "python-syntax-error", "INFO"),
    ("unread", ANY, "", "audit-read-error", "INFO"),
]
FACT = ["path", "kind", "name", "marks", "line", "col", "function", "seq"]
FACT_SCHEMA = "path STRING, kind STRING, name STRING, marks ARRAY<STRING>, line INT, col INT, function STRING, seq INT"


def _resolved(node, names: dict) -> str:
    """Dotted name of an expression with imported names written out; what is no name leaves its attributes only."""
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    head = [names.get(node.id, node.id)] if isinstance(node, ast.Name) else []
    return ".".join(head + tail[::-1])


def _call_marks(call: ast.Call) -> list[str]:
    marks = [f"{k.arg}={k.value.value}" for k in call.keywords if isinstance(k.value, ast.Constant) and isinstance(k.value.value, bool)]
    values = [a.value if isinstance(a, ast.Constant) else None for a in call.args[:2]]
    if values and values[0] is not None:
        marks.append(f"0={str(values[0]).lower()}")
    if len(values) > 1 and isinstance(values[1], int) and values[1] & 0o002:
        marks.append("world")
    first = call.args[0] if call.args else None
    if isinstance(first, ast.JoinedStr) or isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute) and first.func.attr == "format":
        marks.append("built")
    return marks


def python_facts(source: str) -> list[tuple]:
    """Facts (kind, name, marks, line, col, function, seq) of one file, in the order of the source.

    The tree is walked with a stack, so nesting is limited by the parser alone; what the parser refuses is a fact too.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        return [("broken", "", [], getattr(exc, "lineno", 0) or 0, 0, "", 0)]
    out, names, todo = [], {}, [(tree, "")]
    while todo:
        node, function = todo.pop()
        line, col = getattr(node, "lineno", 1), getattr(node, "col_offset", 0)
        add = lambda kind, name, marks=(): out.append((kind, name, list(marks), line, col, function, len(out)))  # noqa: B023, E731
        match node:
            case ast.Import():
                names |= {a.asname or a.name: a.name for a in node.names}
            case ast.ImportFrom():
                names |= {a.asname or a.name: ".".join(filter(None, (node.module, a.name))) for a in node.names}
            case ast.Call():
                name, marks = _resolved(node.func, names), _call_marks(node)
                add("call", name, marks)
                add("method", name.rpartition(".")[2], marks)
            case ast.Assign(value=value, targets=targets):
                text = isinstance(value, ast.Constant) and isinstance(value.value, str)
                opened = isinstance(value, ast.Call) and _resolved(value.func, names) in OPENERS
                for target in (t.id for t in targets if isinstance(t, ast.Name)):
                    if text:
                        add("text", target)
                    if opened and function:
                        add("open", target)
            case ast.With(items=items) if function:
                for item in items:
                    call, var = item.context_expr, item.optional_vars
                    if isinstance(var, ast.Name) and isinstance(call, ast.Call) and _resolved(call.func, names) in OPENERS:
                        add("managed", var.id)
            case ast.ExceptHandler(type=caught, body=body):
                only = body[0] if len(body) == 1 else None
                quiet = isinstance(only, ast.Pass) or isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is None
                if caught is None or isinstance(caught, ast.Name):
                    add("handler", caught.id if caught else "", ["quiet"] if quiet else [])
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                function = f"{line}:{col}"
        todo += [(child, function) for child in ast.iter_child_nodes(node)][::-1]
    # the last word on a file that a function opens: a place to itself, or to a with block
    last = {(f[5], f[1]): f[0] for f in out if f[0] in ("open", "managed")}
    for function, name in (key for key, kind in last.items() if kind == "open"):
        line, col = map(int, function.split(":"))
        out.append(("left", name, [], line, col, function, len(out)))
    return out


def syntax_facts(files: DataFrame) -> DataFrame:
    """Facts of all Python files; a file without content could not be read, which is a fact too."""

    def run(batches):
        for batch in batches:
            out = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                facts = [("unread", "", [], 0, 0, "", 0)] if content is None else python_facts(content) if language == "python" else []
                out += [(path, *fact) for fact in facts]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in out], t) for i, t in enumerate(types)], names=FACT)

    types = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.int32()] * 2 + [pa.string(), pa.int32()]
    # the parser reads texts that are Python or missing; others stay where they are
    return files.filter("language = 'python' OR content IS NULL").select("path", "language", "content").mapInArrow(run, FACT_SCHEMA)


def rule_findings(facts: DataFrame) -> DataFrame:
    """Facts that meet a rule of the table."""
    rules = F.broadcast(fixed_table(facts.sparkSession, RULES, "kind, rule, needs, rule_id, severity"))
    secret = F.col("name").rlike(vocab.SECRET_NAME + "$")
    marked = facts.withColumn("marks", F.when((F.col("kind") == "text") & secret, F.array(F.lit("secret"))).otherwise(F.col("marks")))
    keyed = marked.withColumn("rule", F.explode(F.array_distinct(F.array(F.col("name"), F.lit(ANY)))))
    met = keyed.join(rules, ["kind", "rule"]).filter((F.col("needs") == "") | F.array_contains("marks", F.col("needs")))
    return met.select(*FINDING)


def syntax_findings(files: DataFrame) -> DataFrame:
    """(path, language, content) to findings of the rules on structure. A file that cannot be read or parsed is a finding, and the
    scan goes on."""
    c = files.filter("language = 'c/c++' AND content IS NOT NULL")
    return reduce(DataFrame.union, [rule_findings(syntax_facts(files)), format_arguments(c), memory_findings(c)])


def audit(files: DataFrame) -> DataFrame:
    """All findings of a corpus."""
    c_files = files.filter("language = 'c/c++' AND content IS NOT NULL")
    return syntax_findings(files).unionByName(unsafe_calls(c_files))
