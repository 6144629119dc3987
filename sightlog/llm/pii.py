"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base matches of four kinds are found where the text is read. They seed a bootstrap: the words around a match induce lexical
patterns (the word before, the two words before, the word after, whatever the value looks like). Candidates are what no base match
touches: words with at least four digits or an at sign, numbers of 7 to 19 digits over several words, addresses with blanks around the
at sign. Patterns and values form a graph of distinct edges. In each round a pattern's confidence in a kind is the lower Wilson bound of
the share of its values already known as that kind; a candidate's score for a kind that it may be at all (``fits``) is the chance that not all
its patterns err (noisy or); candidates above ``ACCEPT`` join the known values for good, until a round adds none. Only aggregates meet
in a task: a pattern or value that a third of the rows share is summed before it is moved.

Every pattern reads a text once from left to right: runs that cannot be given back are possessive, and a match starts at
the start of its run or where the match before ended.

Defined cases: null texts count as empty; repeated rows and null ids give one row each; texts without matches have empty
spans; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import query, table
from sightlog.session import materialise

#: The base patterns, in the order of their kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@0-9]*+[@0-9][^\x20\x09-\x0D]*+"
#: Seven to 19 digits over one or more words of a line; an at sign with a blank before or after it.
NUMBERS = r"(?<![^\x20\x09-\x0D])[+(]{0,2}[0-9](?:[\x20\x09\u00A0\u2009\u202F\u2010-\u2015().,/-]{0,3}[0-9]){6,18}(?![^\x20\x09-\x0D.,;:!?)])"
SPACED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++(?:[\x20\x09]++@[\x20\x09]*+|@[\x20\x09]++)[^\x20\x09-\x0D@]++"
BLOCK = 256
ACCEPT, CONFIDENT, Z = 0.8, 0.6, 1.96


def prefix_sums(values: Column, op=lambda a, b: a + b, zero: int = 0) -> Column:
    """``op`` over all entries before each entry, in blocks, so that long arrays are not copied again for each entry."""

    def running(part: Column, start: Column) -> Column:
        done = F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<long>").alias("out")),
            lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )
        return done["out"]

    first = F.lit(zero).cast("long")

    def in_blocks(all_values: Column) -> Column:
        blocks = F.when(F.size(all_values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / BLOCK).cast("int")))
        parts = F.transform(blocks, lambda b: F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK)))
        return once(parts, lambda p: F.flatten(F.zip_with(p, running(F.transform(p, lambda q: F.aggregate(q, first, op)), first), running)))

    return once(values, in_blocks)


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_repeats(entries: Column) -> Column:
    """Distinct entries, in order."""
    return once(F.array_sort(entries), lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def clear_of(entries: Column, taken: Column) -> Column:
    """Entries (a, b, ...) that overlap none of ``taken`` (a, b, ...): one pass over both in order of place.

    An entry is overlapped if the furthest end of those that start before its own end lies beyond its start.
    """
    event = lambda at, last, end, m: F.struct(at.cast("long").alias("at"), F.lit(last).alias("last"), end.cast("long").alias("end"), m.alias("m"))
    mine = F.transform(entries, lambda m: event(m["b"], 0, F.lit(-1), m))
    others = F.transform(taken, lambda m: event(m["a"], 1, m["b"], F.get(F.slice(entries, 1, 0), F.lit(0))))

    def passed(events: Column) -> Column:
        ends = prefix_sums(F.transform(events, lambda e: e["end"]), lambda a, b: F.greatest(a, b), -1)
        both = F.filter(F.arrays_zip(events.alias("e"), ends.alias("far")), lambda z: (z["e"]["last"] == 0) & (z["far"] <= z["e"]["m"]["a"]))
        return F.transform(both, lambda z: z["e"]["m"])

    return once(F.array_sort(F.concat(mine, others)), passed)


def outermost(spans: Column) -> Column:
    """Spans (a, k, b) that lie in no longer one: in order of (a, -b) the longest so far is known by its end, then its start."""
    key = lambda m: m["b"] * (1 << 31) - m["a"]
    placed = F.transform(spans, lambda m: F.struct(m["a"].alias("a"), (-m["b"]).alias("_b"), m["k"].alias("k"), m["b"].alias("b")))

    def kept(ordered: Column) -> Column:
        longest = prefix_sums(F.transform(ordered, key), lambda a, b: F.greatest(a, b), -(1 << 62))
        free = F.filter(F.arrays_zip(ordered.alias("m"), longest.alias("far")), lambda z: z["far"] <= key(z["m"]))
        return F.transform(free, lambda z: F.struct(z["m"]["a"].alias("a"), z["m"]["k"].alias("k"), z["m"]["b"].alias("b")))

    return once(F.array_sort(placed), kept)


def with_matches(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds column ``name``: leftmost matches in ``text`` as structs (a, b, value, before, after), positions in code points,
    with the ends of the text between a match and its neighbours.

    Each array is a column of its own: an expression inside a lambda would be computed again for each entry.
    """
    hits, gaps, steps = (f"{name}_{x}" for x in ("hits", "gaps", "steps"))
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("text", pattern, -1)).otherwise(none))
    # the length of a gap and the match after it; the sums of all before are where gaps start
    df = df.withColumn(steps, F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(hits)), F.col(hits), lambda g, h: (F.length(g) + F.length(h)).cast("long")))
    whole = F.arrays_zip(
        F.col(hits).alias("h"), F.slice(F.col(gaps), F.lit(1), F.size(hits)).alias("g"), F.slice(F.col(gaps), F.lit(2), F.size(hits)).alias("n"), prefix_sums(F.col(steps)).alias("s")
    )
    found = F.transform(
        whole,
        lambda m: F.struct(
            (m["s"] + F.length(m["g"])).alias("a"), (m["s"] + F.length(m["g"]) + F.length(m["h"])).alias("b"), m["h"].alias("value"),
            F.substring(m["g"], -64, 64).alias("before"), F.substring(m["n"], 1, 64).alias("after"),
        ),
    )
    return df.withColumn(name, found).drop(hits, gaps, steps)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def with_base_matches(df: DataFrame) -> DataFrame:
    """Valid base matches per kind as columns; a text without the characters that a kind needs is not searched for it."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    df = with_matches(df, "email", EMAIL, text.contains("@"))
    df = with_matches(df, "ip", IP, text.contains(".") & digit)
    df = with_matches(df, "card", CARD, digit)
    df = with_matches(df, "phone", PHONE, text.contains("+") & digit)
    card = F.filter("card", lambda m: F.length(digits_of(m["value"])).between(14, 19))
    return df.withColumns(
        {
            "ip": F.filter("ip", lambda m: small_parts(m["value"])),
            "card": F.filter(card, lambda m: luhn(digits_of(m["value"]))),
            "phone": F.filter("phone", lambda m: F.length(digits_of(m["value"])).between(10, 15)),
        }
    )


def found_rows(documents: DataFrame) -> DataFrame:
    """Per row: a number, the base matches of all kinds in order (a, rank of the kind, ...) and the candidates."""
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_matches(with_base_matches(rows), "word", CANDIDATE, F.col("text").rlike("[0-9@]"))
    found = with_matches(found, "numbers", NUMBERS, F.col("text").rlike("[0-9]"))
    found = with_matches(found, "spaced", SPACED, F.col("text").contains("@"))

    def tagged(kind: str) -> Column:
        at = KINDS.index(kind)
        return F.transform(kind, lambda m: F.struct(m["a"].alias("a"), F.lit(at).alias("k"), m["b"].alias("b"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))

    base = F.array_sort(F.concat(*map(tagged, KINDS)))
    bare = without_repeats(F.concat(*(F.transform(name, trimmed) for name in ("word", "numbers", "spaced"))))
    like = F.filter(bare, lambda m: (F.length(digits_of(m["value"])) >= 4) | (m["value"].contains("@") & (F.length(m["value"]) > 4)))
    free = clear_of(F.col("like"), F.col("base"))
    listed = found.select("uid", "doc_id", base.alias("base"), like.alias("like"))
    return listed.select("uid", "doc_id", "base", F.when(F.size("like") > 0, free).otherwise(F.col("like")).alias("free"))


def trimmed(m: Column) -> Column:
    """A word without the punctuation around it."""
    left = F.length(F.regexp_extract(m["value"], r"^([^\p{L}\p{N}+]*+)", 1))
    core = F.regexp_extract(m["value"], r"^[^\p{L}\p{N}+]*+(.*?)[^\p{L}\p{N}]*$", 1)
    return F.struct((m["a"] + left).alias("a"), (m["a"] + left + F.length(core)).alias("b"), core.alias("value"), m["before"].alias("before"), m["after"].alias("after"))


def fits(value: Column) -> Column:
    """The kinds that a value may be at all, whatever its spelling."""
    digits, letters = F.length(digits_of(value)), F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    at, parts = value.contains("@"), F.size(F.split(value, "[.:]"))
    number = ~at & (letters <= 4)
    can = (at, ~at & (parts >= 3), number & (digits >= 8), number & ((digits >= 7) | value.startswith("+")))
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(can))), lambda k: k.isNotNull())


def patterns_of(m: Column) -> Column:
    """Lexical patterns of a match: the word before, the two words before, the word after; a missing word gives none."""

    def clean(word: Column) -> Column:
        return F.lower(F.regexp_replace(word, r"[^\p{L}:=]", ""))

    one = clean(F.regexp_extract(m["before"], r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    two = clean(F.regexp_extract(m["before"], r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", 1))
    after = clean(F.regexp_extract(m["after"], r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))
    return F.filter(
        F.array(
            F.when(one != "", F.concat(F.lit("1 "), one)),
            F.when((one != "") & (two != ""), F.concat(F.lit("2 "), two, F.lit(" "), one)),
            F.when(after != "", F.concat(F.lit("3 "), after)),
        ),
        lambda p: p.isNotNull(),
    )


def edges_of(found: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind, fits) edges; kind is null for candidates."""
    base = found.select(F.explode("base").alias("m"), F.col("m.k").alias("kind"))
    free = found.select(F.explode("free").alias("m"), F.lit(None).cast("int").alias("kind"))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(patterns_of(F.col("m"))).alias("pattern"), F.lower("m.value").alias("value"), "kind")

    both = spread(base).union(spread(free))
    return both.distinct().withColumn("fits", fits(F.col("value")))


def wilson_low(hits: Column, n: Column) -> Column:
    """Lower Wilson bound of a share."""
    p = hits / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def bootstrap(edges: DataFrame, accept: float = ACCEPT, confident: float = CONFIDENT) -> DataFrame:
    """(value, kind) of accepted candidates. Patterns are scored over seeds and what was accepted before, until a round accepts
    nothing new. Without a column ``fits`` a value may be of any kind."""
    edges = materialise(edges)
    allowed = F.array_contains("fits", F.col("to")) if "fits" in edges.columns else F.lit(True)
    accepted = materialise(edges.where("false").select("value", F.col("kind").alias("got")))
    while True:
        known = edges.join(accepted, "value", "left").withColumn("now", F.coalesce("kind", "got"))
        counts = known.groupBy("pattern", "now").agg(F.count("*").alias("hits"))
        totals = counts.groupBy("pattern").agg(
            F.sum("hits").alias("n"), F.max(F.when(F.col("now").isNotNull(), F.struct("hits", "now"))).alias("best")
        )
        sure = totals.where("best IS NOT NULL").select("pattern", F.col("best.now").alias("to"), wilson_low(F.col("best.hits"), F.col("n")).alias("c"))
        sure = sure.where(F.col("c") >= confident)
        open_edges = edges.where("kind IS NULL").join(accepted, "value", "left_anti")
        scores = open_edges.join(sure, "pattern").where(allowed).groupBy("value", "to").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("score"))
        best = scores.groupBy("value").agg(F.max(F.struct("score", -F.col("to"))).alias("s"))
        new = materialise(best.where(F.col("s.score") >= accept).select("value", (-F.col("s.col2")).cast("int").alias("got")))
        if new.isEmpty():
            break
        accepted = materialise(accepted.union(new))
    return accepted.select("value", F.col("got").alias("kind"))


def find(documents: DataFrame, **options) -> DataFrame:
    """uid, doc_id, counts of base matches, base and spans: arrays of (a, k, b) in order; ``k`` numbers the kinds."""
    found = materialise(found_rows(documents))
    accepted = bootstrap(edges_of(found), **options)
    free = found.select("uid", F.explode("free").alias("m")).select("uid", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.lower("m.value").alias("value"))
    added = free.join(accepted, "value").groupBy("uid").agg(F.collect_list(F.struct("a", F.col("kind").alias("k"), "b")).alias("added"))
    # of several spellings at one place the longest counts
    added = added.withColumn("added", outermost(F.col("added")))
    base = F.transform("base", lambda m: F.struct(m["a"].alias("a"), m["k"].alias("k"), m["b"].alias("b")))
    none = F.array().cast("array<struct<a:bigint,k:int,b:bigint>>")
    out = found.select("uid", "doc_id", base.alias("base")).join(added, "uid", "left")

    def count_of(kind: int) -> Column:
        # of one argument: a second one would be the place in the array
        return F.size(F.filter("base", lambda m: m["k"] == kind)).cast("long")

    counts = [count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("uid", "doc_id", *counts, "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["k"]), m["a"].cast("string"), m["b"].cast("string"))), ",")


def find_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row."""
    return find(documents).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, m: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (m["a"] - acc["at"]).cast("int"))
        inside = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], m["b"]).alias("at"))
        beyond = F.struct(F.concat(acc["out"], F.array(before, F.get(names, m["k"]))).alias("out"), m["b"].alias("at"))
        return F.when(m["a"] < acc["at"], inside).otherwise(beyond)

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    )


@query("op9_pii")
def op9_pii(spark, sf_dir):
    return find_digests(table(spark, sf_dir, "documents"))
