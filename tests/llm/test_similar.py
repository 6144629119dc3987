"""The near-duplicate stage against all pairs by five-word Jaccard similarity."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightlog.llm import similar, simhash


def placed(df):
    return df.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("place"), "text")


def near_pairs(texts):
    """Pairs of different texts with a similarity of 0.8 or more, over an index of their shingles."""
    sets = {k: set(similar.shingles(t).tolist()) for k, t in texts.items()}
    index: dict[int, list] = {}
    for k, s in sets.items():
        for h in s:
            index.setdefault(h, []).append(k)
    shared = Counter((a, b) for v in index.values() if len(v) < 300 for i, b in enumerate(v) for a in v[:i])
    return {(min(a, b), max(a, b)) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}


def test_stage_finds_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    gone = {r.row: r.kept for r in similar.duplicates(placed(docs)).collect()}
    sets = {k: similar.shingles(texts[k]) for k in {*gone, *gone.values()}}
    assert all(similar.jaccard(sets[a], sets[b]) >= 0.8 and b < a for a, b in gone.items())
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert all(k in gone for k, t in texts.items() if first[t] != k)
    different = {k: t for k, t in texts.items() if first[t] == k}
    pairs = near_pairs(different)
    found = sum(a in gone or b in gone for a, b in pairs)
    assert len(pairs) > 20 and found >= 0.9 * len(pairs)


@pytest.fixture(scope="module")
def family(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for n in range(60):
        base = [word() for _ in range(r.randint(150, 400))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 40 if n == 7 else 2])):
            copy = list(base)
            for _ in range(r.choice([1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += rows[:5] + [None, "", " \n", "one two", "one two", "ONE two"]
    path = str(tmp_path_factory.mktemp("family") / "t")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_one_of_each_family_stays(family):
    rows, df = family
    gone = {r.row for r in similar.duplicates(placed(df)).collect()}
    pairs = near_pairs({i: t or "" for i, t in enumerate(rows)})
    stay = set(range(len(rows))) - gone
    left = [(a, b) for a, b in pairs if a in stay and b in stay]
    assert len(left) <= 0.02 * len(pairs)
    # the empty ones and the short ones leave one each
    assert len([i for i in stay if not (rows[i] or "").split()]) == 1 and len([i for i in stay if (rows[i] or "").lower() == "one two"]) == 1


def test_hot_keys_are_dealt_and_give_the_same_links(spark, family):
    rows, df = family
    words = {tuple(simhash._majority(t or "", 4, 42, 2)) for t in rows}
    fps = spark.createDataFrame([(a, b) for a, b in {a: b for a, b in words}.items()], "fp long, more long")

    def groups(hot):
        links = similar.candidate_links(fps, hot=hot).collect()
        a, b = np.array([r.a for r in links]), np.array([r.b for r in links])
        return {x: y for x, y in zip(*(v.tolist() for v in simhash.stars(a, b)), strict=True)}

    whole = groups(simhash.HOT)
    assert whole and groups(5) == whole and groups(2) == whole


def test_no_rows(spark, family):
    assert similar.duplicates(placed(family[1].limit(0))).count() == 0


def test_every_member_meets_all_kept_ones_before_it(spark, tmp_path, monkeypatch):
    """A component of many unlike texts, some with a near copy: what is kept is what one pass in order keeps."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(100)] for _ in range(14)]
    near = [[*b[:60], word(), *b[61:]] for b in bases[3:]]
    chain = [[*bases[9][:60], word(), *bases[9][61 : 90 - k], *(word() for _ in range(10 + k))] for k in range(4)]
    rows = [" ".join(x) for x in [*bases, *near, *chain]]
    sets, want, kept = [similar.shingles(t) for t in rows], {}, []
    for i, s in enumerate(sets):
        like = next((k for k in kept if similar.jaccard(sets[k], s) >= 0.8), None)
        if like is None:
            kept.append(i)
        else:
            want[i] = like
    assert len(want) >= 11
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "t"))
    # all are candidates of each other
    monkeypatch.setattr(similar, "candidate_links", lambda fps, *_: fps.crossJoin(fps.agg(F.min("fp").alias("b"))).select(F.col("fp").alias("a"), "b").where("a <> b"))
    got = similar.duplicates(placed(spark.read.parquet(str(tmp_path / "t")))).collect()
    assert {x.row: x.kept for x in got} == want


@pytest.mark.parametrize("sizes", [{}, {"leaders": 7, "group": 5}, {"room": 900, "group": 4}])
def test_a_component_of_many_unlike_texts_takes_few_rounds(spark, tmp_path, monkeypatch, sizes):
    """One round for a component within a block, whatever stays of it; blocks and groups of any size give what one pass in order keeps."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(100)]
    rows = []
    for _ in range(48):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            copy[r.randrange(100)] = word()
        rows.append(" ".join(copy))
    sets, want, kept = [similar.shingles(x) for x in rows], {}, []
    for i, s in enumerate(sets):
        like = next((k for k in kept if similar.jaccard(sets[k], s) >= 0.8), None)
        if like is None:
            kept.append(i)
        else:
            want[i] = like
    assert len(want) >= 4 and len(kept) >= 25
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(similar, "candidate_links", lambda fps, *_: fps.crossJoin(fps.agg(F.min("fp").alias("b"))).select(F.col("fp").alias("a"), "b").where("a <> b"))
    rounds, settled = [], similar._settled
    monkeypatch.setattr(similar, "_settled", lambda *a: rounds.append(1) or settled(*a))
    got = similar.duplicates(placed(spark.read.parquet(str(tmp_path / "t"))), **sizes).collect()
    assert {x.row: x.kept for x in got} == want
    assert len(rounds) == 1 if not sizes else len(rounds) > 1


def test_many_rounds_leave_the_estimates_of_the_plan_small(spark, capsys):
    """Sizes that Spark estimates are numbers of any length: taken times each other round after round, they filled the driver."""
    rows = [(1, n, n, 30, " ".join(f"w{n}x{i}" for i in range(8))) for n in range(8)]
    open_rows, rounds = spark.createDataFrame(rows, "root long, row long, place long, size long, text string"), 0
    while True:
        _, rest = similar._settled(open_rows, 0.8, 1, 1 << 22, 2048)
        rounds += 1
        if rest is None:
            break
        open_rows = rest
    open_rows.explain(mode="cost")
    powers = [int(p) for p in re.findall(r"sizeInBytes=[0-9.]+E\+(\d+) B", capsys.readouterr().out)]
    assert rounds == 8 and max(powers, default=0) < 60
