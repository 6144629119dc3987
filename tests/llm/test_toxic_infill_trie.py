"""Toxicity, fill-in-middle and the prefix trie against brute force and held-out labels, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightlog.llm import infill, prefix_trie, toxicity

DOCS = "doc_id long, text string, lang string, score string, n string, form string, h1 string, y int"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    count = iter(range(10_000))

    def write(rows, schema, parts=3):
        path = str(folder / f"t{next(count)}")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return write


def docs_of(store, texts, first=0):
    return store([(first + i, t, "en", "x", "y", "z", "w", 3) for i, t in enumerate(texts)], DOCS)


# toxicity


def sentences(r, n, bad=None):
    out = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 9))) for _ in range(n)]
    if bad:
        at = r.randrange(n)
        out[at] += " " + bad
    return ". ".join(out) + "."


def test_gradient_is_that_of_the_log_loss():
    r = np.random.default_rng(4)
    ys = [1, 0, 1, 0]
    columns = {"y": ys, "n": [3, 2, 1, 0], "feats": [[0, 2, 1], [1, 3], [], []], "ends": [[1, 3], [2], [], []]}
    batch = pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns.values(), [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())], strict=True)], names=list(columns))
    w = r.normal(size=5)

    def loss(v):
        return toxicity.loss_and_gradient(batch, v)[-1]

    got = toxicity.loss_and_gradient(batch, w)[:-1]
    want = [(loss(w + d) - loss(w - d)) / 2e-6 for d in np.eye(5) * 1e-6]
    assert got == pytest.approx(want, rel=1e-4)
    # the loss itself, by the product of the definition
    p = [[1 / (1 + np.exp(-(w[-1] + sum(w[f] for f in s)))) for s in doc] for doc in ([[0], [2, 1], []], [[1, 3], []], [[]], [[]])]
    noisy_or = [1 - np.prod([1 - x for x in doc]) for doc in p]
    assert loss(w) == pytest.approx(-sum(np.log(q if y else 1 - q) for q, y in zip(noisy_or, ys, strict=True)))


def test_document_labels_teach_sentences(store):
    r = random.Random(2)
    bad = ["zzkugel", "zzkuger", "qqwort"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, sentences(r, r.randint(2, 12), r.choice(bad) if toxic else None), "en", "x", "y", "z", "w", 3))
        labels.append((i, int(toxic), 7))
    long = sentences(r, 4000, "zzkugen")
    rows += [(1000, long, "en", "x", "y", "z", "w", 3), (1001, None, "en", "x", "y", "z", "w", 3), (1002, "", "en", "x", "y", "z", "w", 3), (None, "qqwort", "en", "x", "y", "z", "w", 3), (1003, "...!!!\n", "en", "x", "y", "z", "w", 3)]
    rows += rows[:2]
    labels += [(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)]
    docs = store(rows, DOCS)
    got = toxicity.classify(docs, store(labels, "doc_id long, toxic int, score int")).collect()
    assert len(got) == len(rows)
    text = {x[0]: x[1] for x in rows}
    for row in got:
        if row["doc_id"] is not None and row["doc_id"] < 600:
            assert row["predicted"] == (row["doc_id"] % 4 == 0), row
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
            marked = [text[row["doc_id"]][s["start"] : s["end"]] for s in row["offending"]]
            assert len(marked) <= 1 and all(any(b[:5] in m for b in bad) for m in marked)
    by_id = {row["doc_id"]: row for row in got}
    # an unseen word of a known family, in one of thousands of sentences
    assert by_id[1000]["predicted"] == 1 and [long[s["start"] : s["end"]].split()[-1] for s in by_id[1000]["offending"]] == ["zzkugen"]
    assert by_id[1001]["score"] == by_id[1002]["score"] == by_id[1003]["score"] < 0.5 and by_id[1001]["n_sentences"] == 0
    assert by_id[None]["held_out"] is False and by_id[None]["predicted"] == 1


def test_scores_are_the_noisy_or_of_all_sentences(store):
    model = {"buckets": np.array(sorted(toxicity.features_of("bad"))), "weights": np.array([1.5] * len(toxicity.features_of("bad"))), "bias": -2.0, "constant": None}
    got = toxicity.score(docs_of(store, ["bad one. fine! Bad bad\nbad"]), model).first()
    p = lambda z: 1 / (1 + np.exp(-z))
    assert got["score"] == pytest.approx(1 - (1 - p(-0.5)) ** 3 * (1 - p(-2.0))) and got["n_sentences"] == 4


def test_toxicity_without_labels_or_rows(store):
    labels = store([(1, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs_of(store, ["a", None]), labels).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.5, 1)] * 2
    one_kind = toxicity.classify(docs_of(store, ["a b", "c"], first=1), store([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")).collect()
    assert {r["score"] for r in one_kind} == {0.0}
    assert toxicity.classify(docs_of(store, []), labels).count() == 0


def test_training_rows_keep_to_the_bound(store):
    docs = docs_of(store, [f"t{i}" for i in range(20_000)])
    labels = store([(i, i % 2) for i in range(20_000)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, 3000)
    assert 2500 < got.count() <= 3000 and toxicity.training_rows(docs, labels, 10**6).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20_000))


def test_op11_on_held_out_documents(spark):
    scored = toxicity.op11_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([s >= 0.5 for s in bad]) > 0.8 and np.mean([s < 0.5 for s in good]) > 0.99
    ranks = np.searchsorted(np.sort(good), bad)
    assert ranks.mean() / len(good) > 0.97


# fill-in-middle


def infill_by_hand(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_against_slices(store):
    r = random.Random(6)
    alphabet = ["a", "é", "日", "😀", "́", "\n", "\r", "\r\n", " ", "\x85", "$1", "\\", "<", "<P", "S>", "{", "\x00"]
    texts = [None, "", "x", "a<P>b", "<S>", "<M", "\n", "😀" * 70_000, "ab\r\n" * 100_000] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "en", "x", "y", "z", "w", 3) for i, t in enumerate(texts)] + [(None, "no id here", "en", "x", "y", "z", "w", 3), (20, texts[20], "en", "x", "y", "z", "w", 3)]
    got = infill.transform(store(rows, DOCS)).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    have = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=repr)
    want = sorted(((d, *infill_by_hand(d, t), t or "") for d, t, *_ in rows), key=repr)
    assert have == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_infill_takes_one_match_and_no_shuffle(spark, store):
    plan = infill.transform(docs_of(store, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert infill.transform(docs_of(store, [])).count() == 0


# prefix trie


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    for v in convs.values():
        v.sort(key=lambda x: x[:3])
    whole = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = [(role, text) for _, role, _, text in convs.get(c - c % 100, [])[:h] + convs[c][h:]]
    members, children = defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[: d - 1])].add(tuple(s[:d]))

    def below(node):
        found, waiting = [], [node]
        while waiting:
            found.append(waiting.pop())
            waiting += children[found[-1]]
        return found

    out = []
    for node, m in members.items():
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), sum(not children[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, c string, pos string, head string, key int"


@pytest.fixture(scope="module")
def turns(store):
    r = random.Random(1)
    rows = []
    for c in [*range(12), *range(195, 260), None, 555, 10_001]:
        for k in range(r.choice([0, 1, 2, 3, 6, 9, 14])):
            rows.append((c, r.choice([k, k, k, None]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é日", None, ""] if r.random() < 0.8 else ["x" * r.randint(1, 40)])))
    for c in range(400, 440):
        rows += [(c, k, "u", "same") for k in range(30 if c % 2 else 7)]
    rows += rows[5:15]
    return rows, store([(*row, "c", "p", "h", 1) for row in rows], TURNS, 5)


@pytest.mark.parametrize("limb, capacity", [(16_384, 65_536), (16_384, 20), (4, 15)])
def test_trie_against_brute_force(turns, limb, capacity):
    rows, df = turns
    assert sorted(map(tuple, prefix_trie.trie(df, limb, capacity).collect()), key=repr) == trie_by_hand(rows)


def test_trie_of_one_long_conversation_and_its_copy(store):
    rows = [(c, k, "user", f"t{k % 7}") for c in (100, 7) for k in range(3000)] + [(300, 0, "user", "t0")]
    got = prefix_trie.trie(store([(*row, "c", "p", "h", 1) for row in rows], TURNS), 1000, 500)
    have = sorted(map(tuple, got.collect()), key=repr)
    assert len(have) == 3001 and have == sorted(set(have), key=repr)
    deepest = max(have, key=lambda x: x[1])
    assert deepest[:4] == (7, 3000, 7, 2) and deepest[7] == hashlib.sha256(b"7,100").hexdigest()
    assert next(x for x in have if x[1] == 0)[3:7] == (3, 1, 1, sum(2 for k in range(3000)) + 2)


def test_trie_of_turnless_conversations_and_no_rows(store):
    alone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5][:2]
    df = store([(c, 0, "user", "gone", "c", "p", "h", 1) for c in alone], TURNS)
    ids = ",".join(map(str, alone))
    assert list(map(tuple, prefix_trie.trie(df).collect())) == [(alone[0], 0, None, 2, 0, 1, 0, hashlib.sha256(ids.encode()).hexdigest())]
    assert prefix_trie.trie(store([], TURNS)).count() == 0
    assert prefix_trie.trie(store([(None, 0, "user", "x", "c", "p", "h", 1)], TURNS)).count() == 0


def test_pieces_of_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    ends = spark.range(0, 5000).select(F.lit(3).cast("long").alias("conv_id"), F.lit(2).alias("depth"), (F.col("id") * 37 % 5000).alias("c")).repartition(7)
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.member_digests(ends).collect()] == [(3, 2, want)]
