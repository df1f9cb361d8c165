"""Corpus operators against SQL, brute force, round trips and held-out accuracy; and on messy tables."""

from __future__ import annotations

import itertools
import math
import os
import random
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from slipway.llm import (chat, decontaminate, exact, jaccard, mixing, passages, pii, suffixes, templates,  # noqa: E402
                         toxicity)
from slipway.llm.common import Scratch  # noqa: E402
from slipway.llm.graph import components  # noqa: E402
from slipway.llm.queries import QUERIES, SQL, domain  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ["id", "row", "n", "cls", "spans", "kept", "pii", "toxicity", "shape", "component", "item_id", "label"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = words(1, 30000)
P = words(2, 70)
MESSY = [
    (1, "Hello  world\tagain"), (2, "Hello world again"), (3, None), (4, ""), (5, " "), (6, LONG), (7, LONG),
    (8, LONG + " and a little more"), (9, P), (9, P), (10, words(3, 40) + " " + P + " " + words(4, 40)),
    (11, words(5, 30) + " " + P.upper()), (12, "é" * 60), (13, "é" * 61), (None, P), (None, None), (None, "alone"),
    (14, "one two three"), (15, "One two THREE"), (-3, "<>&'\"\\ \x00 x"), (16, "mail a.b@c.org, +1 (555) 010-9999"),
]


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "src1" if (i or 0) % 3 else None,
                                 len(t) if t else None) for i, t in rows], SCHEMA)
    for c in CLASHES if clash else []:
        df = df.withColumn(c, F.lit("other"))
    return df


def rows_of(spark, name="documents"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(
        "doc_id" if name == "documents" else "item_id", "text").collect()]


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert check.compare(spark, check.connect(SF), SF, name, QUERIES[name], SQL[name])[1] is None


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


# 1
def test_exact_on_messy_rows(spark):
    docs = table(spark, MESSY)
    assert listed(exact.with_digests(exact.exact_groups(docs), docs)) == sorted(brute.exact(MESSY), key=str)


def test_exact_same_length_and_prefix(spark):
    base = "x" * 100
    rows = [(k, base + c) for k, c in enumerate("abcabcd")] + [(9, "y" + base)]
    docs = table(spark, rows)
    assert listed(exact.with_digests(exact.exact_groups(docs), docs)) == sorted(brute.exact(rows), key=str)
    assert sorted(r.doc_id for r in exact.drop_copies(docs).collect()) == [0, 1, 2, 6, 9]


def test_exact_null_id_loses(spark):
    got = exact.exact_groups(table(spark, [(None, "a"), (5, "a"), (None, "b"), (None, "b")]))
    assert {(r.id, r.keep_id, r.group_size) for r in got.collect()} == {(None, 5, 2), (5, 5, 2), (None, None, 2)}


# 2
ITEMS = [(1, P), (2, "one two three"), (3, None), (4, ""), (5, words(3, 12)), (5, words(3, 12)), (None, words(4, 11)),
         (6, "hello world again"), (7, "mail")]


def test_contamination_on_messy_rows(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    got = decontaminate.contamination(table(spark, MESSY), bench)
    assert {(r.id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()} == brute.contamination(MESSY, ITEMS)


def test_contamination_with_an_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(table(spark, MESSY), bench)
    assert {(r.n_hit, tuple(r["items"])) for r in got.collect()} == {(0, ())}


# 3
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = scored.filter("held_out").select("score", "predicted", "toxic").collect()
    bad, good = [[r.score for r in rows if r.toxic == k] for k in (1, 0)]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    hits = [r.toxic for r in rows if r.predicted]
    assert auc > 0.95 and sum(hits) / len(hits) > 0.9 and sum(hits) / len(bad) > 0.6


def test_toxicity_on_messy_rows(spark):
    learn = [(k, ("you idiot " if k % 2 else "a lovely ") + words(k, 5)) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    docs = table(spark, MESSY + learn)
    got = {(r.doc_id, r.text): r.toxicity for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(set(MESSY + learn)) and all(0 <= s <= 1 for s in got.values())
    assert got[3, None] == got[4, ""] == got[None, None]
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert len({k for k, _ in learn if k % 2} & kept) < 10 and len({k for k, _ in learn if k % 2 == 0} - kept) < 10
    assert toxicity.drop_toxic(docs, labels).columns == COLUMNS


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity for r in toxicity.score_documents(table(spark, MESSY), labels).collect()} == {0.0}


# 4
def test_templates_against_brute_force(spark):
    r = random.Random(5)
    lines = ["Page {n} of the report", "Written by {w} on {n} for the whole editorial board", "{w} {w}", "the end",
             "Read more about {w} here and on our other pages now", ""]
    rows = [(k, "\n".join(r.choice(lines).format(n=r.randint(1, 99), w=words(r.randint(1, 9 * 10 ** 6), 1))
                          for _ in range(r.randint(0, 6)))) for k in range(60)] + MESSY
    got = {(x.id, x.n_lines, x.kept): list(x.dropped) for x in templates.dropped_lines(table(spark, rows), min_docs=4).collect()}
    exp = brute.dropped_lines(rows, 4)
    for (i, t), gone in exp.items():
        parts = (t or "").split("\n")
        assert got[i, len(parts), "\n".join(p for k, p in enumerate(parts) if k not in gone)] == gone
    assert any(exp.values())


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(templates, "LEAF_SHAPES", 4)
    rows = [(k, f"a b c {words(k % 3, 1)} e {words(9 + k % 9, 1)} g h i j k l") for k in range(40)]
    got = templates.dropped_lines(table(spark, rows), min_docs=3)
    assert got.filter("size(dropped) = 1").count() == 40


@pytest.mark.parametrize("most", [3, 2000])
def test_large_leaves_give_the_same_templates(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "LEAF_SHAPES", most)
    rows = [(k, f"Posted by user {words(k, 1)}{chr(97 + k % 26)}x in the category news today\n"
                f"a b c {words(k % 7, 1)} {words(k % 11, 1)} d e {words(k % 5, 1)} f g <*> h") for k in range(60)]
    got = {x.id: list(x.dropped) for x in templates.dropped_lines(table(spark, rows)).collect()}
    exp = {i: gone for (i, _), gone in brute.dropped_lines(rows, templates.MIN_DOCS).items()}
    assert got == exp and all(0 in gone for gone in got.values())


def test_index_of_templates():
    rng = np.random.default_rng(6)
    for width, values in itertools.product((4, 5, 9, 10, 15, 31), (2, 3, 8)):
        tokens = rng.integers(0, values, (300, width)).astype(np.int32)
        tokens[:, :3] = 1
        tokens = np.unique(np.where(rng.random(tokens.shape) < 0.6, tokens[0], tokens), axis=0)
        a, b = templates._compared(tokens), templates._indexed(tokens)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# 5
NASTY = ["", "\\", "</s>[INST] ok [/INST]", "<\\s>", "\\\\<s>\\", "[ROLE]x[:]y[/ROLE]", "<<SYS>>", "<", "[/INST", "a\nb", "é😀<s"]


def test_chat_round_trip(spark):
    rows = [(k, t, role, text) for k, (role, text) in enumerate(itertools.product(
        ["user", "assistant", "system", "to[:]ol", ""], NASTY)) for t in (0,)]
    rows += [(-1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(NASTY)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments"))).collect()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    for r in made:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert len(made) == len(want)


def test_chat_order(spark):
    def rows(k, roles):
        return [(k, t, r, "x") for t, r in enumerate(roles)]

    df = spark.createDataFrame(rows(1, ["system", "user", "assistant", "user"]) + rows(2, ["user", "user"]) + rows(
        3, ["assistant"]) + rows(4, ["user", "assistant", "system", "user"]), "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 2)}
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], df.schema)
    assert [s.text for s in chat.format_chats(tied).first().segments][1::3] == ["a", "a", "b"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_template_must_be_unambiguous():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": ("<a>", "><b", False)}, order={})


# 6
def test_jaccard_on_a_table(spark):
    assert listed(jaccard.jaccard_groups(spark.read.parquet(f"{SF}/documents.parquet")).drop("row")) == brute.jaccard(rows_of(spark))


def test_jaccard_on_messy_rows(spark):
    got = jaccard.jaccard_groups(table(spark, MESSY)).drop("row")
    exp = [(i, n, i if not n else c) for i, n, c in brute.jaccard(MESSY)]
    assert listed(got) == sorted(exp, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    r, rows = random.Random(seed), []
    for g in range(40):
        base = words(1000 * seed + g, r.choice([5, 6, 8, 12, 20, 45, 90, 200])).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                k = r.randrange(len(w))
                w[k:k + r.randint(0, 1)] = [words(r.randint(1, 10 ** 9), 1)]
            rows.append((len(rows), " ".join(w)))
    hot = "the same long line that every document of this little table holds somewhere in its text"
    rows = [(i, t + (" " + hot if i % 2 else "")) for i, t in rows]
    assert listed(jaccard.jaccard_groups(table(spark, rows)).drop("row")) == brute.jaccard(rows)


@pytest.mark.parametrize("family", ["changed", "passage"])
def test_jaccard_families_that_do_not_link_are_told_apart(spark, monkeypatch, family):
    """Texts that resemble each other but mostly do not link: few of their pairs are compared token by token."""
    compared = []
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest, old=jaccard._verified: (
        compared.append(pairs.count()), old(pairs, *rest))[1])

    def texts(n):
        rng = random.Random(n)
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        out = []
        for k in range(n):
            if family == "changed":
                words = list(base)
                for at in rng.sample(range(200), rng.randint(1, 8)):
                    words[at] = f"v{rng.randrange(10**6)}"
            else:
                words = base[:60] + [f"v{rng.randrange(10**6)}" for _ in range(140)]
            out.append((k, " ".join(words)))
        return out

    rows = texts(400)
    assert listed(jaccard.jaccard_groups(table(spark, rows)).drop("row")) == brute.jaccard(rows)
    assert sum(compared) <= 0.01 * 400 * 399 / 2, compared


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7), (None, 1), (60, 61), (61, 62), (60, 62), (62, 70)]
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == {k: 0 for k in range(41)} | {99: 99, 100: 99} | {
        k: 60 for k in (60, 61, 62, 70)}


# 7
def test_windows_are_those_of_the_tree():
    rng = np.random.default_rng(3)
    sizes = [60, 46, 10, 0, 130]
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 40, first[-1]).astype(np.uint64)
    exp = []
    for t, (a, b) in enumerate(zip(first[:-1], first[1:])):
        for c in range(a, b):
            lo, hi = c, c
            while lo > a and h[lo - 1] > h[c]:
                lo -= 1
            while hi + 1 < b and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= passages.SPAN:
                exp.append((c, lo, hi, t))
    assert list(zip(*(x.tolist() for x in passages.windows(h, first)))) == exp


def test_passages_on_messy_rows(spark):
    got = {(r.id, r.row): [(s.start, s.end) for s in r.spans] for r in passages.near_passages(table(spark, MESSY)).collect()}
    spans = {i: s for (i, _), s in got.items()}
    assert spans == {7: [(0, 30000)], 8: [(0, 30000)], 10: [(40, 110)], 11: [(30, 100)]} or (
        spans.keys() == {7, 8, 10, 11} and all(b - a >= n for (a, b), n in (
            (spans[7][0], 30000), (spans[8][0], 30000), (spans[10][0], 70), (spans[11][0], 70))))


def test_passage_keys_are_dealt_in_little_memory():
    """A slice of 2 MB took 36 bytes for a byte of text at its peak."""
    base = words(7, 1500)
    texts = [base[k:] + base[:k] for k in range(0, len(base), 50)] + [words(400 + k, 400) for k in range(300)]
    part = pa.record_batch({"id": list(range(len(texts))), "row": [0] * len(texts), "text": texts})
    hot = np.zeros(1, np.uint64)
    passages._slice_blobs([part.slice(0, 2)], 3, hot)  # tables that stay
    tracemalloc.start()
    try:
        passages._slice_blobs([part], 3, hot)
        assert tracemalloc.get_traced_memory()[1] < 18 * sum(map(len, texts))
    finally:
        tracemalloc.stop()


def test_passage_keys_are_few():
    """Two keys for every word were four times the input's size on disk."""
    texts = [words(900_000 + k, 400) for k in range(200)]
    part = pa.record_batch({"id": list(range(len(texts))), "row": [0] * len(texts), "text": texts})
    blobs = passages._slice_blobs([part], 3, np.zeros(0, np.uint64))
    assert blobs.nbytes < 1.2 * sum(map(len, texts))
    entries = sum(len(k.as_py()) for k in blobs.column("key")) // 8
    assert 0.2 * 400 * len(texts) < entries < 0.4 * 400 * len(texts)


def test_windows_of_texts_that_are_all_short():
    h = np.random.default_rng(1).integers(0, 1 << 62, 200).astype(np.uint64)
    assert not any(len(x) for x in passages.windows(h, np.arange(0, 201, 10)))
    assert [len(x) for x in passages.windows(h, np.array([0, 100, 200]), 41, 40)][0]


def test_windows_followed_a_little_way():
    """Nodes are those of the whole windows, whose ends within reach are the same."""
    r = np.random.default_rng(2)
    h, first = r.integers(0, 300, 3000).astype(np.uint64), np.array([0, 500, 510, 551, 3000])
    whole, near = passages.windows(h, first, 41), passages.windows(h, first, 41, 40)
    assert len(whole[0]) and (whole[0] == near[0]).all() and (whole[3] == near[3]).all()
    for x, y in ((whole[0] - whole[1], near[0] - near[1]), (whole[2] - whole[0], near[2] - near[0])):
        assert (np.minimum(x, 40) == np.minimum(y, 40)).all()
    nodes = {a + int(h[a:a + 41].argmin()) for i, j in zip(first[:-1], first[1:]) for a in range(i, j - 40)}
    assert set(whole[0].tolist()) == nodes


def test_passages_of_a_batch_are_those_of_each_pair(monkeypatch):
    texts = [words(k, 70) for k in range(4)] + ["", "short", None]
    x = [a + " " + b if a and b else a for a in texts for b in texts[::-1]]
    y = [b for a in texts for b in texts]
    want = [[tuple(p) for p in passages.similar_passages(a or "", b or "")] for a, b in zip(x, y)]
    assert any(want)
    for size in (1 << 19, 500):
        monkeypatch.setattr(passages, "SLICE", size)
        got = passages._compare(pa.array(x), pa.array(y)).to_pylist()
        assert [[(p["start"], p["end"]) for p in found] for found in got] == want


def test_near_passages_are_found(spark):
    rows = []
    for g in range(30):
        core = words(g, 120).split()
        changed = list(core)
        for k in (30, 75):
            changed[k] = "changed"
        rows += [(2 * g, words(500 + g, 60) + " " + " ".join(core) + " " + words(600 + g, 60)),
                 (2 * g + 1, words(700 + g, 50) + " " + " ".join(changed) + " " + words(800 + g, 50))]
    got = {r.id: sum(s.end - s.start for s in r.spans) for r in passages.near_passages(table(spark, rows)).collect()}
    assert all(i % 2 for i in got) and sum(got.values()) > 0.9 * 30 * 118


def test_passages_of_shared_lines(spark):
    """Passages of frequent lines whose keys' first and previous holders share only two of the three lines."""
    lines = {c: words(900 + k, 20) for k, c in enumerate("ABCDEFGHIJKLMNOPQR")}
    rows, exp = [], set()

    def add(*three):
        k = len(rows)
        rows.append((k, " ".join([words(3000 + k, 30), *(lines[c] if c in lines else words(5000 + k, 20) for c in three),
                                  words(7000 + k, 30)])))
        return k

    triples = ("ABC", "DEF", "GHI", "JKL", "MNO", "PQR")
    for a, b, c in triples:
        two = [(a, b, "-"), ("-", b, c), (a, "-", c)]
        for t in [*two * 17, (a, b, c), *two * 17]:
            add(*t)
    for a, b, c in triples:
        for t in ((a, b, "-"), ("-", b, c), (a, "-", c)):
            add(*t)
        exp.add(add(a, b, c))
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in passages.near_passages(table(spark, rows)).collect()}
    assert got.keys() == exp
    assert all(any(a <= 30 and b >= 90 for a, b in s) for s in got.values())


def test_short_passages_near_the_threshold_are_candidates():
    """Passages of 50 to 60 words at a similarity of 0.8 to 0.84: one word in their midst is changed."""
    pairs, texts = 1500, []
    for k in range(pairs):
        core = words(20000 + k, 50 + k % 11).split()
        other = core[:25] + ["changed"] + core[26:]
        assert passages.similar_passages(" ".join(core), " ".join(other)) == [(0, len(core))]
        texts += [" ".join([words(40000 + k, 30), *core, words(60000 + k, 30)]),
                  " ".join([words(80000 + k, 30), *other, words(90000 + k, 30)])]
    key, text, _, _ = passages.signatures(*passages._shingles(passages.pa.array(texts)), np.zeros(0, np.uint64))
    holders = {}
    for k, t in zip(key.tolist(), text.tolist()):
        holders.setdefault(k, set()).add(t)
    met = {a // 2 for h in holders.values() for a in h if a ^ 1 in h}
    assert len(met) >= 0.985 * pairs


def test_repeats_of_two_overlapping_partners(spark):
    """The third text of each triple holds more of its second partner than what lies outside the first one's passage."""
    rows = []
    for g in range(120):
        core = words(100_000 + g, 75).split()
        parts = [core[:60], core[20:], core]
        rows += [(3 * g + k, " ".join([words(200_000 + 3 * g + k, 30), *p, words(300_000 + 3 * g + k, 30)]))
                 for k, p in enumerate(parts)]
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in passages.near_passages(table(spark, rows)).collect()}
    assert all(got.get(3 * g + 2) == [(30, 105)] for g in range(120))


def test_passages_query_against_brute_force(spark):
    """Words that the query marks, of those that a comparison of every two texts marks."""
    r, rows = random.Random(11), []
    for g in range(60):
        core = words(400_000 + g, r.randint(50, 60)).split()
        other = core[:25] + ["changed"] + core[26:]
        for part in (core, other, core[:-2] + words(g, 2).split()):
            rows.append((len(rows), " ".join([words(500_000 + len(rows), r.randint(0, 60)), *part,
                                              words(600_000 + len(rows), r.randint(0, 60))])))
    rows += [(len(rows) + k, " ".join(rows[r.randrange(150)][1].split()[10:80] + rows[r.randrange(150)][1].split()[5:75]))
             for k in range(40)]
    shingles = [frozenset(brute.shingles(t)) for _, t in rows]
    want, have = {}, {}
    for k, (i, t) in enumerate(rows):
        want[i] = {w for j in range(k) if shingles[k] & shingles[j]
                   for a, b in passages.similar_passages(t, rows[j][1]) for w in range(a, b)}
    for x in passages.near_passages(table(spark, rows)).collect():
        have[x.id] = {w for s in x.spans for w in range(s.start, s.end)}
    found = sum(len(w & have.get(i, set())) for i, w in want.items())
    extra = sum(len(w - want[i]) for i, w in have.items())
    assert found >= 0.97 * sum(map(len, want.values())) and extra <= 0.02 * found, (found, sum(map(len, want.values())), extra)


# 8
def test_mixing_on_messy_rows(spark):
    got = mixing.mix(table(spark, MESSY), domain(), {"curated": 3, "web/en": 2}, budget_pct=100, max_epochs=2)
    rows = got.collect()
    assert rows and all(1 <= r.copies <= 2 and r.n_tokens > 0 for r in rows)
    total = sum(len((t or "").split()) for _, t in MESSY)
    assert sum(r.copies * r.n_tokens for r in rows) <= total
    assert mixing.mix(table(spark, MESSY).limit(0), domain(), {}).count() == 0


def test_water_filling(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 5), ("b", "x", "1", 1000),
                                    ("c", "x", "1", 400)], "domain string, lang string, source string, available long")
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(leaves, {"a": 2, "c": 0}, 20, 1).collect()}
    # 303 tokens: a can use 115 of its 202, so b has the rest; inside a every leaf is used up.
    assert got == {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 5, ("b", "x", "1"): 188, ("c", "x", "1"): 0}


# 9
def test_suffixes_on_a_table(spark):
    got = QUERIES["op9_suffix_dedup"](spark, SF)
    assert listed(got) == brute.repeats(rows_of(spark))


def test_suffixes_on_messy_rows(spark):
    got = suffixes.repeated_spans(table(spark, MESSY)).select(
        "id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
        F.size("spans").cast("long"), F.sha2("kept", 256))
    assert listed(got) == brute.repeats(MESSY)


def test_suffixes_of_periodic_runs(spark):
    """A run is one context of more strings than a byte can count."""
    runs = ["=" * 400, "lol " * 250, "| 0 | 00 " * 120, "\u2014" * 1000]
    rows = [(10 * k + j, words(50 + k, 30) + run + words(60 + k, 30)) for k, run in enumerate(runs) for j in range(3)]
    rows += [(100, runs[0]), (101, runs[0])]
    for part in (rows, rows[:3], rows[-2:]):
        got = suffixes.repeated_spans(table(spark, part)).select(
            "id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
            F.size("spans").cast("long"), F.sha2("kept", 256))
        assert listed(got) == brute.repeats(part)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["abandon", "be", "charlie", "delta", "it", "of", "under", "yesterday"]) for _ in range(n))


@pytest.mark.parametrize("many", [1, 3, 1 << 14])
def test_suffixes_of_shared_phrases(spark, monkeypatch, many):
    """Few words, so anchors have many contexts; both ways of taking them apart give what brute force gives."""
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", many)
    line = prose(0, 11)
    rows = [(k, prose(k, 9) + " " + line + " " + prose(100 + k, 9 + k)) for k in range(1, 30)]
    rows += [(90 + k, prose(k // 2, 300)) for k in range(6)] + [(99, "0 " * 900 + line), (99, line * 3), (None, line * 3)]
    got = suffixes.repeated_spans(table(spark, rows).repartition(3)).select(
        "id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
        F.size("spans").cast("long"), F.sha2("kept", 256))
    assert listed(got) == brute.repeats(rows)


def test_strings_of_pieces_have_their_keys(monkeypatch):
    text = np.frombuffer(prose(5, 60).encode(), np.uint8)
    places = [(0, 3), (20, 1), (21, 60), (90, 7)]
    want = np.concatenate([suffixes.strings(text[p:p + 50], np.array([1])) for a, n in places for p in range(a, a + n)])
    pieces, n = np.concatenate([text[a:a + n + 49] for a, n in places]), np.array([n for _, n in places], np.int32)
    assert (suffixes.strings(pieces, n) == want).all()
    monkeypatch.setattr(suffixes, "_BLOCK", 64)
    assert (suffixes.strings(pieces, n) == want).all()
    start, _, _, key, _ = suffixes.contexts(text, np.array([0, len(text)]), lambda v: np.arange(len(v)))
    assert dict(zip(start.tolist(), key.tolist())).items() >= dict(
        zip([p for a, n in places for p in range(a, a + n)], want.tolist())).items()


def test_contexts_taken_apart_are_sent_as_bytes():
    """Each string took 14 bytes before, for its hash, place and text number."""
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(20)]
    part = pa.record_batch({"id": list(range(20)), "row": [0] * 20, "text": texts})
    every = SimpleNamespace(value=(np.full(suffixes.KEY_BITS // 8, 255, np.uint8), np.zeros(suffixes.HOT_BITS // 8, np.uint8)))
    blobs = suffixes._group_blobs([part], 4, every).to_pylist()
    assert all(b["bucket"] >= 0 for b in blobs)
    assert sum(len(x) for b in blobs for x in b.values() if isinstance(x, bytes)) < 7 * 20 * 2000


def test_level_index_in_small_batches(monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH", 7)
    rng = np.random.default_rng(4)
    keys, docs = rng.integers(0, 60, 500).astype(np.uint64), rng.integers(0, 90, 500)
    assert (suffixes.first_documents(keys, docs) == [docs[keys == k].min() for k in keys]).all()
    index = suffixes.LevelIndex()
    for k in range(64):
        index.add(np.arange(k * 10, k * 10 + 10).astype(np.uint64), np.full(10, k))
    assert len(index.levels) <= 7


def test_long_texts_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 64)
    got = suffixes.contexts(np.frombuffer(P.encode(), np.uint8), np.array([0, len(P)]))
    starts = sorted(x for a, b in zip(got[0], got[1]) for x in range(a, b + 1))
    assert starts == list(range(len(P) - 49))


# 10
TEXTS = [t for _, t in MESSY] + [
    "a@b.co_x@y.org", "x@@y.com", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.4", "4111 1111 1111 1111", "4111111111111112",
    "+1 (555) 010-9999 +49 30 123456-", "9" * 500, "a" * 500 + "@", "+1+2+3 4567890123", "é +44 20 7946 0958 ü a.b@c.de.",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "0000000000000000"]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == brute.base_spans(t)
    r = random.Random(7)
    for _ in range(3000):
        t = "".join(r.choice("0123456789.@+-() ab_%é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute.base_spans(t)


def test_random_field_sums_and_best_path():
    rng = np.random.default_rng(5)
    n, spans = 6, [(i, j, None) for i in range(6) for j in range(i + 1, 7) if j - i <= 3]
    scores = rng.normal(size=(len(spans), len(pii.KINDS)))

    def paths(at):
        if at == n:
            yield ()
            return
        for rest in paths(at + 1):
            yield rest
        for k, (i, j, _) in enumerate(spans):
            if i == at:
                for kind in range(len(pii.KINDS)):
                    for rest in paths(j):
                        yield ((k, kind), *rest)

    every = [(sum(scores[c] for c in p), p) for p in paths(0)]
    z = sum(math.exp(s) for s, _ in every)
    want = np.zeros_like(scores)
    for s, p in every:
        for c in p:
            want[c] += math.exp(s) / z
    assert np.allclose(pii._expected(n, spans, scores), want)
    best = max(every, key=lambda x: x[0])[1]
    assert pii.best_path(n, spans, scores) == [(spans[k][0], spans[k][1], kind) for k, kind in best]


def test_personal_data_on_messy_rows(spark):
    r = random.Random(9)
    more = [(100 + k, f"call +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} or u{k}@mail{k % 9}.org from 10.1.{k}.7 "
                      f"code {r.randint(1000, 99999)}") for k in range(150)]
    docs = table(spark, MESSY + more)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(MESSY + more)
    for x in rows:
        assert [(s.start, s.end, s.kind) for s in x.pii if s.base] == brute.base_spans(x.text)
        ends = sorted((s.start, s.end) for s in x.pii if not s.base)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    weights = np.zeros(pii.WEIGHTS)
    for w in pii.fit(docs).collect():
        weights[w.i] = w.w
    # Without the base patterns the field finds what it was trained on, and leaves plain numbers alone.
    text = "call +1 (222) 555-1234 or someone@mail3.org from 10.1.200.7 code 4821"
    cuts, spans = pii.candidates(text, 0, len(text))
    path = pii.best_path(len(cuts) - 1, spans, pii._scores(spans, weights))
    assert [(text[cuts[i]:cuts[j]], pii.KINDS[k]) for i, j, k in path] == [
        ("+1 (222) 555-1234", "phone"), ("someone@mail3.org", "email"), ("10.1.200.7", "ip")]


def test_drops_spare_other_texts_of_the_same_id(spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    near = words(21, 60)
    rows = [(1, "a copy"), (2, "a copy"), (2, "another text"), (None, "a copy"), (None, "a text of its own"), (3, near),
            (4, near + " x"), (4, "a clean one"), (None, near + " y"), (5, P), (5, "clean too"), (1, "a copy"), (6, None), (7, "")]
    docs = table(spark, rows)

    def kept(df):
        return sorted(((x.doc_id, x.text) for x in df.collect()), key=str)

    left = sorted(set(rows) - {(2, "a copy"), (None, "a copy"), (7, "")}, key=str)
    assert kept(exact.drop_copies(docs).distinct()) == left
    gone = {(2, "a copy"), (None, "a copy"), (4, near + " x")}
    assert kept(jaccard.drop_near_copies(docs)) == sorted([x for x in rows if x not in gone], key=str)
    assert kept(decontaminate.drop_contaminated(docs, bench)) == sorted([x for x in rows if x != (5, P)], key=str)
    assert exact.drop_copies(docs).columns == jaccard.drop_near_copies(docs).columns == COLUMNS


# all
def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), table(spark, []).filter("doc_id = 0"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_empty_tables(spark):
    docs = table(spark, []).filter("doc_id = 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (exact.exact_groups(docs), exact.drop_copies(docs), decontaminate.contamination(docs, bench),
               decontaminate.drop_contaminated(docs, bench), toxicity.score_documents(docs, labels),
               templates.dropped_lines(docs), jaccard.jaccard_groups(docs), jaccard.drop_near_copies(docs),
               passages.near_passages(docs), mixing.mix(docs, domain(), {}), suffixes.repeated_spans(docs),
               pii.personal_data(docs)):
        assert df.count() == 0


def write_tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, int(k % 4 == 0)) for k in range(1000, 1200)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline(spark, tmp_path):
    learn = [(k, ("you idiot " if k % 4 == 0 else "a lovely ") + words(k, 30)) for k in range(1000, 1200)]
    near = words(11, 200)
    copies = [(2000, near), (2001, near), (2002, near + " x"), (2003, words(12, 50))]
    write_tables(spark, str(tmp_path), table(spark, MESSY + learn + copies))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "test").table(stage(spark, docs, str(tmp_path)))
        if name != "mixture":
            assert out.columns == COLUMNS
            rows = {(r.doc_id, r.text) for r in out.collect()}
            seen.append(rows)
            docs = out
    toxic, unique, apart, clean = seen
    assert {k for k, _ in learn if k % 4} - {i for i, _ in toxic} == set()
    assert len({k for k, _ in learn if k % 4 == 0} & {i for i, _ in toxic}) < 5
    gone = {i for i, _ in toxic} - {i for i, _ in unique}
    named = {(i, t) for i, t in toxic if i is not None}
    keep = {i: k for i, k, *_ in brute.exact(named)}
    assert gone == {i for i, k in keep.items() if i != k}
    assert {2000, 2003} <= {i for i, _ in apart} and not {2001, 2002} & {i for i, _ in apart}
    hits = {i for i, _, n, _ in brute.contamination(apart, ITEMS[:1]) if n}
    assert {i for i, _ in clean if i is not None} == {i for i, _ in apart if i is not None} - hits
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "copies"}
    assert listed(corpus_pipeline.run(spark, str(tmp_path))) == listed(out)
