"""Packing, spelling variants and the infilling transformation against brute force, exact round trips and messy tables."""

from __future__ import annotations

import collections
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from slipway.llm import infill, packing, spelling  # noqa: E402
from slipway.llm.common import Scratch  # noqa: E402
from slipway.llm.queries import QUERIES, with_typos  # noqa: E402
from test_corpus import CLASHES, COLUMNS, LONG, MESSY, SF, listed, rows_of, table, words  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> in <|startoftext|>text", "é ́ a\n̈b", "x\x0b\x0cy\x1cz w", "İstanbul ΣΑΣ ǅ", "日本語 テキスト",
       "'s'll don't I'M 1234", "한 ᄒ", " ", "\t\n", "a​b   c", "😀👩‍👩‍👧 ok", "ﬁ ½ Ⅷ"]


# 11
def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check_packing(rows, sequences, capacity=4096):
    """Every id of every document in exactly one piece, every sequence gapless and within the capacity."""
    want = collections.Counter((i, tuple(ids)) for (i, _), ids in zip(rows, encoded([t for _, t in rows])))
    found, parts = collections.Counter(), collections.defaultdict(list)
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    for s in sequences:
        ids = np.frombuffer(s.ids, "<u4").tolist()
        offset = 0
        for p in s.pieces:
            assert p.offset == offset and p.length > 0
            parts[p.id, p.doc_tokens].append((p.start, ids[offset:offset + p.length]))
            offset += p.length
        assert offset == len(ids) == s.n_tokens <= capacity
        assert s.padded_to == (s.n_tokens if bin(s.n_tokens).count("1") == 1 else capacity)
    for (i, n), held in parts.items():
        starts = collections.defaultdict(list)  # documents of one id and length are put together in any way that fits
        for start, ids in held:
            starts[start].append(ids)
        docs = [d for d, k in want.items() for _ in range(k) if d[0] == i and len(d[1]) == n]
        for _, ids in docs:
            at = 0
            while at < n:
                piece = next(x for x in starts[at] if list(ids[at:at + len(x)]) == x)
                starts[at].remove(piece)
                at += len(piece)
            found[i, ids] += 1
        assert not any(starts.values())
    assert found == want


def test_packing_of_messy_rows(spark):
    rows = MESSY + [(100 + k, t) for k, t in enumerate(ODD)]
    check_packing(rows, packing.packed(table(spark, rows), TOKENIZER).collect())
    check_packing(rows, packing.packed(table(spark, rows).repartition(7), TOKENIZER, capacity=64).collect(), 64)
    assert packing.packed(table(spark, []), TOKENIZER).count() == 0


def test_packing_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = [(k, words(k, 5 + k * 7 % 400)) for k in range(300)]
    sequences = packing.packed(table(spark, rows).repartition(11), TOKENIZER, capacity=512).collect()
    check_packing(rows, sequences, 512)
    assert sum(s.padded_to - s.n_tokens for s in sequences) < 0.02 * sum(s.n_tokens for s in sequences)


def test_packing_query_reads_every_document(spark):
    rows = rows_of(spark)
    got = collections.defaultdict(list)
    found = QUERIES["op11_harmonic_packing"](spark, SF).collect()
    for r in found:
        got[r.doc_id].append(r)
    for (i, _), ids in zip(rows, encoded([t for _, t in rows])):
        held = sorted(got.pop(i), key=lambda r: r.start)
        assert [r.start for r in held] == [sum(q.length for q in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) == len(ids) and {r.doc_tokens for r in held} == {len(ids)}
        for r in held:
            assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert not got
    used = collections.Counter()
    for r in found:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sum(used.values()) > 0.97 * 4096 * len(used)


def test_tokens_by_word_equal_tokens_of_the_text():
    r = random.Random(3)
    odd = "".join(ODD) + "ab'\"<|>endoftext \n\t̀́"
    texts = ODD + ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|>"] * 2
    ids, first = packing.token_ids(pa.array([*texts, None]), TOKENIZER, 2)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == encoded([*texts, None])


def test_cuts_add_up_and_fit_their_class():
    for capacity in (64, 4096):
        for n in [*range(1, 3 * capacity, 1 if capacity == 64 else 7), 10 * capacity + 1]:
            made = list(packing.cuts(n, capacity))
            assert sum(a for a, _ in made) == n and all(0 < a <= capacity // k for a, k in made)


# 12
def variants(spark, rows):
    runs = spelling.runs(table(spark, rows), keep=("doc_id",))
    return spelling.vocabulary(with_typos(runs).filter(F.length("word") >= 6))


@pytest.mark.parametrize("tile", [1024, 3])
def test_variants_against_brute_force(spark, tile):
    r = random.Random(7)
    base = ["".join(r.choice("abcdeßéÿÀ×") for _ in range(r.randint(6, 9))) for _ in range(40)]

    def edited(w):
        k = r.randrange(len(w))
        return r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abcé") + w[k + 1:], w[:k] + r.choice("abcé") + w[k:]])

    pool = [w for b in base for w in [b] * 60 + [e for e in (edited(b), edited(edited(b))) for _ in range(r.choice([4, 6, 12]))]]
    pool += ["aaaaaa"] * 9 + ["aaaaaaa"] * 50 + ["a" * 300] * 5 + ["a" * 299] * 25 + ["abcabc"] * 5 + ["abccab"] * 30
    pool += ["kkkkkk"] * 5 + ["kkkkkkl"] * 30 + ["kkkkkkll"] * 170
    r.shuffle(pool)
    rows = [(k if k % 7 else None, " ".join(w.upper() if r.random() < 0.1 else w for w in pool[k::50])) for k in range(50)]
    rows += [*MESSY, (1, None)]
    got = spelling.spelling_variants(variants(spark, rows).withColumn("near", F.lit("x")), tile=tile)
    want = brute.spelling(rows)
    assert listed(got) == want and sum(w[1] is not None for w in want) > 10 and any(w[1] != w[2] and w[1] for w in want)


def test_variants_query_against_brute_force(spark):
    assert listed(QUERIES["op12_spelling_variants"](spark, SF)) == brute.spelling(rows_of(spark))


def test_variants_of_an_empty_table(spark):
    assert variants(spark, []).count() == 0 == spelling.spelling_variants(variants(spark, [])).count()
    nothing = spark.createDataFrame([(None,), (None,)], "w string")
    assert spelling.vocabulary(nothing, 1).count() == 0


def test_large_blocks_are_compared_tile_by_tile(spark):
    vocab = spark.createDataFrame([("".join(p), k + 1) for k, p in enumerate(
        sorted({"".join(random.Random(s).sample("abcdefgh", 7)) for s in range(400)}))], "word string, n long")
    whole, tiled = (listed(spelling.near_words(vocab, Scratch(spark, "near"), tile)) for tile in (1024, 2))
    assert whole == tiled and len(whole) == len(set(whole))


# 13
def test_infill_on_messy_rows(spark):
    rows = MESSY + [(200 + k, t) for k, t in enumerate(ODD)] + [(300, "a <P> b"), (301, "<<S"), (302, "x<S>"), (303, "\0<M")]
    docs = table(spark, rows).withColumn("fim", F.lit("other"))
    made = infill.fill_in_middle(docs)
    assert made.columns == [*COLUMNS, "fim"]
    assert listed(made.select("doc_id", "fim.*")) == brute.infill(rows)
    back = made.select("text", infill.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert infill.fill_in_middle(table(spark, [])).count() == 0
    assert {c: made.first()[c] for c in CLASHES} == dict.fromkeys(CLASHES, "other")


def test_infill_by_words(spark):
    rows = [(k, f"start {words(k, k % 50)} <end>\n") for k in range(200)] + [(900, LONG)]
    made = infill.fill_in_middle(table(spark, rows), unit=r"\S+\s*").collect()
    for r in made:
        assert r.fim.n == len(re.findall(r"\S+\s*", r.text))
        if r.fim.form != "plain":
            cut = {0, *(m.end() for m in re.finditer(r"\S+\s*", r.text))}
            assert {r.fim.prefix_chars, r.fim.prefix_chars + r.fim.middle_chars} <= cut
    assert {r.fim.form for r in made} == {"plain", "psm", "spm"}


def test_skip_list_reaches_every_rank():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 500):
        width = r.integers(0, 9, n)
        units = infill.SkipList(width)
        assert [units.chars_before(k) for k in range(n + 1)] == [0, *np.cumsum(width)]
    deep = infill.SkipList(np.ones(200_000, np.int64))
    assert len(deep.lanes) > 6 and all(deep.chars_before(int(k)) == k for k in r.integers(0, 200_001, 200))
