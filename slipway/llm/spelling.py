"""Spelling variants: words one edit apart, found by Gram matrices of letter counts inside blocks of near lengths.

The squared distance of two words' letter counts, |a|^2 + |b|^2 - 2ab, is 2 if one letter is replaced and 1 if one is
inserted or deleted, so one matrix product per block leaves few pairs whose letters are compared in order. A block holds
words of two adjacent lengths whose counts agree in two of four groups of letters: one edit changes the counts of at most
two letters, so of the four groups two are untouched, and every near pair shares a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slipway.llm import text as T
from slipway.llm.common import Scratch

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF
GROUPS = 4
COMBINATIONS = list(combinations(range(GROUPS), 2))
TILE = 1024  # words of a block that meet in one task at a time; larger blocks are compared tile by tile
CELLS = 1 << 22  # letters laid out in one matrix
_U = np.uint64


def runs(docs: DataFrame, text_col: str = "text", least_chars: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per letter run of ``least_chars`` letters or more: the columns ``keep`` and ``run``, with A-Z lower-cased.
    Null and empty texts have none."""
    upper = "".join(map(chr, range(65, 91)))
    cut = F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))
    long = F.filter(cut, lambda w: F.length(w) >= least_chars)
    return docs.select(*keep, F.explode(long).alias("run")).withColumn("run", F.translate("run", upper, upper.lower()))


def vocabulary(words: DataFrame, least_count: int = 5) -> DataFrame:
    """word, n of the words (first column; nulls are left out) that occur ``least_count`` times or more."""
    return words.toDF("word").filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).filter(
        F.col("n") >= least_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the words; the owner and the number (0 to 89) of each letter."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return size, np.repeat(np.arange(len(words)), size), np.where(code < 128, code - 97, code - 192 + 26)


def _group_sums(owner: np.ndarray, letter: np.ndarray, n: int, group: np.ndarray) -> np.ndarray:
    """Per word and letter group a number that equal counts of its letters share (others by a chance of 2**-64)."""
    weight = T.mix(np.arange(1, LETTERS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    out = np.zeros((n, GROUPS), np.uint64)
    np.add.at(out, (owner, group[letter]), weight[letter])
    return out


_KEYED = "low int, block long, word string, n long"


def _keyed(group: np.ndarray):
    """Every word with the blocks it stands in: for each pair of letter groups, with words as long and one longer, and
    with words as long and one shorter."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            size, owner, letter = _letters(words)
            sums = _group_sums(owner, letter, len(words), group)
            for k, (x, y) in enumerate(COMBINATIONS):
                both = T.mix(sums[:, x] * _U(3) + T.mix(sums[:, y] + _U(k)))
                for low in (size, size - 1):
                    block = T.mix(both + low.astype(np.uint64)).view(np.int64)
                    yield pa.record_batch([pa.array(low, pa.int32()), pa.array(block), batch.column("word"),
                                           batch.column("n")], names=["low", "block", "word", "n"])

    return work


_ROWS = "low int, block long, t1 int, t2 int, own int, word string, n long"
_PAIRS = "word string, near string, near_n long"


def _near(group: np.ndarray):
    """Near pairs, in both directions, of rows sorted by low, block, t1 and t2."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= TILE:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = _starts(table)
                last = int(starts[-1])  # the block that may go on in the next batch waits
                if last:
                    yield from _compared(table.slice(0, last), starts[:-1], group)
                held = table.slice(last).to_batches()
                count = table.num_rows - last
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _compared(table, _starts(table), group)

    return work


def _starts(table: pa.Table) -> np.ndarray:
    keys = [table.column(c).to_numpy() for c in ("low", "block", "t1", "t2")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _compared(table: pa.Table, starts: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Several small blocks share a matrix; a larger one has its own."""
    ends = np.append(starts[1:], table.num_rows)
    several = ends - starts > 1
    starts, ends = starts[several], ends[several]
    low = table.column("low").to_numpy()
    a = 0
    while a < len(starts):
        b, rows = a + 1, ends[a] - starts[a]
        while b < len(starts) and rows + ends[b] - starts[b] <= TILE and (rows + ends[b] - starts[b]) * (
                low[starts[b]] + 1) <= CELLS:
            rows += ends[b] - starts[b]
            b += 1
        at = np.concatenate([np.arange(x, y) for x, y in zip(starts[a:b], ends[a:b])])
        block = np.repeat(np.arange(b - a), (ends - starts)[a:b])
        yield _pairs(table.take(pa.array(at)), block, group)
        a = b


def _pairs(table: pa.Table, block: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    words = table.column("word").to_pylist()
    low, own, t1, t2 = (table.column(c).to_numpy() for c in ("low", "own", "t1", "t2"))
    n = len(words)
    size, owner, letter = _letters(words)
    counts = np.bincount(owner * LETTERS + letter, minlength=n * LETTERS).reshape(n, LETTERS)
    counts = counts.astype(np.float32 if size.max() < 2048 else np.float64)  # products stay exact
    square = (counts * counts).sum(1)
    distance = square[:, None] + square[None, :] - 2 * (counts @ counts.T)
    lower = size == low  # of two words of one length or of adjacent lengths the first is of the lower length
    ok = lower[:, None] & (distance == np.where(lower, 2, 1)[None, :]) & (block[:, None] == block[None, :])
    i, j = np.nonzero(ok)
    keep = ~lower[j] | (i < j)
    # Two tiles meet in full, each of them by itself in its own task.
    keep &= np.where(t1[i] == t2[i], True, own[i] != own[j])
    i, j = i[keep], j[keep]
    # A pair counts in the first block that it shares.
    sums = _group_sums(owner, letter, n, group)
    agree = sums[i] == sums[j]
    first = np.argmax(np.stack([agree[:, x] & agree[:, y] for x, y in COMBINATIONS], 1), axis=1) if len(i) else i
    here = _combination(table, low, sums)
    i, j = i[first == here[i]], j[first == here[i]]
    near = _one_edit(words, size, i, j)
    i, j = i[near], j[near]
    word, count = table.column("word"), table.column("n")
    x, y = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    columns = [word.take(x), word.take(y), count.take(y)]
    return pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns],
                           names=["word", "near", "near_n"])


def _combination(table: pa.Table, low: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Which pair of letter groups each row's block was made from."""
    block = table.column("block").to_numpy().view(np.uint64)
    out = np.zeros(len(block), np.int64)
    for k, (x, y) in enumerate(COMBINATIONS):
        both = T.mix(sums[:, x] * _U(3) + T.mix(sums[:, y] + _U(k)))
        out[T.mix(both + low.astype(np.uint64)) == block] = k
    return out


def _one_edit(words: list[str], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, j as long or one longer, differ by exactly one code point: what they share in front and
    what they share at the end leave at most one letter of the longer word."""
    if not len(i):
        return np.zeros(0, bool)
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = back[:len(i)], back[len(i):]
    front = _rows([words[k] for k in used])
    end = _rows([words[k][::-1] for k in used])
    return _shared(front, x, y) + _shared(end, x, y) >= size[j] - 1


def _rows(words: list[str]) -> np.ndarray:
    a = np.array(words)
    return a.view(np.uint32).reshape(len(a), -1)


def _shared(letters: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows x and y, which are never equal."""
    out = np.zeros(len(x), np.int64)
    step = max(CELLS // max(letters.shape[1], 1), 1)
    for k in range(0, len(x), step):
        out[k:k + step] = np.argmax(letters[x[k:k + step]] != letters[y[k:k + step]], axis=1)
    return out


def near_words(vocab: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """word, near, near_n: all pairs of words (word, n) that differ by exactly one code point, in both directions."""
    # The letters' own counts deal them to groups of like weight, so that no group says little about a word.
    often = {r["letter"]: r["n"] for r in vocab.select(F.explode(F.split("word", "")).alias("letter")).groupBy(
        "letter").agg(F.count("*").alias("n")).collect()}  # 90 letters at most
    order = sorted((chr(c) for c in [*range(97, 123), *range(192, 256)]), key=lambda c: (-often.get(c, 0), c))
    group, weight = np.zeros(LETTERS, np.int64), [0] * GROUPS
    for c in order:
        least = weight.index(min(weight))
        group[ord(c) - 97 if c < "\x80" else ord(c) - 192 + 26] = least
        weight[least] += often.get(c, 0) + 1
    keyed = scratch.table(vocab.select("word", "n").mapInArrow(_keyed(group), _KEYED))
    tiles = keyed.groupBy("low", "block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.when(F.col("tiles") == 1, 0).otherwise(F.pmod(F.xxhash64("word"), F.col("tiles"))).cast("int")
    rows = keyed.join(tiles, ["low", "block"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "low", "block", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "word", "n")
    parts = rows.repartition("low", "block", "t1", "t2").sortWithinPartitions("low", "block", "t1", "t2")
    return scratch.table(parts.mapInArrow(_near(group), _PAIRS))


def spelling_variants(vocab: DataFrame, ratio: int = 5, tile: int = TILE) -> DataFrame:
    """One row per word of ``vocab`` (word, n): word, form, root, n, n_near, form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (ties: the smallest in code-point order), if that n is at least ``ratio`` times the word's own;
    root is the end of the chain of forms, the word itself if it has none.

    Words must be distinct, not null, and consist of the letters a-z and U+00C0 to U+00FF, as ``runs`` gives them;
    ``n`` must not be null. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(vocab.sparkSession, "spelling")
    vocab = scratch.table(vocab.select("word", "n"))
    best = near_words(vocab, scratch, tile).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    strong = -F.col("b.m") >= ratio * F.col("n")
    out = scratch.table(vocab.join(best, "word", "left").select(
        "word", F.when(strong, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("b.m")).alias("form_n")))
    # n grows by ``ratio`` with each form, so chains are short, and each round doubles the step.
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.table(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    return out.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
