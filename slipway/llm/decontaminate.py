"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A window is a set of shingles at known offsets. To contain a window, a document must contain its rarest shingle, so
that one shingle is the window's whole prefix. Documents meet windows on that shingle only; the offset then says where
the window must lie, positions and lengths say whether it fits, and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from slipway.llm import text as T
from slipway.llm.common import Scratch, without_rows

WINDOW = 10
SHINGLE = 5  # words of a shingle; a window of fewer words is one shingle
FILTER_BITS = 1 << 23  # 1 MB: the fixed size of the shingle filter sent to all tasks
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _shingle_rows(column: pa.Array, sizes: tuple[int, ...]):
    """All shingles of the given sizes: hash, text index, position of its first word in the text; words per text."""
    h, first = T.words(column, T.ALNUM)
    hashes, owners, at = [], [], []
    for n in sizes:
        g, o = T.grams(h, first, n)
        hashes.append(g)
        owners.append(o)
        count = np.maximum(np.diff(first) - n + 1, 0)
        at.append(np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(hashes, np.uint64), cat(owners, np.int64), cat(at, np.int64), np.diff(first)


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of every item with their words: item, window (array of words)."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                          "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("s")).select(
        "item", F.slice("w", F.col("s"), F.lit(WINDOW)).alias("window")).distinct()


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("window").to_pylist()
        texts = pa.array([" ".join(w) for w in lists])
        h, owner, at, _ = _shingle_rows(texts, tuple(range(1, SHINGLE + 1)))
        size = np.concatenate([np.full(max(len(w) - n + 1, 0), n) for n in range(1, SHINGLE + 1) for w in lists]
                              or [np.zeros(0, int)])
        keep = size == np.minimum([len(w) for w in lists], SHINGLE)[owner] if len(lists) else size == 0
        take = pa.array(owner[keep])
        yield pa.record_batch([batch.column("item").take(take), batch.column("window").take(take),
                               pa.array(h[keep].view(np.int64)), pa.array(at[keep], pa.int32()),
                               pa.array(size[keep], pa.int32())], names=["item", "window", "h", "offset", "size"])


def _filter(shingles: DataFrame) -> np.ndarray:
    """Shingle hashes as a bitmap of FILTER_BITS bits, merged from the partitions' bitmaps word by word."""
    words = shingles.select(F.pmod("h", F.lit(FILTER_BITS)).alias("s")).groupBy(F.expr("shiftright(s, 6)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        out[r.w] = r.b
    return out


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = (h.view(np.int64) % FILTER_BITS)
    return np.flatnonzero((bits[s >> 6] >> (s & 63)) & 1)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per distinct (id, text): id, row (xxhash64 of the text), n_words, n_hit, items (sorted array of item ids as strings).

    ``n_hit`` counts the words inside any occurrence of any window, ``items`` names the items with such windows.

    Null and empty texts have no words and no hits; items without words have no windows; an item with a null id is
    named by the empty string. Repeated document rows give one row, repeated items change nothing. An empty benchmark
    leaves every document clean. Other columns are not read, whatever their names.

    Shingle frequencies are counted over all documents. The windows' shingles reach the tasks as a filter of fixed
    size; what passes is joined with the windows on the shingle, so a benchmark of any size gives the same result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    sc = spark.sparkContext
    # ``row`` tells apart rows that share an id.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"),
                        F.col(text_col).alias("text"))
    shingles = scratch.table(item_windows(benchmark, item_col, item_text).mapInArrow(
        _window_shingles, "item string, window array<string>, h long, offset int, size int"))
    sizes = tuple(sorted(r.size for r in shingles.select("size").distinct().collect()))  # at most SHINGLE values
    sent = sc.broadcast(_filter(shingles.select("h").distinct()))

    def count(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, owner, _, _ = _shingle_rows(part.column("text"), sizes)
                k = _passing(sent.value, h)
                pairs = np.unique(np.stack([owner[k], h[k].view(np.int64)]), axis=1)
                value, n = np.unique(pairs[1], return_counts=True)
                yield pa.record_batch([pa.array(value), pa.array(n)], names=["h", "n"])

    # Document frequency of every window shingle; shingles that no document has cannot be a prefix that is met.
    frequency = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ranked = shingles.join(frequency, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = scratch.table(ranked.groupBy("item", "window").agg(
        F.min(F.struct("n", "h", "offset", "size")).alias("p")).filter("p.n > 0").select(
        "item", "window", "p.h", "p.offset", F.size("window").alias("len")))
    probe = sc.broadcast(_filter(prefix.select("h").distinct()))

    def candidates(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield _candidate_rows(part, sizes, probe.value)

    found = scratch.table(texts.mapInArrow(
        candidates, "id long, row long, n_words long, hits array<struct<h:long,pos:int,base:int,ctx:string>>"))
    sent.destroy()
    probe.destroy()
    met = found.select("id", "row", "n_words", F.explode("hits").alias("c")).select(
        "id", "row", "n_words", "c.h", "c.pos", "c.base", F.split("c.ctx", " ").alias("ctx"))
    start = F.col("pos") - F.col("offset")
    placed = met.join(prefix, "h").withColumn("start", start).filter(
        "start >= 0 and start + len <= n_words and slice(ctx, start - base + 1, len) = window")
    spots = placed.groupBy("id", "row", "start").agg(F.max("len").alias("len"), F.collect_set("item").alias("items"))
    # Words covered by the union of occurrences: what each adds beyond the furthest end before it. One text's
    # occurrences are at most its words.
    before = F.max(F.col("start") + F.col("len")).over(
        W.partitionBy("id", "row").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    per_doc = spots.withColumn("added", added).groupBy("id", "row").agg(
        F.sum("added").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    all_docs = found.select("id", "row", "n_words").distinct()
    return all_docs.alias("d").join(per_doc.alias("p"), F.expr("d.id <=> p.id and d.row = p.row"), "left").select(
        "d.id", "d.row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _candidate_rows(part: pa.RecordBatch, sizes: tuple[int, ...], bits: np.ndarray) -> pa.RecordBatch:
    """Per text its words and, for each possible prefix shingle, its place and the words around it."""
    buf, offsets = T.flat(part.column("text"))
    starts, ends = T.spans(buf, offsets, T.ALNUM)
    first = np.searchsorted(starts, offsets)
    h, owner, pos, n_words = _shingle_rows(part.column("text"), sizes)
    k = _passing(bits, h)
    k = k[np.lexsort((pos[k], owner[k]))]
    base = np.maximum(pos[k] - WINDOW + 1, 0)
    stop = np.minimum(pos[k] + WINDOW, n_words[owner[k]])
    lower = buf.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    context = []
    for o, a, b in zip(owner[k], base, stop):
        lo = first[o]
        context.append(b" ".join(lower[starts[w]:ends[w]].tobytes() for w in range(lo + a, lo + b)).decode())
    hits = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner[k], np.arange(part.num_rows + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(h[k].view(np.int64)), pa.array(pos[k], pa.int32()),
                                    pa.array(base, pa.int32()), pa.array(context, pa.string())],
                                   names=["h", "pos", "base", "ctx"]))
    return pa.record_batch([part.column("id"), part.column("row"), pa.array(n_words, pa.int64()), hits],
                           names=["id", "row", "n_words", "hits"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns stay as they are.

    Decided for each (id, text): a clean text stays whatever other rows share its id, and repeated rows stay or go
    together. Null and empty texts stay, null ids are treated like others. An empty table gives no rows.
    """
    hit = contamination(docs, benchmark, id_col, text_col).filter("n_hit > 0").select("id", "row")
    return without_rows(docs, hit, id_col, F.xxhash64(text_col))
