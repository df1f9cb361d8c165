"""N-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole), and its groups.

Sets fall into size bands, each 1.25 times as wide as the last. A linked pair whose smaller set lies in band j differs
in at most H tokens, a number fixed by the band. The tokens are hashed into m segments. Give each segment a threshold
t in {-1, 0, 1}: if the thresholds plus one add up to H + 1 or more, some segment differs by at most its t. So a
document looks up, per segment, nothing (-1), its exact subset (0), or the subset and its one-deletion neighbourhood
(1), and which of the three is chosen by cost: segments without any rare token are skipped as long as the others make
up for it. Every document can be found by every signature, so two documents need not choose alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as _count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from slipway.llm import text as T
from slipway.llm.common import Scratch, bitmap, in_bitmap, without_rows
from slipway.llm.graph import components

N_WORDS = 5
HOT_TOKENS = 1 << 18  # the most frequent shingles, which steer the choice of segments: at most 4 MB with their counts
HOT_LEAST = 2  # a shingle is counted for it in slices where so many documents have it
SLICE = 4 << 20  # texts whose signatures are grouped before they are dealt out
ROUNDS = 2  # of comparisons with one set per signature, before all sets of different components are compared
ROWS = 8000  # and their number: an entry's number must fit 15 bits, and a text has three entries at most
_U = np.uint64
SKETCH = _U(0x2545F4914F6CDD1D)  # salt of the sketches


def _bands() -> Iterator[tuple[int, int]]:
    low = 1
    for _ in _count():
        yield low, low * 5 // 4
        low = low * 5 // 4 + 1


class Scheme:
    """Band j: ``high`` is its largest smaller set, ``largest`` its largest set, ``h`` the most differing tokens."""

    def __init__(self, j: int, low: int, high: int):
        self.j, self.low, self.high, self.largest = j, low, high, high * 5 // 4
        self.h = (high + self.largest) // 9  # 100 * both >= 80 * either, so at most a ninth of the sizes' sum differs
        self.m = self.h + 1 + (self.h + 1) // 5  # a sixth of the segments may be skipped
        self.near = self.m if self.m <= 8 else -(-self.m // 32)  # leading segments with deletion neighbourhoods
        self.salt = _U(0x5851F42D4C957F2D * (j + 1) & (1 << 64) - 1)


def schemes(largest: int) -> list[Scheme]:
    out = []
    for j, (low, high) in enumerate(_bands()):
        if low > largest:
            return out
        out.append(Scheme(j, low, high))
    return out


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ordered by text and hash, and the offset of each text's first."""
    h, first = T.words(column, T.NONSPACE)
    g, owner = T.grams(h, first, N_WORDS, short=True)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(column) + 1))


def _set_hash(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([_U(0)], np.cumsum(T.mix(g ^ _U(0xA5A5)), dtype=np.uint64)))
    size = np.diff(first).astype(np.uint64)
    return T.mix(total[first[1:]] - total[first[:-1]] + size * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(g: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per set a bitmap of four to eight bits a token: a bit says whether an odd number of tokens fall on it.

    Two sets' bitmaps differ in no more bits than the sets differ in tokens. The number of bits is a power of two, so a
    bitmap folds to half its width by xor of its halves.
    """
    size = np.diff(first)
    words = 1 << np.ceil(np.log2(np.maximum(4 * size, 256))).astype(np.int64) - 6
    start = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(size)), size)
    bit = T.mix(g ^ SKETCH) & (words[owner] * 64 - 1).astype(np.uint64)
    out = np.zeros(start[-1], np.uint64)
    np.bitwise_xor.at(out, start[owner] + (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(out.view(np.int64)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size, hash and sketch (kind 0); per slice its frequent shingles (kind 1)."""
    for parts in T.groups(batches, "text", SLICE, ROWS):
        tokens = []
        for part in parts:
            g, first = shingle_sets(part.column("text"))
            tokens.append(g)
            yield pa.record_batch([pa.array(np.zeros(part.num_rows, np.int8)), part.column("id"), part.column("row"),
                                   pa.array(np.diff(first)), pa.array(_set_hash(g, first)), _sketches(g, first)],
                                  names=["kind", "id", "row", "n", "cls", "sketch"])
        value, times = np.unique(np.concatenate(tokens), return_counts=True)
        hot = times >= HOT_LEAST
        none = pa.nulls(hot.sum(), pa.int64())
        yield pa.record_batch([pa.array(np.ones(hot.sum(), np.int8)), none, none, pa.array(times[hot]),
                               pa.array(value[hot].view(np.int64)), pa.nulls(hot.sum(), pa.list_(pa.int64()))],
                              names=["kind", "id", "row", "n", "cls", "sketch"])


def _signatures(g: np.ndarray, owner: np.ndarray, s: Scheme, n_docs: int, hot: tuple[np.ndarray, np.ndarray]):
    """Signatures of ``n_docs`` sets (tokens ``g`` of ``owner``) under one scheme: signature, set, looked up or not;
    and for each set the number of whole segments that it looks up."""
    value = T.mix(g ^ s.salt)
    cell = owner * s.m + (value % _U(s.m)).astype(np.int64)
    total = np.zeros(n_docs * s.m, np.uint64)
    np.add.at(total, cell, value)
    # A segment costs as much as its rarest token is frequent; an empty one is the most expensive.
    often = np.zeros(len(g), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], g), len(hot[0]) - 1)
        often = np.where(hot[0][at] == g, hot[1][at], 0)
    cost = np.full(n_docs * s.m, np.iinfo(np.int64).max)
    np.minimum.at(cost, cell, often)
    rare = cost == 0
    name = np.tile(T.mix(np.arange(s.m, dtype=np.uint64) * _U(31) + s.salt), n_docs)
    full = T.mix(total + name)
    # All segments with a rare token are looked up. Where they are too few, so are their one-deletion neighbourhoods;
    # where these do not do either, as many of the cheapest other segments as are missing.
    near = np.tile(np.arange(s.m) < s.near, n_docs)
    per_doc = lambda x: x.reshape(n_docs, s.m).sum(1)
    by_near = per_doc(rare) < s.h + 1
    wanted = s.h + 1 - np.where(by_near, per_doc(rare & near), 0)
    rank = np.empty((n_docs, s.m), np.int64)
    np.put_along_axis(rank, np.argsort(cost.reshape(n_docs, s.m), axis=1, kind="stable"), np.arange(s.m)[None, :], axis=1)
    asked = rare | (rank < wanted[:, None]).ravel()
    inside = np.flatnonzero(near[cell])
    without = T.mix(total[cell[inside]] - value[inside] + name[cell[inside]])
    return (np.concatenate([full, without]), np.concatenate([np.repeat(np.arange(n_docs), s.m), owner[inside]]),
            np.concatenate([asked, by_near[owner[inside]] & rare[cell[inside]]]), per_doc(asked))


def _slice_signatures(parts: list[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray]):
    """All signatures of a slice's distinct sets: signature, entry, looked up or not. An entry is a set under a scheme:
    its class, and in one number the scheme and how many whole segments it looks up."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    entries, base, known = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))], 0, np.zeros(0, np.int64)
    for part in parts:
        g, first = shingle_sets(part.column("text"))
        cls, sizes = _set_hash(g, first), np.diff(first)
        _, one = np.unique(cls, return_index=True)
        one = one[(sizes[one] > 0) & ~np.isin(cls[one], known)]
        known = np.concatenate([known, cls[one]])
        for s in schemes(int(sizes.max(initial=0))):
            rows = one[(sizes[one] >= s.low) & (sizes[one] <= s.largest)]
            if s.h == 0 or not len(rows):  # sets of the smallest sizes link only when equal
                continue
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            tokens = g[np.repeat(first[rows] - np.cumsum(sizes[rows]) + sizes[rows], sizes[rows]) + np.arange(len(owner))]
            sig, doc, asked, lookups = _signatures(tokens, owner, s, len(rows), hot)
            out.append((sig, doc + base, asked))
            entries.append((cls[rows], ((s.j << 24) + np.minimum(lookups, (1 << 24) - 1)).astype(np.uint32)))
            base += len(rows)
    return (*(np.concatenate(x) for x in zip(*out)), *(np.concatenate(x) for x in zip(*entries)))


_BLOB = "bucket long, sigs binary, who binary, cls binary, info binary"
_MET = "sig long, cls long, pivot long, asked boolean, local boolean, low int, lookups int"


def _index(hot_sent, buckets: int):
    """Signatures in blobs, one per bucket and slice. Of a slice's sets with one signature only the first goes to the
    signature's bucket; the others are listed in a local blob (negative bucket), so no signature gathers all its sets.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in T.groups(batches, "text", SLICE, ROWS):
            sig, row, asked, cls, info = _slice_signatures(parts, hot_sent.value)
            order = np.lexsort((row, sig))
            sig, row, asked = sig[order], row[order], asked[order]
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            group = np.cumsum(head) - 1
            any_asked = np.bincount(group, asked, minlength=1) > 0 if len(sig) else asked
            several = np.bincount(group)[group] > 1 if len(sig) else head
            rows = []
            who = (row + 32768 * asked).astype(np.uint16)
            if several.any():
                rows.append((-1 - int(sig[0] % _U(buckets)), sig[several], who[several]))
            sig, who = sig[head], (row[head] + 32768 * any_asked).astype(np.uint16)
            bucket = (sig % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows += [(b, sig[order[x:y]], who[order[x:y]])
                     for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            out = [(b, x.tobytes(), y.tobytes(), cls.tobytes(), info.tobytes()) for b, x, y in rows]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 5, [pa.int64()] + [pa.binary()] * 4)],
                names=["bucket", "sigs", "who", "cls", "info"])

    return blobs


def _meet(table: pa.Table) -> pa.Table:
    """Sets that share a signature, with the signature's smallest set here as pivot."""
    out, lows = [], np.array([s.low for s in schemes(1 << 40)])
    local = table.num_rows > 0 and table.column("bucket")[0].as_py() < 0
    parts = [table.slice(k, 1) for k in range(table.num_rows)] if local else [table]
    for part in parts:  # local blobs are groups of their own slice
        sigs, clss, asks, infos = [], [], [], []
        for s, w, c, i in zip(*(part.column(k) for k in ("sigs", "who", "cls", "info"))):
            who = np.frombuffer(w.as_py(), np.uint16)
            sigs.append(np.frombuffer(s.as_py(), np.uint64))
            clss.append(np.frombuffer(c.as_py(), np.int64)[who & 32767])
            infos.append(np.frombuffer(i.as_py(), np.uint32)[who & 32767])
            asks.append(who >= 32768)
        sig, cls, asked, info = (np.concatenate(x) for x in (sigs, clss, asks, infos))
        order = np.lexsort((cls, sig))
        sig, cls, asked, info = sig[order], cls[order], asked[order], info[order]
        head = np.ones(len(sig), bool)
        head[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        asked = np.maximum.reduceat(asked, np.flatnonzero(head))
        sig, cls, info = sig[head], cls[head], info[head]
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        start, group = np.flatnonzero(head), np.cumsum(head) - 1
        keep = np.bincount(group)[group] > 1
        if not local:  # nobody looks this signature up
            keep &= np.maximum.reduceat(asked, start)[group]
        out.append(pa.table([pa.array(sig[keep].view(np.int64)), pa.array(cls[keep]), pa.array(cls[start][group][keep]),
                             pa.array(asked[keep]), pa.array(np.full(keep.sum(), local)),
                             pa.array(lows[info[keep] >> 24], pa.int32()),
                             pa.array((info[keep] & 0xFFFFFF).astype(np.int32))],
                            names=["sig", "cls", "pivot", "asked", "local", "low", "lookups"]))
    T.release()
    return pa.concat_tables(out)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.slices(batch, "text"):
            g, first = shingle_sets(part.column("text"))
            packed = [g[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch([part.column("id"), pa.array(_set_hash(g, first)), pa.array(packed, pa.binary())],
                                  names=["id", "cls", "tokens"])


def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= 80 * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes that really link."""
    left = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    both = left.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    return scratch.table(both.filter(F.arrow_udf(_linked, "boolean")("ta", "tb")).select("a", "b"))


def _needed_sets(texts: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Token sets of the classes in ``pairs``, each read from its first document."""
    cls = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    first = scratch.table(classes.join(cls, "cls", "left_semi").select("rep"))
    some = texts.filter(in_bitmap(bitmap(first, scratch), F.col("id")))
    read = some.mapInArrow(_sets, "id long, cls long, tokens binary")
    return scratch.table(read.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi")
                         .dropDuplicates(["cls"]).select("cls", "tokens"))


def _may_link(a: str, b: str, n: str) -> str:
    """Whether sketches ``a`` and ``b`` of sets of ``n`` tokens together leave a link possible: linked sets differ in at
    most a ninth of their tokens."""
    k = f"least(size({a}), size({b}))"
    fit = lambda s: f"if(size({s}) > {k}, {_fold(s, k)}, {s})"
    return f"aggregate(zip_with({fit(a)}, {fit(b)}, (p, q) -> bit_count(p ^ q)), 0, (t, v) -> t + v) <= ({n}) div 9"


def _fold(s: str, k: str) -> str:
    """Sketch ``s`` of twice ``k`` words at half its width."""
    return f"zip_with(slice({s}, 1, {k}), slice({s}, {k} + 1, {k}), (p, q) -> p ^ q)"


def _promising(pairs: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""
    side = lambda k: sketches.select(F.col("cls").alias(k), F.struct("sketch", "n").alias(f"s{k}"))
    return scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").filter(
        F.expr(_may_link("sa.sketch", "sb.sketch", "sa.n + sb.n"))).select("a", "b"))


def _fits(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= 80 * greatest({a}, {b})"


#: The scheme of a pair is that of its smaller set's band.
_IN_BAND = "least({a}, {b}) between {low} and {low} * 5 div 4"


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row (xxhash64 of the text), n_shingles, component (the smallest id reachable by links,
    its own included).

    A document's set holds its distinct 5-word shingles (lower-cased; a shorter text is one shingle). Two documents
    link when 100 * intersection >= 80 * union. Sets are compared as 64-bit shingle hashes.

    Null and empty texts have no shingles and link with nothing, so their component is their own id. Repeated rows
    give repeated results. Null ids take part, but never name a component that has an id; a text whose every row has
    a null id has a null component. An empty table gives no rows. Other columns are not read.

    Equal sets form one class and are compared once. The first rounds compare each class with one other that shares a
    signature, another in each round; the last compares every two classes that share a looked-up signature, are not yet
    in one component, and whose sketches (``_sketches``) differ in no more bits than linked sets may differ in tokens.
    So a group of n near copies costs about n comparisons, a family of texts that resemble but do not link is told
    apart in the join, and no link between components is lost.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"),
                        F.col(text_col).alias("text"))
    seen = scratch.table(texts.mapInArrow(_describe, "kind byte, id long, row long, n long, cls long, sketch array<long>"))
    texts = texts.select("id", "text")
    hot = seen.filter("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(HOT_TOKENS)
    hot = hot.toArrow()
    tokens, times = hot.column("cls").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(tokens)
    sent = spark.sparkContext.broadcast((tokens[order], times[order]))
    members = seen.filter("kind = 0")
    classes = scratch.table(members.filter("n > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.first("n").alias("n")).filter("rep is not null"))
    sketches = scratch.table(members.join(classes.select("cls", F.col("rep").alias("id")), ["cls", "id"], "left_semi")
                             .select("cls", "n", "sketch").dropDuplicates(["cls"]))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = scratch.table(texts.mapInArrow(_index(sent, buckets), _BLOB).groupBy("bucket").applyInArrow(
        _meet, _MET))
    sent.destroy()
    scratch.settle()
    # Local groups count where a set of their slice, or of another slice, looks the signature up.
    looked = scratch.table(met.filter("not local or asked").select("sig").distinct())
    known = scratch.table(met.join(looked, "sig", "left_semi").groupBy("sig", "cls").agg(
        F.max("asked").alias("asked"), F.first("low").alias("low"), F.max("lookups").alias("lookups")))
    scratch.drop(met, looked)
    scratch.settle()

    links = spark.createDataFrame([], "a long, b long")
    groups = classes.select("cls", "n", F.col("rep").alias("component"))
    rest = _unsettled(known, groups, scratch)
    scratch.drop(known)
    used = spark.createDataFrame([], "cls long, used boolean")
    for _ in range(ROUNDS):
        # The set that shares most with others is likely the one the others were copied from; each round takes new ones.
        pivots = scratch.table(rest.join(used, "cls", "left").groupBy("sig").agg(F.max_by(
            F.struct("cls", "n", "component"), F.struct(F.col("used").isNull(), "central", "cls")).alias("p")))
        used = scratch.table(used.unionByName(pivots.select("p.cls", F.lit(True).alias("used"))).distinct())
        star = rest.join(pivots, "sig").filter(
            f"component <> p.component and {_fits('n', 'p.n')} and {_IN_BAND.format(a='n', b='p.n', low='low')}")
        pairs = scratch.table(star.groupBy("cls", F.col("p.cls").alias("a")).agg(
            F.count_if("asked").alias("shared"), F.max("lookups").alias("lookups"),
            F.expr("first(n + p.n) div 9").alias("differ")).filter("shared >= lookups - differ").select(
            "a", F.col("cls").alias("b")))
        pairs = _promising(pairs, sketches, scratch)
        links = scratch.table(links.unionByName(_verified(pairs, _needed_sets(texts, classes, pairs, scratch), scratch)))
        groups = _labels(links, classes, scratch)
        before, rest = rest, _unsettled(rest.select(*known.columns), groups, scratch)
        scratch.drop(before, pivots)
        scratch.settle()

    # The join carries sketches at a quarter of their width; the pairs that it leaves are tested at the whole width.
    narrow = sketches.withColumn("sketch", F.expr(_fold("sketch", "cast(size(sketch) / 2 as int)"))).withColumn(
        "sketch", F.expr(_fold("sketch", "cast(size(sketch) / 2 as int)")))
    rest = scratch.table(rest.drop("central").join(narrow.select("cls", "sketch"), "cls"))
    x, y = rest.alias("x"), rest.alias("y")
    meet = x.join(y, F.expr(
        "x.sig = y.sig and x.cls < y.cls and x.component <> y.component and (x.asked or y.asked) and "
        f"{_fits('x.n', 'y.n')} and {_IN_BAND.format(a='x.n', b='y.n', low='x.low')} and "
        f"{_may_link('x.sketch', 'y.sketch', 'x.n + y.n')}"))
    more = scratch.table(meet.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(
        F.count_if("x.asked").alias("sx"), F.count_if("y.asked").alias("sy"), F.max("x.lookups").alias("lx"),
        F.max("y.lookups").alias("ly"), F.expr("first(x.n + y.n) div 9").alias("differ")).filter(
        "sx >= lx - differ and sy >= ly - differ").select("a", "b"))
    more = _promising(more, sketches, scratch)
    links = links.unionByName(_verified(more, _needed_sets(texts, classes, more, scratch), scratch))
    groups = _labels(links, classes, scratch)

    result = members.join(groups.select("cls", "component"), "cls", "left")
    return result.select("id", "row", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def _unsettled(met: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Signatures that sets of several components share, with these sets' sizes, components and how central they are.

    A looked-up segment of a set is spoilt by a differing token, so of the looked-up segments all but as many as a pair
    may differ in must be shared. Sets that share too few with all other components together link with none of them.
    """
    labelled = scratch.table(met.join(groups, "cls"))
    mixed = scratch.table(labelled.groupBy("sig").agg(
        F.min("component").alias("c"), F.max("component").alias("d"), F.max("asked").alias("asked"),
        F.count("*").alias("sharing")).filter("c <> d and asked").select("sig", "sharing"))
    rest = scratch.table(labelled.join(mixed, "sig"))
    alive = scratch.table(rest.groupBy("cls", "low").agg(
        F.count_if("asked").alias("shared"), F.max("lookups").alias("lookups"), F.first("n").alias("n"),
        F.sum("sharing").alias("central")).filter(
        # The partner of a set in the band has at most 1.25 times its size; that of a larger set lies in the band.
        "shared >= lookups - (n + if(n <= low * 5 div 4, n * 5 div 4, low * 5 div 4)) div 9").select("cls", "low", "central"))
    out = scratch.table(rest.drop("sharing").join(alive, ["cls", "low"]))
    scratch.drop(labelled, mixed, rest, alive)
    return out


def _labels(links: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """cls, n, component (the smallest id of the classes it can reach) of every class. Classes that share an id without a
    link stay apart."""
    found = components(links, scratch)
    linked = scratch.table(classes.join(found, classes.cls == found.node).select("cls", "n", "rep", "component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    alone = classes.join(found, classes.cls == found.node, "left_anti").select("cls", "n", F.col("rep").alias("component"))
    return scratch.table(linked.join(least, "component").select("cls", "n", F.col("least").alias("component")).unionByName(alone))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay as they are.

    Decided for each (id, text): a text that links with nothing stays whatever other rows share its id, and repeated
    rows stay or go together. Null and empty texts stay; a row with a null id goes if a row with an id has the same set
    of shingles. An empty table gives no rows.
    """
    gone = jaccard_groups(docs, id_col, text_col).filter("id is distinct from component").select("id", "row")
    return without_rows(docs, gone, id_col, F.xxhash64(text_col))
