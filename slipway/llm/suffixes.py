"""Exact repeated passages by a family of sorted suffix indexes of logarithmic size.

Positions are sampled by content, so texts of any size fit: in every 50-byte string the position of its smallest
26-byte hash is the string's anchor, and equal strings have equal anchors. All strings with one anchor position form a
context. The index sorts contexts instead of all suffixes; contexts that share an anchor string but are not equal are
taken apart into their 50-byte strings, which are sorted the same way. They travel as bytes, once, to the bucket of their
anchor and are taken apart there; those of an anchor with very many contexts are dealt out string by string.

Spark deals anchors out by hash. Each bucket is an index family of its own: documents come in batches of rising id, a
batch is sorted, scanned against the levels below, and added as a level; levels of like size merge, so there are never
more than about log2(n) of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slipway.llm import text as T
from slipway.llm.common import Scratch, bitmap, in_bitmap

LENGTH = 50
GRAM = 26
BATCH = 1 << 18  # entries of a batch, the smallest level
GROUP = 24 << 20  # texts whose equal entries are joined before they are dealt out
KEY_BITS = 1 << 28  # 32 MB: the fixed size of the filter of anchors to take apart
HOT_CONTEXTS = 1 << 14  # contexts of an anchor from which its strings are spread over all buckets
HOT_BITS = 1 << 23  # 1 MB: the fixed size of the filter of such anchors
_BLOCK = 1 << 20
_U = np.uint64


class LevelIndex:
    """Sorted runs of (key, first document), merged geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch; returns the first document known to have each key, the batch's own included."""
        order = np.lexsort((docs, keys))
        head = _heads(keys[order])
        run = keys[order][head], docs[order][head]
        first = run[1].copy()
        for level in self.levels:  # both sides are sorted, so this is one scan along them
            at = np.minimum(np.searchsorted(level[0], run[0]), len(level[0]) - 1)
            first = np.where(level[0][at] == run[0], np.minimum(first, level[1][at]), first)
        while self.levels and len(self.levels[-1][0]) <= len(run[0]):
            below = self.levels.pop()
            both = np.concatenate([below[0], run[0]]), np.concatenate([below[1], run[1]])
            merged = np.argsort(both[0], kind="stable")  # the level below holds smaller documents and comes first
            keep = merged[_heads(both[0][merged])]
            run = both[0][keep], both[1][keep]
        self.levels.append(run)
        out = np.empty(len(keys), np.int64)
        out[order] = first[np.cumsum(head) - 1]
        return out


def _heads(x: np.ndarray) -> np.ndarray:
    head = np.ones(len(x), bool)
    head[1:] = x[1:] != x[:-1]
    return head


def first_documents(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every entry the smallest document with its key, found by adding batches of rising document."""
    index, out = LevelIndex(), np.zeros(len(keys), np.int64)
    order = np.argsort(docs, kind="stable")
    for a in range(0, len(order), BATCH):
        batch = order[a:a + BATCH]
        out[batch] = index.add(keys[batch], docs[batch])
    return out


def _sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial over bytes, and the inverse powers that move a stretch of it to the front."""
    r, inv = T.powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + _U(1)) * r[:len(part)], out=total[1:])
    return total, inv


def _hash(total: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return T.mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64) * _U(3))


def strings(data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys of all 50-byte strings of pieces that lie one behind another, each with the bytes of its ``n`` strings.

    The keys are those that ``contexts`` gives to strings. Work goes in blocks of pieces.
    """
    size = n.astype(np.int64) + LENGTH - 1
    to = np.cumsum(size)
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(n):
        low = int(to[a] - size[a])
        b = max(a + 1, int(np.searchsorted(to, low + _BLOCK, "right")))
        total, inv = _sums(data[low:int(to[b - 1])])
        start = _ranges(to[a:b] - size[a:b] - low, n[a:b])
        out.append(_hash(total, inv, start, start + LENGTH))
        a = b
    return np.concatenate(out)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``n`` of them) for each start."""
    n = n.astype(np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def contexts(buf: np.ndarray, offsets: np.ndarray, live=None):
    """All contexts of a flat buffer of texts: first string's start, last string's start, anchor, key, text.

    The key hashes the whole context. With ``live``, a test of anchors, the contexts that pass are taken apart into
    their 50-byte strings, each keyed by its own hash. Work goes in blocks, so one long text needs no more memory than
    many short ones; a context cut by a block's end is two contexts, which changes nothing in the result.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64),
              np.zeros(0, np.int64))]
    for a in range(0, max(len(buf) - LENGTH + 1, 0), _BLOCK):
        b = min(a + _BLOCK, len(buf) - LENGTH + 1)
        part = buf[a:b + LENGTH - 1]
        total, inv = _sums(part)
        n = len(part) - GRAM + 1
        low = T.mix((total[GRAM:] - total[:-GRAM]) * inv[:n])
        width, span = LENGTH - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:b - a], low[width - span:width - span + b - a])
        # Positions whose string ends in the same text.
        first = int(np.searchsorted(offsets, a, "right")) - 1
        ends = np.minimum(np.maximum(offsets[first + 1:] - a, 0), b - a)
        ends = ends[:int(np.searchsorted(ends, b - a)) + 1]
        doc = first + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.flatnonzero(np.arange(a, b) + LENGTH <= offsets[1:][doc])
        if not len(at):
            continue
        v = low[at]
        head = _heads(v)
        head[1:] |= (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
        start = at[head]
        last = at[np.append(np.flatnonzero(head)[1:], len(at)) - 1]
        v = v[head]
        if live is not None:
            k = live(v)
            count = last[k] - start[k] + 1
            v = np.repeat(v[k], count)
            start = _ranges(start[k], count)
            last = start
        end = last + LENGTH
        whole = _hash(total, inv, start, end)
        parts.append((start + a, last + a, v, whole if live is not None else T.mix(whole ^ v), doc[start]))
    return tuple(np.concatenate(x) for x in zip(*parts))


_BLOB = ("bucket long, key binary, anchor binary, who binary, start binary, n binary, text binary, id binary, "
         "row binary")
_OUT = "part long, id binary, row binary, starts binary, ends binary, anchors array<long>, hot array<long>"


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, rows: np.ndarray, parts: int,
          anchors: np.ndarray, hot: np.ndarray) -> pa.Table:
    """Removed intervals, joined where they touch and dealt to ``parts`` groups of documents; and anchors to take
    apart, with those that have very many contexts, in a row of their own."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    head = _heads(doc)
    head[1:] |= start[1:] > end[:-1]
    first = np.flatnonzero(head)
    end = np.maximum.reduceat(end, first) if len(first) else end
    doc, start = doc[first], start[first]
    part = ids[doc] % parts
    order = np.argsort(part, kind="stable")
    each, at = np.unique(part[order], return_index=True)
    out = [(int(p), ids[doc[o]].tobytes(), rows[doc[o]].tobytes(), start[o].astype(np.int32).tobytes(),
            end[o].astype(np.int32).tobytes(), None, None)
           for p, o in zip(each, np.split(order, at[1:]))]
    if len(anchors):
        out.append((None, None, None, None, None, anchors, hot))
    kinds = [pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int64())] * 2
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)],
                    names=["part", "id", "row", "starts", "ends", "anchors", "hot"])


def _join_runs(table: pa.Table) -> pa.Table:
    """All intervals of a group of documents: one row per document."""
    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])

    ids, rows, starts, ends = (column(n, k) for n, k in (
        ("id", np.int64), ("row", np.int32), ("starts", np.int32), ("ends", np.int32)))
    order = np.lexsort((starts, rows, ids))
    ids, rows, starts, ends = ids[order], rows[order], starts[order], ends[order]
    head = _heads(ids)
    head[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(head)
    cuts = pa.array(np.append(at, len(ids)), pa.int32())
    return pa.table([pa.array(ids[at]), pa.array(rows[at]), pa.ListArray.from_arrays(cuts, pa.array(starts)),
                     pa.ListArray.from_arrays(cuts, pa.array(ends))], names=["id", "row", "starts", "ends"])


def _short(anchor: np.ndarray) -> np.ndarray:
    """The half of an anchor hash that does not choose its bucket."""
    return (anchor >> _U(32)).astype(np.uint32)


def _planes(n: np.ndarray) -> np.ndarray:
    """Counts as their lowest bytes, then their second bytes, and so on: the high ones are nearly all zero and compress."""
    return np.ascontiguousarray(n.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _counts(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _in_filter(words: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    slot = _short(anchor).astype(np.int64) % bits
    return (words[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _deal(buckets: int, taken_apart=None):
    """Entries of every group of texts in one blob per bucket. Of a group's equal entries only those of its smallest
    document go on; the others are already known as repeats and stay in a local blob (negative bucket).

    ``taken_apart`` holds the filters of anchors to take apart and, of these, of those with very many contexts.
    """

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in T.groups(batches, "text", GROUP, 1 << 16):
            yield _group_blobs(parts, buckets, taken_apart)

    return blobs


def _group_blobs(parts: list[pa.RecordBatch], buckets: int, taken_apart) -> pa.RecordBatch:
    ids, rows = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False).astype(t) for p in parts])
                 for c, t in (("id", np.int64), ("row", np.int32)))

    def live(anchor: np.ndarray) -> np.ndarray:
        return np.flatnonzero(_in_filter(taken_apart.value[0], anchor, KEY_BITS))

    found, base = [], 0
    for part in parts:
        buf, offsets = T.flat(part.column("text"))
        start, last, anchor, key, doc = contexts(buf, offsets, live if taken_apart is not None else None)
        found.append(((start - offsets[doc]).astype(np.int32), (last - start + 1).astype(np.int32), anchor, key,
                      (doc + base).astype(np.int32)))
        base += part.num_rows
    start, n, anchor, key, doc = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.lexsort((ids[doc], key))
    head = _heads(key[order])
    repeat = np.empty(len(key), bool)
    repeat[order] = ids[doc[order]] > ids[doc[order]][head][np.cumsum(head) - 1]
    out = []

    def blob(bucket: int, o: np.ndarray, length: np.ndarray | bytes, keys: bytes = b"", anchors: bytes = b"",
             text: bytes = b"") -> None:
        who, count = np.unique(doc[o], return_counts=True)  # entries come by text
        out.append((bucket, keys, anchors, bytes(_planes(count)), bytes(_planes(np.diff(start[o], prepend=0))),
                    bytes(length), text, ids[who].tobytes(), rows[who].tobytes()))

    def dealt(o: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (by % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return ((b, o[order[x:y]]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x)

    known = np.flatnonzero(repeat)
    if len(known):  # entries come by text and start, so what touches is joined here
        begin = start[known].astype(np.int64)
        stop = begin + n[known] - 1 + LENGTH
        new = _heads(doc[known])
        new[1:] |= begin[1:] > stop[:-1]
        first = np.flatnonzero(new)
        blob(-1 - int(key[known[0]] % _U(buckets)), known[first],
             _planes(np.maximum.reduceat(stop, first) - begin[first]))
    go = np.flatnonzero(~repeat)
    if taken_apart is None:
        for b, o in dealt(go, anchor[go]):
            blob(b, o, _planes(n[o]), key[o].tobytes(), _short(anchor[o]).tobytes())
    else:
        hot = _in_filter(taken_apart.value[1], anchor[go], HOT_BITS)
        for b, o in dealt(go[hot], key[go[hot]]):
            blob(b, o, b"", key[o].tobytes())
        go = go[~hot]
        new = _heads(anchor[go])
        new[1:] |= (doc[go[1:]] != doc[go[:-1]]) | (start[go[1:]] != start[go[:-1]] + 1)
        new[1:] |= start[go[1:]] % _BLOCK == 0
        first = np.flatnonzero(new)
        length = np.zeros(len(key), np.int32)
        length[go[first]] = np.diff(first, append=len(go))
        flat = [T.flat(part.column("text")) for part in parts]
        buf = np.concatenate([buf for buf, _ in flat])
        origin = np.cumsum([0, *(int(offsets[-1]) for _, offsets in flat[:-1])])
        origin = np.concatenate([offsets[:-1] + at for (_, offsets), at in zip(flat, origin)])
        for b, o in dealt(go[first], anchor[go[first]]):
            text = buf[_ranges(origin[doc[o]] + start[o], length[o] + (LENGTH - 1))]
            blob(b, o, _planes(length[o]), text=text.tobytes())
    kinds = [pa.int64()] + [pa.binary()] * 8
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)],
                           names=["bucket", "key", "anchor", "who", "start", "n", "text", "id", "row"])


def _search(buckets: int, hot: int):
    return lambda table: _search_bucket(table, buckets, hot)


def _search_bucket(table: pa.Table, buckets: int, many: int) -> pa.Table:
    """Removed intervals of one bucket's entries, the anchors whose contexts differ, and those of them that have
    ``many`` contexts or more."""
    local = table.column("bucket")[0].as_py() < 0
    cols: list[list[np.ndarray]] = [[] for _ in range(7)]
    base = 0
    for key, anchor, who, start, n, text, ids, rows in zip(*(table.column(c) for c in (
            "key", "anchor", "who", "start", "n", "text", "id", "row"))):
        count = _counts(who.as_py())
        index = np.repeat(np.arange(base, base + len(count), dtype=np.int32), count)
        base += len(count)
        key, n = np.frombuffer(key.as_py(), np.uint64), _counts(n.as_py())
        start = np.cumsum(_counts(start.as_py()), dtype=np.int32)
        if len(text := np.frombuffer(text.as_py(), np.uint8)):
            key, index, start, n = strings(text, n), np.repeat(index, n), _ranges(start, n).astype(np.int32), n[:0]
        for c, x in zip(cols, (key, np.frombuffer(anchor.as_py(), np.uint32), index, start, n,
                               np.frombuffer(ids.as_py(), np.int64), np.frombuffer(rows.as_py(), np.int32))):
            c.append(x)
    key, anchor, who, start, n, ids, rows = (np.concatenate(cols.pop(0)) for _ in range(7))
    apart = hot = np.zeros(0, np.int64)
    if local:
        return _runs(who, start, start + n, ids, rows, buckets, apart, hot)
    doc = ids[who]
    gone = np.flatnonzero(first_documents(key, doc) < doc)
    if len(anchor):
        order = np.lexsort((key, anchor))
        a, k = anchor[order], key[order]
        apart = np.unique(a[1:][(a[1:] == a[:-1]) & (k[1:] != k[:-1])]).astype(np.int64)
        hot = apart[np.searchsorted(a, apart, "right") - np.searchsorted(a, apart) >= many]
    end = start[gone] + LENGTH + (n[gone].astype(np.int64) - 1 if len(n) else 0)
    return _runs(who[gone], start[gone], end, ids, rows, buckets, apart, hot)


def _anchor_filter(found: DataFrame, column: str, bits: int) -> np.ndarray:
    """Anchors of a column as a bitmap, merged from 64-bit words."""
    slots = found.select(F.explode(column).alias("a")).select(F.pmod("a", F.lit(bits)).alias("s"))
    words = slots.groupBy(F.expr("shiftright(s, 6)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    spans, kept = [], []
    for text, s, e in zip(texts, starts, ends):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        s, e = (np.array(x.as_py() or [], np.int64) for x in (s, e))
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
        head = np.flatnonzero(np.append(True, s[1:] > e[:-1])) if len(s) else s
        runs = list(zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist())) if len(s) else []
        edges = [0, *(x for run in runs for x in run), len(data)]
        spans.append([{"start": a, "end": b} for a, b in runs])
        kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return pa.StructArray.from_arrays([pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                       pa.array(kept, pa.binary())], names=["spans", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (maximal removed byte runs, end exclusive), kept (remaining bytes).

    A byte goes when it is covered by a 50-byte string of its text that also starts in a document with a smaller id.
    Texts are compared as UTF-8 bytes, as they came in; strings are compared as 64-bit hashes.

    Null and empty texts have no bytes and no spans, as have texts under 50 bytes. Rows with a null id are kept whole
    and match nothing. Rows that share an id never match one another and are judged one by one. An empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("row"),
                        F.col(text_col).alias("text"))
    named = texts.filter("id is not null")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    search = _search(buckets, HOT_CONTEXTS)
    whole = scratch.table(named.mapInArrow(_deal(buckets), _BLOB).groupBy("bucket").applyInArrow(search, _OUT))
    scratch.settle()
    sent = spark.sparkContext.broadcast((_anchor_filter(whole, "anchors", KEY_BITS), _anchor_filter(whole, "hot", HOT_BITS)))
    parts = scratch.table(named.mapInArrow(_deal(buckets, sent), _BLOB).groupBy("bucket").applyInArrow(search, _OUT))
    scratch.settle()
    spans = scratch.table(whole.unionByName(parts).filter("part is not null").groupBy("part").applyInArrow(
        _join_runs, "id long, row int, starts array<int>, ends array<int>"))
    marked = F.col("id").isNotNull() & in_bitmap(bitmap(spans.select("id").distinct(), scratch), F.col("id"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    some = texts.filter(marked).join(spans, ["id", "row"], "left").withColumn("c", F.arrow_udf(
        _cut, "spans array<struct<start:long,end:long>>, kept binary")("text", "starts", "ends"))
    rest = texts.filter(~marked).select(
        "id", size, F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return some.select("id", size, "c.spans", "c.kept").unionByName(rest)
