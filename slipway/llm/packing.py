"""Packing token sequences: harmonic classes of reciprocals of the capacity, filled by each worker for itself.

Documents are tokenized and cut where that lets a piece fit: whole sequences first; of the rest, a piece that is almost
a k-th of the capacity goes into class k, from a longer one exactly a (k + 1)-th is cut off. A bin of class k takes k
pieces, so a worker closes it without knowing any other piece. The pieces of the last class, a ``SMALL``-th of the
capacity or less, fill bins one after the other. Bins that a worker leaves open go on to a worker of the next round, which
takes those of ``FAN_IN`` workers, until one is left; its open bins, at most one for each class, are joined end to end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from slipway.llm import text as T
from slipway.llm.common import Scratch

SMALL = 32
SLACK = 64  # a piece may be shorter than its class's share by a 64th of it
FAN_IN = 64
SLICE = 4 << 20  # text whose distinct words are encoded together
KNOWN_PARTS = 1 << 18  # words and parts of words whose ids a worker keeps

#: How tokenizer files of this kind prepare a text. Their words can be cut here, without the library.
_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The split's pattern for lower-cased words of printable ASCII and the letters of Latin-1.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")


class Words:
    """Ids of single words by a tokenizer file.

    Simple words are cut into parts here, which only the file's merges see, each distinct part once; all others, and all
    words with other kinds of files, are encoded by the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, list[int]] = {}
        spec = json.loads(self.tokenizer.to_str())
        steps = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = steps == _NORMALIZER and len(cut) == 2 and cut[0].get("pattern") == {"Regex": _SPLIT} and cut[
            0]["behavior"] == "Removed" and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"]
        added = [t["content"] for t in spec["added_tokens"]]
        self.marked = not any(t.isalpha() for t in added)
        self.special = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        # Byte-level names: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
        hidden = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)]
        self.names = {c: chr(256 + k) for k, c in enumerate(hidden)}

    def keep(self, part: str, ids: list[int]) -> list[int]:
        if len(self.known) < KNOWN_PARTS:
            self.known[part] = ids
        return ids

    def part_ids(self, part: str) -> list[int]:
        name = part if part.isascii() else part.encode().decode("latin-1").translate(self.names)
        return self.keep(part, [t.id for t in self.tokenizer.model.tokenize(name)])

    def word_ids(self, word: str) -> list[int]:
        simple = self.plain and (word.isascii() and word.isprintable() or _SIMPLE.fullmatch(word) is not None)
        if simple and word.isalpha() and self.marked:
            low = word.lower()
            return self.keep(word, self.known.get(low) or self.part_ids(low))
        if not simple or self.special.search(word):
            return self.keep(word, self.tokenizer.encode(word, add_special_tokens=False).ids)
        parts = [self.known.get(p) or self.part_ids(p) for p in _PARTS.findall(word.lower())]
        return self.keep(word, parts[0] if len(parts) == 1 else [i for p in parts for i in p])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        found = [self.known.get(w) or self.word_ids(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size


_words: dict[str, Words] = {}


def token_ids(column: pa.Array, tokenizer: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by the tokenizer file at a path, each with ``end`` behind it, and where each text's ids start.

    Each distinct word between white space is encoded once. That gives the ids of the whole text with tokenizers whose
    tokens never cross or depend on white space.
    """
    if tokenizer not in _words:
        _words[tokenizer] = Words(tokenizer)
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary
    one = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.string()))
    flat, size = _words[tokenizer].ids(pc.binary_join(one, "\n")[0].as_py().split("\n") if len(distinct) else [])
    # ``end`` counts as one more word, which stands behind each text's last.
    flat, size = np.append(flat, np.uint32(end)), np.append(size, 1)
    start = np.cumsum(size) - size
    texts = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
    word = np.insert(coded.indices.to_numpy(), texts, len(size) - 1)
    total = np.cumsum(size[word])
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(start[word] - total + size[word], size[word])
    return flat[at], np.concatenate(([0], total[texts + np.arange(len(texts))]))


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Lengths and classes of the pieces of a document of ``length`` tokens, in order."""
    while length:
        k = max(capacity // length, 1)
        share = capacity // k
        if k >= SMALL:
            yield length, SMALL
            return
        if length <= share and length * SLACK >= share * (SLACK - 1):
            yield length, k
            return
        if length <= capacity:
            k, share = k + 1, capacity // (k + 1)
        yield share, k
        length -= share


Piece = tuple[np.ndarray, object, int, int]  # ids, document, start, the document's tokens


class Bins:
    """The open bins of one worker, at most one for each class, and the sequences closed so far."""

    def __init__(self, worker: int, capacity: int):
        self.worker, self.capacity = worker, capacity
        self.open: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []
        self.number = 0

    def add(self, piece: Piece, cls: int) -> None:
        held = self.open.setdefault(cls, [])
        if cls == SMALL and sum(len(p[0]) for p in held) + len(piece[0]) > self.capacity:
            self.close(held)
            held = self.open[cls] = []
        held.append(piece)
        if cls < SMALL and len(held) == cls:
            self.close(self.open.pop(cls))

    def close(self, pieces: list[Piece], cls: int = 0) -> None:
        """A finished sequence, or with a class the open bin that goes on to the next round."""
        ids = np.concatenate([p[0] for p in pieces])
        listed, offset = [], 0
        for part, doc, start, tokens in pieces:
            listed.append({"id": doc, "start": start, "length": len(part), "doc_tokens": tokens, "offset": offset})
            offset += len(part)
        self.rows.append((cls == 0, self.worker, self.number, cls, offset, ids.astype("<u4").tobytes(), listed))
        self.number += 1

    def hand_on(self) -> None:
        for cls, pieces in sorted(self.open.items()):
            self.close(pieces, cls)
        self.open = {}

    def join(self) -> None:
        """What is open at last, end to end: less than a sequence for each class."""
        left, room = [], self.capacity
        for _, pieces in sorted(self.open.items()):
            for ids, doc, start, tokens in pieces:
                while len(ids):
                    left.append((ids[:room], doc, start, tokens))
                    start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        self.close(left)
                        left, room = [], self.capacity
        if left:
            self.close(left)
        self.open = {}

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct(
            [("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
             ("offset", pa.int64())]))]
        columns = zip(*self.rows) if self.rows else [[]] * len(kinds)
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)],
                              names=["done", "worker", "number", "cls", "n_tokens", "ids", "pieces"])
        self.rows = []
        return out


def _fill(tokenizer: str, capacity: int, end: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, kind = Bins(TaskContext.get().partitionId(), capacity), None
        for batch in batches:
            kind = batch.column("id").type
            for part in T.slices(batch, "text", SLICE):
                ids, first = token_ids(part.column("text"), tokenizer, end)
                for doc, a, b in zip(part.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    start = 0
                    for size, cls in cuts(b - a, capacity):
                        bins.add((ids[a + start:a + start + size], doc, start, b - a), cls)
                        start += size
                yield bins.batch(kind)
        if kind is not None:
            bins.hand_on()
            yield bins.batch(kind)

    return work


def _refill(capacity: int, last: bool):
    """The open bins of some workers, sorted by ``group``, as one worker's pieces."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, kind = None, None

        def finished() -> pa.RecordBatch:
            bins.join() if last else bins.hand_on()
            return bins.batch(kind)

        for batch in batches:
            kind = batch.column("pieces").type.value_type.field("id").type
            for group, cls, ids, pieces in zip(*(batch.column(c) for c in ("group", "cls", "ids", "pieces"))):
                if bins is None or bins.worker != group.as_py():
                    if bins is not None:
                        yield finished()
                    bins = Bins(group.as_py(), capacity)
                flat = np.frombuffer(ids.as_py(), "<u4")
                for p in pieces.as_py():
                    bins.add((flat[p["offset"]:p["offset"] + p["length"]], p["id"], p["start"], p["doc_tokens"]), cls.as_py())
            yield bins.batch(kind)
        if bins is not None:
            yield finished()

    return work


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096,
           end: int = 2) -> DataFrame:
    """One row per sequence of at most ``capacity`` tokens: sequence_id, n_tokens, padded_to, ids, pieces.

    ``ids`` are little-endian unsigned 32-bit token ids. ``pieces`` lists, in the sequence's order, the document's id,
    ``start`` (its ids before the piece), ``length``, ``doc_tokens`` (all its ids) and ``offset`` in the sequence.
    Sequences are to be padded to ``padded_to``: the capacity, or their own length where that is a power of two.
    ``tokenizer`` is the path of a tokenizer file that every executor can read; each document is its ids followed by
    ``end``. Every id of every document stands in exactly one piece.

    Null and empty texts are the one id ``end``. Null ids stay null; repeated rows and rows sharing an id are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = (f"done boolean, worker long, number long, cls int, n_tokens long, ids binary, pieces array<struct<id:"
           f"{texts.schema['id'].dataType.simpleString()},start:long,length:long,doc_tokens:long,offset:long>>")
    made = scratch.table(texts.mapInArrow(_fill(tokenizer, capacity, end), ddl))
    rounds = [made]
    while (workers := made.filter("not done").agg(F.max("worker")).first()[0]) is not None:
        groups = workers // FAN_IN + 1
        waiting = made.filter("not done").withColumn("group", F.expr(f"worker div {FAN_IN}"))
        dealt = waiting.repartition(groups, "group").sortWithinPartitions("group", "cls", "worker").select(
            "group", "cls", "ids", "pieces")
        made = scratch.table(dealt.mapInArrow(_refill(capacity, groups == 1), ddl))
        rounds.append(made)
    out = None
    for k, r in enumerate(rounds):
        part = r.filter("done").select(
            F.expr(f"shiftleft({k}L, 56) + shiftleft(worker, 32) + number").alias("sequence_id"), "n_tokens",
            F.when(F.expr("n_tokens & (n_tokens - 1) = 0"), F.col("n_tokens")).otherwise(capacity).alias("padded_to"),
            "ids", "pieces")
        out = part if out is None else out.unionByName(part)
    return out


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece of ``packed`` sequences: id, start, length, doc_tokens, sequence_id, offset, and its ids."""
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select(
        "p.id", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset",
        F.expr("substring(ids, cast(p.offset * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"))
