"""Line deduplication with a tree of line templates.

A line's tokens that hold digits are variable fields. Lines fall through a tree of fixed depth: number of tokens, then
the leading tokens. Inside a leaf, lines that agree in most positions share a template, in which the positions that
differ are variable too. Templates that recur across documents are boilerplate, and their lines are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions.ordered import once
from slipway.llm.common import Scratch, bitmap, in_bitmap

SPACE = r"[\x20\x09-\x0D]"
ANY = "<*>"
DEPTH = 3  # leading tokens of a leaf
SIMILAR = 0.8  # share of positions that agree with a template
MIN_DOCS = 5  # documents in which a template recurs
LEAF_SHAPES = 2000  # in a leaf of more shapes, templates are looked up by an index; the results are the same
BITS = 1 << 23


def shape(line: Column) -> Column:
    """The line with single spaces and every token that has a digit as a variable field."""
    odd = line.startswith(" ") | line.endswith(" ")
    for gap in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(gap)
    spaced = F.when(odd, F.trim(F.regexp_replace(line, SPACE + "+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(
        spaced, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(spaced)


def _leaf(masked: Column, depth: int) -> Column:
    """Key of the leaf: number of tokens and the first ``depth`` tokens."""
    n = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit("")))
    return F.xxhash64(n, F.substring_index(masked, " ", depth))


def _clusters(table: pa.Table) -> pa.Table:
    """Templates of one leaf: shapes in the order of their text join the most similar template so far."""
    table = table.take(pc.sort_indices(table, [("shape", "ascending")]))
    words = pc.split_pattern(table.column("shape").combine_chunks(), " ")
    coded = pc.dictionary_encode(pc.list_flatten(words))
    vocabulary = coded.dictionary.to_pylist()
    # Token 0 is the variable field.
    code = np.arange(1, len(vocabulary) + 1, dtype=np.int32)
    if ANY in vocabulary:
        code[vocabulary.index(ANY)] = 0
    tokens = code[coded.indices.to_numpy()].reshape(table.num_rows, -1)
    templates, of = (_indexed if table.num_rows > LEAF_SHAPES else _compared)(tokens)
    vocabulary = [ANY, *vocabulary]
    text = pa.array([" ".join(vocabulary[t] for t in row) for row in templates], pa.string())
    return pa.table({"h": table.column("h"), "template": text.take(pa.array(of))})


def _compared(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Templates and the template of each line, by comparing every line with all templates so far."""
    templates = np.zeros_like(tokens)
    count, of = 0, np.zeros(len(tokens), np.int64)
    need = SIMILAR * tokens.shape[1]
    for k, line in enumerate(tokens):
        agree = (templates[:count] == line).sum(1)
        best = int(agree.argmax()) if count else -1
        if best >= 0 and agree[best] >= need:
            templates[best] = np.where(templates[best] == line, line, 0)
            of[k] = best
        else:
            templates[count], of[k] = line, count
            count += 1
    return templates[:count], of


def _indexed(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_compared`` gives, by comparing a line only with templates that equal it in one segment of positions.

    A line and its template differ in at most ``most`` positions, so of ``most`` + 1 segments one is equal. Segments
    hold the positions that differ at all in the leaf. A template is entered anew under each segment that changes.
    """
    need = SIMILAR * tokens.shape[1]
    most = tokens.shape[1] - math.ceil(need)
    free = np.flatnonzero((tokens != tokens[0]).any(0))
    segments = [c for c in np.array_split(free, most + 1)]
    known: list[dict[bytes, list[int]]] = [{} for _ in segments]
    templates: list[np.ndarray] = []
    of = np.zeros(len(tokens), np.int64)
    for k, line in enumerate(tokens):
        keys = [line[c].tobytes() for c in segments]
        near = sorted({t for seen, key in zip(known, keys) for t in seen.get(key, ())})
        agree = (np.array([templates[t] for t in near]) == line).sum(1) if near else np.zeros(0)
        best = int(agree.argmax()) if near else -1
        if best >= 0 and agree[best] >= need:
            best = near[best]
            made = np.where(templates[best] == line, line, 0)
            for seen, c in zip(known, segments):
                if (key := made[c].tobytes()) != templates[best][c].tobytes():
                    seen.setdefault(key, []).append(best)
            templates[best], of[k] = made, best
        else:
            of[k] = len(templates)
            for seen, key in zip(known, keys):
                seen.setdefault(key, []).append(len(templates))
            templates.append(line)
    return np.array(templates), of


def line_templates(lines: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """``lines`` (h, shape; distinct) -> h, template. The tree has the same depth for leaves of all sizes."""
    keyed = lines.select("h", "shape", _leaf(F.col("shape"), depth).alias("leaf"))
    return scratch.table(keyed.groupBy("leaf").applyInArrow(_clusters, "h long, template string"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: id, n_lines, dropped (line numbers from 0, ascending), kept (the other lines).

    A line is dropped when its template occurs in ``min_docs`` documents or more. Blank lines are never dropped.

    Null text is empty text: one blank line. Null ids are ids of their own. Repeated rows count as one document and
    give equal rows. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "templates")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "row", F.xxhash64("text"))
    split = texts.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    shaped = once(split, {"shape": shape(F.col("line"))}).filter("shape <> ''").drop("line")
    keyed = once(shaped, {"leaf": _leaf(F.col("shape"), DEPTH)})
    lines = scratch.table(keyed.select("id", "row", "pos", "leaf", F.xxhash64("shape").alias("h")))
    # A template lies in one leaf, so a leaf in too few documents holds none that recurs.
    live = scratch.table(lines.select("leaf", "id", "row").distinct().groupBy("leaf").count().filter(
        F.col("count") >= min_docs).select("leaf"))
    some = keyed.filter(in_bitmap(bitmap(live, scratch, BITS), F.col("leaf"), BITS))
    shapes = some.groupBy(F.xxhash64("shape").alias("h"), "leaf").agg(F.first("shape").alias("shape"))
    shapes = scratch.table(shapes.join(live, "leaf", "left_semi").select("h", "shape"))
    named = line_templates(shapes, scratch)
    met = scratch.table(lines.join(named, "h").select("id", "row", "pos", "template"))
    recurring = scratch.table(met.select("template", "id", "row").distinct().groupBy("template").count().filter(
        F.col("count") >= min_docs).select("template"))
    gone = scratch.table(met.join(recurring, "template", "left_semi").groupBy("id", "row").agg(
        F.array_sort(F.collect_set("pos")).alias("dropped")))
    marked = in_bitmap(bitmap(gone.select("row").distinct(), scratch, BITS), F.col("row"), BITS)
    pieces = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(pieces, lambda _, k: ~F.array_contains("dropped", k)), "\n")
    cut = texts.filter(marked).alias("t").join(
        gone.alias("g"), F.expr("t.id <=> g.id and t.row = g.row"), "left").select(
        "t.id", "text", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")).select(
        "id", F.size(pieces).cast("long").alias("n_lines"), "dropped", kept.alias("kept"))
    return cut.unionByName(texts.filter(~marked).select("id", F.size(pieces).cast("long").alias("n_lines"),
                                        F.array().cast("array<int>").alias("dropped"), F.col("text").alias("kept")))
