"""Fill-in-the-middle transformation: each text's two cut ranks are reached through an indexable skip list of its units."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slipway.llm import text as T
from slipway.llm.common import small_batches

#: The strings before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_heights = np.zeros(0, np.int8)


def heights(n: int) -> np.ndarray:
    """Number of express lanes that hold each of ``n`` units: each lane keeps a quarter of the one below, by hash."""
    global _heights
    if len(_heights) < n:
        h = T.mix(np.arange(max(n, 1 << 16), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lowest = (h & (~h + np.uint64(1))).astype(np.float64)
        _heights = (np.log2(np.maximum(lowest, 1)) // 2).astype(np.int8)
    return _heights[:n]


class SkipList:
    """Units of a text in order. A link of a lane leads over the units up to its node and carries how many units and how
    many code points these are; the third array has the place in the lane below at which each link, and the rest behind
    the last one, starts."""

    def __init__(self, chars: np.ndarray):
        height = heights(len(chars))
        self.lanes = [(np.ones(len(chars), np.int64), chars.astype(np.int64), np.zeros(0, np.int64))]
        lane = 1
        while (node := np.flatnonzero(height >= lane)).size:
            units, width, _ = self.lanes[-1]
            cuts = np.concatenate(([0], node + 1))
            start, end = cuts[:-1], cuts[-1]
            self.lanes.append((np.add.reduceat(units[:end], start), np.add.reduceat(width[:end], start), cuts))
            height = height[node]
            lane += 1

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units: from the top lane, links are followed while they do not pass the
        rank, then the walk goes one lane down."""
        place = units_done = chars_done = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            units, width, down = self.lanes[level]
            while place < len(units) and units_done + units[place] <= rank:
                units_done += units[place]
                chars_done += width[place]
                place += 1
            if level:
                place = int(down[place])
        return int(chars_done)


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit. Without a pattern every code point is a unit; otherwise each match ends one, text before
    a match belongs to its unit, and text behind the last match is one more unit."""
    if unit is None:
        return np.ones(len(text), np.int64)
    ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
    if len(text) and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], np.int64))


def _rearranged(key: str, text: str, unit: re.Pattern | None, percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text; ``key`` seeds the choices."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    widths = unit_widths(text, unit)
    n = len(widths)
    if not text or h3 % 100 >= percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = sorted((units.chars_before(h1 % (n + 1)), units.chars_before(h2 % (n + 1))))
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}"


_RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])
_DDL = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 1,
                   unit: str | None = None, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with a column ``fim``: n (units), form, prefix_chars, middle_chars (code points), output (the new text).

    The first four 8-digit groups of the SHA-256 of ``<seed>:<id>`` choose: two cuts among the n + 1 places between
    units, whether the text is rearranged (``percent`` of 100), and in which order (``spm_percent`` of 100 suffix
    first). ``unit`` is a pattern of units; without one they are code points.

    Null text is empty text. Empty texts and texts that contain a marker stay ``plain``: their output is the text
    itself and both counts are null. A null id is written as nothing. Rows are independent: repeated rows give repeated
    results, rows sharing an id share its choices, an empty table gives no rows. A column called ``fim`` is replaced;
    all other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    pattern = re.compile(unit, re.S) if unit else None

    def work(keys: pa.Array, texts: pa.Array) -> pa.Array:
        made = [_rearranged(k.as_py(), t.as_py() or "", pattern, percent, spm_percent) for k, t in zip(keys, texts)]
        columns = list(zip(*made)) or [()] * len(_RESULT)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], fields=list(_RESULT))

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.withColumn("fim", F.arrow_udf(work, _DDL)(key, F.col(text_col)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No marker stands in a text that is rearranged, so the parts are found again."""
    def part(mark: str) -> Column:
        rest = F.substring_index(output, mark, -1)
        for other in (PREFIX, SUFFIX, MIDDLE):
            rest = F.substring_index(rest, other, 1)
        return rest

    return F.when(form == "plain", output).otherwise(F.concat(part(PREFIX), part(MIDDLE), part(SUFFIX)))
