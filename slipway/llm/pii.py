"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans in other forms.

The random field scores whole spans of tokens: digit counts, grouping, checks such as Luhn, and the characters around
them. Dynamic programming over spans of at most MAX_TOKENS tokens picks boundaries and kinds jointly. It is trained on
what the base patterns find in a bounded sample of passages, by the likelihood of the labelled segmentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slipway.llm.common import Scratch, small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_START = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SAMPLE_PASSAGES = 3000  # passages the random field is trained on, about; a fixed bound, whatever the corpus holds
MAX_TOKENS = 20
REACH = 64  # characters of a word around a digit or at sign that can belong to a passage
WEIGHTS = 1 << 14  # bounds the model
EPOCHS, RATE, DECAY = 6, 0.5, 1e-4

_MARK = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s|[^\w\s]|_")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts where a run of local characters starts, or where the match before it ended inside such a run.
    at = 0
    while m := (EMAIL.match(text, at) if at else None) or EMAIL_START.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns; matches that fail their check are dropped."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(*m.span(), "ip") for m in IP.finditer(text) if _octets(m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def passages(text: str) -> list[tuple[int, int]]:
    """Words with digits or at signs; neighbours one character apart belong together."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        a, b = m.span()
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hashed(names: list[str], kind: int) -> np.ndarray:
    out, h = [], 0
    for n in names:
        h = 2166136261 ^ kind
        for c in n.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        out.append(h % WEIGHTS)
    return np.array(out)


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "space" if c.isspace() else "word" if c.isalnum() else c


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of a whole span, the characters next to it included."""
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    n = sum(map(len, groups))
    size = next(k for k in (3, 6, 9, 15, 19, 10 ** 9) if n <= k)
    shape = "-".join(str(min(len(g), 5)) for g in groups[-4:])
    other = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s))))[:8]
    dots = s.split(".")
    return ["one", f"left={_side(text, a - 1)}", f"right={_side(text, b)}", f"digits={size}", f"groups={shape}",
            f"other={other}", f"letters={bool(re.search('[^0-9 ().+-]', s))}", f"ats={min(s.count('@'), 2)}",
            f"first={'0' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}",
            f"mail={bool(EMAIL.fullmatch(s))}",
            f"octets={len(dots) == 4 and all(d.isdigit() and d.isascii() for d in dots) and _octets(dots)}",
            f"luhn={14 <= n <= 19 and luhn(''.join(groups))}"]


def candidates(text: str, a: int, b: int):
    """Token bounds of a passage and its candidate spans: (first token, last token + 1, features)."""
    cuts = [m.start() + a for m in _TOKEN.finditer(text[a:b])] + [b]
    spans = []
    for i in range(len(cuts) - 1):
        x = cuts[i]
        if not (text[x].isalnum() or text[x] in "+("):
            continue
        marked = False
        for j in range(i + 1, min(i + MAX_TOKENS, len(cuts) - 1) + 1):
            c = text[cuts[j - 1]]
            marked |= c == "@" or (c.isdigit() and c.isascii())
            if marked and c.isalnum():
                spans.append((i, j, span_features(text, x, cuts[j])))
    return cuts, spans


def _scores(spans, w: np.ndarray) -> np.ndarray:
    """Score of every span for every kind."""
    return np.array([[w[_hashed(f, k)].sum() for k in range(len(KINDS))] for _, _, f in spans]).reshape(-1, len(KINDS))


def best_path(n: int, spans, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of ``n`` tokens: tokens outside spans score 0, spans do not overlap."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(spans):
        into[j].append(k)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in into[j]:
            kind = int(scores[k].argmax())
            if best[spans[k][0]] + scores[k, kind] > best[j] + 1e-9:
                best[j], back[j] = best[spans[k][0]] + scores[k, kind], (spans[k][0], j, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _expected(n: int, spans, scores: np.ndarray) -> np.ndarray:
    """Probability of every (span, kind) under the model, by forward and backward sums over segmentations."""
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    total = np.logaddexp.reduce(scores, axis=1)
    into: list[list[int]] = [[] for _ in range(n + 1)]
    out_of: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(spans):
        into[j].append(k)
        out_of[i].append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1]] + [ahead[spans[k][0]] + total[k] for k in into[j]])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1]] + [behind[spans[k][1]] + total[k] for k in out_of[i]])
    edge = np.array([ahead[i] + behind[j] for i, j, _ in spans])
    return np.exp(np.clip(scores + edge[:, None] - ahead[n], -50, 0))


def train(samples: list[tuple[str, list[tuple[int, int, str]]]]) -> np.ndarray:
    """Weights from passages and their labelled spans, by stochastic gradient ascent with per-weight rates."""
    w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    prepared = []
    for text, gold in samples:
        cuts, spans = candidates(text, 0, len(text))
        if spans:
            at = {(cuts[i], cuts[j]): k for k, (i, j, _) in enumerate(spans)}
            truth = np.zeros((len(spans), len(KINDS)))
            for a, b, kind in gold:
                if (a, b) in at:
                    truth[at[a, b], KINDS.index(kind)] = 1
            ids = np.array([[_hashed(f, k) for k in range(len(KINDS))] for _, _, f in spans])
            prepared.append((len(cuts) - 1, spans, truth, ids))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(prepared)):
            n, spans, truth, ids = prepared[k]
            error = truth - _expected(n, spans, w[ids].sum(2))
            grad = np.zeros(WEIGHTS)
            np.add.at(grad, ids.ravel(), np.repeat(error.ravel(), ids.shape[2]))
            live = np.flatnonzero(grad)
            g = grad[live] - DECAY * w[live]
            seen[live] += g * g
            w[live] += RATE * g / np.sqrt(seen[live])
    return w


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = sorted({t for b in batches for t in b.column("passage").to_pylist()})
    w = train([(t, _alone(base_spans(t))) for t in texts])
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    yield pa.record_batch([pa.array(keep, pa.int64()), pa.array(w[keep])], names=["i", "w"])


def _alone(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """A segmentation: of overlapping base spans the first stays, the longer one of two that start together."""
    out: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [t[a:b] for t in batch.column("text").to_pylist() for a, b in passages(t or "")]
        yield pa.record_batch([pa.array(out, pa.string())], names=["passage"])


def fit(docs: DataFrame, text_col: str = "text", sample_passages: int = SAMPLE_PASSAGES) -> DataFrame:
    """Weights (i, w) trained on about ``sample_passages`` distinct passages of all documents, drawn by their hash."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_passage_rows, "passage string").filter(
        F.length("passage") <= 4 * REACH).distinct()
    found = Scratch(docs.sparkSession, "pii").table(found)
    share = int(min(1.0, sample_passages / max(1, found.count())) * (1 << 30))
    drawn = found.filter(F.pmod(F.xxhash64("passage"), F.lit(1 << 30)) < share)
    return drawn.repartition(1).mapInArrow(_train_task, "i long, w double")  # a sample of fixed size


def find(text: str, w: np.ndarray) -> list[tuple[int, int, str, bool]]:
    """All spans of a text: (start, end, kind, base). Spans of the random field that touch a base span are left out."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    for a, b in passages(text):
        cuts, spans = candidates(text, a, b)
        if spans:
            for i, j, kind in best_path(len(cuts) - 1, spans, _scores(spans, w)):
                x, y = cuts[i], cuts[j]
                if all(y <= p or q <= x for p, q, _ in base):
                    out.append((x, y, KINDS[kind], False))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def finder(weights: DataFrame):
    """A column function text -> array of (start, end, kind, base). ``weights`` holds at most WEIGHTS rows."""
    rows = weights.collect()
    sent = weights.sparkSession.sparkContext.broadcast(
        (np.array([r.i for r in rows], np.int64), np.array([r.w for r in rows])))

    def spans(texts: pa.Array) -> pa.Array:
        w = np.zeros(WEIGHTS)
        w[sent.value[0]] = sent.value[1]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])
        found = [[dict(zip(("start", "end", "kind", "base"), s)) for s in find(t.as_py() or "", w)] for t in texts]
        return pa.array(found, pa.list_(kind))

    return F.arrow_udf(spans, "array<struct<start:int,end:int,kind:string,base:boolean>>")


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii`` appended: spans (start, end, kind, base) in code points, by start and then kind.

    Base spans are always there; the others are the random field's. Null and empty texts have none, repeated rows have
    equal ones, an empty table stays empty. A column named ``pii`` is replaced, all others pass through.
    """
    spans = finder(fit(docs, text_col))
    return docs.withColumn("pii", spans(F.coalesce(F.col(text_col), F.lit(""))))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
