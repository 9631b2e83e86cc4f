"""Personal data by candidate gradient boosting (operator 6).

Four strict patterns give the base spans: e-mail addresses, IPv4 addresses, card
numbers (Luhn) and international phone numbers.  High-recall generators propose
further, overlapping spans (spelled-out addresses, numbers in groups, digit runs
that fail a check).  Boosted trees over format and context features score those
that touch no base span, and a threshold for each kind selects what is added.
Base spans always stay.

The tables have no labels of personal data, so the labels are made.  Positive: a
base span rewritten in its place into a form that no base pattern matches
(spelled out or regrouped), and a candidate that a base pattern accepts once it
is written plainly.  Negative: every other candidate that touches no base span.
Base spans themselves are no examples: they need no selection.

Two passes read every document.  The first takes, of each kind and label, the
``SAMPLE_SPANS`` distinct feature vectors with the smallest hashes: copies and
frequent formats count once, and a rare kind keeps all it has.  Trees are fitted
to ``FOLDS`` folds of vectors, and a vector is always scored by the trees that
have not seen it.  The second counts the scores of all examples by kind, score
and label; a threshold is the lowest score above which at least ``PRECISION`` of
the kind's examples are positive, whatever their number.  Finding reads every
whole text once more.  Only sampled vectors and score counts are shuffled.  All
scans are linear in the text, and candidates are selected in n log n.  The
patterns of spelled-out addresses and grouped numbers bound the length of their
parts (64 characters of a local part, 63 of a label, 24 digits); that is part of
what a candidate is, and no candidate is dropped for its length.

Edge rows: a null text is empty; an empty text or table has no spans.  A kind
without a positive example in the whole table gets no added span.  Rows are
independent, so repeated rows and null ids need no care; other columns pass
through in ``row``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .catalog import query, table
from .shared import bound_batches, quoted, stored

KINDS = ("email", "ip", "card", "phone")
#: distinct feature vectors of each kind and label that the trees are fitted to
SAMPLE_SPANS = 2500
FOLDS = 3
#: classes of scores
LEVELS = 1024
PRECISION = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a digit run: the run's first digit would match as well
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,8}")
_SPELLED_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_DOT = re.compile(r" ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]|\.) ?")
_GROUPS = re.compile(r"(?<![0-9])\+?\(?[0-9]{1,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,6}(?![0-9])")
_RUN = re.compile(r"(?<![0-9])[0-9]{9,24}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data; spans may overlap."""
    out = set()
    if "@" in text or "(at)" in text or "[at]" in text:
        out.update((m.start(), 0, m.end()) for m in _SPELLED.finditer(text))
    if _DIGIT.search(text):
        out.update((m.start(), 1, m.end()) for m in _IP.finditer(text))
        if "[.]" in text or "(.)" in text or "(dot)" in text or "[dot]" in text:
            out.update((m.start(), 1, m.end()) for m in _SPELLED_IP.finditer(text))
        out.update((m.start(), 2, m.end()) for m in _RUN.finditer(text))
        for m in _GROUPS.finditer(text):
            n = sum(map(str.isdigit, m.group()))
            if 7 <= n <= 15:
                out.add((m.start(), 3, m.end()))
            if 12 <= n <= 19:
                out.add((m.start(), 2, m.end()))
        if "+" in text:
            out.update((m.start(), 3, m.end()) for m in _PHONE.finditer(text))
    return sorted(out)


#: Context words of the features: fixed values.
_CUES = (
    ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    ("ip", "host", "server", "address", "login", "from"),
    ("card", "visa", "credit", "account", "payment", "karte", "tarjeta", "carte"),
    ("phone", "tel", "call", "fax", "mobile", "telefon", "dial"),
)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of the span and its surroundings; no feature repeats a base check."""
    start, kind, end = span
    s = text[start:end]
    before = text[max(0, start - 24) : start]
    cues = before.lower()
    digits = sum(map(str.isdigit, s))
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    letters = sum(map(str.isalpha, s))
    touches = (start > 0 and text[start - 1].isalnum()) + (end < len(text) and text[end].isalnum())
    return [
        float(x)
        for x in (
            kind, end - start, digits, letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            s.count(" "), s.count("-"), s.count("."), s.count("@"), s.count("("), s.startswith("+"), s.startswith("("),
            touches, before[-1:] in " \n\t", before[-1:] in "$€#=\"'", end < len(text) and text[end] in "%/:=",
            *(any(c in cues for c in cue) for cue in _CUES),
        )
    ]


_N_FEATURES = 18 + len(_CUES)


def addable(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span."""
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max, initial=0))
    # of the base spans that start before the candidate's end, the furthest end decides
    return [c for c in candidates(text) if reach[bisect_left(starts, c[2])] <= c[0]]


def _plain(span: str, kind: int) -> bool:
    """Whether a base pattern accepts the candidate once it is written plainly; phone numbers show no such sign."""
    if kind == 0:
        written = _DOT.sub(".", _AT.sub("@", span, count=1))
        if "(at)" not in span and "[at]" not in span and (". " in span or " ." in span):
            return False  # the end of a sentence
        tail = written.rsplit(".", 1)[-1]
        return len(tail) >= 2 and tail.isalpha() and (0, 0, len(written)) in base_spans(written)
    if kind == 1:
        return all(map(_small, _DOT.sub(".", span).split(".")))
    digits = "".join(filter(str.isdigit, span))
    return kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)


def _rewritten(span: str, kind: int, pick: int) -> str:
    """A base span in a form that its base pattern does not match, one of several by ``pick``."""
    if kind == 0:
        local, domain = span.split("@", 1)
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), ("@", " [dot] "), ("[at]", "[dot]"))[pick % 6]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", ("[.]", "(.)", " (dot) ", "[dot]")[pick % 4])
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 2:
        cuts = list(range(0, len(digits) - 1, 4))  # a last single digit joins its neighbour
        return "./"[pick % 2].join(digits[a:b] for a, b in zip(cuts, [*cuts[1:], len(digits)]))
    sep = "- ./"[pick % 4]
    ends = [len(digits) - 10, len(digits) - 7, len(digits) - 4, len(digits)]
    parts = [digits[a:b] for a, b in zip([0, *[max(e, 0) for e in ends]], ends) if b > a]
    if pick // 4 % 2:
        parts[-3] = f"({parts[-3]})"
    return sep.join(parts)


_AROUND = 64


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") >> 1


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, label, features) of the text's candidates and of its base spans in another form."""
    base = base_spans(text)
    for c in addable(text, base):
        yield c[1], int(_plain(text[c[0] : c[2]], c[1])), features(text, c)
    for a, k, b in base:
        new = _rewritten(text[a:b], k, _hash(text[a:b].encode("utf-8", "replace")))
        before = text[max(0, a - _AROUND) : a]
        near, span = before + new + text[b : b + _AROUND], (len(before), k, len(before) + len(new))
        if span in addable(near, base_spans(near)):
            yield k, 1, features(near, span)


def _vector_hashes(x: np.ndarray) -> np.ndarray:
    return np.array([_hash(v.tobytes()) for v in x], np.int64)


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind and label the task's distinct vectors with the smallest hashes."""
    kept: dict[tuple[int, int], dict[int, list[float]]] = {(k, y): {} for k in range(len(KINDS)) for y in (0, 1)}

    def cut(own: dict[int, list[float]]) -> dict[int, list[float]]:
        return {h: own[h] for h in sorted(own)[:SAMPLE_SPANS]}

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for k, y, x in examples(text or ""):
                own = kept[k, y]
                own[_hash(np.array(x).tobytes())] = x
                if len(own) >= 2 * SAMPLE_SPANS:
                    kept[k, y] = cut(own)
    for (k, y), own in kept.items():
        own = cut(own)
        cols = [pa.array([k] * len(own), pa.int32()), pa.array([y] * len(own), pa.int32()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "y", "h", "x"])


class Model:
    def __init__(self, folds: list[boosting.Trees], limits: list[float]):
        self.folds, self.limits = folds, limits

    def score(self, x: np.ndarray) -> np.ndarray:
        """Class 0 .. LEVELS - 1 of each row's probability, by the trees that were not fitted to its vector."""
        fold = _vector_hashes(x) % FOLDS
        p = np.zeros(len(x))
        for i, trees in enumerate(self.folds):
            p[fold == i] = trees.predict(x[fold == i])
        return np.minimum(p * LEVELS, LEVELS - 1).astype(np.int64)


def _counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            found = [e for t in batch.column("text").to_pylist() for e in examples(t or "")]
            if found:
                n.update(zip((k for k, _, _ in found), model.score(np.array([x for _, _, x in found])).tolist(), (y for _, y, _ in found)))
        cols = [pa.array([key[i] for key in n], pa.int32()) for i in range(3)] + [pa.array(list(n.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "score", "y", "n"])

    return run


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Trees from distinct vectors and thresholds from the score counts of all documents."""
    bound_batches(docs)
    texts = docs.select(quoted(text_col).alias("text")).where(F.col("text").isNotNull())
    drawn = stored(texts.mapInArrow(_smallest, "kind int, y int, h long, x array<double>").dropDuplicates(["kind", "y", "h"]))
    rows = [r for k in range(len(KINDS)) for y in (0, 1) for r in drawn.where((F.col("kind") == k) & (F.col("y") == y)).orderBy("h").limit(SAMPLE_SPANS).collect()]
    x = np.array([r["x"] for r in rows], float).reshape(-1, _N_FEATURES)
    y = np.array([r["y"] for r in rows], float)
    fold = np.array([r["h"] for r in rows], np.int64) % FOLDS
    model = Model([boosting.fit(x[fold != i], y[fold != i]) for i in range(FOLDS)], [])
    counted = texts.mapInArrow(_counts(model), "kind int, score int, y int, n long").groupBy("kind", "score", "y").agg(F.sum("n").alias("n")).collect()
    model.limits = [_limit({(r["score"], r["y"]): r["n"] for r in counted if r["kind"] == k}) for k in range(len(KINDS))]
    return model


def _limit(counts: dict[tuple[int, int], int]) -> float:
    """Lowest score whose selection is right often enough, from counts by score and label."""
    limit, right, wrong = np.inf, 0, 0
    for score in sorted({s for s, _ in counts}, reverse=True):
        right += counts.get((score, 1), 0)
        wrong += counts.get((score, 0), 0)
        if right >= PRECISION * (right + wrong):
            limit = float(score)
    return limit


def spans_of(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, is base): base spans and the selected candidates that touch none of them, best first."""
    base = base_spans(text)
    out = [(a, k, b, True) for a, k, b in base]
    open_ = [c for c in addable(text, base) if np.isfinite(model.limits[c[1]])]
    if open_:
        p = model.score(np.array([features(text, c) for c in open_]))
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for i in np.lexsort((np.arange(len(p)), -p)):
            a, k, b = open_[i]
            at = bisect_left(taken, (a, b))
            if p[i] >= model.limits[k] and (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                out.append((a, k, b, False))
    return sorted(out)


_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def redact_text(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _find(model: Model, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [spans_of(t or "", model) for t in texts]
            cols = [batch.column("row"), pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": s} for a, k, b, s in f] for f in found], _SPAN_ARROW)]
            if redact:
                cols.append(pa.array([t and redact_text(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["row", "spans", "redacted"][: len(cols)])

    return run


def find(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``row`` (the carried columns, by default all, as a struct), ``spans`` and, on request, the ``redacted`` text."""
    bound_batches(docs)
    src = docs.select(F.struct(*[quoted(c) for c in carry or docs.columns]).alias("row"), quoted(text_col).alias("text"))
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), T.StructField("spans", T._parse_datatype_string(_SPAN))])
    if redact:
        schema = schema.add("redacted", "string")
    return src.mapInArrow(_find(model, redact), schema)


@query("op6_pii")
def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("row.doc_id", *[count(k) for k in KINDS], F.sha2(name(base).cast("binary"), 256).alias("base_sha256"), name(F.col("spans")).alias("spans"))
