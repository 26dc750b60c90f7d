"""Personal data: fixed patterns, and boosted trees over the spans of high-recall generators.

Base spans follow four fixed patterns with a check each (e-mail, IP address, payment
card, telephone).  Generators propose looser, overlapping spans: written-out or defanged
addresses, cards with other separators, telephones without a plus sign.  Boosted trees
score each by its format and its surroundings, and a calibrated probability above the
kind's threshold adds it, valid forms and then the best first, where it overlaps neither
a base span nor a better one.

The trees learn from all texts that hold a digit or an at sign.  Positive are candidates on base spans and on spellings of
them that the base patterns don't know.  Other candidates are negative, but for those
off base spans that have a valid form of their kind (``valid_form``) or overlap one that has:
what they are isn't known, so they are neither taught nor counted.  Tasks count the different
rows of features, one written table holds them, and each level of a tree is one sum of
gradients over it, so that only sums by feature and bin reach the driver.  One half of the
texts, by a hash, fits the trees, the other half calibrates them and sets thresholds, from counts by kind
and by steps of ``1 / STEPS`` of the trees' sum.  For a kind with fewer than ``LEAST_SPANS`` base spans in
a half, spellings of ``STAND_INS`` put into ``CARRIERS`` of that half's texts are positives too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, with_text_columns
from .boosting import BoostedTrees
from .scratch import Scratch
from .worker import give_back, release

KINDS = ("email", "ip", "card", "phone")
LEAST_SPANS, CARRIERS = 50, 40
#: Steps of one of the trees' sum at which held-out rows are counted, and the sum beyond which steps aren't told apart.
STEPS, FARTHEST = 256, 30
#: Precision wanted on the calibration rows, and the least probability in any case.
PRECISION, LEAST_PROBABILITY = 0.98, 0.95
STAND_INS = (
    ("jane.doe@example.org", "info@mail.example.com", "x_y7@example.co.uk"),
    ("192.0.2.17", "203.0.113.240", "10.1.2.3"),
    ("4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"),
    ("+1 (415) 555-0132", "+49 30 901820 11", "+44 20 7946 0958"),
)

_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each at sign is looked at once, so long runs cost no more than their length."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
            at = text.find("@", low)
        else:
            low, at = at + 1, text.find("@", at + 1)


def ip_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers in a row, taken from the left; only those with parts up to 255 are given."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = [], run.start()
        for part in run.group().split("."):
            if not part:
                parts = []
            else:
                parts.append((start, start + len(part), part))
                if len(parts) == 4:
                    if all(len(p[2].lstrip("0")) <= 3 and int(p[2].lstrip("0") or "0") <= 255 for p in parts):
                        yield parts[0][0], parts[3][1]
                    parts = []
            start += len(part) + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base spans in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in ((1, ip_addresses), (2, cards), (3, phones)):
            out += [(s, kind, e) for s, e in find(text)]
    return sorted(out)


_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_AT = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\}|@)[ ]?|[ ]at[ ]", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\])[ ]?|[ ]dot[ ]|\.)[A-Za-z0-9-]{1,63})+", re.I)
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_LOOSE_IP = re.compile(_EDGE + r"[0-9]{1,3}(?:[ ]?\[?\.\]?[ ]?[0-9]{1,3}){3}" + _END)
_LOOSE_CARD = re.compile(_EDGE + r"[0-9](?:[ ._/-]{0,2}[0-9]){12,18}" + _END)
_LOOSE_PHONE = re.compile(r"(?<![A-Za-z0-9+])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}" + _END)
_HINT = re.compile(r"tel|phone|call|fax|mobil|card|visa|e-?mail|contact|addr|host|server|\bip\b", re.I)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Loose (start, kind index, end) spans, overlapping ones included."""
    out = []
    if "@" in text or re.search(r"[\[({ ]dot[\])} ]|\[\.\]", text, re.I):
        for m in _AT.finditer(text):
            left = _LOOSE_LOCAL.search(text[max(0, m.start() - 64) : m.start()])
            right = _HOST.match(text, m.end())
            if left and right:
                out.append((m.start() - len(left.group()), 0, right.end()))
    if _DIGIT.search(text):
        for kind, loose in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
            out += [(m.start(), kind, m.end()) for m in loose.finditer(text)]
    return out


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context of one candidate."""
    start, kind, end = span
    body = text[start:end]
    digits = _digits(body)
    groups = re.findall("[0-9]+", body) or [""]
    before = text[max(0, start - 32) : start]
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(body), len(digits), len(groups), len(groups[0]), len(groups[-1]), max(map(len, groups)),
        body.count(" "), body.count("-"), body.count("."), body.count("(") + body.count("["),
        float(body[0] == "+"), float(body[:2] == "00"), float(body[0] == "("), float("@" in body),
        float(bool(re.search(r"\bat\b", body, re.I))), float(bool(re.search(r"\bdot\b|\[\.\]", body, re.I))),
        float(len(digits) >= 13 and luhn(digits)), float(max((int(g[:9] or 0) for g in groups)) <= 255),
        _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1]),
        float(bool(_HINT.search(before))), float(sum(c.isdigit() for c in before)),
    ]


def _spellings(kind: int, body: str) -> list[str]:
    """Other spellings of a base span."""
    if kind == 0:
        name, _, host = body.partition("@")
        return [f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}"]
    if kind == 1:
        return [body.replace(".", "[.]"), body.replace(".", " . ")]
    digits = _digits(body)
    if kind == 2:
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "--".join((digits[:8], digits[8:]))]
    tail = digits[-10:]
    country = digits[:-10] or "1"
    return [f"00{body[1:]}", f"00 {country} {tail[:3]} {tail[3:]}", f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}"]


_PHONE_FORM = re.compile(r"(?:\+|00|1[ .-])?[ ]?(?:\([0-9]{2,5}\)[ ./-]{0,2}|[0-9]{2,5}[ ./-]{1,2})[0-9]{2,}(?:[ ./-]{1,2}[0-9]{2,})*\Z")
_COUNTRY_FORM = re.compile(r"00[ ]?[1-9][0-9]{0,2}(?:[ ()./-]{1,3}[0-9]+)+\Z")
_EMAIL_FORM = re.compile(r"\S+?(?:@|[ ]?(?:\(at\)|\[at\]|\{at\})[ ]?|[ ]at[ ](?=.*(?:[ ]dot[ ]|[\[({]dot[\])}])))\S.*[.\])} ][A-Za-z]{2,}\Z", re.I)


def valid_form(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a loose span may well be what its kind says: octets, check digit, a telephone's grouping and number of digits."""
    start, kind, end = span
    body = text[start:end]
    if kind == 0:
        return bool(_EMAIL_FORM.match(body))
    if re.search(r"[0-9][./-]?\Z", text[max(0, start - 2) : start]) or re.match("[./-]?[0-9]", text[end : end + 2]):
        return False  # a part of a longer number
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall("[0-9]+", body))
    digits = _digits(body)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(_PHONE_FORM.match(body) or _COUNTRY_FORM.match(body))


def _examples(text: str) -> Iterator[tuple[list[float], float]]:
    base, loose = base_spans(text), candidates(text)
    known = Intervals(base)
    maybe = Intervals([c for c in loose if valid_form(text, c)])
    kinds = [Intervals([b for b in base if b[1] == k]) for k in range(len(KINDS))]
    for c in loose:
        if not kinds[c[1]].free(c[0], c[2]):
            yield features(text, c), 1.0
        elif not known.free(c[0], c[2]) or maybe.free(c[0], c[2]):
            yield features(text, c), 0.0
    for start, kind, end in base:
        yield from _respelled(kind, text[max(0, start - 40) : start], text[start:end], text[end : end + 40])


def _respelled(kind: int, left: str, base: str, right: str) -> Iterator[tuple[list[float], float]]:
    for body in _spellings(kind, base):
        at, whole = len(left), left + body + right
        for c in candidates(whole):
            if c[1] == kind and c[0] < at + len(body) and at < c[2]:
                yield features(whole, c), 1.0


def _stand_ins(texts: list[str], missing: list[int]) -> Iterator[tuple[list[float], float]]:
    """Positives of the kinds that too few base spans have."""
    for i, text in enumerate(texts):
        words = text.split()
        for kind in missing:
            yield from _respelled(kind, " ".join(words[:5]) + " ", STAND_INS[kind][i % 3], " " + " ".join(words[5:10]))


class SpanModel:
    """Trees and a threshold for each kind; without any, only base spans are found."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: np.ndarray | None = None):
        self.trees = trees or None
        self.thresholds = np.full(len(KINDS), np.inf) if thresholds is None else thresholds

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind index, end, base) of all spans of each text, in order of start, then kind."""
        out = []
        pending: list[tuple[int, tuple[int, int, int]]] = []
        rows = []
        for i, text in enumerate(texts):
            base = base_spans(text) if text else []
            out.append([(s, k, e, True) for s, k, e in base])
            if text and self.trees is not None:
                taken = Intervals(base)
                for c in candidates(text):
                    if taken.free(c[0], c[2]):
                        pending.append((i, c))
                        rows.append(features(text, c))
        if not pending:
            return out
        x = np.array(rows, float)
        p = self.trees.probability(x)
        kinds = np.array([c[1] for _, c in pending])
        good = np.flatnonzero(p >= self.thresholds[kinds])
        for i in {pending[g][0] for g in good}:
            own = sorted((g for g in good if pending[g][0] == i), key=lambda g: (not valid_form(texts[i], pending[g][1]), -p[g], pending[g][1]))
            taken = Intervals([])
            for g in own:
                s, k, e = pending[g][1]
                if taken.free(s, e):
                    taken.add(s, e)
                    out[i].append((s, k, e, False))
            out[i].sort()
        return out


class Intervals:
    """Disjoint or overlapping intervals of one text, asked by overlap through blocks of positions."""

    BLOCK = 64

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for s, _, e in spans:
            self.add(s, e)

    def add(self, start: int, end: int) -> None:
        for b in range(start // self.BLOCK, (end - 1) // self.BLOCK + 1):
            self.blocks.setdefault(b, []).append((start, end))

    def free(self, start: int, end: int) -> bool:
        near = range(start // self.BLOCK, (end - 1) // self.BLOCK + 1)
        return not any(s < end and start < e for b in near for s, e in self.blocks.get(b, ()))


def redact(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the first one's kind, as ``<EMAIL>``."""
    if not text or not spans:
        return text
    out, upto = [], 0
    for start, kind, end, _ in spans:
        if start >= upto:
            out += [text[upto:start], f"<{KINDS[kind].upper()}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


#: Rows of :func:`_counted`: half of the texts, what the row is (1 and 0: a taught row, -1: base spans of the kind in x), features, number.
_ROWS = "half int, y double, x array<double>, n bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different taught rows of the texts of each slice, and their base spans by kind, with their numbers."""
    release()
    for batch in batches:
        for part in slices(batch, "text"):
            counts: Counter = Counter()
            for half, text in zip(part.column("half").to_pylist(), part.column("text").to_pylist()):
                counts.update((half, y, tuple(x)) for x, y in _examples(text))
                counts.update((half, -1.0, (float(k),)) for _, k, _ in base_spans(text))
            yield _row_batch([(*key, n) for key, n in counts.items()])
    give_back()


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["half", "y", "x", "n"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and n of a batch of taught rows."""
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
    return x, batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(float)


def _sums(rows: DataFrame, cuts: list[np.ndarray]) -> Callable[[BoostedTrees, tuple | None], np.ndarray]:
    """What :meth:`BoostedTrees.fit_sums` asks for, by one Spark job each; a task gives one row."""

    def over(trees: BoostedTrees, root: tuple | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(trees.histogram(*_arrays(b), cuts, root) for b in batches if b.num_rows)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = [np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()]
        return sum(got).reshape(1 if root is None else 2, len(cuts), trees.bins + 1, 3)

    return over


def _cells(trees: BoostedTrees) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, n = _arrays(batch)
                cell = np.floor(np.clip(trees.margin(x), -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
                columns = (x[:, : len(KINDS)].argmax(axis=1).astype(np.int64), cell, y, n.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "cell", "y", "n"])

    return run


def fit_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Learn from every text with a digit or an at sign; halves are told by a hash of id and text.

    Kinds with few base spans are taught by stand-ins.  If a half has nothing to teach,
    as with fewer than two such texts, only base spans are found later.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("personal data"))
    some = docs.select(F.col(text_col).alias("text"), place.alias("place")).where(F.col("text").rlike("[0-9@]"))
    halved = some.withColumn("half", F.pmod("place", F.lit(2)).cast("int"))
    counted = halved.select("half", "text").mapInArrow(_counted, _ROWS).groupBy("half", "y", "x").agg(F.sum("n").alias("n"))
    every = scratch.table(counted, "rows")
    held = {(r["half"], int(r["kind"])): r["n"] for r in every.where("y < 0").select("half", F.col("x")[0].alias("kind"), "n").collect()}
    missing = [[k for k in range(len(KINDS)) if held.get((half, k), 0) < LEAST_SPANS] for half in (0, 1)]
    rows = every.where("y >= 0")
    if any(missing):
        carriers = [[r["text"] for r in halved.where(F.col("half") == h).select(F.substring("text", 1, 200).alias("text"), "place").orderBy("place", "text").limit(CARRIERS).collect()] for h in (0, 1)]
        extra = [(h, y, list(map(float, x)), 1) for h in (0, 1) for x, y in _stand_ins(carriers[h], missing[h])]
        rows = rows.union(scratch.table(docs.sparkSession.createDataFrame(extra, _ROWS), "stand_ins"))
    model = _taught(rows)
    scratch.keep_only()
    return model


def _taught(rows: DataFrame) -> SpanModel:
    """The model of taught rows: those of half 0 fit the trees, those of half 1 calibrate them and set the thresholds."""
    fit, rest = (rows.where(F.col("half") == h) for h in (0, 1))
    trees = BoostedTrees()
    places = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, trees.bins + 1)[1:-1]])
    width = len(features("0", (0, 0, 1)))
    asked = [z for i in range(width) for z in (F.percentile(F.col("x")[i], places, F.col("n")).alias(f"q{i}"), F.max(F.col("x")[i]).alias(f"m{i}"))]
    told = fit.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"), *asked).first()
    if not told["n"] or not 0 < told["good"] < told["n"] or not rest.limit(1).count():
        return SpanModel()
    cuts = [np.unique(told[f"q{i}"]) for i in range(width)]
    cuts = [c[c < told[f"m{i}"]] for i, c in enumerate(cuts)]
    trees.fit_sums(told["good"] / told["n"], cuts, _sums(fit.select("y", "x", "n"), cuts))
    seen = rest.select("y", "x", "n").mapInArrow(_cells(trees), "kind bigint, cell bigint, y double, n bigint")
    cells = seen.groupBy("kind", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good")).collect()
    kind, margin, n, good = (np.array([r[c] for r in cells], float) for c in ("kind", "cell", "n", "good"))
    margin /= STEPS
    trees.calibrate_margins(np.tile(margin, 2), np.repeat([1.0, 0.0], len(cells)), np.concatenate([good, n - good]))
    thresholds = np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        if not good[own].any():
            continue
        own = own[np.argsort(-margin[own])]
        fine = np.flatnonzero(np.cumsum(good[own]) / np.cumsum(n[own]) >= PRECISION)
        if len(fine):
            last = fine[-1]
            # Where all rows may pass, less probable ones than the least of this half may too.
            least = 1 / (1 + np.exp(-(trees.slope * margin[own[last]] + trees.offset))) if last + 1 < len(own) else 0.0
            thresholds[k] = max(LEAST_PROBABILITY, least)
    return SpanModel(trees, thresholds)


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]
    )
)


def personal_data(
    docs: DataFrame, model: SpanModel, text_col: str = "text", keep: list[str] | None = None, redacted: bool = False
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``spans`` of each whole text and, if asked for, ``redacted``.

    spans: (kind, start, end, base) structs by start, then kind; code points, end
    exclusive.  A null or empty text has none; its redacted form is itself.
    Repeated rows give the same spans; an empty table gives an empty one; columns with
    the new names are replaced.  A very long text is searched in place, in time in
    proportion to its length.
    """
    fields = [("spans", _SPANS)] + ([("redacted", T.StringType())] if redacted else [])

    def make() -> Callable[[list], list[list]]:
        def find(texts: list) -> list[list]:
            found = model.spans(texts)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans] for spans in found]
            return [rows, [redact(t, s) for t, s in zip(texts, found)]] if redacted else [rows]

        return find

    return with_text_columns(docs, text_col, fields, make, keep)


def redact_personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with its texts redacted and, if named, the column of their lengths brought up to date.

    A null or empty text stays as it is, and so does the length of a text that holds
    nothing personal.  Repeated rows are redacted alike; columns, whatever their names,
    and their order stay.  An empty table gives an empty one.  A very long text is searched
    and rewritten in place.
    """
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index(text_col)]
    out = personal_data(docs.toDF(*names), model, text, redacted=True)
    picked = {text_col: F.col("redacted")}
    if length_col in columns:
        i = columns.index(length_col)
        changed = F.col("redacted").isNotNull() & (F.col("redacted") != F.col(text))
        picked[length_col] = F.when(changed, F.length("redacted").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"c{i}"))
    return out.select(*[picked.get(c, F.col(n)).alias(c) for n, c in zip(names, columns)])
