"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds.

Spans of four base kinds with a strict format are always redacted. Wider
generators propose further, overlapping candidates; trees that are fitted on
candidates of a bounded sample score each of them, and those above the threshold
of their kind are redacted too.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retinue.llm.boosting import Trees, calibrated_cut, fit
from retinue.llm.words import small_batches

#: Base kinds in the order of the contract, then the kinds that only the trees decide on.
KINDS = ("email", "ip", "card", "phone", "account", "secret")
BASE_KINDS = 4
#: Candidates that the trees are fitted and calibrated on, at most; each kind has an equal
#: share of base spans and one of other candidates.
TRAINING_ROWS = 20_000
#: Share of true spans among those a threshold selects, in calibration.
PRECISION = 0.95
#: Positive candidates of a kind that calibration needs.
LEAST_SHOWN = 20
#: Threshold of a kind with fewer positive candidates than that.
FALLBACK = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either begins a match or none of its digits does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Runs are taken whole: what follows a possessive quantifier gives nothing back, and a run is tried from its begin only.
_WIDE = (
    ("email", re.compile(r"(?<![^\s@<>])[^\s@<>]+(?:@|\s?[\[(]at[\])]\s?)[^\s@<>]{3,}+")),
    ("ip", re.compile(r"(?<![0-9])(?<![0-9A-Fa-f]:)[0-9]{1,4}(?:[.:][0-9]{1,4}){2,7}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?:(?:\.[0-9]{1,3}){3})?(?![\w:])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,20}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,15}(?![0-9])")),
    ("account", re.compile(r"\b[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{8,}+\b")),
    ("secret", re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[^\s,;]{6,}+")),
)
_AT = re.compile(r"\s?[\[(]at[\])]\s?")
_DOT = re.compile(r"[\[(]dot[\])]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
#: National numbers: an area code in brackets is enough, other groups need a hint before them.
_AREA = re.compile(r"\([0-9]{2,4}\)[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}")
_NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}|[0-9]{9,11}")
_CARD_GROUPS = re.compile(r"[0-9]{4}(?:[\x20.-][0-9]{4}){2,3}(?:[\x20.-][0-9]{1,3})?|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{4,5}")
#: Words before a candidate that speak of its kind.
_OWN_HINTS = tuple(
    re.compile(rf"(?i){words}")
    for words in (
        r"mail|contact|write|reach",
        r"\bip\b|host|server|addr",
        r"card|visa|master|amex|credit|debit|pay",
        r"phone|\btel|\bcall|\bfax|mobile|\bcell|\bsms|whatsapp|\bring\b|\bdial",
        r"account|iban|bank",
        r"password|secret|token|key|login",
    )
)
_HINTS = re.compile(r"(?i)mail|phone|tel|call|\bip\b|host|card|visa|iban|account|password|secret|token|key")
#: Code points looked at before a candidate.
CONTEXT = 24
_ANY = re.compile(rb"[0-9@]|::")
_WORDS = re.compile(rb"(?i)[\[(]at[\])]|(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]")
#: Left out at the end of a proposed email.
_TRAILING = ".,;:!?)]}'\""


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", at + 1)


def _small_parts(number: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in number.split("."))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_long_address(text: str) -> bool:
    """Eight hex groups, fewer around one ``::``, the last two perhaps as four decimal parts."""
    try:
        return ":" in text and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def _is_phone(text: str) -> bool:
    return 10 <= sum(c.isdigit() for c in text) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base spans, sorted; leftmost and without overlap within a kind."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    for kind, pattern, valid in ((1, _IP, _small_parts), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the wide generators propose; spans of different kinds overlap."""
    kinds = {name: n for n, name in enumerate(KINDS)}
    found = {(m.start(), kinds[name], m.end()) for name, pattern in _WIDE for m in pattern.finditer(text)}
    return sorted((start, kind, end if kind else _email_end(text, start, end)) for start, kind, end in found)


def _email_end(text: str, start: int, end: int) -> int:
    own = text[start:end]
    while own and own[-1] in _TRAILING and not own.endswith(("[dot]", "(dot)")):
        own = own[:-1]
    return start + len(own)


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of one candidate."""
    start, kind, end = span
    own = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    groups = re.findall(r"[0-9]+", own)
    n = len(own)
    return [
        kind,
        n,
        sum(map(len, groups)),
        len(groups),
        max(map(len, groups), default=0),
        sum("A" <= c <= "Z" for c in own) / n,
        sum("a" <= c <= "z" for c in own) / n,
        sum(not c.isalnum() for c in own) / n,
        own.count("."),
        own.startswith("+"),
        own[0].isdigit() and int(own[0]),
        len(own.rpartition("@")[2]),
        own.rpartition("@")[2].count("."),
        _entropy(own),
        not before or before[-1].isspace(),
        not after or after.isspace(),
        after in (".", ",", ";", ")"),
        _HINTS.search(before) is not None,
        _OWN_HINTS[kind].search(before) is not None,
        "(" in own,
        "@" in own,
        _AT.search(own) is not None,
        len(set(own) & set("\x20./:-")),
        min(map(len, groups), default=0),
    ]


def _shown(text: str, span: tuple[int, int, int], base: set[tuple[int, int, int]]) -> bool:
    """Whether a candidate of the sample passes the check of its kind.

    Base spans do. Other candidates of these kinds need looser evidence: an
    email once ``[at]`` and ``[dot]`` are undone; a well-formed long address (hex
    groups, ``::`` once) or, after a hint, four parts of up to 255; the check digit of a card in
    groups by any separator, or after a hint; a national phone number with its
    area code in brackets, or after a hint.
    """
    start, kind, end = span
    if span in base:
        return True
    own, before = text[start:end], text[max(0, start - CONTEXT) : start]
    hinted = _OWN_HINTS[kind].search(before) is not None
    if kind == KINDS.index("email"):
        return _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", own))) is not None
    if kind == KINDS.index("ip"):
        parts = re.split("[.:]", own)
        return _is_long_address(own) or (hinted and len(parts) == 4 and all(part.isdigit() and int(part) <= 255 for part in parts))
    if kind == KINDS.index("card"):
        digits = re.sub("[^0-9]", "", own)
        return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits) and (hinted or _CARD_GROUPS.fullmatch(own) is not None)
    if kind == KINDS.index("phone"):
        national = hinted and 7 <= sum(c.isdigit() for c in own) <= 12 and _NATIONAL.fullmatch(own) is not None
        return national or _AREA.fullmatch(own) is not None
    if kind == KINDS.index("account"):
        return own.isupper() and 14 <= len(own) <= 34
    value = re.split(r"[=:]\s?", own, maxsplit=1)[-1]
    return len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


@dataclass(frozen=True)
class Model:
    """Trees for the probability that a candidate is personal data, and a threshold per kind."""

    trees: Trees | None
    cuts: tuple[float, ...]


def _text(value: bytes | None) -> str:
    """The text if anything in it may be personal data, else an empty one."""
    possible = value and (_ANY.search(value) or _WORDS.search(value))
    return value.decode() if possible else ""


def _proposed(doc_id: int | None, text: str):
    """``(span, base, key)`` of the candidates that the trees may learn from, with a sampling key below 2^32."""
    base = set(base_spans(text)) if text else set()
    for span in candidates(text) if text else ():
        exact = span in base
        if exact or not _overlaps(span, base):
            start, kind, end = span
            yield span, base, zlib.crc32(f"{doc_id} {start} {kind} {text[max(0, start - CONTEXT) : end]}".encode())


class _Least:
    """Of what is offered under a key, the ``size`` entries of least key."""

    def __init__(self, size: int) -> None:
        self.size, self.entries, self.bound = size, [], math.inf

    def wants(self, key: int) -> bool:
        return key < self.bound or (key == self.bound and len(self.entries) < self.size)

    def take(self, key: int, *entry) -> None:
        self.entries.append((key, *entry))
        if len(self.entries) >= 2 * self.size:
            self.cut()

    def cut(self) -> None:
        self.entries.sort()
        del self.entries[self.size :]
        if len(self.entries) == self.size:
            self.bound = self.entries[-1][0]


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` candidates, drawn from all documents in one pass.

    Each kind has an equal share of ``rows`` for base spans and one for others:
    those with the least hash, kept per task and then over all of them. A
    candidate is a positive case if it passes the check of its kind
    (:func:`_shown`). Half of the sample fits the trees. The other half
    calibrates the thresholds on what may be added, which base spans are not: a
    kind with fewer than ``LEAST_SHOWN`` positive cases there has the threshold
    ``FALLBACK``. Without any candidate there is nothing to learn from and
    nothing is added.
    """
    small_batches(docs.sparkSession)
    share = max(1, rows // (len(KINDS) + BASE_KINDS))
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def draw(batches):
        drawn = {(kind, base): _Least(share) for kind in range(len(KINDS)) for base in (False, True)}
        for batch in batches:
            values = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), map(_text, values)):
                for span, base, key in _proposed(doc_id, text):
                    own = drawn[span[1], span in base]
                    if own.wants(key):
                        own.take(key, int(_shown(text, span, base)), describe(text, span))
        for (kind, base), own in drawn.items():
            own.cut()
            if own.entries:
                keys, shown, features = zip(*own.entries)
                columns = [pa.array([kind] * len(keys), pa.int32()), pa.array([base] * len(keys), pa.bool_())]
                columns += [pa.array(keys, pa.int64()), pa.array(shown, pa.int32()), pa.array([list(map(float, f)) for f in features], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "base", "key", "shown", "features"])

    drawn = texts.mapInArrow(draw, "kind int, base boolean, key long, shown int, features array<double>")
    # Each task keeps the first of its rows per class ahead of the window, so no task gathers more than their sum.
    order = Window.partitionBy("kind", "base").orderBy("key", "shown", "features")
    table = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).toPandas()
    if table.empty:
        return Model(None, (2.0,) * len(KINDS))
    # In an order of its own, so that the result does not depend on the order of the rows.
    table = table.sort_values(["kind", "base", "place"])
    x = np.array(table["features"].tolist(), np.float64)
    y, base = table["shown"].to_numpy(np.float64), table["base"].to_numpy(bool)
    held_out = table["place"].to_numpy() % 2 == 0
    trees = fit(x[~held_out], y[~held_out], [0] * x.shape[1])
    score = trees.probability(x[held_out])
    cuts = []
    for kind in range(len(KINDS)):
        own = (x[held_out, 0] == kind) & ~base[held_out]
        enough = y[held_out][own].sum() >= LEAST_SHOWN
        cuts.append(max(0.5, calibrated_cut(score[own], y[held_out][own], PRECISION)) if enough else FALLBACK)
    return Model(trees, tuple(cuts))


def _overlaps(span: tuple[int, int, int], others) -> bool:
    return any(span[0] < end and start < span[2] for start, _, end in others)


def find_spans(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For every text its base spans and all its spans, both sorted by start and kind.

    The added spans overlap neither base spans nor each other; where candidates
    do, the one with the best score stays, then the leftmost, then the longest.
    """
    based = [base_spans(text) if text else [] for text in texts]
    wide, features = [], []
    if model.trees is not None:
        for n, text in enumerate(texts):
            for span in candidates(text) if text else ():
                if not _overlaps(span, based[n]):
                    wide.append((n, span))
                    features.append(describe(text, span))
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if wide:
        score = model.trees.probability(np.array(features, np.float64))
        order = sorted(range(len(wide)), key=lambda i: (-score[i], wide[i][1][0], -wide[i][1][2], wide[i][1][1]))
        for i in order:
            n, span = wide[i]
            if score[i] >= model.cuts[span[1]] and not _overlaps(span, added[n]):
                added[n].append(span)
    return [(base, sorted(base + more)) for base, more in zip(based, added)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    parts, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            parts += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """``<doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted>``, one row per row of ``docs``.

    Counts and ``base_sha256`` are of the base spans; ``spans`` has all of them
    as ``kind:start:end`` (code points, end exclusive). ``redacted`` is the text
    without them, null where nothing was found. Only ``doc_id`` and ``text``
    are read. Null and empty texts have no spans; null ids and repeated rows are
    rows like others; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]

    def find(batches):
        for batch in batches:
            texts = [_text(value) for value in batch.column("text").cast(pa.binary()).to_pylist()]
            found = find_spans(texts, model)
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(BASE_KINDS)]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            spans = [_joined(every) for _, every in found]
            clean = [redact(text, every) if every else None for text, (_, every) in zip(texts, found)]
            columns = [batch.column("doc_id"), *counts, *(pa.array(c, pa.string()) for c in (digests, spans, clean))]
            yield pa.RecordBatch.from_arrays(columns, names)

    counts = ", ".join(f"{name} long" for name in names[1:5])
    schema = f"doc_id long, {counts}, base_sha256 string, spans string, redacted string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)


def redact_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the spans of :func:`personal_data` redacted in ``text``, all columns and rows kept.

    ``n_chars``, if there, is counted anew for the texts that change.
    """
    small_batches(docs.sparkSession)

    def clean(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            found = find_spans([_text(value) for value in raw], model)
            changed = {n: redact(raw[n].decode(), every) for n, (_, every) in enumerate(found) if every}
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array([changed.get(n, value) for n, value in enumerate(batch.column("text").to_pylist())], batch.schema.field("text").type)
            if "n_chars" in columns:
                lengths = [len(changed[n]) if n in changed else value for n, value in enumerate(columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(clean, docs.schema)
