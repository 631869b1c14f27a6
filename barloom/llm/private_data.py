"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base spans of e-mail addresses, IP addresses, card and phone numbers follow fixed patterns and always stay. The
field finds what the patterns miss: numbers written without their plus sign or with other separators, addresses with
"(at)" and "[dot]". It works on short runs of digit groups and on address-like runs. A run is a lattice: each edge is
a segment of at most ``MOST_GROUPS`` groups with a type, or a single group outside any entity. Features look at whole
segments (digits, shape of the groups, separators, checksum, edges, the word before). Dynamic programming over the
lattice sums all segmentations for learning, and for finding chooses boundaries and types jointly.

It is learned here, from a bounded sample of documents whose base spans are the truth, once as written and once with
their writing changed. A found segment is kept when its marginal probability reaches ``least`` and it meets no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import blocks

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, TRAIN_RUNS, MOST_GROUPS, LEAST = 4_000, 6_000, 8, 0.95
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Runs that the field looks at: digit groups with short separators, and addresses with marks written out.
NUMBERS = re.compile(r"[+(]{0,2}[0-9]+(?:[ ()./-]{1,3}[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
AT, DOT = r"(?:@|[\[({] ?(?:at|AT) ?[\])}])", r"(?:\.|[\[({] ?(?:dot|DOT) ?[\])}])"
ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?: ?{DOT} ?[A-Za-z0-9_%+-]{{1,64}}){{0,4}} ?{AT} ?[A-Za-z0-9-]{{1,63}}(?: ?{DOT} ?[A-Za-z0-9-]{{1,63}}){{1,6}}")
WRITTEN = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]|@ | @")
CONTEXT = {"phone": "tel telefon telefono teléfono téléphone telephone phone call fax mobile cell handy móvil portable", "card": "card visa mastercard amex carte karte tarjeta credit", "ip": "ip host server address adresse", "email": "mail email e-mail contact"}
CONTEXT_OF = {word: kind for kind, words in CONTEXT.items() for word in words.split()}
WIDTH = 256


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping per kind, in the order of ``KINDS`` and then of the start."""
    out: list[tuple[str, int, int]] = []
    end = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    if GROUP.search(text) is None:
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.groups())]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Run:
    """A lattice: ``edges`` are (from, to, kind index or -1 for outside, features, start, end)."""

    __slots__ = ("size", "edges")

    def __init__(self, size: int, edges: list):
        self.size, self.edges = size, edges


def _features(text: str, start: int, end: int, groups: list[str], kind: int) -> list[int]:
    piece = text[start:end]
    digits = "".join(groups)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    marks = re.sub(r"[0-9A-Za-z]+", "x", piece)
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())
    told = [
        "bias",
        f"n{n if n < 21 else 21}",
        f"groups{len(groups)}",
        "shape" + "-".join(str(len(g)) for g in groups),
        "marks" + marks if len(marks) < 16 else "long",
        "luhn" if 13 <= n <= 19 and luhn(digits) else "unchecked",
        "octets" if len(groups) == 4 and all(int(g[:6]) <= 255 for g in groups) and piece.count(".") == 3 else "other",
        f"edge{int(before.isalnum() or before in '.-_/#' and before != '')}{int(after.isalnum() or after in '-_/@' and after != '')}",
        f"first{piece[:1] if piece[:1] in '+(' else 'd'}",
        "at" if WRITTEN.search(piece) or "@" in piece else "noat",
        f"context{CONTEXT_OF.get(words[-1] if words else '', '-')}",
    ]
    return [zlib.crc32(f"{kind}:{x}".encode()) % WIDTH for x in told]


def lattices_of(text: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Size and edges of each lattice of a text, edges in the order of their start. However long a run is, it is one
    lattice: its edges grow with its groups only, and come one by one."""
    if GROUP.search(text):
        for m in NUMBERS.finditer(text):
            if sum(map(str.isdigit, m[0])) < 7:
                continue
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
            yield len(groups), _numbers(text, groups)
    if WRITTEN.search(text):
        for m in ADDRESS.finditer(text):
            if WRITTEN.search(m[0]):
                yield 1, iter([(0, 1, -1, [], m.start(), m.end()), (0, 1, 0, _features(text, m.start(), m.end(), GROUP.findall(m[0]), 0), m.start(), m.end())])


def runs_of(text: str) -> Iterator[Run]:
    for size, edges in lattices_of(text):
        yield Run(size, list(edges))


def _numbers(text: str, groups: list[tuple[int, int]]) -> Iterator[tuple]:
    for i, (start, _) in enumerate(groups):
        yield i, i + 1, -1, [], start, groups[i][1]
        digits = 0
        for j in range(i, min(len(groups), i + MOST_GROUPS)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits < 7 and j - i != 3:
                continue
            first = start
            while first and text[first - 1] in "+(" and start - first < 2:
                first -= 1
            own = [text[a:b] for a, b in groups[i : j + 1]]
            for kind in (1, 2, 3):
                if kind == 1 and j - i != 3 or kind == 2 and not 13 <= digits <= 19 or kind == 3 and not 7 <= digits <= 15:
                    continue
                at = first if kind == 3 else start
                yield i, j + 1, kind, _features(text, at, groups[j][1], own, kind), at, groups[j][1]


class SemiMarkovField:
    """Weights of segment features; segments outside entities score 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(WIDTH) if weights is None else np.asarray(weights, float)

    def scores(self, run: Run) -> list[float]:
        w = self.weights
        return [float(w[f].sum()) if f else 0.0 for _, _, _, f, _, _ in run.edges]

    def marginals(self, run: Run, scores: list[float]) -> list[float]:
        """Probability of each edge over all segmentations: forward and backward sums."""
        return _marginals([e[0] for e in run.edges], [e[1] for e in run.edges], run.size, scores, range(len(scores)))

    def best(self, run: Run, scores: list[float]) -> list[int]:
        """Edges of the segmentation of greatest score."""
        return _best([e[0] for e in run.edges], [e[1] for e in run.edges], run.size, scores)

    def learn(self, examples: list[tuple[Run, set[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> SemiMarkovField:
        """Maximum likelihood by adaptive gradient steps; the truth of a run are its spans."""
        squares = np.full(WIDTH, 1e-6)
        for _ in range(rounds):
            for run, spans in examples:
                scores = self.scores(run)
                found = self.marginals(run, scores)
                step = -decay * self.weights
                for (_, _, kind, features, a, b), p in zip(run.edges, found, strict=True):
                    if kind >= 0:
                        np.add.at(step, features, float((KINDS[kind], a, b) in spans) - p)
                squares += step * step
                self.weights += rate * step / np.sqrt(squares)
        return self

    def find(self, text: str, base: list[tuple[str, int, int]], least: float = LEAST) -> list[tuple[str, int, int]]:
        taken = sorted((a, b) for _, a, b in base)
        out, w = [], self.weights
        for size, edges in lattices_of(text):
            # Of an edge numbers are held only, not its features: a run may be as long as the text.
            left, right, kinds, starts, ends, scores = (array(x) for x in "qqbqqd")
            for edge in edges:
                for column, value in zip((left, right, kinds, starts, ends), (*edge[:3], *edge[4:]), strict=True):
                    column.append(value)
                scores.append(float(w[edge[3]].sum()) if edge[3] else 0.0)
            chosen = [k for k in _best(left, right, size, scores) if kinds[k] >= 0]
            if not chosen:
                continue
            for k, probability in zip(chosen, _marginals(left, right, size, scores, chosen), strict=True):
                if probability >= least and not _meets(taken, starts[k], ends[k]):
                    out.append((KINDS[kinds[k]], starts[k], ends[k]))
        return out


def _marginals(left: Sequence[int], right: Sequence[int], size: int, scores: Sequence[float], asked: Iterable[int]) -> list[float]:
    """Probability of the edges ``asked`` for."""
    ahead, behind = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
    ahead[0] = behind[size] = 0.0
    for k in sorted(range(len(scores)), key=left.__getitem__):
        ahead[right[k]] = _add(ahead[right[k]], ahead[left[k]] + scores[k])
    for k in sorted(range(len(scores)), key=lambda k: -right[k]):
        behind[left[k]] = _add(behind[left[k]], scores[k] + behind[right[k]])
    return [math.exp(min(0.0, ahead[left[k]] + scores[k] + behind[right[k]] - ahead[size])) for k in asked]


def _best(left: Sequence[int], right: Sequence[int], size: int, scores: Sequence[float]) -> list[int]:
    top: list[tuple[float, int]] = [(-math.inf, -1)] * (size + 1)
    top[0] = (0.0, -1)
    for k in sorted(range(len(scores)), key=left.__getitem__):
        top[right[k]] = max(top[right[k]], (top[left[k]][0] + scores[k], k))
    out, at = [], size
    while at:
        out.append(top[at][1])
        at = left[top[at][1]]
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in taken)


def variants(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, str, set[tuple[str, int, int]]]]:
    """Each base span with its surroundings as written, and in other writings: (kind, text, true spans)."""
    for kind, a, b in spans:
        left, own, right = text[max(0, a - 30) : a], text[a:b], text[b : b + 30]
        forms = [own]
        if kind == "phone":
            forms += [own[1:], own[1:].replace(" ", "."), re.sub("[()]", "", own[1:]), "00" + own[1:]]
        elif kind == "card":
            digits = re.sub("[ -]", "", own)
            forms += [".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), digits]
        elif kind == "email":
            forms += [own.replace("@", " (at) ").replace(".", " (dot) "), own.replace("@", "[at]").replace(".", "[dot]"), own.replace("@", " (at) ")]
        for form in forms:
            yield kind, left + form + right, {(kind, len(left), len(left) + len(form))}


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS, runs: int = TRAIN_RUNS) -> np.ndarray:
    """Weights of the field, from about ``rows`` documents (by a hash of the id) of those with base spans, and the
    first ``runs`` lattices of these in the order of a hash."""
    texts = docs.where(docs[text_column].rlike("[0-9@]")).select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    n = texts.count()
    buckets = 1 << 30
    part = texts if n <= rows else texts.where(F.pmod(F.xxhash64("id"), F.lit(buckets)) < rows * buckets // n)

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for text in batch.column(1).to_pylist():
                for kind, piece, truth in variants(text, base_spans(text)):
                    pieces.append((zlib.crc32(piece.encode()), kind, piece))
                taken = [(a, b) for _, a, b in base_spans(text)]
                for m in list(NUMBERS.finditer(text))[:8]:
                    if not _meets(taken, m.start(), m.end()):
                        piece = text[max(0, m.start() - 30) : m.end() + 30][:200]
                        pieces.append((zlib.crc32(piece.encode()), "", piece))
            order, kinds, texts = zip(*pieces, strict=True) if pieces else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["order", "kind", "piece"])

    pieces = part.mapInArrow(lattices, "order long, kind string, piece string").where(F.length("piece") < 400).distinct().orderBy("order", "kind", "piece").limit(runs).collect()
    field = SemiMarkovField()
    return field.learn([x for r in pieces for x in _example(r.kind, r.piece)]).weights


def _example(kind: str, piece: str) -> list[tuple[Run, set[tuple[str, int, int]]]]:
    """The lattices of a piece; its truth is the span of its kind that stands between the 30 characters around it."""
    out = []
    for run in runs_of(piece):
        truth = set()
        if kind:
            own = [(e[5] - e[4], e) for e in run.edges if e[2] == KINDS.index(kind) and e[4] <= 32 and e[5] >= len(piece) - 32]
            truth = {(kind, e[4], e[5]) for _, e in sorted(own, key=lambda x: -x[0])[:1]}
            if not truth:
                continue
        out.append((run, truth))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_private(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """``id_column, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row: counts and digest of the base spans,
    and all spans as ``kind:start:end`` (code points, end exclusive).

    A NULL text counts as empty: no spans, the digest of nothing. Rows that repeat give rows that repeat; other
    columns aren't read. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkovField(weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                rows = []
                for text in texts[a:b]:
                    base = base_spans(text) if text else []
                    more = field.find(text, base, least) if text else []
                    kinds = [k for k, _, _ in base]
                    rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string").withColumnRenamed("id", id_column)
