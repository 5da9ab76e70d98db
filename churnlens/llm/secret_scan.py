"""Secret scan: fixed patterns plus a battery of randomness tests.

Base spans are the matches of three patterns.  The method adds long runs of
encoding characters that look random:
1. Runs are cut at inner '=' and around base spans, and a piece that fits no
   alphabet at the characters that keep it from the nearest one; all pieces of 16
   or more characters are tested.  The encoding (alphabet) of a piece is inferred
   from its characters.
2. Chi-squared uniformity over the alphabet, a runs test about its middle and a
   lag-1 serial correlation test give p-values under randomness; Fisher's method
   combines them into one score, high for random strings.
3. Decoys, the letters of every whole text run together and cut into strings of
   all length classes, are scored in the same way, in every alphabet in turn.  A
   candidate's p-value is the share of decoys of its alphabet and length class that
   score as high.  Where fewer than ``FEW`` do, the share is the tail of a normal
   law fitted to the logarithm of the alphabet's decoys' evidence a character, over
   all lengths (its spread falls with the length's root); ``PRIOR`` decoys of a
   fixed passage of prose stand in where a table has hardly any text.  So a string
   is judged alike in a table of one document and of a million.
   Benjamini-Hochberg, per alphabet over all length classes and documents, keeps
   the expected share of false spans below ``rate``.

Offsets are code points, ends exclusive.  Null and empty texts have no spans.
Repeated rows get the same result each (each counts in the statistics).  An empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import keyed

# fixed values: base patterns, kinds in the order of ties, least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
VALUE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
MIXED = (re.compile("[_-]"), re.compile("[+/]"))  # what keeps a piece from the one or the other widest alphabet
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_CHARS = 12
ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
LENGTHS = (16, 24, 32, 48, 64)
STEPS, FINE, STEP, MOST = 240, 120, 0.05, 300.0  # classes of -log10(score): FINE equal ones, then geometric ones
RATE, FEW, PRIOR = 0.05, 10, 8.0
_TOGETHER = 1 << 20  # bytes of text whose decoys are scored at once
# fixed value: letters that stand in for a table's own text
PROSE = ("the rain had stopped before the village woke and the road along the river was still dark with water when the first carts came down "
         "from the farms with milk and apples and a few letters that nobody had asked for the baker opened his door and looked at the sky "
         "then went back to his bread because there was nothing else to be done about the weather that day or any other day in autumn")

_SETS = [frozenset(a) for a in ALPHABETS]
_TABLES = []
for _a in ALPHABETS:
    _t = np.full(128, 0, dtype=np.int64)
    for _i, _c in enumerate(_a):
        _t[ord(_c)] = _i
    for _c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":  # decoy letters outside the alphabet wrap round
        if _c not in _a:
            _t[ord(_c)] = (ord(_c.lower()) - 97) % len(_a)
    _TABLES.append(_t)


def alphabet_of(run: str) -> int | None:
    """Number of the smallest alphabet that holds the run (padding removed)."""
    chars = set(run)
    return next((i for i, a in enumerate(_SETS) if chars <= a), None)


def _upper(z: float) -> float:
    """Normal upper tail."""
    return 0.5 * erfc(z / 1.4142135623730951)


def randomness(run: str, alphabet: int) -> float:
    """Fisher-combined p-value of the three tests under randomness."""
    x = _TABLES[alphabet][np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    n, size = len(x), len(ALPHABETS[alphabet])
    counts = np.bincount(x, minlength=size)
    df = size - 1
    chi = size / n * float((counts * counts).sum()) - n
    p_chi = _upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5) if chi > 0 else 1.0
    side = 2 * x >= size
    above = int(side.sum())
    below = n - above
    if above and below:
        runs = 1 + int((side[1:] != side[:-1]).sum())
        mean = 1 + 2 * above * below / n
        spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9) ** 0.5
        p_runs = 2 * _upper(abs(runs - mean) / spread)
    else:
        p_runs = 2 * 0.5 ** n
    centred = x - x.mean()
    power = float((centred * centred).sum())
    p_serial = 2 * _upper(abs(float((centred[1:] * centred[:-1]).sum()) / power) * n ** 0.5) if power else 0.0
    half = -sum(np.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))  # half of Fisher's statistic, 6 degrees
    return float(np.exp(-half) * (1 + half + half * half / 2))


def _steps(v: np.ndarray) -> np.ndarray:
    """The class of -log10(score)."""
    edge = FINE * STEP
    far = FINE + (STEPS - FINE) * np.log(np.maximum(v, edge) / edge) / np.log(MOST / edge)
    return np.minimum(np.where(v < edge, v / STEP, far), STEPS - 1).astype(np.int64)


def _edges() -> np.ndarray:
    """The lower edges of the classes, and the upper edge of the last."""
    edge = FINE * STEP
    return np.concatenate((np.arange(FINE) * STEP, edge * (MOST / edge) ** (np.arange(STEPS - FINE + 1) / (STEPS - FINE))))


def _class(score: float) -> int:
    return int(_steps(np.array([-np.log10(max(score, 1e-300))]))[0])


def evidence(x: np.ndarray, size: int) -> np.ndarray:
    """-log10 of ``randomness`` of many strings of one length: a row of symbol numbers each, of ``size`` symbols."""
    m, n = x.shape
    tail = lambda z: np.fromiter(map(erfc, (z / 1.4142135623730951).tolist()), float, m) * 0.5
    counts = np.bincount((np.arange(m)[:, None] * size + x).ravel(), minlength=m * size).reshape(m, size)
    df = size - 1
    chi = size / n * (counts * counts).sum(axis=1) - n
    p_chi = np.where(chi > 0, tail(((np.maximum(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5), 1.0)
    side = 2 * x >= size
    above = side.sum(axis=1)
    mean = 1 + 2 * above * (n - above) / n
    runs = 1 + (side[:, 1:] != side[:, :-1]).sum(axis=1)
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p_runs = np.where((above > 0) & (above < n), 2 * tail(np.abs(runs - mean) / spread), 2 * 0.5 ** n)
    centred = x - x.mean(axis=1, keepdims=True)
    power = (centred * centred).sum(axis=1)
    serial = np.abs((centred[:, 1:] * centred[:, :-1]).sum(axis=1)) / np.where(power > 0, power, 1) * n ** 0.5
    p_serial = np.where(power > 0, 2 * tail(serial), 0.0)
    half = -(np.log(np.maximum(p_chi, 1e-300)) + np.log(np.maximum(p_runs, 1e-300)) + np.log(np.maximum(p_serial, 1e-300)))
    return np.maximum((half - np.log1p(half + half * half / 2)) / np.log(10), 0.0)


def _code(alphabet: int, length: int, step: int) -> int:
    return (alphabet * len(LENGTHS) + length) * STEPS + step


def _length_class(n: int) -> int:
    return sum(n >= least for least in LENGTHS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    for run in RUN.finditer(text):  # the other two lie within a run, up to its characters
        part, at = run.group(), run.start()
        found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(part)]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part)]
    return sorted(found)


def pieces(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, str, int]]:
    """(start, piece, alphabet) of the pieces of all runs that lie outside base spans."""
    for run in RUN.finditer(text):
        start, end = run.span()
        free = start
        for s, e in [*((s, e) for s, _, e in base if s < end and start < e), (end, end)]:  # by start
            for value in VALUE.finditer(text, free, max(s, free)):
                part = value.group()
                if (alphabet := alphabet_of(part)) is not None:
                    yield value.start(), part, alphabet
                    continue
                breaks = min(MIXED, key=lambda b: len(b.findall(part)))
                at = 0
                for stop in [*(m.start() for m in breaks.finditer(part)), len(part)]:
                    if stop - at >= LENGTHS[0]:
                        yield value.start() + at, part[at:stop], alphabet_of(part[at:stop])
                    at = stop + 1
            free = max(free, e)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, code) of the pieces of runs outside base spans."""
    return [(start, start + len(part), _code(alphabet, _length_class(len(part)), _class(randomness(part, alphabet))))
            for start, part, alphabet in pieces(text, base)]


# every alphabet at every length class, one after the other; a text begins somewhere in this round
_ROUND = [(length, alphabet) for alphabet in range(len(ALPHABETS)) for length in range(len(LENGTHS))]
_STARTS = np.concatenate(([0], np.cumsum([LENGTHS[c] for c, _ in _ROUND])))
_NOT_LETTERS = bytes(sorted(set(range(256)) - set(range(65, 91)) - set(range(97, 123))))


def decoys(texts: list[tuple[int, bytes]]) -> np.ndarray:
    """Codes of the decoys of many (key, text): the letters of each whole text, cut into strings one after the other."""
    whole = int(_STARTS[-1])
    cut: dict[int, list[np.ndarray]] = {k: [] for k in range(len(_ROUND))}
    joined, base = [], 0
    for key, data in texts:
        letters = data.translate(None, _NOT_LETTERS)
        offset = int(_STARTS[key % len(_ROUND)])
        for k, (length, _) in enumerate(_ROUND):
            first = (int(_STARTS[k]) - offset) % whole
            if first + LENGTHS[length] <= len(letters):
                cut[k].append(base + np.arange(first, len(letters) - LENGTHS[length] + 1, whole))
        joined.append(letters)
        base += len(letters)
    letters = np.frombuffer(b"".join(joined), dtype=np.uint8)
    out = [np.zeros(0, dtype=np.int64)]
    for k, (length, alphabet) in enumerate(_ROUND):
        if cut[k]:
            x = _TABLES[alphabet][letters[np.concatenate(cut[k])[:, None] + np.arange(LENGTHS[length])]]
            out.append(_code(alphabet, length, 0) + _steps(evidence(x, len(ALPHABETS[alphabet]))))
    return np.concatenate(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base (start, kind, end), found (start, end, code): one pass over the texts.

    ``decoys`` holds the (code, n) of the decoys of some neighbouring rows, on the first of them.
    """
    rows = keyed(docs, id_col, text_col)
    span = "struct<start: int, kind: int, end: int>"
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text_key long, base array<{span}>, found array<struct<start: int, end: int, code: int>>, decoys array<struct<code: int, n: long>>"
    i32 = pa.int32()
    base_type = pa.list_(pa.struct([("start", i32), ("kind", i32), ("end", i32)]))
    found_type = pa.list_(pa.struct([("start", i32), ("end", i32), ("code", i32)]))
    decoy_type = pa.list_(pa.struct([("code", i32), ("n", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found, decoy, held, size, since = [], [], [[] for _ in range(batch.num_rows)], [], 0, 0
            for i, (key, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                text = text.as_py()
                own = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                found.append([{"start": s, "end": e, "code": c} for s, e, c in candidates(text, own)])
                held.append((key, text.encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= _TOGETHER or i + 1 == batch.num_rows:
                    code, n = np.unique(decoys(held), return_counts=True)
                    decoy[since] = [{"code": c, "n": x} for c, x in zip(code.tolist(), n.tolist())]
                    held, size, since = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, base_type), pa.array(found, found_type),
                                              pa.array(decoy, decoy_type)], names=["doc_id", "text_key", "base", "found", "decoys"])

    return rows.mapInArrow(work, schema)


def _table(counts: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(ALPHABETS) * len(LENGTHS), STEPS))
    for code, n in counts.items():
        out[divmod(code, STEPS)] = n
    return out


def _prior() -> np.ndarray:
    """``PRIOR`` decoys of the fixed passage for each alphabet."""
    codes = decoys([(k, PROSE.encode()) for k in range(len(_ROUND))])
    out = _table(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)))))
    per = out.reshape(len(ALPHABETS), -1)
    return (per * (PRIOR / per.sum(axis=1, keepdims=True))).reshape(out.shape)


def tail_law(null: np.ndarray) -> np.ndarray:
    """P(a decoy of the stratum has this class or a lower one), from the decoys of all lengths of its alphabet."""
    edges, out = _edges(), np.ones_like(null)
    lengths = np.array(LENGTHS, dtype=float)[:, None]
    level = lambda v: np.log((v[None, :] + 1) / lengths)
    middle, upper = level((edges[:-1] + edges[1:]) / 2), level(edges[1:])
    weight = (null + _prior()).reshape(len(ALPHABETS), len(LENGTHS), STEPS)
    for a in range(len(ALPHABETS)):
        mean = (weight[a] * middle).sum() / weight[a].sum()
        spread = np.sqrt((weight[a] * lengths * (middle - mean) ** 2).sum() / weight[a].sum())
        z = (upper - mean) * np.sqrt(lengths) / max(spread, 1e-9)
        out[a * len(LENGTHS):(a + 1) * len(LENGTHS)] = [[_upper(-v) for v in row] for row in z.tolist()]
    return out


def p_values(decoy: dict[int, int]) -> np.ndarray:
    """The p-value of each stratum (alphabet, length class) and class; class 0 is the most random."""
    null = _table(decoy)
    beyond, whole = np.cumsum(null, axis=1), 1 + null.sum(axis=1, keepdims=True)
    few = np.minimum(tail_law(null), np.minimum((1 + FEW) / whole, 1.0))
    return np.maximum.accumulate(np.where(beyond >= FEW, (1 + beyond) / whole, few), axis=1)


def accepted_codes(candidate: dict[int, int], decoy: dict[int, int], rate: float = RATE) -> set[int]:
    """Codes that Benjamini-Hochberg accepts; both arguments count codes."""
    seen, p = _table(candidate), p_values(decoy)
    out = set()
    for alphabet in range(len(ALPHABETS)):
        own = range(alphabet * len(LENGTHS), (alphabet + 1) * len(LENGTHS))
        cells = sorted((p[s, k], s, k) for s in own for k in range(STEPS) if seen[s, k])
        m, cum, last = sum(seen[s, k] for _, s, k in cells), 0.0, -1.0
        for value, s, k in cells:
            cum += seen[s, k]
            if value <= rate * cum / m:
                last = value
        out |= {s * STEPS + k for value, s, k in cells if value <= last}
    return out


def _counts(rows: DataFrame, found: Column) -> dict[int, int]:
    """At most alphabets * lengths * steps entries; ``found`` is an array of structs with code and n."""
    rows = rows.select(F.explode(found).alias("f")).groupBy("f.code").agg(F.sum("f.n").alias("n"))
    return {r["code"]: r["n"] for r in rows.collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Per document: doc_id, text_key, base and spans (arrays of start, kind, end, kind named in ``spans``)."""
    rows = cut_lineage(scan(docs, id_col, text_col))
    each = F.transform("found", lambda s: F.struct(s["code"].alias("code"), F.lit(1).cast("long").alias("n")))
    accepted = accepted_codes(_counts(rows, each), _counts(rows, F.col("decoys")), rate)
    kept = F.filter("found", lambda s: s["code"].isin(*accepted) if accepted else F.lit(False))
    random = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
