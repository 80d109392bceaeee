"""Secrets: fixed patterns, and more spans from the Shannon entropy of sliding windows over candidate strings.

A candidate is a longest run of at least ``WINDOW`` characters of ``[A-Za-z0-9+/_=-]``. A window of that many characters
slides over it; the counts of its characters, of its character classes and the sum of c * log2(c) are kept up to date by one
character that enters and one that leaves, for all candidates of a block at once. A window's class is the narrowest alphabet
that holds all its characters, and each class has its own threshold (``CLASSES``). Windows at or above it that mix digits
with letters, or change case often, are high; a candidate's span goes from its first high window of a row of overlapping
ones to the last, widened to the candidate's ends where these are nearer than a window.

Suppressed are candidates on the allow-list: words, numbers and names put together from them by marks or capitals, UUIDs,
parts of an e-mail address, and strings that the caller names. What the method adds never touches what the patterns found,
and what the patterns found stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Alphabet and bits per character from which a window is high; digits alone are numbers, never secrets.
CLASSES = {"digits": None, "lower hex": 2.9, "upper hex": 2.9, "lower and digits": 3.4, "upper and digits": 3.4, "all": 3.7}
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: A plain part of a name: a number, a word in capitals, or words in small letters whose first may be capitals.
_PLAIN = re.compile(r"[0-9]*|[A-Z]+[0-9]{0,4}|[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}")
_MARKS = re.compile(r"[+/_=-]+")
PIECE, BLOCK = 512, 1 << 22

_HEX = np.zeros(128, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_CANDIDATE = np.zeros(128, bool)
_CANDIDATE[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = True
#: Groups of characters: 0 digits, 1 a-f, 2 other small letters, 3 A-F, 4 other capitals, 5 marks.
_GROUP = np.full(128, 5, np.int8)
for _chars, _g in (("0123456789", 0), ("abcdef", 1), ("ghijklmnopqrstuvwxyz", 2), ("ABCDEF", 3), ("GHIJKLMNOPQRSTUVWXYZ", 4)):
    _GROUP[[ord(c) for c in _chars]] = _g
_LOG = np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))


def _masks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it of the hex alphabet, is it of a candidate's. Long texts go in pieces, so that a code point
    costs two bytes and no more."""
    hexes, others = [], []
    for a in range(0, len(text), BLOCK):
        code = np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, code, 0)
        hexes.append(_HEX[code])
        others.append(_CANDIDATE[code])
    return np.concatenate(hexes), np.concatenate(others)


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of at least ``least`` characters."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.concatenate(([0] if mask[0] else [], edge, [len(mask)] if mask[-1] else [])).astype(np.int64)
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def high_windows(candidates: list[str]) -> list[np.ndarray]:
    """For each candidate of at least WINDOW and at most PIECE characters: which windows, by their start, are high."""
    order = sorted(range(len(candidates)), key=lambda i: -len(candidates[i]))
    lens = np.array([len(candidates[i]) for i in order], np.int64)
    code = np.zeros((len(order), lens.max(initial=0)), np.uint8)
    for row, i in zip(code, order, strict=True):
        row[: len(candidates[i])] = np.frombuffer(candidates[i].encode(), np.uint8)
    counts = np.zeros((len(order), 128), np.int16)
    groups = np.zeros((len(order), 6), np.int16)
    cased = np.zeros(len(order), np.int16)  # neighbours in the window that differ in case
    load = np.zeros(len(order))
    high = np.zeros((len(order), max(0, code.shape[1] - WINDOW + 1)), bool)
    group = _GROUP[code]
    small, big = (group == 1) | (group == 2), (group == 3) | (group == 4)
    turn = (small[:, 1:] & big[:, :-1]) | (big[:, 1:] & small[:, :-1])
    for p in range(code.shape[1]):
        n = int(np.searchsorted(-lens, -p, side="left"))  # candidates longer than p
        rows = np.arange(n)
        at = code[:n, p]
        had = counts[rows, at]
        load[:n] += _LOG[had + 1] - _LOG[had]
        counts[rows, at] += 1
        groups[rows, group[:n, p]] += 1
        if p:
            cased[:n] += turn[:n, p - 1]
        if p >= WINDOW:
            gone = code[:n, p - WINDOW]
            had = counts[rows, gone]
            load[:n] += _LOG[had - 1] - _LOG[had]
            counts[rows, gone] -= 1
            groups[rows, group[:n, p - WINDOW]] -= 1
            cased[:n] -= turn[:n, p - WINDOW]
        if p >= WINDOW - 1:
            bits = np.log2(WINDOW) - load[:n] / WINDOW
            high[:n, p - WINDOW + 1] = _is_high(bits, groups[:n], cased[:n])
    out: list[np.ndarray] = [np.empty(0, bool)] * len(order)
    for row, i in zip(high, order, strict=True):
        out[i] = row[: len(candidates[i]) - WINDOW + 1]
    return out


def _is_high(bits: np.ndarray, groups: np.ndarray, cased: np.ndarray) -> np.ndarray:
    digits, af, small, big_af, big, marks = groups.T
    letters = af + small + big_af + big
    one_case = ((big_af + big == 0) | (af + small == 0)) & (marks == 0)
    as_hex = one_case & (small + big == 0)
    least = np.where(as_hex, CLASSES["lower hex"], np.where(one_case, CLASSES["lower and digits"], CLASSES["all"]))
    mixed = ((digits >= 2) & (letters >= 2)) | (cased >= 6)
    return (letters > 0) & mixed & (bits >= least - 1e-9)


def allowed(candidate: str, allow: frozenset[str] = frozenset()) -> bool:
    """On the allow-list: named by the caller, a UUID, or put together from plain words and numbers."""
    if candidate in allow or candidate.strip("+/_=-") in allow or _UUID.search(candidate):
        return True
    return all(_PLAIN.fullmatch(part) and (part[:2].isupper() or 3 * sum(map(str.isupper, part)) <= len(part)) for part in _MARKS.split(candidate))


def _spans_of(high: np.ndarray, length: int) -> list[tuple[int, int]]:
    at = np.flatnonzero(high)
    cuts = np.flatnonzero(np.diff(at) > WINDOW) + 1
    out = []
    for part in np.split(at, cuts):
        start, end = int(part[0]), int(part[-1]) + WINDOW
        out.append((0 if start < WINDOW else start, length if length - end < WINDOW else end))
    return out


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")):
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                yield m.start(), m.end()


def scan_texts(texts: list[str], allow: frozenset[str] = frozenset()) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, each span (start, kind, end) in code points."""
    out = []
    for part in _blocks(texts):
        starts = np.cumsum([0, *(len(t) + 1 for t in part)])
        hexes, others = _masks("\n".join(part) + "\n")
        base: list[list[tuple[int, int, int]]] = [[] for _ in part]
        for k, t in enumerate(part):
            base[k] += [(s, 0, e) for s, e in _assigned(t)]
            if "AKIA" in t:
                base[k] += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
        for s, e in zip(*(x.tolist() for x in _runs(hexes, 16)), strict=True):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            base[k].append((s - int(starts[k]), 2, e - int(starts[k])))
        found = []
        for s, e in zip(*(x.tolist() for x in _runs(others, WINDOW)), strict=True):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            s, e, t = s - int(starts[k]), e - int(starts[k]), part[k]
            if t[e : e + 1] != "@" and t[max(0, s - 1) : s] != "@" and not allowed(t[s:e], allow):
                found.append((k, s, e))
        out += [(sorted(b), a) for b, a in zip(base, _added(part, base, found), strict=True)]
    return out


def _added(texts: list[str], base: list[list[tuple[int, int, int]]], found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """What the windows of candidates (text, start, end) add. Candidates longer than PIECE are slid over in pieces whose
    windows follow one another, so that no step has less than a piece's share of the work."""
    pieces = [(i, a) for i, (_, s, e) in enumerate(found) for a in range(0, e - s - WINDOW + 1, PIECE - WINDOW + 1)]
    high = [np.zeros(e - s - WINDOW + 1, bool) for _, s, e in found]
    for a in range(0, len(pieces), 2048):
        some = pieces[a : a + 2048]
        cut = [texts[found[i][0]][found[i][1] + at : min(found[i][1] + at + PIECE, found[i][2])] for i, at in some]
        for (i, at), h in zip(some, high_windows(cut), strict=True):
            high[i][at : at + len(h)] = h
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, s, e), h in zip(found, high, strict=True):
        if h.any():
            for a, b in _spans_of(h, e - s):
                if all(y <= s + a or x >= s + b for x, _, y in base[k]):
                    added[k].append((s + a, 3, s + b))
    return added


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in blocks of at most BLOCK characters, or one longer text alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BLOCK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, allow: Iterable[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (patterns), base_sha256, spans (patterns and entropy), n_entropy.

    A span of ``assign`` is its whole match, key word included; its value has 12 characters or more. allow: strings that are
    no secrets, for the entropy spans only. A null text is empty and a text without spans has ''. Repeated rows are scanned
    each, a null doc_id is kept, further columns are ignored, and an empty table gives an empty result.
    """
    listed = frozenset(allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = []
                for base, added in scan_texts([x or "" for x in part.column(1).to_pylist()], listed):
                    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), run, schema)


def redact(docs: DataFrame, allow: Iterable[str] = ()) -> DataFrame:
    """docs with every span in text replaced by ``<SECRET>``, overlapping spans as one; other texts and all columns stay. An
    empty table gives an empty result."""
    listed, at = frozenset(allow), docs.columns.index("text")

    def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for s, _, e in sorted(spans):
            if s >= done:
                out += [text[done:s], "<SECRET>"]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for a in range(0, batch.num_rows, 512):
                old = batch.column(at).slice(a, 512).to_pylist()
                texts += [cleaned(o, b + x) if b or x else o for o, (b, x) in zip(old, scan_texts([o or "" for o in old], listed), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
