"""Personal data: fixed patterns, and more spans from a character-level BiLSTM-CRF (see tagger).

The tagger learns from labelled spans: those that the patterns find in a bounded sample of the documents, and made-up ones
in many ways of writing, most of which the patterns miss, set into passages of the sample. Every kind holds a digit, an @ or
a written-out (at), so only windows around these are decoded; no window without them could hold a span. Windows overlap by half. Each is decoded on its own; then a
document's findings are reconciled together: a span is taken if no overlapping one was found in more windows, or in as
many and is longer, and spans cut by a window's edge yield to the neighbour that sees them whole. What the tagger adds
must not touch what the patterns found, and must pass its kind's check (digits, parts, Luhn). What the patterns found stays.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tagger import PAD, Tagger, numbers

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would have started at its first one, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, by start and kind; leftmost and not overlapping within a kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := x.lstrip("0")) <= 3 and int(d or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _passes(kind: int, text: str) -> bool:
    d = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+", text))
    if kind == 1:
        parts = re.split(r" ?\. ?|-", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and bool(re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", text)) and luhn(d)
    # Figures in a row are no phone number: it shows a plus, 00, an area code in brackets, or three groups and one mark.
    shape = r"(?:\+|00)[0-9(][0-9 ()./-]*[0-9]|\(?[0-9]{2,5}\)[ -]?[0-9][0-9 .-]*[0-9]|[0-9]{2,4}([-.])[0-9]{2,4}(?:\1[0-9]{2,4})+"
    return 9 <= len(d) <= 15 and bool(re.fullmatch(shape, text))


def _made_up(rng: np.random.Generator, kind: int) -> str:
    """A span of a kind in one of many ways of writing."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))
    if kind == 0:
        at = rng.choice(["@", "@", " @ ", "@ ", " (at) ", "(at)", " [at] "])
        dot = str(rng.choice([".", " . "] if "@" in at else [".", " (dot) ", "(dot)", " [dot] "]))
        name = f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([num(rng.integers(1, 4)), word()])}"
        return f"{name}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', f'example{dot}com', f'co{dot}uk'])}"
    if kind == 1:
        return rng.choice([".", ".", ".", " . ", "-"]).join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        head = str(rng.integers(3, 7)) + num(14)
        card = next(head + c for c in "0123456789" if luhn(head + c))
        return rng.choice(["", "", " ", "-", "."]).join(card[i : i + 4] for i in range(0, 16, 4))
    area, three, four = num(3), num(3), num(4)
    return rng.choice([f"+1 ({area}) {three}-{four}", f"+{rng.integers(1, 99)} {area} {three} {four}", f"({area}) {three}-{four}", f"{area}-{three}-{four}", f"{area}.{three}.{four}", f"00{rng.integers(20, 60)} {area} {three} {four}"])


def _tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int8)
    for start, kind, end in spans:
        if not tags[start:end].any():
            tags[start] = 1 + 2 * kind
            tags[start + 1 : end] = 2 + 2 * kind
    return tags


def fit(docs: DataFrame, sample: int = 300, longest: int = 100_000, made_up: int = 2400, steps: int = 300, seed: int = 11) -> Tagger:
    """Trains on at most ``sample`` documents with a digit or @ and at most ``longest`` characters, those with the least
    hash of doc_id; without any on made-up spans alone."""
    found = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest))
    # Ids first: a limit over texts would send so many texts of every task to the driver.
    ids = [r["doc_id"] for r in found.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return train([], made_up, steps, seed)
    picked = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "_id long")  # ``sample`` rows at most
    rows = found.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(rows, key=lambda r: r["_id"])], made_up, steps, seed)


def train(texts: list[str], made_up: int = 2400, steps: int = 300, seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)
    ids, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]], at: int) -> None:
        x, y = numbers(text)[at : at + WINDOW], _tagged(text, spans)[at : at + WINDOW]
        ids.append(np.pad(x, (0, WINDOW - len(x)))), tags.append(np.pad(y, (0, WINDOW - len(y))))

    calm = []
    for t in texts:
        spans = base_spans(t)
        for m in list(_TRIGGER.finditer(t))[:: max(1, len(t) // 400)][:8]:
            add(t, spans, max(0, m.start() - int(rng.integers(8, WINDOW - 8))))
        at = int(rng.integers(0, max(1, len(t) - 200)))
        if not _TRIGGER.search(t, at, at + 200):
            calm.append(t[at : at + 200])
    calm = calm or ["the quick words of a plain text stand here, one after another, and say no more than that. So it goes on."]
    for i in range(made_up):
        base = calm[int(rng.integers(len(calm)))]
        cut, kind = int(rng.integers(0, max(1, len(base) - 80))), i % 5
        left, right = base[cut : cut + int(rng.integers(0, 40))].rsplit(" ", 1)[0], base[cut + 40 :].split(" ", 1)[-1]
        # One in five holds figures that are no personal data.
        plain = [f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", str(rng.integers(1900, 2100)), f"{rng.integers(1, 99)},{rng.integers(100, 999)}", f"v{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}", f"{rng.integers(1, 2000)}", f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 30)}", f"@{rng.choice(['home', 'work', 'noon'])}", f"{rng.integers(2, 9)} @ {rng.integers(2, 99)}.{rng.integers(10, 99)}", "(at) last", f"{rng.integers(1, 99)}-{rng.integers(1, 99)}", "".join(map(str, rng.integers(0, 10, rng.integers(5, 18))))]
        mid = _made_up(rng, kind) if kind < 4 else str(rng.choice(plain))
        text = f"{left} {mid} {right}"
        spans = [(len(left) + 1, kind, len(left) + 1 + len(mid))] if kind < 4 else []
        add(text, spans, 0 if len(left) + len(mid) < WINDOW - 4 else len(left) - 8)
    model = Tagger(1 + 2 * len(KINDS))
    model.train(np.array(ids), np.array(tags), steps)
    return model


def missed_spans(texts: list[str], count: int = 400, seed: int = 23) -> list[tuple[str, tuple[int, int, int]]]:
    """Labelled texts to hold a tagger against: made-up spans that the patterns miss, set between words of texts."""
    rng, out = np.random.default_rng(seed), []
    words = [w for t in texts for w in t.split() if not _TRIGGER.search(w)] or ["word"]
    while len(out) < count:
        left, right = (" ".join(words[i] for i in rng.integers(0, len(words), rng.integers(3, 12))) for _ in range(2))
        kind = len(out) % 4
        span = _made_up(rng, kind)
        text, where = f"{left} {span} {right}", (len(left) + 1, kind, len(left) + 1 + len(span))
        if where not in base_spans(text):
            out.append((text, where))
    return out


def recall_and_precision(model: Tagger, labelled: list[tuple[str, tuple[int, int, int]]]) -> dict[str, tuple[float, float]]:
    """By kind: share of the labelled spans that the tagger adds, and share of what it adds that is labelled."""
    added = [set(x) for _, x in tag_texts(model, [t for t, _ in labelled])]
    out = {}
    for kind, name in enumerate(KINDS):
        hit = sum(s in a for (_, s), a in zip(labelled, added, strict=True) if s[1] == kind)
        out[name] = (hit / max(1, sum(s[1] == kind for _, s in labelled)), hit / max(1, sum(x[1] == kind for a in added for x in a)))
    return out


def windows_of(text: str) -> list[int]:
    """Starts of the windows, on a grid of STRIDE, that hold a trigger or lie beside one that does."""
    cells = {m.start() // STRIDE for m in _TRIGGER.finditer(text)}
    return sorted({max(0, c + d) * STRIDE for c in cells for d in (-1, 0)})


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], None, 0
    for i, t in enumerate(tags.tolist() + [0]):
        if start is not None and t != 2 + 2 * kind:
            out.append((start, kind, i))
            start = None
        if t and t % 2 == 1:
            start, kind = i, (t - 1) // 2
    return out


def reconcile(text: str, found: Counter, cut: Counter, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that the tagger adds. found: spans by the number of windows that saw them whole; cut: those at an edge."""
    taken = [(s, e) for s, _, e in base]
    added = []
    for (start, kind, end), _ in sorted({**cut, **found}.items(), key=lambda x: (-found.get(x[0], 0), -(x[0][2] - x[0][0]), x[0])):
        while start < end and text[start] in " .,;:\n\t":
            start += 1
        while end > start and text[end - 1] in " .,;:-\n\t":
            end -= 1
        if start < end and all(e <= start or s >= end for s, e in taken) and _passes(kind, text[start:end]):
            # A longer number or word around it is something else.
            if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
                taken.append((start, end))
                added.append((start, kind, end))
    return added


def tag_texts(model: Tagger, texts: list[str], batch: int = 1024) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    found, cut = [Counter() for _ in texts], [Counter() for _ in texts]
    where = [(k, at) for k, t in enumerate(texts) for at in windows_of(t)]
    coded = {}
    for a in range(0, len(where), batch):
        part = where[a : a + batch]
        ids = np.full((len(part), WINDOW), PAD, np.int32)
        for row, (k, at) in zip(ids, part, strict=True):
            x = coded.get(k)
            if x is None:
                coded = {k: (x := numbers(texts[k]))}
            row[: len(x[at : at + WINDOW])] = x[at : at + WINDOW]
        tags = model.decode(ids)
        for n in np.flatnonzero(tags.any(axis=1)).tolist():
            k, at = part[n]
            for s, kind, e in _spans(tags[n]):
                edge = (s == 0 and at > 0) or (e == WINDOW and at + e < len(texts[k]))
                (cut if edge else found)[k][(at + s, kind, min(at + e, len(texts[k])))] += 1
    return [(b, reconcile(t, f, c, b)) for t, b, f, c in zip(texts, base, found, cut, strict=True)]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    col = batch.column(at)
    for a in range(0, batch.num_rows, 512):
        yield a, [x or "" for x in col.slice(a, 512).to_pylist()]


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (patterns), base_sha256, spans (patterns and tagger) of every whole text. A
    null text is empty. Texts of any length are searched whole; repeated rows each; further columns, whatever their names, are
    ignored; a null doc_id is kept; an empty table gives an empty result."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _pieces(batch, 1):
                rows = []
                for base, added in tag_texts(model, texts):
                    n = Counter(k for _, k, _ in base)
                    rows.append((*(n[k] for k in range(4)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + added))))
                cols = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), *cols], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, schema)


def mask(docs: DataFrame, model: Tagger) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; spans that overlap are replaced as one, by
    the kind of the first. Other texts stay as they are, null ones too; all columns are kept, whatever their names; repeated
    rows are masked each; an empty table gives an empty result."""
    at = docs.columns.index("text")

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
            if s >= done:
                out += [text[done:s], f"<{KINDS[k].upper()}>"]
            done = max(done, e)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for a, part in _pieces(batch, at):
                old = batch.column(at).slice(a, len(part)).to_pylist()
                texts += [masked(t, b + x) if b or x else o for t, o, (b, x) in zip(part, old, tag_texts(model, part), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
