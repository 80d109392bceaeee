"""Removal of word sequences that an earlier document holds, by level-wise doubling.

A window of n words can repeat only if the windows of half its length inside it repeat. So the first level looks at
windows of (n + 1) // 2 words, and of these only at one for each place of the text: the one with the least hash among
those inside a window of n words (equal windows have equal least ones, so none is missed). Those found in one document
alone end there. Around the others the windows of full length, at most twice as long, are compared. ``repeat_levels`` goes
on to twice the length of what still repeats, until nothing does.

A block of documents sends each hash once with what only it knows, packed into one binary value for each bucket of
hashes; what repeats inside the block is settled there. So a passage with any share of all rows reaches a bucket once for each
block, not once for each place. Windows are compared by 64-bit hashes of their words' 64-bit hashes (40 bits on the first
level, which only selects).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, map_arrow, unused
from .token_blocks import BLOCK_BYTES, Book

_WORDS = 300_000
#: Buckets in a shuffle partition, answers held at once, bytes of input for a partition, and those that no known input reaches.
_SUB, _ANSWERS, _PART_BYTES, _KNOWN_BYTES = 4, 1 << 22, 32 << 20, 1 << 55
_SPLIT = re.compile(rb"([\x20\x09-\x0D]+)")


class _Hasher:
    """Words' hashes; a worker remembers the words of a few blocks."""

    def __init__(self) -> None:
        self.book, self.hashes = Book(), np.empty(0, np.uint64)

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and where each text's begin."""
        if len(self.book) > _WORDS:
            self.__init__()
        numbers = []
        for t in texts:
            words = (t or "").encode().split()
            numbers.append(np.fromiter(map(self.book.__getitem__, words), np.int32, len(words)))
        known = len(self.hashes)
        new = b"".join(xxhash.xxh64_digest(w) for w in list(self.book)[known:])
        self.hashes = np.concatenate((self.hashes, np.frombuffer(new, ">u8").astype(np.uint64)))
        starts = np.concatenate(([0], np.cumsum([len(x) for x in numbers], dtype=np.int64)))
        return self.hashes[np.concatenate(numbers)] if numbers else self.hashes[:0], starts


def _factors(n: int) -> np.ndarray:
    """n odd numbers of 64 bits, always the same."""
    return np.array([xxhash.xxh64_intdigest(b"%d" % k) | 1 for k in range(n)], np.uint64)


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; places with fewer words behind them are left out."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k, factor in enumerate(_factors(n)):
        out += words[k : k + count] * factor
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _starts_of(text_starts: np.ndarray, n: int) -> np.ndarray:
    """The places where a window of n words begins that ends in the same text."""
    lens = np.maximum(np.diff(text_starts) - n + 1, 0)
    ends = np.cumsum(lens)
    return np.repeat(text_starts[:-1] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def _least(words: np.ndarray, text_starts: np.ndarray, n: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All window starts, for each the place of its least half-length window, and the half-length windows' hashes."""
    at = _starts_of(text_starts, n)
    hashes = _windows(words, half)
    if not len(at):
        return at, at, hashes
    inside = np.lib.stride_tricks.sliding_window_view(hashes, n - half + 1)
    least = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 18):
        part = at[a : a + (1 << 18)]
        least[a : a + len(part)] = part + inside[part].argmin(axis=1)
    return at, least, hashes


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, all first bytes before all second ones."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


_BLOB = "bucket int, ids binary, keys binary, hash binary, doc binary, place binary, told_doc binary, told_place binary"
_FOUND = "bucket int, ids binary, keys binary, places binary"


def _first_of(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)


def _blobs(doc_ids: np.ndarray, keys: np.ndarray, owner: np.ndarray, place: np.ndarray, hashes: np.ndarray, width: int, buckets: int, earlier: bool) -> pa.RecordBatch:
    """What a block sends: windows (their text's number in the block, place in the text, hash) by bucket.

    earlier: told are the windows that a smaller doc_id of the block has too; asked are those of the block's smallest.
    Otherwise told are the windows of two or more doc_ids, which also send one entry without an asker: its text's number is
    the one behind the last.
    """
    order = np.argsort(hashes, kind="stable")
    owner, place, hashes = owner[order], place[order], hashes[order]
    ids, begin = doc_ids[owner], _first_of(hashes)
    lens = np.diff(np.append(begin, len(hashes)))
    low = np.minimum.reduceat(ids, begin) if len(begin) else ids
    silent = np.zeros(len(ids), bool)
    if earlier:
        told = ids > np.repeat(low, lens)
    else:
        several = low != (np.maximum.reduceat(ids, begin) if len(begin) else ids)
        told = np.repeat(several, lens)
        silent[begin[several]] = True
    ask = ~told | silent
    asked_doc = np.where(silent, len(doc_ids), owner)[ask]
    h, p, t_doc, t_place = hashes[ask], place[ask], owner[told], place[told]
    if width < 8:
        h = h >> np.uint64(64 - 8 * width)
    to = (h % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    to, h, p, asked_doc = to[by], h[by], p[by], asked_doc[by]
    # What is told lies by document, and goes where chance sends the document.
    t_to = ((t_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc_ids[t_doc].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((t_place, t_doc, t_to))
    t_to, t_doc, t_place = t_to[by], t_doc[by], t_place[by]
    cols: list[list] = [[] for _ in range(8)]
    cut, t_cut = np.searchsorted(to, np.arange(buckets + 1)), np.searchsorted(t_to, np.arange(buckets + 1))
    for b in range(buckets):
        i, j, k, m = cut[b], cut[b + 1], t_cut[b], t_cut[b + 1]
        if i == j and k == m:
            continue
        near, far = np.unique(np.concatenate((asked_doc[i:j], t_doc[k:m])), return_inverse=True)
        near = near[near < len(doc_ids)]
        row = (b, doc_ids[near].astype("<i8").tobytes(), keys[near].astype("<i8").tobytes(), _planes(h[i:j], width), _planes(far[: j - i], 4), _planes(p[i:j], 4), _planes(far[j - i :], 4), _planes(t_place[k:m], 4))
        for c, x in zip(cols, row, strict=True):
            c.append(x)
    kinds = [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _BLOB.split(", ")])


def _repeats(rows: list[dict], width: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, text key and place of what repeats among the blobs of one bucket, and of what they tell."""
    parts: list[list] = [[] for _ in range(8)]
    for r in rows:
        ids, keys = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["keys"], "<i8")
        doc, told = _values(r["doc"], 4).astype(np.int64), _values(r["told_doc"], 4).astype(np.int64)
        silent = doc == len(ids)
        ids, keys = np.append(ids, 0), np.append(keys, 0)
        found = (_values(r["hash"], width), ids[doc], keys[doc], _values(r["place"], 4).astype(np.int32), silent, ids[told], keys[told], _values(r["told_place"], 4).astype(np.int32))
        for c, x in zip(parts, found, strict=True):
            c.append(x)
    h, d, k, p, s, *told = (np.concatenate(c) for c in parts)
    order = np.argsort(h, kind="stable")
    h, d, k, p, s = h[order], d[order], k[order], p[order], s[order]
    begin = _first_of(h)
    if len(begin):
        lens, low = np.diff(np.append(begin, len(h))), np.minimum.reduceat(d, begin)
        yes = d > np.repeat(low, lens) if earlier else np.repeat((low != np.maximum.reduceat(d, begin)) | np.logical_or.reduceat(s, begin), lens) & ~s
        d, k, p = d[yes], k[yes], p[yes]
    return tuple(np.concatenate(x) for x in zip((d, k, p), told, strict=True))


def _answers(width: int, earlier: bool, doc_buckets: int):
    """Reads a partition's blobs bucket by bucket (they are sorted) and tells which places repeat: a value for each bucket of
    documents, so that the rows are as many as buckets, not as documents and places."""

    def packed(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        d, k, p = (np.concatenate(x) for x in zip(*found, strict=True))
        to = ((d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(doc_buckets)
        order = np.lexsort((p, k, d, to))
        d, k, p, to = d[order], k[order], p[order], to[order].astype(np.int64)
        cut = np.searchsorted(to, np.arange(doc_buckets + 1))
        rows = [(b, d[i:j].astype("<i8").tobytes(), k[i:j].astype("<i8").tobytes(), p[i:j].astype("<i4").tobytes()) for b, i, j in zip(range(doc_buckets), cut, cut[1:], strict=False) if j > i]
        for a in range(0, len(rows), 64):
            cols = zip(*rows[a : a + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int32()] + [pa.binary()] * 3, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, n = None, [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if r["bucket"] != now and held:
                    found.append(_repeats(held, width, earlier))
                    held, n = [], n + len(found[-1][0])
                    if n > _ANSWERS:
                        yield from packed(found)
                        found, n = [], 0
                now = r["bucket"]
                held.append(r)
        if held:
            found.append(_repeats(held, width, earlier))
        if found:
            yield from packed(found)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All answers for a bucket of documents to one row for each of them."""
    cols: list[list] = [[], [], []]
    for batch in batches:
        for c, name, kind in zip(cols, ("ids", "keys", "places"), ("<i8", "<i8", "<i4"), strict=True):
            c += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    if not cols[0]:
        return
    d, k, p = (np.concatenate(c) for c in cols)
    cols.clear()
    order = np.lexsort((k, d))
    d, k, p = d[order], k[order], p[order]
    begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
    ends = np.append(begin[1:], len(d))
    for a in range(0, len(begin), 5000):
        part = [p[i:j].tobytes() for i, j in zip(begin[a : a + 5000], ends[a : a + 5000], strict=True)]
        at = begin[a : a + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(k[at]), pa.array(part, pa.binary())], ["doc_id", "key", "places"])


def _blocks(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """(doc_ids, text keys, texts, extra values) of at most some BLOCK_BYTES; a longer text stands alone."""
    ids, keys, texts, more, size = [], [], [], [], 0
    for batch in batches:
        cols = [batch.column("doc_id"), batch.column("key"), batch.column("text"), batch.column(extra) if extra else None]
        for i in range(batch.num_rows):
            t = cols[2][i].as_py()
            if texts and size + len(t or "") > BLOCK_BYTES:
                yield np.array(ids, np.int64), np.array(keys, np.int64), texts, more
                ids, keys, texts, more, size = [], [], [], [], 0
            ids.append(cols[0][i].as_py())
            keys.append(cols[1][i].as_py())
            texts.append(t)
            more.append(cols[3][i].as_py() if extra else None)
            size += len(t or "")
    if texts:
        yield np.array(ids, np.int64), np.array(keys, np.int64), texts, more


def _partitions(docs: DataFrame) -> int:
    """Partitions of the shuffles between blocks: as the session has them, and more where the input's files ask for it. An
    input of unknown size counts as 2^63 bytes with the planner; it gets what the session has."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _PART_BYTES if size < _KNOWN_BYTES else 0)


def _settle(sent: DataFrame, parts: int, width: int, earlier: bool, name: str) -> DataFrame:
    """Deals the blobs out and keeps the answers, one row for each document."""
    told = map_arrow(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"), _answers(width, earlier, parts), _FOUND, lean=True)
    return keep(map_arrow(told.repartition(parts, "bucket"), _by_document, "doc_id long, key long, places binary", lean=True), name)


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and its text's key. Rows without a doc_id neither take nor lose words."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], _key(docs).alias("key"))


def _candidates(docs: DataFrame, n: int) -> DataFrame:
    """First level: (doc_id, key, places) of half-length windows that two documents hold."""
    half, parts = (n + 1) // 2, _partitions(docs)
    buckets = parts * _SUB

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for ids, keys, texts, _ in _blocks(batches):
            words, starts = hasher.block(texts)
            _, least, hashes = _least(words, starts, n, half)
            least = least[np.concatenate(([True], np.diff(least) > 0))] if len(least) else least
            # Equal on 40 bits is enough to go on.
            h = hashes[least] >> np.uint64(24) << np.uint64(24)
            owner = np.searchsorted(starts, least, "right") - 1
            yield _blobs(ids, keys, owner, least - starts[owner], h, 5, buckets, earlier=False)

    return _settle(map_arrow(_rows(docs).filter("doc_id IS NOT NULL"), send, _BLOB, lean=True), parts, 5, False, "substring-candidates")


def _marked(places: bytes | None, n_words: int) -> np.ndarray:
    on = np.zeros(n_words + 1, bool)
    at = np.frombuffer(places or b"", "<i4")
    on[at[at < n_words]] = True
    return on


def _level(docs: DataFrame, before: DataFrame, length: int, half: int | None, earlier: bool, name: str) -> DataFrame:
    """(doc_id, key, places) of windows of ``length`` words that repeat. before: places of the level before; half: its length if
    these are least half-length windows, else the places are all starts of windows of length // 2 words that repeat."""
    parts = _partitions(docs)
    buckets = parts * _SUB

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for ids, keys, texts, places in _blocks(batches, "places"):
            words, starts = hasher.block(texts)
            on = np.concatenate([_marked(p, n)[:n] for p, n in zip(places, np.diff(starts).tolist(), strict=True)]) if len(ids) else np.empty(0, bool)
            if half:
                at, least, _ = _least(words, starts, length, half)
                at = at[on[least]] if len(at) else at
            else:
                at = _starts_of(starts, length)
                at = at[on[at] & on[at + length // 2]]
            hashes = _windows(words, length)
            owner = np.searchsorted(starts, at, "right") - 1
            yield _blobs(ids, keys, owner, at - starts[owner], hashes[at] if len(at) else hashes[:0], 8, buckets, earlier)

    sent = map_arrow(_rows(docs).join(before, ["doc_id", "key"]).select("doc_id", "key", "text", "places"), send, _BLOB, lean=True)
    return _settle(sent, parts, 8, earlier, name)


def later_windows(docs: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, key, places): starts of windows of n words that also begin in a document with a smaller doc_id."""
    first = _candidates(docs, n)
    later = _level(docs, first, n, (n + 1) // 2, True, "substring-later")
    forget(first)
    return later


def repeat_levels(docs: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, longest): for documents with a repeated window of n words, the largest of the lengths n, 2n, 4n, ... of a
    window that another document holds too. Ends with the first length at which none repeats."""
    level = _level(docs, _candidates(docs, n), n, (n + 1) // 2, False, "substring-level")
    length, found = n, level.select("doc_id", F.lit(n).alias("longest"))
    while not level.isEmpty():
        length *= 2
        level = _level(docs, level, length, None, False, "substring-level")
        found = found.unionByName(level.select("doc_id", F.lit(length).alias("longest")))
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def _covered(places: bytes | None, n_words: int, n: int) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(_marked(places, n_words))
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + n, n_words), -1)
    return np.cumsum(change)[:n_words] > 0


def removal_digests(docs: DataFrame, n: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row.

    Removed is each word inside a window of n words that also begins in a document with a smaller doc_id, judged on the
    input. A null or short text loses nothing. Rows that repeat a document keep alike. Rows with one doc_id and different
    texts are judged each, and take no words from each other. Rows without a doc_id keep all words and take none. Further columns,
    whatever their names, are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for t, p in zip(batch.column("text"), batch.column("places"), strict=True):
                words, places = (t.as_py() or "").encode().split(), p.as_py()
                kept = words
                if places:
                    gone = _covered(places, len(words), n)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for c, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    c.append(x)
            cols = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _rows(docs).join(later_windows(docs, n), ["doc_id", "key"], "left")
    return map_arrow(joined.select("doc_id", "text", "places"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """docs with the words that removal_digests() counts as removed taken out of text, each with the white space before
    it. Texts that lose nothing stay as they are, to the character, null ones too. All columns are kept, whatever their names; an
    empty table stays empty."""
    at = docs.columns.index("text")

    def cut(text: str, places: bytes) -> str:
        parts = _SPLIT.split(text.encode())
        first = 0 if parts[0] else 2
        words = [i for i in range(first, len(parts), 2) if parts[i]]
        gone = _covered(places, len(words), n)
        kept = [i for i, g in zip(words, gone.tolist(), strict=True) if not g]
        return b"".join([(parts[i - 1] if k and i else b"") + parts[i] for k, i in enumerate(kept)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(t, p) if p and t else t for t, p in zip(texts, places, strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    _id, key, places = (unused(x, docs) for x in ("_id", "_key", "_places"))
    later = later_windows(docs, n).toDF(_id, key, places)
    joined = docs.join(later, (docs["doc_id"].cast("long") == later[_id]) & (_key(docs) == later[key]), "left").drop(_id, key)
    return map_arrow(joined, run, docs.schema)
