"""Toxicity by averaged subword-bag embeddings under a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its subwords: character n-grams of the word between marks, and the word
itself, each hashed to a row of one embedding table. A document's vector is the mean of the vectors of its different words
and of ``NEUTRAL`` empty ones, which keeps few words from saying much by chance; a linear softmax over two classes reads it. Table and softmax are trained together by gradient descent (Adam) in numpy. A misspelling
never seen still shares most n-grams with what was seen.

For scoring, softmax and averages are linear, so each row of the table folds to one number, and a document's logit is the
mean of its words' numbers. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .token_blocks import Encoder, blocks, gather

BUCKETS, DIM, GRAMS, SCALE, NEUTRAL = 1 << 17, 6, (3, 4, 5), 20, 24
_STRIP = ".,;:!?\"'()[]{}«»„“”¿¡…-"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, word by word, and where each word's begin."""
    marked = ["<" + w.strip(_STRIP) + ">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lens)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    owners, hashes = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * _FACTORS[k]
        inside = np.arange(len(h)) + n <= ends[owner[: len(h)]]
        owners.append(owner[: len(h)][inside])
        hashes.append(h[inside])
    place = np.arange(len(code)) - np.repeat(ends - lens, lens)
    whole = np.add.reduceat((code + np.uint64(1)) * (_FACTORS[place % 5] + (place.astype(np.uint64) << np.uint64(1))), ends - lens) if len(code) else code
    owners.append(np.arange(len(words)))
    hashes.append(whole * _FACTORS[0])
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    bucket = ((h ^ (h >> np.uint64(31))) * _FACTORS[1] >> np.uint64(64 - 17)).astype(np.int64)[order]
    return bucket, np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """What each bucket adds to the logit of a word, and the bias."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.float32)
        for a in range(0, len(words), 10_000):
            bucket, starts = subwords(words[a : a + 10_000])
            out[a : a + 10_000] = np.add.reduceat(self.weight[bucket], starts[:-1]) / np.diff(starts)
        return out

    def logit(self, distinct: np.ndarray) -> float:
        """distinct: the numbers of a text's different words."""
        return self.bias + float(distinct.sum(dtype=np.float64)) / (len(distinct) + NEUTRAL)


def split(text: str) -> list[str]:
    return text.lower().split()


def calibrated(logits: np.ndarray, toxic: np.ndarray, clean_weight: float = 3.0) -> tuple[float, float]:
    """Scale and bias of a logistic curve through the logits of texts that training did not see. A clean text counts
    ``clean_weight`` times a toxic one, both classes taken as equally many."""
    weigh = np.where(toxic == 1, 1 / toxic.sum(), clean_weight / (1 - toxic).sum())
    x = np.stack((logits, np.ones(len(logits))), axis=1)
    b = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weigh * (p - toxic)) + 1e-3 * b
        h = (x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(b[0], 1e-3)), float(b[1])


def train(texts: list[str], toxic: np.ndarray, **settings) -> Model:
    """Fits on three of four texts of either class, and sets the curve from logit to score on the fourth."""
    toxic = np.asarray(toxic, np.int64)
    nth = np.where(toxic == 1, np.cumsum(toxic == 1), np.cumsum(toxic == 0))
    apart = nth % 4 == 0
    if min((toxic[apart] == c).sum() for c in (0, 1)) < 5:
        return train_joint(texts, toxic, **settings)
    model = train_joint([t for t, a in zip(texts, apart, strict=True) if not a], toxic[~apart], **settings)
    logits = np.array([model.logit(model.words(sorted(set(split(t))))) for t, a in zip(texts, apart, strict=True) if a])
    scale, bias = calibrated(logits, toxic[apart])
    return Model((model.weight * scale).astype(np.float32), model.bias * scale + bias)


def train_joint(texts: list[str], toxic: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 4.0, seed: int = 7) -> Model:
    """Fits the embedding table and the softmax together, on batches that hold both classes alike. With one class or
    none the score is that class's, or 0."""
    toxic = np.asarray(toxic, np.int64)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS, np.float32), 5.0 if len(toxic) and toxic[0] else -5.0)
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    bags = []
    for t in texts:
        words = np.unique([seen.setdefault(w.strip(_STRIP), len(seen)) for w in split(t)] or [seen.setdefault("", len(seen))])
        bags.append((words, np.full(len(words), 1 / (len(words) + NEUTRAL), np.float32)))
    known, local, n_sub = list(seen), [], []
    for a in range(0, len(known), 10_000):
        part, at = subwords(known[a : a + 10_000])
        local.append(part.astype(np.int32)), n_sub.append(np.diff(at))
    local, n_sub = np.concatenate(local), np.concatenate(n_sub)
    starts = np.concatenate(([0], np.cumsum(n_sub)))
    used = np.flatnonzero(np.bincount(local, minlength=BUCKETS))
    place_of = np.zeros(BUCKETS, np.int32)
    place_of[used] = np.arange(len(used))
    local = place_of[local]
    # Each batch with its own words and their subwords, so that a step touches nothing else.
    place = np.empty(len(toxic))
    for c in (0, 1):
        own = np.flatnonzero(toxic == c)
        place[rng.permutation(own)] = np.linspace(0, 1, len(own), endpoint=False)
    order, parts = np.argsort(place, kind="stable"), []
    for ids in np.array_split(order, max(1, len(order) // batch)):
        word, at = np.unique(np.concatenate([bags[i][0] for i in ids]), return_inverse=True)
        lens = np.array([len(bags[i][0]) for i in ids])
        sub = gather(local, starts, word)
        weigh = np.where(toxic[ids] == 1, 0.5 / max(1, (toxic[ids] == 1).sum()), 0.5 / max(1, (toxic[ids] == 0).sum()))
        parts.append((
            sub, np.repeat(np.arange(len(word), dtype=np.int32), n_sub[word]), np.concatenate(([0], np.cumsum(n_sub[word])[:-1])), (1 / n_sub[word]).astype(np.float32)[:, None],
            at.astype(np.int32), np.concatenate([bags[i][1] for i in ids])[:, None], np.repeat(np.arange(len(ids)), lens), np.concatenate(([0], np.cumsum(lens)[:-1])),
            np.stack((toxic[ids] == 0, toxic[ids] == 1), axis=1), weigh[:, None],
        ))
    table = rng.normal(0, 0.02, (len(used), DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, soft, bias)]
    step, steps = 0, epochs * len(parts)
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            sub, owner, sub_at, pull, at, share, doc, doc_at, target, weigh = parts[k]
            step += 1
            words = np.add.reduceat(table[sub], sub_at, axis=0) * pull
            vectors = np.add.reduceat(words[at] * share, doc_at, axis=0)
            logits = vectors @ soft * SCALE + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = ((p - target) * weigh).astype(np.float32)
            back = (err @ soft.T * SCALE)[doc] * share
            g_table = np.empty_like(table)
            for d in range(DIM):
                g_word = np.bincount(at, back[:, d], len(pull)) * pull[:, 0]
                g_table[:, d] = np.bincount(sub, g_word[owner], len(table))
            pace = rate * (1 - step / (steps + 1))
            for x, g, (m, v) in zip((table, soft, bias), (g_table, vectors.T @ err * SCALE, err.sum(axis=0)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
            table *= 1 - pace * decay
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = (table @ (soft[:, 1] - soft[:, 0])) * SCALE
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, clean_factor: int = 2, longest: int = 200_000, most_chars: int = 60_000_000) -> Model:
    """Trains on a bounded sample: at most ``per_class`` toxic documents and ``clean_factor`` times as many clean ones, those with the least hash of
    doc_id, held-out ids and texts over ``longest`` characters left aside, and no further ones once ``most_chars`` characters are read. Contradicting labels of a document are no label."""
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    known = known.filter((F.col("low") == F.col("high")) & F.col("low").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = []
    for c in (0, 1):
        own = known.filter(F.col("low") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (1 if c else clean_factor))
        picked += [(r["doc_id"], c) for r in own.select("doc_id").collect()]
    if not picked:
        return train([], np.empty(0))
    spark = docs.sparkSession
    sample = spark.createDataFrame(picked, "_id long, _toxic int")  # (1 + clean_factor) * per_class rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).filter(F.length("text") <= longest)
    # Texts come a partition at a time, in the order of the hash, which deals both classes alike.
    rows, held = [], 0
    for r in found.groupBy("_id", "_toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("_id"), "_id").toLocalIterator():
        if (held := held + len(r["text"])) > most_chars:
            break
        rows.append((r["_id"], r["_toxic"], r["text"]))
    rows.sort()
    return train([r[2] for r in rows], np.array([r[1] for r in rows]))


def _scores(model: Model, coder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(doc_ids, scores) of the rows in their order."""
    for ids, texts in blocks(batches):
        parts = [coder.number(t) for t in texts]
        coder.settle()
        numbers = coder.ids.view(np.float32)
        logits = np.array([model.logit(numbers[np.unique(p)]) for p in parts])
        yield ids, 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
        del numbers
        coder.retire([np.concatenate(parts)])


def _coder(model: Model) -> Encoder:
    def values(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return model.words(new).view(np.int32), np.arange(len(new) + 1)

    return Encoder(split, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text alone. A null text is empty, and an empty
    text has the score of no words. Repeated rows are scored each; further columns, whatever their names, are ignored; an empty
    table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores in _scores(model, _coder(model), batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], ["doc_id", "score"])

    scored = map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those rows whose own score is 0.5 or more, whatever their doc_id. All columns are kept; a null text is
    empty; without labels of both classes nothing is learned, and with none nothing goes; an empty table stays empty."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([x for _, x in _scores(model, coder, iter([batch]))])
                yield batch.filter(pa.array(scores < 0.5))

    return map_arrow(docs, run, docs.schema)
