"""Language-model scores by deleted interpolation: bigram and unigram maximum-likelihood estimates and a uniform floor,
mixed with weights that depend on how often the context was seen and are learned by expectation-maximisation on
held-out counts.

Counting and looking up are one exchange. Texts are packed into chunks. A chunk sends its distinct bigrams and words,
sorted and packed, to the buckets of their hashes, each with its count in the chunk; a bucket adds the counts up and
answers each chunk with the totals of the keys it sent, in the same order. So the counts of all documents are gathered
without a row for each token, and a chunk never needs counts of words that it doesn't have.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, store

END = np.uint64(0x6A09E667F3BCC908)
START = np.uint64(0xBB67AE8584CAA73B)
_SALT = np.uint64(0x3C6EF372FE94F82B)
#: histogram steps of log10 probability that EM works on, and their range
STEP, FLOOR = 0.05, -12.0


@dataclass(frozen=True)
class Plan:
    """chunk_tokens: tokens a chunk closes at (a longer text is a chunk of its own). bucket_keys: keys, before they
    are merged, that a bucket gets at most on average. held: one of so many training texts is held out for the
    mixture weights. iterations of EM. Context buckets are the binary logarithms of the contexts' counts."""

    chunk_tokens: int = 1_000_000
    bucket_keys: int = 2_000_000
    held: int = 10
    iterations: int = 50
    context_buckets: int = 24


def _pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the upper planes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    used = 8 - int(np.argmax(planes.any(axis=0)[::-1])) if planes.any() else 1
    plain = [planes[:, k].tobytes() for k in range(used)]
    return bytes([used]) + len(values).to_bytes(8, "little") + b"".join(len(z := zlib.compress(p, 1)).to_bytes(8, "little") + z for p in plain)


def _unpack(data: bytes) -> np.ndarray:
    used, n, at = data[0], int.from_bytes(data[1:9], "little"), 9
    out = np.zeros((n, 8), np.uint8)
    for k in range(used):
        size = int.from_bytes(data[at : at + 8], "little")
        out[:, k] = np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + size]), np.uint8)
        at += 8 + size
    return out.view(np.uint64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' tokens, each row closed by END, and the n + 1 offsets."""
    words, cuts = hashing.word_hashes(texts.fill_null(""))
    n = len(cuts) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = cuts[1:] + np.arange(n)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[ends], out[place] = END, words
    return out, np.concatenate([[0], ends + 1])


def _bigrams(tokens: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it; a text's first token comes after START."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[cuts[:-1]] = START
    return hashing.mix64(before * np.uint64(0x9E3779B97F4A7C15) + tokens * _SALT)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key by its upper 32 bits, so sorted keys lie in bucket order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


CHUNKS = "chunk long, held boolean, n_tokens long, ids array<{}>, learned binary, lengths binary, text binary"
PARTS = "chunk long, held boolean, kind int, bucket int, n_keys long, n_learned long, keys binary, counts binary"


def _chunked(docs: DataFrame, plan: Plan) -> DataFrame:
    """Chunk rows from (id, text, learned, held): rows of held-out texts and others in chunks of their own."""
    schema = CHUNKS.format(dict(docs.dtypes)["id"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, open_ = 0, {False: [], True: []}
        sizes = {False: 0, True: 0}

        def close(held: bool) -> pa.RecordBatch:
            nonlocal made
            table = pa.concat_tables([pa.Table.from_batches([b]) for b in open_[held]]).combine_chunks()
            open_[held], sizes[held] = [], 0
            texts = [t.encode() for t in table["text"].fill_null("").to_pylist()]
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 33) + made], pa.int64()),
                    pa.array([held]),
                    pa.array([sum(map(len, texts)) // 6], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["id"].combine_chunks()),
                    pa.array([table["learned"].to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                    pa.array([zlib.compress(b"".join(texts), 3)], pa.binary()),
                ],
                names=["chunk", "held", "n_tokens", "ids", "learned", "lengths", "text"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for held in (False, True):
                    some = part.filter(part.column(3) if held else pc.invert(part.column(3)))
                    if some.num_rows:
                        open_[held].append(some)
                        sizes[held] += some.column(1).nbytes
                        if sizes[held] >= 6 * plan.chunk_tokens:
                            yield close(held)
        for held in (False, True):
            if open_[held]:
                yield close(held)

    return docs.select("id", "text", "learned", "held").mapInArrow(task, schema)


def _texts(row) -> pa.Array:
    """The chunk's texts again."""
    lengths = np.frombuffer(row.lengths, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(zlib.decompress(row.text)))


def _keys_of(row) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens, cuts, and for words and bigrams the sorted distinct keys with each token's place among them."""
    tokens, cuts = _tokens(_texts(row))
    return tokens, cuts, [np.unique(k, return_inverse=True) for k in (tokens, _bigrams(tokens, cuts))]


def _parts(chunks: DataFrame, buckets: int) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tokens, cuts, kinds = _keys_of(row)
                learned = np.repeat(np.frombuffer(row.learned, np.uint8).astype(float), np.diff(cuts))
                out = []
                for kind, (keys, place) in enumerate(kinds):
                    counts = np.bincount(place, weights=learned, minlength=len(keys)).astype(np.uint64)
                    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        k, c = keys[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]
                        out.append((row.chunk, row.held, kind, b, len(k), int(c.sum()), _pack_keys(k), _pack(c)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    return chunks.mapInPandas(task, PARTS)


ANSWERS = "chunk long, kind int, bucket int, fit binary, total binary, n_new long, n_tokens long, n_fit long"


def _answers(parts: DataFrame) -> DataFrame:
    """For each part, the totals of its keys: over the chunks that aren't held out (fit), and over all (total). The
    first part of a bucket also tells the number of keys that training texts have, their tokens, and those not held."""

    def bucket(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        keys = [_unpack_keys(k) for k in frame["keys"]]
        counts = [_unpack(c) for c in frame["counts"]]
        every = np.unique(np.concatenate(keys))
        fit, total = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        places = [np.searchsorted(every, k) for k in keys]
        for place, c, held in zip(places, counts, frame["held"], strict=True):
            total[place] += c
            if not held:
                fit[place] += c
        rows = []
        for i, (chunk, held, place) in enumerate(zip(frame["chunk"], frame["held"], places, strict=True)):
            told = (int((total > 0).sum()), int(total.sum()), int(fit.sum())) if i == 0 else (0, 0, 0)
            rows.append((chunk, frame["kind"].iloc[0], frame["bucket"].iloc[0], _pack(fit[place]) if held else None, _pack(total[place]), *told))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return parts.select("chunk", "held", "kind", "bucket", "keys", "counts").groupBy("kind", "bucket").applyInPandas(bucket, ANSWERS)


def _looked_up(row, answers: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, and for each token the counts of the word, of its bigram and of its context."""
    tokens, cuts, kinds = _keys_of(row)
    found = []
    for kind, (keys, place) in enumerate(kinds):
        mine = answers[answers["kind"] == kind].sort_values("bucket")
        totals = np.concatenate([_unpack(x) for x in mine[column]])
        if len(totals) != len(keys):
            raise ValueError(f"chunk {row.chunk} has {len(keys)} keys and got {len(totals)} counts")
        found.append(totals[place].astype(float))
    context = np.empty(len(tokens))
    context[1:] = found[0][:-1]
    context[cuts[:-1]] = found[0][cuts[1:] - 1]  # texts begin as often as they end
    return cuts, found[0], found[1], context


def _estimates(word: np.ndarray, pair: np.ndarray, context: np.ndarray, n: float, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram and unigram estimate of each token; bucket 0 is of contexts never seen."""
    bucket = np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(int), plan.context_buckets - 1), 0)
    return bucket, np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1.0)


def _level(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round((np.log10(np.maximum(p, 10**FLOOR)) - FLOOR) / STEP) + 1, 0).astype(np.int64)


def mixture(histogram: np.ndarray, floor: float, plan: Plan) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each context bucket, by expectation-maximisation over rows of (bucket,
    level of the bigram estimate, level of the unigram estimate, tokens). Buckets without tokens get the weights of
    all together; without any token, they are even. The uniform weight stays above a thousandth."""
    value = lambda level: np.where(level > 0, 10 ** (FLOOR + STEP * (level - 1)), 0.0)

    def learn(rows: np.ndarray) -> np.ndarray:
        p = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), floor)], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(plan.iterations):
            share = p * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * rows[:, 3:4]).sum(axis=0)
            w = np.maximum(w / w.sum(), [0, 0, 1e-3])
            w /= w.sum()
        return w

    everything = learn(histogram) if len(histogram) else np.full(3, 1 / 3)
    out = np.tile(everything, (plan.context_buckets, 1))
    for b in range(plan.context_buckets):
        rows = histogram[histogram[:, 0] == b] if len(histogram) else histogram
        if len(rows):
            out[b] = learn(rows)
    return out


def scored(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, train_tokens, vocabulary, base_score and score.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and one end for each text; null texts are empty and
    have the end alone. The model learns from rows for which learned is true (null: false); one of plan.held of them,
    by a hash of the text so that copies go together, is held out for the mixture weights, and counts again once
    these are known. n_known are tokens that training texts have; base_score is the add-one unigram log10
    probability; score the model's. Without training rows both are those of a uniform choice among one word. Equal
    rows get equal values; ids may repeat or be null. An empty table gives an empty one.

    Everything but the histogram of held-out estimates (its size depends on STEP and not on the texts) stays with
    the tasks. Chunks have about plan.chunk_tokens tokens; the number of buckets follows the number of chunks, so
    that a bucket's keys, and a chunk's, fit in a task. A chunk sends a row to each bucket that it has keys for, so
    there are never more rows than distinct keys of all chunks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    rows = rows.withColumn("held", F.col("learned") & (F.pmod(F.xxhash64("text", F.lit(3)), F.lit(plan.held)) == 0))
    chunks = store.written(_chunked(rows, plan), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, math.ceil(2 * size / plan.bucket_keys), min(64, math.ceil(size / 50_000)))
    answers = store.written(_answers(_parts(chunks.select("chunk", "held", "learned", "lengths", "text"), buckets)), "answers")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_new", "n_tokens", "n_fit")]
    v, n, n_fit = answers.filter("kind = 0").agg(*sums).first()
    replies = answers.select("chunk", "kind", "bucket", "fit", "total")

    def held(key, chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        totals: list[np.ndarray] = []
        for row in chunk.itertuples(index=False):
            _, word, pair, context = _looked_up(row, answer, "fit")
            bucket, two, one = _estimates(word, pair, context, n_fit, plan)
            totals.append(np.stack([bucket, _level(two), _level(one)], axis=1))
        keys, counts = np.unique(np.concatenate(totals), axis=0, return_counts=True) if totals else (np.empty((0, 3)), np.empty(0))
        return pd.DataFrame({"bucket": keys[:, 0], "two": keys[:, 1], "one": keys[:, 2], "n": counts})

    estimates = chunks.filter("held").drop("ids").groupBy("chunk").cogroup(replies.filter("fit is not null").drop("total").groupBy("chunk")).applyInPandas(held, "bucket long, two long, one long, n long")
    found = estimates.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "two", "one"])
    floor = 1 / (v + 1)
    weights = mixture(found.to_numpy(dtype=float).reshape(-1, 4), floor, plan)
    schema = f"{id_col} {dict(rows.dtypes)['id']}, n_tokens long, n_known long, base_score double, score double"

    def score(key, chunk: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples(index=False):
            cuts, word, pair, context = _looked_up(row, answer, "total")
            bucket, two, one = _estimates(word, pair, context, n, plan)
            w = weights[bucket]
            p = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor)
            base = np.log10((word + 1) / (n + v + 1))
            add = lambda x, at=cuts[:-1]: np.add.reduceat(x, at)
            out.append(pd.DataFrame({id_col: pd.Series(list(row.ids), dtype=object), "n_tokens": np.diff(cuts), "n_known": add((word > 0).astype(np.int64)), "base_score": add(base), "score": add(p)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "n_tokens", "n_known", "base_score", "score"])

    results = chunks.groupBy("chunk").cogroup(replies.drop("fit").groupBy("chunk")).applyInPandas(score, schema)
    return results.withColumns({"train_tokens": F.lit(n).cast("long"), "vocabulary": F.lit(v).cast("long")})
