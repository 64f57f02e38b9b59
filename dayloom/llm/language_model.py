"""Language-model scores: a log-bilinear model, noise-contrastive estimation, exact normalisation.

The model predicts a token from the two before it: the context is the sum of two embeddings (one
table per position), a token's logit its product with the token's vector plus a bias. Training
runs in the tasks that hold the corpus: each round every task takes the current parameters
through its share of the training documents and the results are averaged. Scoring needs no
softmax per token: with logits a[w1] + b[w2] + c the normalisers of all contexts are one product
of exp(a) and exp(b), so a token costs a few table look-ups.

The model knows the most frequent words and one class for all others; inside that class a word
has its smoothed corpus frequency. Corpus counts cover all training documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, materialise, words_of, worker_memo

END = ""  # no word is empty
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Sizes of what travels to tasks, and of the training."""

    model_words: int = 2048  # with vectors of their own
    dictionary_words: int = 1 << 18  # whose counts are looked up in the task; others are joined
    dictionary_bytes: int = 64  # longer words are always joined
    dimensions: int = 16
    noise: int = 64  # shared by a batch
    batch: int = 1024
    rounds: int = 3  # each takes another third of the training documents
    rate: float = 0.05
    seed: int = 5


def token_counts(docs: DataFrame, text: Column) -> DataFrame:
    """``token`` and ``c`` over all given documents, with one end for each."""
    tokens = F.concat(words_of(F.translate(text, UPPER, LOWER)), F.array(F.lit(END)))
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` tokens have it or more.

    Counts are told apart exactly up to 64 and in sixteenths of an octave beyond, so the table
    of them stays small whatever the corpus.
    """
    low = F.when(F.col("c") <= 64, F.col("c")).otherwise(
        F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("c") * 16) / 16)).cast("long")
    )
    rows = counts.groupBy(low.alias("low")).agg(F.count("*").alias("n")).collect()
    least, total = 1 << 62, 0
    for row in sorted(rows, key=lambda r: -r["low"]):
        total += row["n"]
        if total > most:
            break
        least = row["low"]
    return least


@dataclass
class Vocabulary:
    """The words that tasks look up: the first ``classes`` - 1 have vectors, in this order."""

    words: str  # joined by spaces, which no word has
    counts: np.ndarray
    classes: int  # one more than the words with vectors: the class of all others

    def table(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words.split(" "))}


def encode(batch_text: pa.Array, known: dict[str, int], counts: np.ndarray, classes: int) -> dict[str, object]:
    """Classes of a batch's tokens and sums per document; words not known stay as words."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(batch_text), ""))
    flat = split.flatten()
    cuts = split.offsets.to_numpy().astype(np.int64)
    rows = len(batch_text)
    of = np.repeat(np.arange(rows), np.diff(cuts))
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # an edge of white space leaves an empty piece
    if not keep.all():
        flat, of = flat.filter(pa.array(keep)), of[keep]
    coded = flat.dictionary_encode()
    which = coded.indices.to_numpy()
    found = np.array([known.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1)
    cls = np.minimum(found, classes - 1)
    log_c = np.where(found < 0, 0.0, np.log10(counts[found] + 1.0))
    token_cls, token_log = cls[which], log_c[which]
    rare = token_cls < 0
    other = rare | (token_cls == classes - 1)
    end_cls, end_count = min(known[END], classes - 1), int(counts[known[END]])
    n_words = np.bincount(of, minlength=rows)
    n_rare = np.bincount(of[rare], minlength=rows)
    end_known = int(end_count > 0)
    # the classes of each document with its end, one after the other
    stream = np.empty(len(which) + rows, dtype="<u2")
    ends = np.cumsum(n_words + 1)
    stream[ends - 1] = end_cls
    inside = np.ones(len(stream), dtype=bool)
    inside[ends - 1] = False
    stream[inside] = np.where(rare, classes - 1, token_cls)
    return {
        "classes": stream,
        "ends": ends,
        "n_tokens": n_words + 1,
        "n_other": np.bincount(of[other], minlength=rows),
        "n_known": n_words - n_rare + end_known,
        "base": np.bincount(of, weights=token_log, minlength=rows) + math.log10(end_count + 1),
        "other": np.bincount(of[other], weights=token_log[other], minlength=rows),
        "rare": pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)), coded.dictionary.take(pa.array(which[rare]))
        ),
    }


ENCODED = (
    "doc_id long, held_out boolean, classes binary, n_tokens long, n_other long, n_known long, "
    "base double, other double, rare array<string>"
)


class Parameters:
    """Two context tables, the token vectors and the biases, as one flat vector."""

    def __init__(self, flat: np.ndarray, classes: int, dimensions: int):
        n = classes * dimensions
        self.flat, self.classes, self.dimensions = flat, classes, dimensions
        self.first, self.second, self.token = (flat[k * n : (k + 1) * n].reshape(classes, dimensions) for k in range(3))
        self.bias = flat[3 * n :]

    @classmethod
    def initial(cls, share: np.ndarray, s: Settings) -> Parameters:
        classes = len(share)
        flat = np.random.default_rng(s.seed).normal(0, 0.1, 3 * classes * s.dimensions + classes)
        out = cls(flat, classes, s.dimensions)
        out.bias[:] = np.log(share)
        return out


class Trainer:
    """Noise-contrastive estimation with one set of noise words a batch and Adagrad steps."""

    def __init__(self, flat: np.ndarray, share: np.ndarray, s: Settings, seed: int):
        self.p = Parameters(flat.astype(np.float32), len(share), s.dimensions)
        self.squares = Parameters(np.full(len(flat), 1.0, dtype=np.float32), len(share), s.dimensions)
        self.s, self.share = s, share
        self.log_noise = (np.log(s.noise) + np.log(share)).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.random = np.random.default_rng(seed)
        self.seen = 0

    def _step(self, name: str, at: np.ndarray, gradient: np.ndarray) -> None:
        """Add the gradients of each row up and move the rows that have one."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rows, total = at[starts], np.add.reduceat(gradient[order], starts, axis=0)
        squares, values = getattr(self.squares, name), getattr(self.p, name)
        squares[rows] += total * total
        values[rows] += self.s.rate * total / np.sqrt(squares[rows])

    def learn(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, self.p.classes
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(self.s.noise)), n - 1)
        context = p.first[w1] + p.second[w2]
        target, other = p.token[w], p.token[noise]
        s_data = np.einsum("ij,ij->i", context, target) + p.bias[w] - self.log_noise[w]
        s_noise = context @ other.T + (p.bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(s_data, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(s_noise, -30, 30)))
        to_context = up[:, None] * target + down @ other
        from_noise, from_data = down.T @ context, up[:, None] * context
        self._step("first", w1, to_context)
        self._step("second", w2, to_context)
        self._step("token", np.concatenate([w, noise]), np.concatenate([from_data, from_noise]))
        self._step("bias", np.concatenate([w, noise]), np.concatenate([up, down.sum(0)]))
        self.seen += len(w)


def _contexts(stream: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each; before a document's first token stands ``start``."""
    w2 = np.concatenate([[start], stream[:-1]])
    w1 = np.concatenate([[start, start], stream[:-2]])[: len(stream)]
    begins = np.concatenate([[0], ends[:-1]])
    w2[begins] = start
    w1[begins] = start
    w1[np.minimum(begins + 1, len(stream) - 1)[begins + 1 < ends]] = start
    return w1, w2


def _streams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    pieces = batch.column(0).to_pylist()
    stream = np.frombuffer(b"".join(pieces), dtype="<u2").astype(np.int64)
    return stream, np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 2)


def train(encoded: DataFrame, share: np.ndarray, start: int, s: Settings) -> np.ndarray:
    """Parameters learnt from all rows that are not held out, averaged over tasks by tokens seen.

    Each task returns its parameters once. The averages are running sums per slice of the
    parameter vector, so no task holds those of all others, and the driver gets one vector of
    the model's fixed size.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    flat = Parameters.initial(share, s).flat
    slices = 16
    for k in range(s.rounds):
        current = flat.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], current=current, k=k) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(current, share, s, 1000 * k + TaskContext.get().partitionId())
            for batch in batches:
                if not batch.num_rows:
                    continue
                stream, ends = _streams(batch)
                w1, w2 = _contexts(stream, ends, start)
                for a in range(0, len(stream), s.batch):
                    cut = slice(a, a + s.batch)
                    trainer.learn(w1[cut], w2[cut], stream[cut])
            if trainer.seen:
                parts = [x.astype(np.float64) for x in np.array_split(trainer.p.flat, slices)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(slices), pa.int32()), pa.array([float(trainer.seen)] * slices), pa.array(parts)],
                    names=["slice", "weight", "values"],
                )

        rows = encoded.filter("NOT held_out").filter(F.pmod(F.xxhash64("row"), F.lit(s.rounds)) == k)
        learnt = rows.select("classes").mapInArrow(run, "slice int, weight double, values array<double>")
        mean = learnt.groupBy("slice").agg(
            vector_to_array(Summarizer.mean(array_to_vector("values"), F.col("weight"))).alias("values")
        )
        got = {r["slice"]: r["values"] for r in mean.collect()}
        if len(got) == slices:  # else this round had no documents
            flat = np.concatenate([np.array(got[i]) for i in range(slices)])
    return flat


class Scorer:
    """Tables of log10 probabilities: of each class after each context word, and normalisers."""

    def __init__(self, flat: np.ndarray, classes: int, dimensions: int):
        p = Parameters(flat.astype(np.float32), classes, dimensions)
        self.first, self.second = p.first @ p.token.T, p.second @ p.token.T + p.bias
        top1, top2 = self.first.max(1, keepdims=True), self.second.max(1, keepdims=True)
        sums = np.exp(self.first - top1) @ np.exp(self.second - top2).T
        self.norm = np.log(np.maximum(sums, 1e-37)) + top1 + top2.T

    def log10(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.first[w1, w] + self.second[w2, w] - self.norm[w1, w2]).astype(np.float64) / math.log(10)


def score_documents(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """Scores of all documents by a model of those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per
    document, repeated rows included. Null text is empty and has just its end. ``held_out`` that
    is null counts as false. Without training documents all counts are zero, and every word
    belongs to the class of others.
    """
    s = settings
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(
        col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    counts = materialise(token_counts(source.filter("NOT held_out"), F.col("text")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    # bounded: dictionary_words rows of at most dictionary_bytes
    short = counts.filter((F.octet_length("token") <= s.dictionary_bytes) & (F.col("token") != END))
    top = short.filter(F.col("c") >= _least_count(short, s.dictionary_words)).collect()
    top.sort(key=lambda r: (-r["c"], r["token"]))
    ends = counts.filter(F.col("token") == END).first()
    words = [END, *[r["token"] for r in top]]
    seen = [int(ends["c"]) if ends else 0, *[int(r["c"]) for r in top]]
    classes = min(len(words), s.model_words) + 1
    vocabulary = spark.sparkContext.broadcast(Vocabulary(" ".join(words), np.array(seen, dtype=np.int64), classes))
    share = np.array([*[c + 1 for c in seen[: classes - 1]], n - sum(seen[: classes - 1]) + 1], dtype=float)
    share /= share.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = vocabulary.value.table(), vocabulary.value.counts
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                piece = batch.slice(a, 1024)
                e = encode(piece.column(2), known, often, classes)
                begins = np.concatenate([[0], e["ends"][:-1]])
                streams = [e["classes"][x:y].tobytes() for x, y in zip(begins.tolist(), e["ends"].tolist(), strict=True)]
                columns = [piece.column(0), piece.column(1), pa.array(streams, pa.binary())]
                columns += [pa.array(e[k], pa.int64()) for k in ("n_tokens", "n_other", "n_known")]
                columns += [pa.array(e[k].astype(float), pa.float64()) for k in ("base", "other")] + [e["rare"]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ENCODED.split(", ")])

    encoded = source.mapInArrow(run, ENCODED).withColumn("row", F.monotonically_increasing_id())
    encoded = materialise(encoded, "encoded")
    flat = train(encoded, share, 0, s)
    model, dimensions, name = flat.astype(np.float32), s.dimensions, f"scorer {uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_memo(name, lambda: Scorer(model, classes, dimensions))
        for batch in batches:
            if not batch.num_rows:
                continue
            stream, ends = _streams(batch)
            w1, w2 = _contexts(stream, ends, 0)
            of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            sums = np.bincount(of, weights=scorer.log10(w1, w2, stream), minlength=len(ends))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums)], names=["row", "model"])

    # words outside the dictionary get their counts in a join, one row per occurrence
    rare = (
        encoded.select("row", F.explode("rare").alias("token"))
        .join(counts, "token", "left")
        .groupBy("row").agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"),
            F.count("c").alias("rare_known"),
        )
    )
    scored = encoded.select("classes", "row").mapInArrow(score, "row long, model double")
    inside = classes - 1
    other_log = math.log10(max(1, n - sum(seen[:inside]) + v - sum(c > 0 for c in seen[:inside]) + 1))
    return (
        encoded.drop("classes", "rare").join(scored, "row").join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
            (F.col("model") + F.col("other") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_other") * other_log).alias("score"),
        )
    )
