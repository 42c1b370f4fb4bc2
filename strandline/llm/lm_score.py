"""Language-model scores from a log-bilinear model with noise-contrastive estimation.

Word counts of all training texts give ``SINGLE`` classes of one frequent word
each and ``SHARED`` classes of the other words by their last two bytes. The
log-bilinear model predicts the class of a token from the classes of the two
before it: a context vector, the sum of their vectors through one matrix each,
meets every class's output vector. It is trained in numpy on the class trigram
counts of the whole corpus, with noise from the class frequencies: each of
``PASSES`` steps follows the gradient of the noise-contrastive objective over
every trigram, weighted by its count, and over all noise classes in expectation,
so nothing is drawn. However large the input, there are at most ``CLASSES``**3
counts (64 MB) and a step works through them in a fraction of a second, less than
a job takes to start; one task therefore makes all steps, and the model does not
depend on partitions. Matrix products over all contexts at a time then give normalised class
log-probabilities, and a word's share of its class is its smoothed count.

Counts are aggregated and joined as tables. The driver sees only the class
table, the parameters, and the ``KNOWN_WORDS`` most frequent words (the bound of
the broadcast that scores most tokens in place; the other words are joined).

Defined cases: a null text is empty and is one end token. A null id is in the
training part. Repeated rows give a row each and count each. Texts of any length
are taken whole. Only doc_id and text are read, so other columns may have any
name. An empty table gives an empty result. Without training texts every
probability is uniform and the base score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, held_out, saved
from .textkit import runs, text_buffer

SINGLE, SHARED = 192, 64
CLASSES = SINGLE + SHARED
KNOWN_WORDS = 150_000
#: Steps of the training, each a pass over all counts.
PASSES = 80
ALPHA = 0.1
#: The end token as a word: no word is empty.
END = b""


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for part in runs(batch, "text"):
        data, offsets = text_buffer(part.column("text"))
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = raw[a:b].lower().split()
            words.append(END)
            yield words


def count_words(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, c) over all texts, end tokens included; summed inside tasks first."""

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for words in _texts(batch):
                seen.update(words)
                if len(seen) > flush:
                    yield batch_of(seen)
                    seen = Counter()
        yield batch_of(seen)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class WordClasses:
    single: dict[bytes, int]
    suffix: dict[bytes, int]

    def of(self, word: bytes) -> int:
        k = self.single.get(word)
        return self.suffix.get(word[-2:], CLASSES - 1) if k is None else k


class _Lookup(dict):
    """Classes of words, remembered up to a bound."""

    def __init__(self, classes: WordClasses):
        super().__init__(classes.single)
        self.classes = classes

    def __missing__(self, word: bytes) -> int:
        k = self.classes.of(word)
        if len(self) < KNOWN_WORDS:
            self[word] = k
        return k


def _trigrams(docs: DataFrame, classes: WordClasses, flush: int = 1 << 21) -> DataFrame:
    """(code, n): counts of class trigrams, the two before a text's first token being ends."""
    end = classes.of(END)

    def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(n.astype(np.int64))], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held, size = _Lookup(classes), [], 0
        for batch in batches:
            for words in _texts(batch):
                ids = np.full(len(words) + 2, end, np.int32)
                ids[2:] = np.fromiter(map(look.__getitem__, words), np.int32, len(words))
                held.append((ids[:-2] * CLASSES + ids[1:-1]) * CLASSES + ids[2:])
                size += len(words)
                if size > flush:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class LogBilinear:
    """score(c | a, b) = (X[a] A + X[b] B) . Q[c] + bias[c]."""

    SHAPES = (("x", (CLASSES, 32)), ("a", (32, 32)), ("b", (32, 32)), ("q", (CLASSES, 32)), ("bias", (CLASSES,)))

    def __init__(self, flat: np.ndarray):
        at = 0
        for name, shape in self.SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size

    @classmethod
    def start(cls, frequency: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        parts = [rng.normal(0, 0.1, (CLASSES, 32)), np.eye(32) * 0.5, np.eye(32), rng.normal(0, 0.1, (CLASSES, 32)), np.log(frequency)]
        return np.concatenate([p.ravel() for p in parts])

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n, _ in self.SHAPES]).astype(np.float64)

    def gradient(self, counts: dict[int, np.ndarray], frequency: np.ndarray, noise: float) -> np.ndarray:
        """Gradient a token of the objective over all trigrams, as flat(); counts[a][b, c] is the count of (a, b, c)."""
        ln_noise, expected = (np.log(frequency * noise)).astype(np.float32), (frequency * noise).astype(np.float32)
        later = self.x @ self.b
        by_first, by_second = np.zeros((CLASSES, 32)), np.zeros((CLASSES, 32))
        gq, gb, total = np.zeros((CLASSES, 32)), np.zeros(CLASSES), 0.0
        for a, n in counts.items():
            weight = n.sum(1)
            live = np.flatnonzero(weight)
            n, weight = n[live], weight[live]
            r = self.x[a] @ self.a + later[live]
            with np.errstate(over="ignore"):
                true = 1 / (1 + np.exp(ln_noise - self.bias - r @ self.q.T))
            g = n - (n + weight[:, None] * expected) * true
            gr = g @ self.q
            gq += g.T @ r
            gb += g.sum(0, dtype=np.float64)
            by_first[a] = gr.sum(0)
            by_second[live] += gr
            total += weight.sum(dtype=np.float64)
        gx = by_first @ self.a.T + by_second @ self.b.T
        return np.concatenate([g.ravel() for g in (gx, self.x.T @ by_first, self.x.T @ by_second, gq, gb)]) / total

    @classmethod
    def train(cls, counts: dict[int, np.ndarray], frequency: np.ndarray, noise: float = 96.0, rate: float = 0.05) -> np.ndarray:
        """Parameters after PASSES Adam steps, each over all counts, with a rate that falls to none."""
        flat = cls.start(frequency)
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        for t in range(PASSES):
            g = cls(flat).gradient(counts, frequency, noise)
            mean = 0.9 * mean + 0.1 * g
            square = 0.98 * square + 0.02 * g * g
            step = (mean / (1 - 0.9 ** (t + 1))) / (np.sqrt(square / (1 - 0.98 ** (t + 1))) + 1e-9)
            flat = flat + rate * (0.5 + 0.5 * np.cos(np.pi * t / PASSES)) * step
        return flat

    def table(self) -> np.ndarray:
        """log10 P(class | the two classes before), for all contexts: (CLASSES**2, CLASSES)."""
        out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
        later = self.x @ self.b
        for a in range(CLASSES):
            s = (self.x[a] @ self.a + later) @ self.q.T + self.bias
            s -= s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            out[a * CLASSES : (a + 1) * CLASSES] = s
        out /= np.float32(np.log(10))
        return out


def train_classes(trigrams: DataFrame, frequency: np.ndarray) -> LogBilinear:
    """Trains on all of (code, n): a table of counts for each first class, then all passes in one task."""

    def dense(table):
        code = table["code"].to_numpy()
        n = np.zeros(CLASSES * CLASSES, np.float32)
        n[code % (CLASSES * CLASSES)] = table["n"].to_numpy()
        return pa.table([pa.array(code[:1] // (CLASSES * CLASSES), pa.int32()), pa.array([n.tobytes()], pa.binary())], ["a", "counts"])

    first = F.floor(F.col("code") / (CLASSES * CLASSES)).alias("a")
    tables = saved(trigrams.select(first, "code", "n").groupBy("a").applyInArrow(dense, "a int, counts binary"), "class-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            for a, n in zip(batch.column("a").to_pylist(), batch.column("counts"), strict=True):
                counts[a] = np.frombuffer(n.as_buffer(), np.float32).reshape(CLASSES, CLASSES)
        if counts:
            flat = LogBilinear.train(dict(sorted(counts.items())), frequency)
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["p"])

    trained = tables.coalesce(1).mapInArrow(run, "p array<double>").collect()
    return LogBilinear(np.array(trained[0]["p"]) if trained else LogBilinear.start(frequency))


def score_texts(docs: DataFrame, folds: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Rows whose id's crc32 leaves no remainder by ``folds`` are held out of all that is learned.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    training = docs.where(~held_out("doc_id", folds))
    counts = saved(count_words(training), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(totals["n"]), int(totals["v"])

    # the end token always has a class of its own
    top = [END] + [bytes(r["word"]) for r in counts.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(SINGLE - 1).collect()]
    single = {w: i for i, w in enumerate(top)}
    last = F.substring("word", -2, 2)
    others = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in top], "word binary")), "word", "left_anti")
    endings = others.groupBy(last.alias("suffix")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "suffix").limit(SHARED - 1).collect()
    classes = WordClasses(single, {bytes(r["suffix"]): SINGLE + i for i, r in enumerate(endings)})
    kinds = spark.createDataFrame([(bytearray(s), k) for s, k in classes.suffix.items()] or [(bytearray(b""), CLASSES - 1)], "suffix binary, k int")
    grouped = others.join(F.broadcast(kinds), last == F.col("suffix"), "left").groupBy(F.coalesce("k", F.lit(CLASSES - 1)).alias("k"))
    shared = {r["k"]: (r["n"], r["v"]) for r in grouped.agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}

    frequency = np.full(CLASSES, 0.5)
    for r in counts.join(F.broadcast(spark.createDataFrame([(bytearray(w), i) for w, i in single.items()], "word binary, k int")), "word").select("k", "c").collect():
        frequency[r["k"]] += r["c"]
    for k, (n, _) in shared.items():
        frequency[k] += n
    frequency /= frequency.sum()
    model = train_classes(saved(_trigrams(training, classes), "trigrams"), frequency)

    least = at_most(counts, "c", KNOWN_WORDS)
    known = {} if least is None else {bytes(w): int(c) for w, c in counts.where(F.col("c") >= least).toPandas().itertuples(index=False)}
    inside = np.zeros(CLASSES)  # log10 of the mass that a class's words share
    for k in range(SINGLE, CLASSES):
        n, v = shared.get(k, (0, 0))
        inside[k] = np.log10(n + ALPHA * (v + 1))
    held = spark.sparkContext.broadcast((classes, model, known, inside))
    names = ["row", "doc_id", "n_tokens", "n_known", "log_c", "log_own", "log_class", "word", "tf", "shared"]
    schema = "row long, doc_id long, n_tokens long, n_known long, log_c double, log_own double, log_class double, word binary, tf long, shared boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model, known, inside = held.value
        table, look, end = model.table(), _Lookup(classes), classes.of(END)
        row = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in runs(batch, "text")):
            rows, rare = [], []
            for doc, words in zip(part.column("doc_id").to_pylist(), _texts(part), strict=True):
                n = len(words)
                ids = np.full(n + 2, end, np.int64)
                ids[2:] = np.fromiter(map(look.__getitem__, words), np.int64, n)
                c = np.fromiter((known.get(w, -1) for w in words), np.int64, n)
                seen, common = c >= 0, ids[2:] >= SINGLE
                logs = np.log10(c[seen] + ALPHA)
                by_class = float(table[ids[:-2] * CLASSES + ids[1:-1], ids[2:]].sum(dtype=np.float64) - inside[ids[2:]].sum())
                rows.append((row, doc, n, int(seen.sum()), float(logs.sum()), float(logs[common[seen]].sum()), by_class))
                left = Counter(words[i] for i in np.flatnonzero(~seen).tolist())
                rare += [(row, w, t, w not in classes.single) for w, t in left.items()]
                row += 1
            # a header row for each text, then a row for each of its words outside the broadcast
            k, m = len(rows), len(rare)
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate([pa.int64()] * 4 + [pa.float64()] * 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_())], names)
            words_of = [pa.array([r[j] for r in rare], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.bool_()))]
            blank = [pa.nulls(m, t) for t in [pa.int64()] * 3 + [pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([words_of[0], *blank, *words_of[1:]], names)

    made = saved(docs.mapInArrow(run, schema), "scored-parts")
    heads = made.where("word is null").drop("word", "tf", "shared")
    unknown = counts if least is None else counts.where(F.col("c") < least)
    rare = made.where("word is not null").select("row", "word", "tf", "shared").join(unknown, "word", "left")
    log_c = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))
    rare = rare.select(
        "row",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"),
        log_c.alias("log_c"),
        F.when(F.col("shared"), log_c).otherwise(0.0).alias("log_own"),
        F.lit(0.0).alias("log_class"),
    )
    whole = heads.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "log_c", "log_own", "log_class")])
    return whole.select(
        "doc_id",
        held_out("doc_id", folds).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * float(np.log10(n_all + ALPHA * (v_all + 1)))).alias("base_score"),
        (F.col("log_class") + F.col("log_own")).alias("score"),
    )
