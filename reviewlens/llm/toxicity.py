"""A small convolutional text classifier: trained in numpy, applied to whole texts in Arrow batches.

All labelled rows are learned from. Up to ``shard_rows`` of them are one task's work; more are dealt into
shards, each of which trains from the common parameters for a while; their changes are averaged, and the
next round begins from there.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.text import (
    Words,
    alphanumeric_table,
    bounded_batches,
    id_and_text,
    slices,
    words_of,
)
from reviewlens.storage import stored

# Frequent words by which a text's language is guessed; one tie goes to the first.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it was for with",
    "fr": "le la les des et un une est que qui dans",
    "de": "der die und den das von mit ist ein zu im",
    "es": "el los las una por con del y es en se",
}
LANGUAGES = [*LANGUAGE_WORDS, "other"]

BUCKETS = 1 << 15
STEM_BYTES = 4  # a word is embedded as the sum of itself and its first bytes
PAD = 2 * BUCKETS  # the bucket after those of words and stems; its embedding is zero
BLOCK_WORDS = 1 << 15
BINS = 10_000  # of probability, by which rows are counted where there are many
TABLE = alphanumeric_table()


@dataclass
class Settings:
    """What is fixed before training; ``shard_rows`` and ``shard_words`` say what a task holds, about."""

    shard_rows: int = 8000
    shard_words: int = 8_000_000
    rounds: int = 4  # in which shards train apart, where there are several
    batch_words: int = 1 << 20  # a step ends early when its texts have as many words
    dimension: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 10
    steps: int = 1000
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-5
    drop_words: float = 0.1
    min_docs: int = 4  # buckets in fewer training texts have the zero embedding
    seed: int = 7


@dataclass
class Model:
    """Embeddings, filters by width, output layer, and one threshold per guessed language."""

    embedding: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def parts(self) -> dict:
        """What scoring needs, as plain arrays: above all, what each bucket adds to each filter at
        each of the filter's positions."""
        tables = {w: [self.embedding @ k for k in kernel] for w, kernel in self.kernels.items()}
        cuts = [self.thresholds.get(name, 0.5) for name in LANGUAGES]
        return {
            "tables": tables,
            "biases": self.biases,
            "weights": self.weights,
            "bias": self.bias,
            "cuts": np.array(cuts),
        }

    def to_bytes(self) -> bytes:
        """The parameters alone, some 3 MB."""
        arrays = {"embedding": self.embedding, "weights": self.weights, "bias": np.array(self.bias)}
        arrays |= {f"kernel{w}": k for w, k in self.kernels.items()}
        arrays |= {f"biases{w}": b for w, b in self.biases.items()}
        arrays |= {f"cut_{name}": np.array(cut) for name, cut in self.thresholds.items()}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as file:
            arrays = dict(file)

        def named(prefix: str) -> dict:
            return {k.removeprefix(prefix): v for k, v in arrays.items() if k.startswith(prefix)}

        return cls(
            arrays["embedding"],
            {int(w): k for w, k in named("kernel").items()},
            {int(w): b for w, b in named("biases").items()},
            arrays["weights"],
            float(arrays["bias"]),
            {name: float(cut) for name, cut in named("cut_").items()},
        )


def _stems(raw: np.ndarray, inside: np.ndarray, begins: np.ndarray, closes: np.ndarray):
    """Cuts every word behind its first bytes."""
    last = np.minimum(np.flatnonzero(closes), np.flatnonzero(begins) + STEM_BYTES - 1)
    short = np.zeros(len(raw), bool)
    short[last] = True
    return TABLE[raw], begins, short


def features_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of texts, and a row of two buckets for each: the word's and its stem's."""
    words, stems = words_of(texts, TABLE), words_of(texts, TABLE, _stems)
    both = np.stack([words.hashes, stems.hashes], axis=1) % np.uint64(BUCKETS)
    return words, both.astype(np.int32) + np.array([0, BUCKETS], np.int32)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the language words, sorted, and the language each counts for."""
    pairs = []
    for n, listed in enumerate(LANGUAGE_WORDS.values()):
        found = words_of(pa.array([listed]), alphanumeric_table())
        pairs += [(h, n) for h in found.hashes]
    pairs.sort()
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


def languages_of(words: Words) -> np.ndarray:
    """For each text the language most of whose frequent words it holds, or the last, "other"."""
    keys, kinds = _language_table()
    at = np.minimum(np.searchsorted(keys, words.hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == words.hashes)
    doc = np.searchsorted(words.first, hit, "right") - 1
    n = len(words.first) - 1
    counts = np.zeros((n, len(LANGUAGE_WORDS) + 1))
    np.add.at(counts, (doc, kinds[at[hit]]), 1)
    counts[:, -1] = 0.5
    return counts.argmax(axis=1)


def _padded(buckets: np.ndarray, first: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' buckets with ``gap`` pads behind each, and where each text then begins."""
    sizes = np.diff(first)
    begin = first[:-1] + gap * np.arange(len(sizes))
    out = np.full((len(buckets) + gap * len(sizes), 2), PAD, np.int32)
    out[np.arange(len(buckets)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = buckets
    return out, np.concatenate([begin, [len(out)]])


def probabilities(parts: dict, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The network's output for each text, whole, however long: maxima are carried over blocks."""
    tables = parts["tables"]
    gap = max(tables)
    line, begin = _padded(buckets, first, gap)
    n = len(first) - 1
    pooled = []
    for width, table in tables.items():
        best = np.full((n, table[0].shape[1]), -np.inf, np.float32)
        # Windows may begin at any word or at a text's first pad, never where the next text is seen.
        for a in range(0, len(line), BLOCK_WORDS):
            b = min(len(line), a + BLOCK_WORDS)
            own = np.concatenate([line[a : b + width - 1], np.full((max(0, b + width - 1 - len(line)), 2), PAD)])
            total = sum(
                table[k][own[k : k + b - a, c]] for k in range(width) for c in (0, 1)
            )
            doc0 = np.searchsorted(begin, a, "right") - 1
            doc1 = np.searchsorted(begin, b, "left")
            edge = np.maximum(begin[doc0:doc1], a) - a
            stop = np.minimum(begin[doc0 + 1 : doc1 + 1] - gap + 1, b) - a
            real = np.flatnonzero(stop > edge)
            if len(real):
                cuts = np.stack([edge[real], stop[real]], axis=1).ravel()
                if cuts[-1] == b - a:
                    cuts = cuts[:-1]
                peak = np.maximum.reduceat(total, cuts, axis=0)[::2]
                best[doc0 + real] = np.maximum(best[doc0 + real], peak)
        pooled.append(np.maximum(best + parts["biases"][width], 0))
    logit = np.concatenate(pooled, axis=1) @ parts["weights"] + parts["bias"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _found(texts: list[np.ndarray]) -> np.ndarray:
    """How many texts have each bucket."""
    found = np.zeros(PAD + 1, np.int64)
    for text in texts:
        found[np.unique(text)] += 1
    return found


def _initial(found: np.ndarray, s: Settings, random: np.random.Generator) -> dict:
    """Parameters to begin with; buckets that too few texts have stay at nought."""
    d, f = s.dimension, s.filters
    par = {"E": random.normal(0, 0.3, (PAD + 1, d)).astype(np.float32)}
    par["E"][found < s.min_docs] = 0
    for w in s.widths:
        par[f"K{w}"] = random.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32)
        par[f"b{w}"] = np.zeros(f, np.float32)
    par["W"] = random.normal(0, 0.3, f * len(s.widths)).astype(np.float32)
    par["c"] = np.zeros(1, np.float32)
    return par


def _batches(order: np.ndarray, sizes: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """The texts in order, as many at a time as a step takes."""
    at = 0
    while at < len(order):
        chosen = order[at : at + s.batch]
        fits = int(np.searchsorted(np.cumsum(sizes[chosen]), s.batch_words, "right"))
        yield chosen[: max(1, fits)]
        at += max(1, min(fits, len(chosen)))


def _descend(
    par: dict, texts: list[np.ndarray], labels: np.ndarray, found: np.ndarray, share: float, steps: int,
    s: Settings, random: np.random.Generator,
) -> None:
    """Changes the parameters by ``steps`` batches, at least whole rounds of the texts."""
    known = np.where(found < s.min_docs, PAD, np.arange(PAD + 1)).astype(np.int32)
    texts = [known[text] for text in texts]
    sizes = np.array([len(text) for text in texts])
    m1 = {k: np.zeros_like(v) for k, v in par.items()}
    m2 = {k: np.zeros_like(v) for k, v in par.items()}
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    while len(texts) and step < steps:
        for chosen in _batches(random.permutation(len(texts)), sizes, s):
            grad = _gradient(par, [texts[i] for i in chosen], labels[chosen], cost[chosen], s, random)
            step += 1
            for k, g in grad.items():
                rows = slice(None)
                if k == "E":
                    rows, g = g
                g = g + s.decay * par[k][rows]
                m1[k][rows] = 0.9 * m1[k][rows] + 0.1 * g
                m2[k][rows] = 0.999 * m2[k][rows] + 0.001 * g * g
                rise = m1[k][rows] / (1 - 0.9**step)
                par[k][rows] -= s.rate * rise / (np.sqrt(m2[k][rows] / (1 - 0.999**step)) + 1e-8)


def _share(toxic: float, rows: int) -> float:
    return float(np.clip(toxic / rows, 1e-3, 1 - 1e-3)) if rows else 0.5


def _model(par: dict, s: Settings) -> Model:
    kernels, biases = {w: par[f"K{w}"] for w in s.widths}, {w: par[f"b{w}"] for w in s.widths}
    return Model(par["E"], kernels, biases, par["W"], float(par["c"][0]))


def train(texts: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Gradient descent (Adam) on the cross entropy, with the classes weighted equally.

    Max pooling passes the gradient to one window per text and filter only, so a step costs little
    beyond the forward pass.
    """
    random, found = np.random.default_rng(settings.seed), _found(texts)
    par = _initial(found, settings, random)
    share = _share(labels.sum(), len(labels))
    _descend(par, texts, labels, found, share, settings.steps, settings, random)
    return _model(par, settings)


def _gradient(par, texts, labels, cost, s: Settings, random) -> dict:
    gap = max(s.widths)
    dropped = [np.where(random.random((len(t), 1)) < s.drop_words, PAD, t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    line, begin = _padded(np.concatenate(dropped).astype(np.int32), first, gap)
    vectors = par["E"][line[:, 0]] + par["E"][line[:, 1]]
    peaks, places = [], []
    for w in s.widths:
        count = len(line) - w + 1
        total = sum(vectors[k : k + count] @ par[f"K{w}"][k] for k in range(w))
        place = np.stack(
            [a + total[a : min(b - gap + 1, count)].argmax(axis=0) for a, b in zip(begin, begin[1:])]
        )
        peaks.append(np.take_along_axis(total, place, axis=0) + par[f"b{w}"])
        places.append(place)
    hidden = np.concatenate(peaks, axis=1)
    active = np.maximum(hidden, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ par["W"] + par["c"][0], -30, 30)))
    slope = ((p - labels) * cost / len(texts)).astype(np.float32)
    grad = {"W": active.T @ slope, "c": np.array([slope.sum()], np.float32)}
    back = slope[:, None] * par["W"] * (hidden > 0)
    used, change = [], []
    for n, w in enumerate(s.widths):
        own = back[:, n * s.filters : (n + 1) * s.filters]
        grad[f"b{w}"] = own.sum(axis=0)
        kernel = np.empty_like(par[f"K{w}"])
        for k in range(w):
            at = places[n] + k
            kernel[k] = np.einsum("ifd,if->df", vectors[at], own)
            pushed = (own[:, :, None] * par[f"K{w}"][k].T[None]).reshape(-1, s.dimension)
            for c in (0, 1):
                used.append(line[at, c].ravel())
                change.append(pushed)
        grad[f"K{w}"] = kernel
    rows, back_at = np.unique(np.concatenate(used), return_inverse=True)
    total = np.zeros((len(rows), s.dimension), np.float32)
    np.add.at(total, back_at, np.concatenate(change))
    total[rows == PAD] = 0
    grad["E"] = (rows, total)
    return grad


def threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """Where accuracy is best on calibration rows: the middle of the widest such gap, or 0.5."""
    if len(p) < 20 or labels.min() == labels.max():
        return 0.5
    order = np.argsort(p)
    p, y = p[order], labels[order]
    right = np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    edge = np.concatenate([[0], p, [1]])
    best = np.flatnonzero(right == right.max())
    widest = best[np.argmax(edge[best + 1] - edge[best])]
    return float(np.clip((edge[widest] + edge[widest + 1]) / 2, 0.02, 0.98))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id's digits is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, words, language, toxic) of every labelled text that may be learned from."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id")
    known = usable.agg(F.max("toxic").cast("int").alias("toxic")).withColumnRenamed("doc_id", "labelled")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, buckets = features_of(batch.column(1))
            ends = pa.array(2 * words.first, pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.array(buckets.ravel()))
            language = pa.array(languages_of(words).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rows, language, batch.column(2)],
                names=["doc_id", "words", "language", "toxic"],
            )

    rows = id_and_text(docs).where(~held_out()).join(known, F.col("doc_id") == F.col("labelled"))
    one_text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        one_text, F.max("toxic").alias("toxic")
    )
    schema = "doc_id long, words array<int>, language int, toxic int"
    return stored(rows.select("doc_id", "text", "toxic").mapInArrow(features, schema), "toxicity")


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts, languages and labels of a task's rows (doc_id, words, language, toxic), by id."""
    texts, rest = [], []
    for batch in batches:
        texts += [np.array(row.values, np.int32).reshape(-1, 2) for row in batch.column("words")]
        own = [batch.column(name).to_numpy() for name in ("doc_id", "language", "toxic")]
        rest.append(np.stack(own, axis=1).astype(np.int64))
    about = np.concatenate(rest) if rest else np.zeros((0, 3), np.int64)
    order = np.argsort(about[:, 0], kind="stable")
    return [texts[k] for k in order], about[order, 1], about[order, 2]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Trains on all labelled rows that are not held out.

    ``labels``: doc_id, toxic (0 or 1; several rows of an id count as their maximum; others are
    ignored); of several texts of an id the one with the smallest hash is learned from. Texts are
    learned from whole. Every fifth row, by id, is kept from training and calibrates the thresholds by
    language. Without usable rows, the model is untrained and scores near 0.5. Up to ``shard_rows`` rows are
    one task's work. More are dealt into shards; of these the driver gets the parameters alone, averaged in
    two levels, numbers of texts per bucket and counts per hundredth of a percent of probability.
    """
    s = settings or Settings()
    bounded_batches(docs.sparkSession)
    rows = _training_rows(docs, labels)
    count, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0)) / 2).first()
    shards = max(1, math.ceil(count / s.shard_rows), math.ceil(words / s.shard_words))
    if shards > 1:
        return _fit_shards(rows, shards, s)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, language, toxic = _gathered(batches)
        yield pa.RecordBatch.from_pydict({"model": [_calibrated(texts, language, toxic, s).to_bytes()]})

    return Model.from_bytes(rows.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def _flat(par: dict) -> np.ndarray:
    return np.concatenate([np.ravel(par[k]) for k in sorted(par)])


def _unflat(flat: np.ndarray, like: dict) -> dict:
    names = sorted(like)
    ends = np.cumsum([like[k].size for k in names])[:-1]
    return {k: part.reshape(like[k].shape).astype(np.float32) for k, part in zip(names, np.split(flat, ends))}


def _added(group: pa.Table) -> pa.Table:
    """Changes of several shards, and how many shards changed each number, summed."""
    columns = [[np.frombuffer(row.as_py(), np.float32) for row in group[name]] for name in ("change", "shards")]
    return pa.table({name: [sum(rows).tobytes()] for name, rows in zip(("change", "shards"), columns)})


def _averaged(group: pa.Table) -> pa.Table:
    """The same sums as one mean: what each number changes by in the shards that changed it."""
    sums = _added(group)
    change, shards = (np.frombuffer(sums[name][0].as_py(), np.float32) for name in ("change", "shards"))
    return pa.table({"change": [(change / np.maximum(shards, 1)).tobytes()]})


def _learner(begin: Broadcast, share: float, turn: int, steps: int, s: Settings) -> Callable:
    """For a task's rows, which are a shard: what a round changes in the common parameters."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, found = begin.value
        own, number = {k: v.copy() for k, v in common.items()}, TaskContext.get().partitionId()
        texts, _, labels = _gathered(batches)
        if not texts:
            return
        _descend(own, texts, labels, found, share, steps, s, np.random.default_rng([s.seed, turn, number]))
        change = _flat(own) - _flat(common)
        changed = (change != 0).astype(np.float32)
        yield pa.RecordBatch.from_pydict(
            {"branch": pa.array([number // 8], pa.int32()), "change": [change.tobytes()], "shards": [changed.tobytes()]}
        )

    return learn


def _fit_shards(rows: DataFrame, shards: int, s: Settings) -> Model:
    """Rounds of training in shards; a number's changes are averaged over the shards that changed it.

    The stored rows are read as they lie, one shard a task, and every round goes at least once through all.
    """
    spark, sums = rows.sparkSession, "change binary, shards binary"
    # About every fifth row.
    spare = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4
    learned, steps = rows.where(~spare), math.ceil(2 * s.steps / (s.rounds * shards))
    number, toxic = learned.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share, found = _share(toxic, number), np.zeros(PAD + 1, np.int64)
    bucket = F.explode(F.array_distinct("words")).alias("bucket")
    texts = learned.select(bucket).groupBy("bucket").count().toArrow()
    found[texts["bucket"].to_numpy()] = texts["count"].to_numpy()
    par = _initial(found, s, np.random.default_rng(s.seed))
    for turn in range(s.rounds):
        begin = spark.sparkContext.broadcast((par, found))
        learn = _learner(begin, share, turn, steps, s)
        changes = learned.mapInArrow(learn, f"branch int, {sums}")
        few = changes.groupBy("branch").applyInArrow(_added, sums)
        mean = few.groupBy(F.lit(0).alias("all")).applyInArrow(_averaged, "change binary").toArrow()
        par = _unflat(_flat(par) + np.frombuffer(mean["change"][0].as_py(), np.float32), par)
        begin.destroy()
    model = _model(par, s)
    _calibrate_shards(rows.where(spare), model)
    return model


def _calibrate_shards(spare: DataFrame, model: Model) -> None:
    """Thresholds out of the counts of all spare rows by language, bin of probability and label."""
    shared = spare.sparkSession.sparkContext.broadcast(model.to_bytes())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Model.from_bytes(shared.value).parts()
        for batch in batches:
            texts = batch.column("words")
            first = (np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy())]) // 2).astype(np.int64)
            p = probabilities(parts, texts.flatten().to_numpy().reshape(-1, 2), first)
            bins = np.minimum((p * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("language"), pa.array(bins), batch.column("toxic")], names=["language", "bin", "toxic"]
            )

    counts = np.zeros((len(LANGUAGES), 2, BINS), np.int64)
    rated = spare.select("words", "language", "toxic").mapInArrow(rate, "language int, bin int, toxic int")
    for row in rated.groupBy("language", "bin", "toxic").count().collect():
        counts[row["language"], row["toxic"], row["bin"]] = row["count"]
    shared.destroy()
    for n, name in enumerate(LANGUAGES):
        model.thresholds[name] = _binned_threshold(*counts[n])


def _binned_threshold(clean: np.ndarray, toxic: np.ndarray) -> float:
    """As ``threshold``, for numbers of rows per bin of probability."""
    if clean.sum() + toxic.sum() < 20 or not clean.any() or not toxic.any():
        return 0.5
    (used,) = np.nonzero(clean + toxic)
    below = np.concatenate([[0], np.cumsum(clean[used])])
    above = np.concatenate([np.cumsum(toxic[used][::-1])[::-1], [0]])
    edge = np.concatenate([[0], (used + 0.5) / BINS, [1]])
    best = np.flatnonzero(below + above == (below + above).max())
    widest = best[np.argmax(edge[best + 1] - edge[best])]
    return float(np.clip((edge[widest] + edge[widest + 1]) / 2, 0.02, 0.98))


def _calibrated(
    texts: list[np.ndarray], language: np.ndarray, toxic: np.ndarray, s: Settings
) -> Model:
    """A model of four fifths of the texts, with thresholds from the rest."""
    spare = np.arange(len(texts)) % 5 == 4
    model = train([t for t, x in zip(texts, spare) if not x], toxic[~spare], s)
    later = [t for t, x in zip(texts, spare) if x]
    first = np.concatenate([[0], np.cumsum([len(t) for t in later])]).astype(np.int64)
    flat = np.concatenate(later) if later else np.zeros((0, 2), np.int32)
    p = probabilities(model.parts(), flat, first)
    for n, name in enumerate(LANGUAGES):
        own = language[spare] == n
        model.thresholds[name] = threshold(p[own], toxic[spare][own])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, probability, score) for every row of ``docs``, from its whole text alone.

    ``language`` is guessed from the words; no other column than doc_id and text is read, and the
    doc_id is only passed on. The score moves the language's threshold to 0.5 and keeps the order:
    toxic means 0.5 or more. Null and empty texts, and texts without words, score as a text of
    padding only. Repeated rows score alike. Words count as hashed into a fixed number of buckets;
    a long text is scored in blocks, over all of its words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Model.from_bytes(shared.value).parts()
        for batch in slices(batches, "text"):
            words, buckets = features_of(batch.column(1))
            p = probabilities(parts, buckets, words.first).astype(np.float64)
            language = languages_of(words)
            t = parts["cuts"][language]
            moved = np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([LANGUAGES[n] for n in language]),
                    pa.array(p),
                    pa.array(np.clip(moved, 0, 1)),
                ],
                names=["doc_id", "language", "probability", "score"],
            )

    rows = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, language string, probability double, score double")
