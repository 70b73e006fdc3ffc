"""Language-model scores: a log-bilinear model over two words of context, and an add-one unigram base.

Method. Every word has a class: the most frequent words one each, all others that of
their last characters. A log-bilinear neural model gives P(class | two classes before): the embeddings of
both, weighted by position, add up to a context vector, and its dot product with the embedding of a class, plus
that class's bias, is the class's log-odds. It is trained in numpy with noise-contrastive estimation: minibatches of
the runs of three classes of the whole training corpus, each against classes drawn at random from the
smoothed unigram distribution. Runs of three are counted in Spark; their table stays distributed. In a round every
partition of it trains a copy of the model, and the copies are averaged. Log-odds add up over positions, so the
normalisers of all contexts are one matrix product. Within a class, words have add-one
probabilities; one more share stands for all words that training did not meet. So
the probabilities of all words add up to 1 for every context.

Counts of words cover the whole training corpus and stay distributed: documents are
dealt to blocks, the distinct words of a block fetch their counts by one join, and
a block's documents are scored together. Words are compared by 64-bit hashes.

Defined cases: null or empty text is the end token alone. Repeated rows count and are scored
each; identifiers play no part, null or repeated. Without training documents all counts are 0 and the model is uniform
over classes. An empty table gives an empty table. Result columns replace input
columns of the same name.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import without
from strandlake.session import materialize, n_blocks, ship, text_size

#: Classes of one frequent word each, and of the other words by their endings: fewer if those are not ENDING_WORDS words each.
FREQUENT, ENDINGS, ENDING_WORDS = 256, 768, 8
CLASSES = FREQUENT + ENDINGS
DIMENSIONS = 40
#: Rounds of training, rows of a minibatch, noise classes drawn for it, and how much commoner than data noise counts.
ROUNDS, MINIBATCH, DRAWN, NOISE = 3, 2048, 96, 25.0
RATE = 0.1
#: Copies that are trained in a round at most, which bounds what the driver averages.
TRAINERS = 32
#: Where the squares of gradients start: it shortens the first steps of classes that were hardly met.
CALM = 1e-6
#: Words whose class a worker remembers.
HELD = 400_000
#: Bytes of text whose words a task numbers at a time.
SHARE = 8 << 20
#: Runs of three classes are numbers below RUNS, a power of two; an odd factor spreads them evenly over buckets of PLACES runs.
RUNS, PLACES = CLASSES**3, 1 << 16
SPREAD = 0x1E3779B1
GATHER = pow(SPREAD, -1, RUNS)
#: Entries a task holds of one bucket before it adds them up, runs of a row of the table, rows of a batch, and runs that are shuffled together for training.
PENDING, PIECE, PIECES, SHUFFLED = 1 << 20, 1024, 1024, 1 << 16
#: No word holds white space.
END = b"\n"
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def shares(arrays: Iterable[pa.Array], size: int = SHARE) -> Iterator[pa.Array]:
    """The texts of ``arrays`` in order, in arrays of about ``size`` bytes."""
    held, total = [], 0
    for texts in arrays:
        upto = total + np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        for end in (np.flatnonzero(np.diff(upto // size, prepend=0)) + 1).tolist():
            yield pa.concat_arrays([*held, texts.slice(start, end - start)])
            held, start = [], end
        if start < len(texts):
            held.append(texts.slice(start))
        total = int(upto[-1]) % size if len(upto) else total
    if held:
        yield pa.concat_arrays(held)


def numbered(texts: pa.Array, before: int = 0) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, sizes, words): the tokens of all texts one after the other as places in ``words``, and how many each text has.

    ``words``: what :func:`tokens` gives, each once, the end last. ``before``: ends that also come before each text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.values.dictionary_encode()
    kind = pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()
    words = pa.concat_arrays([coded.dictionary.cast(kind), pa.array([END], kind)])
    ids, end = coded.indices.to_numpy(), len(words) - 1
    # White space at a text's ends leaves empty strings there, as does a text without words; every list has a string.
    kept = ids != words.index(pa.scalar(b"", kind)).as_py()
    sizes = np.add.reduceat(kept, lists.offsets.to_numpy()[:-1], dtype=np.int64) + (before + 1) if len(texts) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    word = np.ones(ends[-1] if len(ends) else 0, bool)
    word[ends - 1] = False
    for i in range(before):
        word[ends - sizes + i] = False
    out = np.full(len(word), end, np.int32)
    out[word] = ids[kept]
    return out, sizes, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """:func:`word_hash` of each word."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def word_endings(words: pa.Array) -> np.ndarray:
    """:func:`ending` of each word."""
    last = pc.binary_slice(words, -3).dictionary_encode()
    return np.array([ending(w) for w in last.dictionary.to_pylist()], np.int64)[last.indices.to_numpy()]


class BilinearModel:
    """P(class | the class two before, the class before)."""

    def __init__(self, share: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        """``share``: how common each class is, where the biases start."""
        random = np.random.default_rng(seed)
        n = len(share)
        self.context, self.target = (random.normal(0, 0.1, (n, dimensions)).astype(np.float32) for _ in range(2))
        self.position = np.repeat(np.array([[0.5], [1.0]], np.float32), dimensions, 1)
        self.bias = np.log(share).astype(np.float32)[:, None]
        self.squares = [np.full_like(p, CALM) for p in self.parameters()]
        smooth = share**0.75
        self.noise = smooth / smooth.sum()

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.position, self.bias]

    def train(self, runs: np.ndarray, n: np.ndarray, random: np.random.Generator, mean: float, rate: float = RATE) -> None:
        """One pass over ``runs`` (rows of three classes, the last the target) that occur ``n`` times, ``mean`` on average."""
        log_noise = np.log(NOISE * self.noise).astype(np.float32)[:, None]
        upto = np.cumsum(self.noise)
        runs = np.ascontiguousarray(runs.T)
        odds_of_all = np.empty((MINIBATCH, DRAWN), np.float32)
        for i in range(0, len(n), MINIBATCH):
            far, near, target = runs[:, i : i + MINIBATCH]
            weight = (n[i : i + MINIBATCH] / (mean * len(target))).astype(np.float32)[:, None]
            drawn = np.minimum(np.searchsorted(upto, random.random(DRAWN) * upto[-1]), len(upto) - 1)
            v = (self.context * self.position[0]).take(far, 0)
            v += (self.context * self.position[1]).take(near, 0)
            q, z = self.target.take(target, 0), self.target.take(drawn, 0)
            above = self.bias - log_noise
            # Chances that a target is taken for noise, and that noise is taken for data.
            odds = np.einsum("ij,ij->i", v, q)[:, None] + above[target]
            pull = weight / (1 + np.exp(np.clip(odds, -30, 30)))
            push = np.matmul(v, -z.T, out=odds_of_all[: len(target)])
            push -= above[drawn].T
            np.exp(np.minimum(push, 30, out=push), out=push)
            push += 1
            np.divide(weight * np.float32(-NOISE / DRAWN), push, out=push)
            g = push @ z
            g += pull * q
            # Sums by class of context; what a position's weights are due follows from those.
            by_far, by_near = self._class_sums(far, g), self._class_sums(near, g)
            position = np.stack([np.einsum("ij,ij->j", by, self.context) for by in (by_far, by_near)])
            by_target = self._class_sums(target, pull * v)
            np.add.at(by_target, drawn, push.T @ v)
            bias = np.bincount(target, pull[:, 0], len(self.bias)) + np.bincount(drawn, push.sum(0), len(self.bias))
            # Rare classes get long steps and common ones short.
            for which, gradient in enumerate((by_far * self.position[0] + by_near * self.position[1], by_target, position, bias[:, None].astype(np.float32))):
                parameter, square = self.parameters()[which], self.squares[which]
                square += gradient * gradient
                parameter += rate * gradient / (np.sqrt(square) + np.float32(1e-8))

    def _class_sums(self, classes: np.ndarray, gradients: np.ndarray) -> np.ndarray:
        """The sum of the rows of each class."""
        order = np.argsort(classes.astype(np.uint16), kind="stable")  # a radix sort
        sorted_ = classes[order]
        first = np.flatnonzero(np.diff(sorted_, prepend=-1))
        sums = np.zeros_like(self.context)
        sums[sorted_[first]] = np.add.reduceat(gradients.take(order, 0), first, axis=0)
        return sums

    def to_bytes(self) -> bytes:
        return b"".join(p.tobytes() for p in [*self.parameters(), *self.squares])

    def average(self, copies: list[bytes], weights: list[float]) -> None:
        """Takes on the weighted mean of trained copies."""
        total = np.sum([w * np.frombuffer(c, np.float32).astype(np.float64) for c, w in zip(copies, weights, strict=True)], axis=0) / sum(weights)
        at = 0
        for p in [*self.parameters(), *self.squares]:
            p[...] = total[at : at + p.size].reshape(p.shape)
            at += p.size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(far, near, norm): log P(w | c, d) = far[c, w] + near[d, w] - norm[c, d]."""
        context, target = self.context.astype(np.float64), self.target.astype(np.float64)
        far, near = (context * self.position[0]) @ target.T, (context * self.position[1]) @ target.T + self.bias[:, 0].astype(np.float64)
        a, b = far.max(1, keepdims=True), near.max(1, keepdims=True)
        return far, near, np.log(np.exp(far - a) @ np.exp(near - b).T) + a + b.T


class Lexicon:
    """Classes of words, and what the small tables of the training corpus say."""

    def __init__(self, frequent: list[int], class_tokens: np.ndarray, class_words: np.ndarray, n: int, v: int):
        self.n, self.v = n, v
        order = np.argsort(np.array(frequent, np.int64)) if frequent else np.zeros(0, np.int64)
        self.hashes, self.numbers = np.array(frequent, np.int64)[order], order.astype(np.int64)
        self.by_hash = dict(zip(frequent, range(len(frequent)), strict=True))
        self.endings = len(class_tokens)
        self.rest = np.log((class_tokens + class_words + 1).astype(np.float64))
        self.model: BilinearModel | None = None
        self.far = self.near = self.norm = np.zeros((0, 0))
        self._known: dict[bytes, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def learnt(self, model: BilinearModel) -> None:
        self.model = model
        self.far, self.near, self.norm = model.tables()

    def log_p(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log P(target | far, near) of classes."""
        return self.far[far, target] + self.near[near, target] - self.norm[far, near]

    def classes(self, words: list[bytes]) -> list[int]:
        known = self._known
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > HELD:
                known.clear()
            for w in set(words).difference(known):
                c = self.by_hash.get(word_hash(w))
                known[w] = FREQUENT + ending(w) % self.endings if c is None else c
            return list(map(known.__getitem__, words))

    def classes_of(self, words: pa.Array) -> np.ndarray:
        """As :meth:`classes`, of each word of an array."""
        frequent = self.frequent_class(word_hashes(words))
        return np.where(frequent >= 0, frequent, FREQUENT + word_endings(words) % self.endings)

    def frequent_class(self, hashes: np.ndarray) -> np.ndarray:
        """Class of each hash, -1 for words that are not frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)


class LanguageModel:
    def __init__(self, counts: DataFrame, lexicon: Lexicon):
        self.counts, self.lexicon = counts, lexicon


def train(docs: DataFrame, keep: Column, text: str = "text") -> LanguageModel:
    """Counts over all documents for which ``keep`` holds, and the model trained on them."""
    ship(docs.sparkSession)
    texts = docs.where(keep).select(F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in shares(b.column(0) for b in batches):
            ids, _, words = numbered(share)
            n = np.bincount(ids, minlength=len(words))
            met = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words)[met]), pa.array(word_endings(words)[met], pa.int32()), pa.array(n[met])], names=["h", "ending", "n"])

    found = texts.mapInArrow(count, "h long, ending int, n long")
    counts = materialize(found.groupBy("h").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")), "counts")
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    by_class = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # ENDINGS rows
    class_tokens, class_words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in by_class:
        class_tokens[r["ending"]], class_words[r["ending"]] = r["c"], r["v"]
    n, v = int(class_tokens.sum()), int(class_words.sum())
    for r in top:
        class_tokens[r["ending"]] -= r["c"]
        class_words[r["ending"]] -= 1
    endings = max(1, min(ENDINGS, (v - len(top)) // ENDING_WORDS))
    class_tokens, class_words = (np.bincount(np.arange(ENDINGS) % endings, x, endings) for x in (class_tokens, class_words))
    lexicon = Lexicon([r["h"] for r in top], class_tokens, class_words, n, v)
    # Add-one over words, so that training starts from the base; classes of no word have next to nothing.
    share = np.full(CLASSES, 1e-3)
    share[: len(top)] = [r["c"] + 1 for r in top]
    share[FREQUENT : FREQUENT + endings] = class_tokens + class_words + 1
    lexicon.learnt(fit(packed_runs(texts, lexicon), BilinearModel(share / share.sum())))
    return LanguageModel(counts, lexicon)


def run_counts(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(run, n): how often three classes follow each other; two end tokens come before a text's first."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([pa.array(run), pa.array(n)], names=["run", "n"]) for run, n in _unpacked(batch))

    return packed_runs(texts, lexicon).mapInArrow(unpack, "run long, n long")


def packed_runs(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The counts of :func:`run_counts`, many to a row: bucket, places (16 bits each), n (64 bits each), runs, total.

    A task's counts leave by bucket as two byte strings, so the shuffle moves no row a run. Sorted by bucket
    they are added up as they stream in, in one array of PLACES numbers whatever the corpus.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for share in shares(b.column(0) for b in batches):
            ids, sizes, words = numbered(share, before=2)
            yield _runs(lex.classes_of(words)[ids], np.cumsum(sizes) - sizes)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = _BucketSums(), []
        for batch in batches:
            bucket, (places, at), (n, _) = batch.column(0).to_numpy(), _flat(batch.column(1), "<u2"), _flat(batch.column(2), "<u4")
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                if i == j:
                    continue
                if bucket[i] != sums.bucket:
                    rows += sums.finish(int(bucket[i]))
                sums.add(places[at[i] : at[j]], n[at[i] : at[j]])
            while len(rows) >= PIECES:
                yield _pieces(rows[:PIECES])
                rows = rows[PIECES:]
        rows += sums.finish(-1)
        for i in range(0, len(rows), PIECES):
            yield _pieces(rows[i : i + PIECES])

    found = texts.mapInArrow(count, "bucket int, places binary, n binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "bucket int, places binary, n binary, runs long, total long")


class _BucketSums:
    """Counts of one bucket's runs after the other."""

    def __init__(self):
        self.bucket, self.sums, self.waiting, self.held = -1, None, [], 0

    def add(self, places: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((places, n))
        self.held += len(n)
        if self.held > PENDING:
            self._settle()

    def _settle(self) -> None:
        places, n = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        sums = np.bincount(places, n, PLACES)  # whole numbers, exact below 2 ** 53
        self.sums = sums if self.sums is None else self.sums + sums
        self.waiting, self.held = [], 0

    def finish(self, following: int) -> list[tuple]:
        """Rows of the bucket that ends here."""
        rows = []
        if self.waiting:
            self._settle()
        if self.sums is not None:
            places = np.flatnonzero(self.sums)
            n = self.sums[places].astype("<i8")
            for i in range(0, len(places), PIECE):
                part = n[i : i + PIECE]
                rows.append((self.bucket, places[i : i + PIECE].astype("<u2").tobytes(), part.tobytes(), len(part), int(part.sum())))
        self.bucket, self.sums = following, None
        return rows


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "places", "n", "runs", "total"])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of byte strings holds, and where each row's begin (and the last one's end)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, n) of a batch's rows, about SHUFFLED at a time."""
    if not batch.num_rows:
        return
    bucket, (places, at), (n, _) = batch.column(0).to_numpy().astype(np.int64), _flat(batch.column(1), "<u2"), _flat(batch.column(2), "<i8")
    cuts = [0, *(np.flatnonzero(np.diff((at[1:] - 1) // SHUFFLED)) + 1).tolist(), len(bucket)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        code = np.repeat(bucket[i:j] * PLACES, np.diff(at[i : j + 1])) + places[at[i] : at[j]]
        yield code * GATHER % RUNS, n[at[i] : at[j]]


def _runs(c: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Counts by bucket of runs of three of classes ``c`` in texts that begin, with two ends, at ``at``; no run ends at those."""
    inside = np.ones(len(c), bool)
    inside[at] = inside[at + 1] = False
    run = ((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[inside[2:]]
    code, n = np.unique((run * SPREAD % RUNS).astype(np.int32), return_counts=True)
    bucket = code // PLACES
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(code))

    def strings(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), strings((code % PLACES).astype("<u2")), strings(n.astype("<u4"))], names=["bucket", "places", "n"])


def fit(runs: DataFrame, model: BilinearModel, rounds: int = ROUNDS) -> BilinearModel:
    """Trains on the table of :func:`packed_runs`: a copy of the model a partition and round, averaged by the tokens each saw.

    The table has at most RUNS runs whatever the corpus; TRAINERS bounds what the driver averages.
    """
    table = materialize(runs, "runs")
    distinct, total = table.agg(F.sum("runs"), F.sum("total")).first()
    for number in range(rounds if distinct else 0):
        shared, mean, rate = table.sparkSession.sparkContext.broadcast(model), total / distinct, RATE / (1 + number / 2)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            copy, seen = pickle.loads(pickle.dumps(shared.value)), 0  # noqa: B023
            random = np.random.default_rng([number, TaskContext.get().partitionId()])  # noqa: B023
            for batch in batches:
                for run, n in _unpacked(batch):
                    order = random.permutation(len(n))
                    run, n = run[order], n[order]
                    copy.train(np.stack([run // CLASSES**2, run // CLASSES % CLASSES, run % CLASSES], 1), n, random, mean, rate)  # noqa: B023
                    seen += int(n.sum())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([copy.to_bytes()]), pa.array([float(seen)])], names=["model", "seen"])

        copies = table.select("bucket", "places", "n").coalesce(TRAINERS).mapInArrow(learn, "model binary, seen double").collect()
        model.average([r["model"] for r in copies], [r["seen"] for r in copies])
    return model


def score(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens (long), base_score, score (double, log10)."""
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, *RESULT)
    _, size = text_size(docs, text)
    names, at = docs.columns, docs.columns.index(text)
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(n_blocks(docs, size))).cast("int").alias("block"))
    shared = spark.sparkContext.broadcast(model.lexicon)

    def distinct(table: pa.Table) -> pa.Table:
        h = np.unique(np.concatenate([word_hashes(numbered(share)[2]) for share in shares(table.column(f"c{at}").chunks)]))
        return pa.table({"block": pa.array(np.full(len(h), table.column("block")[0].as_py(), np.int32)), "h": pa.array(h)})

    fields = [(RESULT[0], T.LongType()), (RESULT[1], T.LongType()), (RESULT[2], T.LongType()), (RESULT[3], T.DoubleType()), (RESULT[4], T.DoubleType())]
    schema = T.StructType([*base.drop("block").schema.fields, *[T.StructField(n, t) for n, t in fields]])

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        lex = shared.value
        h = counts.column("h").to_numpy() if counts.num_rows else np.zeros(0, np.int64)
        order = np.argsort(h)
        h, c = h[order], (counts.column("c").to_numpy()[order] if counts.num_rows else h)
        parts = [_score_texts(share, lex, h, c) for share in shares(table.column(f"c{at}").chunks)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        n = table.num_rows
        return pa.table([*(table.column(f"c{i}") for i in range(len(names))), pa.array(columns[0]), pa.array(columns[1]), pa.array(np.full(n, lex.n, np.int64)), pa.array(columns[2]), pa.array(columns[3])], names=schema.names)

    words = base.groupBy("block").applyInArrow(distinct, "block int, h long")
    counted = words.join(model.counts.select("h", "c"), "h").select("block", "h", "c")
    out = base.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *RESULT)


def _score_texts(texts: pa.Array | list[str | None], lex: Lexicon, known: np.ndarray, counts: np.ndarray) -> tuple:
    """Tokens, known tokens, base score and score of each text, given sorted hashes and their counts."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    ids, sizes, words = numbered(texts)
    h = word_hashes(words)
    c = np.zeros(len(words), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        c = np.where(known[at] == h, counts[at], 0)
    frequent = lex.frequent_class(h)
    last = word_endings(words) % lex.endings
    cls = np.where(frequent >= 0, frequent, FREQUENT + last)
    within = np.where(frequent >= 0, 0.0, np.log(c + 1.0) - lex.rest[last])
    base = np.log(c + 1.0) - np.log(lex.n + (lex.v + 1.0))
    owner = np.repeat(np.arange(len(texts)), sizes)
    seq = cls[ids]
    near, far = np.empty_like(seq), np.empty_like(seq)
    starts = np.cumsum(sizes) - sizes
    near[1:], near[starts] = seq[:-1], cls[-1]
    far[1:], far[starts] = near[:-1], cls[-1]
    s = lex.log_p(far, near, seq) + within[ids]
    total = lambda x: np.bincount(owner, x, len(texts))
    return sizes, total((c > 0)[ids].astype(np.float64)).astype(np.int64), total(base[ids]) / np.log(10), total(s) / np.log(10)
