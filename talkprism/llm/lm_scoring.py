"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Spark counts the tokens of all training texts. The most frequent are outputs of the model; the
others fall into classes by their last bytes, and inside a class a second log-bilinear step has a
vector for each of its frequent words. The words with vectors are as many as VECTORS times the
cube root of the tokens, the classes as twice the square root of these words, so both grow with
the corpus and a class stays small.

Training runs in rounds, each over its own part of the training texts, all texts in turn: every
partition takes the current parameters, makes stochastic noise-contrastive steps in numpy over
its tokens, and the parameters are averaged, by tokens seen and, for the words of classes, by how
often each was a target or a noise word. The sums go through a tree of bounded fan-in, so no task
and not the driver holds more than a few vectors of parameters.

The score of output w after outputs c2, c1 is A1[c1, w] + A2[c2, w] + b[w], each A a product
of context and target vectors. The exponential of a sum is a product, so one matrix product,
exp(A2 + b) times exp(A1) transposed, gives the normaliser of every context. Inside a class one
matrix product of the contexts met there and the vectors of its words gives theirs. So all
probabilities are exactly normalised. A token without a vector has its smoothed share of what its
class leaves to others, where every class keeps one place for unseen tokens.

The scoring pass looks frequent tokens up in a broadcast table; a document's other tokens,
distinct and counted, are joined with the full counts in Spark.

Defined cases: a null or empty text is its end token alone; a very long text is read whole; a
null doc_id is split as an empty string would be and is kept; repeated rows are scored each; with
nothing to learn from, every token has base probability 1 and the model is uniform; an empty
table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkprism.llm.common import materialize

#: The end of a text; no word has a space.
END = b" "
ADD = 0.1
FOLDS = 10
#: Words with a vector: so many times the cube root of the training tokens.
VECTORS = 48
#: Outputs that are words, and the least number of outputs that are classes of other words.
MODEL_WORDS = 1024
CLASSES = 256
#: Tokens broadcast with their counts, at least.
FREQUENT = 65_536
DIMENSION = 16
ROUNDS = 3
NOISE = 32
#: Noise words of each token of a class, drawn from its class.
CLASS_NOISE = 2
BATCH = 8192
RATE = 0.1
#: A training task reads so many tokens a round for each parameter, so the vectors sent stay in proportion to the text.
TOKENS_PER_PARAMETER = 4
#: Bytes of parameter vectors that a task, or the driver, adds up at once, and how many at most.
FAN_BYTES = 128 << 20
FAN = 16
#: Tokens scored together.
CHUNK = 200_000
_FLUSH_TOKENS = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()

    def flushed() -> pd.DataFrame:
        out = pd.DataFrame({"token": [t.decode("utf-8", "surrogatepass") for t in counts], "n": list(counts.values())})
        counts.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens(text))
            if len(counts) > _FLUSH_TOKENS:
                yield flushed()
    if counts:
        yield flushed()


def token_counts(train: DataFrame) -> DataFrame:
    """(token, n) over all texts of ``train`` (column text); tokens are counted in the tasks before they are shuffled."""
    return train.select("text").mapInPandas(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def rare_class(token: bytes, classes: int = CLASSES) -> int:
    """The class, from 0, of a token that is no output of its own."""
    return xxhash.xxh32_intdigest(token[-3:]) % classes


def _rare_class(classes: int):
    @F.pandas_udf(T.IntegerType())
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([rare_class(v.encode("utf-8", "surrogatepass"), classes) for v in values], dtype="int32")

    return of


@dataclass
class Vocabulary:
    """What training and scoring need of the counts. Outputs: the first ``n_words`` tokens of the index, then classes. The first ``n_vectors`` tokens have a vector. A class's slots are its words with a vector, then one for all its others."""

    index: dict[bytes, int]
    counts: np.ndarray
    n_words: int
    n_vectors: int
    total: int
    kinds: int
    class_counts: np.ndarray
    class_kinds: np.ndarray

    @property
    def n_classes(self) -> int:
        return len(self.class_counts)

    @property
    def n_outputs(self) -> int:
        return self.n_words + self.n_classes

    @property
    def n_slots(self) -> int:
        return self.n_vectors - self.n_words + self.n_classes

    @property
    def denominator(self) -> float:
        return self.total + ADD * (self.kinds + 1)

    def __post_init__(self):
        rare = list(self.index)[self.n_words :]
        own = np.array([rare_class(t, self.n_classes) for t in rare], dtype=np.int64)
        self.outputs = np.concatenate([np.arange(self.n_words), self.n_words + own])
        self.log_add = np.log10(self.counts + ADD)
        members = own[: self.n_vectors - self.n_words]
        sizes = np.bincount(members, minlength=self.n_classes)
        #: Where the slots of each class end; the last of them is for others.
        self.ends = np.cumsum(sizes + 1)
        order = np.argsort(members, kind="stable")
        place = np.arange(len(members)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        slots = self.ends[own] - 1
        slots[order] = (self.ends - 1 - sizes)[members[order]] + place
        self.slots = np.concatenate([np.full(self.n_words, -1), slots])
        tail = self.counts[self.n_words : self.n_vectors]
        others = self.class_counts - np.bincount(members, tail, self.n_classes)
        self.slot_counts = np.zeros(self.n_slots)
        self.slot_counts[self.ends - 1] = others
        self.slot_counts[slots[: len(members)]] = tail
        #: log10 of the smoothed total of a class's others: another's log10(count + ADD) less this is its share of them.
        self.other_logs = np.log10(others + ADD * (self.class_kinds - sizes + 1))
        self.shares = np.zeros(len(self.counts))
        self.shares[self.n_vectors :] = self.log_add[self.n_vectors :] - self.other_logs[own[len(members) :]]

    def unigram(self) -> np.ndarray:
        """Smoothed probability of each output."""
        n = np.concatenate([self.counts[: self.n_words], self.class_counts]) + 1.0
        return n / n.sum()

    def within(self) -> np.ndarray:
        """Smoothed probability of each slot in its class."""
        n = self.slot_counts + 1.0
        starts = np.concatenate([[0], self.ends[:-1]])
        return n / np.repeat(np.add.reduceat(n, starts), self.ends - starts)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(index of each token or -1, its output, its slot or -1, the tokens without an index)."""
        own = tokens(text)
        get = self.index.get
        at = np.fromiter(map(get, own, repeat(-1)), dtype=np.int64, count=len(own))
        known = at >= 0
        outputs, slots = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        outputs[known], slots[known] = self.outputs[at[known]], self.slots[at[known]]
        missing = [own[i] for i in np.flatnonzero(~known).tolist()]
        classes = np.array([rare_class(t, self.n_classes) for t in missing], dtype=np.int64)
        outputs[~known], slots[~known] = self.n_words + classes, self.ends[classes] - 1
        return at, outputs, slots, missing


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (token, n): totals, the most frequent tokens, sums of the classes; each grows as a small power of the corpus."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    vectors = round(VECTORS * total ** (1 / 3))
    classes = max(CLASSES, round(2 * vectors**0.5))
    # Counts by steps of their logarithm tell the least count to take, so no more rows are sent than are wanted.
    step = F.floor(F.log2("n") * 64).cast("int")
    room, least = max(FREQUENT, vectors), None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        room -= r["k"]
        if room < 0:
            break
        least = r["step"]
    top = counts.where(step >= F.lit(least)).collect() if least is not None else []
    top = sorted(((r["token"].encode("utf-8", "surrogatepass"), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))
    n_words = min(MODEL_WORDS, len(top))
    own = [t.decode("utf-8", "surrogatepass") for t, _ in top[:n_words]]
    rare = counts.where(~F.col("token").isin(own)).groupBy(_rare_class(classes)("token").alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    sums, sizes = np.zeros(classes), np.zeros(classes)
    for r in rare:
        sums[r["c"]], sizes[r["c"]] = r["n"], r["k"]
    return Vocabulary({t: i for i, (t, _) in enumerate(top)}, np.array([n for _, n in top], dtype=np.float64), n_words, max(n_words, min(vectors, len(top))), total, kinds, sums, sizes)


@dataclass
class Model:
    """Outputs: context vectors one and two back (the last row is the start of a text), target vectors, biases. Slots of classes: the same, with contexts of their own."""

    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    b: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    t: np.ndarray
    d: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, within: np.ndarray | None = None, seed: int = 42) -> Model:
        rng = np.random.default_rng(seed)
        k, slots = len(unigram), np.ones(0) if within is None else within
        small = lambda n: rng.normal(0, 0.1, (n, DIMENSION)).astype(np.float32)
        return cls(small(k + 1), small(k + 1), small(k), np.log(unigram).astype(np.float32), small(k + 1), small(k + 1), small(len(slots)), np.log(slots).astype(np.float32))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.r1, self.r2, self.q, self.b, self.s1, self.s2, self.t, self.d

    def copy(self) -> Model:
        return Model(*[x.copy() for x in self.arrays()])

    def sums(self, seen: float, touched: np.ndarray) -> np.ndarray:
        """All parameters times their weights (the tokens seen; for slots, how often each was touched), then the weights."""
        slots = [(self.t * touched[:, None]).ravel(), self.d * touched]
        return np.concatenate([*[x.ravel() * seen for x in self.arrays()[:6]], *slots, touched, [seen]]).astype(np.float32)

    def averaged(self, sums: np.ndarray) -> Model:
        """The model of added-up sums; slots that none touched stay as they are."""
        new, at, slots = [], 0, len(self.d)
        for x in self.arrays():
            new.append(sums[at : at + x.size].reshape(x.shape).astype(np.float64))
            at += x.size
        touched, seen = sums[at : at + slots].astype(np.float64), float(sums[-1])
        new[:6] = [x / seen for x in new[:6]]
        some = touched > 0
        new[6] = np.where(some[:, None], new[6] / np.maximum(touched, 1)[:, None], self.t)
        new[7] = np.where(some, new[7] / np.maximum(touched, 1), self.d)
        return Model(*[x.astype(np.float32) for x in new])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A1, A2 + b, and the logarithm of each context's normaliser [c2, c1]."""
        a1, a2 = self.r1 @ self.q.T, self.r2 @ self.q.T + self.b
        m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        z = np.exp(a2 - m2) @ np.exp(a1 - m1).T
        return a1, a2, np.log(z) + m2 + m1.T

    def within_classes(self, ends: np.ndarray, c1: np.ndarray, c2: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Natural log probability of each slot among those of its class, after outputs c2, c1: for each class one matrix product."""
        out = np.zeros(len(slots))
        classes = np.searchsorted(ends, slots, side="right")
        order = np.argsort(classes, kind="stable")
        cuts = np.flatnonzero(np.diff(classes[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            c = classes[part[0]]
            first, last = (ends[c - 1] if c else 0), ends[c]
            scores = (self.s1[c1[part]] + self.s2[c2[part]]) @ self.t[first:last].T + self.d[first:last]
            most = scores.max(axis=1)
            out[part] = scores[np.arange(len(part)), slots[part] - first] - most - np.log(np.exp(scores - most[:, None]).sum(axis=1, dtype=np.float64))
        return out


def contexts(outputs: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two back."""
    padded = np.concatenate([[start, start], outputs])
    return padded[1:-1], padded[:-2]


class Trainer:
    """Noise-contrastive steps with Adagrad; the noise words of a step are shared by its batch."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.noise, self.rng = model, noise, np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.squares = [np.full_like(x, 1e-2) for x in model.arrays()]
        self.touched = np.zeros(len(model.d))

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        m, k = self.m, len(self.m.b)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), k - 1)
        h = m.r1[c1] + m.r2[c2]
        true = (h * m.q[w]).sum(axis=1) + m.b[w] - self.log_noise[w]
        false = h @ m.q[drawn].T + (m.b[drawn] - self.log_noise[drawn])
        g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        g_false = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        scale = np.float32(1 / len(w))
        g_h = (g_true[:, None] * m.q[w] + g_false @ m.q[drawn]) * scale
        g_q = _sum_rows(w, g_true[:, None] * h, k) * scale
        np.add.at(g_q, drawn, (g_false.T @ h) * scale)
        g_b = np.bincount(w, g_true, k) * scale
        np.add.at(g_b, drawn, g_false.sum(axis=0) * scale)
        for value, square, gradient in zip((m.r1, m.r2, m.q, m.b), self.squares[:4], (_sum_rows(c1, g_h, k + 1), _sum_rows(c2, g_h, k + 1), g_q, g_b), strict=True):
            square += gradient * gradient
            value += (RATE * gradient / np.sqrt(square)).astype(np.float32)


    def among(self, vocab: Vocabulary) -> None:
        """The noise distribution inside classes: the smoothed counts of their slots."""
        within = vocab.within()
        self.ends, self.slot_cumulative = vocab.ends, np.cumsum(within)  # a class after the other, each with weight 1
        self.log_slot_noise = np.log(CLASS_NOISE * within).astype(np.float32)

    def class_step(self, c1: np.ndarray, c2: np.ndarray, slots: np.ndarray) -> None:
        """A step on the slots of classes; each has noise from its own class."""
        m, k, n = self.m, len(self.m.b), len(slots)
        classes = np.searchsorted(self.ends, slots, side="right")
        drawn = classes[:, None] + self.rng.random((n, CLASS_NOISE))
        first = np.concatenate([[0], self.ends[:-1]])[classes]
        drawn = np.clip(np.searchsorted(self.slot_cumulative, drawn, side="right"), first[:, None], self.ends[classes, None] - 1)
        at = np.concatenate([slots[:, None], drawn], axis=1)
        h = m.s1[c1] + m.s2[c2]
        t = m.t[at]
        score = np.einsum("nd,nkd->nk", h, t) + m.d[at] - self.log_slot_noise[at]
        gradient = -1 / (1 + np.exp(-np.clip(score, -30, 30)))
        gradient[:, 0] = 1 / (1 + np.exp(np.clip(score[:, 0], -30, 30)))
        gradient *= np.float32(1 / n)
        g_h = np.einsum("nk,nkd->nd", gradient, t)
        for value, square, g in zip((m.s1, m.s2), self.squares[4:6], (_sum_rows(c1, g_h, k + 1), _sum_rows(c2, g_h, k + 1)), strict=True):
            square += g * g
            value += (RATE * g / np.sqrt(square)).astype(np.float32)
        flat = at.ravel()
        order = np.argsort(flat)
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        used = ordered[starts]
        g_t = np.add.reduceat((gradient[:, :, None] * h[:, None, :]).reshape(-1, DIMENSION)[order], starts, axis=0)
        g_d = np.add.reduceat(gradient.ravel()[order], starts)
        for value, square, g in zip((m.t, m.d), self.squares[6:], (g_t, g_d), strict=True):
            new = square[used] + g * g
            square[used] = new
            value[used] += RATE * g / np.sqrt(new)
        self.touched[used] += np.diff(np.append(starts, len(flat)))


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, d], n) for d in range(rows.shape[1])], axis=1)


def _trained(shared, current, seed: int):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab: Vocabulary = shared.value
        k, part = vocab.n_outputs, TaskContext.get().partitionId()
        trainer, seen, held, size = None, 0, [], 0
        for batch in batches:
            for text in batch["text"]:
                if trainer is None:
                    trainer = Trainer(current.value.copy(), vocab.unigram(), seed + part)
                    trainer.among(vocab)
                _, outputs, slots, _ = vocab.read(text)
                held.append((*contexts(outputs, k), outputs, slots))
                size += len(outputs)
                seen += len(outputs)
                if size >= BATCH:
                    _steps(trainer, held)
                    held, size = [], 0
        if held:
            _steps(trainer, held)
        if trainer:
            yield pd.DataFrame({"part": [part], "sums": [trainer.m.sums(float(seen), trainer.touched).tobytes()]})

    return train


def _steps(trainer: Trainer, held: list[tuple[np.ndarray, ...]]) -> None:
    c1, c2, w, slots = (np.concatenate(x) for x in zip(*held, strict=True))
    order = trainer.rng.permutation(len(w))
    for i in range(0, len(w), BATCH):
        part = order[i : i + BATCH]
        trainer.step(c1[part], c2[part], w[part])
        part = part[slots[part] >= 0]
        if len(part):
            trainer.class_step(c1[part], c2[part], slots[part])


def _total(vectors) -> np.ndarray:
    total = 0.0
    for v in vectors:
        total = total + np.frombuffer(v, dtype=np.float32).astype(np.float64)
    return total


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, seed: int = 42) -> Model:
    """The model of all ``texts`` (columns turn, text); each round takes the texts of its turn."""
    spark = texts.sparkSession
    model, shared = Model.start(vocab.unigram(), vocab.within(), seed), spark.sparkContext.broadcast(vocab)
    schema = "part int, sums binary"

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "sums": [_total(group["sums"]).astype(np.float32).tobytes()]})

    size = sum(x.size for x in model.arrays())
    tasks = max(spark.sparkContext.defaultParallelism, -(-vocab.total // (rounds * TOKENS_PER_PARAMETER * size)))
    fan = max(2, min(FAN, FAN_BYTES // (4 * (size + len(model.d)))))
    texts = texts.coalesce(tasks)
    parts = (texts.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    for r in range(rounds):
        current = spark.sparkContext.broadcast(model)
        rows, left = texts.where(F.col("turn") == r).select("text").mapInPandas(_trained(shared, current, seed + 1000 * r), schema), parts
        while left > fan:
            left = -(-left // fan)
            rows = rows.withColumn("part", F.col("part") % left).groupBy("part").applyInPandas(added, schema)
        total = _total(x["sums"] for x in rows.collect())  # at most ``fan`` vectors
        if isinstance(total, np.ndarray):
            model = model.averaged(total)
    return model


_SCORED = "n_tokens long, head_known long, head_base double, head_score double, tail_tokens array<string>, tail_counts array<int>"


def _scorer(shared, tables):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab: Vocabulary = shared.value
        model, (a1, a2, log_z) = tables.value
        k = vocab.n_outputs

        def scored(rows: pd.DataFrame, read: list[tuple]) -> pd.DataFrame:
            at, outputs, slots = (np.concatenate([x[i] for x in read]) for i in range(3))
            c1, c2 = (np.concatenate(x) for x in zip(*[contexts(x[1], k) for x in read], strict=True))
            text = np.repeat(np.arange(len(read)), [len(x[0]) for x in read])
            logs = a1[c1, outputs].astype(np.float64) + a2[c2, outputs] - log_z[c2, c1]
            inner = np.flatnonzero(slots >= 0)
            logs[inner] += model.within_classes(vocab.ends, c1[inner], c2[inner], slots[inner])
            logs /= np.log(10)
            known = at >= 0
            logs[known] += vocab.shares[at[known]]
            logs[~known] -= vocab.other_logs[outputs[~known] - vocab.n_words]
            total = lambda x: np.bincount(text, x, len(read))
            base = np.zeros(len(at))
            base[known] = vocab.log_add[at[known]]
            tails = [Counter(x[3]) for x in read]
            return rows.drop(columns="text").assign(
                n_tokens=[len(x[0]) for x in read], head_known=total(known).astype(np.int64), head_base=total(base), head_score=total(logs),
                tail_tokens=[[t.decode("utf-8", "surrogatepass") for t in c] for c in tails], tail_counts=[list(c.values()) for c in tails],
            )

        for batch in batches:
            start, read, size = 0, [], 0
            for i, text in enumerate(batch["text"], 1):
                read.append(vocab.read(text))
                size += len(read[-1][0])
                if size >= CHUNK or i == len(batch):
                    yield scored(batch.iloc[start:i].reset_index(drop=True), read)
                    start, read, size = i, [], 0

    return score


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's; both learn
    from the rows whose fold isn't 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id)) == 0).alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    counts = materialize(token_counts(learn), "lm-counts")
    vocab = vocabulary(counts)
    turn = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(ROUNDS)).alias("turn")
    model = train(learn.select(turn, "text"), vocab)

    shared, tables = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast((model, model.tables()))
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    kind = dict(rows.dtypes)["doc_id"]
    scored = materialize(keyed.mapInPandas(_scorer(shared, tables), f"row long, doc_id {kind}, held_out boolean, {_SCORED}"), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tail_tokens", "tail_counts")).alias("t")).select("row", F.col("t.tail_tokens").alias("token"), F.col("t.tail_counts").alias("times"))
    rare = rare.join(counts, "token", "left")
    tail = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = scored.join(tail, "row", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + log - F.col("n_tokens") * F.lit(float(np.log10(vocab.denominator)))).alias("base_score"),
        (F.col("head_score") + log).alias("score"),
    )
