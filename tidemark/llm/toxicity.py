"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in the tasks on all labelled rows, thresholds by language."""
from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import scratch_path, small_batches, stored, table, text_slices, whole_text
from .hashing import letter_words

EPOCHS, VISITS = 8, 48_000      # passes over all training texts, at least; of few texts more, until so many were visited
SHARD_CHARS = 8_000_000         # of the training texts in one shard, about
UNIT = 1 << 24                  # moves of parameters are summed in such parts
CELLS = 256                     # logits of one unit told apart by the scale
PREFIXES = (4, 5, 6, 7, 8)            # bytes: parts of words that have embeddings of their own
WIDTHS = (1, 2, 3)
CUT = 0.7
CUTS = tuple(float(x) for x in np.arange(0.3, 0.96, 0.05))


@dataclass
class TextCNN:
    """Embeddings of a word are the sum of those of its hash and of its prefixes' hashes; filters of several widths slide
    over them, each keeps its maximum over the text, and a logistic layer reads the maxima. No position, no language."""
    bits: int = 16
    dim: int = 8
    filters: int = 8
    seed: int = 11
    drop: float = 0.3
    rare: int = 300
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.p = {"E": r.normal(0, 0.02, (1 << self.bits, self.dim)), "w": r.normal(0, 0.3, self.filters * len(WIDTHS)), "b": np.zeros(1)}
        for k in WIDTHS:
            self.p[f"F{k}"] = r.normal(0, 0.5, (k * self.dim, self.filters))
            self.p[f"c{k}"] = np.zeros(self.filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.weight, self.known = 1.0, np.ones(1 << self.bits, bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h, bounds = letter_words(texts, PREFIXES)
        return (h >> np.uint64(64 - self.bits)).astype(np.int32), bounds

    def forward(self, ids: np.ndarray, bounds: np.ndarray, back: bool = False, drop: np.ndarray | None = None):
        """Logits per text; with ``back`` also the pooled values and the position of every maximum (-1: none)."""
        n, last = len(bounds) - 1, len(WIDTHS) - 1
        x = np.zeros((len(ids), self.dim), np.float32)
        for column in ids.T:
            x += self.p["E"][column]
        if drop is not None:
            x[drop] = 0
        pooled = np.zeros((n, self.filters * (last + 1)), np.float32)
        where = np.full(pooled.shape, -1, np.int64)
        for j, k in enumerate(WIDTHS):
            m = len(x) - k + 1
            owners = np.flatnonzero(np.diff(bounds) >= k)
            if m <= 0 or not len(owners):
                continue
            y = sum(x[i:i + m] @ self.p[f"F{k}"][i * self.dim:(i + 1) * self.dim] for i in range(k)) + self.p[f"c{k}"]
            for e in bounds[1:-1].tolist():                     # windows over the edge of two texts count for none
                y[max(0, e - k + 1):min(e, m)] = -1
            a = bounds[owners]
            top = np.maximum.reduceat(y, a, axis=0)
            f = slice(j * self.filters, (j + 1) * self.filters)
            pooled[owners, f] = np.maximum(top, 0)
            if back:
                for o, s in zip(owners.tolist(), a.tolist()):
                    where[o, f] = s + np.argmax(y[s:bounds[o + 1] - k + 1], 0)
        logits = pooled @ self.p["w"] + self.p["b"]
        return (logits, pooled, where) if back else logits

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words and bounds per text, made slice by slice."""
        parts = [self.ids(texts[a:b]) for a, b in text_slices(texts)] or [self.ids([])]
        return np.concatenate([p for p, _ in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))))

    def texts_with(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Per slot, how many clean and how many toxic texts have it."""
        seen = np.zeros((1 << self.bits, 2), np.int64)
        for a, b, y in zip(bounds[:-1], bounds[1:], labels):
            seen[np.unique(ids[a:b]), int(y)] += 1
        return seen

    def forget_rare(self, seen: np.ndarray, clean: int, toxic: int) -> None:
        """Training's view of the whole set. A toxic text weighs so much that there are two clean ones to a toxic one at most;
        an embedding of few texts could only learn those texts by heart, so it stays 0."""
        self.weight = max(1.0, clean / (2 * max(1, toxic)))
        self.known = seen @ np.array([1, self.weight]) >= max(3, int(clean + self.weight * toxic) // self.rare)
        self.p["E"][~self.known] = 0

    def train(self, texts: list[str], labels: np.ndarray, visits: int = VISITS) -> None:
        """The whole training on texts at hand: as ``train_model`` does it where one shard holds them all."""
        pairs = dict.fromkeys(zip(texts, labels.tolist()))      # copies teach nothing new
        texts, labels = [t for t, _ in pairs], np.array([y for _, y in pairs], np.float32)
        ids, bounds = self.encode(texts)
        toxic = int(labels.sum())
        self.forget_rare(self.texts_with(ids, bounds, labels), len(texts) - toxic, toxic)
        self.fit(ids, bounds, labels, np.random.default_rng(self.seed), epochs(len(texts), visits))

    def fit(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, r: np.random.Generator, epochs: int, batch: int = 32, rate: float = 0.01) -> None:
        """Adam on the logistic loss; only the words at the maxima get a gradient, so a step touches few embeddings."""
        known = self.known
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(labels))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                part = np.concatenate([ids[bounds[i]:bounds[i + 1]] for i in pick])
                b = np.concatenate(([0], np.cumsum([bounds[i + 1] - bounds[i] for i in pick] + [0])))   # the last is an empty clean text
                y = np.append(labels[pick], 0)
                weight = np.where(y == 1, self.weight, 1.0)
                logits, pooled, where = self.forward(part, b, True, r.random(len(part)) < self.drop)
                d = (((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - y) * weight / weight.sum()).astype(np.float32)
                g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
                dp = d[:, None] * self.p["w"] * (pooled > 0)
                rows, values = [], []
                for j, k in enumerate(WIDTHS):
                    o, f = np.nonzero(dp[:, j * self.filters:(j + 1) * self.filters])
                    t, dv = where[o, j * self.filters + f], dp[o, j * self.filters + f]
                    gf, gc = np.zeros_like(self.p[f"F{k}"]), np.zeros_like(self.p[f"c{k}"])
                    np.add.at(gc, f, dv)
                    for i in range(k):
                        word = part[t + i]
                        x = self.p["E"][word].sum(1)
                        np.add.at(gf.reshape(k, self.dim, self.filters)[i].T, f, dv[:, None] * x)
                        back = dv[:, None] * self.p[f"F{k}"].reshape(k, self.dim, self.filters)[i][:, f].T
                        rows.append(word.ravel())
                        values.append(np.repeat(back, word.shape[1], 0))
                    g[f"F{k}"], g[f"c{k}"] = gf, gc
                step += 1
                if rows:
                    rows, values = np.concatenate(rows), np.concatenate(values)
                    u, inverse = np.unique(rows[known[rows]], return_inverse=True)
                    ge = np.zeros((len(u), self.dim), np.float32)
                    np.add.at(ge, inverse, values[known[rows]])
                else:
                    u, ge = np.empty(0, np.int64), np.empty((0, self.dim), np.float32)
                for key, grad, at in [(k, x, slice(None)) for k, x in g.items()] + [("E", ge, u)]:
                    m[key][at] = 0.9 * m[key][at] + 0.1 * grad
                    v[key][at] = 0.999 * v[key][at] + 0.001 * grad * grad
                    self.p[key][at] -= rate * (m[key][at] / (1 - 0.9 ** step)) / (np.sqrt(v[key][at] / (1 - 0.999 ** step)) + 1e-7)

    def logits(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self.forward(*self.ids(texts[a:b])) for a, b in text_slices(texts)] or [np.empty(0, np.float32)])

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts).astype(float) + b, -30, 30)))

    def calibrate(self, texts: list[str], labels: np.ndarray, langs: list) -> None:
        """Logistic scaling on rows that training did not see; per language the cut that errs least there, nearest to CUT."""
        z = self.logits(texts).astype(float)
        self.fit_scale(z, labels, np.ones(len(z)))
        s = self.score(texts)
        own = {x: np.array([y == x for y in langs]) for x in langs if x is not None}
        self.fit_thresholds({x: (int((labels[o] == 0).sum()), int((labels[o] == 1).sum()), [int(((s[o] >= t) != (labels[o] == 1)).sum()) for t in CUTS]) for x, o in own.items()})

    def fit_scale(self, z: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """``counts`` rows each with a logit and a label."""
        a, b = 1.0, 0.0
        for _ in range(200):                                    # Newton with a little damping
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, e = (p * (1 - p) + 1e-6) * counts, (p - labels) * counts
            h = np.array([[(w * z * z).sum() + 5, (w * z).sum()], [(w * z).sum(), w.sum() + 5]])   # stays near the trained scale
            da, db = np.linalg.solve(h, [(e * z).sum() + 5 * (a - 1), e.sum() + 5 * b])
            a, b = a - 0.5 * da, b - 0.5 * db
        if a > 0:
            self.scale = (float(min(a, 3.0)), float(np.clip(b, -3, 3)))

    def fit_thresholds(self, found: dict) -> None:
        """``found``: per language clean rows, toxic rows, and the errors of each of CUTS."""
        usual = min(range(len(CUTS)), key=lambda i: abs(CUTS[i] - CUT))
        self.thresholds = {x: CUTS[min(range(len(CUTS)), key=lambda i: (wrong[i], abs(i - usual)))] for x, (clean, toxic, wrong) in sorted(found.items()) if clean and toxic}

    def flat(self) -> np.ndarray:
        """All parameters in rows of ``dim``: the embeddings, then the rest."""
        rest = np.concatenate([x.ravel() for k, x in self.p.items() if k != "E"])
        return np.concatenate([self.p["E"], np.pad(rest, (0, -len(rest) % self.dim)).reshape(-1, self.dim)])

    def move(self, rows: np.ndarray, by: np.ndarray) -> None:
        """Adds ``by`` to these rows of ``flat``."""
        all_rows = self.flat()
        all_rows[rows] += by.astype(np.float32)
        at = len(self.p["E"])
        self.p["E"], rest = all_rows[:at], all_rows[at:].ravel()
        at = 0
        for k, x in self.p.items():
            if k != "E":
                self.p[k] = rest[at:at + x.size].reshape(x.shape).copy()
                at += x.size


def epochs(texts: int, visits: int = VISITS) -> int:
    return max(EPOCHS, -(-visits // max(1, texts)))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """(key, toxic, check, lang, id_, copies, n) of every labelled text of ``docs``, without the texts: copies share a key, and with
    it the side; a fifth is for calibration (check). ``learn`` tells which rows of ``labels`` may be used."""
    use = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if learn is not None:
        use = use.where(learn)
    use = use.groupBy(F.col("doc_id").alias("id_")).agg(F.max("toxic").cast("int").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.sha2(whole_text(), 256).alias("key"), lang.alias("lang"), F.length(whole_text()).alias("n")).join(use, F.expr("doc_id = id_"))
    rows = rows.withColumn("check", F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    return rows.groupBy("key", "toxic", "check", "lang").agg(F.min("id_").alias("id_"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))


def once(found: DataFrame, split: bool) -> DataFrame:
    """Texts for calibration once per label and language, all others once per label: further copies teach nothing new."""
    side = found.withColumn("check", F.col("check") & F.lit(split)).withColumn("lang", F.when(F.col("check"), F.col("lang")))
    return side.groupBy("key", "toxic", "check", "lang").agg(F.min("id_").alias("id_"), F.sum("copies").alias("copies"), F.max("n").alias("n"))


def store_shards(docs: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """The rows of ``once`` with their texts, by shards, in an order that hangs on the texts alone."""
    texts = docs.select(F.col("doc_id").alias("id_"), F.sha2(whole_text(), 256).alias("key"), whole_text().alias("text"))
    rows = texts.join(found, ["id_", "key"]).dropDuplicates(["id_", "key", "toxic", "check", "lang"])      # a table may repeat a row
    rows = rows.select("text", "key", "toxic", "lang", "copies", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "check")
    path = scratch_path(docs.sparkSession, "learn")
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("check", "shard", "key", "toxic", "lang").write.partitionBy("check").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def by_shard(batches: Iterator[pa.RecordBatch], model: TextCNN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, slots, bounds, labels) of columns shard, text, toxic. A shard comes in one piece unless it is far larger than SHARD_CHARS."""
    held, size, shard = [], 0, None

    def piece():
        ids, bounds = zip(*((p[0], p[1]) for p in held))
        return shard, np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(b) for b in bounds])))), np.concatenate([p[2] for p in held])
    for batch in small_batches(batches, 1):
        owners, texts, y = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(np.float32)
        edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and (owners[a] != shard or size > 4 * SHARD_CHARS):
                yield piece()
                held, size = [], 0
            shard = int(owners[a])
            held.append((*model.encode(texts[a:b]), y[a:b]))
            size += sum(map(len, texts[a:b]))
    if held:
        yield piece()


def slot_sums(rows: DataFrame, run, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``run`` makes (slot, whole numbers) of batches; their sums, exact in any order. At most one row per slot reaches the driver."""
    names = [f"v{i}" for i in range(width)]

    def numbers(batches):
        sums = run(batches)
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(sums[at, i]) for i in range(width))], names=["slot", *names])
    got = rows.mapInArrow(numbers, "slot int, " + ", ".join(f"{n} long" for n in names)).groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    return got["slot"].to_numpy(), np.stack([got[n].to_numpy() for n in names], 1)


def count_slots(rows: DataFrame, model: TextCNN) -> np.ndarray:
    def run(batches):
        seen = np.zeros((1 << model.bits, 2), np.int64)
        for _, ids, bounds, y in by_shard(batches, model):
            seen += model.texts_with(ids, bounds, y)
        return seen
    at, sums = slot_sums(rows, run, 2)
    seen = np.zeros((1 << model.bits, 2), np.int64)
    seen[at] = sums
    return seen


def train_round(rows: DataFrame, model: TextCNN, texts: int, turn: int, epochs: int) -> None:
    """Every shard trains a copy of the model on all its texts; the model moves by the mean of their moves, weighted by texts.

    Moves are summed as whole multiples of 1 / UNIT, so that the order in which tasks end does not change the model.
    """
    def run(batches):
        start = model.flat()
        total = np.zeros(start.shape, np.int64)
        for shard, ids, bounds, y in by_shard(batches, model):
            own = deepcopy(model)
            own.fit(ids, bounds, y, np.random.default_rng([model.seed, turn, shard]), epochs)
            total += np.rint((own.flat().astype(float) - start) * (len(y) * UNIT)).astype(np.int64)
        return total
    at, sums = slot_sums(rows, run, model.dim)
    model.move(at, sums / (UNIT * texts))


def calibrate_model(rows: DataFrame, model: TextCNN) -> None:
    """``TextCNN.calibrate`` on rows of a table: the scale from counts per label and logit (to 1 / CELLS), the cuts from all scores."""
    def run(batches):
        for batch in small_batches(batches, 0):
            z = model.logits(batch.column(0).to_pylist()).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(z, pa.float64())], names=[*batch.schema.names[1:], "z"])
    rows = rows.select("text", "lang", "toxic", "copies")
    z = stored(rows.mapInArrow(run, StructType(rows.schema.fields[1:]).add("z", DoubleType())), "logits")
    cells = z.groupBy("toxic", F.rint(F.expr(f"least(greatest(z, -50D), 50D) * {CELLS}")).alias("cell")).agg(F.sum("copies").alias("n")).orderBy("toxic", "cell").toArrow()
    model.fit_scale(cells["cell"].to_numpy() / CELLS, cells["toxic"].to_numpy(), cells["n"].to_numpy().astype(float))
    a, b = model.scale
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("z") * a + b, F.lit(30.0)), F.lit(-30.0))))
    number = lambda c: F.sum(F.when(c, F.col("copies")).otherwise(0))
    found = z.where("lang IS NOT NULL").withColumn("s", score).groupBy("lang").agg(
        number(F.col("toxic") == 0).alias("clean"), number(F.col("toxic") == 1).alias("toxic"), F.array(*(number((F.col("s") >= t) != (F.col("toxic") == 1)) for t in CUTS)).alias("wrong"))
    model.fit_thresholds({r["lang"]: (r["clean"], r["toxic"], r["wrong"]) for r in found.collect()})


def train_model(docs: DataFrame, labels: DataFrame, learn=None) -> TextCNN | None:
    """Fits on every labelled row that ``learn`` allows (an expression over ``labels``), a fifth of the texts for calibration.
    None where either label has no row with a text.

    The texts go to shards of about SHARD_CHARS characters. In each round the tasks train the model on every shard and the
    driver gets only the sum of their moves, one row per slot; a single shard has all its epochs in one round.
    """
    found = stored(labelled_texts(docs, labels, learn), "labelled")
    sides = {(r["check"], r["toxic"]) for r in found.select("check", "toxic").distinct().collect()}
    if len({y for _, y in sides}) < 2:
        return None
    split = len(sides) == 4                                     # else all is for training
    found = once(found, split)
    size = {r["toxic"]: r for r in found.where("NOT check").groupBy("toxic").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}
    clean, toxic = size[0]["texts"], size[1]["texts"]
    shards = max(1, round((size[0]["n"] + size[1]["n"]) / SHARD_CHARS))
    learned = store_shards(docs, found, shards)
    train = learned.where("NOT check").select("shard", "text", "toxic")
    model = TextCNN()
    model.forget_rare(count_slots(train, model), clean, toxic)
    rounds = 1 if shards == 1 else epochs(clean + toxic)
    for turn in range(rounds):
        train_round(train, model, clean + toxic, turn, epochs(clean + toxic) // rounds)
    if split:
        calibrate_model(learned.where("check"), model)
    return model


def toxicity(docs: DataFrame, model: TextCNN | None) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``rejected`` (score at or above its language's threshold, CUT where none is known).

    Every whole text is scored, null as empty; equal texts get equal scores. The model is about 2 MB and travels with the
    tasks. Without a model (no labels) every score is 0. An empty table gives no rows; other columns pass through.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, names.index("text")):
            texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            s = model.score(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "__score"])

    schema = StructType([*docs.schema.fields]).add("__score", DoubleType())
    scored = docs.mapInArrow(run, schema)
    known = (model.thresholds if model is not None else {}) if "lang" in names else {}
    cut = F.lit(CUT)
    if known:
        cut = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[F.col("lang")], cut)
    keep = [F.col(f"`{c}`") for c in names if c not in ("score", "rejected")]
    return scored.select(*keep, F.col("__score").alias("score"), (F.col("__score") >= cut).alias("rejected"))


def op8_toxicity_cnn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_model(docs.where(~held_out()), labels, learn=~held_out())
    scored = toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "rejected")
