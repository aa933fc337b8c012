"""Quality classifier: Bradley-Terry ranking of documents, learnt from pairs of a better and a worse one.

Each document has a score w.x of its features; the probability that one is
preferred to another is the logistic function of the difference of scores.  w
is fitted by Newton's method on the logistic loss over feature differences of
seeded random pairs, with an L2 penalty.  The threshold is a quantile of the
learning documents' scores: the share of worse ones among all of them.  Scores are
mapped to 0..1 by a logistic curve that passes through `cut` at the threshold
and whose slope is fitted on the learning labels, so score >= cut says that a
document is above the quantile.

All labelled documents that aren't held out take part, each in one pair or more:
they are dealt by the hash of their id to blocks of about BLOCK of either class,
the smaller class's rows to as many blocks as it takes for each block to have
both.  Pairs and features are rows of a table in the shared folder; executors sum
gradients, order statistics and the slope's terms, and the driver gets a row a
task.  Only a caller who gives `most_labels` has a fit on so many documents of
each class, those with the least hash of their id; for the quantile and the
slope each class counts then as much as it has labelled documents.

Scoring reads every whole text.  Features are shares of byte classes and of pairs of
neighbouring classes, lengths, repeated words and repeated lines.

Null and empty texts have a score: that of a text without content.  Labels that
are null are not used; several labels of a document are averaged and count as
better from 0.5 on.  With labels of one class only, or none, every score is 0.5.
Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, maybe_broadcast, small_batches, small_enough, split_batches, stored, tidy

CLASSES = 10
#: Learning documents of a class in a block, on average.
BLOCK = 4096
#: A fit has at least so many pairs; fewer documents are in more pairs each.
PAIRS = 40_000


def byte_classes() -> np.ndarray:
    """The class of each byte: lower-case letters and bytes beyond ASCII, upper case, digits, space, newline, sentence marks, other marks of prose, rare marks, symbols, control."""
    kind = np.full(256, 9, dtype=np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,?", b"'\"()-:;", b"!|", b"#$%&*+/<=>@[\\]^_`{}~")):
        kind[list(chars)] = k
    kind[128:] = 0
    return kind


N_FEATURES = CLASSES + CLASSES**2 + 8


def features(texts: list[str | None]) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    kind = byte_classes()
    x = np.zeros((len(texts), N_FEATURES))
    for k, text in enumerate(texts):
        if not text:
            continue
        c = kind[np.frombuffer(text.encode(), np.uint8)]
        words, lines = text.split(), [s for s in text.split("\n") if s.strip()]
        n = max(len(words), 1)
        x[k, :CLASSES] = np.bincount(c, minlength=CLASSES) / len(c)
        x[k, CLASSES : CLASSES + CLASSES**2] = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES**2) / len(c)
        x[k, -8:] = (
            len(c) / n / 10,
            sum(map(eq, words, words[1:])) / n,
            len(set(words)) / n,
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(len(c)) / 10,
            np.log1p(len(words)) / 10,
            np.log1p(len(c) / max(len(lines), 1)) / 10,
            1.0,
        )
    return np.sqrt(x)  # a small share of a rare class counts


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Ranking:
    """A fitted model; weights None: no classes to tell apart."""

    weights: np.ndarray | None
    threshold: float = 0.0
    slope: float = 1.0
    cut: float = 0.3

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        raw = features(texts) @ self.weights
        return logistic(self.slope * (raw - self.threshold) + np.log(self.cut / (1 - self.cut)))


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """np.quantile of values each of which stands weights times, but for what lies between two neighbours."""
    order = np.argsort(values, kind="stable")
    before = np.cumsum(weights[order]) - weights[order]
    last = weights.sum() - weights[order[-1]]
    return float(np.interp(share, before / last, values[order])) if last > 0 else float(values[order[-1]])


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of N_FEATURES numbers from an array of their bytes."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.float32, len(column) * N_FEATURES, first).reshape(-1, N_FEATURES).astype(np.float64)


def as_bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())


def paired(better: np.ndarray, worse: np.ndarray, rounds: int, seed: list[int]) -> np.ndarray:
    """Differences of pairs in which each row of either side is at least `rounds` times."""
    rng = np.random.default_rng(seed)
    n = max(len(better), len(worse))
    better, worse = rng.permutation(better), rng.permutation(worse)
    at = np.arange(n)
    shifts = [0, *rng.integers(0, n, rounds - 1).tolist()]
    return np.concatenate([better[at % len(better)] - worse[(at + k) % len(worse)] for k in shifts])


def dealt(rows: DataFrame, worse: int, better: int, rounds: int, seed: int) -> DataFrame:
    """(pair, good, x) of rows (key, good, mark, x): a row for each document and one for each pair; of rows that repeat a key that with the least mark serves."""
    blocks = {False: -(-worse // BLOCK), True: -(-better // BLOCK)}
    most = max(blocks.values())
    kinds = F.when(F.col("good"), F.lit(blocks[True])).otherwise(F.lit(blocks[False])).cast("long")
    own = F.pmod(F.xxhash64("key"), kinds)
    spread = rows.withColumn("block", F.explode(F.sequence(own, F.lit(most - 1).cast("long"), kinds)))
    ordered = spread.select("block", "good", "key", "mark", "x").repartition("block").sortWithinPartitions("block", "good", "key", "mark")

    def out(block: int, held: list):
        x, good = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        for kind in (False, True):
            if block < blocks[kind]:  # later blocks have copies of the smaller class
                some = x[good == kind]
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(some)), pa.array([kind] * len(some)), as_bytes(some)], ["pair", "good", "x"])
        d = paired(x[good], x[~good], rounds, [seed, block])
        for k in range(0, len(d), BLOCK):
            some = d[k : k + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(some)), pa.array([True] * len(some)), as_bytes(some)], ["pair", "good", "x"])

    def run(batches):
        at, held, last = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, keys = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            fresh = np.array([k != j for k, j in zip(keys, [last, *keys[:-1]], strict=True)])
            fresh[1:] |= block[1:] != block[:-1]
            fresh[0] |= block[0] != at
            last = keys[-1]
            x, good = vectors(batch.column(4)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if block[a] != at and held:
                    yield from out(at, held)
                    held = []
                at = int(block[a])
                held.append((x[a:b][fresh[a:b]], good[a:b][fresh[a:b]]))
        if held:
            yield from out(at, held)

    return ordered.mapInArrow(tidy(run), "pair boolean, good boolean, x binary")


def summed(rows: DataFrame, of) -> list[np.ndarray]:
    """What `of`, a function of a batch's vectors, gives for a list of arrays, summed by executors; a row a task comes here."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(vectors(batch.column(0)))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a, np.float64).tobytes()], pa.binary()) for a in total], [f"s{k}" for k in range(len(total))])

    names = ["s0", "s1"]
    parts = rows.select("x").mapInArrow(tidy(run), ", ".join(f"{c} binary" for c in names)).collect()
    return [np.sum([np.frombuffer(r[c], np.float64) for r in parts], axis=0) for c in names]


def fitted_weights(table: DataFrame, documents: int, pairs: int, penalty: float = 1.0) -> np.ndarray:
    """The weights by Newton's method over all pairs of a table of dealt rows."""
    rows, differences = table.where("not pair"), table.where("pair")
    mean = summed(rows, lambda x: [x.sum(axis=0), np.zeros(1)])[0] / documents
    scale = np.sqrt(summed(rows, lambda x: [((x - mean) ** 2).sum(axis=0), np.zeros(1)])[0] / documents)
    scale[scale < 1e-7] = np.inf  # a constant feature has no weight
    penalty *= max(1.0, pairs / PAIRS)  # as strong for a pair in a large table
    w = np.zeros(N_FEATURES)
    for _ in range(12):

        def terms(x, w=w):
            d = x / scale
            p = logistic(d @ w)
            return [d.T @ (p - 1), ((d * (p * (1 - p) + 1e-9)[:, None]).T @ d).reshape(-1)]

        gradient, hessian = summed(differences, terms)
        step = np.linalg.solve(hessian.reshape(N_FEATURES, -1) + penalty * np.eye(N_FEATURES), gradient + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def ranked(raw: DataFrame, rank: int) -> float:
    """The value of column raw with `rank` values before it in order: bins of the range that has it are counted until it holds one value."""
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    while low < high:
        place = F.least(F.floor((F.col("raw") - low) / (high - low) * 4096), F.lit(4095))
        for r in sorted(raw.where(F.col("raw").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).collect()):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
    return low


def quantile(raw: DataFrame, n: int, share: float) -> float:
    """np.quantile of column raw, which has n rows."""
    place = share * (n - 1)
    rank = min(int(place), n - 1)
    at = ranked(raw, rank)
    upto, above = raw.agg(F.count(F.when(F.col("raw") <= at, 1)), F.min(F.when(F.col("raw") > at, F.col("raw")))).first()
    return at if upto > rank + 1 or above is None else at + (above - at) * (place - rank)


def fitted_slope(raw: DataFrame, t: float, cut: float, weights: tuple[float, float]) -> float:
    """The slope of the logistic curve through cut at t, by Newton's method over all rows (raw, good)."""
    slope, offset = 1.0, float(np.log(cut / (1 - cut)))
    good, z = F.col("good").cast("double"), F.col("raw") - t
    weight = F.when(F.col("good"), F.lit(weights[1])).otherwise(F.lit(weights[0]))
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.least(F.greatest(z * slope + offset, F.lit(-500.0)), F.lit(500.0))))
        first, second = raw.agg(F.sum(weight * (p - good) * z), F.sum(weight * p * (1 - p) * z * z)).first()
        before, slope = slope, min(max(slope - float(np.clip(first / (second + 1e-6), -1, 1)), 0.05), 50.0)
        if abs(slope - before) < 1e-9 * slope:
            break
    return slope


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labels: int | None = None, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Ranking:
    """The ranking learnt from all labelled documents that aren't held out; from at most most_labels of each class only if that is given."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("key")).agg((F.avg(label_col) >= 0.5).alias("good"))
    # a label without a document is none of the learning documents
    known = stored(known.join(docs.select(F.col(id_col).alias("key")), "key", "left_semi"), "labelled")
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Ranking(None, cut=cut)
    used = dict(counts)
    if most_labels is not None:
        order = [F.xxhash64("key"), F.col("key")]
        known = stored(known.where("good").orderBy(*order).limit(most_labels).unionAll(known.where("not good").orderBy(*order).limit(most_labels)), "labelled")
        used = {k: min(n, most_labels) for k, n in counts.items()}

    def run(batches):
        for batch in split_batches(batches, "text"):
            texts = batch.column(1).to_pylist()
            marks = [xxhash.xxh3_64_intdigest((t or "").encode()) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), as_bytes(features(texts))], ["key", "mark", "x"])

    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    if small_enough(known, 24):  # else features are shuffled, which are smaller than texts
        texts = texts.join(F.broadcast(known.select("key")), "key", "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(tidy(run), f"key {kind}, mark long, x binary").join(maybe_broadcast(known, 24), "key")
    rounds = -(-PAIRS // max(used.values()))
    table = stored(dealt(rows, used[False], used[True], rounds, seed), "learning")
    w = fitted_weights(table, sum(used.values()), table.where("pair").count())

    def run_raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors(batch.column(1)) @ w)], ["good", "raw"])

    raw = stored(table.where("not pair").select("good", "x").mapInArrow(tidy(run_raw), "good boolean, raw double"), "raw")
    share, weights = counts[False] / sum(counts.values()), tuple(counts[k] / used[k] for k in (False, True))
    if most_labels is None:
        t = quantile(raw, sum(used.values()), share)
    else:
        some = raw.toPandas()
        t = weighted_quantile(some["raw"].to_numpy(), np.where(some["good"].to_numpy(dtype=bool), weights[1], weights[0]), share)
    slope = fitted_slope(raw, t, cut, weights)
    for df in (known, table, raw):
        discard(df)
    return Ranking(w, t, float(slope), cut)


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, score (0 to 1), predicted (1 if score >= the model's cut)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in split_batches(batches, text_col):
            s = m.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= m.cut).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the model's cut, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in split_batches(batches, text_col):
            yield batch.filter(pa.array(m.scores(batch.column(place).to_pylist()) >= m.cut))

    return docs.mapInArrow(tidy(run), docs.schema)
