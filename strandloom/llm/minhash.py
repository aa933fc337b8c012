"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, verification.

A document's shingles are its runs of five words (all its words, if fewer),
weighted by how often they occur.  Each shingle is the source of a Poisson
process whose rate is its weight: arrivals come at exponential distances, each
at a random register, both drawn from the shingle's hash.  A register keeps the
shingle that arrives first; arrivals later than the latest register's stop a
process early.  Two documents agree in a register with the probability that is
their probability Jaccard similarity.

Texts with the same words are one node, so copies cost nothing more; bands of
registers are buckets of candidates (see near_groups); candidates are verified
over whole texts: they are linked if the probability Jaccard similarity of
their weighted shingles, or the Jaccard similarity of the plain ones, is at
least `similarity`.  A class is a connected component.
Both criteria have candidates: a text that repeats shingles has a second
signature with all weights 1, whose bands are buckets beside those of the first
(for other texts the two are the same), and a pair is gated by the nearer of its
two sketches.

Words: lower-cased runs of digits, letters a-z and characters beyond ASCII.
Documents without words (null, empty, or marks only) are classes of their own.
Rows that share a doc_id are one document: the classes of its texts are joined.
Rows with a null doc_id have a null class and are not compared.  Empty tables
are fine; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import maybe_broadcast, small_batches, split_batches, stored, tidy
from strandloom.llm.near_groups import Joined, labelled, near_classes, with_centres

SHINGLE = 5
#: Bands and registers in each.  A pair of similarity 0.8 shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Registers' bits, 64 in each of two words, in which a pair that is to be verified may differ: at similarity 0.8 5 deviations above the mean.
MOST_BITS = 31
#: Texts handled at a time; their number stands above a shingle's hash.
TEXTS, HASH_BITS = 1000, 52
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(NORMAL).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_shingles(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash of HASH_BITS bits, weight) of the distinct shingles of at most 4096 lists of words, sorted."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join([h for w in texts for h in map(xxhash.xxh3_64_digest, w)]), ">u8").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    who = np.repeat(np.arange(len(texts)), sizes)
    n = np.maximum(len(flat) - SHINGLE + 1, 0)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        s = mixed(s + flat[k : n + k] + np.uint64(0x9E3779B97F4A7C15))
    whole = np.arange(n) - starts[who[:n]] + SHINGLE <= sizes[who[:n]]
    keys = (who[:n][whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (s[whole] >> np.uint64(64 - HASH_BITS))
    few = []
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        h = xxhash.xxh3_64_intdigest(b" ".join(texts[i])) >> (64 - HASH_BITS)
        few.append(i << HASH_BITS | h)
    keys = np.sort(np.concatenate([keys, np.array(few, dtype=np.uint64)]))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), weight


def signatures(count: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures of `count` documents; a document without shingles has zeros."""
    arrival = np.full(count * registers, np.inf)
    kept = np.zeros(count * registers, dtype=np.uint64)
    per_doc = np.bincount(doc, minlength=count)
    alone = per_doc[doc] == 1
    kept.reshape(count, registers)[doc[alone]] = mixed(shingle[alone])[:, None]  # all arrivals are its own
    doc, name, rate = doc[~alone], mixed(shingle[~alone]), weight[~alone].astype(np.float64)
    state, time = name, np.zeros(len(doc))
    while len(doc):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mixed(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        latest = arrival.reshape(count, registers).max(axis=1)
        going = time < latest[doc]
        if not going.all():
            doc, name, rate, state, time, draw = (x[going] for x in (doc, name, rate, state, time, draw))
            if not len(doc):
                break
        place = doc * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, place, time)
        won = arrival[place] == time
        kept[place[won]] = name[won]
    return kept.reshape(count, registers)


def banded(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, sketch of two words) of each signature."""
    bands = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        bands = mixed(bands + sig[:, k::ROWS][:, :BANDS] + np.uint64(0x9E3779B97F4A7C15))
    bands = mixed(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
    bits = np.zeros((len(sig), 128), dtype=np.uint8)
    bits[:, :REGISTERS] = (mixed(sig) >> np.uint64(63)).astype(np.uint8)
    return bands.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def signed(doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    words = [words_of(t) for t in texts]
    n = len(words)
    doc, shingle, weight = weighted_shingles(words)
    bands, sketch = banded(signatures(n, doc, shingle, weight))
    # texts that repeat shingles have a signature without weights, too
    repeats = np.unique(doc[weight > 1])
    own = np.isin(doc, repeats)
    plain, plain_sketch = banded(signatures(len(repeats), np.searchsorted(repeats, doc[own]), shingle[own], np.ones(int(own.sum()), np.int64)))
    sketches = np.concatenate([sketch, sketch], axis=1)
    sketches[repeats, 2:] = plain_sketch
    ends = np.full(n, BANDS)
    ends[repeats] = 2 * BANDS
    ends = np.concatenate([[0], np.cumsum(ends)])
    keys = np.empty(ends[-1], dtype=np.int64)
    at = ends[:-1, None] + np.arange(BANDS)
    keys[at] = bands
    keys[at[repeats] + BANDS] = plain
    prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), dtype=np.int64).reshape(-1, 2)
    empty = np.array([not w for w in words], dtype=bool)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
    fours = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), pa.array(sketches.reshape(-1)))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(prints[:, 0], mask=empty), pa.array(prints[:, 1], mask=empty), lists, fours], ["doc_id", "f1", "f2", "bands", "sketch"])


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard similarity of two sorted (hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(both)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / union
    if a[1].max() == 1 and b[1].max() == 1:
        return plain, plain
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    rest_x, rest_y = float(a[1].sum()) - x.sum(), float(b[1].sum()) - y.sum()
    kinds, count = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), n in zip(kinds.T, count, strict=True):
        total += n / (np.maximum(kinds[0] / p, kinds[1] / q) @ count + rest_x / p + rest_y / q)
    return float(total), plain


def linked(batches, similarity: float):
    """Of batches (a, b, text of a, text of b), the pairs (a, b) that are similar enough."""
    for big in split_batches(batches, "a_text"):
        for at in range(0, len(big), TEXTS):
            batch = big.slice(at, TEXTS)
            words = [words_of(t) for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for t in pair]
            doc, shingle, weight = weighted_shingles(words)
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            one = lambda k: (shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]])  # noqa: B023, E731
            keep = [max(similarities(one(2 * k), one(2 * k + 1))) >= similarity for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def connecting(table: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) that join the classes of a group (id, class, text) as all links between its members would."""
    ids, classes = table["id"].to_pylist(), table["class"].to_pylist()
    joined, a, b = Joined(classes), [], []
    words = [words_of(t) for t in table["text"].to_pylist()]
    doc, shingle, weight = weighted_shingles(words)
    n = len(words)
    size = np.bincount(doc, minlength=n)
    total = np.bincount(doc, weights=weight, minlength=n)
    repeats = np.zeros(n, dtype=bool)
    repeats[doc[weight > 1]] = True
    # shared shingles, and the sum of roots of products of probabilities, which the probability similarity can't exceed
    both, roots = np.zeros((n, n), dtype=np.float32), np.zeros((n, n), dtype=np.float32)
    kinds, column, uses = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(uses[column] > 1)
    order = shared[np.argsort(column[shared], kind="stable")]
    place = np.searchsorted(np.unique(column[order]), column[order])
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        cut = slice(*np.searchsorted(place, [low, low + 4096]))
        x = np.zeros((n, 4096), dtype=np.float32)
        x[doc[order[cut]], place[cut] - low] = 1
        both += x @ x.T
        if repeats.any():
            x[doc[order[cut]], place[cut] - low] = np.sqrt(weight[order[cut]] / total[doc[order[cut]]])
            roots += x @ x.T
    plain = both / np.maximum(size[:, None] + size[None] - both, 1)
    maybe = (plain >= similarity) | ((repeats[:, None] | repeats[None]) & (roots >= similarity - 1e-3))
    group = np.array(classes)
    cut = np.searchsorted(doc, np.arange(n + 1))
    one = lambda k: (shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]])
    for i, j in np.argwhere(np.triu(maybe & (group[:, None] != group[None]), 1)).tolist():
        if joined.root(i) != joined.root(j) and max(similarities(one(i), one(j))) >= similarity:
            joined.join(i, j)
            a.append(min(ids[i], ids[j]))
            b.append(max(ids[i], ids[j]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def document_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id and class_id, the least id of its class."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for big in split_batches(batches, "text"):
            for at in range(0, len(big), TEXTS):
                batch = big.slice(at, TEXTS)
                yield signed(batch.column(0), batch.column(1).to_pylist())

    every = stored(source.mapInArrow(tidy(run), "doc_id long, f1 long, f2 long, bands array<long>, sketch array<long>"), "signatures")
    known = every.where("doc_id is not null and f1 is not null")
    nodes = stored(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("id")), "texts")
    own = known.join(nodes.withColumnRenamed("id", "doc_id"), ["f1", "f2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "id")
    repeated = bool(known.groupBy("doc_id").count().where("count > 1").take(1))
    own = stored(own.dropDuplicates(["f1", "f2"]) if repeated else own, "nodes")

    def texts_of(ids: DataFrame) -> DataFrame:
        texts = source.join(maybe_broadcast(stored(ids.distinct(), "wanted"), 16), "doc_id", "left_semi")
        return stored(texts.distinct() if repeated else texts, "wanted-texts")

    def within(rows: DataFrame) -> DataFrame:
        texts = texts_of(rows.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")
        return rows.join(texts, "id").groupBy("key", "part").applyInArrow(lambda t: connecting(t, similarity), "a long, b long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))))
        told = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))
        side = pairs.join(told("a"), "a").join(told("b"), "b").select("a", "b", "a_text", "b_text")
        return side.mapInArrow(tidy(lambda batches: linked(batches, similarity)), "a long, b long").distinct()

    def near(x: str, y: str):
        apart = lambda k: F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) + F.bit_count(F.col(x)[k + 1].bitwiseXOR(F.col(y)[k + 1]))
        return F.least(apart(0), apart(2)) <= MOST_BITS

    given = None
    if repeated:  # texts of one doc_id are one document
        placed = known.join(nodes, ["f1", "f2"]).select("doc_id", F.col("id").alias("b")).distinct()
        given = placed.join(placed.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a <> b").select("a", "b")
    inside = with_centres(own.select(F.explode(F.array_distinct("bands")).alias("key"), "id"))
    sketch = lambda name: own.select(F.col("id").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    inside = inside.join(sketch("id"), "id").join(sketch("centre"), "centre").select("key", "id", "centre", near("id_sketch", "centre_sketch").alias("near"))
    classes = near_classes(stored(inside, "buckets"), verify, within, given)
    placed = labelled(nodes, classes, "id").select("f1", "f2", "id_class")
    found = every.select("doc_id", "f1", "f2").join(placed, ["f1", "f2"], "left")
    return found.select(F.col("doc_id").alias(id_col), F.when(F.col("doc_id").isNotNull(), F.coalesce("id_class", "doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their classes (the least id), with their columns; rows with a null id stay.

    Of rows that repeat an id one stays.
    """
    classes = document_classes(docs, similarity, id_col, text_col)
    gone = stored(classes.where(F.col(id_col) != F.col("class_id")).select(id_col).distinct(), "dropped")
    kept = docs.join(maybe_broadcast(gone, 16), id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if twice.take(1):
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionAll(kept.where(F.col(id_col).isNull()))
    return kept
