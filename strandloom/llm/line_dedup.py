"""Deduplication of lines, exact and fuzzy: SimHash, pigeonhole blocks, edit similarity, one line of each group kept.

Lines are normalised: lower-cased, digits as 0, marks and white space as single
spaces.  Equal normalised lines are one node.  A line of at least `least_words`
words has a 64-bit SimHash of its distinct words, so that the words a language
repeats don't make its lines alike.  Two SimHashes that differ in at most
MOST_BITS bits agree in all but MOST_BITS of any blocks they are cut into, so
lines are joined on every choice of that many blocks; there are so many blocks
that unlike lines seldom meet, which changes the cost, never the result.

One changed word of an ordinary line flips more bits than that.  So if `reach`,
the bits in which linked lines may differ, is more than MOST_BITS, the blocks
are made of the words of which the SimHash is made (WORD_BLOCKS): a line's
distinct words are dealt by hash to so many blocks, and lines that differ in few
words have the same words in at least one.  A block of fewer words than its
class asks for is no key, since unlike lines share it too often.  Short lines
have a key for all words but each one as well, so any two that differ by one
changed, added or missing word meet.  Recall against all pairs is in the README.

Pairs that met and are within `reach` are linked if the edit similarity of the
normalised lines, 1 - distance / longer length, is at least `similarity`;
classes are connected components (see near_groups).  Of each class the
occurrence with the least (doc_id, line number) stays, in place and unchanged;
the others are removed.

Lines without words (empty, or marks only) are never removed.  Null and empty
texts stay as they are.  Rows with a null doc_id are not compared and stay as
they are; rows that share a doc_id are taken for one another's copies, and lose
the same lines by number.  Empty tables are fine.  Columns of docs are kept, and
the operator's own replace those of the same name.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import maybe_broadcast, small_batches, split_batches, stored, tidy
from strandloom.llm.near_groups import Joined, labelled, near_classes

#: Bits in which SimHashes may differ that blocks of bits bring together without loss.
MOST_BITS = 3
#: Bits in which SimHashes of lines of edit similarity 0.8 may differ: 99.9 % of the pairs, unlike lines seldom.
REACH = 16
#: (distinct words below which a line is of this class, blocks, words a block must have to be a key).
WORD_BLOCKS = ((11, 4, 2), (25, 6, 2), (50, 8, 3), (100, 12, 4), (1 << 62, 16, 4))
#: Lines of fewer distinct words than this have keys of all words but one, too.
SHORT = 11
#: Lines of a bucket on either side of a group whose SimHashes are compared, on average.
LINES = 16_384
LINE_NORMAL = bytes(48 if 48 <= b <= 57 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


#: The same with lines left apart.
TEXT_NORMAL = LINE_NORMAL[:10] + b"\n" + LINE_NORMAL[11:]


def line_words(line: str) -> list[bytes]:
    return line.lower().encode().translate(LINE_NORMAL).split()


def normal_line(line: str) -> bytes:
    return b" ".join(line_words(line))


def hashed(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each line, the words' hashes as bytes one after another)."""
    return np.array([len(w) for w in lines], dtype=np.int64), np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(lines))), np.uint8).reshape(-1, 8)


#: The secret of XXH3 as far as words of up to 16 bytes use it, as 64-bit numbers.
SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"), "<u8")


def folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The halves of 128-bit products, combined by exclusive or."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    ll, hl, lh, hh = (x & low) * (y & low), (x >> half) * (y & low), (x & low) * (y >> half), (x >> half) * (y >> half)
    cross = (ll >> half) + (hl & low) + lh
    return ((hl >> half) + (cross >> half) + hh) ^ ((cross << half) | (ll & low))


def word_hashes(data: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash.xxh3_64 of each range of data, of numbers at once; the library's for ranges of more than 16 bytes."""
    u = np.uint64
    a = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(a, 8)
    read = lambda at: np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
    rolled = lambda h, k: (h << u(k)) | (h >> u(64 - k))
    out = np.zeros(len(starts), np.uint64)
    if len(k := np.flatnonzero(size <= 3)):
        at, n = starts[k], size[k]
        h = a[at].astype(u) << u(16) | a[at + n // 2].astype(u) << u(24) | a[at + n - 1].astype(u) | n.astype(u) << u(8)
        h ^= (SECRET[0] ^ (SECRET[0] >> u(32))) & u(0xFFFFFFFF)
        h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
        out[k] = h ^ (h >> u(32))
    if len(k := np.flatnonzero((size > 3) & (size <= 8))):
        at, n = starts[k], size[k]
        low = u(0xFFFFFFFF)
        h = ((read(at + n - 4) & low) + ((read(at) & low) << u(32))) ^ (SECRET[1] ^ SECRET[2])
        h = (h ^ rolled(h, 49) ^ rolled(h, 24)) * u(0x9FB21C651E98DF25)
        h = (h ^ ((h >> u(35)) + n.astype(u))) * u(0x9FB21C651E98DF25)
        out[k] = h ^ (h >> u(28))
    if len(k := np.flatnonzero((size > 8) & (size <= 16))):
        at, n = starts[k], size[k]
        x, y = read(at) ^ (SECRET[3] ^ SECRET[4]), read(at + n - 8) ^ (SECRET[5] ^ SECRET[6])
        h = n.astype(u) + x.byteswap() + y + folded(x, y)
        h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
        out[k] = h ^ (h >> u(32))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + size[k]])
    return out


def normal_lines(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(normalised line, number of its text, number in the text, number of words) of each line with words, and its distinct words as `hashed` gives them."""
    parts = [t.lower().encode().translate(TEXT_NORMAL) for t in texts]
    data = b"\n".join(parts)
    a = np.frombuffer(data, np.uint8)
    inside = a > 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    lines_in = np.array([x.count(b"\n") + 1 for x in parts], dtype=np.int64)
    line = np.searchsorted(np.flatnonzero(a == 10), starts)
    words = np.bincount(line, minlength=int(lines_in.sum()))
    some = np.flatnonzero(words)
    text = np.repeat(np.arange(len(parts)), lines_in)
    number = np.arange(len(words)) - np.repeat(np.cumsum(lines_in) - lines_in, lines_in)
    # one byte, a space, stays between words of a line
    keep = inside.copy()
    keep[ends[:-1][line[1:] == line[:-1]]] = True
    compact = a[keep].tobytes()
    upto = np.cumsum(np.bincount(line, ends - starts, len(words)).astype(np.int64)[some] + words[some] - 1).tolist()
    normal = [compact[x:y] for x, y in zip([0, *upto], upto, strict=False)]
    h = word_hashes(data, starts, ends - starts)
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[fresh], line[fresh]
    return normal, text[some], number[some], words[some], (np.bincount(line, minlength=len(words))[some], h)


def parts_of(size: np.ndarray, most: int = 20_000):
    """Ranges of lines with some thousands of words in all; a long line stands alone."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def simhashes(lines: list, hashes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The SimHash of each list of words: bit k is set if more than half of the words' hashes have it."""
    sizes, flat = hashes or hashed(lines)
    out, first = np.zeros(len(lines), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for at, end in parts_of(sizes):
        size, words = sizes[at:end], flat[first[at] : first[end]]
        if not len(words):
            continue
        bits = np.unpackbits(words, axis=1).view(np.uint64)  # each bit as a byte
        starts = np.cumsum(size) - size
        cuts = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts.tolist(), size.tolist(), strict=True) if n]) if size.max() > 255 else starts[size > 0]
        sums = np.add.reduceat(bits, cuts, axis=0).view(np.uint8)  # bytes count to 255
        total = np.zeros((len(size), 64), dtype=np.int64)
        if size.max() > 255:
            np.add.at(total, np.searchsorted(np.cumsum(size), cuts, side="right"), sums.astype(np.int64))
        else:
            total[size > 0] = sums
        out[at:end] = np.packbits(2 * total > size[:, None], axis=1).view(">i8")[:, 0]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_blocks(lines: list, hashes: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Array:
    """Of each line of distinct words, the keys of its blocks of words.

    The class depends on the number of words; lines near such a bound have the
    keys of both sides, so that those of 4 to 5 in words share one.
    """
    sizes, flat = hashes or hashed(lines)
    flat = mixed(flat.view(np.uint64).reshape(-1) * np.uint64(0xC2B2AE3D27D4EB4F))
    tops, blocks, least = (np.array(x) for x in zip(*WORD_BLOCKS, strict=True))
    most = int(blocks.max())
    first = np.concatenate([[0], np.cumsum(sizes)])
    out, ends = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for at, end in parts_of(sizes, 200_000):
        size, words = sizes[at:end], flat[first[at] : first[end]]
        owner = np.repeat(np.arange(end - at), size)
        halves = (words >> np.uint64(32)).astype(np.float64), (words & np.uint64(0xFFFFFFFF)).astype(np.float64)
        chance = (words >> np.uint64(40)).astype(np.int64)
        keys, owners, before = [], [], np.full(end - at, -1)
        # classes that the number of words lies in, and those beside it
        for factor in (0.89, 1.0, 1.125):
            kind = np.searchsorted(tops, size * factor, side="right")
            own = np.flatnonzero((kind != before)[owner])  # a class that the line has had gives nothing new
            before, of = kind, owner[own]
            place = of * most + chance[own] % blocks[kind[of]]
            length = (end - at) * most
            count = np.bincount(place, minlength=length)
            cut = np.flatnonzero(count)
            line, count = cut // most, count[cut]
            fine = count >= least[kind[line]]
            # sums of halves of the hashes, exact as floats up to 2^21 words
            high, low = (np.bincount(place, x[own], length)[cut].astype(np.uint64) for x in halves)
            total = high * np.uint64(0x9E3779B97F4A7C15) ^ low
            salt = (kind[line] * most + cut % most + 1).astype(np.uint64)
            keys.append(mixed(mixed(total) + salt * np.uint64(0x9E3779B97F4A7C15))[fine])
            owners.append(line[fine])
        short = np.flatnonzero((size * 0.89 < SHORT) & (size > 0))
        if len(short):
            total = np.zeros(end - at, np.uint64)
            cut = np.flatnonzero(size)
            total[cut] = np.add.reduceat(words, (np.cumsum(size) - size)[cut])
            some = np.flatnonzero((size * 0.89 < SHORT)[owner])
            keys += [mixed(total[short]), mixed(total[owner[some]] - words[some])]
            owners += [short, owner[some]]
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        out.append(keys[order])
        ends.append(ends[-1][-1] + np.cumsum(np.bincount(owners, minlength=end - at)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))


def triples(x: str) -> np.ndarray:
    """How many runs of three characters have each of 2,048 hashes."""
    c = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    return np.bincount((c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) & np.uint32(2047), minlength=2048)


def most_equal(n: int, equal) -> int:
    """The largest k up to n whose range 0 to k is equal, by halving; equal tells it of any range i to j."""
    low = 0
    while low < n:
        half = (low + n + 1) // 2
        if equal(low, half):
            low = half
        else:
            n = half - 1
    return low


def edit_similarity(a: bytes, b: bytes, least: float = 0.0) -> float:
    """1 - Levenshtein distance / longer length, of characters; 0.0 if it is found to be below `least` on the way."""
    if a == b:
        return 1.0
    x, y = a.decode(), b.decode()
    longer = max(len(x), len(y))
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > allowed:
        return 0.0
    n = min(len(x), len(y))
    k = most_equal(n, lambda i, j: x[i:j] == y[i:j])
    e = most_equal(n - k, lambda i, j: x[len(x) - j : len(x) - i] == y[len(y) - j : len(y) - i])
    x, y = x[k : len(x) - e], y[k : len(y) - e]
    if not x or not y:
        return 1 - max(len(x), len(y)) / longer
    # an edit changes three runs of three characters at most; hashes that collide only make more of them seem shared
    shared = max(len(x), len(y)) - 2 - 3 * allowed
    if shared > 0 and np.minimum(triples(x), triples(y)).sum() < shared:
        return 0.0
    # bit-parallel rows of the distance table (Myers): plus and minus hold where neighbours differ by +1 and -1
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    plus, minus, distance = full, 0, len(x)
    for left, c in zip(range(len(y) - 1, -1, -1), y, strict=True):
        eq = where.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - left > allowed:  # each character that is left takes one off at most
            return 0.0
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
    return 1 - distance / longer


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether the edit similarity is at least `least`; known at once where as many words stand and the differing ones are short."""
    x, y = a.split(), b.split()
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v) <= int((1 - least) * max(len(a.decode()), len(b.decode())) + 1e-9):
        return True
    return edit_similarity(a, b, least) >= least


def lines_of(docs: DataFrame, least_words: int, by_words: bool = False) -> DataFrame:
    """(doc_id, line_no, f1, f2, simhash, blocks) of each line with words; simhash is null for short ones, blocks are the keys by words, if asked for."""

    def run(batches):
        for batch in split_batches(batches, "text", 1 << 20):
            kept = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
            normal, text, numbers, words, (sizes, flat) = normal_lines([t for _, t in kept])
            owners = np.array([i for i, _ in kept], dtype=np.int64)[text]
            prints = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, normal)), np.int64).reshape(-1, 2)
            short = words < least_words
            flat = flat[np.repeat(~short, sizes)].byteswap().view(np.uint8).reshape(-1, 8)
            sizes = np.where(short, 0, sizes)
            compared, hashes = range(len(words)), (sizes, flat)
            blocks = word_blocks(compared, hashes) if by_words else pa.array([()] * len(words), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(numbers, pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(simhashes(compared, hashes), mask=short), blocks], ["doc_id", "line_no", "f1", "f2", "simhash", "blocks"])

    return docs.where("doc_id is not null").mapInArrow(tidy(run), "doc_id long, line_no int, f1 long, f2 long, simhash long, blocks array<long>")


def block_keys(simhash, lines: int):
    """The keys of a SimHash: one for each choice of blocks that stay equal, with so many blocks that unlike lines seldom meet.

    b blocks of 64/b bits, b - MOST_BITS of them equal: lines meet by chance in
    one of 2^(64 (b - MOST_BITS) / b) values.
    """
    b = MOST_BITS + 1
    while b < 12 and lines > 4 * 2 ** (64 * (b - MOST_BITS) / b):
        b += 1
    edges = [64 * k // b for k in range(b + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(b), b - MOST_BITS)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(simhash.bitwiseAND(F.lit(mask).cast("long")), F.lit(k)))
    return F.array(*keys)


def gathered(batches, reach: int):
    """Of rows (key, id, simhash) in order of (key, id), buckets (key, id, centre, near, simhash): members beside the least id.

    Keys of one row give nothing, nor do keys of two that are not near.
    """
    out = ["key", "id", "centre", "near", "simhash"]
    none = np.zeros((3, 0), dtype=np.int64)
    centre, held, begun = none, none, 0  # of the bucket that goes on: its first row, its second one if that waits for a third, its rows so far

    def rows(now, head, size):
        near = np.bitwise_count((now[2] ^ head[2]).view(np.uint64)) <= reach
        keep = (now[1] != head[1]) & ((size > 2) | near)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (now[0], now[1], head[1], near, now[2])], out)

    for batch in batches:
        new = np.stack([batch.column(c).to_numpy() for c in ("key", "id", "simhash")])
        if not new.shape[1]:
            continue
        now = np.concatenate([centre, held, new], axis=1)
        first = np.flatnonzero(np.concatenate([[True], now[0, 1:] != now[0, :-1]]))
        length = np.diff(np.append(first, now.shape[1]))
        bucket = np.repeat(np.arange(len(first)), length)
        if begun > 2:
            length[0] = max(length[0], 3)
        begun, last = int(length[-1]), first[-1]
        upto = now.shape[1] if begun > 2 else last
        yield rows(now[:, :upto], now[:, first[bucket[:upto]]], length[bucket[:upto]])
        centre, held = now[:, last : last + 1], now[:, last + 1 : last + 2] if begun == 2 else none
    if held.shape[1]:
        yield rows(held, centre, np.array([2]))


def line_buckets(nodes: DataFrame, reach: int) -> DataFrame:
    """(key, id, centre, near, simhash) of buckets of lines (id, simhash, blocks) which blocks bring together, in one shuffle."""
    keys = F.col("blocks") if reach > MOST_BITS else block_keys(F.col("simhash"), nodes.count())
    members = nodes.select(F.explode(keys).alias("key"), "id", "simhash").repartition("key").sortWithinPartitions("key", "id")
    return members.mapInArrow(tidy(lambda batches: gathered(batches, reach)), "key long, id long, centre long, near boolean, simhash long")


def similar(batches, least: float):
    for batch in split_batches(batches, "a_line"):
        keep = [alike(x, y, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def with_partners(batches, reach: int):
    """Of rows (id, key, part, class, simhash) in order of (key, part), those that have a near one of another class in their (key, part)."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = np.stack([batch.column(c).to_numpy() for c in ("key", "part", "id", "class", "simhash")])
            now = now if held is None else np.concatenate([held, now], axis=1)
            whole = np.flatnonzero((now[:2] != now[:2, -1:]).any(axis=0))
            end = whole[-1] + 1 if len(whole) else 0  # the last group may go on in the next batch
            now, held = now[:, :end], now[:, end:]
        elif held is None:
            return
        else:
            now = held
        keep = np.zeros(now.shape[1], dtype=bool)
        bits = now[4].view(np.uint64)
        first = np.flatnonzero((np.diff(now[:2], axis=1, prepend=now[:2, :1] - 1) != 0).any(axis=0))
        size = np.diff(np.append(first, now.shape[1]))
        ahead = np.flatnonzero(np.repeat(size <= 64, size))
        for step in range(1, 64):  # all small groups at once
            ahead = ahead[ahead < now.shape[1] - step]
            ahead = ahead[(now[:2, ahead] == now[:2, ahead + step]).all(axis=0)]
            if not len(ahead):
                break
            near = ahead[(np.bitwise_count(bits[ahead] ^ bits[ahead + step]) <= reach) & (now[3, ahead] != now[3, ahead + step])]
            keep[near] = keep[near + step] = True
        for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            some, kind = bits[a : a + n], now[3, a : a + n]
            names, count = np.unique(kind, return_counts=True)
            for i in np.flatnonzero(kind != names[count.argmax()]).tolist():  # of each pair of classes one is not the largest
                near = (np.bitwise_count(some ^ some[i]) <= reach) & (kind != kind[i])
                if near.any():
                    keep[a : a + n][near] = True
                    keep[a + i] = True
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in now[:, keep]], ["key", "part", "id", "class", "simhash"])


def connecting(ids: list[int], classes: list[int], bits: np.ndarray, lines: list[bytes], least: float, reach: int) -> tuple[list[int], list[int]]:
    """Links (a, b) that join the classes of a group of lines as all links between its members would."""
    joined, a, b = Joined(classes), [], []
    group = np.array(classes)
    known: dict[int, np.ndarray] = {}

    def counts(k: int) -> np.ndarray:
        if k not in known:
            if len(known) >= 2048:
                known.clear()
            known[k] = triples(lines[k].decode()).astype(np.uint16)
        return known[k]

    length = np.array([len(x) if x.isascii() else len(x.decode()) for x in lines])
    for i in range(len(ids) - 1):
        close = np.flatnonzero((np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= reach) & (group[i + 1 :] != group[i])) + i + 1
        for at in range(0, len(close), 512):
            some = [j for j in close[at : at + 512].tolist() if joined.root(i) != joined.root(j)]
            if len(some) > 1 and length[i] < 48_000:  # most that are unlike by runs of three characters go at once
                longer = np.maximum(length[some], length[i])
                shared = np.minimum(np.stack([counts(j) for j in some]), counts(i)).sum(axis=1)
                some = np.array(some)[shared >= longer - 2 - 3 * ((1 - least) * longer + 1e-9).astype(np.int64)].tolist()
            for j in some:
                if joined.root(i) != joined.root(j) and alike(lines[i], lines[j], least):
                    joined.join(i, j)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
    return a, b


def connected(batches, least: float, reach: int):
    """connecting for each (key, part) of rows (key, part, id, class, simhash, line) in order of (key, part)."""
    held = None
    for batch in chain(batches, [None]):
        if batch is None:
            now, held = held, None
        else:
            now = pa.concat_batches([held, batch]) if held is not None and held.num_rows else batch
        if now is None or not now.num_rows:
            continue
        keys = np.stack([now.column(0).to_numpy(), now.column(1).to_numpy()])
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        if batch is not None:  # the last group may go on in the next batch
            held, now = now.slice(first[-1]), now.slice(0, first[-1])
        else:
            first = np.append(first, now.num_rows)
        ids, classes, bits, lines = now.column(2).to_pylist(), now.column(3).to_pylist(), now.column(4).to_numpy().view(np.uint64), now.column(5).to_pylist()
        out: tuple[list, list] = ([], [])
        for at, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            for x, y in zip(out, connecting(ids[at:end], classes[at:end], bits[at:end], lines[at:end], least, reach), strict=True):
                x += y
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def repeated_lines(docs: DataFrame, similarity: float = 0.8, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text", reach: int = MOST_BITS) -> DataFrame:
    """(doc_id, line_no, fuzzy) of each line that is to be removed; fuzzy: not equal to the one that stays."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = stored(lines_of(source, least_words, reach > MOST_BITS), "lines", hashes=True)
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    nodes = every.groupBy("f1", "f2").agg(first, F.count("*").alias("n"), F.max("simhash").alias("simhash"), F.first("blocks").alias("blocks"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("id"), "f1", "f2", "first", "n", "simhash", "blocks"), "distinct-lines", hashes=True)
    fuzzy = nodes.where("simhash is not null")
    inside = stored(line_buckets(fuzzy.select("id", "simhash", "blocks"), reach), "buckets", hashes=True)
    nodes = nodes.drop("blocks")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, line) of nodes, from the documents where they occur first."""
        wanted = nodes.join(maybe_broadcast(stored(ids.distinct(), "wanted-ids"), 8), "id", "left_semi").groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line_no", "id")).alias("wanted"))
        wanted = stored(wanted, "wanted")

        def texts(batches):
            for batch in split_batches(batches, "text"):
                found = {}
                for text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lines = text.split("\n")
                    found |= {x["id"]: normal_line(lines[x["line_no"]]) for x in some if x["line_no"] < len(lines)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["id", "line"])

        lines = source.where("text is not null").join(maybe_broadcast(wanted, 64, F.size("wanted") * 24), "doc_id").select("text", "wanted")
        return stored(lines.mapInArrow(tidy(texts), "id long, line binary"), "wanted-lines")

    def within(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
        rows = stored(dealt.mapInArrow(tidy(lambda batches: with_partners(batches, reach)), "key long, part long, id long, class long, simhash long"), "partners")
        told = rows.join(texts_of(rows.select("id")), "id").repartition("key", "part").sortWithinPartitions("key", "part", "id")
        return told.select("key", "part", "id", "class", "simhash", "line").mapInArrow(tidy(lambda batches: connected(batches, similarity, reach)), "a long, b long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        lines = texts_of(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))))
        told = lambda name: lines.select(F.col("id").alias(name), F.col("line").alias(f"{name}_line"))
        side = pairs.join(told("a"), "a").join(told("b"), "b").select("a", "b", "a_line", "b_line")
        return side.mapInArrow(tidy(lambda batches: similar(batches, similarity)), "a long, b long").distinct()

    classes = near_classes(inside, verify, within, chunk=LINES, carried=["simhash"])
    placed = labelled(nodes, classes, "id")
    linked = labelled(nodes.join(maybe_broadcast(classes.select("id").distinct(), 8), "id", "left_semi"), classes, "id")
    stays = stored(linked.groupBy("id_class").agg(F.min("first").alias("stays")), "stays")
    placed = placed.join(maybe_broadcast(stays, 24), "id_class", "left").withColumn("stays", F.coalesce("stays", "first"))
    touched = placed.where("n > 1 or stays <> first").select("f1", "f2", "stays", (F.col("stays") != F.col("first")).alias("fuzzy"))
    gone = every.join(maybe_broadcast(stored(touched, "touched"), 48), ["f1", "f2"]).where(F.struct("doc_id", "line_no") != F.col("stays"))
    return gone.select("doc_id", "line_no", "fuzzy").distinct()


def without_repeats(docs: DataFrame, similarity: float, least_words: int, id_col: str, text_col: str, reach: int) -> DataFrame:
    """docs with the repeated lines removed, and __n_lines, __n_exact and __n_fuzzy."""
    gone = repeated_lines(docs, similarity, least_words, id_col, text_col, reach).groupBy("doc_id").agg(F.collect_list(F.when(F.col("fuzzy"), -1 - F.col("line_no")).otherwise(F.col("line_no"))).alias("__gone"))
    gone = stored(gone, "removed-lines").withColumnRenamed("doc_id", "__id")
    joined = docs.join(maybe_broadcast(gone, 64, F.size("__gone") * 4), F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")
    place = docs.columns.index(text_col)

    def run(batches):
        for big in batches:
            for batch in split_batches([big], text_col, 4 << 20):
                texts, n_lines, n_exact, n_fuzzy = batch.column(place).to_pylist(), [], [], []
                for k, (t, some) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                    fuzzy = sum(x < 0 for x in some) if some else 0
                    n_lines.append(t.count("\n") + 1 if t else 0)
                    n_fuzzy.append(fuzzy)
                    n_exact.append(len(some) - fuzzy if some else 0)
                    if some and t is not None:
                        less = {-1 - x if x < 0 else x for x in some}
                        texts[k] = "\n".join([line for n, line in enumerate(t.split("\n")) if n not in less])
                columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n_lines, n_exact, n_fuzzy))], [*batch.schema.names[:-1], "__n_lines", "__n_exact", "__n_fuzzy"])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__n_lines", "__n_exact", "__n_fuzzy"))])
    return joined.mapInArrow(tidy(run), schema)


def dedup_lines(docs: DataFrame, similarity: float = 0.8, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text", reach: int = MOST_BITS) -> DataFrame:
    """docs with the texts' repeated lines removed, and n_lines, n_exact and n_fuzzy removed ones; rows stay even if no line does.

    reach: bits in which SimHashes of linked lines may differ; REACH for those of edit similarity 0.8.
    """
    found = without_repeats(docs, similarity, least_words, id_col, text_col, reach)
    new = {"n_lines": "__n_lines", "n_exact": "__n_exact", "n_fuzzy": "__n_fuzzy"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new or c in (id_col, text_col)]
    return found.select(*keep, *(F.col(v).alias(k) for k, v in new.items()))


def drop_lines(docs: DataFrame, similarity: float = 0.8, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text", reach: int = MOST_BITS) -> DataFrame:
    """docs, with its columns, without the repeated lines; documents of which nothing with words is left go, unless nothing was removed."""
    found = without_repeats(docs, similarity, least_words, id_col, text_col, reach)
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return found.where(worded | (F.col("__n_exact") + F.col("__n_fuzzy") == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
