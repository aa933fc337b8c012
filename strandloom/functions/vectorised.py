"""Functions over batches of sequences that built-in functions can't express at the speed of columns.

Sequences of a batch become a matrix of bytes; steps go over positions, each
for all reads of the batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.dna import letter_class


def matrix(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, one row a text, 0 behind its end; lengths); null is empty."""
    raw = [x.encode("latin-1") if x is not None else b"" for x in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    width = max(1, int(sizes.max(initial=0)))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width), sizes


def refusals(pattern: str) -> np.ndarray:
    """For each letter of a pattern, which bytes it refuses."""
    out = np.ones((len(pattern), 256), dtype=bool)
    for k, letter in enumerate(pattern):
        accepted = letter_class(letter)
        out[k, list(range(256)) if accepted is None else [ord(x) for x in accepted + accepted.lower()]] = False
    return out


def iupac_anywhere(seq: Column, pattern: str, most: int) -> Column:
    """Start of the leftmost window with the fewest mismatches, if at most `most`; else null."""

    @F.pandas_udf("int")
    def start(texts: pd.Series) -> pd.Series:
        m, sizes = matrix(texts)
        n, width = len(pattern), m.shape[1] - len(pattern) + 1
        if width < 1:
            return pd.Series([None] * len(m), dtype="Int32")
        no = refusals(pattern)
        distance = np.zeros((len(m), width), dtype=np.int32)
        for k in range(n):
            distance += no[k][m[:, k : k + width]]
        distance[np.arange(width)[None] > (sizes - n)[:, None]] = 1 << 20
        best = distance.argmin(axis=1)
        found = distance[np.arange(len(m)), best] <= most
        return pd.Series(best, dtype="Int32").where(found)

    return start(seq)


def iupac_with_indels(seq: Column, pattern: str, anchor: str, mismatches: int, indels: int, edits: int) -> Column:
    """struct<start, len> of the best alignment within the limits, else null.

    Match 1, mismatch -1, a skipped base on either side -1; the ends of the read
    that the anchor leaves open cost nothing.  Of equal scores the diagonal is
    preferred, then a base missing from the read, and the leftmost end.
    """

    @F.pandas_udf("start int, len int")
    def align(texts: pd.Series) -> pd.DataFrame:
        m, sizes = matrix(texts)
        m = np.where((m >= 97) & (m <= 122), m - 32, m).astype(np.uint8)
        no, n, rows = refusals(pattern), len(pattern), len(m)
        far = -(10**6)
        # columns of the table by place in the read: score, start, mismatches, indels for each prefix of the pattern
        score = np.full((n + 1, rows), far)
        begin, wrong, gaps = (np.zeros((n + 1, rows), dtype=np.int64) for _ in range(3))
        for i in range(n + 1):
            score[i], gaps[i] = -i, i
        best = np.full(rows, far)
        result = np.zeros((4, rows), dtype=np.int64)  # start, end, mismatches, indels

        def offer(at, allowed):
            better = allowed & (score[n] > best)
            best[better] = score[n][better]
            for k, x in enumerate((begin[n], np.full(rows, at), wrong[n], gaps[n])):
                result[k][better] = x[better]

        offer(0, (sizes == 0) if anchor == "right" else np.ones(rows, dtype=bool))
        for j in range(m.shape[1]):
            old = [x.copy() for x in (score, begin, wrong, gaps)]
            if anchor != "left":
                score[0], begin[0], wrong[0], gaps[0] = 0, j + 1, 0, 0
            else:
                score[0], gaps[0] = -(j + 1), j + 1
            for i in range(1, n + 1):
                differs = no[i - 1][m[:, j]]
                diagonal = old[0][i - 1] + np.where(differs, -1, 1)
                missing, extra = score[i - 1] - 1, old[0][i] - 1  # the read lacks a base; has one more
                kind = np.where((diagonal >= missing) & (diagonal >= extra), 0, np.where(missing >= extra, 1, 2))
                score[i] = np.choose(kind, [diagonal, missing, extra])
                begin[i] = np.choose(kind, [old[1][i - 1], begin[i - 1], old[1][i]])
                wrong[i] = np.choose(kind, [old[2][i - 1] + differs, wrong[i - 1], old[2][i]])
                gaps[i] = np.choose(kind, [old[3][i - 1], gaps[i - 1] + 1, old[3][i] + 1])
            inside = j < sizes
            offer(j + 1, inside & (sizes == j + 1) if anchor == "right" else inside)
        fine = (result[2] <= mismatches) & (result[3] <= indels) & (result[2] + result[3] <= edits) & (best > far) & (result[1] > result[0]) & (sizes + indels >= n)
        return pd.DataFrame({"start": pd.Series(result[0], dtype="Int32").where(fine), "len": pd.Series(result[1] - result[0], dtype="Int32").where(fine)})

    return align(seq)


def poly_tail(seq: Column, base: str, min_length: int, rate: float, consecutive: int) -> Column:
    """Start of the tail of one base, with mismatches, at a read's end; null without one."""

    def one(m: np.ndarray, sizes: np.ndarray, letter: int) -> np.ndarray:
        rows = len(m)
        last = np.full(rows, -1, dtype=np.int64)
        mis, mat, run = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        going = np.ones(rows, dtype=bool)
        for back in range(1, m.shape[1] + 1):
            at = sizes - back
            going &= at >= 0
            if not going.any():
                break
            same = m[np.arange(rows), np.maximum(at, 0)] == letter
            mat += going & same
            run[going & same] = 0
            good = going & same & (back >= min_length) & (mis <= rate * (mis + mat))
            last[good] = at[good]
            differs = going & ~same
            mis += differs
            run += differs
            going &= ~(differs & ((mis > rate * sizes) | (run > consecutive)))
        return last

    @F.pandas_udf("int")
    def start(texts: pd.Series) -> pd.Series:
        m, sizes = matrix(texts)
        best = one(m, sizes, ord("A" if base == "." else base))
        for letter in "GCTN" if base == "." else "":
            other = one(m, sizes, ord(letter))
            best = np.where((other >= 0) & ((best < 0) | (other < best)), other, best)
        return pd.Series(best, dtype="Int32").where(best >= 0)

    return start(seq)


def longest_poly(seq: Column, base: str, min_length: int, rate: float, consecutive: int) -> Column:
    """struct<start, len> of the longest window of one base with mismatches, the leftmost of equal ones; null without one."""

    def one(m: np.ndarray, sizes: np.ndarray, letter: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(m)
        same = m == letter
        best, length = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        for start in range(m.shape[1] - min_length + 1):
            going = (sizes - start >= min_length) & (sizes - start > length)
            mis, run = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            for at in range(start, m.shape[1]):
                going &= at < sizes
                if not going.any():
                    break
                hit = same[:, at]
                run = np.where(hit, 0, run + 1)
                mis += going & ~hit
                going &= hit | (run < consecutive)
                cur = at - start + 1
                good = going & (cur >= min_length) & (mis <= rate * cur) & (cur > length)
                best[good], length[good] = start, cur
                going &= mis <= rate * (sizes - start)
        return best, length

    @F.pandas_udf("start int, len int")
    def window(texts: pd.Series) -> pd.DataFrame:
        m, sizes = matrix(texts)
        best, length = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
        for letter in "ACGT" if base == "." else base:
            b, n = one(m, sizes, ord(letter))
            better = (n > length) | ((n == length) & (n > 0) & (b < best))
            best, length = np.where(better, b, best), np.where(better, n, length)
        return pd.DataFrame({"start": pd.Series(best, dtype="Int32").where(length > 0), "len": pd.Series(length, dtype="Int32").where(length > 0)})

    return window(seq)


#: Positions from the start of an overlap in which mismatches beyond the limit refuse it.
CHECKED = 50
#: Qualities (bytes) between which the second read's base replaces the first's.
GOOD, BAD = 63, 47


def merge_reads(seq1: Column, qual1: Column, seq2: Column, qual2: Column, min_overlap: int, max_rate: float, max_count: int) -> Column:
    """struct<seq, qual> of two overlapping reads as one (the second already turned); null without an overlap.

    Offsets of the second read against the first are tried from 0 up, then from
    0 down; the first one whose mismatches are within the limits counts.
    """

    def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n1, n2 = x.shape[1], y.shape[1]
        found = np.full(len(x), np.iinfo(np.int64).max)
        none = found.copy()
        tries = [(o, min(n1 - o, n2), o, 0) for o in range(max(0, n1 - min_overlap))]
        tries += [(-o, min(n1, n2 - o), 0, o) for o in range(max(0, n2 - min_overlap))]
        for offset, n, a, b in tries:
            limit = min(max_count, int(n * max_rate))
            k = min(n, CHECKED)
            open_ = found == none
            if not open_.any():
                break
            diff = (x[open_, a : a + k] != y[open_, b : b + k]).sum(axis=1)
            found[np.flatnonzero(open_)[diff <= limit]] = offset
        return found

    @F.pandas_udf("seq string, qual string")
    def merged(s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        seqs: list[str | None] = [None] * len(s1)
        quals: list[str | None] = [None] * len(s1)
        n1, n2 = s1.str.len().to_numpy(), s2.str.len().to_numpy()
        for a, b in set(zip(n1.tolist(), n2.tolist(), strict=True)):
            rows = np.flatnonzero((n1 == a) & (n2 == b))
            if not a or not b:
                continue
            (x, _), (p, _), (y, _), (q, _) = (matrix(c.iloc[rows]) for c in (s1, q1, s2, q2))
            for i, k, offset in zip(rows.tolist(), range(len(rows)), overlap(x, y).tolist(), strict=True):
                if abs(offset) > a + b:
                    continue
                left, right = max(offset, 0), max(-offset, 0)
                n = min(a - left, b - right)
                swap = (x[k, left : left + n] != y[k, right : right + n]) & (q[k, right : right + n] >= GOOD) & (p[k, left : left + n] <= BAD)
                middle, marks = np.where(swap, y[k, right : right + n], x[k, left : left + n]), np.where(swap, q[k, right : right + n], p[k, left : left + n])
                tail = slice(right + n, b) if offset > 0 else slice(0, 0)
                head = x[k, :left], p[k, :left]
                seqs[i] = np.concatenate([head[0], middle, y[k, tail]]).astype(np.uint8).tobytes().decode("latin-1")
                quals[i] = np.concatenate([head[1], marks, q[k, tail]]).astype(np.uint8).tobytes().decode("latin-1")
        return pd.DataFrame({"seq": pd.Series(seqs, dtype=object), "qual": pd.Series(quals, dtype=object)})

    return merged(seq1, qual1, seq2, qual2)
