"""Problem 2: records of one split that also stand, unchanged or nearly so, in another split.

A weighted cosine join. A record is a vector of its distinct words, each with the word's weight, divided by the vector's length; the dot
product of two records is their cosine. Weights are one (all words count alike, as the definition of near-equal records has it) or
idf (1 + log of the records over those with the word). Words are ordered by how rare they are over both splits. Bounds keep
the inverted lists short, none of which loses a pair:

* maximum weight: each word of a record can add no more than its weight times the largest weight that the word has in any record of the other split, 0 if
  it never occurs there. Once the words still to come can't reach the bound together, a word opens no list;
* residual norm: nor does it once the length of what is still to come is below the bound. With equal weights this is a count, and exact for each pair
  of sizes: the shorter record of a pair meets its partner within a shorter prefix than the longer one; lists are kept
  apart by that, so long prefixes never meet long prefixes;
* at a meeting in a list, the residuals of both records and, with equal weights, a 256-bit sketch of each (bits that differ are at
  most words that differ) must leave the bound within reach.

Lists come sorted to the tasks, which hold one at a time and compare its two sides in blocks of arrays; a word set that several tasks wrote into a
list stands in it once. What is left gets its exact dot product from the texts. Equal word sets are one class from the start: each
class is joined once, and pairs of records come from the classes at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.words import words
from ..session import BROADCAST_ROWS, cut

#: Words are counted in this many buckets: the counts order words and show which are absent from a split;
#: two words in one bucket make the order less exact and never lose a pair. This bounds what the driver holds.
BUCKETS = 1 << 20
#: Words of a record that isn't there.
NONE = 1 << 40
#: A list of a word that occurs in more records than this is split among several tasks.
HOT_RECORDS = 500_000
#: Words and word sets that one task remembers at a time.
REMEMBERED = 400_000
#: About so many meetings are compared at a time, for so many left entries at least; from so many meetings on a list is compared by itself.
BLOCK, ROWS_AT_ONCE, OWN_BLOCK = 1 << 16, 16, 1 << 12

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


class _Reader:
    """Texts to flat arrays of word hashes, with the number of distinct words of each text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        known, flat, sizes = self.known, [], np.zeros(len(texts), np.int64)
        if len(known) > REMEMBERED:
            known.clear()
        for k, text in enumerate(texts):
            found = set(words(text))
            sizes[k] = len(found)
            for w in found:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                flat.append(h)
        return np.array(flat, np.uint64), sizes


def _set_hashes(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word set, whatever the order of its words; all sets have a word."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(_mix(h, _M1), starts).view(np.int64), np.bitwise_xor.reduceat(_mix(h, _M2), starts).view(np.int64)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each record's word set (side 0 or 1), then by bucket of words (id) the task's counts (side 2) and the fewest words of a record that has one (side 3)."""
    read, counts, least = _Reader(), np.zeros((2, BUCKETS), np.int64), np.full((2, BUCKETS), NONE, np.int64)
    for batch in batches:
        h, sizes = read(batch["text"])
        keep = sizes > 0
        side = batch["side"].to_numpy()
        np_side = np.repeat(side, sizes)
        bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        n = np.repeat(sizes, sizes)
        for s in (0, 1):
            here = bucket[np_side == s]
            counts[s] += np.bincount(here, minlength=BUCKETS)
            np.minimum.at(least[s], here, n[np_side == s])
        one, two = _set_hashes(h, sizes[keep])
        yield pd.DataFrame({"side": side[keep].astype(np.int32), "id": batch["id"].to_numpy()[keep], "h1": one, "h2": two})
    used = np.nonzero(counts.sum(axis=0))[0]
    for k in range(0, len(used), 50_000):
        b = used[k : k + 50_000]
        for side, of in ((2, counts), (3, least)):
            yield pd.DataFrame({"side": np.full(len(b), side, np.int32), "id": b, "h1": of[0][b], "h2": of[1][b]})


class Words:
    """What is known of all words: by bucket the records of each side that have one, and the fewest words of such a record."""

    def __init__(self, counts: np.ndarray, least: np.ndarray, records: int, idf: bool) -> None:
        self.counts, self.least, self.records, self.idf = counts, least, records, idf

    def weight(self, bucket: np.ndarray) -> np.ndarray:
        """1, or 1 + log of all records over those with the word; never below 1."""
        return 1 + np.log((self.records + 1) / (self.counts[0][bucket] + self.counts[1][bucket] + 1)) if self.idf else np.ones(len(bucket))

    def most(self, bucket: np.ndarray, side: int, w: np.ndarray) -> np.ndarray:
        """The largest that the word's part of a vector of ``side`` can be: its record has ``least`` words of weight 1 or more."""
        return np.where(self.counts[side][bucket] > 0, w / np.sqrt(w * w + np.maximum(0, self.least[side][bucket] - 1)), 0.0)


#: Rests are counts of words with equal weights, else lengths; n is negative in entries of the right side.
_POSTING = "term long, word_set long, n int, rest {}, b0 long, b1 long, b2 long, b3 long"


def _suffix(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums of what is still to come, the place itself included, in records of ``m`` places each."""
    if not len(x):
        return x
    total = np.cumsum(x)
    return np.repeat(total[np.cumsum(m) - 1], m) - total + x


def _postings(side: int, similarity: float, shared, cosine: float):
    """Inverted-list entries of one split; side 0 is the left one. With idf weights ``cosine`` bounds the dot product, else the counts that ``similarity`` asks for do, too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, seen = _Reader(), set()
        known = shared.value
        total, other = known.counts[0] + known.counts[1], known.counts[1 - side]
        for batch in batches:
            h, sizes = read(batch["text"])
            if not len(h):
                continue
            one, _ = _set_hashes(h, sizes[sizes > 0])
            # Equal sets give equal entries: a task writes them once.
            if len(seen) > REMEMBERED:
                seen.clear()
            first = np.zeros(len(one), bool)
            for k, v in enumerate(one.tolist()):
                if v not in seen:
                    seen.add(v)
                    first[k] = True
            n = sizes[sizes > 0]
            h = h[np.repeat(first, n)]
            n, one = n[first], one[first]
            if not len(n):
                continue
            rec = np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), 256), bool)
            bits[rec, (_mix(h, _M3) & np.uint64(255)).astype(np.int64)] = True
            sketch = np.packbits(bits, axis=1).view(np.int64)
            bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
            w = known.weight(bucket)
            v = w / np.sqrt(np.bincount(rec, w * w, minlength=len(n)))[rec]
            there = other[bucket] > 0
            h, rec, count, v, most = h[there], rec[there], total[bucket[there]], v[there], known.most(bucket[there], 1 - side, w[there])
            order = np.lexsort((h, count, rec))
            h, rec, count, v, most = h[order], rec[order], count[order], v[order], most[order]
            m = np.bincount(rec, minlength=len(n))
            at = np.arange(len(rec)) - np.repeat(np.cumsum(m) - m, m)
            m = m[m > 0]
            norm, best = np.sqrt(np.maximum(0, _suffix(v * v, m))), _suffix(v * most, m)
            keep = np.minimum(norm, best) >= cosine - 1e-6
            m = np.bincount(rec, minlength=len(n))
            early = np.ones(len(rec), bool)
            rest = norm
            if not known.idf:
                # Equal weights: the bounds are exact counts.
                longest = m - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                shortest = m - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1
                keep &= at < longest[rec]
                early, rest = at < shortest[rec], (m[rec] - at).astype(np.int32)
            h, rec, count, rest, early = h[keep], rec[keep], count[keep], rest[keep], early[keep]
            # List 0: the left record's early words with all of the right one's; list 1: its late words with early ones.
            if side == 0:
                pick, which = np.arange(len(h)), np.where(early, 0, 1)
            elif known.idf:
                pick, which = np.arange(len(h)), np.zeros(len(h), np.int64)
            else:
                pick = np.concatenate([np.arange(len(h)), np.nonzero(early)[0]])
                which = np.concatenate([np.zeros(len(h), np.int64), np.ones(int(early.sum()), np.int64)])
            parts = 1 + count[pick] // HOT_RECORDS
            if side == 0:
                salt = (one[rec[pick]].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
            else:
                salt = np.concatenate([np.arange(p) for p in parts]) if parts.max(initial=1) > 1 else np.zeros(len(pick), np.int64)
                pick, which = np.repeat(pick, parts), np.repeat(which, parts)
            term = _mix(h[pick] + (2 * salt + which).astype(np.uint64) * _M2, _M1)
            rec, rest = rec[pick], rest[pick]
            yield pd.DataFrame(
                {"term": term.view(np.int64), "word_set": one[rec], "n": (-n if side else n)[rec].astype(np.int32), "rest": rest}
                | {f"b{k}": sketch[rec, k] for k in range(4)}
            )

    return run


class _Lists:
    """Whole lists (entries sorted by term): which of a list's left word sets may reach the bound with which of its right ones."""

    def __init__(self, entries: pd.DataFrame, similarity: float | None, cosine: float) -> None:
        self.similarity, self.cosine = similarity, cosine
        term, word_set, n, rest = (entries[c].to_numpy() for c in ("term", "word_set", "n", "rest"))
        bits = [entries[f"b{k}"].to_numpy().view(np.uint64) for k in range(4)]
        # With equal weights, the most words that a partner met here can have.
        most = np.zeros(len(n), np.int64) if similarity is None else np.floor(rest * ((1 + similarity) / similarity) - np.abs(n) + 1e-6).astype(np.int64)
        order = np.lexsort((word_set, most, np.abs(n), n < 0, term))
        # Tasks that read equal records wrote equal entries.
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (term, n, word_set, bits[0])], axis=0)
        kept = order[new]
        self.word_set, self.n, self.rest, self.most, self.bits = word_set[kept], np.abs(n[kept]).astype(np.int64), rest[kept], most[kept], [b[kept] for b in bits]
        term, right = term[kept], n[kept] < 0
        self.start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        self.end = np.append(self.start[1:], len(term))
        self.middle = self.start + np.add.reduceat((~right).astype(np.int64), self.start)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = self.middle - self.start, self.end - self.middle
        own = left * right >= OWN_BLOCK
        for start, middle, end in zip(self.start[own].tolist(), self.middle[own].tolist(), self.end[own].tolist()):
            yield from self._block(start, middle, end)
        # Short lists are laid out together, a row of right entries for each left one.
        few = (left * right > 0) & ~own
        left, right, start, middle = left[few], right[few], self.start[few], self.middle[few]
        x = np.arange(left.sum()) + np.repeat(start - np.cumsum(left) + left, left)
        first, width = np.repeat(middle, left), np.repeat(right, left)
        until = np.cumsum(width)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(until, until[at] + BLOCK)))
            w = width[at:to]
            yield self._within_reach(np.repeat(x[at:to], w), np.arange(w.sum()) + np.repeat(first[at:to] - np.cumsum(w) + w, w))
            at = to

    def _block(self, start: int, middle: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both sides of a list stand in the order of their sizes, so few rows of the left one ask for the same part of the right one."""
        step = max(ROWS_AT_ONCE, BLOCK // (end - middle))
        for a in range(start, middle, step):
            x = slice(a, min(middle, a + step))
            y = np.arange(middle, end)
            if self.similarity is not None:
                least, largest = self.n[a], self.n[x.stop - 1]
                sizes = self.n[middle:end]
                first = np.searchsorted(sizes, least * self.similarity - 1e-6)
                last = np.searchsorted(sizes, min(largest / self.similarity + 1e-6, self.most[x].max()), "right")
                y = middle + first + np.flatnonzero(self.most[middle + first : middle + last] >= least)
            at_once = max(1, 4 * BLOCK // (x.stop - a))
            for k in range(0, len(y), at_once):
                part = y[k : k + at_once]
                if self.similarity is None:
                    near = self.rest[x, None] * self.rest[None, part] >= self.cosine - 1e-6
                else:
                    apart = np.floor((largest + self.n[part]) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6)
                    differ = np.bitwise_count(self.bits[0][x, None] ^ self.bits[0][None, part])
                    differ += np.bitwise_count(self.bits[1][x, None] ^ self.bits[1][None, part])
                    near = differ <= np.minimum(apart, 255).astype(np.uint8)
                met = np.flatnonzero(near)
                if len(met):
                    i, j = np.divmod(met, len(part))
                    yield self._within_reach(i + a, part[j])

    def _within_reach(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.similarity is None:
            near = self.rest[x] * self.rest[y] >= self.cosine - 1e-6
        else:
            size = self.n[x] + self.n[y]
            near = np.minimum(self.rest[x], self.rest[y]) * (1 + self.similarity) >= size * self.similarity - 1e-6
            differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in self.bits)
            near &= differ <= size * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6
        return self.word_set[x[near]], self.word_set[y[near]]


def _meetings(similarity: float | None, cosine: float):
    """The word sets l1, r1 that meet in a list and may reach the bound; entries come sorted by term."""

    def met(entries: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, y in _Lists(pd.concat(entries), similarity, cosine).pairs():
            if len(x):
                yield pd.DataFrame({"l1": x, "r1": y})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_list: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            term = batch["term"].to_numpy()
            ended = int(np.searchsorted(term, term[-1]))
            if open_list and (ended or open_list[-1]["term"].iloc[0] != term[-1]):
                yield from met([*open_list, batch.iloc[:ended]])
                open_list = []
            elif ended:
                yield from met([batch.iloc[:ended]])
            open_list.append(batch.iloc[ended:])
        if open_list:
            yield from met(open_list)

    return run


def _exact(shared):
    """Words in common and the exact dot product of each pair of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, known = _Reader(), shared.value
        for batch in batches:
            common, in_left, in_right, cosine = [], [], [], []
            for a, b in zip(batch["left_text"], batch["right_text"]):
                (x, _), (y, _) = read([a]), read([b])
                both = np.intersect1d(x, y)
                common.append(len(both))
                in_left.append(len(x))
                in_right.append(len(y))
                dot, one, two = (float((known.weight((h & np.uint64(BUCKETS - 1)).astype(np.int64)) ** 2).sum()) for h in (both, x, y))
                cosine.append(dot / np.sqrt(one * two))
            yield batch.drop(columns=["left_text", "right_text"]).assign(common=common, in_left=in_left, in_right=in_right, cosine=cosine)

    return run


def cross_split_overlap(left: DataFrame, right: DataFrame, similarity: float = 0.8) -> DataFrame:
    """All pairs of a record of ``left`` and one of ``right`` whose words in common are at least ``similarity`` of the words in either.

    Both need the columns id (integer, unique) and text; others are left alone. Returns left_id, right_id, common
    (number of words in common), similarity (common over the words in either) and cosine (the exact dot
    product). Rows without an id and null, empty and wordless texts pair with nothing; repeated texts pair each for itself; an
    empty split gives an empty result.
    """
    # Equal records of the same size need the cosine 2s / (1 + s); all others need more.
    return _joined(left, right, similarity, 2 * similarity / (1 + similarity), False)


def weighted_overlap(left: DataFrame, right: DataFrame, cosine: float = 0.8) -> DataFrame:
    """All pairs of a record of ``left`` and one of ``right`` whose vectors of idf weights have a cosine of at least ``cosine``.

    Inputs, results and edge cases are those of ``cross_split_overlap``. Weights come from counts in BUCKETS buckets of word hashes.
    """
    return _joined(left, right, None, cosine, True)


def _joined(left: DataFrame, right: DataFrame, similarity: float | None, cosine: float, idf: bool) -> DataFrame:
    spark = left.sparkSession
    one, two = (df.select(F.col("id").cast("long").alias("id"), "text").filter("id is not null") for df in (left, right))
    both = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))
    survey = cut(both.mapInPandas(_survey, "side int, id long, h1 long, h2 long"))

    counted = survey.filter("side > 1").groupBy("side", "id").agg(F.sum("h1").alias("c1"), F.sum("h2").alias("c2"), F.min("h1").alias("n1"), F.min("h2").alias("n2")).toPandas()
    counts, least = np.zeros((2, BUCKETS), np.int64), np.full((2, BUCKETS), NONE, np.int64)
    for of, kind, columns in ((counts, 2, ("c1", "c2")), (least, 3, ("n1", "n2"))):
        rows = counted[counted["side"] == kind]
        for k in (0, 1):
            of[k][rows["id"]] = rows[columns[k]]
    shared = spark.sparkContext.broadcast(Words(counts, np.minimum(least, 1 << 30).astype(np.int32), survey.filter("side < 2").count() if idf else 0, idf))

    lists = [df.select("text").mapInPandas(_postings(k, similarity, shared, cosine), _POSTING.format("double" if idf else "int")) for k, df in enumerate((one, two))]
    met = lists[0].unionByName(lists[1]).repartition("term").sortWithinPartitions("term").mapInPandas(_meetings(None if idf else similarity, cosine), "l1 long, r1 long")
    near = cut(met.distinct())

    few = near.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    sets = survey.filter("side < 2")
    wanted = [sets.filter(f"side = {k}").join(small(near.select(F.col(f"{c}1").alias("h1")).distinct()), "h1", "left_semi") for k, c in enumerate("lr")]
    members = [cut(df.select("id", "h1", "h2")) for df in wanted]
    firsts = [df.groupBy("h1", "h2").agg(F.min("id").alias("id")) for df in members]
    # Class representatives with their texts; few of them are sent to the texts, many are joined with a shuffle.
    texts = []
    for df, first in ((one, firsts[0]), (two, firsts[1])):
        texts.append(df.join(small(first), "id"))
    a = texts[0].select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("text").alias("left_text"))
    b = texts[1].select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("text").alias("right_text"))
    exact = near.join(a, "l1").join(b, "r1").mapInPandas(_exact(shared), "r1 long, l1 long, l2 long, r2 long, common int, in_left int, in_right int, cosine double")
    union = F.col("in_left") + F.col("in_right") - F.col("common")
    same = exact.filter(F.col("cosine") >= cosine - 1e-9) if idf else exact.filter(F.col("common") >= union * similarity - 1e-9)
    x = members[0].select(F.col("id").alias("left_id"), F.col("h1").alias("l1"), F.col("h2").alias("l2"))
    y = members[1].select(F.col("id").alias("right_id"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    return (
        same.join(x, ["l1", "l2"])
        .join(y, ["r1", "r2"])
        .select("left_id", "right_id", "common", (F.col("common") / union).alias("similarity"), "cosine")
    )


def overlap_counts(pairs: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Per group of the right records (say, split and data set): records with a partner on the left, and pairs.

    ``groups`` names columns of ``right``; null is a group of its own.
    """
    per = pairs.groupBy("right_id").agg(F.count("*").alias("pairs"))
    kept = right.select("id", *groups)
    return kept.join(per, kept["id"] == per["right_id"]).groupBy(*groups).agg(F.count("*").alias("records"), F.sum("pairs").alias("pairs"))
