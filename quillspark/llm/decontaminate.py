"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask is laid on every position of the test items and of the training texts; the hash covers only the words
under its ones, so a substituted word under a zero goes unnoticed. Equal hashes are hits. Around a hit the two texts are
laid side by side on the hit's diagonal and all runs on it are judged: an overlap is a run of at least min_words words, from
a match to a match, of which MATCHING % match, or a whole shorter item of which as many match.

No overlap is missed for want of a hit: a longer one can be halved until one of 12 to 23 words is left that matches as well, and
the masks hit every such one wherever its substituted words stand (the tests try all cases). For whole items of fewer words
the masks that are wanting are added by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, saved, small_batches
from .textbytes import Words, chain, slices, texts_of

#: Fixed masks: together they hit every run of 12 to 23 words of which 80 % match.
MASKS = ("1101111", "1111000101", "11101000011", "1000001110101")
MATCHING = 80
PREFILTER_BITS = 22
#: Steps of up to so many words at which texts may repeat themselves without making more hits.
PERIODS = 16
#: Hits and words that are held at once.
CHUNK = 1 << 20


def gaps(n: int) -> list[tuple[int, ...]]:
    """Masks over n words without as many of them as may be substituted, for the places that no fixed mask gets around."""
    may = (100 - MATCHING) * n // 100
    laid = [{lo + i for i, c in enumerate(m) if c == "1"} for m in MASKS for lo in range(n - len(m) + 1)]
    return [tuple(j for j in range(n) if j not in gone) for gone in combinations(range(n), may) if may and all(x & set(gone) for x in laid)]


def long_run(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The run of at least least words, from a match to a match, that is furthest over MATCHING % of matches."""
    at = np.flatnonzero(same)
    if not len(at) or at[-1] - at[0] + 1 < least:
        return None
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - MATCHING, -MATCHING))])
    far = np.iinfo(np.int64).max // 2
    starts = np.where(same, total[:-1], far)[: len(same) - least + 1]
    low = np.minimum.accumulate(starts)
    over = np.where(same[least - 1 :], total[least:] - low, -far)
    end = int(np.argmax(over))
    return (int(np.argmin(starts[: end + 1])), end + least) if over[end] >= 0 else None


def periods(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each position the least step back, up to PERIODS, to an equal hash in the same group; 0 without one."""
    out = np.zeros(len(h), dtype=np.int64)
    for q in range(min(PERIODS, len(h) - 1), 0, -1):
        out[q:][(h[q:] == h[:-q]) & (group[q:] == group[:-q])] = q
    return out


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i] to lo[i] + n[i] - 1 for each i, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Seeds:
    """The seeds of some test items, with the items' words for verification."""

    def __init__(self, ids: list[int], texts: list[str | None], min_words: int):
        words = texts_of(texts).words()
        self.ids, self.min_words = ids, min_words
        self.words, self.bounds = words.hash, words.bounds
        sizes = np.diff(words.bounds)
        self.sizes = sizes
        #: items that are too short for the masks are hashed whole, by length
        short = sorted({int(n) for n in sizes if 0 < n < max(map(len, MASKS))})
        plans = [(len(m), tuple(i for i, c in enumerate(m) if c == "1"), False) for m in MASKS]
        plans += [(n, tuple(range(n)), True) for n in short]
        plans += [(n, offs, True) for n in short if n <= min_words for offs in gaps(n)]
        self.tables = []
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - np.repeat(words.bounds[:-1], sizes)
        for span, offs, exact in plans:
            h = chain(words.hash, offs, len(words) - span + 1)
            # that lie inside one item
            fits = (place[: len(h)] + span <= sizes[item[: len(h)]]) & ((sizes[item[: len(h)]] == span) | (not exact))
            step = periods(h, np.where(fits, item[: len(h)], -1 - np.arange(len(h))))
            at = np.flatnonzero(fits)
            at = at[np.lexsort((at, step[at], h[at]))]
            values, first = np.unique(h[at], return_index=True)
            group = np.repeat(np.arange(len(values)), np.diff(np.append(first, len(at))))
            bits = np.zeros(1 << PREFILTER_BITS, dtype=bool)
            bits[(values >> np.uint64(64 - PREFILTER_BITS)).astype(np.int64)] = True
            self.tables.append((offs, values, group * (PERIODS + 1) + step[at], item[at], place[at], bits))

    def hits(self, words: Words) -> Iterator[np.ndarray]:
        """Diagonals with a hit, some at a time, as numbers that diagonals() takes apart.

        Where a text and an item repeat themselves with the same step, a hit that follows from the one a step before on
        the same diagonal is left out, so that repeated words don't multiply.
        """
        text_of = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        longest = int(self.sizes.max(initial=0))
        for offs, values, keys, item, place, bits in self.tables:
            if not len(values):
                continue
            mine = chain(words.hash, offs, len(words) - offs[-1])
            at = np.flatnonzero(bits[(mine >> np.uint64(64 - PREFILTER_BITS)).astype(np.int64)])
            group = np.searchsorted(values, mine[at])
            group[group == len(values)] = 0
            equal = values[group] == mine[at]
            at, group = at[equal], group[equal]
            if not len(at):
                continue
            step = np.zeros(len(at), dtype=np.int64)
            for q in range(PERIODS, 0, -1):
                back = np.maximum(at - q, 0)
                step[(at >= q) & (mine[back] == mine[at]) & (text_of[back] == text_of[at])] = q
            key = group * (PERIODS + 1)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key + PERIODS, "right")
            # entries of the same step are left out
            out_lo = np.where(step > 0, np.searchsorted(keys, key + step), lo)
            out_hi = np.where(step > 0, np.searchsorted(keys, key + step, "right"), lo)
            at, lo, n = np.concatenate([at, at]), np.concatenate([lo, out_hi]), np.concatenate([out_lo - lo, hi - out_hi])
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            total = np.cumsum(n)
            a = 0
            while a < len(n):
                # at least one position, then as many as make a chunk
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
                where = _ranges(lo[a:b], n[a:b])
                text = np.repeat(text_of[at[a:b]], n[a:b])
                diagonal = np.repeat(at[a:b], n[a:b]) - words.bounds[text] - place[where]
                yield np.unique((text * len(self.sizes) + item[where]) * (longest + len(words)) + diagonal + longest)
                a = b

    def diagonals(self, words: Words) -> np.ndarray:
        """Rows of text, item and the first word of the text less that of the item, where there is a hit."""
        found = [x for x in self.hits(words)]
        if not found:
            return np.empty((0, 3), dtype=np.int64)
        longest = int(self.sizes.max())
        pair, diagonal = np.divmod(np.unique(np.concatenate(found)), longest + len(words))
        return np.stack([pair // len(self.sizes), pair % len(self.sizes), diagonal - longest], 1)

    def promising(self, words: Words, found: np.ndarray) -> np.ndarray:
        """The diagonals of found on which some window has matches enough for an overlap, and all of short items."""
        text, item, diagonal = found.T
        lo = np.maximum(0, -diagonal)
        n = np.minimum(self.sizes[item], np.diff(words.bounds)[text] - diagonal) - lo
        least = self.min_words
        need = least - (100 - MATCHING) * (2 * least - 1) // 100
        keep = self.sizes[item] < least
        total = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
            mine = _ranges(words.bounds[text[a:b]] + lo[a:b] + diagonal[a:b], n[a:b])
            theirs = _ranges(self.bounds[item[a:b]] + lo[a:b], n[a:b])
            sums = np.concatenate([[0], np.cumsum(words.hash[mine] == self.words[theirs])])
            ends = np.cumsum(n[a:b])
            first, last = ends - n[a:b], ends
            good = np.flatnonzero(sums[least:] - sums[:-least] >= need) if len(sums) > least else np.empty(0, np.int64)
            # windows that start in a diagonal and end in it
            keep[a:b] |= np.searchsorted(good, first) < np.searchsorted(good, np.maximum(first, last - least + 1))
            a = b
        return found[keep]

    def overlaps(self, words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Verified overlaps: text, item, first word in the text, first word in the item, words, matching words."""
        best: dict[tuple[int, int], tuple[int, ...]] = {}
        for t, i, d in self.promising(words, self.diagonals(words)).tolist():
            size = int(self.sizes[i])
            if best.get((t, i), (0,))[0] > (100 - MATCHING) * size:
                continue  # all of the item is there, word by word
            mine, theirs = words.hash[words.bounds[t] : words.bounds[t + 1]], self.words[self.bounds[i] : self.bounds[i + 1]]
            lo, hi = max(0, -d), min(size, len(mine) - d)
            same = mine[lo + d : hi + d] == theirs[lo:hi]
            if size <= self.min_words:
                # an item that is short itself is taken as a whole, whichever of its words differ
                run = (0, size) if len(same) == size and 100 * int(same.sum()) >= MATCHING * size else None
            else:
                run = long_run(same, self.min_words)
            if run is None:
                continue
            start, end = run
            matched = int(same[start:end].sum())
            # over 0 also where just enough words match
            score = 100 * matched - MATCHING * (end - start) + 1
            if score > best.get((t, i), (0,))[0]:
                best[t, i] = (score, lo + d + start, lo + start, end - start, matched)
        for (t, i), (_, s, p, n, m) in best.items():
            yield t, i, s, p, n, m


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    min_words: int = 12,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """Overlaps of training documents with test items: one row for each document row and item, the best overlap.

    Returns id_column, item_column, doc_start, item_start (word positions), n_words, n_matched. An overlap counts from
    min_words words, or the whole item where that is shorter; words are runs of bytes other than ASCII white space, A-Z
    lower-cased; substituted words are tolerated as long as MATCHING % match, inserted or deleted ones end an overlap. With
    min_words of 12 or more every overlap is found. The best of a document and an item is the one furthest over MATCHING %.
    Null, empty or white-space texts and items overlap with nothing. Equal documents and equal items each give their rows; rows with a null id keep the
    null. Other columns are not read. Empty tables give an empty result.

    Test items are read in blocks of about block_chars characters (an item is in one block), which bounds what is sent to
    the executors; each block is joined with all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    items = items.select(F.col(item_column).cast("long").alias("id"), F.col(item_text_column).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    schema = f"`{id_column}` long, `{item_column}` long, doc_start long, item_start long, n_words long, n_matched long"
    out = None
    items = saved(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))))
    for block in range(blocks):
        rows = items.where(F.col("block") == block).orderBy("id", "text").collect()
        seeds = spark.sparkContext.broadcast((Seeds([r.id for r in rows], [r.text for r in rows], min_words)))

        def search(batch, seeds=seeds):
            own = seeds.value
            ids = batch.column(0)
            for lo, hi, texts in slices(batch.column(1)):
                found = list(own.overlaps(texts.words()))
                if found:
                    t, i, s, p, n, m = (list(x) for x in zip(*found, strict=True))
                    yield pa.record_batch(
                        [ids.slice(lo, hi - lo).take(pa.array(t)), pa.array([own.ids[x] for x in i], pa.int64()), *[pa.array(x, pa.int64()) for x in (s, p, n, m)]],
                        names=[id_column, item_column, "doc_start", "item_start", "n_words", "n_matched"],
                    )

        part = docs.mapInArrow(per_batch(search), schema)
        out = part if out is None else out.union(part)
    return out
