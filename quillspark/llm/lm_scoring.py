"""Cross-entropy difference of matched n-gram models.

Target and background are bigram models of the same form over one vocabulary, all words of the corpus. With the counts c,
    P(w | v) = (c(v, w) + strength * P(w)) / (c(v) + strength),  P(w) = (c(w) + 1) / (tokens + words of the vocabulary).
A document's score is the mean over its tokens of the target's loss less the background's, in nats: lower means closer to
the target.

Counts are kept for every word (56 bits of its hash) and pair (48 bits), grow with the corpus and are never in one place:

1. Texts are read in runs of about RUN tokens. A run sends its distinct words and pairs, with their counts in it, to parts
   by hash; a part is one row of packed arrays, so a word in every text is one entry for each run.
2. A part adds up its entries and answers every run with the totals of what the run has sent, in the same order.
3. A run's tokens, as places among its distinct words, meet the answers, and its documents are scored.

The number of parts follows the length of all texts, so a part's and a run's memory are bounded whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_in, saved, settled, small_batches
from .textbytes import mix, slices

STRENGTH, RUN, PART_CHARS, LEAST_PARTS = 4.0, 3 << 18, 6 << 20, 64
#: Bits of a hash that stand for a word and for a pair.
WORD_MASK, PAIR_MASK = np.uint64((1 << 64) - (1 << 8)), np.uint64((1 << 64) - (1 << 16))
#: What stands before a text's first word.
BOUNDARY = np.uint64(0x9E3779B97F4A7C00)
_SENT = "task int, run int, part int, words binary, as_word binary, as_context binary, pairs binary, as_pair binary"
_ANSWER = "task int, run int, part int, words binary, pairs binary, vocabulary long, background long, target long"


def _packed(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers before their second bytes: most are small."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(packed: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(x: np.ndarray) -> bytes:
    """Sorted hashes, as differences."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, np.uint64), dtype=np.uint64)


def _runs(batches, size: int):
    """The texts of a partition in runs: first the ids, then sizes in words, then the hashes of all words."""
    ids, sizes, words, held = [], [], [], 0
    for batch in batches:
        for lo, hi, texts in slices(batch.column(1)):
            own = texts.words()
            ids.append(batch.column(0).slice(lo, hi - lo))
            sizes.append(np.diff(own.bounds))
            words.append(own.hash & WORD_MASK)
            held += len(own)
            if held >= size:
                yield pa.chunked_array(ids, pa.int64()), np.concatenate(sizes), np.concatenate(words)
                ids, sizes, words, held = [], [], [], 0
    if ids:
        yield pa.chunked_array(ids, pa.int64()), np.concatenate(sizes), np.concatenate(words)
    del ids, sizes, words
    pa.default_memory_pool().release_unused()


def _before(places: np.ndarray, sizes: np.ndarray, boundary: int) -> np.ndarray:
    """The place of the word before each word."""
    before = np.empty_like(places)
    before[1:] = places[:-1]
    heads = np.cumsum(sizes) - sizes
    before[heads[sizes > 0]] = boundary
    return before


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part, out of fewer than 2 ** 32, that each hash belongs to."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Run:
    """A run's distinct words (the boundary last) and pairs, and the parts they belong to."""

    def __init__(self, words: np.ndarray, places: np.ndarray, sizes: np.ndarray, parts: int):
        self.words, n = np.append(words, BOUNDARY), len(words)
        before = _before(places, sizes, n)
        both, self.pair_at, self.pair_counts = np.unique(before * (n + 1) + places, return_inverse=True, return_counts=True)
        self.first, self.second = both // (n + 1), both % (n + 1)
        self.pairs = mix(self.words[self.first] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.second]) & PAIR_MASK
        self.as_word, self.as_context = np.bincount(places, minlength=n + 1), np.bincount(before, minlength=n + 1)
        self.word_order, self.pair_order = np.argsort(self.words, kind="stable"), np.argsort(self.pairs, kind="stable")
        # a part is a range of hashes; the parts of the sorted words and pairs
        self.word_parts, self.pair_parts = _part(self.words[self.word_order], parts), _part(self.pairs[self.pair_order], parts)

    def of_part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a part's words and pairs, in the order of their hashes."""
        a, b = np.searchsorted(self.word_parts, [k, k + 1])
        c, d = np.searchsorted(self.pair_parts, [k, k + 1])
        return self.word_order[a:b], self.pair_order[c:d]

    def sent(self):
        """For each part with an entry: its number, words, their counts as words and contexts, pairs and their counts.

        Only parts that the run has something for are looked at, so that its work doesn't grow with their number.
        """
        for k in np.union1d(self.word_parts, self.pair_parts).tolist():
            w, p = self.of_part(k)
            yield k, self.words[w], self.as_word[w].astype(np.uint32), self.as_context[w].astype(np.uint32), self.pairs[p], self.pair_counts[p].astype(np.uint32)


def _send(parts: int, size: int, of_target: bool):
    def send(batches):
        task = TaskContext.get().partitionId()
        for number, (_, sizes, words) in enumerate(_runs(batches, size)):
            if not len(words):
                continue
            found, places = np.unique(words, return_inverse=True)
            rows = list(zip(*Run(found, places, sizes, parts).sent(), strict=True))
            packed = [pa.array([(_packed_keys if x.dtype == np.uint64 else _packed)(x) for x in column], pa.binary()) for column in rows[1:]]
            n = len(rows[0])
            yield pa.record_batch([pa.array([task] * n, pa.int32()), pa.array([-1 if of_target else number] * n, pa.int32()), pa.array(rows[0], pa.int32()), *packed], names=["task", "run", "part", "words", "as_word", "as_context", "pairs", "as_pair"])

    return send


def _tokens(size: int):
    def tokens(batches):
        task = TaskContext.get().partitionId()
        for number, (ids, sizes, words) in enumerate(_runs(batches, size)):
            found, places = np.unique(words, return_inverse=True)
            ids = ids.combine_chunks()
            yield pa.record_batch(
                [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (_packed(sizes.astype(np.int64)), _packed_keys(found), _packed(places.astype(np.uint32)))]],
                names=["task", "run", "ids", "sizes", "words", "places"],
            )

    return tokens


def _totals(group: pa.Table) -> pa.Table:
    """Adds up one part's entries and answers its runs: counts in background and target, for words as words and as contexts."""
    runs = np.asarray(group["run"])
    answers: dict[str, list[bytes]] = {}
    facts = [0, 0, 0]
    for keys, counts in (("words", ("as_word", "as_context")), ("pairs", ("as_pair",))):
        sent = [_unpacked_keys(x) for x in group[keys].to_pylist()]
        ends = np.cumsum([0, *map(len, sent)])
        found, at = np.unique(np.concatenate(sent), return_inverse=True)
        target = np.repeat(runs < 0, np.diff(ends))
        sums = []
        for name in counts:
            n = np.concatenate([_unpacked(x, np.uint32) for x in group[name].to_pylist()])
            sums += [np.bincount(at, np.where(target, 0, n), len(found)).astype(np.int64), np.bincount(at, np.where(target, n, 0), len(found)).astype(np.int64)]
        if keys == "words":
            facts = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
        table = np.stack(sums)
        answers[keys] = [_packed(table[:, at[a:b]].ravel()) for a, b, r in zip(ends[:-1], ends[1:], runs, strict=True) if r >= 0]
    asked = np.flatnonzero(runs >= 0)
    out = [group["task"].take(pa.array(asked)).to_pylist(), runs[asked].tolist(), group["part"].take(pa.array(asked)).to_pylist(), answers["words"], answers["pairs"]]
    # one more row says how many words and tokens the part has
    whole = [[None, None, None, None, None, *facts]]
    rows = [[*x, None, None, None] for x in zip(*out, strict=True)] + whole
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 3
    names = ["task", "run", "part", "words", "pairs", "vocabulary", "background", "target"]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", strength: float = STRENGTH, run: int = RUN, part_chars: int = PART_CHARS
) -> DataFrame:
    """Scores each row of docs; target holds the id_column values of the documents that the target model is counted on.

    The background model is counted on all of docs. Returns id_column, n_tokens, target_loss, background_loss, score (the
    difference of both, means per token). Words are runs of bytes other than ASCII white space, A-Z lower-cased. A null or
    empty text, or one of white space, has no tokens, losses of 0 and a score of 0. Repeated rows are counted and scored
    each; rows with a null id are background only. With no target at all its model is uniform. Other columns aren't read; an
    empty table gives an empty result. docs is read twice, each time in the same partitions: what isn't read straight from
    files is written to the checkpoint folder first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = settled(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")))
    wanted = saved(target.select(F.col(id_column).cast("long").alias("id")).where("id IS NOT NULL").distinct())
    # only texts that may be the target's are shuffled to find those that are
    of_target = maybe_in(rows, "id", bitmap(wanted, "id")).join(wanted, "id", "left_semi").select("id", "text")
    parts = max(LEAST_PARTS, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars)
    sent = rows.mapInArrow(_send(parts, run, False), _SENT).union(of_target.mapInArrow(_send(parts, run, True), _SENT))
    answers = saved(sent.groupBy("part").applyInArrow(_totals, _ANSWER))
    facts = answers.where("task IS NULL").agg(F.sum("vocabulary"), F.sum("background"), F.sum("target")).first()
    vocabulary, background, in_target = (int(x or 0) for x in facts)

    def score(answered: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for t in told.to_pylist():
            sizes, found, places = _unpacked(t["sizes"], np.int64), _unpacked_keys(t["words"]), _unpacked(t["places"], np.uint32).astype(np.int64)
            means = [np.zeros(len(sizes)), np.zeros(len(sizes))]
            if len(places):
                own = Run(found, places, sizes, parts)
                by_word, by_pair = np.zeros((4, len(own.words)), dtype=np.int64), np.zeros((2, len(own.pairs)), dtype=np.int64)
                n = 0
                for k, w, p in zip(*(answered[c].to_pylist() for c in ("part", "words", "pairs")), strict=True):
                    at_w, at_p = own.of_part(k)
                    by_word[:, at_w] = _unpacked(w, np.int64).reshape(4, len(at_w))
                    by_pair[:, at_p] = _unpacked(p, np.int64).reshape(2, len(at_p))
                    n += len(at_p)
                if n != len(own.pairs) or not by_pair[0].all():
                    raise RuntimeError("docs came in other partitions when read again")
                ends = np.cumsum(sizes)
                for model, (word, context, pair, tokens) in enumerate(((by_word[1], by_word[3], by_pair[1], in_target), (by_word[0], by_word[2], by_pair[0], background))):
                    unigram = (word + 1.0) / (tokens + vocabulary)
                    loss = np.log(context[own.first] + strength) - np.log(pair + strength * unigram[own.second])
                    sums = np.concatenate([[0.0], np.cumsum(loss[own.pair_at])])  # of one run: short enough to stay exact to 1e-9
                    means[model] = np.where(sizes, (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1), 0.0)
            for column, values in zip(out, (t["ids"], sizes.tolist(), means[0].tolist(), means[1].tolist()), strict=True):
                column.extend(values)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "n_tokens", "target_loss", "background_loss"])

    told = rows.mapInArrow(_tokens(run), "task int, run int, ids array<long>, sizes binary, words binary, places binary")
    scored = answers.where("task IS NOT NULL").select("task", "run", "part", "words", "pairs").groupBy("task", "run").cogroup(told.groupBy("task", "run")).applyInArrow(score, "id long, n_tokens long, target_loss double, background_loss double")
    return scored.select(F.col("id").alias(id_column), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
