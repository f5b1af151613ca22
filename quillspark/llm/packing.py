"""Packing by minimum bin slack.

A document's tokens are cut into full windows and a rest. Rests are packed by a plan made from the counts of their lengths
alone: for each window the longest rest left is put in, and a bitset subset-sum over the lengths left finds the multiset that
fills the window closest to capacity; backtracking gives the counts, and the pattern is used as often as the counts allow.
Each pattern uses up some length, so the plan has about as many patterns as there are lengths, however many documents.
Ranks among the rests of equal length then place every piece without looking at any other.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, saved, small_batches

_LONG_SPACE = re.compile(r"\s{20000}")


class Encoder:
    """Token ids as tokenizers gives them for a byte-level BPE file, without special tokens added.

    The same merges are run by tiktoken, several times faster; a file that it can't run, and a text with a very long run of white space, on
    which its pattern fails, are left to tokenizers itself.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
            special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.special = frozenset(special)
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        except (KeyError, ValueError):
            self.fast = None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _LONG_SPACE.search(text):
            try:
                ids = self.fast.encode(text, allowed_special=self.special) if any(s in text for s in self.special) else self.fast.encode_ordinary(text)
                return np.array(ids, dtype=np.uint32)
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to room, by bitset subset-sum with backtracking."""
    mask, reach = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> count) and how often each is used; together they use every count exactly."""
    left = {n: c for n, c in counts.items() if c}
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill(left, window - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        patterns.append((used, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return patterns


def layout(patterns: list[tuple[dict[int, int], int]], first_sequence: int) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks: the first rank, the pattern's first sequence, pieces per sequence, offset of the first."""
    rows = []
    done: dict[int, int] = {}
    sequence = first_sequence
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, done.get(length, 0), sequence, used[length], offset))
            done[length] = done.get(length, 0) + used[length] * times
            offset += length * used[length]
        sequence += times
    rows.sort()
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return dict(zip(("length", "rank", "sequence", "each", "offset"), (np.array(c, dtype=np.int64) for c in columns), strict=True))


def pack(docs: DataFrame, tokenizer: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs every row's tokens and one end_id after them into sequences of at most window tokens.

    Returns a row for each piece: id_column, start, length, ids_crc32 (of the piece's ids, unsigned little-endian 32 bit),
    doc_tokens (with the end), sequence_id, offset. A null text is empty, so it has the end alone. Repeated rows and null
    ids are packed like any other; other columns aren't read; an empty table gives an empty result. Full windows are cut
    first; only rests are combined, and a sequence has no gaps.

    Pieces and counts are written to the checkpoint folder before they are numbered, so a lost executor changes nothing.
    The plan's size is bounded by the window; counts by task and length are summed where they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def cut(batches):
        encode = encoder(tokenizer, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for column, value in zip(rows, (k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(r, pa.int64()) for r in rows[1:]], pa.array([task] * len(rows[0]), pa.int64())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "own_rank", "task"],
            )

    pieces = saved(docs.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long, own_rank long, task long"))
    counts = saved(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    full = totals.pop(window, 0)
    ranges = docs.sparkSession.sparkContext.broadcast(layout(plan(totals, window), full))
    before = counts.selectExpr("task", "length", "sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead")

    def place(batch):
        own = ranges.value
        length, rank = (np.asarray(batch.column(i)) for i in (2, 5))
        # ranges are sorted by length and first rank; the last one that starts at or before a piece is its own
        top = int(max(own["rank"].max(initial=0), rank.max(initial=0))) + 1
        at = np.searchsorted(own["length"] * top + own["rank"], length * top + rank, side="right") - 1
        whole = length == window
        if len(own["length"]):
            at = np.maximum(at, 0)
            ahead = rank - own["rank"][at]
            each = own["each"][at]
            sequence = np.where(whole, rank, own["sequence"][at] + ahead // each)
            offset = np.where(whole, 0, own["offset"][at] + ahead % each * length)
        else:
            sequence, offset = rank, np.zeros_like(rank)
        yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(before, ["task", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own_rank") + F.coalesce("ahead", F.lit(0))).alias("rank"))
    schema = f"`{id_column}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(per_batch(place), schema)
