"""Line dedup by a log-template tree.

A line's path in the tree is its number of tokens and its first tokens; tokens with a digit are variable and stand as one
wildcard. At a leaf, lines that agree in enough places share a template, in which the places that differ become wildcards.
Templates that lines of several documents share recur; their lines are dropped, but for the first document that has them.

Lines too short for a template recur only as they are: those with the same tokens, digits included, share a template.
Equal masked lines share a template by hash alone. Only leaves where several documents have different lines are parsed
further, on one line for each hash and in the order of the hashes; every line is held against every template it can agree
with, however many lines a leaf has.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_in, per_batch, saved, small_batches
from .textbytes import SPACE, chain, mix, signed, slices

DEPTH, AGREE, MIN_TOKENS, MIN_DOCS, CHUNK = 4, 0.7, 5, 2, 2000  # CHUNK: rows worked on or given out at once
#: Documents in which a line of fewer than MIN_TOKENS tokens recurs, and what tells its hash from a longer line's.
SHORT_DOCS, SHORT = 3, 1 << 40
#: Lines of a leaf from which templates are looked up instead of tried one by one; the result is the same.
INDEXED = 64
WILDCARD = "<*>"
_VARIABLE = np.uint64(0x2A2A2A2A2A2A2A2A)


def _lines(min_tokens: int):
    def make(batch):
        for lo, hi, texts in slices(batch.column(1), lower=False):
            data = texts.data
            words = texts.words(SPACE)
            digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
            tokens = np.where(digits[words.end] > digits[words.start], _VARIABLE, words.hash)
            feeds = np.flatnonzero(data == 10)
            # a line starts where a text starts and after each line feed
            starts = np.union1d(texts.offsets[:-1][np.diff(texts.offsets) > 0], feeds[feeds + 1 < len(data)] + 1) if len(data) else np.empty(0, np.int64)
            doc = np.searchsorted(texts.offsets, starts, side="right") - 1
            first = np.searchsorted(words.start, starts)
            bounds = np.append(first, len(words))
            size = np.diff(bounds)
            # number of the line in its text
            head = np.searchsorted(starts, texts.offsets[doc])
            number = np.arange(len(starts)) - head
            # a trailing empty line has no tokens and needs no row
            power = np.cumprod(np.full(max(int(size.max(initial=0)), 1), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64))
            place = np.arange(len(words)) - np.repeat(first, size)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens) * power[place], dtype=np.uint64)])
            line_hash = mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64))
            short = size < min_tokens
            if short.any():
                # short lines go by all their bytes, digits too
                exact = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash) * power[place], dtype=np.uint64)])
                line_hash = np.where(short, mix(exact[bounds[1:]] - exact[bounds[:-1]] + (size + SHORT).astype(np.uint64)), line_hash)
            fit = np.flatnonzero(size >= 1)
            leaf = np.zeros(len(fit), dtype=np.uint64)
            deep = np.minimum(size[fit], DEPTH)
            for d in np.unique(deep):
                at = fit[deep == d]
                lead = np.zeros(len(at), dtype=np.uint64)
                for i in range(d):
                    lead = lead * np.uint64(0xD6E8FEB86659FD93) + tokens[first[at] + i]
                leaf[deep == d] = mix(lead + size[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            # a leaf of its own, so that nothing merges with it
            leaf = np.where(short[fit], line_hash[fit], leaf)
            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(doc[fit]))
            text_key = batch.column(2).slice(lo, hi - lo).take(pa.array(doc[fit]))
            yield pa.record_batch([ids, text_key, pa.array(number[fit].astype(np.int64)), pa.array(signed(leaf)), pa.array(signed(line_hash[fit]))], names=["doc_id", "text_key", "line", "leaf", "hash"])

    return make


def masked(line: str) -> list[str]:
    """A line's tokens, variable ones as the wildcard."""
    return [WILDCARD if re.search("[0-9]", t) else t for t in re.split("[\x20\x09-\x0d]+", line.strip("\x20\x09\x0a\x0b\x0c\x0d"))]


def merge(lines: list[list], agree: float = AGREE, wildcard=WILDCARD) -> tuple[list[int], list[list]]:
    """Parses lines of one leaf in order: for each the number of its template, and the templates with their wildcards."""
    templates: list[list] = []
    of = []
    for tokens in lines:
        best, where = -1.0, -1
        for i, t in enumerate(templates):
            same = sum(a == b for a, b in zip(t, tokens, strict=True)) / len(t)
            if same > best:
                best, where = same, i
        if where >= 0 and best >= agree:
            templates[where] = [a if a == b else wildcard for a, b in zip(templates[where], tokens, strict=True)]
        else:
            where = len(templates)
            templates.append(tokens)
        of.append(where)
    return of, templates


def parse(rows: np.ndarray, agree: float = AGREE) -> np.ndarray:
    """What merge() gives for lines of numbered tokens (0 is the wildcard): for each line the number of its template.

    Only places that differ between lines can part them. Cut into one block more than the places that may differ, a line
    and a template that agree enough are equal in a whole block, so templates are looked up by their blocks and compared.
    """
    n, size = rows.shape
    need = next(k for k in range(size + 1) if k / size >= agree)
    places = np.flatnonzero((rows != rows[0]).any(axis=0))
    if len(places) <= size - need:
        return np.zeros(n, dtype=np.int64)
    need -= size - len(places)
    rows = np.ascontiguousarray(rows[:, places])
    cuts = np.linspace(0, len(places), len(places) - need + 2).astype(np.int64)[:-1]
    factor = mix(np.arange(1, len(places) + 1, dtype=np.uint64))
    blocks = lambda r: np.add.reduceat(mix(r.astype(np.uint64) + np.uint64(1)) * factor, cuts, axis=-1)
    templates = np.empty_like(rows)
    found: list[dict[int, list[int]]] = [{} for _ in cuts]
    of, count = np.empty(n, dtype=np.int64), 0
    for lo in range(0, n, CHUNK):
        for i, keys in enumerate(blocks(rows[lo : lo + CHUNK]).tolist(), lo):
            near = sorted({t for k, held in zip(keys, found, strict=True) for t in held.get(k, ())})
            where, best = -1, -1
            if near:
                same = (templates[near] == rows[i]).sum(axis=1)
                at = int(same.argmax())
                where, best = near[at], int(same[at])
            if best >= need:
                wider = np.where(templates[where] == rows[i], rows[i], 0)
                before, after = blocks(templates[where]).tolist(), blocks(wider).tolist()
                for old, new, held in zip(before, after, found, strict=True):
                    if old != new:
                        held[old].remove(where)
                        held.setdefault(new, []).append(where)
                templates[where] = wider
            else:
                where = count
                templates[count] = rows[i]
                count += 1
                for k, held in zip(keys, found, strict=True):
                    held.setdefault(k, []).append(where)
            of[i] = where
    return of


def _merged(rows: DataFrame) -> DataFrame:
    """Parses rows (leaf, hash, template) leaf by leaf in the order of hash: (leaf, hash, into), into being the least hash of a template.

    Leaves are sorted runs of a partition's rows and are read as a stream, so that a task holds one leaf at a time, its
    tokens as numbers.
    """

    def run(batches):
        hashes: list[int] = []
        lines: list[np.ndarray] = []
        numbers: dict[str, int] = {}
        key = None
        out: list[pa.RecordBatch] = []

        def end():
            if len(lines) < INDEXED:
                of = np.array(merge([x.tolist() for x in lines], wildcard=0)[0])
            else:
                of = parse(np.stack(lines))
            line = np.array(hashes, dtype=np.int64)
            # templates are numbered in the order of their first lines
            into = line[np.unique(of, return_index=True)[1]][of]
            out.append(pa.record_batch({"leaf": pa.array(np.full(len(line), key)), "hash": pa.array(line), "into": pa.array(into)}))

        def given():
            whole = pa.Table.from_batches(out).combine_chunks()
            out.clear()
            return whole.to_batches(max_chunksize=CHUNK)

        for batch in batches:
            for leaf, line, template in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if leaf != key:
                    if lines:
                        end()
                    hashes, lines, numbers, key = [], [], {WILDCARD: 0}, leaf
                hashes.append(line)
                tokens = template.split(" ")
                lines.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int32, len(tokens)))
            if out:
                yield from given()
        if lines:
            end()
            yield from given()

    sorted_ = rows.select("leaf", "hash", "template").repartition("leaf").sortWithinPartitions("leaf", "hash")
    return sorted_.mapInArrow(run, "leaf long, hash long, into long")


def recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """Lines of templates that recur in at least min_docs documents, one row for each row of docs and line; lines of fewer
    than min_tokens tokens count only with equal ones, from short_docs documents on.

    Returns id_column, text_key (a hash of the text: rows may repeat an id), line (number from 0), template_id, n_docs and
    dropped (false in the document with the smallest id, which keeps its lines). Lines end at line feeds; tokens are runs of
    other than ASCII white space; lines without tokens are never dropped. Repetition inside one document is no recurrence, nor are repeated rows of one id. Null and empty texts have no lines; rows with a null id are left out.
    Other columns aren't read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    lines = saved(docs.mapInArrow(per_batch(_lines(min_tokens)), "doc_id long, text_key long, line long, leaf long, hash long"))
    kinds = saved(lines.groupBy("leaf", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "text_key", "line")).alias("at")))
    # written before they are joined, so that the rows of a large leaf or template can be split
    mixed = kinds.groupBy("leaf").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("least").alias("least"), F.max("most").alias("most")).where("a <> b AND least <> most").select("leaf")
    mixed = saved(mixed)
    wanted = saved(kinds.join(mixed, "leaf").select("leaf", "hash", "at.*"))
    # one line's tokens for each hash that needs them
    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line", "leaf", "hash")).alias("asked"))
    fetch = maybe_in(docs, "doc_id", bitmap(wanted, "doc_id")).join(per_doc, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    tokens = saved(
        fetch.select(F.split("text", "\n", -1).alias("rows"), F.explode("asked").alias("a"))
        .select("a.leaf", "a.hash", F.expr("element_at(rows, CAST(a.line + 1 AS INT))").alias("row"))
        .select("leaf", "hash", F.expr(r"array_join(transform(filter(split(row, '[\\x20\\x09-\\x0d]+'), t -> t <> ''), t -> if(t rlike '[0-9]', '<*>', t)), ' ')").alias("template"))
    )
    done = _merged(tokens)
    named = lines.join(done, ["leaf", "hash"], "left").withColumn("template_id", F.coalesce("into", "hash"))
    named = saved(named.select("doc_id", "text_key", "line", "leaf", "template_id"))
    counts = named.groupBy("leaf", "template_id", "doc_id").agg(F.count("*").alias("times")).groupBy("leaf", "template_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")).where(F.col("n_docs") >= F.when(F.col("leaf") == F.col("template_id"), short_docs).otherwise(min_docs))
    counts = saved(counts)
    return named.join(counts, ["leaf", "template_id"]).select(F.col("doc_id").alias(id_column), "text_key", "line", "template_id", "n_docs", (F.col("doc_id") != F.col("first")).alias("dropped"))


def drop_lines(docs: DataFrame, lines: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the dropped lines of recurring_lines; texts of which no line is left become empty, null texts stay."""
    gone = lines.where("dropped").groupBy(F.col(id_column).alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("line").alias("__lines"))
    keyed = docs.withColumn("__text", F.col(text_column)).withColumn("__key_", F.xxhash64("__text"))
    joined = keyed.join(gone, (F.col(id_column) == F.col("__id")) & (F.col("__key_") == F.col("__key")), "left")
    # by the set of the numbers that stay, in a time proportional to the lines
    split = joined.withColumn("__rows", F.when(F.col("__lines").isNotNull(), F.split("__text", "\n", -1)))
    numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__rows") - F.lit(1).cast("long")), F.col("__lines"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get("__rows", i.cast("int"))), "\n")
    return split.withColumn(text_column, F.when(F.col("__lines").isNull(), F.col("__text")).otherwise(kept)).drop("__id", "__key", "__key_", "__lines", "__text", "__rows")
