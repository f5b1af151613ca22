"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its distinct words and the distinct beginnings (4, 5 and 6 bytes) of its words, lower-cased, each
hashed to one of 2 ** BITS places; none is left out. A feature's value grows with the significance of its association with
the label on the labelled texts, so that chance ones weigh little. A logistic model is fitted with an L2 penalty and a
counterfactual one: every labelled text has a copy, in which the identity terms that it names are swapped within their group
of terms, or, if it names none, one is mentioned, and the squared difference of both logits is penalised. So a neutral
mention of a group cannot by itself move a score, whether or not the labelled texts name it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe_in, per_batch, saved, small_batches
from .textbytes import SPACE, Words, mix, slices, texts_of

#: Terms that may replace each other in a sentence, by language and kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american"), ("immigrants", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("ausländer", "inländer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("extranjeros", "españoles"),
)
PREFIXES = (4, 5, 6)
BITS = 20
#: Rows that are added to a feature's when its significance is taken, and the square of it at which a feature has half its value.
SMOOTHING, HALF = 10.0, 50.0
#: Words end at white space and ASCII punctuation.
BREAKS = SPACE.copy()
BREAKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def features(words: Words) -> list[np.ndarray]:
    """For each text the sorted places of its distinct features."""
    size = words.end - words.start
    place = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int32)
    kinds = [place(words.hash)]
    for n in PREFIXES:
        # a beginning is not the same feature as a word of its length; a word that is no longer has none
        beginning = mix(words.span_hash(words.start, np.minimum(words.start + n, words.end)) ^ np.uint64(0x9E3779B97F4A7C15 + n))
        kinds.append(np.where(size > n, place(beginning), np.int32(-1)))
    table = np.stack(kinds, 1)
    out = []
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        found = np.unique(table[lo:hi])
        out.append(found[1:] if len(found) and found[0] < 0 else found)
    return out


def term_swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By a term's word hash: the features it gives a text and those of the term that replaces it."""
    swaps = {}
    for group in groups:
        words = texts_of(list(group)).words(BREAKS)
        own = features(words)
        for i in range(len(group)):
            swaps[int(words.hash[i])] = (own[i], own[(i + 1) % len(group)])
    return swaps


@dataclass
class Model:
    #: what each feature's place adds to the logit
    weights: np.ndarray
    bias: float

    def logits(self, words: Words) -> np.ndarray:
        return np.array([self.bias + float(self.weights[own].sum()) for own in features(words)])

    def scores(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(words), -40, 40)))


def values(one: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """The value, from 0 to 1, of each feature that seen rows have, one of which are labelled 1; share is that of all rows."""
    square = (one - seen * share) ** 2 / ((seen + SMOOTHING) * max(share * (1 - share), 1e-9))
    return square / (square + HALF)


def fit(rows: list[np.ndarray], gone: list[np.ndarray], come: list[np.ndarray], labels: np.ndarray, value: np.ndarray, l2: float = 1e-4, counterfactual: float = 5.0, passes: int = 6, rate: float = 0.2) -> Model:
    """Fits weights row by row, each step scaled by the coordinate's gradients so far.

    rows holds the texts' features; a text's counterfactual copy has come instead of gone, which share no feature.
    """
    n, positive = len(labels), float(labels.sum())
    w = np.zeros(len(value))
    if not n or positive in (0, n):
        share = (positive + 0.5) / (n + 1)
        return Model(w, float(np.log(share / (1 - share))))
    size, size_b = np.full(len(value), 1e-3), 1e-3
    b = float(np.log(positive / (n - positive)))
    order = np.random.default_rng(1)
    for _ in range(passes):
        for i in order.permutation(n).tolist():
            own = rows[i]
            x, at = value[own], w[own]
            error = 1 / (1 + np.exp(-min(max(b + float(at @ x), -40.0), 40.0))) - labels[i]
            step = error * x + l2 * at
            size[own] += step * step
            w[own] = at - rate * step / np.sqrt(size[own])
            size_b += error * error
            b -= rate * error / np.sqrt(size_b)
            if len(gone[i]) or len(come[i]):
                gap = float(w[gone[i]] @ value[gone[i]] - w[come[i]] @ value[come[i]])
                for places, sign in ((gone[i], 1.0), (come[i], -1.0)):
                    step = counterfactual * gap * sign * value[places]
                    size[places] += step * step
                    w[places] -= rate * step / np.sqrt(size[places])
    return Model(w * value, b)


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "toxic", **options) -> Model:
    """Fits the model on the labelled rows, whose number train_on bounds.

    Rows with a null label are left out; a null text is empty. Rows of equal text and label count once. Without both labels
    the model gives their prior alone. Options go to fit.
    """
    small_batches(labelled.sparkSession)
    swaps = labelled.sparkSession.sparkContext.broadcast(term_swaps())
    rows = labelled.where(F.col(label_column).isNotNull()).select(F.coalesce(F.col(text_column), F.lit("")).alias("text"), (F.col(label_column) != 0).alias("y"))
    sample = saved(rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"])).select("text", "y")

    def places(batch):
        terms = sorted(swaps.value)
        lists = pa.list_(pa.int32())
        for lo, hi, texts in slices(batch.column(0)):
            words = texts.words(BREAKS)
            mine, gone, come = features(words), [], []
            for i, own in enumerate(mine):
                hashes = np.unique(words.hash[words.bounds[i] : words.bounds[i + 1]])
                named = [swaps.value[h] for h in hashes.tolist() if h in swaps.value]
                if named:
                    out, into = (np.unique(np.concatenate(x)) for x in zip(*named, strict=True))
                    gone.append(np.setdiff1d(out, into))
                    come.append(np.setdiff1d(into, own))
                else:
                    # the mention of one term, drawn by the text's words
                    gone.append(own[:0])
                    come.append(np.setdiff1d(swaps.value[terms[int(hashes.sum(dtype=np.uint64) % np.uint64(len(terms)))]][0], own))
            yield pa.record_batch([batch.column(1).slice(lo, hi - lo), pa.array(mine, lists), pa.array(gone, lists), pa.array(come, lists)], names=["y", "own", "gone", "come"])

    got = sample.mapInArrow(per_batch(places), "y boolean, own array<int>, gone array<int>, come array<int>").toArrow()

    def arrays(name):
        flat = got[name].combine_chunks()
        ends, data = np.asarray(flat.offsets), np.asarray(flat.values)
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    y = np.array(got["y"].to_pylist(), dtype=float)
    table = list(zip(y.tolist(), arrays("own"), arrays("gone"), arrays("come"), strict=True)) if len(y) else []
    # in an order that doesn't depend on how the rows came
    table.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes(), r[3].tobytes()))
    one, seen = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for label, own, _, _ in table:
        seen[own] += 1
        one[own] += label
    share = float(y.mean()) if len(y) else 0.0
    return fit([r[1] for r in table], [r[2] for r in table], [r[3] for r in table], np.array([r[0] for r in table]), values(one, seen, share), **options)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", into: str = "score") -> DataFrame:
    """The kept columns and the probability that a text is toxic, for every row and whole text; null texts count as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        n = batch.num_columns - 1
        for lo, hi, texts in slices(batch.column(n)):
            yield pa.record_batch([*(batch.column(i).slice(lo, hi - lo) for i in range(n)), pa.array(shared.value.scores(texts.words(BREAKS)))], names=[*keep, into])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{into}` double"])
    return docs.select(*keep, F.col(text_column).alias("__text")).mapInArrow(per_batch(run), schema)


def held_out(id_column: str = "doc_id"):
    """Rows whose labels aren't learnt: crc32 of the id's decimal text leaves 0 when divided by 5. A null id is not one."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = 16000, **options) -> Model:
    """Trains on at most max_rows labelled documents that held_out leaves, those of the smallest hash of their id.

    The bound is drawn on labels before any text is read, and only texts that may be in the sample are shuffled.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).select(F.col("doc_id").cast("long").alias("id"), "toxic").distinct()
    ids = saved(known.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"))
    return train(maybe_in(texts, "id", bitmap(ids, "id")).join(ids, "id").select("text", "toxic"), **options)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every row of docs (doc_id, text).

    Null, empty and wordless texts get the score of a text without features. Repeated rows get equal scores; a null doc_id
    is kept. Only doc_id and text are read, and of labels doc_id and toxic; an empty labels table gives one score for all.
    """
    scored = score(docs, train_on(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
