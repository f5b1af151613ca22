import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm.packing import encoder, fill, pack, plan
from quillspark.llm.queries import tokenizer


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 24))
def test_fill_is_the_best_subset(counts, room):
    sums = {sum(n * c for n, c in zip(counts, used, strict=True)) for used in itertools.product(*(range(c + 1) for c in counts.values()))}
    used = fill(dict(counts), room)
    assert all(0 < c <= counts[n] for n, c in used.items())
    assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= room)


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece(counts):
    total = Counter()
    for used, times in plan(counts, 64):
        assert times and sum(n * c for n, c in used.items()) <= 64
        for n, c in used.items():
            total[n] += c * times
    assert total == Counter(counts)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_tokenizers(text):
    encode = encoder(*tokenizer())
    assert encode.fast is not None
    for t in (text, text + "<|endoftext|> x" + text, " " * 50 + text):
        assert encode(t).tolist() == encode.slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip(spark, parts):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices(["some", "words", "é", "\n", "12345"], k=r.choice([0, 3, 40, 300, 1500])))) for i in range(150)]
    docs += [(500, None), (500, None), (501, ""), (None, "null id"), (502, "x" * 50000), (503, " " * 30000), (504, "a" + "\n" * 1000000 + "b")]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, length string").repartition(parts)
    got = pack(df, *tokenizer()).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for i, t in docs:
        whole = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(whole), 1024):
            ids[i, s, len(whole[s : s + 1024]), zlib.crc32(whole[s : s + 1024].tobytes()), len(whole)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == ids
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = sum(x.length for x in got)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= -(-tokens // 1024) + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), *tokenizer()).collect() == []
