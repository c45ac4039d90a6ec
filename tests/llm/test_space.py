"""What operators leave on disk and in memory."""

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glyphstat.llm import bpe, katz, storage, suffix_dedup
from glyphstat.llm.queries import BPE_FILE


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.mark.parametrize("write", [storage.cut, storage.store])
def test_shuffle_files_go_when_rows_are_written(spark, write):
    before, setting = shuffle_files(spark), spark.conf.get(storage._FILE_CLEANUP, None)
    # The frame is from before the setting changes, and is used again.
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = write(counts)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(storage._FILE_CLEANUP, None) == setting
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, counts.collect()))


def test_words_of_a_block_travel_packed(spark):
    texts = ["", None, *(f"w{i} w{i % 50} é{i} W{i % 7}" for i in range(3000))]
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held boolean, text string").repartition(3)
    blocks = storage.store(katz._read(docs), "blocks")
    sent = katz._asked(blocks, 2).collect()
    assert len(sent) <= 2 * blocks.count()
    answers = katz._asked(blocks, 2).groupBy("word_shard").applyInArrow(katz._answers, "block long, blobs array<binary>").collect()
    words = {r.block: r.words for r in blocks.collect()}
    found = {}
    for r in answers:
        place, numbers, counts = r.blobs
        for i, *told in zip(np.cumsum(katz.unpack(place, np.int32)), katz.unpack(numbers), katz.unpack(counts)):
            found.setdefault(words[r.block][i], set()).add(tuple(told))
    assert set(found) == {w for x in words.values() for w in x} and all(len(x) == 1 for x in found.values())
    count = {w: next(iter(x))[1] for w, x in found.items()}
    assert count[""] == len(texts) and count["w0"] == 60 + 1 + 429 and count["é7"] == 1 and len({n for x in found.values() for n, _ in x}) == len(found)


def test_hashes_are_made_where_they_are_needed():
    texts = suffix_dedup.Texts([b"x" * 300, None])
    assert "prefix" not in vars(texts)
    assert len(texts.prefix) == len(texts.data) + 1


def test_anchors_of_stretches():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 900).astype(np.uint8).tobytes()
    texts = suffix_dedup.Texts([text])
    first, last, _, grams = suffix_dedup._anchors(texts)
    _, _, place, _ = suffix_dedup._anchors(texts)
    stretches = suffix_dedup.Texts([text[i : j + suffix_dedup.WINDOW] for i, j in zip(first, last)])
    assert (suffix_dedup.anchor_places(stretches, grams.view(np.int64)) + first == place).all()


def test_ids_are_remembered_as_shared_objects():
    with open(public_tokenizers.path(BPE_FILE)) as file:
        model = bpe.Bpe(file.read())
    text = "a corpus, corpus corpus. of several unremarkable words, unremarkable 12th and_so on corpus!"
    model.prime([text])
    fresh = bpe.Bpe.__new__(bpe.Bpe)
    fresh.__dict__.update(vars(model), cache={}, chunk_cache={})
    assert bpe.encode(model, text) == bpe.encode(fresh, text)
    numbers = [i for ids in model.chunk_cache.values() for i in ids]
    assert len({id(i) for i in numbers}) == len(set(numbers))
