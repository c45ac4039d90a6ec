"""Texts that plain polynomial hashes take for equal: long Thue-Morse words and their complements."""

import numpy as np
import pytest

from glyphstat.llm import line_dedup, phrase_dedup, quality_forest, suffix_dedup, superminhash, words

ONE, OTHER = [0], [1]
for _ in range(11):
    ONE, OTHER = ONE + OTHER, OTHER + ONE
ONE, OTHER = ("".join("ab"[bit] for bit in x) for x in (ONE, OTHER))


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashes_differ():
    w = words.Words([f"{ONE} {OTHER}\n{ONE}".encode()])
    a, b, c = w.hashes()
    assert a == c and a != b
    lines = w.line_hashes(*w.lines())
    assert len(set(lines.tolist())) == len(lines)
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    n = len(ONE)
    spans = words.span_hashes(words.prefix_hashes(data), np.array([0, n]), np.array([n, 2 * n]))
    assert spans[0] != spans[1]


def test_products_of_residues():
    rng, prime = np.random.default_rng(1), (1 << 61) - 1
    a, b = (rng.integers(0, prime, 500, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = prime - 1, [prime - 1, 1]
    assert [int(x) * int(y) % prime for x, y in zip(a, b)] == words._times(a, b).tolist()


def test_spans_of_several_steps(monkeypatch):
    values = np.random.default_rng(2).integers(0, 1 << 63, 900, dtype=np.uint64)
    twice = np.concatenate([values[:7], values, values])
    whole = words.span_hashes(words.prefix_hashes(twice), np.array([7, 907]), np.array([907, 1807]))
    pieces = words.piece_hashes(twice, np.array([7, 907, 1807]), np.array([907, 1807, 1807]))
    monkeypatch.setattr(words, "_STEP", 16)
    assert words.span_hashes(words.prefix_hashes(twice), np.array([7, 907]), np.array([907, 1807])).tolist() == whole.tolist()
    assert words.piece_hashes(twice, np.array([7, 907, 1807]), np.array([907, 1807, 1807])).tolist() == pieces.tolist()
    assert whole[0] == whole[1] and pieces[0] == pieces[1]


def test_windows_are_not_removed(spark):
    rest = [f"w{i}" for i in range(19)]
    found = phrase_dedup.without_repeats(documents(spark, [" ".join([x, *rest]) for x in (ONE, OTHER, ONE)]))
    assert [r.n_removed for r in found.orderBy("doc_id").collect()] == [0, 0, 20]


def test_bytes_are_not_removed(spark):
    cut = ONE[:256], OTHER[:256]
    texts = [f"{i} {x} {i}" for i, x in enumerate(cut)]
    rows = suffix_dedup.without_repeats(documents(spark, texts)).collect()
    shared = {ONE[i : i + 200] for i in range(57)} & {OTHER[i : i + 200] for i in range(57)}
    assert not shared and all(r.n_removed == 0 for r in rows)


@pytest.mark.parametrize("copies", [2, 3, 5])
def test_groups_of_stretches(spark, copies):
    """Passages in several documents, cut at different places, against all windows."""
    rng = np.random.default_rng(copies)
    base = "".join(rng.choice(list("abcdefgh "), 700))
    texts = []
    for k in range(copies):
        i, j = sorted(rng.integers(0, 700, 2).tolist())
        texts.append(f"{k}" * 30 + base[i:j] + f"{k}" * 30)
    places = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - 199):
            places.setdefault(t[i : i + 200], []).append((d, i))
    gone = [set() for _ in texts]
    for where in places.values():
        for d, i in where if len(where) > 1 else []:
            gone[d].update(range(i, i + 200))
    rows = suffix_dedup.without_repeats(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [len(g) for g in gone]


def test_documents_are_not_linked(spark):
    docs = documents(spark, [f"{x} {x} {x} {x} {x} end" for x in (ONE, OTHER)])
    assert all(r.kept for r in superminhash.near_duplicates(docs).collect())


def test_lines_are_neither_counted_nor_deleted(spark):
    text = f"{ONE}\n{OTHER}\n"
    assert quality_forest.text_stats([text.encode()])[0, quality_forest.STATS.index("n_dup_lines")] == 0
    many = " ".join(["word"] * 25)
    docs = documents(spark, [f"{ONE} {many}", f"{OTHER} {many}", f"{ONE} {many}"])
    rows = line_dedup.without_common_blocks(docs).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 0, 1]
