"""Passage, near-copy and line deduplication against brute force on small texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glyphstat.llm import line_dedup, passages, phrase_dedup, suffix_dedup, superminhash
from glyphstat.llm.components import components

SCHEMA = "doc_id long, text string, block string, n long, key long"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus() -> list[tuple]:
    """Random texts with shared passages, copies, near copies, repeats inside, nulls and odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, phrase = prose(60), prose(25)
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [f"{prose(12)} {passage} {prose(9)}" for _ in range(12)]
    texts += [f"{prose(3)}\n{phrase}\t{prose(30)}" for _ in range(12)]
    texts += [phrase + " " + phrase, "la " * 90, "la " * 200, passage, "", None, " \n ", "one two", "ONE two"]
    base = prose(150).split()
    for k in range(25):
        copy = list(base)
        copy[(7 * k) % 150] = f"x{k}"
        texts.append(" ".join(copy))
    texts += [texts[0]] * 30 + ["日本語" * 120, "日本語" * 121, prose(5000)]
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[41], (7, rows[41][1] + " tail", "clash", 1, 2), (None, passage, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = ROWS[:]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def distinct_rows():
    """Rows in the order of the operators, equal ones once: a missing id comes last."""
    return list(dict.fromkeys((r[0], r[1]) for r in ROWS))


def test_phrases_match_brute_force(docs):
    rows = sorted(distinct_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    # Id 7 has two texts, whose order is that of a hash; neither shares a window with the other.
    seen, expected = set(), {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        expected[doc_id, text] = (len(words), sum(gone), sha(kept))
    wanted = Counter((r[0], *expected[r[0], r[1]]) for r in ROWS)
    for block in (1000, 4000, 10**6):
        found = phrase_dedup.without_repeats(docs, True, block, block // 2).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == wanted
    kept = phrase_dedup.without_repeats(docs, False, 4000, 2000).collect()
    assert Counter((r.doc_id, sha(bytes(r.kept))) for r in kept) == Counter((k[0], k[3]) for k in wanted.elements())


@pytest.mark.parametrize("module", [phrase_dedup, suffix_dedup])
def test_edges_of_a_common_passage_are_spread(spark, monkeypatch, module):
    """One anchor before different texts: its stretches must not meet in one shard."""
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(80))
    rows = [(i, f"{passage} " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(400)]
    most, in_shards = [], passages.in_shards

    def watched(stretches, n):
        sizes = in_shards(stretches.filter("stretch IS NOT NULL"), 1000).count()
        most.append(max(r["count"] for r in sizes.collect()))
        return in_shards(stretches, n)

    monkeypatch.setattr(passages, "in_shards", watched)
    monkeypatch.setattr(passages, "HOT_STRETCHES", 50, raising=False)
    found = module.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), False, 20_000, 10_000).collect()
    assert most[0] < 100
    assert sum(bytes(r.kept).startswith(passage[:20].encode()) for r in found) == (module is phrase_dedup)


def test_automata_of_bounded_size(monkeypatch):
    rng = random.Random(3)
    words = [b"w%d" % rng.randint(0, 30) for _ in range(200)]
    texts = [b" ".join(words[i : i + 60]) for i in (0, 10, 90, 30, 0)] + [b"a " * 30]
    one = phrase_dedup.repeated_windows(texts, np.arange(41 * 5 + 11))
    monkeypatch.setattr(phrase_dedup, "MAX_PATTERNS", 7)
    assert (phrase_dedup.repeated_windows(texts, np.arange(41 * 5 + 11)) == one).all()
    assert one[205:].tolist() == [False] + [True] * 10


def test_byte_strings_match_brute_force(docs):
    rows = distinct_rows()
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[i : i + 200] for i in range(len(data) - 199))
    expected = {}
    for key in rows:
        data = (key[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 199):
            if counts[data[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        expected[key] = (len(data), sum(gone), (b"\0" + gone).count(b"\0\1"), sha(kept))
    wanted = Counter((r[0], *expected[r[0], r[1]]) for r in ROWS)
    for block in (1000, 4000, 10**6):
        found = suffix_dedup.without_repeats(docs, True, block, block // 2).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == wanted


@pytest.mark.parametrize("stretches", [-1, 2])
def test_hot_anchors_match_brute_force(docs, monkeypatch, stretches):
    monkeypatch.setattr(passages, "HOT_STRETCHES", stretches)
    test_phrases_match_brute_force(docs)
    test_byte_strings_match_brute_force(docs)


def test_suffixes_are_sorted():
    rng = random.Random(2)
    stretches = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(300)] + [b"a" * 30] * 3
    texts = suffix_dedup.Texts(stretches)
    begin = texts.start[:-1]
    order = suffix_dedup.sorted_suffixes(texts, begin, begin + texts.size)
    assert sorted(order.tolist()) == list(range(len(stretches)))
    assert [stretches[i] for i in order] == sorted(stretches)


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


@pytest.mark.parametrize("percent", [80, 85, 97])
def test_near_duplicates_match_brute_force(docs, percent):
    sets = [(r[0], shingles(r[1])) for r in ROWS if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (u, a) in enumerate(sets):
        for v, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(u), find(v)
                root[max(x, y)] = min(x, y)
    wanted = Counter((i, len(s), find(i), find(i) == i) for i, s in sets)
    wanted[None, len(shingles(ROWS[-1][1])), None, True] = 1
    found = superminhash.near_duplicates(docs, percent).collect()
    # A row with the id of another text belongs to its id; only such a row may have two names.
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == wanted


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    other = np.concatenate([base[100:], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sizes = [len(base), len(other), 1, 0]
    flat = np.concatenate([base, np.sort(other), base[:1]])
    values = superminhash.signatures(flat, np.cumsum([0, *sizes]), 72)
    assert abs((values[0] == values[1]).mean() - 0.6) < 0.2
    assert np.isinf(values[3]).all() and sorted(np.floor(values[2])) == list(range(72))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    edges += [(500, i) for i in range(501, 520)] + [(9, 9), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    linked = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, find(x)) for x in linked)


def test_patience():
    a, b = list("xabcyqq"), list("abczqq")
    assert line_dedup.patience(a, b) == [(1, 0), (2, 1), (3, 2), (5, 4), (6, 5)]
    assert line_dedup.patience([], b) == [] and line_dedup.patience(list("aa"), list("bb")) == []
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        matches = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in matches)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(matches, matches[1:], strict=False))


def test_lines_of_later_documents_go(spark):
    rng = random.Random(8)

    def line(n=12):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    common, boiler = [line(), line(), line()], line()
    first = "\n".join([line(), *common, boiler, line()])
    second = "\n".join([boiler, line(), *common, line()])
    third = "\n".join([line(), boiler, line()])
    rows = [(1, first), (2, second), (3, third), (4, first), (5, None), (6, ""), (None, first), (1, first)]
    rows += [(i, first + f"\n{line()}") for i in range(100, 170)]  # more holders than a rare line has
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string")
    found = {(r.doc_id, r.text): r for r in line_dedup.without_common_blocks(docs).collect()}
    kept = second.split("\n")
    assert found[1, first].kept_text == first and found[3, third].n_removed == 0
    assert found[2, second].kept_text == "\n".join([kept[0], kept[1], kept[5]])
    assert found[4, first].n_removed == 6 and found[4, first].kept_text == ""
    assert found[5, None].kept_text is None and found[5, None].n_lines == 0 and found[6, ""].n_lines == 1
    assert found[None, first].n_removed == 0
    assert all(r.n_removed == 6 for (i, _), r in found.items() if i and i >= 100)


def line_deduped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.text): r.kept_text for r in line_dedup.without_common_blocks(docs).collect()}


def test_blocks_in_fragments_of_frequent_lines_go(spark):
    # Each line's first holder has a part of the passage only; the first whole passage is in document 3.
    passage = [" ".join(f"p{k}w{i}" for i in range(8)) for k in range(4)]
    rows = [(1, f"{passage[0]}\none\n{passage[2]}"), (2, f"{passage[1]}\ntwo\n{passage[3]}")]
    for holders in (20, 100):
        found = line_deduped(spark, rows + [(i, "\n".join([f"own {i}", *passage])) for i in range(3, holders)])
        assert found.pop(rows[0]) == rows[0][1] and found.pop(rows[1]) == rows[1][1]
        assert all(kept == (text if i == 3 else f"own {i}") for (i, text), kept in found.items())


def brute_force_lines(rows, min_words=20):
    """The text that stays of each row: without all runs of lines that stand in a document with a smaller id."""
    kept = {}
    for doc_id, text in rows:
        lines = text.split("\n")
        gone = [False] * len(lines)
        for other in {t for i, t in rows if i < doc_id}:
            before = other.split("\n")
            for i in range(len(lines)):
                for j in range(len(before)):
                    n = 0
                    while i + n < len(lines) and j + n < len(before) and lines[i + n] == before[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[i : i + n]) >= min_words:
                        gone[i : i + n] = [True] * n
        kept[doc_id, text] = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    return kept


def test_repeated_and_moved_blocks_go(spark):
    p, q, *own = ("\n".join(f"{name}{k} " + "w " * 7 for k in range(4)) for name in "pqxyuvzabc")
    x, y, u, v, z, a, b, c = own
    rows = [(1, f"{x}\n{p}\n{y}"), (2, f"{u}\n{p}\n{v}\n{p}\n{z}"), (3, f"{a}\n{q}\n{b}"), (4, f"{q}\n{c}\n{p}")]
    found = line_deduped(spark, rows)
    assert found == dict(zip(rows, [rows[0][1], f"{u}\n{v}\n{z}", rows[2][1], c], strict=True))
    # The first of very many holders repeats the passage.
    rows = [(1, f"{x}\n{p}\n{y}\n{p}")] + [(i, f"own {i}\n{p}\nlast {i}") for i in range(2, 80)]
    assert line_deduped(spark, rows) == {r: r[1] if r[0] == 1 else f"own {r[0]}\nlast {r[0]}" for r in rows}


def test_lines_match_brute_force(spark):
    rng = random.Random(11)
    lines = ["", " ", "one", "two words", *(f"l{k} " + "w " * rng.randint(2, 24) for k in range(14))]
    rows = [(i // 2, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25)))) for i in range(160)]
    expected = brute_force_lines(rows)
    found = line_deduped(spark, rows)
    assert any(text != kept for (_, text), kept in expected.items())
    assert found == expected


@pytest.mark.parametrize("run", [
    phrase_dedup.without_repeats, suffix_dedup.without_repeats, superminhash.near_duplicates, line_dedup.without_common_blocks,
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rounds", [0, 1])
@pytest.mark.parametrize("percent", [80, 85])
def test_copies_around_the_threshold_match_brute_force(spark, monkeypatch, rounds, percent):
    """Groups of copies that are altered by very different amounts, and copies of altered copies, all decided by their differences."""
    monkeypatch.setattr(superminhash, "HUB_ROUNDS", rounds)
    rng = random.Random(percent + rounds)
    texts = []

    def altered(words, n):
        words = list(words)
        for _ in range(n):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [f"z{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
        return words

    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        texts.append(base)
        for _ in range(25):
            copy = altered(base, rng.randint(0, 9))
            texts.append(copy)
            if rng.random() < 0.3:
                texts += [altered(copy, rng.randint(0, 3)) for _ in range(3)]
    docs_ = spark.createDataFrame([(i * 2 + 1, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sets = {i * 2 + 1: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in enumerate(texts)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(docs_, percent).collect()}
    assert got == {i: root(i) for i in sets}
    assert 4 < len(set(got.values())) < len(got)
