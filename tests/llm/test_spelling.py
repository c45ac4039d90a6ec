"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from glyphstat.llm import queries, spelling, sql
from tests.oracle import connect, difference


def near(a, b):
    """Whether one inserted, deleted or replaced code point leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(beside[w]), words.get(form.get(w))) for w, n in words.items()}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)
    return got


@pytest.mark.parametrize("letters,shortest", [("ab", 4), ("abcé", 3)])
def test_random_words_match_brute_force(spark, letters, shortest):
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(shortest, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(60))) for i in range(40)]
    got = check(spark, rows)
    assert max(r[4] for r in got) > 1


def test_chains_are_followed_to_their_end(spark):
    counts = {"abcde": 3, "abcdf": 6, "abcgf": 13, "abhgf": 30, "xbhgf": 61, "lonely": 4}
    rows = [(None, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = {r[0]: r for r in check(spark, rows)}
    assert got["abcde"][1:3] == ("abcdf", "xbhgf") and got["lonely"][1:] == (None, "lonely", 4, 0, None)


def test_edges(spark):
    assert check(spark, []) == [] and check(spark, [(1, None), (2, ""), (3, "1234 -- ab")]) == []
    twins = "ÀÉÎÕÜ àéîõü àéîõü× " * 3 + "many same words " * 5
    check(spark, [(7, twins), (7, twins), (None, twins), (8, "x" * 100_000 + " " + "ab cde fghij " * 50_000)])


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert not difference(queries.QUERIES["op13_spelling"](spark, sf_dir), connect(sf_dir), sql.ORACLES["op13_spelling"])
