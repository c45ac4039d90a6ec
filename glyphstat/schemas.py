"""Declared schemas of every relation that is read from or written to storage."""

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


REPOS = _struct(
    ("language", _S, True), ("full_name", _S, True), ("fork", T.BooleanType(), True),
    ("size", _L, True), ("stars", _L, True),
)

# The repository object as a hosting service's search API returns it.
REPO_JSON = _struct(
    ("language", _S, True), ("full_name", _S, True), ("fork", T.BooleanType(), True),
    ("size", _L, True), ("stargazers_count", _L, True),
)

FILES = _struct(
    ("repo", _S, True), ("path", _S, True), ("name", _S, True), ("size", _L, True),
    ("contents", _S, True),
)

TOKENS = _struct(
    ("uuid", _S, False), ("dataset", _S, False), ("path", _S, False), ("file_name", _S, False),
    ("token_num", _I, False), ("char_start", _I, False), ("char_end", _I, False),
    ("token_text", _S, False), ("token_type", _S, False), ("channel", _I, True),
    ("line", _I, False), ("line_char", _I, False),
)

# Longest value each constrained tokens column may hold.
TOKEN_LENGTH_LIMITS = {"uuid": 36, "dataset": 4, "file_name": 255, "token_type": 255}

# The four counted views of a token sequence, in the order records list them.
KINDS = ("token_text", "token_type", "bigram_text", "bigram_type")

_COUNTS = T.MapType(_S, _L)

RECORD = _struct(
    ("id", _S, True), ("path", _S, True), ("filename", _S, True), ("dataset", _S, True), ("num_tokens", _L, True),
    ("part", _I, True), *[(kind, _COUNTS, True) for kind in KINDS],
)

_ENTRIES = T.ArrayType(_struct(("key", _S, True), ("val", _L, True)))

INDEX_DOCUMENT = _struct(
    ("id", _S, True), ("path", _S, True), ("filename", _S, True), ("dataset", _S, True), ("num_tokens", _L, True),
    ("part", _I, True), *[(kind, _ENTRIES, True) for kind in KINDS],
)

CORPUS_HISTOGRAM = _struct(("dataset", _S, True), ("key", _S, True), ("count", _L, True))

MANIFEST = _struct(("src_file", _S, False), ("dst_file", _S, False))

REJECTS = _struct(("path", _S, False), ("reason", _S, False))
