"""String expressions: null spelling, key encoding, row ids, decoding, paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "<<UNK>>"
BIGRAM_SEPARATOR = "<<>>"

# The spellings a pandas CSV reader takes for a missing cell.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def fill_unknown(value: Column, pandas_na: bool = True) -> Column:
    """Missing values become the unknown key; with ``pandas_na`` so do their usual spellings."""
    missing = value.isNull()
    if pandas_na:
        missing = missing | value.isin(PANDAS_NA)
    return F.when(missing, F.lit(UNKNOWN)).otherwise(value)


def bigram_key(left: Column, right: Column) -> Column:
    return F.concat_ws(BIGRAM_SEPARATOR, left, right)


def token_uuid(dataset: Column, path: Column, token_num: Column) -> Column:
    """A 36-character id that is the same on every attempt of a task."""
    # Cut as bytes, which need no search for the places of characters.
    digest = F.md5(F.concat_ws("|", dataset, path, token_num.cast("string"))).cast("binary")
    first, *cuts = [F.substring(digest, start, size) for start, size in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]]
    dashed = [piece for cut in cuts for piece in (F.lit(bytearray(b"-")), cut)]
    return F.concat(first, *dashed).cast("string")


def decode_latin1(content: Column) -> Column:
    """Bytes to text, with every line ending read as a newline."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), "\r\n?", "\n")


def escape_dump(text: Column) -> Column:
    """Line breaks and tabs as a token dump prints them."""
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def decoded_path(uri: Column) -> Column:
    """A path as it is listed: without a file scheme, percent escapes decoded, plus signs kept."""
    plain = F.regexp_replace(uri, r"^file:/+", "/")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def path_stem(name: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
