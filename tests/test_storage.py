"""Readers, writers, rejects and re-runs on small fixtures."""

import gzip

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphstat.functions.lexing import CPP14, WORDS
from glyphstat.functions.text import decoded_path
from glyphstat.operators.counts import file_key_counts, token_keys
from glyphstat.operators import incremental, quality
from glyphstat.operators.tokenize import render_dump, render_files, tokenize
from glyphstat.plans import catalog
from glyphstat.sources import files, metrics, repos, scratch
from glyphstat.sources import tree as file_tree
from glyphstat.sources import records as record_files
from glyphstat.sources import tokens as token_files
from glyphstat.streaming.arrivals import arriving_documents, tokenize_available

DOCS = "dataset string, path string, text string"


def docs(spark, texts, dataset="D"):
    return spark.createDataFrame([(dataset, f"f{i}.c", t) for i, t in enumerate(texts)], DOCS)


def content(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in {
        "o/r/a.c": b"int a;\r\nx\ry\n", "o/r/sub/b.cpp": "é".encode("latin1"), "o/r/site.css": b"p{}",
        "o/q/k.cc": b"\n", "o/q/n.txt": b"no",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_scan_and_package(spark, tree, tmp_path):
    scanned = files.scan(spark, tree)
    packed = files.package(scanned, tree)
    assert content(packed, "repo", "path", "name", "size", "contents") == [
        ("o/q", "k.cc", "k.cc", 1, "\n"), ("o/r", "a.c", "a.c", 12, "int a;\nx\ny\n"),
        ("o/r", "site.css", "site.css", 3, "p{}"), ("o/r", "sub/b.cpp", "b.cpp", 1, "é"),
    ]
    assert files.only_extensions(scanned).count() == 2
    files.write_packaged(packed.coalesce(1), str(tmp_path / "p"), chunk=3)
    assert files.read_packaged(spark, str(tmp_path / "p")).count() == 4
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 2


def test_every_file_is_listed(spark, tmp_path):
    written = {"o/r/a.c": b"int a;", "o/r/._a.c": b"x", "_o/r/.hid/b.c": b"", "o/empty.c": b"", "o/r/n.h": b"h", "o/sp ace/%20#é.c": b"1"}
    frame = spark.createDataFrame(list(written.items()), "relative string, content binary")
    for _ in range(2):  # writing again changes nothing
        assert file_tree.write(frame, str(tmp_path)) == len(written)
    (tmp_path / "none").mkdir()
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    listed = {r["path"]: r["length"] for r in file_tree.listing(spark, str(tmp_path)).collect()}
    assert listed == {f"{tmp_path}/{name}": len(data) for name, data in written.items()}
    scanned = {r["path"]: (r["length"], bytes(r["content"])) for r in files.scan(spark, f"{tmp_path}/", "*.c*").collect()}
    assert scanned == {f"{tmp_path}/{n}": (len(d), d) for n, d in written.items() if not n.endswith(".h")}
    docs_ = files.package(files.scan(spark, str(tmp_path), "empty*"), str(tmp_path)).select(
        F.lit("D").alias("dataset"), F.col("name").alias("path"), F.col("contents").alias("text")
    )
    assert [r["token_type"] for r in tokenize(docs_, CPP14).collect()] == ["EOF"]
    assert file_tree.listing(spark, f"file:{tmp_path}/o").count() == 5
    assert incremental.finished(spark, str(tmp_path), "b.*").first()["dst_file"] == f"{tmp_path}/_o/r/.hid/b.c"


def test_files_in_path_order(spark, tmp_path):
    paths = [f"d{i % 7}/{'x' * (i % 5)}{i}.c" for i in range(200)] + ["same/a.c"] * 30
    frame = spark.createDataFrame([("r/q", p, str(i)) for i, p in enumerate(paths)], "repo string, path string, contents string")
    rows_ = files.in_path_order(frame.repartition(5), chunk=17).orderBy("position").collect()
    assert [r["position"] for r in rows_] == list(range(230)) and [r["chunk"] for r in rows_] == [i // 17 for i in range(230)]
    assert [r["path"] for r in rows_] == sorted(paths) and len({r["contents"] for r in rows_}) == 230
    files.write_chunks(frame, str(tmp_path / "c"), chunk=17)
    assert len(list((tmp_path / "c").glob("chunk=*/*.parquet"))) == 14
    assert files.in_path_order(frame.limit(0)).count() == 0


def test_a_run_that_stops_before_its_commit_does_not_count(spark, tmp_path):
    runs = incremental.Runs(spark, str(tmp_path / "runs"))
    listed = spark.createDataFrame([(f"/s/{i}.c", f"/t/{i}.t") for i in range(6)], "src_file string, dst_file string")

    def write(run, done, failed):
        out = spark.createDataFrame([(i, run) for i in done], "i int, made_by string")
        bad = spark.createDataFrame([(f"/s/{i}.c", "failed") for i in failed], "path string, reason string")
        runs.write(run, out, bad, spark.createDataFrame([(f"/t/{i}.t",) for i in done], "dst_file string"))

    def pending():
        return sorted(r["src_file"] for r in runs.pending(listed).collect())

    assert len(pending()) == 6 and runs.committed().count() == 0
    write("a", [0, 1], [2])
    assert len(pending()) == 6  # stopped between write and commit
    assert runs.table(runs.OUTPUTS, "i int, made_by string").count() == 0
    write("b", [0], [3])
    runs.commit("b")
    assert pending() == ["/s/1.c", "/s/2.c", "/s/4.c", "/s/5.c"]
    write("a", [1, 2], [])  # the same run once more, in place of its torn files
    runs.commit("a")
    runs.commit("a")
    assert pending() == ["/s/4.c", "/s/5.c"]
    assert content(runs.table(runs.OUTPUTS, "i int, made_by string"), "i", "run") == [(0, "b"), (1, "a"), (2, "a")]


def test_manifest_and_pending(spark, tree, tmp_path):
    listed = incremental.manifest(files.scan(spark, tree).select("path"), tree, "/out", ".tokens")
    targets = [r["dst_file"] for r in listed.collect()]
    assert sorted(targets) == [
        "/out/o/q/k.tokens", "/out/o/r/a.tokens", "/out/o/r/site.tokens", "/out/o/r/sub/b.tokens",
    ]
    incremental.save_manifest(listed, str(tmp_path / "m"))
    listed = incremental.load_manifest(spark, str(tmp_path / "m"))
    for reason, name in (("failed", "site.css"), ("timeout", "k.cc")):
        rejects = listed.filter(F.col("src_file").endswith(name)).select(
            F.col("src_file").alias("path"), F.lit(reason).alias("reason")
        )
        incremental.append_rejects(rejects, str(tmp_path / "x"))
    failed = incremental.load_rejects(spark, str(tmp_path / "x"))
    done = spark.createDataFrame([("/out/o/r/a.tokens",)], "dst_file string")
    left = incremental.pending(listed, done, failed).collect()
    assert [r["dst_file"] for r in left] == ["/out/o/r/sub/b.tokens"]


CODE = ['#define A "x,y" \\\n  2\nchar *s = "q\\"\\t, \\\\ ";\tint NULL; // c\n', "a,b", "", "'\"' \"'\""]


def test_csv_round_trip(spark, tmp_path):
    made = tokenize(docs(spark, CODE), CPP14)
    token_files.write_csv(made, str(tmp_path / "t"))
    back = token_files.read_csv(spark, str(tmp_path / "t"))
    assert content(back, *made.columns) == content(made, *made.columns)


def test_texts_are_classified_after_the_explosion(spark):
    # Lambdas are interpreted; what stands in the generator is made by them.
    for profile in (WORDS, CPP14):
        plan = tokenize(docs(spark, CODE), profile)._jdf.queryExecution().optimizedPlan().toString()
        (exploded,) = [line for line in plan.splitlines() if "Generate posexplode" in line]
        assert "Identifier" in plan and "Identifier" not in exploded


def test_token_csvs_are_compressed_and_cut_by_rows(spark, tmp_path):
    made = tokenize(docs(spark, CODE), CPP14).coalesce(1)
    token_files.write_csv(made, str(tmp_path / "t"), max_rows=5)
    assert len(list((tmp_path / "t").glob("*.csv.gz"))) == -(-made.count() // 5)
    made.limit(3).coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "t" / "plain"))
    assert token_files.read_csv(spark, str(tmp_path / "t")).count() == made.count() + 3


def test_dump_round_trip_and_rejects(spark, tmp_path):
    made = tokenize(docs(spark, CODE), CPP14)
    lines = render_dump(made).orderBy("path", "token_num").collect()
    folder = tmp_path / "dump"
    folder.mkdir()
    for name in {r["path"] for r in lines}:
        mine = [r["value"] for r in lines if r["path"] == name]
        (folder / f"{name}.tokens").write_text("\n".join(mine) + "\n", encoding="utf-8")
    (folder / "bad.tokens").write_text("[@0,0:0='a',<Identifier>,1:0]\nbroken\n[@1,1:0='<EOF>',<EOF>,1:1]\n")
    (folder / "blank.tokens").write_text("[@0,0:0='a',<Identifier>,1:0]\n\n")
    dumped = token_files.read_dump(spark, str(folder), "D")
    rejects = token_files.unreadable_files(dumped)
    parsed = token_files.parse_dump(dumped, rejects)
    assert [r["path"].rsplit("/", 1)[1] for r in rejects.orderBy("path").collect()] == ["bad.tokens", "blank.tokens"]
    columns = [c for c in made.columns if c not in ("uuid", "path", "file_name")]
    assert content(parsed, *columns) == content(made, *columns)
    line = spark.createDataFrame([("p", "D", "  [@2,5:9='#if X',<Directive>,channel=1,7:0] ")], "path string, dataset string, value string")
    row = token_files.parse_dump(line, rejects).first()
    assert (row["token_text"], row["token_type"], row["channel"], row["line"], row["line_char"]) == ("#if X", "Directive", 1, 7, 0)


def test_broken_json_line_is_set_aside(spark, tmp_path):
    good = '{"id":"u","filename":"f","dataset":"D","num_tokens":2,"token_text":{"a":2},"token_type":{},"bigram_text":{},"bigram_type":{}}'
    (tmp_path / "0000.jsonl").write_text(good + "\n{broken\n" + good.replace('"f"', '"g"') + "\n")
    records, rejects = record_files.read(spark, str(tmp_path))
    assert record_files.count(records) == 2
    assert [r["line"] for r in rejects.collect()] == ["{broken"]
    assert {r["part"] for r in records.collect()} == {0}


def test_metric_files(spark, tmp_path):
    for name, body in {"A": "k,1\nl,2\n", "B": 'k,5\n"a""b,c",1\n', "token_type": "k,1,5\n"}.items():
        (tmp_path / f"{name}.csv").write_text("token_type,count\n" + body)
    schema = StructType([StructField("key", StringType()), StructField("count", LongType())])
    read = metrics.read_named_files(spark, str(tmp_path), schema, "token_type")
    assert content(read, "dataset", "key", "count") == [
        ("A", "k", 1), ("A", "l", 2), ("B", "a\"b,c", 1), ("B", "k", 5),
    ]
    metrics.write(read, str(tmp_path / "out"))
    back = metrics.read(spark, str(tmp_path / "out"), schema)
    assert content(back, "dataset", "key", "count") == content(read, "dataset", "key", "count")


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    first, both = docs(spark, ["a b"]), docs(spark, ["a b", "c d e"])
    incremental.append_tokens(spark, tokenize(first, WORDS), path)
    for _ in range(2):
        incremental.append_tokens(spark, tokenize(both, WORDS), path)
        table = token_files.read(spark, path)
        assert table.count() == 7 and table.select("uuid").distinct().count() == 7


def test_documents_are_appended_once_and_joined_before_they_are_lexed(spark, tmp_path):
    path, lexed = str(tmp_path / "table"), []

    def lexer(new):
        lexed.append(sorted(r["path"] for r in new.collect()))
        return tokenize(new, WORDS)

    first, both = docs(spark, ["a b"]), docs(spark, ["a b", "c d e", None])
    for given in (first, both, both):
        incremental.append_tokens(spark, given, path, lexer)
    assert lexed == [["f0.c"], ["f1.c", "f2.c"], ["f2.c"]]
    other = docs(spark, ["x"], dataset="E")
    incremental.append_tokens(spark, other.unionByName(docs(spark, ["y"], dataset="F")).coalesce(1), path, lexer)
    table = token_files.read(spark, path)
    assert content(table.groupBy("dataset").count(), "dataset", "count") == [("D", 7), ("E", 2), ("F", 2)]
    assert list((tmp_path / "table").glob("dataset=*/*.zstd.parquet")) and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_token_tables_store_rising_numbers_as_differences(spark, tmp_path):
    path = str(tmp_path / "table")
    texts = ["".join(f"w{j} " for j in range(i, i + 300)) for i in range(50)]
    made = tokenize(docs(spark, texts), WORDS).coalesce(1)
    token_files.write(made, path)
    assert content(token_files.read(spark, path), *made.columns) == content(made, *made.columns)
    (file,) = (tmp_path / "table").glob("dataset=D/*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    stored = {c.path_in_schema: c for c in (group.column(i) for i in range(group.num_columns))}
    assert all("DELTA_BINARY_PACKED" in stored[name].encodings for name in ("token_num", "char_start", "char_end", "line_char"))
    assert not any("DICTIONARY" in e for e in stored["uuid"].encodings)
    assert stored["char_start"].total_compressed_size < group.num_rows and stored["uuid"].total_compressed_size < 21 * group.num_rows


def test_shuffle_files_go_with_what_made_them(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before, writer = spark.conf.get(name, None), type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda *a, **k: seen.append(spark.conf.get(name, None)) or parquet(*a, **k))
    token_files.write(tokenize(docs(spark, ["a b", "c d"]), WORDS), str(tmp_path / "table"))
    scratch.materialize(docs(spark, ["a b", "c d"]), "rows")
    assert seen == ["true", "true"] and spark.conf.get(name, None) == before


def test_constraint_report(spark):
    made = tokenize(docs(spark, ["a b"], dataset="TOOLONG"), WORDS)
    broken = made.unionByName(made.limit(1)).withColumn("line", F.when(F.col("token_num") > 0, F.col("line")))
    got = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(broken).collect()}
    assert got["unique", "uuid"] == 1 and got["max_length", "dataset"] == 4
    assert got["not_null", "line"] == 2 and got["not_null", "uuid"] == 0
    assert sum(got.values()) == 7


def test_constraint_report_exchanges_no_ids(spark, monkeypatch):
    made = tokenize(docs(spark, ["a b", "c d"]), WORDS)
    plan = quality.constraint_report(made)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(uuid" not in plan
    # Ids that share their bits are told apart.
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    repeated = made.unionByName(made.limit(2)).unionByName(made.limit(1).withColumn("uuid", F.lit(None).cast("string")))
    got = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(repeated).collect()}
    assert got["unique", "uuid"] == 2 and got["not_null", "uuid"] == 1


def test_constraint_report_makes_tokens_once(spark):
    made, seen = tokenize(docs(spark, ["a b", "c d"]), WORDS), spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(made.mapInArrow(passed, made.schema)).collect()}
    assert seen.value == 6 and len(got) == 16 and set(got.values()) == {0}
    # Missing ids break their rule, they are no repeats.
    missing = made.withColumn("uuid", F.when(F.col("token_num") > 0, F.col("uuid"))).withColumn("line", F.lit(None).cast("int"))
    got = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(missing).collect()}
    assert (got["not_null", "uuid"], got["not_null", "line"], got["unique", "uuid"]) == (2, 6, 0)
    got = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(made.limit(0)).collect()}
    assert len(got) == 16 and set(got.values()) == {0}


def test_repeated_numbers_are_found_in_pieces(monkeypatch):
    monkeypatch.setattr(quality, "_REPEATS", 3)
    numbers = [5, 1, 5, 7, 7, 7, 2, 9, 1, -4, 8, 6, 3, -4, 10]
    for size in (1, 2, 4, 20):
        repeats = quality._Repeats()
        for at in range(0, len(numbers), size):
            repeats.add(np.array(numbers[at : at + size], np.int64))
        assert repeats.found().tolist() == [-4, 1, 5, 7]
    assert quality._Repeats().found().tolist() == []


def test_dump_files_hold_the_lines_of_a_path(spark, tmp_path):
    frame = docs(spark, CODE).unionByName(docs(spark, ["x y", None], dataset="E"))
    for profile in (WORDS, CPP14):
        lines = sorted((r["path"], r["token_num"], r["value"]) for r in render_dump(tokenize(frame, profile)).collect())
        made = {r["path"]: r["content"] for r in render_files(frame, profile).collect()}
        assert made == {path: "\n".join(v for p, _, v in lines if p == path) for path in {p for p, _, _ in lines}}
    written = render_files(frame, WORDS).select(F.concat("path", F.lit(".tokens.gz")).alias("relative"), F.encode("content", "UTF-8").alias("content"))
    file_tree.write(written, str(tmp_path), compression="gzip")
    assert (tmp_path / "f0.c.tokens.gz").read_bytes()[:2] == b"\x1f\x8b"
    dumped = token_files.read_dump(spark, str(tmp_path), "D")
    assert sorted(r["value"] for r in dumped.collect()) == sorted(r["value"] for r in render_dump(tokenize(frame, WORDS)).collect())


ODD_DUMPS = {
    "x/a.tokens": b"one\ntwo\r\nthree\rfour\n\nsix", "x/b.tokens": b"\r\r\n\n", "x/c c+.tokens": b"\xef\xbb\xbfbom\nbad\xff\xfebytes\r", "x/d.tokens": b"",
    "_h/e.tokens": b"e", "x/_f.tokens": b"f", "x/.g.tokens": b"g", "_a=1/h.tokens": b"h\n", "_metadata.tokens": b"m", "_metadata_x/i.tokens": b"i", "x/j.txt": b"j",
    "x/k.tokens._COPYING_": b"k", "y/deep/l%20.tokens.gz": gzip.compress(b"l1\nl2\r") + gzip.compress(b"l3\n"), "n.tokens.gz": gzip.compress(b""),
}


def test_dumps_are_read_as_spark_reads_text_in_tasks_by_bytes(spark, tmp_path):
    for name, body in ODD_DUMPS.items():
        (tmp_path / "a b+" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "a b+" / name).write_bytes(body)
    root = str(tmp_path / "a b+")
    for given in (root, f"file://{root}//x", f"{root}/x/a.tokens"):
        text = spark.read.option("pathGlobFilter", "*.{tokens,tokens.gz}").option("recursiveFileLookup", True).text(given)
        expected = text.select(decoded_path(F.col("_metadata.file_path")).alias("path"), F.col("value").cast("binary").alias("value"))
        read = token_files.read_dump(spark, given, "D").withColumn("value", F.col("value").cast("binary"))
        assert content(read, "path", "value") == content(expected, "path", "value")
    for i in range(40):
        (tmp_path / "many" / str(i)).mkdir(parents=True)
        (tmp_path / "many" / str(i) / "main.tokens").write_text(f"{i}\n")
    many = token_files.read_dump(spark, str(tmp_path / "many"), "D")
    assert many.count() == 40 and many.rdd.getNumPartitions() == 1
    with pytest.raises(AnalysisException):
        token_files.read_dump(spark, str(tmp_path / "none"), "D")


def test_lines_are_whole_whatever_the_blocks(monkeypatch):
    for body in [*ODD_DUMPS.values(), b"a\r\nb\rc\n\r\nd" * 5]:
        found = []
        for size in (3, 4, 5, 7, 1_000):
            monkeypatch.setattr(file_tree, "_BYTES", size)
            found.append([line for block in file_tree._line_blocks(pa.BufferReader(body)) for line in block.split(b"\n")])
        assert all(f == found[-1] for f in found)


def test_gzip_files_hold_their_contents_in_pieces(spark, tmp_path, monkeypatch):
    body = bytes(range(256)) * 50
    monkeypatch.setattr(file_tree, "_BYTES", 1_000)
    assert gzip.decompress(b"".join(file_tree._gzipped(pa.py_buffer(body)))) == body
    files = spark.createDataFrame([("a.gz", bytearray(body)), ("b.gz", bytearray()), ("c.gz", None)], "relative string, content binary")
    assert file_tree.write(files, str(tmp_path), compression="gzip") == 3
    assert [gzip.decompress((tmp_path / f"{n}.gz").read_bytes()) for n in "abc"] == [body, b"", b""]


def test_rejected_files_are_found_without_storing_lines(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"a b{i}", "en", "web") for i in range(4)], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stored = []
    kept = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: stored.append(df.columns) or kept(df, name))
    assert content(catalog.QUERIES["reject_files"](spark, str(tmp_path)), "path", "reason") == [("en/web/1/main.c", "unparsable")]
    assert not any("value" in columns for columns in stored)
    assert catalog.QUERIES["token_dump_parse"](spark, str(tmp_path)).count() == 9


def test_repositories(spark, tmp_path):
    raw = ['{"language":"C","full_name":"o/r","fork":false,"size":5,"stargazers_count":50,"extra":1}'] * 2 + [
        '{"language":"C","full_name":"o/q","fork":true,"size":1,"stargazers_count":9}',
        '{"language":"C++","full_name":"o/z","fork":true,"size":1,"stargazers_count":70}',
    ]
    table = repos.flatten(spark.createDataFrame([(v,) for v in raw], "value string"))
    assert table.count() == 3
    assert [r["full_name"] for r in repos.popular(table, "c", 10).collect()] == ["o/r"]
    repos.write(table, str(tmp_path / "repos"))
    assert content(repos.read(spark, str(tmp_path / "repos")), "full_name", "stars") == [
        ("o/q", 9), ("o/r", 50), ("o/z", 70),
    ]


def test_arriving_documents_are_taken_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = docs(spark, ["a b"])
    for name in ("one", "two"):
        frame.withColumn("path", F.lit(name)).write.mode("append").parquet(source)
        for _ in range(2):
            stream = arriving_documents(spark, source, frame.schema, max_files=1)
            tokenize_available(stream, WORDS, out, state).awaitTermination()
    table = token_files.read(spark, out)
    assert content(table.groupBy("path").count(), "path", "count") == [("one", 3), ("two", 3)]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    texts = {"p/main c.c": "a b c", "q/main c.c": "d e", "q+/50%.c": "f"}
    frame = spark.createDataFrame([("D", p, t) for p, t in texts.items()], DOCS)
    lines = render_dump(tokenize(frame, WORDS)).orderBy("path", "token_num").collect()
    for path in texts:
        target = tmp_path / "dump" / f"{path}.tokens"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("\n".join(r["value"] for r in lines if r["path"] == path) + "\n")
    dumped = token_files.read_dump(spark, str(tmp_path / "dump"), "D")
    assert {r["path"] for r in dumped.select("path").collect()} == {f"{tmp_path}/dump/{p}.tokens" for p in texts}
    parsed = token_files.parse_dump(dumped, token_files.unreadable_files(dumped))
    assert parsed.select("uuid").distinct().count() == parsed.count() == 9
    assert {r["file_name"] for r in parsed.collect()} == {"main c.c.tokens", "50%.c.tokens"}
    pairs = {r["key"] for r in file_key_counts(token_keys(parsed, "bigram_text", all_pairs=True)).collect()}
    assert pairs == {"a<<>>b", "b<<>>c", "c<<>><EOF>", "d<<>>e", "e<<>><EOF>", "f<<>><EOF>"}
    table = str(tmp_path / "table")
    incremental.append_tokens(spark, parsed.filter("path LIKE '%/p/%'"), table)
    incremental.append_tokens(spark, parsed, table)
    assert token_files.read(spark, table).count() == 9
    listed = incremental.manifest(dumped.select("path").distinct(), str(tmp_path / "dump"), str(tmp_path / "out"), ".csv")
    (tmp_path / "out" / "q").mkdir(parents=True)
    (tmp_path / "out" / "q" / "main c.c.csv").write_text("x")
    done = incremental.finished(spark, str(tmp_path / "out"), "*.csv")
    none = spark.createDataFrame([], "path string, reason string")
    assert {r["src_file"].rsplit("/", 2)[1] for r in incremental.pending(listed, done, none).collect()} == {"p", "q+"}
