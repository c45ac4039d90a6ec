"""The pipeline, stage by stage, against plain versions of its decisions; and the queries against SQL."""

import pytest

import corpus_pipeline
from glyphstat.llm import line_dedup, quality_forest, queries, sql, superminhash
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def words(rows):
    return sum(len((r.text or "").split()) for r in rows)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, out = [name for name, _ in corpus_pipeline.STAGES], {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_round_trip"]
    assert all(out[name].columns == out["start"].columns for name in names[:-1])

    start = out["start"].collect()
    good = {r.doc_id: r for r in out["quality_rules"].collect()}
    forest = quality_forest.fit_labelled(quality_forest.stats(out["start"]), spark.read.parquet(f"{SF}/labels.parquet"))
    table = quality_forest.text_stats([r.text.encode() for r in start])
    assert set(good) == {r.doc_id for r, k in zip(start, quality_forest.verdicts(table, forest)[1], strict=True) if k}

    # Every line that went stands in an earlier document.
    lines = {r.doc_id: r.text for r in out["line_dedup"].collect()}
    for doc_id, r in good.items():
        kept = lines.get(doc_id, "").split("\n")
        for line in r.text.split("\n"):
            if line not in kept:
                assert any(line in other.text.split("\n") for i, other in good.items() if i < doc_id)

    near = {r.doc_id for r in out["near_dedup"].collect()}
    groups = superminhash.near_duplicates(out["line_dedup"]).collect()
    assert near == {r.component_id for r in groups}
    mixed, before = out["mix_sources"].collect(), out["near_dedup"].collect()
    assert words(mixed) == pytest.approx(1.5 * words(before), rel=0.02)
    texts = sorted(r.text for r in mixed)
    assert sorted(r.decoded for r in out["bpe_round_trip"].collect()) == texts
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_stage_keeps_whole_documents(spark):
    rows = [(1, "a b\n" * 9, "en", "s", 36), (2, "c", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert line_dedup.without_common_blocks(docs).filter("n_removed > 0").count() == 0
    assert corpus_pipeline.line_dedup_stage(spark, docs, SF).count() == 3
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, kept_text string, gone_id long, row int, _id string"
X, Y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", 8, 9, "q") for i, t in rows], SCHEMA)


def test_one_row_of_each_group_stays(spark):
    docs = rows_of(spark, [(3, X), (5, X), (5, Y), (9, Y + " q"), (9, Y + " q"), (None, X), (None, X), (4, ""), (4, None), (4, None)])
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, X), (5, Y), (None, X), (None, X), (4, ""), (4, None), (4, None)], key=str)
    equal = corpus_pipeline.near_dedup(spark, rows_of(spark, [(2, X), (2, X), (2, X)]), SF).collect()
    assert [(r.doc_id, r.text) for r in equal] == [(2, X)]


def test_columns_of_any_name_pass_through(spark):
    block = "\n".join(f"a line with several words number {i}" for i in range(6))
    docs = rows_of(spark, [(1, block), (2, "new\n" + block), (3, None), (None, block)])
    out = corpus_pipeline.line_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.n_removed, r.kept_text, r.gone_id, r.row) for r in out.collect()}
    assert got[2] == ("new", 3, 7, "k", 8, 9) and got[1][0] == block and got[3][0] is None


@pytest.mark.parametrize("rows", [0, 7])
def test_the_whole_pipeline_on_odd_rows(spark, tmp_path, rows):
    long = "\n".join(" ".join(f"word{i * 9 + k}" for k in range(9)) for i in range(20_000))
    other = " ".join(f"other{i}" for i in range(90))
    odd = [(1, long), (1, long), (2, None), (None, "no id " + other), (3, ""), (2, "one " * 90), (2, other)][:rows]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without an id a row is in no group, so its text and the other one both stay; words are mixed to 150 %.
    assert {r.doc_id for r in out} == ({1, 2, None} if rows else set())
    kept = 180_000 + 90 + 92 if rows else 0
    assert sum(len(r.decoded.split()) for r in out) == pytest.approx(1.5 * kept, abs=100)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_match_sql(spark, name):
    problem = difference(queries.QUERIES[name](spark, SF), connect(SF), sql.ORACLES[name])
    assert not problem, problem
