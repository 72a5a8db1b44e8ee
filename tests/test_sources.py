import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import readers as R


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,y\nCC,1.5\nC,x\n")
    d = R.load(spark, "csv", str(tmp_path / "a.csv"))
    assert [tuple(r) for r in d.select("smiles", F.expr("try_cast(y AS double)")).collect()] == [("CC", 1.5), ("C", None)]
    (tmp_path / "b.csv").write_text("p;q\n1;2\n")
    assert R.load(spark, "semicolon", str(tmp_path / "b.csv"), schema="p int, q int").first() == (1, 2)


def test_comments_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "m.maf.gz", "wt") as f:
        f.write("#version 2\n#x\ngene\tsample\nTP53\tS1\nKRAS\tS2\n")
    assert {r["gene"] for r in R.load(spark, "mutations", str(tmp_path / "m.maf.gz")).collect()} == {"TP53", "KRAS"}


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fasta").write_text(">1abc|H|Heavy\nEVQ\nLVE\n>1abc|L|Light\nDIQ\n>2xyz|H|Heavy\nQVQ\n>bad\n\n")
    d = R.load(spark, "fasta", str(tmp_path / "s.fasta"))
    assert d.count() == 4
    assert [tuple(r) for r in R.paired_chains(d).collect()] == [("1abc", "EVQLVE", "DIQ")]


def test_file_names_become_columns(spark, tmp_path):
    for name in ("rf_ecfp4_legacy", "svm_pdv_outlier"):
        (tmp_path / f"{name}.csv").write_text("sigma,r2\n0.0,0.8\n0.6,0.5\n")
    d = R.load(spark, "named_runs", str(tmp_path / "*.csv"), schema="sigma double, r2 double")
    assert {tuple(r) for r in d.select("model", "representation", "strategy").distinct().collect()} == {("rf", "ecfp4", "legacy"), ("svm", "pdv", "outlier")}


def test_matrix_and_unknown(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6).reshape(3, 2))
    assert [r["values"] for r in R.load(spark, "npy", str(tmp_path / "x.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(ValueError):
        R.load(spark, "nothing", "x")


def test_cache_and_checkpoint(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert R.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1
    p = str(tmp_path / "runs")
    R.write_checkpoint(spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int"), p, "model")
    R.write_checkpoint(spark.createDataFrame([("a", 9)], "model string, v int"), p, "model")
    assert {(r["model"], r["v"]) for r in spark.read.parquet(p).collect()} == {("a", 9), ("b", 2)}


def test_sinks(spark, tmp_path):
    for kind in ("csv", "json", "parquet"):
        R.write_results(spark.range(2), str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        R.write_results(spark.range(1), str(tmp_path / "z"), "latex")


def test_matrix_goes_by_row_ranges(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(5000, 7))
    np.save(tmp_path / "c.npy", m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m.astype("float32")))
    np.save(tmp_path / "v.npy", np.arange(7))
    np.save(tmp_path / "empty.npy", np.empty((0, 7)))
    d = R.load(spark, "npy", str(tmp_path), range_bytes=7 * 8 * 400, batch_bytes=7 * 8 * 150)
    assert d.rdd.getNumPartitions() == 13 + 7 + 1
    got = {(r["file"].rsplit("/", 1)[1], r["row"]): r["values"] for r in d.collect()}
    assert len(got) == 10001 and got["v.npy", 0] == list(range(7))
    assert np.array_equal([got["c.npy", i] for i in range(5000)], m)
    assert np.array_equal([got["f.npy", i] for i in range(5000)], m.astype("float32"))


@pytest.mark.parametrize("bad", [np.array([{}, None], dtype=object), np.zeros((2, 2, 2)), np.array(["a"])])
def test_matrix_refuses_what_is_no_table_of_numbers(spark, tmp_path, bad):
    np.save(tmp_path / "o.npy", bad, allow_pickle=True)
    with pytest.raises(Exception, match="not numbers|axes"):
        R.load(spark, "npy", str(tmp_path / "o.npy")).count()


def test_matrix_that_ends_early_is_an_error(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((100, 4)))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends before"):
        R.load(spark, "npy", str(tmp_path / "a.npy")).collect()


def test_matrix_is_written_in_bounded_pieces(spark, tmp_path):
    d = spark.range(0, 1000, 1, 2).select(F.array(F.col("id").cast("double"), (F.col("id") * 2).cast("double")).alias("m"))
    for n in (1000, 300):  # the second replaces the first
        files = R.write_matrix(d.filter(F.col("m")[0] < n), str(tmp_path / "out"), "m", piece_bytes=16 * 128).collect()
        assert sum(r["rows"] for r in files) == n and max(r["rows"] for r in files) <= 128
        back = R.load(spark, "npy", str(tmp_path / "out")).collect()
        assert sorted(r["values"] for r in back) == [[i, 2 * i] for i in range(n)]
    assert all(p.suffix == ".npy" for p in (tmp_path / "out").iterdir())
    assert sum(len(np.load(p)) for p in (tmp_path / "out").iterdir()) == 300
    R.write_matrix(d.filter("false"), str(tmp_path / "none"), "m")
    assert R.load(spark, "npy", str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("values", ["array(id, 1)", "if(id = 3, array(id), array(id, 1))", "array(id, if(id = 3, null, 1))", "if(id = 3, null, array(id, 1))"])
def test_matrix_rows_are_as_long_as_each_other(spark, tmp_path, values):
    d = spark.range(0, 6, 1, 1).selectExpr(f"{values} AS m")
    if values == "array(id, 1)":
        assert R.write_matrix(d, str(tmp_path / "out"), "m").first()["rows"] == 6
    else:
        with pytest.raises(Exception, match="holds no nulls|in one matrix"):
            R.write_matrix(d, str(tmp_path / "out"), "m")
        assert not list((tmp_path / "out").glob("*"))
