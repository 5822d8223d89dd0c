"""Files read and written."""

import pytest
from pyspark.sql import functions as F

from profilespark.sources import readers as R
from profilespark.streaming.rollup import rollup, stream_rollup
from tests.conftest import rows


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_wide_tables(spark, tmp_path):
    mq = write(tmp_path, "mq.txt", "Protein IDs\tGene names\tLFQ intensity A\tLFQ intensity B\nP1;P2\tG1\t5\tNaN\nP3\t\t\t7\n")
    ds = R.read_maxquant(spark, mq)
    assert rows(ds.cells) == [("P1;P2", "A", 5.0), ("P1;P2", "B", 0.0), ("P3", "A", 0.0), ("P3", "B", 7.0)]
    assert rows(ds.var, "var_id", "var_pos") == [("A", 0), ("B", 1)] and "Gene_names" in ds.obs.columns
    fp = write(tmp_path, "fp.tsv", "Protein\tA MaxLFQ Intensity\nP1\t3\n")
    assert rows(R.read_fragpipe(spark, fp).cells) == [("P1", "A", 3.0)]
    with pytest.raises(ValueError):
        R.read_maxquant(spark, fp)


def test_long_table(spark, tmp_path):
    dn = write(tmp_path, "dn.tsv", "Protein.Group\tRun\tPG.MaxLFQ\nP1\tr1\t2\nP1\tr1\t2\nP1\tr2\t\n\tr1\t3\n")
    assert rows(R.read_diann(spark, dn).cells) == [("P1", "r1", 2.0), ("P1", "r2", 0.0)]


def test_gene_sets(spark, tmp_path):
    gmt = write(tmp_path, "s.gmt", "A\tsrc\tg1\tg2\nB\tsrc\tg2\tg1\t\nshort\tx\nC\tsrc\tg3\nC\tsrc\tg4\n")
    assert rows(R.read_gmt(spark, gmt)) == [("A", "g1"), ("A", "g2"), ("C", "g4")]
    assert {r.term for r in R.read_gmt(spark, gmt, deduplicate=False).collect()} == {"A", "B", "C"}


def test_vocabulary(spark, tmp_path):
    text = "ID   Membrane.\nAC   SL-1\nDE   A thin\nDE   layer.\nSY   Skin; Hull.\nHP   Cell.\nHP   Organ.\nGO   GO:1; x\n//\nID   Cell.\nAC   SL-2\n//\nID   no accession\n//\n"
    v = {r.ac: r for r in R.read_vocabulary(spark, write(tmp_path, "v.txt", text)).collect()}
    assert set(v) == {"SL-1", "SL-2"} and v["SL-1"].de == "A thin layer" and v["SL-1"].hp == ["Cell", "Organ"] and v["SL-1"].sy == ["Skin", "Hull"]


def test_markers(spark, tmp_path):
    m = write(tmp_path, "m.tsv", "id\tmarker_x\tmarker_y\nP1\tER\t\n")
    assert R.read_markers(spark, m, ["x", "zz"]).columns == ["id", "marker_x"]
    with pytest.raises(ValueError):
        R.read_markers(spark, m, ["zz"])


def test_msnset_round_trip(spark, tmp_path):
    e = write(tmp_path, "e.tsv", "id\ts1\ts2\nP1\t1\tNaN\nP2\t3\t4\n")
    f = write(tmp_path, "f.tsv", "id\tmarkers\nP1\tunknown\nP2\tER\n")
    p = write(tmp_path, "p.tsv", "id\tfraction\ns1\t1\ns2\t2\n")
    ds = R.read_msnset_tables(spark, e, f, p)
    assert rows(ds.cells) == [("P1", "s1", 1.0), ("P1", "s2", 0.0), ("P2", "s1", 3.0), ("P2", "s2", 4.0)] and rows(ds.obs, "markers") == [("ER",), (None,)]
    R.write_msnset_tables(ds, str(tmp_path / "out"))
    with pytest.raises(Exception):
        R.write_msnset_tables(ds, str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out" / "fdata"))
    assert rows(back.where("obs_id = 'P1'"), "markers") == [("unknown",)]
    twice = write(tmp_path, "g.tsv", "id\tmarkers\nP1\tx\nP1\ty\n")
    with pytest.raises(ValueError):
        R.read_msnset_tables(spark, e, twice, p)


def test_registry(spark, tmp_path):
    reg = R.Registry(spark, str(tmp_path), ["one"])
    with pytest.raises(ValueError):
        reg.load("two")
    with pytest.raises(ValueError):
        reg.load("one", "other")


def test_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    df = spark.sql("SELECT timestamp_seconds(id * 900) AS ts, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type, CAST(id AS double) AS value FROM range(40)")
    df.write.parquet(str(tmp_path / "in"))
    q = stream_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    want = rows(rollup(df).where("hour < timestamp_seconds(32400)"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("hour", "event_type", "n", F.round("total", 4).alias("total")).where("hour < timestamp_seconds(32400)")) == want
