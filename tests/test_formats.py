"""Data sources of sequence and pattern files, cut at every kind of place."""

import pytest

from motifmill.sources import formats, readers


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_splits_cut_anywhere(spark, tmp_path, split):
    formats.register(spark)
    read = lambda kind, path: sorted(tuple(r) for r in spark.read.format(kind).option("splitBytes", split).load(str(path)).collect())
    (tmp_path / "a.fa").write_text(">r1 a->b\nACGTN\r\nacg\n>r2\nTT\n> r3 empty\n>r4\nA>C")
    assert read("fasta", tmp_path / "a.fa") == [("", ""), ("r1", "ACGTNacg"), ("r2", "TT"), ("r4", "A>C")]
    (tmp_path / "a.fq").write_text("@q1 x\nACGT\n+\n@III\n@q2\nGG\n+q2\n@+\n@q3\n\n+\n\n@q4\nG\n+\n@\n")
    assert read("fastq", tmp_path / "a.fq") == [("q1", "ACGT", "@III"), ("q2", "GG", "@+"), ("q3", "", ""), ("q4", "G", "@")]
    (tmp_path / "fixed").mkdir()
    (tmp_path / "fixed" / "a").write_bytes(b"# number=3 length=4\nab\ncdef\xe9\n#gh")
    (tmp_path / "fixed" / "b").write_bytes(b"# number=1 length=2\nxy")
    (tmp_path / "fixed" / "_no").write_bytes(b"nothing")
    assert read("fixed_width", tmp_path / "fixed") == [(0, "ab\nc"), (1, "def\xe9"), (2, "\n#gh"), (3, "xy")]
    (tmp_path / "none").write_text("")
    assert read("fasta", tmp_path / "none") == read("fastq", tmp_path / "none") == []


def test_fixed_width_files_are_written_in_order(spark, tmp_path, monkeypatch):
    formats.register(spark)
    path = str(tmp_path / "out")
    rows = spark.range(1000).selectExpr("lpad(cast(id as string), 5, '0') as p").repartitionByRange(4, "p").sortWithinPartitions("p")
    rows.write.format("fixed_width").option("length", 5).mode("append").save(path)
    got = readers.read_fixed_width_patterns(spark, path).orderBy("nth").collect()
    assert [tuple(r) for r in got] == [(k, f"{k:05d}") for k in range(1000)]
    with pytest.raises(Exception, match="not of 4 bytes"):
        rows.write.format("fixed_width").option("length", 4).mode("append").save(str(tmp_path / "bad"))
    assert readers.read_fixed_width_patterns(spark, str(tmp_path / "bad")).count() == 0
