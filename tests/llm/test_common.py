"""Scratch tables."""

from rastrel.llm import common


def test_scratch_tables_have_no_checksum_files(spark):
    """In a local folder each would cost one more process that shares an executor's memory until it runs."""
    made = common.table(spark.range(100, numPartitions=3), "plain")
    jvm, path = spark.sparkContext._jvm, made.inputFiles()[0].rpartition("/")[0]
    names = [f.name for f in __import__("pathlib").Path(jvm.java.net.URI(path).getPath()).iterdir()]
    assert any(n.startswith("part-") for n in names) and not [n for n in names if n.endswith(".crc")]
    assert made.count() == 100 and made.columns == ["id"]
    common.discard(made)
