"""Pages with urls that no header holds."""

from densigrid.llm import warc


def test_pages_with_very_long_urls_are_read_back(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "é" * (5 << 20), bytearray(b"one")), (2, "http://b/\r\nX: y", bytearray(b"two")), (3, "", bytearray(b"three"))], "id long, url string, payload binary")
    found = warc.read_archives(warc.write_archives(pages)).collect()
    assert {(r["kind"], r["record_id"], bytes(r["payload"])) for r in found} == {("record", 1, b"one"), ("record", 2, b"two"), ("record", 3, b"three")}
