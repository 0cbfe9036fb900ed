"""WARC bundles: exact round trip, record types, random access."""

import hashlib
import io
import os

import pytest
import zstandard
from pyspark.sql import functions as F

import tallyweave.llm.warc_bundles as m
from tests.llm.conftest import SF_DIR

LONG = "é" * 600
ODD = [
    (1001, "http://a/", LONG), (1005, "http://b/\r\nX: y%0A", LONG), (1003, None, LONG), (1005, "http://b/", LONG), (None, "http://n/", LONG),
    (1010, "u", None), (1011, "u", ""), (1012, "u", "short"), (1013, "u", "short"), (1014, "u", "x" * 2_000_000), (None, "u", "y" * 1000), (None, "u", "y" * 1000),
]


def expected(rows):
    groups = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 1000 and r["page_id"] is not None:
            groups[body] = max(groups.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        top = groups.get(body)
        revisit = top is not None and r["page_id"] != top
        out.append((str(r["page_id"]), r["url"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None, None if revisit else body))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.read.parquet(os.path.join(SF_DIR, "pages.parquet")).select("page_id", "url", "html")
    both = pages.unionByName(spark.createDataFrame(ODD, "page_id long, url string, html string")).withColumn("payload", F.lit(1)).withColumn("d", F.lit(2))
    path = str(tmp_path / "bundles")
    m.write_bundles(both, path)
    bundles = spark.read.parquet(path)
    got = [
        (str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
        for r in m.read_bundles(bundles).collect()
    ]
    want = expected(both.collect())
    assert sorted(got, key=str) == want
    # every record by its index entry
    images = {r["bundle"]: bytes(r["data"]) for r in bundles.collect()}
    index = m.record_index(bundles).collect()
    assert len(index) == len(want)
    for i in index:
        one = m.read_record(images[i["bundle"]], i["frame"], i["offset"], i["length"])
        (_, length, head, _, _), = m.parse_records(one)
        assert length == i["length"] and m._id_of(head["WARC-Record-ID"]) == i["page_id"]
    # an ordinary decoder reads the same bytes, file by file
    m.export_bundles(bundles, str(tmp_path / "files"))
    for name, image in images.items():
        with open(tmp_path / "files" / f"{name}.warc.zst", "rb") as f:
            assert f.read() == image
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(image), read_across_frames=True).read()
        assert plain == b"".join(m.read_frame(image, f) for f in m.seek_table(image))
    assert m.read_bundles(bundles.limit(0)).count() == 0


def test_frames_and_damage():
    writer = m.BundleWriter()
    for i in range(40):
        body = os.urandom(20_000)
        writer.add(i, m.record_bytes(i, "u", body, hashlib.sha1(body).hexdigest(), len(body), None, False))
    image = writer.close()
    frames = m.seek_table(image)
    assert len(frames) > 2 and writer.index[-1]["frame"] == len(frames) - 1
    with pytest.raises(ValueError):
        m.seek_table(image[:-1])
    plain = bytearray(m.read_frame(image, frames[0]))
    plain[5000] ^= 1
    with pytest.raises(ValueError):
        m._frame_rows(bytes(plain), True)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    m.write_bundles(empty, str(tmp_path / "none"))
    assert m.read_bundles(spark.read.parquet(str(tmp_path / "none"))).count() == 0
