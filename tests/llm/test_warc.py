"""Round trip, byte-for-byte repetition, rolling and recovery."""

import gzip
import hashlib
import os
import zlib

import pytest

from pyspark.sql import functions as F

from marketspark.llm import warc
from marketspark.llm.common import range_parts
from marketspark.session import new_path


def pages(spark, n=120):
    rows = [(i, f"http://h{i % 7}/p?{i}", ("same body " * 30 if i % 5 == 0 else f"<p>page {i} é</p>" * (i % 40))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), {r[0]: r for r in rows}


def local(root):
    return root.removeprefix("file://")


def test_round_trip_and_rolling(spark):
    frame, rows = pages(spark)
    root = new_path(spark, "test-warc")
    manifest = warc.write(frame, root, roll=3000, shards=3)
    got = {r.page_id: r for r in warc.read(manifest, root, payload=True).collect()}
    assert set(got) == set(rows)
    for i, (_, url, html) in rows.items():
        body = html.encode()
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 0) if i % 5 == 0 and i else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else body)
    files = manifest.orderBy("name").collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(rows)
    assert all(a.last_id < b.first_id for a, b in zip(files, files[1:]))
    for f in files:
        data = open(f"{local(root)}/{f.name}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f.bytes, f.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert os.listdir(f"{local(root)}/_temporary") == []


def test_written_alike_each_time(spark):
    frame, _ = pages(spark)
    a, b = ({(f.name, f.sha256) for f in warc.write(x, new_path(spark, "test-warc"), roll=3000, shards=3).collect()} for x in (frame, frame.repartition(2)))
    assert a == b


def test_ranges_depend_on_the_rows_alone(spark):
    rows = [(i // 3, i) for i in range(900)] + [(None, i) for i in range(50)] + [(7, i) for i in range(300)]
    frames = [spark.createDataFrame(rows, "k long, t long").repartition(n) for n in (1, 5)]
    a, b = (sorted(((r.part, r.k, r.t) for r in range_parts(f, 8, "k", F.col("t")).collect()), key=repr) for f in frames)
    assert a == b and len({p for p, *_ in a}) > 4 and len(a) == len(rows)
    keys = {}
    for part, k, t in a:
        keys.setdefault(part, []).append((1 << 63 if k is None else k, t))
    assert all(max(keys[p]) <= min(keys[q]) for p, q in zip(sorted(keys), sorted(keys)[1:]))
    whole = range_parts(frames[1], 8, "k").select("k", "part").distinct().collect()
    assert len({r.k for r in whole}) == len(whole)  # without a tie rows of one key stay together


def test_damage_is_found():
    good = warc.record(1, "u", b"x" * 150, hashlib.sha256(b"x" * 150).hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload_bytes"] == 150
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"xxx", b"xyx", 1))


def test_loss_is_found(spark):
    """A file cut between two records, and one that is gone, end the reading."""
    frame, _ = pages(spark)
    for harm in ("cut", "gone"):
        root = new_path(spark, "test-warc")
        manifest = warc.write(frame, root, roll=3000, shards=2)
        whole = warc.read(manifest, root).count()
        assert whole == frame.count()
        path = f"{local(root)}/{manifest.filter('records > 2').first().name}"
        if harm == "gone":
            os.remove(path)
        else:
            data = open(path, "rb").read()
            members = []
            while data:
                press = zlib.decompressobj(31)
                press.decompress(data)
                members.append(data[: len(data) - len(press.unused_data)])
                data = press.unused_data
            assert len(members) > 3
            open(path, "wb").write(b"".join(members[:-1]))
        with pytest.raises(Exception, match="manifest|No such file|not found"):
            warc.read(manifest, root).count()


def test_pages_without_ids_are_spread(spark):
    rows = [(None, f"u{i}", f"{i % 700} " * 60) for i in range(2000)] + [(1, "u", "5 " * 60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    root = new_path(spark, "test-warc")
    manifest = warc.write(frame, root, shards=8)
    assert max(r.records for r in manifest.collect()) < 800
    got = warc.read(manifest, root).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" and r.refers_to == 1 for r in got) == 3  # of 5, 705, 1405
