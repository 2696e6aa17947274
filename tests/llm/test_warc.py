import base64
import gzip
import hashlib
import os
import random
import time
import zlib

import pytest

from quarry.llm import warc
from quarry.llm.shared import new_folder, task_files
from quarry.llm.warc import salvage


def record(i, text=None):
    p = (text or f"page {i} " * 30).encode()
    return warc.record_bytes("response", i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), len(p))


def seen(data):
    ids, gaps = [], []
    for x in warc.walk(data):
        ids.append(warc._page(x.headers["warc-record-id"])) if isinstance(x, warc.Record) else gaps.append(x)
    return ids, gaps


def test_whole_archives_have_no_gaps():
    records = [record(i) for i in range(9)]
    assert seen(b"".join(records)) == (list(range(9)), [])
    assert seen(b"".join(map(gzip.compress, records))) == (list(range(9)), [])
    assert seen(gzip.compress(b"".join(records))) == (list(range(9)), [])
    assert seen(b"") == ([], [])


def test_damage_is_quarantined_and_later_records_recovered():
    rng = random.Random(4)
    for pack in (bytes, gzip.compress):
        parts = [pack(record(i)) for i in range(12)]
        starts = [sum(map(len, parts[:i])) for i in range(13)]
        for _ in range(30):
            i = rng.randrange(12)
            data = bytearray(b"".join(parts))
            at = rng.randrange(starts[i], starts[i + 1])
            data[at] ^= 1 << rng.randrange(8)
            ids, gaps = seen(bytes(data))
            assert set(range(12)) - {i} <= set(ids)
            if i not in ids:
                assert [g[:2] for g in gaps] == [(starts[i], starts[i + 1])]
        cut = b"".join(parts)[: starts[12] - 5]
        ids, gaps = seen(cut)
        whole = 11 if pack is bytes else 12  # a member that has lost its last bytes still gives its record
        assert ids == list(range(whole)) and gaps[-1][:2] == (starts[11], len(cut))
        junk = parts[0] + b"\x00junk WARC/1.0 is not at a line start" + parts[1] + parts[2][: len(parts[2]) // 2] + parts[3]
        ids, gaps = seen(junk)
        assert ids == [0, 1, 3] and len(gaps) == 2


def test_a_payload_that_looks_like_a_record_stays_a_payload():
    inner = record(77).decode()
    outer = record(1, "x\r\n" + inner)
    assert seen(outer + record(2))[0] == [1, 2]
    broken = outer.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert seen(broken + record(2))[0] == [77, 2]


def test_long_urls_and_urls_like_version_lines():
    urls = ["http://x/" + "a" * 200_000, "http://x/WARC/1.0", "http://x/?q=WARC/1.1"]
    parts = [warc.record_bytes("response", i, u, b"page", hashlib.sha256(b"page").hexdigest(), 4) for i, u in enumerate(urls)]
    for pack in (bytes, gzip.compress):
        data = b"".join(map(pack, parts))
        assert seen(data) == ([0, 1, 2], [])
        assert [x.headers["warc-target-uri"] for x in warc.walk(data)] == urls


def test_other_digests_are_verified():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nthe page itself"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()

    def made(i, *lines):
        head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{i}>", "Content-Type: application/http; msgtype=response", *lines, f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(head).encode() + block + b"\r\n\r\n"

    for lines in (["WARC-Payload-Digest: " + sha1(b"the page itself")], ["WARC-Block-Digest: " + sha1(block)], ["WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest()]):
        good = made(1, *lines)
        assert seen(good + made(2, *lines)) == ([1, 2], [])
        ids, gaps = seen(good.replace(b"itself", b"itsela") + made(2, *lines))
        assert ids == [2] and gaps[0][:2] == (0, len(good)) and gaps[0][2].endswith("digest differs")
    assert seen(made(1, "WARC-Block-Digest: other:xyz")) == ([1], [])


def test_lost_pages_fail_the_query(spark, tmp_path, monkeypatch):
    pages(spark, [(1, "http://a/WARC/1.0", "one"), (2, "http://x/" + "a" * 100_000, "two")]).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in warc.op1_warc(spark, str(tmp_path)).collect()) == [1, 2]
    monkeypatch.setattr(warc, "salvage", lambda archives, keep_payload=True: salvage(archives, keep_payload).filter("page_id = 1"))
    with pytest.raises(RuntimeError, match="2 records written, 1 recovered"):
        warc.op1_warc(spark, str(tmp_path))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def test_round_trip_with_revisits_and_odd_rows(spark):
    long = "é" * 60  # 120 bytes
    rows = [(1, "http://a", long), (5, None, long), (3, "u\r\nx", long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "n" * 200), (9, "u", "y" * 99), (10, "u", "y" * 99), (11, "u", "q" * 300_000), (1, "http://a", long)]
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages(spark, rows), folder, archive_bytes=500)
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    from pyspark.sql import functions as F

    got = warc.salvage(manifest.select(F.concat(F.lit(folder + "/"), "file").alias("path"))).collect()
    assert not [r for r in got if r.gap]
    want = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        revisit = p == long.encode() and page_id != 1
        want.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.payload for r in got if r.record_type == "revisit"} == {b""}


def test_no_pages(spark):
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages(spark, []), folder)
    assert manifest.count() == 0
    assert warc.salvage(manifest.selectExpr("file AS path")).count() == 0


def test_gaps_are_reported_by_the_reader(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"broken" + record(2))
    (tmp_path / "b.warc").write_bytes(b"")
    found = warc.salvage(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.warc").select("path")).collect()
    assert sorted(r.page_id for r in found if not r.gap) == [1, 2]
    assert [(r.start, r.end) for r in found if r.gap] == [(len(record(1)), len(record(1)) + 6)]
    assert task_files(f"file://{tmp_path}")[1] == os.fspath(tmp_path)


def test_members_of_any_size_are_read_record_by_record(monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 1000)
    large = gzip.compress(record(1, "x" * 5_000_000) + record(2) + record(3, "y" * 70_000))
    parts = [gzip.compress(record(0)), large, gzip.compress(record(4))]
    assert seen(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    widest = 0
    member = warc._Member(gzip.compress(b"".join(record(i, f"{i} " * 900) for i in range(500))), 0, 1 << 30)
    for _ in member.records():
        widest = max(widest, len(member.window))
    assert widest < 600_000  # a few pieces, while the member holds 1.7 MB


def test_records_before_the_damage_of_a_member_are_recovered():
    """Members of ten records, cut at any place or with a byte flipped: what comes before the damage stays, the rest is a gap."""
    rng = random.Random(7)
    texts = [" ".join(str(rng.random()) for _ in range(40)) for _ in range(10)]
    before, member, after = gzip.compress(record(90)), gzip.compress(b"".join(record(i, t) for i, t in enumerate(texts))), gzip.compress(record(91))
    for _ in range(40):
        at = rng.randrange(20, len(member))
        whole = zlib.decompressobj(31).decompress(member[:at])
        least = sum(len(b"".join(record(i, t) for i, t in enumerate(texts[:k]))) <= len(whole) for k in range(1, 11))
        ids, gaps = seen(before + member[:at] + after)
        assert ids == [90, *range(least), 91] and [g[:2] for g in gaps] == [(len(before), len(before) + at)]
        flipped = bytearray(member)
        flipped[at] ^= 0x55
        ids, gaps = seen(before + bytes(flipped) + after)
        assert ids[0] == 90 and ids[-1] == 91 and set(ids) <= {90, 91, *range(10)} and len(set(ids)) == len(ids)
        assert set(range(max(0, least - 1))) <= set(ids) and [g[:2] for g in gaps] == [(len(before), len(before) + len(member))]


def test_records_behind_a_broken_one_of_a_member_are_recovered():
    parts = [record(i) for i in range(6)]
    parts[2] = parts[2].replace(b"page 2", b"page X", 1)
    parts[4] = parts[4].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    ids, gaps = seen(gzip.compress(b"".join(parts)))
    assert ids == [0, 1, 3, 5] and len(gaps) == 1


@pytest.mark.parametrize("line", [b"WARC/1.0\r\n", b"xWARC/1.0\r\n", b"a: WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 5\r\n"])
@pytest.mark.parametrize("end", [b"", b"\r\n", b"Content-Length: 3\r\n\r\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_the_search_is_linear(line, end, pack):
    data = pack(line * (1_400_000 // len(line)) + end)
    began = time.process_time()
    assert seen(data + record(1))[0] == [1]
    assert time.process_time() - began < 5


def test_many_repeated_payloads_are_joined_by_spreading(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", ("hot" if i % 3 else f"p{i % 30}") * 60) for i in range(200)] + [(None, "u", None)]
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages(spark, rows), folder)
    from pyspark.sql import functions as F

    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.salvage(manifest.select(F.concat(F.lit(folder + "/"), "file").alias("path"))).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert got == {i: ("response", None) if first[html] == i else ("revisit", first[html]) for i, _, html in rows}
