import io
import random
import zlib

import pytest

from loomstone.llm import warc as W

SCHEMA = "page_id long, url string, html string, path string"


def gz(raw):
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def expect(rows):
    first = {}
    for p, _, h, *_ in rows:
        d = (h or "").encode()
        if p is not None:
            first[d] = min(p, first.get(d, p))
    out = []
    for p, _, h, *_ in rows:
        d = (h or "").encode()
        revisit = d in first and p != first[d]
        out.append((p, len(d), W.base32_sha1(d), "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = [tuple(r) for r in W.op10_warc(spark, sf).collect()]
    assert sorted(got, key=str) == expect(rows)


def test_edges(spark):
    rows = [(5, "u\r\nX: y", "same é", None), (3, None, "same é", "p"), (None, "u", "same é", None), (9, "v", None, None), (8, "v", "", None), (3, None, "same é", "p"), (1, "w", "x" * 3_000_000, None), (2, "q", "\r\n\r\nWARC/1.1\r\n", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.round_trip(spark, df, archive_bytes=200).collect()
    assert not [r for r in out if r.record_type == "gap"]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == expect(rows)
    whole = {r.page_id: r.payload for r in out if r.record_type == "response"}
    assert bytes(whole[1]) == b"x" * 3_000_000 and bytes(whole[2]) == b"\r\n\r\nWARC/1.1\r\n"
    assert W.round_trip(spark, df.limit(0)).count() == 0
    small = W.round_trip(spark, df, least=100).collect()
    assert all(r.record_type == "response" for r in small)


def test_large_ids_and_long_headers(spark):
    big = 2**53
    rows = [(big + 3, "u", "same", None), (big + 1, "v", "same", None), (None, "w", "other", None), (big + 5, "h" * 3_000_000, "third", None), (-(2**63), "x", None, None)]
    out = W.round_trip(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == expect(rows)
    assert max(len(r.url) for r in out) == 3_000_000


def make(i, body=b"<p>hello</p>"):
    return W.record(i, f"http://x/{i}", body * (i + 1), W.base32_sha1(body * (i + 1)), None, False)


def read(data):
    got = list(W.salvage(io.BytesIO(data), len(data)))
    return [int(x["fields"]["page-id"]) for k, x in got if k == "record"], [x[:2] for k, x in got if k == "gap"]


def test_salvage_of_members():
    parts = [gz(make(i)) for i in range(6)]
    assert read(b"".join(parts)) == ([0, 1, 2, 3, 4, 5], [])
    at = [sum(map(len, parts[:i])) for i in range(7)]
    broken = bytearray(b"".join(parts))
    broken[at[2] + 30] ^= 0xFF
    assert read(bytes(broken)) == ([0, 1, 3, 4, 5], [(at[2], at[3])])
    cut = b"".join(parts[:2]) + parts[2][:40] + b"".join(parts[3:])
    assert read(cut) == ([0, 1, 3, 4, 5], [(at[2], at[2] + 40)])
    assert read(b"junk" + b"".join(parts)) == ([0, 1, 2, 3, 4, 5], [(0, 4)])
    assert read(b"".join(parts)[:-5]) == ([0, 1, 2, 3, 4], [(at[5], at[6] - 5)])
    assert read(b"") == ([], []) and read(b"x" * 10) == ([], [(0, 10)])


def test_salvage_of_plain_records_and_of_a_member_with_many():
    parts = [make(i) for i in range(5)]
    assert read(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    at = [sum(map(len, parts[:i])) for i in range(6)]
    wrong = parts[1].replace(b"hello", b"jello")
    assert read(parts[0] + wrong + b"".join(parts[2:])) == ([0, 2, 3, 4], [(at[1], at[2])])
    assert read(gz(b"".join(parts)) + gz(make(7))) == ([0, 1, 2, 3, 4, 7], [])


def test_salvage_within_a_member_with_many():
    parts = [make(i, random.Random(i).randbytes(9000).hex().encode()) for i in range(6)]
    wrong = parts[2][:-40] + b"?" + parts[2][-39:]  # only its digest fails
    whole = gz(b"".join(parts[:2]) + wrong + b"".join(parts[3:]))
    ids, gaps = read(whole + gz(make(7)))
    assert ids == [0, 1, 3, 4, 5, 7] and len(gaps) == 1
    before = gz(b"".join(parts[:2]))
    after = gz(b"".join(parts[:2]) + wrong)
    assert abs(gaps[0][0] - len(before)) < 200 and abs(gaps[0][1] - len(after)) < 200
    assert read(gz(wrong + parts[3]) + gz(make(7)))[0] == [3, 7]
    assert read(gz(parts[0] + wrong) + gz(make(7)))[0] == [0, 7]
    assert read(b"junk" + gz(wrong + parts[3]))[0] == [3]
    # the stream itself breaks: what comes before stays, the next member is found
    torn = bytearray(gz(b"".join(parts)))
    torn[len(before) + 3000 :] = b""
    ids, gaps = read(bytes(torn) + gz(make(7)))
    assert ids == [0, 1, 7] and len(gaps) == 1
    assert abs(gaps[0][0] - len(before)) < 200 and gaps[0][1] == len(torn)


def test_count_of_records_is_compared(spark, tmp_path):
    (tmp_path / "a").write_bytes(gz(make(0)) + gz(make(1))[:-9])
    df = spark.createDataFrame([(f"{tmp_path}/a", 2)], "path string, records long")
    with pytest.raises(Exception, match="1 records read, 2 written"):
        W.read_archives(df, str(tmp_path)).collect()
    assert W.read_archives(df.drop("records"), str(tmp_path)).where("record_type <> 'gap'").count() == 1
