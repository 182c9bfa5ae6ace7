import gzip
import hashlib
import os
import uuid

import duckdb
import pytest

import dealflow.llm.queries as q
from dealflow.llm.common import shared_folder
from dealflow.llm.warc import _open, member, members, read_manifest, read_warc, round_trip, write_warc
from llm_fixtures import SF_SMALL, shipped  # noqa: F401

SCHEMA = "page_id bigint, url string, html string, part int, start int, shard int, payload int, repeated int, largest int, member int, of_digest int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], SCHEMA)


def brute(rows, least=1000):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "").encode() == data]
        revisit = len(data) >= least and max(equal) != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(equal) if revisit else None))
    return sorted(out, key=repr)


def many():
    rows = [(i, f"http://a.example/{i % 9}?q=é {i}\r\nX: y", f"<p>{i % 23}</p>" * (40 + i % 90)) for i in range(300)]
    rows += [(i, "http://b.example/", "<html>copy</html>" * 100) for i in range(1000, 1200)]
    return rows + [(2000, None, None), (2001, "", ""), (2002, "u", "é漢🙂" * 30000), (2003, "u", "x" * 999), (2004, "u", "x" * 999), (2005, "u", "x" * 1000),
                   (2006, "u", "x" * 1000), (-4, "u", "\x00\r\n\r\nWARC/1.1\r\n" * 200)]


def test_round_trip_against_brute_force(spark):
    rows = many()
    got = round_trip(pages(spark, rows).repartition(7), roll_bytes=3000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_files_are_the_same_however_rows_are_dealt(spark):
    made = []
    for n in (1, 6):
        folder = shared_folder(spark, "test-warc")
        write_warc(pages(spark, many()).repartition(n, "html"), folder, roll_bytes=3000)
        files = read_manifest(spark, folder).orderBy("shard").drop("temporary").collect()
        assert len(files) > 3 and [f.file for f in files] == sorted(f.file for f in files)
        root = _open(folder)[1]
        for f in files:
            data = open(f"{root}/{f.file}", "rb").read()
            assert len(data) == f.bytes and hashlib.sha1(data).hexdigest() == f.sha1
            # a gzip reader sees one stream of whole records
            text = gzip.decompress(data)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
        assert not os.listdir(f"{root}/temporary")
        made.append(files)
        back = read_warc(spark, folder)
        texts = {r.page_id: r.payload for r in back.filter("record_type = 'response'").collect()}
        assert all(texts[i] == (html or "").encode() for i, _, html in many() if i in texts)
        # every offset is the beginning of a member
        some = back.filter("page_id = 2002").first()
        assert gzip.GzipFile(fileobj=open(f"{root}/{some.file}", "rb")) and open(f"{root}/{some.file}", "rb").read()[some.offset:some.offset + 2] == b"\x1f\x8b"
        ids = [r.page_id for r in back.orderBy("file", "offset").collect()]
        assert ids == sorted(ids)
    assert made[0] == made[1]


def test_odd_rows(spark):
    long = "y" * 1500
    rows = [(None, None, long), (None, "u", long), (5, "u", long), (5, "u", long), (5, "v", long), (6, "u", None), (6, "u", None)]
    got = sorted((tuple(r)[:1] + tuple(r)[3:] for r in round_trip(pages(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, "revisit", 5), (None, "revisit", 5), (5, "response", None), (5, "revisit", 5), (5, "revisit", 5),
                          (6, "response", None), (6, "response", None)], key=repr)
    nulls = sorted((r.record_type, r.refers_to) for r in round_trip(pages(spark, rows[:2])).collect())
    assert nulls == [("response", None), ("revisit", None)]
    assert round_trip(pages(spark, [])).count() == 0


def test_damaged_archives_are_noticed(spark):
    folder = shared_folder(spark, "test-warc")
    write_warc(pages(spark, [(1, "u", "abc" * 500)]), folder)
    path = f"{_open(folder)[1]}/{read_manifest(spark, folder).first().file}"
    parts = [data for _, data in members(open(path, "rb"))]
    open(path, "wb").write(b"".join(member(p.replace(b"abcabc", b"abdabc", 1)) for p in parts))
    with pytest.raises(Exception, match="differs"):
        read_warc(spark, folder).collect()
    with pytest.raises(Exception):  # nothing was committed there
        read_warc(spark, f"{folder}-{uuid.uuid4().hex}").collect()


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    got = q.QUERIES["op13_warc"](spark, SF_SMALL)
    want = con.sql(q.ORACLES["op13_warc"])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
