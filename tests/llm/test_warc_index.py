"""Archives against the pages they were written from; lookups against a plain filter."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from cohortlens.llm.queries import ORACLE, QUERIES
from cohortlens.llm.warc_index import (
    Directory,
    archived,
    find_captures,
    parse,
    read_captures,
    record,
    url_key,
    write_archives,
    write_index,
)

SCHEMA = "page_id bigint, url string, html string, record_type string, payload binary"


def _pages(seed=5, n=400):
    rng = random.Random(seed)
    bodies = [f"<p>é {i} " + "x" * rng.randrange(300) for i in range(60)]
    rows = []
    for i in range(n):
        url = "http://hot.example.com/a" if rng.random() < 0.3 else f"https://{rng.choice('abc')}.example.org/p?q={rng.randrange(50)}"
        rows.append((i * 3, url, rng.choice(bodies) if rng.random() < 0.8 else f"own {i}", "x", b"y"))
    rows += [(5000, None, None, None, None), (5001, "", "", None, None), (5002, "no scheme/path", "", None, None), (5003, "http://u@H.Example.COM:80#f", bodies[0], None, None)]
    rows += [rows[0], rows[7]]
    return rows


def _expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        first[b] = min(first.get(b, i), i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), digest, "response" if first[b] == i else "revisit", None if first[b] == i else first[b]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(_pages(), SCHEMA).repartition(5)
    return write_index(write_archives(pages, archive_bytes=8000), block_lines=16)


def test_all_pages_come_back(spark, archive):
    rows = _pages()
    got = read_captures(archive, find_captures(archive, spark.createDataFrame(rows, SCHEMA)))
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == _expected(rows)
    texts = {i: (html or "").encode() for i, _, html, *_ in rows}
    for r in got.collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == texts[r["page_id"]]


def test_lookup_of_some_urls(spark, archive):
    rows = _pages()
    want = ["http://hot.example.com/a", "HTTPS://A.example.org/p?q=7", "http://nowhere.example.com/", None]
    keys = {url_key(u) for u in want}
    got = find_captures(archive, spark.createDataFrame([(u,) for u in want * 3], "url string")).collect()
    assert sorted(r["page_id"] for r in got) == sorted(i for i, u, *_ in rows if url_key(u) in keys)
    assert archive.directory.count() > 20


def test_files_are_plain_warc(archive):
    files = sorted(Path(archive.folder.removeprefix("file://")).glob("*.warc.gz"))
    assert len(files) > 5  # closed at 8000 bytes
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == archive.captures.count() == len(_pages())


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1\r\n".encode()
    got = parse(record(7, "http://x.example.com/a b", payload, None, False))
    assert (got["page_id"], got["payload"], got["url"], got["refers_to"]) == (7, payload, "http://x.example.com/a%20b", None)
    again = parse(record(None, None, payload, 7, True))
    assert (again["page_id"], again["payload"], again["payload_bytes"], again["refers_to"]) == (None, None, len(payload), 7)
    raw = bytearray(record(7, None, payload, None, False))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        parse(bytes(raw))


def test_keys():
    assert url_key("http://u:p@www.Example.com:80/A/b?c#d") == "com,example,www)/A/b?c"
    assert url_key("https://example.com:8443") == "com,example:8443)/"
    assert url_key(None) == url_key(" ") == "-"


def test_directory_search():
    rng = random.Random(3)
    for _ in range(200):
        keys = sorted(rng.choice("abcdef") for _ in range(rng.randrange(1, 30)))
        size = rng.randrange(1, 6)
        blocks = [keys[i : i + size] for i in range(0, len(keys), size)]
        d = Directory([{"key": b[0], "page_id": size * n, "file": "f", "offset": n, "length": 1} for n, b in enumerate(blocks)])
        for k in "abcdefg":
            assert {n for n, b in enumerate(blocks) if k in b} <= set(d.blocks(k))


def test_null_ids_and_empty_table(spark):
    rows = [(None, "http://a.example.com", "same", "a", b""), (3, None, "same", "a", b""), (None, None, "alone", "a", b"")]
    got = archived(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r["page_id"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(
        [(None, "revisit", 3), (3, "response", None), (None, "response", None)], key=str
    )
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark, sf_small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_small}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {cols} FROM ({ORACLE['op11_warc_index']})").fetchall()
    got = QUERIES["op11_warc_index"](spark, sf_small).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 20
