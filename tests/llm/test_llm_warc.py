import hashlib

from llm_data import docs
from shiftscope.llm import warc
from shiftscope.session import shared_folder

BIG = "<p>" + "payload " * 30 + "</p>"
PAGES = [(1, "http://a/1", "<html>one</html>"), (2, "http://a/2", BIG), (3, "http://a/3", BIG), (4, None, None), (5, "http://a/5", ""),
         (6, "http://a/6\r\nX: y", "head\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" + BIG), (7, "u", BIG + "\r\n"), (8, "u", BIG + "\r\n\r\n"),
         (9, "u", "é漢😀" * 60 + "\r"), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "\r\r\n\r\n" + BIG), (13, "u", "y" * 200_000),
         (2, "http://a/2", BIG), (3, "http://other/3", BIG), (14, "u", "\r\n\r\n\r\n\r\n"), (None, "n", "z" * 120), (None, "n", "z" * 120)]


def frame(spark, rows):
    docs(spark)
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, record_type string, copy int").repartition(3)


def brute(rows):
    out, first = [], {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for p, u, h in sorted(rows, key=key):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and d in first
        out.append((p, len(b), d, "revisit" if again else "response", first[d] if again else None))
        first.setdefault(d, p)
    return sorted(out, key=str)


def test_written_archives_read_back_whole(spark):
    got = sorted((tuple(r) for r in warc.op9_warc(frame(spark, PAGES)).collect()), key=str)
    assert got == brute(PAGES)


def test_captures_are_assembled_with_payloads(spark):
    path = shared_folder(spark, "test-warc")
    warc.write_archive(frame(spark, PAGES), path)
    rec = warc.read_records(spark, path).collect()
    assert len(rec) == 3 * len(PAGES) and len({r.record_id for r in rec}) == len(rec)
    assert all(r.payload_digest == r.stored_digest for r in rec if r.record_type == "response")
    caps = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(caps) == len(PAGES) and all(c.request is not None and c.metadata is not None for c in caps)
    html = {r[0]: r[2] or "" for r in PAGES}
    for c in caps:
        pid = c.metadata["fields"].get("pageid")
        if c.record_type == "response":
            assert c.response.payload == html[int(pid) if pid else None]


def test_empty(spark):
    assert warc.op9_warc(frame(spark, PAGES).limit(0)).count() == 0


def test_urls_are_read_as_they_were(spark):
    urls = ["http://x/a%20b", "http://x/a%2520b", "http://x/%", "http://x/?q=é:1", None]
    path = shared_folder(spark, "urls-warc")
    warc.write_archive(frame(spark, [(i, u, "h") for i, u in enumerate(urls)]), path)
    caps = warc.assemble(warc.read_records(spark, path)).collect()
    assert {int(c.metadata["fields"]["pageid"]): c.target_uri for c in caps} == dict(enumerate(urls))
    broken = shared_folder(spark, "broken-warc")
    warc.write_archive(frame(spark, [(1, "http://x/1\r\nX: y", "h")]), broken)
    assert [r.target_uri for r in warc.read_records(spark, broken).collect()] == ["http://x/1%0D%0AX: y"] * 3


def test_files_are_bounded(spark):
    path = shared_folder(spark, "small-warc")
    warc.write_archive(frame(spark, PAGES).coalesce(1), path, captures_per_file=2)
    assert len(spark.read.text(path).inputFiles()) >= len(PAGES) // 2
    assert warc.read_records(spark, path).count() == 3 * len(PAGES)
