import gzip
import os
import tempfile
from hashlib import sha256

from feedback_signals.llm import warc

from . import fixtures


def _pages(spark):
    same = "<p>" + "again " * 40
    rows = [(i, f"http://h.example/{i}", f"<p>{fixtures.words(60, i)}", "x") for i in range(40)]
    rows += [(100 + i, f"http://c.example/{i}", same, "x") for i in range(30)]
    rows += [(200, None, None, "x"), (201, "http://e.example/\r\nä", "", "x"), (202, "u", "small", "x"), (203, "u", "small", "x"), (None, "u", same, "x"),
             (204, "u", fixtures.words(20_000, 9) + "\r\n\r\nWARC/1.1\r\n", "x")]
    rows.append(rows[0])
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archive_round_trip_equals_brute_force(spark):
    rows, pages = _pages(spark)
    first = {}
    for i, _, html, _ in rows:
        if i is not None and len(html or "") >= 100:
            first[html] = min(first.get(html, i), i)
    wanted = []
    for i, url, html, _ in rows:
        payload = (html or "").encode()
        to = first.get(html)
        to = to if to is not None and i is not None and to < i else None
        wanted.append((i, url, len(payload), sha256(payload).hexdigest(), "response" if to is None else "revisit", to))
    columns = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert fixtures.collected(warc.archive_round_trip(pages), *columns) == sorted(wanted, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_ranges_follow_from_the_bytes():
    mb = 1 << 20
    assert [warc.range_count(s) for s in (0, 1, 8 * mb, 8 * mb + 1, 255 * mb, 1 << 33, (1 << 33) + 1)] == [1, 1, 1, 2, 32, 32, 33]
    assert warc.range_count(100_000, 20_000) == 5


def test_files_are_rolled_ordered_and_the_same_on_every_run(spark):
    _, pages = _pages(spark)
    seen = []
    for shuffled in (pages, pages.repartition(5)):
        folder = tempfile.mkdtemp(prefix="warc-")
        manifest = warc.write_archive(shuffled, f"file://{folder}", roll_bytes=4000, range_bytes=20_000).collect()
        seen.append(sorted((r["path"], r["sha256"]) for r in manifest))
        assert {r["path"] for r in manifest} == {f for f in os.listdir(folder) if f.endswith(".warc.gz") and not f.startswith(".")}
        ids = []
        for path, digest in seen[-1]:
            with open(f"{folder}/{path}", "rb") as raw:
                data = raw.read()
            assert sha256(data).hexdigest() == digest
            with gzip.open(f"{folder}/{path}") as stream:
                ids += [int(head.get("X-Page-ID", -1)) for head, _ in warc.parse(stream)]
        assert ids == sorted(ids) and len(ids) == 77
    assert seen[0] == seen[1] and len(seen[0]) > 3
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archive(spark, f"file://{folder}").collect() if r["payload"] is not None}
    assert payloads[204].endswith(b"WARC/1.1\r\n") and payloads[200] == b""
