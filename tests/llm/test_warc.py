import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

from antecede.llm import warc

PAGES = "page_id long, url string, html string, record string"


def _sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_records_come_back_with_types_and_digests(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abé<>\r\n") for _ in range(300_000))
    pages = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (2, "u", None), (4, "v", ""), (6, "w", long),
             (7, "http://x\r\nWARC-Type: none", "\r\n\r\nWARC/1.1\r\n"), (5, "http://b", "same"), (None, "n", "other")]
    got = warc.archived(spark.createDataFrame([(*p, "clash") for p in pages], PAGES)).collect()
    assert len(got) == len(pages)
    by = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    kinds = {1: ("revisit", 5), 3: ("revisit", 5), 2: ("revisit", 4), 4: ("response", None), 6: ("response", None), 7: ("response", None),
             None: ("response", None)}
    expected = [(str(i), len((h or "").encode()), _sha(h), *kinds[i]) for i, _, h in pages if i != 5]
    expected += [("5", 4, _sha("same"), "response", None), ("5", 4, _sha("same"), "revisit", 5)]
    assert [tuple(map(str, x)) for x in by] == sorted(tuple(map(str, x)) for x in expected)


def test_chunks_carry_the_digest_so_far(spark):
    text = "x" * 1000
    rows = warc.chunked(spark.createDataFrame([(1, "u", text, "")], PAGES), size=300).orderBy("chunk").collect()
    assert [len(r.data) for r in rows] == [300, 300, 300, 100] and [r.last for r in rows] == [False] * 3 + [True]
    assert [r.sha1 for r in rows] == [_sha(text[:n]) for n in (300, 600, 900, 1000)]


def test_archives_are_plain_warc_files(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}", "") for i in range(20)], PAGES)
    folder = warc.shared_folder(spark, "warc-test")
    manifest = warc.written(warc.stored(warc.chunked(pages), "chunks"), folder).collect()
    data = b"".join(gzip.decompress(Path(m.path.removeprefix("file:")).read_bytes()) for m in manifest)
    assert sum(m.records for m in manifest) == 20 == data.count(b"WARC/1.1\r\n")
    assert set(re.findall(rb"Content-Length: \d+\r\n\r\n(page \d+)\r\n\r\n", data)) == {f"page {i}".encode() for i in range(20)}
    assert warc.archived(pages.limit(0)).collect() == []
