import hashlib
import io

import pytest

from timeloom.llm import warc

BIG, SMALL = "x" * 1000, "x" * 999


def archive(*records):
    return b"".join(warc.gzip_member(warc.record_bytes(*r)) for r in records)


def test_reader_round_trip_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    payloads = [b"", b"abc\r\n\r\nx", bytes(range(256)) * 50]
    data = archive(*((f"urn:p:{k}", "http://x/é\nb", p, None) for k, p in enumerate(payloads)), ("urn:p:9", "u", payloads[2], "urn:p:2"))
    got = list(warc.read_records(io.BytesIO(data), keep_payload=True))
    assert [r.payload for r in got[:3]] == payloads
    assert [(r.payload_bytes, r.payload_sha1) for r in got] == [(len(p), hashlib.sha1(p).hexdigest()) for p in [*payloads, payloads[2]]]
    assert [r.kind for r in got] == ["response"] * 3 + ["revisit"]


@pytest.mark.parametrize("harm", ["digest", "cut", "length", "tail"])
def test_damage_is_found(harm):
    raw = warc.record_bytes("urn:p:1", "u", b"payload", None)
    if harm == "digest":
        data = warc.gzip_member(raw.replace(b"payload\r\n", b"paYload\r\n"))
    elif harm == "cut":
        data = warc.gzip_member(raw)[:-20]
    elif harm == "length":
        data = warc.gzip_member(raw.replace(b"\r\n\r\n" + raw.split(b"\r\n\r\n")[-2], b"") + b"")
    else:
        data = warc.gzip_member(raw + b"x")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_round_trip(spark, tmp_path):
    rows = [(1, "a", BIG), (2, "b", BIG), (5, None, BIG), (3, "c", SMALL), (4, "d", SMALL), (6, "e", None), (7, "f", ""), (5, "g", BIG), (None, "h", BIG), (8, "i", "é" * 500), (9, "j", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as refers_to", "2 as digest")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows) and manifest.groupBy().sum("records").first()[0] == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "revisit", 5), (2, "revisit", 5), (3, "response", None), (4, "response", None), (5, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None)]
    for r in got:
        html = next(h or "" for p, _, h in rows if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, f"file://{tmp_path}/w").count() == 0
