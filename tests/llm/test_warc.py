import hashlib

import pytest
from pyspark.sql import functions as F

from tickwright.llm import warc as m


def brute(rows):
    heads = {}
    for i, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            heads.setdefault(raw, []).append(i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        known = [x for x in heads.get(raw, []) if x is not None]
        head = max(known, default=None)
        revisit = len(raw) >= 1000 and head is not None and i != head
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


ROWS = [
    (1, "http://a/ b\r\nX: y", "é" * 700), (2, None, "é" * 700), (9, "u", "é" * 700), (3, "u", None), (4, "u", ""), (5, "u", "same small"),
    (6, "u", "same small"), (7, "u", "a\r\n\r\nb" * 300), (None, "u", "é" * 700), (9, "u", "é" * 700), (8, "u", "<p>long</p>" * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id bigint, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("archive, read", [(64 << 20, 1 << 20), (200, 7)])
def test_round_trip(pages, monkeypatch, archive, read):
    monkeypatch.setattr(m, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(m, "READ_BYTES", read)
    manifest = m.archive_pages(pages)
    rows = m.read_archives(manifest)
    assert got(rows) == brute([(i, h) for i, _, h in ROWS])
    payloads = {r["id"]: bytes(r["payload"]).decode() for r in rows.where("record_type = 'response'").collect()}
    assert payloads == {i: h or "" for i, _, h in ROWS if i not in (1, 2, None)}
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)


def test_no_pages(pages):
    manifest = m.archive_pages(pages.limit(0))
    assert manifest.count() == 0 and m.read_archives(manifest).count() == 0


def test_dictionary_leads_and_frames_stand_alone(spark, small):
    import zstandard

    pages = spark.read.parquet(f"{small}/pages.parquet")
    path = m.archive_pages(pages).first()["path"]
    fs, place = m.open_shared(path)
    raw = fs.open_input_stream(place).read()
    assert int.from_bytes(raw[:4], "little") == m.SKIPPABLE
    size = int.from_bytes(raw[4:8], "little")
    held = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    frame = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
    first = frame.decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and m.parse(first)["n_bytes"] >= 0
    plain = sum(len(zstandard.compress(h[0].encode(), 3)) for h in pages.select("html").collect())
    assert len(raw) - size < plain


def test_damage_is_noticed():
    good = m.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "")
    assert m.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        m.parse(good.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf"))


def test_dictionary_counts_whole_pages(spark):
    """A banner behind 40 000 characters of every page is in the dictionary, a unique tag is not."""
    banner = "<div class='the same banner on every page of this site'>"
    rows = [(i, f"u{i}", "".join(f"<p id='{i}-{k}'>" for k in range(4000)) + banner + f"<b>{i}</b>" * 3) for i in range(40)]
    typed = m.record_type(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "page_id", "url", "html", 1000)
    found = m.dictionary_of(typed)
    assert banner.encode() in found and b"<p id='3-77'>" not in found and len(found) <= m.DICTIONARY_BYTES
    assert m.dictionary_of(typed.limit(0)).startswith(b"WARC/1.1")
