import hashlib
import zlib

import numpy as np
import pytest

from tickwright.llm import telephony as m


def test_companding_tables():
    assert m.EXPAND[m.MULAW][[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert m.EXPAND[m.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    for table in m.EXPAND.values():
        assert sorted(table[:128].tolist()) == sorted((-table[128:]).tolist())


def slow_adpcm(data, block):
    out = []
    data += bytes(-len(data) % block)
    for k in range(0, len(data), block):
        b = data[k : k + block]
        now, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(now)
        for code in (c for x in b[4:] for c in (x & 15, x >> 4)):
            step = m.STEPS[index]
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
            index = max(0, min(88, index + m.INDEX_CHANGE[code & 7]))
            out.append(now)
    return out


@pytest.mark.parametrize("slab", [1, 3, 1 << 14])
def test_adpcm_against_sample_by_sample(monkeypatch, slab):
    monkeypatch.setattr(m, "SLAB_BLOCKS", slab)
    data = np.random.default_rng(2).integers(0, 256, 192 * 7 + 50, dtype=np.uint8).tobytes()
    assert m.decode_adpcm(data, 192).tolist() == slow_adpcm(data, 192)


def test_resampling():
    x = np.array([0, 10, -10, 3], "<i2")
    assert m.resample(x, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -4, 3, 3]
    assert m.resample(x, 8000, 8000).tolist() == x.tolist()
    assert m.resample(x, 8000, 12000).tolist() == [0, 6, 3, -10, -2, 3]
    assert m.resample(x, 16000, 8000).tolist() == [0, -10]
    assert len(m.resample(x[:0], 8000, 16000)) == 0


@pytest.mark.parametrize("tag", [m.MULAW, m.ALAW, m.ADPCM])
def test_files_round_trip(tag):
    for n in (0, 1, 191, 192, 1000):
        data = bytes(range(256)) * 4
        assert m.read_wav(m.wav(data[:n], tag))[3] == data[:n]
    with pytest.raises(ValueError):
        m.read_wav(b"RIFFxxxxWAVEdata")


def test_table_round_trip(odd_docs, no_docs):
    media = m.encode_media(odd_docs)
    found = sorted(((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in m.decode_media(media).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        raw = (r["text"] or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want.append((r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert found == sorted(want, key=repr)
    same = {(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in m.decode_media(media).where("id = 2").collect()}
    assert len(same) == 1
    assert m.decode_media(m.encode_media(no_docs)).count() == 0


def test_packing_loses_nothing():
    rng = np.random.default_rng(0)
    cases = [rng.integers(-32768, 32768, n) for n in (0, 1, 2, 7, 600)] + [rng.choice([-32768, 0, 5, 32767], 900), np.zeros(512), np.arange(256).repeat(9), np.arange(257).repeat(9)]
    for x in cases:
        x = x.astype("<i2")
        for pcm in (x, m.resample(x, 8000, 16000)):
            assert m.unpack_pcm(m.pack_pcm(pcm)).tolist() == pcm.tolist()
    doubled = m.resample(rng.choice([-5, 9, 300], 4000).astype("<i2"), 8000, 16000)
    assert len(m.pack_pcm(doubled)) < 4100
    doubled[7] += 1
    assert m.unpack_pcm(m.pack_pcm(doubled)).tolist() == doubled.tolist()


def test_pcm_is_kept_on_request(odd_docs):
    rows = m.read_pcm(m.decode_media(m.encode_media(odd_docs))).collect()
    for r in rows:
        n = int(r["feature"].split("n=")[1].split()[0])
        assert len(r["pcm"]) == 4 * n and f"{zlib.crc32(r['pcm']):08x}" == r["feature"][-8:]


def test_query_stores_pcm(spark, small):
    from pathlib import Path

    from tickwright.llm.queries import QUERIES
    from tickwright.session import run_folder

    before = set(Path(run_folder(spark).removeprefix("file://")).glob("pcm-*"))
    out = {r["doc_id"]: r["feature"] for r in QUERIES["op7_telephony"](spark, small).collect()}
    new = set(Path(run_folder(spark).removeprefix("file://")).glob("pcm-*")) - before
    assert len(new) == 1
    rows = m.read_pcm(spark.read.parquet(str(new.pop()))).collect()
    assert {r["id"] for r in rows} == set(out)
    assert all(out[r["id"]].endswith(f"pcm={zlib.crc32(r['pcm']):08x}") for r in rows)
