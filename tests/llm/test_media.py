import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontomill.llm import media as A
from ontomill.llm import registry
from tests.llm.awkward import ROWS, awkward, empty


def test_tables():
    mu, a = A.mulaw_table(), A.alaw_table()
    # well-known values of the two laws
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256


def scalar_adpcm(block):
    value = int.from_bytes(bytes(block[:2]), "little", signed=True)
    index = min(max(int(block[2]), 0), 88)
    out = [value]
    for byte in block[4:]:
        for code in (int(byte) & 15, int(byte) >> 4):
            step = int(A.STEPS[index])
            d = step >> 3
            if code & 4:
                d += step
            if code & 2:
                d += step >> 1
            if code & 1:
                d += step >> 2
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            index = max(0, min(88, index + int(A.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm():
    rng = random.Random(2)
    blocks = np.array([[rng.randrange(256) for _ in range(A.UNIT)] for _ in range(9)], np.uint8)
    assert A.adpcm_decode(blocks).tolist() == [scalar_adpcm(b) for b in blocks]
    pcm = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    back = A.adpcm_decode(A.adpcm_encode(pcm)).ravel()[: len(pcm)]
    assert np.abs(back.astype(int) - pcm).mean() < 300
    assert len(A.adpcm_encode(pcm[:0])) == 0


def test_wave_round_trip():
    for tag in (A.PCM, A.ALAW, A.MULAW, A.IMA_ADPCM):
        payload = bytes(range(192)) * 3
        assert A.read_wave(A.wave_bytes(tag, payload)) == (tag, A.RATE, payload)
        assert len(A.pcm_of(A.wave_bytes(tag, payload), 16000)) > len(payload) // 2
    with pytest.raises(ValueError):
        A.read_wave(b"nothing")
    assert A.resample(np.array([0, 10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 10]


def test_digests(spark):
    out = {(r.id, r.payload_sha256): r for r in A.media_digests(awkward(spark)).collect()}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        r = out[(i, hashlib.sha256(payload).hexdigest())]
        stored = A.wave_bytes(A.MULAW, payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(data), len(payload), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        mu = A.mulaw_table()[np.frombuffer(payload, np.uint8)].astype(float)
        assert f"mulaw_rms={np.sqrt((mu**2).mean()):.3f};" in r.feature
        adpcm = np.array([scalar_adpcm(b) for b in np.frombuffer(payload[:1920], np.uint8).reshape(-1, 192)])
        if len(payload) <= 1920:
            assert f"adpcm_crossings={((adpcm[:, 1:] < 0) != (adpcm[:, :-1] < 0)).sum()};" in r.feature
    assert len({r.feature for r in out.values() if r.n_bytes == 0}) == 1
    # the same in any company: a feature doesn't depend on the batch
    assert {(r.id, r.feature) for r in A.media_digests(awkward(spark), batch_bytes=1).collect()} == {(r.id, r.feature) for r in out.values()}
    assert A.media_digests(empty(spark)).count() == 0
    assert A.store_texts(awkward(spark)).where("length(pcm16k) = 0").count() == 0


def test_query_stores_and_reads_back(spark):
    """The registered query: what stands in the files is the padded text, and features are those of what was read."""
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in registry.op10_media(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(out) == {r.doc_id for r in docs}
    for r in docs:
        data = (r.text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        o = out[r.doc_id]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if len(payload) < 4000:
            a = [A.alaw_table()[b] for b in payload]
            assert f"alaw_rms={np.sqrt(np.mean(np.square(np.array(a, float)))):.3f};" in o.feature
            mu = [int(A.mulaw_table()[b]) for b in payload]
            wide = [x for i, v in enumerate(mu) for x in (v, round_half((v + mu[i + 1]) / 2) if i + 1 < len(mu) else v)]
            assert o.feature.endswith(f"pcm16k_crc32={zlib.crc32(np.array(wide, '<i2').tobytes())}")


def round_half(x):
    return int(np.rint(x))


def test_lift_gives_back_any_samples():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 192, 1001):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        assert len(A.lift(pcm)) == 2 * n and A.unlift(A.lift(pcm)).tolist() == pcm.tolist()
    mu = A.mulaw_table()[rng.integers(0, 256, 192)]
    assert not any(A.lift(A.resample(mu, 8000, 16000))[2 * 192 :])


def test_resampled_pcm_is_stored_and_read_back(spark, tmp_path, monkeypatch):
    """The PCM at twice the rate stands beside each file on disk, and its checksum is that of the stored one."""
    out = A.media_digests(awkward(spark), folder=str(tmp_path))
    (at,) = tmp_path.iterdir()
    stored = spark.read.parquet(str(at)).collect()
    assert len(stored) == len(ROWS)
    crcs = set()
    for r in stored:
        wide = A.unlift(r.pcm16k)
        assert wide.tolist() == A.pcm_of(r.media, 16000).tolist()
        crcs.add((r.id, zlib.crc32(wide.astype("<i2").tobytes())))
    assert {(r.id, int(r.feature.rsplit("pcm16k_crc32=")[1])) for r in out.collect()} == crcs
    # other PCM on disk, another checksum: it isn't made again from the file
    store = A.store_texts
    monkeypatch.setattr(A, "store_texts", lambda *a, **b: store(*a, **b).withColumn("pcm16k", F.expr("pcm16k || X'0100'")))
    assert not {(r.id, r.feature) for r in A.media_digests(awkward(spark)).collect()} & {(r.id, r.feature) for r in out.collect()}
