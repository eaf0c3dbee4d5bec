import hashlib
import os
import zlib

import numpy as np
import pytest

from regolith.llm import media_avi as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 5000, 300_000])
def test_payloads_come_back(n):
    for data in (os.urandom(n), b"\xff" * n, b"\0" * n):
        payload = m.pad(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
        assert m.read_avi(m.write_avi(payload))["payload"] == payload


def test_general_decoder_agrees():
    frames = m.parse_avi(m.write_avi(m.pad(os.urandom(2500))))[0]
    fast = m.decode_frames(frames)
    foreign = [f[:2] + b"\xff\xfe\x00\x02" + f[2:] for f in frames]  # a comment keeps them from the fixed way
    head = m._head_of(foreign[0])
    slow = [m._slow_blocks(f[head[-1] : f.rindex(b"\xff\xd9")], [(1, *head[5][1])], head[3], head[4], m.BLOCKS) for f in foreign]
    assert (fast[0] == np.array(slow)).all()
    assert (m.decode_frames(foreign)[1] == fast[1]).all()


def test_samples_are_the_inverse_transform():
    block = np.zeros(64)
    block[0] = 80
    assert np.allclose(block @ m.IDCT, 10)
    k = np.arange(64)
    assert np.allclose(m.IDCT @ m.IDCT.T, np.eye(64), atol=1e-5) and sorted(m.ZIGZAG) == list(k)


def test_shots():
    a, b = np.eye(16, dtype=int)[[0]] * 9, np.eye(16, dtype=int)[[5]] * 9
    assert m.shots(np.concatenate([a, a, a, b, b])) == [(0, 2), (3, 4)]
    assert m.shots(np.zeros((0, 16), int)) == []


def test_queries_columns(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (4, "abc"), (5, "é" * 2000), (None, "abc")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, media binary")
    got = {(r.doc_id): r for r in m.features(m.to_media(df)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3][1:] == got[4][1:] == got[None][1:]
    assert m.features(m.to_media(df.limit(0))).collect() == []


def test_clips(spark):
    good = m.write_avi(m.pad(b"\0" * 4096 + np.random.default_rng(0).integers(0, 256, 4096, dtype=np.uint8).tobytes()))
    df = spark.createDataFrame([(1, good), (2, None), (3, b"RIFF"), (4, good[:500])], "doc_id long, media binary")
    got = [(r.doc_id, r.first_frame, r.last_frame, round(r.start_s, 3), round(r.end_s, 3)) for r in m.clips(df).orderBy("doc_id", "clip").collect()]
    assert got == [(1, 0, 3, 0.0, 0.4), (1, 4, 7, 0.4, 0.8)]
