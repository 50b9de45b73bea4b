from __future__ import annotations

import hashlib
import io
import wave
import zipfile
import zlib
from collections import Counter

import pytest

from millrace.llm import media_archive as q


def test_stored_and_read_back(spark, odd, odd_rows):
    got = q.media_columns(odd).collect()
    expected = Counter()
    for i, text, *_ in odd_rows:
        payload, n = q.padded(text)
        wav = q.to_wav(payload)
        assert len(payload) % 192 == 0 and payload[:n] == (text or "").encode() and not payload[n:].strip(b" ")
        expected[(i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), q.sound_features(payload))] += 1
    assert Counter(map(tuple, got)) == expected
    assert q.media_columns(odd.limit(0)).count() == 0


def test_ranges_and_retries(spark, odd, tmp_path):
    folder = str(tmp_path / "archives")
    listed = q.write_archives(odd, folder, id_col="doc_id", text_col="text").collect()
    spark.dataSource.register(q.ArchiveSource)
    read = lambda **o: spark.read.format("millrace_archive").options(path=folder, **o).load()
    small = read(range_bytes=300)
    assert small.rdd.getNumPartitions() > 20
    assert small.count() == sum(r.members for r in listed) == odd.count()
    # One damaged member fails by itself, after its retries.
    path = listed[0].path
    with open(path, "r+b") as file:
        data = file.read()
        at = data.index(b".wav") + 40
        file.seek(at)
        file.write(bytes(x ^ 255 for x in data[at : at + 8]))
    rows = read(on_error="row").collect()
    assert sum(r.error is not None for r in rows) == 1 and len(rows) == odd.count()
    with pytest.raises(Exception, match="member"):
        read().count()


def test_wav_is_checked():
    with pytest.raises(ValueError):
        q.from_wav(q.to_wav(b"ab") + b"x")


def test_archives_by_other_readers(spark, odd, odd_rows, tmp_path):
    """What is stored, read with zipfile and wave alone, against texts padded here."""
    folder = str(tmp_path / "archives")
    listed = q.write_archives(odd, folder, id_col="doc_id", text_col="text").collect()
    stored = Counter()
    for r in listed:
        with zipfile.ZipFile(r.path) as archive:
            assert archive.testzip() is None and len(archive.namelist()) == r.members
            for m in archive.infolist():
                with wave.open(io.BytesIO(archive.read(m))) as sound:
                    assert (sound.getnchannels(), sound.getsampwidth()) == (1, 1)
                    stored[(m.filename.split(".")[0], sound.readframes(sound.getnframes()))] += 1
    expected = Counter()
    for i, text, *_ in odd_rows:
        data = (text or "").encode()
        while not data or len(data) % 192:
            data += b" "
        expected[("null" if i is None else str(i), data)] += 1
    assert stored == expected


def test_features_by_plain_loops():
    for data in (b" " * 192, bytes(range(192)), "é中 text".encode().ljust(192), bytes([0, 255] * 96)):
        x, n = [b - 128 for b in data], len(data)
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        levels = [sum(b // 32 == k for b in data) * 1000 // n for k in range(8)]
        wanted = f"peak={max(map(abs, x))} mean={sum(x) * 1000 // n} energy={sum(v * v for v in x) * 1000 // n} crossings={crossings * 1000 // n} levels={'/'.join(map(str, levels))}"
        assert q.sound_features(data) == wanted
