import hashlib
import math
import os
import struct
import zlib

import pytest

from gridloom.llm import media


def test_round_trip_and_ranges(spark, tmp_path):
    texts = ["", None, "a", "é" * 700, "x" * 576, "y" * 577, "long text " * 60_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in [*enumerate(texts[:-1]), (None, "same")]], "doc_id long, text string, media binary").repartition(2)
    folder = f"{tmp_path}/archives"
    media.write_archives(docs, folder, archive_bytes=1000).collect()
    rows = {r.doc_id: r for r in media.media_digests(media.read_archives(spark, folder, rangeBytes=150)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts[:-1]):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert rows[i].tail_crc32 == zlib.crc32(payload[-32:])
        lines = b"".join(b"\0" + payload[k : k + 576] for k in range(0, len(payload), 576))
        chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        mean = sum(payload) / len(payload)
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        step = sum(abs(x - y) for x, y in zip(payload, payload[1:], strict=False)) / (len(payload) - 1)
        bands = [sum(x // 32 == b for x in payload) / len(payload) for b in range(8)]
        assert [float(x) for x in rows[i].feature.split(",")] == pytest.approx([mean, spread, step, *bands], abs=1e-6)
    assert rows[None].media_sha256 == rows[7].media_sha256 and rows[None].feature == rows[7].feature


def test_damaged_member_is_a_row_with_its_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    folder = f"{tmp_path}/archives"
    media.write_archives(docs, folder).collect()
    (name,) = [x for x in os.listdir(folder) if x.endswith(".zip")]
    with open(f"{folder}/{name}", "r+b") as file:
        file.write(b"XX")
    rows = {r.member[0]: r for r in media.read_archives(spark, folder).collect()}
    assert rows["1"].error and rows["1"].media is None
    assert rows["2"].error is None and media.from_png(bytes(rows["2"].media)).startswith(b"b\xff")


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.media_digests(media.store_and_read(docs, f"{tmp_path}/none")).count() == 0


def test_damaged_image():
    with pytest.raises(ValueError):
        media.from_png(media.to_png(media.pad(b"abc"))[:-20] + b"0" * 20)


def test_a_read_that_fails_once_is_tried_again(tmp_path, monkeypatch):
    """Of each member and of the directory the first read fails."""
    failed, read, listing = set(), media.member_at, media.members

    def once(key, get):
        if key not in failed:
            failed.add(key)
            raise OSError("lost")
        return get()

    with media.zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k}/0-{k}.png", media.to_png(media.pad(b"x" * k)))
    monkeypatch.setattr(media, "member_at", lambda file, offset, size: once(offset, lambda: read(file, offset, size)))
    monkeypatch.setattr(media, "members", lambda file: once("directory", lambda: listing(file)))
    reader = media.ArchiveReader({"path": str(tmp_path)})
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert len(failed) == 4 and len(rows) == 3 and all(r["error"] is None and media.from_png(r["media"]) for r in rows)
