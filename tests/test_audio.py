"""Audio files: walks, chunks and tags, whole and broken."""

import io

import pytest

from quaverlake.operators import tags
from quaverlake.sources import audio


def chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def wave(*chunks: bytes) -> bytes:
    return chunk(b"RIFF", b"WAVE" + b"".join(chunks))


def id3(frames: bytes, version: int = 4, flags: int = 0) -> bytes:
    size = bytes(len(frames) >> 7 * k & 127 for k in (3, 2, 1, 0))
    return b"ID3" + bytes([version, 0, flags]) + size + frames


def frame(name: bytes, body: bytes, flags: bytes = b"\0\0") -> bytes:
    return name + len(body).to_bytes(4, "big") + flags + body


def info(*pairs: tuple[bytes, bytes]) -> bytes:
    return chunk(b"LIST", b"INFO" + b"".join(chunk(*p) for p in pairs))


def read(content: bytes) -> audio.Found:
    return audio.read_tags(io.BytesIO(content))


def test_lists_of_wave_files():
    found = read(wave(chunk(b"junk", b"odd"), info((b"IART", b"a\0rest"), (b"INAM", "é’".encode("cp1252")), (b"IGNR", b" \0")), chunk(b"LIST", b"adtl")))
    assert found.info == [("IART", "a"), ("INAM", "é’")]
    too_long = chunk(b"LIST", b"INFO" + b"\0" * audio.MOST_LIST)
    assert read(wave(too_long, info((b"IART", b"a")))).info == [("IART", "a")]


def test_encodings_and_flags_of_frames():
    assert read(id3(frame(b"TPE1", b"\1" + "a\0b".encode("utf-16")), 3)).tags == [("TPE1", "a"), ("TPE1", "b")]
    assert read(id3(frame(b"TPE1", b"\2" + "ü".encode("utf-16-be")), 3)).tags == [("TPE1", "ü")]
    assert read(id3(frame(b"TPE1", b"\0\xfc"), 3)).tags == [("TPE1", "ü")]
    assert read(id3(frame(b"TIT2", b"\3x", b"\0\x80") + frame(b"TPE1", b"\3y"), 3)).tags == [("TPE1", "y")]
    assert read(id3(frame(b"TPE1", b"\0\xff\x00\xfe"), 3, 0x80)).tags == []  # its size counts bytes that the escapes took away
    escaped = b"TPE1" + (3).to_bytes(4, "big") + b"\0\0" + b"\0\xff\x00\xfe"
    assert read(id3(escaped, 3, 0x80)).tags == [("TPE1", "ÿþ")]
    assert read(id3(b"\0\0\0\6\0\0\0\0\0\0" + frame(b"TPE1", b"\3y"), 3, 0x40)).tags == [("TPE1", "y")]
    assert read(id3(frame(b"TXXX", b"\3STYLE\0x\0y") + frame(b"UFID", b"o\0id\0"))).tags == [("TXXX:STYLE", "x"), ("TXXX:STYLE", "y"), ("UFID:o", "id")]


@pytest.mark.parametrize("whole", [
    wave(chunk(b"fmt ", b"\0" * 8 + (2).to_bytes(4, "little") + b"\0" * 4), info((b"IART", b"a")), chunk(b"id3 ", id3(frame(b"TPE1", b"\3y"))), chunk(b"data", b"12345678")),
    id3(frame(b"TPE1", b"\3y") + frame(b"TXXX", b"\3a\0b"), 4, 0x40),
    b"fLaC\0\0\0\x22" + b"\0" * 34 + b"\x84\0\0\x12" + b"\0\0\0\0\1\0\0\0" + b"\6\0\0\0" + b"TITLE=x",
])
def test_files_cut_anywhere_and_with_any_byte_changed(whole):
    for k in range(len(whole)):
        read(whole[:k])
        for b in (0, 127, 255):
            read(whole[:k] + bytes([b]) + whole[k + 1 :])


def test_folder_with_broken_nested_and_empty_files(spark, tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    put("x.mp3", id3(frame(b"TALB", b"\3L") + frame(b"TPE1", b"\3") + frame(b"TPE2", b"\3B")))
    put("deep/er/y.wav", wave(info((b"IART", b"a"), (b"IYER", b"1999x")), chunk(b"LIST", b"INFO")) + b"LIST\xff\xff\0\0INFOINAM")
    put("deep/z.WAV", wave(chunk(b"data", b"")) + b"more\xff\xff\xff\x7f")
    put("deep/empty.flac", b"")
    put("deep/.mp3", b"hidden")
    put("skip/q.mp3", b"")
    put("skipped/q.mp3", b"")
    audio.register(spark)
    for depth in ("0", "1", "3"):
        files = spark.read.format("audio_files").options(exclude="skip", depth=depth, shares="2").load(str(tmp_path))
        rows = {r.name: (r.artist, r.album, r.title, r.year, r.seconds) for r in tags.track_fields(files).collect()}
        assert rows == {
            "x.mp3": ("B", "L", "x", None, None), "deep/er/y.wav": ("a", None, "y", 1999, None), "deep/z.WAV": (None, None, "z", None, None),
            "deep/empty.flac": (None, None, "empty", None, None), "skipped/q.mp3": (None, None, "q", None, None),
        }
        assert tags.catalog_fields(files).count() == 0


def test_writing_again_leaves_one_file(spark, tmp_path):
    audio.register(spark)
    rows = spark.createDataFrame([("a/b.mp3", b"1"), ("c.txt", b"22")], "name string, content binary")
    for _ in range(2):
        rows.write.format("audio_files").mode("append").save(str(tmp_path))
    assert sorted((p.relative_to(tmp_path).as_posix(), p.read_bytes()) for p in tmp_path.rglob("*") if p.is_file()) == [("a/b.mp3", b"1"), ("c.txt", b"22")]
    empty = tmp_path / "none"
    rows.limit(0).write.format("audio_files").mode("append").save(str(empty))
    assert not empty.exists() or spark.read.format("audio_files").load(str(empty)).count() == 0


def test_tasks_hold_few_files(spark, monkeypatch):
    """Tasks of writing and of reading grow in number with the files, not in length."""
    from pyspark.sql import functions as F

    from quaverlake.plans import audio as plans

    monkeypatch.setattr(plans, "FILES", 50)
    number = F.col("id")
    name = F.concat(plans._numbered(F.lit("d"), number), number.cast("string"), F.lit(".mp3"))
    files = spark.range(0, 3000, 1, 1).select(name.alias("name"), F.lit(b"").alias("content"))
    found = plans._stored(files, depth="2")
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 3000
    assert max(t["count"] for t in tasks) <= 50
