"""Sources, sinks and streams on small files."""

from quaverlake.sources import imports, playlists
from quaverlake.streaming import usage


def test_playlist_files(spark, tmp_path):
    (tmp_path / "a.m3u8").write_bytes("﻿#EXTM3U\r\n\r\n  one.mp3 \r\nHTTP://x/y\r\n#EXTINF:1,x\r\ntwo.mp3".encode())
    (tmp_path / "b.m3u").write_bytes("café ’.mp3\n".encode("cp1252"))
    (tmp_path / "c.m3u").write_bytes(b"\x81\x92\xe9.mp3\n")
    (tmp_path / "d.txt").write_text("none")
    rows = {(r.playlist[-6:].lstrip("/"), r.position, r.kind, r.entry) for r in playlists.read_playlists(spark, str(tmp_path)).collect()}
    assert rows == {
        ("a.m3u8", None, "comment", "#EXTM3U"), ("a.m3u8", 1, "entry", "one.mp3"), ("a.m3u8", None, "url", "HTTP://x/y"),
        ("a.m3u8", None, "comment", "#EXTINF:1,x"), ("a.m3u8", 2, "entry", "two.mp3"),
        ("b.m3u", 1, "entry", "café ’.mp3"), ("c.m3u", 1, "entry", "\x81\x92\xe9.mp3"),
    }


def test_playlists_written_and_read(spark, tmp_path):
    rows = [("p", 2, "d/b.mp3", None, "", None), ("p", 1, "d/a.mp3", "A\nB", "T", 7), ("q", 1, "c", "C", "U", 0)]
    df = spark.createDataFrame(rows, "playlist string, position int, path string, artist string, title string, seconds int")
    playlists.write_m3u8(df, str(tmp_path / "out"))
    written = {f.parent.name: f.read_text() for f in (tmp_path / "out").glob("*/*.txt")}
    assert written == {
        "playlist=p": "#EXTM3U\n#EXTINF:7,A B - T\nd/a.mp3\n#EXTINF:-1,? - b.mp3\nd/b.mp3\n",
        "playlist=q": "#EXTM3U\n#EXTINF:-1,C - U\nc\n",
    }
    assert playlists.m3u8_lines(df.limit(0)).count() == 0


def test_imports(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    families = imports.read_families(spark, put("f.csv", "value,family\n rock ,A\nrock,B\n,C\npop,\n"))
    assert families.collect() == [("rock", "B")]
    ids = imports.read_catalog_ids(spark, put("i.csv", 'path,recording_mbid,original_year,style\n"a, ""b""",,19x,s\nc,m,1970,\n,z,1,\n'))
    assert sorted(map(tuple, ids.collect())) == [('a, "b"', None, None, None, "s"), ("c", "m", None, 1970, None)]
    similar = imports.read_artist_similarity(spark, put("s.csv", "artist_mbid,similar_mbid,source,score\na,b,x,0.5\na,,x,1\n"))
    assert similar.collect() == [("a", "b", "x", 0.5)]
    catalog = imports.read_catalog_json(spark, put("l.json", '[{"file":"a","name":"T","year":1999},{"file":"a","name":"U"},{"name":"V"}]'))
    assert [(r.path, r.title, r.year) for r in catalog.collect()] == [("a", "U", None)]
    records = imports.read_records(spark, put("r.txt", "file a b\nyear 1999\nname x\nname y\n\n\n\nfile c\nyear 19x\nname\n"), ["file", "year", "name", "album"])
    assert sorted(map(tuple, records.collect())) == [("a b", 1999, "y", None), ("c", None, "", None)]


def test_counters_are_not_counted_twice(spark, tmp_path):
    ledger, folder = str(tmp_path / "ledger"), str(tmp_path / "counters")
    events = "kind string, at long, path string"
    usage.append_ledger(spark.createDataFrame([("played", 5, "a"), ("skipped", 6, "a"), ("shown", 9, "a"), ("played", 3, None)], events), ledger)
    for k in range(2):
        usage.start_counters(usage.ledger_stream(spark, ledger), folder, str(tmp_path / "progress")).awaitTermination()
        assert usage.counters(spark, folder).collect() == [("a", 1, 1, 5)], k
    usage.append_ledger(spark.createDataFrame([("played", 4, "a"), ("skipped", 1, "b")], events), ledger)
    usage.start_counters(usage.ledger_stream(spark, ledger), folder, str(tmp_path / "progress")).awaitTermination()
    assert sorted(map(tuple, usage.counters(spark, folder).collect())) == [("a", 2, 1, 5), ("b", 0, 1, None)]
    usage.compact(spark, folder, str(tmp_path / "compacted"))
    assert sorted(map(tuple, usage.counters(spark, str(tmp_path / "compacted")).collect())) == [("a", 2, 1, 5), ("b", 0, 1, None)]
