"""Previews and suggestions read the heads of files only."""

import json

import pytest

from emberlog.profile import IIS_W3C, Profile
from emberlog.sources.heads import preview_files, read_heads, suggest_file_formats


def bytes_read(spark):
    jvm = spark.sparkContext._jvm
    stats = jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(stats.get(i).getBytesRead() for i in range(stats.size()) if stats.get(i).getScheme() == "file")


def test_previews_of_every_kind(spark, tmp_path):
    n = 4
    files = {
        "a.jsonl": ("json-lines", "\n\n".join(json.dumps({"message": f"m{i}"}) for i in range(9))), "b.csv": ("csv", "message,x\n" + "".join(f"m{i},1\n" for i in range(9))),
        "c.json": ("structured-json", json.dumps([{"message": f"m{i}"} for i in range(9)])), "d.xml": ("xml", "<r>" + "".join(f"<e><message>m{i}</message></e>" for i in range(9)) + "</r>"),
        "e.json": ("structured-json", json.dumps([{"message": f"m{i}"} for i in range(4)])), "f.csv": ("csv", "message\n" + "".join(f"m{i}\n" for i in range(4))), "g.xml": ("xml", "<r><e><message>m0</message></e></r>"),
    }
    for name, (kind, text) in files.items():
        (tmp_path / name).write_text(text)
        p = Profile(format_id=kind, canonical={"message": "message"}, record_path="r.e" if kind == "xml" else "")
        records, truncated = preview_files(spark, str(tmp_path / name), p, n)
        most = text.count("m0") + text.count("m1") + text.count("m2") + text.count("m3")
        assert sorted(r["message"] for r in records.collect()) == [f"m{i}" for i in range(most)]
        assert [r["truncated"] for r in truncated.collect()] == ["m8" in text]
    (tmp_path / "w.log").write_text("#Software: x\n#Fields: date time cs-method\n" + "2026-08-08 10:00:00 GET\n" * 9)
    records, truncated = preview_files(spark, str(tmp_path / "w.log"), IIS_W3C, n)
    assert records.count() == 4 and truncated.first()["truncated"]
    with pytest.raises(ValueError):
        preview_files(spark, str(tmp_path), Profile(), 0)


def test_what_is_read_does_not_grow_with_the_file(spark, tmp_path):
    line = json.dumps({"message": "m" * 80}) + "\n"
    for name, times in (("small", 2_000), ("large", 400_000)):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.jsonl").write_text(line * times)
    got = {}
    for name in ("small", "large"):
        before = bytes_read(spark)
        records, truncated = preview_files(spark, str(tmp_path / name), Profile(), 50)
        assert records.count() == 150
        got[name] = bytes_read(spark) - before
        assert read_heads(spark, str(tmp_path / name), 5).count() == 15
    # The small files are 190 kB each, the large ones 38 MB.
    assert got["large"] <= 4 * got["small"] and got["large"] < 8 << 20


def test_suggestions_from_heads(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"a":1}\n' * 40)
    (tmp_path / "b.log").write_text("a=1 b=2\n" * 40 + "not like that")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.txt").write_text("")
    got = {r["source_name"]: r["format_id"] for r in suggest_file_formats(spark, str(tmp_path)).collect()}
    assert got == {"a.log": "json-lines", "b.log": "key-value", "c.csv": "csv", "d.txt": None}
