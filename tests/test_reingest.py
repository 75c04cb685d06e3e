"""A second ingest reads what has changed, and versions give what one ingest of the whole gives."""

import os

from emberlog.operators.state import prune_state
from emberlog.plans.reingest import current, latest_version, reingest, state_after, vanished
from emberlog.profile import Profile
from emberlog.sources.registry import ingest

PROFILE = Profile(format_id="key-value")


def rows(df):
    columns = sorted(c for c in df.columns if c not in ("attributes", "structured", "event_ts"))
    return sorted(str(r.asDict()) for r in df.select(columns).collect())


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def same_as_whole(spark, source, out, profile=PROFILE):
    held, whole = current(spark, out), ingest(spark, source, profile)
    for kind in ("records", "diagnostics", "stats"):
        assert rows(getattr(held, kind)) == rows(getattr(whole, kind))


def test_only_changed_files_are_read(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    put("a.log", "message=a level=INFO\nbad\n")
    put("b [1].log", "message=b level=INFO\nmessage=b2 message=b3\n")
    put("c.log", "message=c\n")
    first = reingest(spark, source, PROFILE, out)
    assert (first.version, first.read, first.kept, first.gone) == (1, 3, 0, 0)
    same_as_whole(spark, source, out)
    state = current(spark, out).records.selectExpr("session_id", "record_id", "message AS note").cache()
    assert state.count() == 4

    written = files_under(out)
    again = reingest(spark, source, PROFILE, out)
    assert (again.version, again.read, again.kept, again.gone) == (1, 0, 3, 0) and files_under(out) == written

    # One file changes, one goes, one comes; a version that a lost job left behind counts for nothing.
    put("b [1].log", "message=b level=INFO\nmessage=new\n")
    os.remove(f"{source}/c.log")
    put("d.log", "\n")
    (tmp_path / "out" / "records" / "version=2").mkdir()
    (tmp_path / "out" / "records" / "version=2" / "part-0.parquet").write_text("half")
    second = reingest(spark, source, PROFILE, out)
    assert (second.version, second.read, second.kept, second.gone) == (2, 2, 1, 1)
    same_as_whole(spark, source, out)
    read = {r[0] for r in spark.read.parquet(f"{out}/stats/version=2").select("source_name").collect()}
    assert read <= {"b [1].log", "d.log"}
    # Records that are no longer there lose their state; those that are stay, also in a file read again.
    assert vanished(spark, out, 2).count() == 2
    assert rows(state_after(state, spark, out, 2)) == rows(prune_state(state, current(spark, out).records))
    assert rows(current(spark, out, 1).records) != rows(current(spark, out).records)

    # Another profile reads all anew, another session leaves this one as it is.
    other = Profile(format_id="key-value", severity_aliases={"INFO": "ERROR"})
    assert reingest(spark, source, other, out).read == 3
    same_as_whole(spark, source, out, other)
    reingest(spark, f"{source}/a.log", PROFILE, out, "other")
    held = current(spark, out).records
    assert held.where("session_id = 'other'").count() == 1 and held.where("session_id = 'default'").count() == 3


def test_nothing_stored_and_all_gone(spark, tmp_path):
    out = str(tmp_path / "out")
    assert latest_version(spark, out) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("message=a\n")
    reingest(spark, str(tmp_path / "in"), PROFILE, out)
    os.remove(tmp_path / "in" / "a.log")
    assert reingest(spark, str(tmp_path / "in"), PROFILE, out).gone == 1
    assert current(spark, out).records.count() == 0 and vanished(spark, out, 2).count() == 1
