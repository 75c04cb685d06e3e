"""JSON documents cut by structure, in splits of any size, as whole documents give them."""

import json
import random

import pytest

from emberlog.profile import Profile
from emberlog.session import prepared
from emberlog.sources import json_structure as js
from emberlog.sources.json_sources import ingest_json_documents
from emberlog.sources.registry import ingest

SCHEMA = "session_id string, source_path string, source_name string, document string"


def invented(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 5)
    if kind < 5:
        return r.choice([1, -2.5, True, None, "x", 'q"{[,]}\\', "é\\u0041", "", "a: {", "data"])
    if kind == 5:
        return [invented(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["data", "r", "m", "k{", 'k"', "z"]): invented(r, depth + 1) for _ in range(r.randint(0, 3))}


def test_effects_compose_wherever_a_document_is_split():
    for seed in range(80):
        r = random.Random(seed)
        text = json.dumps({"a": invented(r), "data": {"r": [invented(r) for _ in range(5)]}, "b": invented(r)}, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        pieces = [(i == 0, p) for i, p in enumerate(text.split("{"))]
        scan, states = js.Scan(frames=json.loads(json.dumps(js.BEGIN[2]))), []
        for first, p in pieces:
            states.append(json.loads(json.dumps([scan.inside, scan.partial, scan.frames, ""])))
            list(scan.feed(p if first else "{" + p))
        cuts = sorted(r.sample(range(1, len(pieces)), min(len(pieces) - 1, r.randint(0, 4))))
        state = json.loads(json.dumps(js.BEGIN))
        for lo, hi in zip([0, *cuts], [*cuts, len(pieces)]):
            assert state == states[lo], (seed, lo)
            state = js.after(state, json.loads(json.dumps(js.effects(iter(pieces[lo:hi])))))
        assert state == [False, "", [["^", None, "done"]], ""]


CASES = {
    "list": '[{"message":"a","x":{"y":1}}, 3, {"message":"b{[,\\"]}"} , [1,{"q":2}], "s"]', "empty": "[ ]", "object": '{"message":"c"}', "bad": "[{]", "scalar": "4", "early": '[{"a":1},{"b":2}', "cut": '{"a":[1,2]', "missing": "[1,]", "hole": "[1,,2]", "blank": " \n",
}
NESTED = {"ok": ' {"x":{"r":[9]},"d":{"q":[1],"r":[{"message":"a"},{"d":{"r":[5]}}],"z":1}}', "root": "[1]", "none": '{"d":{}}', "value": '{"d":{"r":5}}', "object": '{"d":{"r":{"message":"z"}}}', "deeper": '{"d":{"x":{"r":[1]}}}'}


def told(result):
    return sorted((r["source_name"], r["record_number"], r["message"], r["raw_source"], json.dumps(r["attributes"], sort_keys=True)) for r in result.records.collect()), sorted((r["source_name"], r["record_number"] or 0, r["code"]) for r in result.diagnostics.collect())


@pytest.mark.parametrize("size", ["400", None])
def test_files_give_what_whole_documents_give(spark, tmp_path, size):
    prepared(spark)
    for cases, path in ((CASES, ""), (NESTED, "d.r")):
        texts = dict(cases)
        for seed in range(2):
            r = random.Random(seed)
            some = [{"message": f"m{i}", "v": invented(r)} for i in range(15)]
            texts[f"random{seed}"] = json.dumps({"a": invented(r), "d": {"k": invented(r), "r": some}} if path else some, indent=r.choice([None, 1]), ensure_ascii=False)
        if not path:  # Spark's own parser overlooks what follows the root
            for name, text in (("tail", '[{"a":1}]}'), ("two", '[{"a":1}][2]')):
                texts[name] = text
        folder = tmp_path / (path or "root")
        folder.mkdir()
        for name, text in texts.items():
            (folder / f"{name}.json").write_text(text)
        p = Profile(format_id="structured-json", record_path=path, canonical={"message": "message"})
        want = told(ingest_json_documents(spark.createDataFrame([("default", f"/{n}.json", f"{n}.json", t) for n, t in texts.items() if n not in ("tail", "two")], SCHEMA), p))
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = told(ingest(spark, str(folder), p))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got[0] == want[0]
        more = [] if path else [(f"{n}.json", 0, "MALFORMED_JSON_DOCUMENT") for n in ("tail", "two")]
        assert got[1] == sorted(want[1] + more)


def test_brackets_alone_are_told_below_an_element():
    text = '{"a": [{"k": 1, "x": ["}", {"y": 2, "z": "\\""}], "b": "[,"}, 3, "open'
    scan = js.Scan()
    told = [c for c, _ in scan.feed(text, 3)]
    assert told == ["{", ":", "[", "{", "[", "{", "}", "]", "}", ",", ","] and scan.inside and scan.partial == "open"
    every = js.Scan()
    assert len([c for c, _ in every.feed(text)]) == 20 and [f[0] for f in every.frames] == [f[0] for f in scan.frames]
