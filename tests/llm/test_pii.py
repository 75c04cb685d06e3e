import hashlib
import re

import pytest

from emberlog.llm import pii

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def good(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if good(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "no data", "é a@b.com@c.org, x.y%z@d.e.f. q@q", "a@b.c%d@e.f", "1.2.3.4.5 0001.002.3.255 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4 1 1 1", "+1 (555) 010-9999 +12 3 +123456789012345678", "5" * 3000, "a" * 3000 + "@", "x" * 5000 + " me@site.org",
    "GB82 WEST 1234 5698 7654 32 iban DE89370400440532013000 DE89370400440532013001", "my ssn 123-45-6789 or 987-65-4321" + " " * 60 + "111-22-3333", "😀 +44 20 7946 0958 😀 b@c.de", "1.1.1.1@a.bc +1.234.567.8901",
    "a@b.com " * 50,
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string")
    return {r["doc_id"]: r for r in pii.find_pii(df).collect()}


def test_base_spans_equal_those_of_plain_patterns(found):
    for i, t in enumerate(TEXTS):
        own = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found[i]["pii"] if s["kind_no"] < 4)
        assert own == base_spans(t), t
        assert all((t or "")[s["start"] : s["end"]] == s["found"] for s in found[i]["pii"])


def test_added_kinds_need_checksums_or_context(found):
    kinds = lambda i: [(s["kind"], s["found"]) for s in found[i]["pii"] if s["kind_no"] > 3]
    assert kinds(11) == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert kinds(12) == [("ssn", "123-45-6789"), ("ssn", "987-65-4321")]
    scores = [s["score"] for s in found[7]["pii"]]
    assert all(0 < s <= 1 for s in scores)


def test_masking_replaces_each_span(spark, found):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(df).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "no data"
    assert got[3] == "é [EMAIL]@c.org, [EMAIL]. q@q"
    assert got[13] == "😀 [PHONE] 😀 [EMAIL]"
    assert got[14].startswith("[") and "@" not in got[14]
    assert got[15] == "[EMAIL] " * 50


def test_query_counts_by_kind(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.cd"), (3, "dup")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op5_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] and r["doc_id"] is not None else None
        if t:
            want = base_spans(t)
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert r["n_email"] == want.count("email:") and r["n_ip"] == want.count("ip:") and r["n_card"] == want.count("card:") and r["n_phone"] == want.count("phone:")


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_with_very_many_spans(spark):
    """Positions, context and masks over many blocks of matches equal those made one by one."""
    import re

    parts, want, masked, at = [], [], [], 0
    for i in range(30_000):
        word = ("mail ", "x ", "é call ")[i % 3]
        found, kind = ((f"a{i}@x.org", "email"), (f"10.0.{i % 256}.7", "ip"), (f"+49 30 {1000000 + i}", "phone"))[i % 3]
        parts.append(f"{word}{found}; ")
        begin = at + len(word)
        want.append((kind, begin, begin + len(found)))
        masked.append(f"{word}[{kind.upper()}]; ")
        at += len(parts[-1])
    text = "".join(parts)
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.mask_pii(pii.find_pii(df)).collect()}
    base = [(x["kind"], x["start"], x["end"]) for x in rows[1]["pii"] if x["kind"] in ("email", "ip", "phone")]
    assert base == want and all(text[x["start"] : x["end"]] == x["found"] for x in rows[1]["pii"])
    near = {k.name: re.compile(k.context) for k in pii.KINDS}
    for x in rows[1]["pii"][::997]:
        raised = bool(near[x["kind"]].search(text[max(0, x["start"] - pii.CONTEXT) : x["start"]].lower()))
        assert (x["score"] > next(k.score for k in pii.KINDS if k.name == x["kind"])) == raised
    if len(rows[1]["pii"]) == len(want):
        assert rows[1]["text"] == "".join(masked)
    assert rows[2]["text"] is None and rows[2]["pii"] == []
