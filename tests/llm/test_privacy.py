import hashlib
import math
import re

from pyspark.sql import functions as F

from triagelake.llm import privacy

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
TEXTS = [
    "a@b.c_d@e.f x@y", "mail: A.b+c%d@mail-1.example.com, and 10.0.0.255 or 10.0.0.256", "1.2.3.4.5.6.7.8 and 0001.02.3.0099 007.8.9", "999999999999999999999999.1.1.1",
    "4387513035237269 4387-5130-3523-7269 4387 5130 3523 7269 4387513035237268", "call +1 (555) 010-9999. or +49 30 123456 or +1 2", "ünïcödé 😀 a@b.cc 汉字 1.2.3.4", "@ + 1.2",
    "x" * 20000 + "@", "1" * 20000, "1 " * 20000, "a." * 9000 + "@b.c", "+1" * 5000, "", None, "...@...", "+12345678901234567 +123456789", "é" * 30 + "4387513035237269" + "é",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = [True, all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_plain_search(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["_base"]] for r in privacy.with_base(rows).select("doc_id", "_base").collect()}
    assert got == {i: spans(t) for i, t in enumerate(TEXTS)}


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in privacy.op3_privacy(spark, str(tmp_path)).collect():
        want = spans(TEXTS[r["doc_id"]])
        listed = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"] == listed
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in want) for k in range(4)]


def test_revealing_terms_go(spark):
    def text(i, who):
        return f"note {i} written about the {who} here, a{'bcdefghij'[i % 9]}x common words and the rest of it"

    rows = [(i, text(i, "weather"), "n") for i in range(60)]
    rows += [(100 + i, f"item {'abcdef'[i]}{'ghijkl'[i]}z by Zebulon common boss@corp.example common end{'uvwxyz'[i]}q of it", "n") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs).collect()}
    assert all("Zebulon" not in out[100 + i] and "<email>" in out[100 + i] and "boss" not in out[100 + i] for i in range(6))
    assert all("common" in out[100 + i] for i in range(6))  # stands everywhere, so it reveals nothing
    assert all(out[i] == t for i, t, _ in rows[:60])
    found = {r["doc_id"]: r["terms"] for r in privacy.find_personal_data(docs).collect()}
    assert {rows[60][1][s["start"] : s["end"]] for s in found[100]} >= {"Zebulon"}


def test_odd_rows(spark, odd, empty):
    out = privacy.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = out.filter(F.col("doc_id").isNull() | (F.col("doc_id") == 8)).collect()
    assert any("<phone>" in r["text"] for r in rows) and any("<email>" in r["text"] for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert privacy.sanitise(empty).count() == 0 and privacy.find_personal_data(empty).count() == 0
    twice = odd.union(odd)
    assert privacy.find_personal_data(twice).count() == twice.count()


def test_overlapping_spans(spark):
    rows = spark.createDataFrame([(1, "x +1.2.3.4 567 8901 y")], "doc_id long, text string")
    assert privacy.sanitise(rows).first()["text"] == "x <phone> y"


def test_far_and_rare_terms_go(spark):
    filler = "plain common words stand here " * 40
    rows = [(i, f"plain common words stand here note {i}") for i in range(300)]
    rows += [(1000, f"Quillon opened it. {filler} write to one@corp.example today, said quillon"), (1001, f"call +1 (555) 010-9999 {filler} for Zebulon"), (1002, f"{filler} Zebulon has +1 555 0109999")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs).collect()}
    # Further off than any window, and with values that stand in one and in two documents.
    assert "quillon" not in out[1000].lower() and all("Zebulon" not in out[i] for i in (1001, 1002))
    assert all(out[i].count("plain common words stand here") == 40 for i in (1000, 1001, 1002))
    assert all(out[i] == t for i, t in rows[:300])
    found = {r["doc_id"]: r["terms"] for r in privacy.find_personal_data(docs).collect()}
    assert [rows[300][1][s["start"] : s["end"]] for s in found[1000] if s["value"] == "<term>"].count("Quillon") == 1


def test_shares_follow_the_counts(spark):
    rows = [(1, "alpha beta me@corp.example"), (2, "alpha beta gamma me@corp.example"), (3, "gamma delta"), *[(i, "delta") for i in range(4, 21)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = privacy._holding(privacy.with_base(docs))
    got = {r["term"]: r["share"] for r in privacy.disclosures(docs, held, prior=1.0).collect()}
    want = {t: 1 - math.log2((n_ct + 0.1) / (n_t + 1)) / math.log2(0.1) for t, n_ct, n_t in (("alpha", 2, 2), ("beta", 2, 2), ("gamma", 1, 2), ("corp", 2, 2), ("example", 2, 2))}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
