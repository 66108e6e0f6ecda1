import json

from pyspark.sql import functions as F

from factlake.functions import identity, matching
from factlake.operators import findings, report
from factlake.sources import documents as docs


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_js_regex(spark):
    ok = lambda p, t, f="": one(spark, matching.test(F.lit(t), p, f))
    assert ok(r"[a-z_.[\]]+", "[") and ok(r"a$", "a") and not ok(r"a$", "a\n") and ok(r"a\sb", "a b") and ok(r"^b", "a\nb", "m") and not ok("A", "a") and ok("A", "a", "i")
    assert one(spark, matching.matches(F.lit("x(y"), "/x(/")) is False and one(spark, matching.matches(F.lit("see /x(/ here"), "/x(/")) is True
    assert one(spark, matching.matches(F.lit(None).cast("string"), "a")) is False


def test_globs(spark):
    g = lambda p, s: one(spark, matching.glob_any(F.lit(s), [p]))
    assert g("**/*.ts", "a.ts") and g("**/a/**/*.{ts,js}", "x/a/b.js") and not g("a/*.ts", "a/b/c.ts") and g("src/**", "src/a/b")


def test_rolling_hash(spark):
    def plain(s):
        h = 0
        for i in range(0, len(s.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big")) & 0xFFFFFFFF
        h = abs(h - 2**32 if h >= 2**31 else h)
        out = ""
        while h:
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
            h //= 36
        return out or "0"

    for s in ("", "a", "hello world", "é😀", '{"k": 1}' * 40):
        assert one(spark, identity.rolling_hash36(F.lit(s))) == plain(s), s


def test_collision_suffix(spark):
    df = spark.createDataFrame([("x", i) for i in range(29)], "id string, o int")
    got = [r["id"] for r in identity.with_collision_suffix(df, "id", ["o"]).orderBy("o").collect()]
    assert got[:3] == ["x", "x:a", "x:b"] and got[26] == "x:z" and got[27] == "x:{"


def test_collision_suffix_of_large_groups(spark):
    df = spark.range(55_300).selectExpr("'x' AS id", "id AS o").unionByName(spark.createDataFrame([(None, 0), (None, 1)], "id string, o long"))
    got = {r["o"]: r["id"] for r in identity.with_collision_suffix(df, "id", ["o"]).filter("id IS NOT NULL").collect()}
    assert [got[n] for n in (31, 159, 160, 55_199)] == ["x:\x7f", "x:\xff", "x:\u0100", "x:\ud7ff"] and got[55_200] == "x:55296"
    assert len(got) == len(set(got.values())) == 55_300


def test_collisions_of_many_and_null_rows_equal_sql(spark, tmp_path):
    from factlake.plans import bindings

    from .compare import TABLES, same

    some = spark.range(8_000).selectExpr("id AS doc_id", "'a' AS text", "IF(id % 7 = 0, NULL, 'en') AS lang", "IF(id % 11 = 0, NULL, 'web') AS source", "1L AS n_chars")
    for t in TABLES:
        (some if t == "documents" else some.limit(0)).toPandas().to_parquet(tmp_path / f"{t}.parquet")
    for q in ("collisions", "has_collisions"):
        same(spark, bindings.QUERIES[q], bindings.ORACLES[q], str(tmp_path))


def test_normalize_and_redact(spark):
    assert one(spark, identity.normalize_path(F.lit(" .\\Src\\A.ts "))) == "src/a.ts"
    assert one(spark, identity.redact(F.lit("apiKey"), F.lit("v"))) == "[REDACTED]" and one(spark, identity.redact(F.lit("k"), F.lit("sk_123456789"))) == "sk_1...6789"


def frame(spark, rows):
    return spark.createDataFrame(rows, "invariant_id string, severity string, message string, file string, line int, symbol string, context string, ord int")


def test_correlation(spark):
    f = frame(spark, [
        ("WEBHOOK.IDEMPOTENT", "P1", "a", "f", 1, "s", None, 1), ("TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "P0", "b", "f", 2, "s", None, 2), ("X", "P2", "c", "f", 3, "s", None, 3),
        ("X", "P2", "d", "g", 1, None, None, 4), ("X", "P1", "e", "g", 2, None, None, 5), ("X", "P1", "lonely", "h", 1, "q", None, 6), ("X", "P1", "nowhere", None, 1, "q", None, 7),
    ])
    g = findings.correlate(f)
    got = {r["file"]: r for r in g.collect()}
    assert set(got) == {"f", "g"}
    assert (got["f"]["rule_no"], got["f"]["finding_count"], got["f"]["primary_invariant"], got["f"]["adjusted_severity"]) == (0, 2, "TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "P0")
    assert [s["step"] for s in got["f"]["attack_path"]["steps"]] == [1, 2]
    assert (got["g"]["symbol"], got["g"]["primary_severity"], got["g"]["adjusted_severity"]) == ("unknown", "P1", "P1") and abs(got["g"]["multiplier"] - 1.2) < 1e-9
    s = findings.correlation_stats(f, g).first()
    assert (s["total_findings"], s["correlated_findings"], s["correlation_groups"], s["severity_escalations"], s["percent"]) == (7, 4, 2, 0, 57)


def test_empty_findings(spark):
    f = frame(spark, [])
    assert findings.correlate(f).count() == 0 and findings.by_priority(f).first()["total"] == 0
    n = findings.category_counts(f.select(F.lit("new").alias("category"), F.lit(False).alias("should_fail"))).first()
    assert n["exit_code"] == 0 and n["summary"] == "No findings detected."


def test_baseline_round_trip(spark, tmp_path):
    doc = {"schemaVersion": "1.0.0", "entries": {"a:1": {"findingId": "a:1", "invariantId": "a", "file": "f", "createdAt": "2024-01-01T00:00:00Z", "lastSeenAt": "2024-01-02T00:00:00Z"}}}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "old.json").write_text('{"entries": []}')
    b = docs.load_baseline(spark, str(tmp_path / "b.json"))
    assert b.count() == 1 and docs.load_baseline(spark, str(tmp_path / "no.json")).count() == 0 and docs.load_baseline(spark, str(tmp_path / "bad.json")).count() == 0 and docs.load_waivers(spark, str(tmp_path / "old.json")).count() == 0
    now = F.lit("2024-03-01").cast("timestamp")
    f = frame(spark, [("a", "P0", "m", "f", 1, None, None, 1), ("b", "P0", "m", "g", 1, None, None, 2)]).withColumn("finding_id", F.concat("invariant_id", F.lit(":1")))
    up = {r["finding_id"]: r["is_new"] for r in findings.upsert_baseline(b, f, now).collect()}
    assert up == {"a:1": False, "b:1": True}
    assert findings.prune_baseline(b, now, 30).count() == 0
    report.save_entries(b, str(tmp_path / "out"), "baseline")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_waivers(spark):
    w = spark.createDataFrame([], docs.WAIVERS)
    now = F.lit("2024-03-01").cast("timestamp")
    more = spark.createDataFrame([("a:1", "a", "f", None, "other", "why", "me")], "finding_id string, invariant_id string, file string, symbol string, reason_key string, reason string, owner string")
    w = findings.upsert_waivers(findings.upsert_waivers(w, more, now, 10), more, now, 20)
    assert w.count() == 1 and findings.expiring_waivers(w, now, 30).first()["days_left"] == 20 and findings.prune_waivers(w, F.lit("2024-04-01").cast("timestamp")).count() == 0
    assert one(spark, findings.parse_expiration(F.lit("30d"))) == 30 and one(spark, findings.parse_expiration(F.lit("x"))) is None


def test_accuracy(spark):
    row = lambda v, line: ("R", "f", line, v)
    cols = "invariant_id string, file string, line int, verdict string"
    before = spark.createDataFrame([row("true_positive", 1), row("false_positive", 2), row("uncertain", 3)], cols)
    after = spark.createDataFrame([row("true_positive", 1), row("true_positive", 4), row("false_positive", 2)], cols)
    d = findings.accuracy_diff(before, after).first()
    assert d["before_accuracy"] == 50.0 and round(d["after_accuracy"], 1) == 66.7 and d["verdict"] == "improved"
    new, removed = findings.golden_changes(before, after)
    assert new.count() == 1 and removed.count() == 1 and findings.exit_code(findings.accuracy_diff(after, before)).first()[0] == 1


def test_calibration_tables(spark):
    s = spark.createDataFrame([("p", None, 0.1, "high", 1), ("q", "x", 0.1, "low", 2), ("r", "y", 0.1, "high", 3)], "pattern_id string, framework string, accuracy double, confidence string, ord int")
    p = s.select("pattern_id")
    assert {r["pattern_id"]: r["skip"] for r in findings.should_skip(p, s, "x").collect()} == {"p": True, "q": False, "r": False}
    assert {r[0] for r in findings.skipped_patterns(s, "x").collect()} == {"p"} and {r[0] for r in findings.skipped_patterns(s).collect()} == {"p", "r"}


def test_sarif_document(spark):
    f = frame(spark, [("A", "P0", "m1", "f", 1, None, None, 1), ("B", "P2", "m2", "g", 2, None, None, 2), ("A", "P1", "m3", "h", 3, None, None, 3)]).withColumns({"finding_id": F.col("message"), "waived": F.lit(None).cast("boolean")})
    log = json.loads(report.sarif_document(f, None, "1.0", "2024-01-01T00:00:00Z", "tool").first()["document"])
    run = log["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["A", "B"] and [r["ruleIndex"] for r in run["results"]] == [0, 1, 0] and run["results"][2]["level"] == "warning"


def test_telemetry_and_feedback(spark, tmp_path):
    f = frame(spark, [("A", "P0", "m1", "f", 1, None, None, 1), ("A", "P2", "m2", "g", 2, None, None, 2)])
    t = report.telemetry(f).first()
    assert t["by_invariant"] == {"A": 2} and (t["p0"], t["p2"], t["total"]) == (1, 1, 2)
    rec = f.select(*report.feedback_row(F.lit("A:abc"), F.lit("tp"), F.lit("r"), F.current_timestamp()))
    report.append_feedback(rec, str(tmp_path / "fb"))
    report.append_feedback(rec, str(tmp_path / "fb"))
    assert spark.read.parquet(str(tmp_path / "fb")).count() == 4
    assert report.submission(f).columns[0] == "invariantId"


def test_documents(spark, tmp_path):
    assert docs.parse_patterns("[]") == [] and docs.parse_patterns('{"patterns": [{"id": 1}]}') == [{"id": 1}] and docs.parse_patterns("{}") == []
    assert docs.latest_two(["x-2-review.json", "x-10-review.json", "x-9-review.json", "y"]) == ("x-9-review.json", "x-10-review.json") and docs.latest_two(["a"]) is None
    (tmp_path / "a.json").write_text('{"version": "1", "profile": "p", "services": []}')
    assert docs.load_artifact(spark, str(tmp_path / "a.json"))["profile"] == "p"
    a, b = (spark.createDataFrame([(x,)], "framework string") for x in ("Next", "next"))
    assert docs.cache_covers(a, b).count() == 0
