import json

import pytest

from factlake.functions import catalogue
from factlake.operators import session
from factlake.operators.patterns import PATTERNS
from factlake.sources.files import read_packages, read_tree


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "src/services").mkdir(parents=True)
    (tmp_path / "jobs").mkdir()
    (tmp_path / "src/services/user.ts").write_text("export async function removeMember(userId) {\n  await db.$transaction(async (tx) => { await sendMail(userId); });\n}\n")
    (tmp_path / "jobs/w.ts").write_text("import { Worker } from 'bullmq';\nnew Worker('q', f);\n")
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"bullmq": "1", "@prisma/client": "1"}}))
    tree = read_tree(spark, str(tmp_path)).persist()
    assert {r["file"] for r in tree.collect()} == {"src/services/user.ts", "jobs/w.ts", "package.json"}
    got = {(r["invariant_id"], r["file"]) for r in session.scan(spark, tree.filter("file LIKE '%.ts'"), PATTERNS, read_packages(tree)).collect()}
    assert {("TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "src/services/user.ts"), ("JOBS.RETRY_SAFE", "jobs/w.ts"), ("AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE", "src/services/user.ts")} <= got
    assert set(session.upload_payload(session.collect(tree.filter("file LIKE '%.ts'")))) >= {"services", "flows", "policies"}


def test_configuration_and_guards(tmp_path):
    assert session.load_config(str(tmp_path), {"a": [1]}) == {"a": [1]}
    (tmp_path / "factlake.config.json").write_text('{"a": [2]}')
    assert session.load_config(str(tmp_path), {"a": [1]}) == {"a": [2]}
    assert session.allowed_target(str(tmp_path), [str(tmp_path)])
    with pytest.raises(PermissionError):
        session.allowed_target("/etc", [str(tmp_path)])
    assert session.ci_context({"GITHUB_SHA": "x"})["sha"] == "x"
    assert "start_line" in session.artifact_schema()


def test_catalogue(spark):
    assert catalogue.catalogue(spark).count() == 100 and len(catalogue.RULES) == 101
    assert catalogue.catalogue(spark, "P2").count() == 1
    assert catalogue.explain(spark, "jobs.retry_safe")[0].startswith("JOBS.RETRY_SAFE (P1")


def test_edits_of_known_files_are_seen(spark, tmp_path):
    import os

    from factlake.plans.bindings import CODE
    from factlake.streaming import watch

    tree, state = tmp_path / "tree", str(tmp_path / "state")
    tree.mkdir()
    (tree / "a.ts").write_text("the one and the other")
    (tree / "b.ts").write_text("nothing")
    scan = watch.line_scan("p", CODE)
    found, hits = watch.scan_changes(spark, str(tree), state, 1, scan)
    assert {r["change"] for r in found.collect()} == {"added"} and hits.count() == 1
    (tree / "b.ts").write_text("now the word and more")
    os.utime(tree / "b.ts", (2_000_000_000, 2_000_000_000))
    (tree / "a.ts").unlink()
    found, hits = watch.scan_changes(spark, str(tree), state, 2, scan)
    assert {(r["file"][-4:], r["change"]) for r in found.collect()} == {("b.ts", "changed"), ("a.ts", "removed")}
    assert [r["file"][-4:] for r in hits.collect()] == ["b.ts"]
