"""Extractors on small sources of our own."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import facts, graph, patterns, routes, rules, taint
from factlake.sources import files as inv
from factlake.sources.lexer import lex, nodes_of


def tree(spark, **sources):
    f = spark.createDataFrame([(k.replace("__", "/").replace("_DOT_", "."), v) for k, v in sources.items()], "file string, text string")
    return f, lex(f)


def files(spark, sources):
    f = spark.createDataFrame(list(sources.items()), "file string, text string")
    return f, lex(f)


def test_lexer_kinds_and_nesting():
    src = "export class A extends B {\n  @Get('x')\n  async m(q: Q): Promise<T> { return this.s.find({ a: q }); }\n}\nconst f = async (a, { b }) => { await g(a); };\n// foo(1)\nconst r = /call\\(/.test('no(1)');\n"
    rows = nodes_of("a.ts", src)
    kinds = [(r["kind"], r["name"]) for r in rows]
    assert ("ClassDeclaration", "A") in kinds and ("MethodDeclaration", "m") in kinds and ("Decorator", "Get") in kinds
    calls = [(r["callee"], r["fn"]) for r in rows if r["kind"] == "CallExpression"]
    assert calls == [("this.s.find", "m"), ("g", "f"), ("/call\\(/.test", None)] or calls == [("this.s.find", "m"), ("g", "f")]
    assert all(r["parent_ord"] is None or r["parent_ord"] < r["ord"] for r in rows)


def test_lexer_survives_anything():
    for text in ("", None, "((((", "}}}}", "`${`", "'", "a => ", "export", "class", "function", "import", "@", "const {", "x = /", "\x00 é"):
        nodes_of("x.ts", text)


def test_services_skip_frontend_and_private(spark):
    f, n = files(spark, {"src/services/billing/sub.ts": "export function pay() {}\nexport class S { run() {} _no() {} }\nconst x = 1;", "src/components/b.ts": "export function C() {}", "lib/index.ts": "export const go = make(1);"})
    got = {r["file"]: (r["name"], r["exported_functions"]) for r in facts.services(f, n).collect()}
    assert got == {"src/services/billing/sub.ts": ("billing/sub", ["pay", "run"]), "lib/index.ts": ("lib", ["go"])}


def test_authz_calls_decorators_middleware(spark):
    f, n = files(spark, {"a.ts": "function x() { checkAccess(u, 'r'); authorName(); }\n@UseGuards(G, f(1, 2))\nclass K {}\napp.use(requireAuth);\nrouter.get('/x', isAuth, h);\n"})
    got = {(r["function_name"], r["caller_function"]) for r in facts.authz_calls(f, n).collect()}
    assert {("checkAccess", "x"), ("authorName", "x"), ("@UseGuards", None), ("isAuth", "get")} <= got
    assert any(r["caller_function"] == "middleware" for r in facts.authz_calls(f, n).collect())


def test_transaction_scopes(spark):
    f, n = files(spark, {"a.ts": "async function save() {\n  await db.$transaction(async (tx) => {\n    await tx.user.create({});\n    await sendWelcomeEmail(u);\n    audit(u);\n    audit(v);\n  });\n  await fetch('x');\n}\n"})
    r = facts.transaction_scopes(n).collect()[0]
    assert (r["line"], r["end_line"], r["function_name"]) == (2, 7, "save")
    assert [(s["type"], s["line"]) for s in r["side_effects"]] == [("email", 4)]
    assert [(c["name"], c["line"]) for c in r["function_calls"]] == [("sendWelcomeEmail", 4), ("audit", 5)]


def test_membership_signals(spark):
    f, n = files(spark, {"a.ts": "export const revokeApiKey = async (keyId) => { await db.apiKey.update({ id: keyId }); await cache.del('apiKey:1'); };\nexport function leaveTeam() {}\n"})
    got = {r["function_name"]: r for r in facts.membership_mutations(n).collect()}
    assert got["revokeApiKey"]["has_cache_invalidation"] and got["revokeApiKey"]["confidence"] == "high" and got["revokeApiKey"]["related_cache_keys"] == ["'apiKey:1'"]
    assert got["leaveTeam"]["confidence"] == "low" and "cache:none" in got["leaveTeam"]["signals"]


def test_jobs(spark):
    f, n = files(spark, {"jobs/a.ts": "import { Worker } from 'bullmq';\nnew Worker('mail', async (j) => { await dedup(j); });\n@Processor('q')\nclass P {\n  @Process('go')\n  async h(j) { work(j); }\n}\nexport function processMailJob(x) {}\n", "jobs/a.spec.ts": "new Worker('no', f);"})
    got = {(r["name"], r["framework"], r["has_idempotency_check"]) for r in facts.job_handlers(f, n).collect()}
    assert {("mail", "bullmq", True), ("q:go", "bullmq", False), ("processMailJob", "custom", False)} <= got and not any("no" == g[0] for g in got)


def test_webhooks(spark):
    src = "export async function POST(req) {\n  const e = stripe.webhooks.constructEvent(b, s);\n  switch (e.type) {\n    case 'a.b': await db.processedEvents.create({ eventId: e.id }); break;\n    case 'c.d': go(); break;\n  }\n}\n"
    f, n = files(spark, {"app/api/webhooks/stripe/route.ts": src, "src/r.ts": "app.post('/webhooks/github', (q) => { verifyGithub(q); });"})
    got = {r["file"]: r for r in facts.webhook_handlers(f, n).collect()}
    a = got["app/api/webhooks/stripe/route.ts"]
    assert (a["provider"], a["event_types"], a["signature_verification"]["method"], a["persistence_marker"]["type"]) == ("stripe", ["a.b", "c.d"], "stripe_construct_event", "database")
    assert [(x["event_type"], x["has_idempotency"]) for x in a["event_type_idempotency"]] == [("a.b", True), ("c.d", False)]
    assert got["src/r.ts"]["provider"] == "github" and got["src/r.ts"]["handler_name"] is None


def test_tests_and_antipatterns(spark):
    src = "function okay() { expect(1); }\ndescribe('a', () => {\n  it('one', () => { okay(); });\n  // JIRA-1\n  test.skip('two', () => { expect(true).toBe(true); });\n});\ndescribe('b', () => {\n  it('three', () => { setTimeout(f, 1); expect(get(201)).toBe(s); });\n});\n"
    f, n = files(spark, {"x.test.ts": src})
    got = {r["name"]: r for r in facts.test_cases(n).collect()}
    assert got["one"]["anti_patterns"] == [] and got["three"]["describes"] == ["a", "b"]
    assert [a["type"] for a in got["two"]["anti_patterns"]] == ["always_passes"]
    assert [a["type"] for a in got["three"]["anti_patterns"]] == ["sleep"] and got["three"]["assertions"][0]["type"] == "status"


ROUTES = {
    "app/api/x/route.ts": ("export async function GET() { await getServerSession(); }\nexport const POST = h;", {("GET", None, True, "nextjs"), ("POST", None, True, "nextjs")}),
    "src/routes/+page.server.ts": ("export const load = f;\nexport const actions = {};", {("GET", None, False, "sveltekit"), ("POST", None, False, "sveltekit")}),
    "server/api/u.post.ts": ("export default defineEventHandler((e) => requireAuth(e));", {("POST", None, True, "nuxt")}),
    "src/routes/q.ts": ("export const useX = routeLoader$(() => 1);\nexport const onGet = f;", {("GET", None, False, "qwik")}),
    "src/pages/api/as.ts": ("import type { APIRoute } from 'astro';\nexport const GET: APIRoute = f;", {("GET", None, False, "astro")}),
    "src/routes/solid.ts": ("createServerAction$(f);", {("POST", None, False, "solid-start")}),
    "keystone.ts": ("import { list } from '@keystone-6/core';\nlist({ access: { a: 1 } });", {("ALL", None, True, "keystone")}),
    "app/routes/r.ts": ("import x from '@remix-run/node';\nexport const loader = f;\nexport function action() { requireUser(1); }", {("GET", None, True, "remix"), ("POST", None, True, "remix")}),
    "src/routes/koa.ts": ("import R from 'koa-router';\nrouter.get('/k', jwtCheck, h);", {("GET", "/k", True, "koa")}),
    "src/routes/fa.ts": ("import f from 'fastify';\nfastify.route({ method: 'put', path: '/f', preHandler: a });", {("PUT", "/f", True, "fastify")}),
    "src/routes/ha.ts": ("import H from '@hapi/hapi';\nserver.route({ method: 'GET', path: '/h', auth: false });", {("GET", "/h", False, "hapi")}),
    "src/routes/ne.ts": ("import { Controller } from '@nestjs/common';\n@Controller('c')\n@UseGuards(G)\nexport class C {\n  @Get('list')\n  all() { return 1; }\n}", {("GET", "list", True, "nestjs")}),
    "src/routes/tr.ts": ("const t = trpc();\nconst r = { get: protectedProcedure.query(f), set: publicProcedure.mutation(g) };", {("GET", "get", True, "trpc"), ("POST", "set", False, "trpc")}),
    "src/routes/ho.ts": ("import { Hono } from 'hono';\napp.post('/x', bearerAuth(t), h);", {("POST", "/x", True, "hono")}),
    "src/routes/el.ts": ("import { Elysia } from 'elysia';\nnew Elysia().get('/e', h);", {("GET", "/e", False, "elysia")}),
    "src/routes/vi.ts": ("import x from 'vinxi';\nfoo();", set()),
    "src/routes/ex.ts": ("app.delete('/d', h);", {("DELETE", "/d", False, "express")}),
}


def test_routes_of_every_framework(spark):
    f, n = files(spark, {k: v[0] for k, v in ROUTES.items()})
    got: dict[str, set] = {k: set() for k in ROUTES}
    for r in routes.routes(f, n).collect():
        got[r["file"]].add((r["method"], r["path"], r["has_auth_middleware"], r["framework"]))
    assert got == {k: v[1] for k, v in ROUTES.items()}


def test_server_functions_belong_to_the_framework_that_is_imported(spark):
    f, n = files(spark, {
        "src/routes/v.ts": "import x from 'vinxi';\nconst go = server$(f);", "src/routes/w.ts": "import { s } from \"@vinxi/server-functions\";\nconst go = server$(async () => getCookie('auth'));",
        "src/routes/p.ts": "const go = server$(f);", "src/routes/q.ts": "import x from 'vinxi';\nconst go = server$(f);\nexport const onPut = f;",
    })
    got = {(r["file"], r["line"], r["method"], r["handler_name"], r["has_auth_middleware"], r["framework"]) for r in routes.routes(f, n).collect()}
    assert got == {("src/routes/v.ts", 2, "POST", "server$", False, "vinxi"), ("src/routes/w.ts", 2, "POST", "server$", True, "vinxi"), ("src/routes/q.ts", 3, "PUT", "onPut", False, "qwik")}


def test_routes_of_frameworks_equal_sql_on_every_source(spark):
    from factlake.plans import bindings

    from .compare import same

    # sf0.001 has ten suppliers, fewer than there are sources.
    same(spark, bindings.QUERIES["facts_routes_of_frameworks"], bindings.ORACLES["facts_routes_of_frameworks"], "/root/testdata/sf0.01")


def test_service_calls(spark):
    f, n = files(spark, {"src/routes/a.ts": "import { load } from '../services/user';\nrouter.get('/a', (q, s) => { load(1); mailService.send(2); other(); });", "src/services/user.ts": "export const load = 1;"})
    b = graph.resolve_modules(graph.import_bindings(n), f)
    got = {(r["service_name"], r["function_name"]) for r in routes.service_calls(routes.routes(f, n), n, b).collect()}
    assert got == {("user", "load"), ("mailService", "send")}


def test_imports_and_calls(spark):
    f, n = files(spark, {"a/x.ts": "import d, { p as q } from './y';\nimport * as ns from '../lib';\nconst { r } = require('./z');\nconst w = require('pkg');\nfunction f() { q(); ns.go(); r(); w.run(); JSON.parse('1'); d.m(); }\n", "a/y.ts": "export function p() {}\nexport default 1;", "lib/index.ts": "export function go() { f(); }", "a/z.js": "x"})
    b = graph.resolve_modules(graph.import_bindings(n), f)
    got = {r["local_name"]: (r["original_name"], r["type"], r["resolved_path"]) for r in b.collect()}
    assert got == {"d": ("default", "default", "a/y.ts"), "q": ("p", "named", "a/y.ts"), "ns": ("*", "namespace", "lib/index.ts"), "r": ("r", "named", "a/z.js"), "w": ("default", "commonjs", None)}
    e = graph.call_edges(n, b)
    edges = {(r["caller"], r["target_function"], r["original_name"], r["target_file"]) for r in e.filter("file = 'a/x.ts'").collect()}
    assert edges == {("f", "q", "p", "a/y.ts"), ("f", "go", None, "lib/index.ts"), ("f", "r", None, "a/z.js"), ("f", "run", None, None), ("f", "m", None, "a/y.ts")}
    up = graph.called_by(graph.call_functions(n), e)
    t = spark.createDataFrame([("p",), ("go",)], "name string")
    assert {(r["root"], r["node"], r["depth"]) for r in graph.callers_of(up, t).collect()} == {("p", "f", 1), ("p", "go", 2), ("go", "f", 1)}
    assert {r["name"]: r["has_auth"] for r in graph.has_auth_in_chain(up, e, t, ["f"]).collect()} == {"p": True, "go": True}
    assert {(r["name"], r["file"]) for r in graph.exports(n).collect()} >= {("p", "a/y.ts"), ("go", "lib/index.ts")}


def test_depth_first_walk_depends_on_order():
    edges = [("f", "T", "A", "f"), ("f", "T", "B", "f"), ("f", "A", "C", "f"), ("f", "C", "B", "f"), ("f", "B", "X", "f"), ("f", "X", "Y", "f")]
    names = lambda depth: {r[0] for r in graph.callers_dfs(edges, "T", depth)}
    assert "Y" in names(3) and "Y" not in names(4)


def test_reachability_stops_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    s = spark.createDataFrame([("a", "a")], "root string, node string")
    assert {(r["node"], r["depth"]) for r in graph.reachable(e, s).collect()} == {("b", 1), ("c", 2)}


def test_flows(spark):
    src = "export function h(req, res) {\n  const id = req.body.id;\n  const safe = sanitize(id);\n  exec(safe);\n  res.send(id);\n}\nfunction admin(x) { el.innerHTML = location.hash; }\n"
    f, n = files(spark, {"src/a.ts": src})
    fl = taint.connect(taint.sources(n), taint.sinks(n), taint.transforms(n))
    got = {(r["source"]["line"], r["sink"]["type"], r["is_sanitized"]) for r in fl.collect()}
    assert (2, "html_response", True) in got and (2, "command_exec", True) in got
    assert any(r["type"] == "dom_sink" for r in taint.sinks(n).collect())
    assert taint.sorted_flows(fl).count() == fl.count()


def test_tenant_relations(spark):
    s = spark.createDataFrame([("prisma/schema.prisma", "model Doc {\n  id String\n  teamId String\n  orgId String\n  org Organization @relation(a)\n}\nmodel Plain {\n  id Int\n}\n")], "file string, text string")
    m = spark.createDataFrame([("db/migrations/1.sql", "ALTER TABLE \"doc\" ENABLE ROW LEVEL SECURITY;\n\nCREATE POLICY p ON doc FOR SELECT USING (org_id = auth.uid()) WITH CHECK (true);")], "file string, text string")
    _, n = files(spark, {"a.ts": "const f = () => prisma.doc.findMany({ where: { orgId: o } });\nconst g = () => supabase.from('x').select();\n"})
    t = facts.with_tenant_flags(facts.tenant_tables(s), facts.protected_tables(m), facts.tenant_queries(n)).collect()
    assert [(r["table"], r["tenant_column"], r["related_tables"], r["has_rls_policy"], r["has_query_filtering"]) for r in t] == [("Doc", "orgId", ["Organization"], True, True)]
    p = facts.sql_policies(m).collect()[0]
    assert (p["policy_type"], p["operations"], p["line"], p["session_context_pattern"]) == ("both", ["SELECT"], 3, "auth.uid()")
    assert {(r["framework"], r["operation"], r["has_tenant_filter"]) for r in facts.tenant_queries(n).collect()} == {("prisma", "select", True), ("supabase", "select", False)}


def test_directives(spark):
    f = spark.createDataFrame([("a.ts", "// hi\n'use server';\n\n\"use strict\"\nimport x;\n'late';"), ("b.ts", "import x;\n'use server'"), ("c.ts", None)], "file string, text string")
    assert {(r["file"], r["directive"]) for r in facts.directives(f).collect()} == {("a.ts", "use server"), ("a.ts", "use strict")}


def test_development_patterns(spark):
    f, n = files(spark, {
        "app/x/actions.ts": "'use server'\nexport async function save() { await db.x(); }",
        "app/api/a/route.ts": "export async function POST() {}\n",
        "src/routes/r.ts": "router.post('/a', h);\n\n\n\n\n\n\nrouter.put('/b',\n  requireAuth, h);\n",
        "jobs/w.ts": "new Worker('q', f);\n", "src/tx.ts": "async function t() { await db.$transaction(async (tx) => { await sendEmail(1); }); }\n",
    })
    f2 = f
    rel = {"services": facts.services(f2, n), "authz_calls": facts.authz_calls(f2, n), "directives": facts.directives(f2), "transaction_scopes": facts.transaction_scopes(n), "webhook_handlers": facts.webhook_handlers(f2, n)}
    deps = spark.createDataFrame([("", ["next", "express", "bullmq", "@prisma/client"])], "folder string, deps array<string>")
    got = {(r["pattern_id"], r["file"], r["line"]) for r in patterns.apply_patterns(patterns.PATTERNS, f2, n, rel, deps).collect()}
    assert {("nextjs.server-action.unprotected", "app/x/actions.ts", 1), ("express.route.no-auth-middleware", "src/routes/r.ts", 1), ("bullmq.job.no-idempotency", "jobs/w.ts", 1), ("prisma.transaction.email-inside", "src/tx.ts", 1)} <= got
    assert not any(g[0].startswith("stripe") for g in got) and ("express.route.no-auth-middleware", "src/routes/r.ts", 8) not in got
    found = patterns.matches_to_findings(patterns.apply_patterns(patterns.PATTERNS[:1], f2, n, rel, deps), patterns.PATTERNS).collect()
    assert found[0]["severity"] == "P0" and "Has directive" in found[0]["context"]


def test_pattern_selection_and_veto(spark):
    p = patterns.PATTERNS
    assert len(patterns.development_for(p, [])) == 8 and patterns.for_frameworks(p, []) == []
    assert {x["id"] for x in patterns.for_frameworks(p, ["stripe"])} == {"stripe.webhook.no-signature", "stripe.webhook.no-idempotency"}
    assert patterns.pattern_stats(p)["prisma"] == 2
    f, n = files(spark, {"a.ts": "hello\nworld", "b.ts": "skip me"})
    one = {"id": "x", "applicability": {"excludePatterns": ["skip"]}, "detection": {"codePatterns": [{"pattern": "hello"}]}}
    assert patterns.match_pattern(one, f, n, {}).count() == 0
    one["applicability"] = {}
    assert [(r["file"], r["line"]) for r in patterns.match_pattern(one, f, n, {}, changed=["a.ts"]).collect()] == [("a.ts", 1)]


def test_inverted_per_function(spark):
    f, n = files(spark, {"a.ts": "function a() {\n  check();\n}\nfunction b() {\n  x();\n}\n"})
    code = {"pattern": "check", "invert": True, "context": {"atFunctionLevel": True}}
    got = patterns.match_code("p", code, patterns.lines_of(f), patterns.function_ranges(n), f).collect()
    assert [(r["symbol"], r["line"]) for r in got] == [("b", 4)]


def test_derived_rules(spark):
    f, n = files(spark, {"src/tx.ts": "async function t() { await db.$transaction(async (tx) => { await sendEmail(1); }); }\n", "jobs/w.ts": "import { Worker } from 'bullmq';\nnew Worker('q', f);\n"})
    rel = {"transaction_scopes": facts.transaction_scopes(n), "job_handlers": facts.job_handlers(f, n), "tests": facts.test_cases(n), "flows": taint.connect(taint.sources(n), taint.sinks(n), taint.transforms(n))}
    got = {(r["invariant_id"], r["file"]) for r in rules.derived_findings(rel).collect()}
    assert {("TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "src/tx.ts"), ("JOBS.RETRY_SAFE", "jobs/w.ts")} <= got


def test_inventory_and_partitions(spark):
    rows = [("package.json", "{}"), ("apps/web/package.json", '{"dependencies": {"next": "1"}}'), ("packages/.x/package.json", "{}"), ("apps/web/a.ts", "x"), ("src/a.test.ts", "x"), ("src/g.generated.ts", "x"), ("src/b.ts", "/* do not edit */"), ("src/c.ts", None), ("node_modules/z.ts", "x"), ("apps/web/next.config.js", "")]
    f = spark.createDataFrame(rows, "file string, text string")
    assert [(r["relative_path"], r["kind"]) for r in inv.discover_partitions(f).collect()] == [("", "workspace"), ("apps/web", "app")]
    assert {r["file"] for r in inv.inventory(f).collect()} == {"apps/web/a.ts", "src/c.ts", "apps/web/next.config.js"}
    assert inv.inventory(f, cap=1).count() == 1
    s = {(r["folder"], r["framework"]): r for r in inv.framework_signals(inv.read_packages(f), f).collect()}
    assert s["apps/web", "nextjs"]["confidence"] == 1.0 and s["apps/web", "nextjs"]["version"] == "1"
    assert inv.rebase_globs(["apps/web/src/**", "packages/*/a", "lib/**"], "apps/web", "app") == ["src/**", "lib/**"]
    assert inv.merge_config({"authzFunctions": ["a"], "x": [1], "o": {"p": 1}}, {"authzFunctions": ["a", "b"], "x": [2], "o": {"q": 2}}) == {"authzFunctions": ["a", "b"], "x": [2], "o": {"p": 1, "q": 2}}
    assert inv.languages(f).first()["languages"] == ["javascript", "typescript"]
    assert "**/dist/**" in inv.framework_excludes(["NestJS"])


@pytest.mark.parametrize("path, expected", [("src/tests/a.ts", True), ("a.spec.tsx", True), ("contests/a.ts", False), ("e2e/x.ts", True)])
def test_test_paths(spark, path, expected):
    assert spark.range(1).select(inv.is_test_path(F.lit(path))).first()[0] is expected
