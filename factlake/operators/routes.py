"""Routes: an ordered framework classifier on path and text, and one extractor for each framework.

Every extractor is a filter over ``files`` or ``nodes`` that yields
(file, line, method, path, handler_name, has_auth_middleware, auth_middleware, framework, ord, node).
``node`` is the call or method a route comes from, or null when the whole file is its scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import any_of, first_match, glob_any, group, js_regex, line_of, test, test_any

# Where routes are looked for.
ROUTE_GLOBS = [
    "**/routes/**/*.{ts,js,tsx}", "**/api/**/*.{ts,js}", "**/app/**/route.{ts,js}", "**/pages/api/**/*.{ts,js}", "**/controllers/**/*.{ts,js}", "**/*.controller.{ts,js}",
    "**/+server.{ts,js}", "**/+page.server.{ts,js}", "**/hooks.server.{ts,js}", "**/server/api/**/*.ts", "**/server/routes/**/*.ts", "**/keystone.{ts,js}",
    "**/app/routes/**/*.{tsx,ts,jsx,js}", "**/plugins/**/*.{ts,js}", "**/lib/**/*.{ts,js}", "**/app.{ts,js}", "**/server.{ts,js}", "**/index.{ts,js}", "**/fastify/**/*.{ts,js}",
    "**/src/**/*.ts", "**/server/middleware/**/*.ts", "**/app/server/**/*.ts", "**/app/api/**/*.ts",
]
QWIK_HANDLERS = r"export\s+const\s+(onRequest|onGet|onPost|onPut|onDelete)"
VERBS = r"\.(get|post|put|delete|patch|all|options|head)\s*\("
HTTP = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"]
# Words of authentication middleware (case-insensitive) and of file-level authentication by framework: (pattern, flags).
MIDDLEWARE = ["auth", "protect", "guard", "requireAuth", "authenticate", "isAuthenticated", "ensureAuth", "checkAuth", "verifyToken", "jwt", "passport", "session"]
_AUTH = {
    "nextjs": [r"getServerSession", r"getSession", r"auth\(\)", r"currentUser", r"requireAuth", r"withAuth"],
    "hono": [
        r"jwt\(", r"bearerAuth\(", r"basicAuth\(", r"jwtPayload", r"verifyWithJwks", r"verifyAuth\(", r"getAuthUser\(", r"authHandler\(", r"c\.get\(['\"`]authUser['\"`]\)", r"useSession\(",
        r"c\.get\(['\"`]session['\"`]\)", r"clerkAuth\(", r"clerkMiddleware\(", r"getAuth\(", r"firebaseAuth\(", r"verifyIdToken", r"oidcAuth\(", r"oidcAuthMiddleware", r"c\.get\(['\"`]user['\"`]\)",
        r"c\.get\(['\"`]jwtPayload['\"`]\)", r"c\.var\.user", r"c\.var\.session", r"@hono/auth-js", r"@hono/clerk-auth", r"@hono/firebase-auth", r"@hono/oidc-auth", r"@hono/session", r"hono/jwt", r"hono/bearer-auth", r"hono/basic-auth",
    ],
    "sveltekit": [r"locals\.user", r"locals\.session", r"locals\.isAdmin", r"event\.locals", r"getSession\(", r"authenticateRequest\(", r"authCondition\("],
    "nuxt": [r"useSession\(", r"getServerSession\(", r"event\.context\.user", r"event\.context\.session", r"requireAuth\(", r"protectRoute\(", (r"getCookie.*auth", "i"), r"verifyToken\("],
    "qwik": [
        (r"cookie\.get\s*\(\s*['\"`].*auth", "i"), (r"cookie\.get\s*\(\s*['\"`].*session", "i"), (r"cookie\.get\s*\(\s*['\"`].*token", "i"), r"Authorization.*Bearer", r"QwikAuth\$", r"useSession\(", r"useSignIn\(",
        r"useSignOut\(", r"getSession\(", r"@auth/qwik", r"@auth/core/jwt", r"AUTH_SECRET", r"sharedMap\.get\s*\(\s*['\"`]user['\"`]\)", r"sharedMap\.get\s*\(\s*['\"`]session['\"`]\)", r"requestEvent\.sharedMap",
        r"useGetCurrentUser", r"useAuthSession", r"useAuth\(", r"serverSideFetch\(", r"plugin@auth", (r"onRequest.*auth", "i"),
    ],
    "astro": [r"locals\.session", r"locals\.user", r"Astro\.locals", r"context\.locals", r"getSession\(", (r"cookies\.get\s*\(\s*['\"`].*auth", "i")],
    "solid-start": [
        r"getSession\(", r"useSession\(", r"authOpts", r"@auth/solid-start", r"\[\.\.\.solidauth\]", r"AuthRequest\.validate", r"lucia\.validateSession", r"lucia\.createSession", r"lucia-auth", r"createAuthCallbacks",
        r"useAppSession\(", (r"createServerFn.*auth", "i"), (r"vinxi.*session", "i"), r"getUser\(", r"getCurrentUser\(", (r"request\.headers\.get\s*\(\s*['\"`]authorization", "i"), (r"request\.headers\.get\s*\(\s*['\"`]cookie", "i"),
        r"session\.get\(", r"session\.set\(", r"validateSession\(", r"parseCookie", r"getCookie\(", (r"redirect.*login", "i"), r"throw.*401", r"throw.*403",
    ],
    "keystone": [r"context\.session", r"context\.session\?\.", r"session\.itemId", r"session\?\.itemId", r"access:\s*\{", r"permissions\.", r"isAccessAllowed"],
    "elysia": [
        r"@elysiajs/jwt", r"jwt\.sign", r"jwt\.verify", r"@elysiajs/bearer", r"bearer\(", r"@elysiajs/cookie", r"cookie\.auth", (r"setCookie.*auth", "i"), r"better-auth", r"auth\.handler", r"isAuthenticated",
        (r"derive.*auth", "i"), (r"derive.*user", "i"), (r"onBeforeHandle.*auth", "i"), r"guard\(", r"\.macro\(",
    ],
    "nitro": [
        r"event\.context\.auth", r"event\.context\.user", r"event\.context\.session", r"requireAuth\(", r"defineRequireAuthEventHandler", r"getAuthUser\(", (r"getHeader.*authorization", "i"), (r"getCookie.*auth", "i"),
        (r"getCookie.*session", "i"), r"getSession\(event", r"useSession\(", r"createError.*401", r"createError.*403", (r"sendError.*Unauthorized", "i"),
    ],
    "vinxi": [
        r"event\.context\.auth", r"event\.context\.user", r"event\.context\.session", r"@vinxi/h3", (r"vinxi.*session", "i"), (r"vinxi.*auth", "i"), (r"server\$.*auth", "i"), (r"createServerFn.*auth", "i"),
        (r"getHeader.*authorization", "i"), (r"getCookie.*auth", "i"), r"requireAuth\(",
    ],
    "remix": [
        r"authenticator\.isAuthenticated", r"getSession\(", r"requireUser\(", r"requireUserId\(", r"requireAuth\(", (r"session\.get\s*\(\s*['\"`]user", "i"), (r"session\.get\s*\(\s*['\"`]userId", "i"),
        (r"request\.headers\.get\s*\(\s*['\"`]authorization", "i"), (r"cookies\.get\s*\(\s*['\"`].*session", "i"), r"throw\s+redirect\s*\(", r"assertUser\(", r"sessionStorage\.", r"authSessionStorage\.", r"invariantResponse\(",
    ],
    "koa": [r"ctx\.state\.user", r"ctx\.state\.session", r"ctx\.session", r"ctx\.isAuthenticated\(\)", r"passport\.authenticate", r"jwt\(", r"koaJwt\(", r"requireAuth", r"isLoggedIn"],
    "hapi": [r"auth:\s*['\"`]\w+['\"`]", r"auth:\s*\{", r"server\.auth\.strategy", r"server\.auth\.default", r"hapi-auth-jwt2", r"hapi-auth-basic", r"hapi-auth-cookie", r"@hapi/bell", r"credentials"],
}
FILE_AUTH = {k: [(p, "") if isinstance(p, str) else p for p in v] for k, v in _AUTH.items()}


def _import_of(*modules: str) -> list[str]:
    return [q for m in modules for q in (f"from '{m}'", f'from "{m}"', f"require('{m}')", f'require("{m}")')]


def route_framework(path: Column, text: Column) -> Column:
    """The 18-way ordered classifier; the nitro branch comes after nuxt, which takes its texts first.

    ``server$(`` alone makes no qwik file of one that imports vinxi, whose routes it marks as well.
    """
    low = F.lower(text)
    has = lambda *w: any_of(F.contains(low, F.lit(x)) for x in w)
    at = lambda *w: any_of(F.contains(path, F.lit(x)) for x in w)
    handler = has("defineeventhandler", "eventhandler(")
    raw = lambda *w: any_of(F.contains(text, F.lit(x)) for x in w)
    vinxi = has("from 'vinxi'", 'from "vinxi"', "@vinxi/", "vinxi.config")
    return first_match([
        (at("+server.", "+page.server.", "hooks.server."), "sveltekit"),
        (handler | at("/server/api/", "/server/routes/"), "nuxt"),
        (has("routeloader$", "routeaction$", "globalaction$", "from '@builder.io/qwik", 'from "@builder.io/qwik') | (has("server$(") & (~vinxi | test(text, QWIK_HANDLERS, "i"))), "qwik"),
        (has("apiroute", "apicontext") | F.endswith(path, F.lit(".astro")), "astro"),
        (has("createserverdata$", "createserveraction$", "from 'solid-start", 'from "solid-start'), "solid-start"),
        (has("@keystone-6", "@keystonejs", "keystone.ts") | (has("context.session") & has("access:")), "keystone"),
        (has("@remix-run/", 'from "remix"', "from 'remix'", 'from "react-router"', "from 'react-router'", "route.loaderargs", "route.actionargs"), "remix"),
        (at("/app/routes/") & raw("function loader", "function action", "export const loader", "export const action"), "remix"),
        (has(*_import_of("koa-router", "@koa/router", "koa")), "koa"),
        (has(*_import_of("fastify"), "fastify.route(", "fastify.get(", "fastify.post(", "fastifyinstance"), "fastify"),
        (has(*_import_of("@hapi/hapi"), "server.route("), "hapi"),
        (at("/app/") & at("route."), "nextjs"),
        (at("/pages/api/", "/api/") & has("nextapiresponse", "nextrequest"), "nextjs"),
        (has("@controller", "@nestjs"), "nestjs"),
        (has("trpc"), "trpc"),
        (has("from 'hono'", 'from "hono"'), "hono"),
        (has("from 'elysia'", 'from "elysia"', "@elysiajs/", "new elysia("), "elysia"),
        (handler & ~has("nuxt") & has("nitro", "from 'h3'", 'from "h3"'), "nitro"),
        (vinxi, "vinxi"),
        (test(text, VERBS), "express"),
    ], "unknown")


def file_auth(framework: str, text: Column) -> tuple[Column, Column]:
    """(any pattern matches, sources of those that do or null)."""
    # A loop over a constant array: far less generated code than a test for each pattern.
    table = F.array(*[F.struct(F.lit(p).alias("said"), F.lit(js_regex(p, f)).alias("run")) for p, f in FILE_AUTH[framework]])
    found = F.transform(F.filter(table, lambda r: F.coalesce(F.call_function("rlike", text, r["run"]), F.lit(False))), lambda r: r["said"])
    return F.size(found) > 0, F.when(F.size(found) > 0, found)


def _row(df: DataFrame, framework: str, method, handler, auth, names, line, path=None, ord_col=None, node=None) -> DataFrame:
    col = lambda v, t="string": F.lit(v).cast(t) if v is None or isinstance(v, str) else v
    return df.select(
        "file", line.cast("int").alias("line"), col(method).alias("method"), col(path).alias("path"), col(handler).alias("handler_name"), auth.alias("has_auth_middleware"),
        (F.lit(None).cast("array<string>") if names is None else names).alias("auth_middleware"), F.lit(framework).alias("framework"),
        (F.lit(0) if ord_col is None else ord_col).alias("ord"), (F.lit(None).cast("int") if node is None else node).alias("node"),
    )


def _from_text(files: DataFrame, framework: str, cases: list[tuple[Column, Column, str, str]], auth_any: Column | None = None, names: Column | None = None) -> DataFrame:
    """Rows of a file for each (condition, matched text, method, handler)."""
    t = F.col("text")
    any_auth, found = file_auth(framework, t)
    rows = F.filter(F.array(*[F.when(c, F.struct(F.lit(m).alias("m"), F.lit(h).alias("h"), line_of(t, hit).alias("l"), F.lit(i).alias("o"))) for i, (c, hit, m, h) in enumerate(cases)]), lambda r: r.isNotNull())
    df = files.withColumn("r", F.explode(rows))
    return _row(df, framework, F.col("r.m"), F.col("r.h"), any_auth if auth_any is None else auth_any, found if names is None else names, F.col("r.l"), ord_col=F.col("r.o"))


def _hit(p: str, flags: str = "") -> tuple[Column, Column]:
    t = F.col("text")
    return test(t, p, flags), F.regexp_extract(t, js_regex(p, flags), 0)


def _verb_exports(names: list[str], tail: str, functions: bool = True) -> list[tuple[Column, Column, str, str]]:
    out = []
    for m in names:
        fp, cp = rf"export\s+(async\s+)?function\s+{m}\s*\(", rf"export\s+const\s+{m}\s*{tail}"
        (c1, h1), (c2, h2) = _hit(fp, "i"), _hit(cp, "i")
        out.append(((c1 | c2) if functions else c2, F.when(c1, h1).otherwise(h2) if functions else h2, m, m))
    return out


def _middleware_names(args: Column, patterns: Column) -> Column:
    return F.transform(F.filter(args, lambda a: patterns(a)), lambda a: F.trim(F.substring_index(a, "(", 1)))


def routes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """All routes; service calls are joined by ``service_calls``."""
    f = files.filter(glob_any(F.col("file"), ROUTE_GLOBS)).withColumn("text", F.coalesce("text", F.lit("")))
    # Kept, as every framework's branch scans it and the classifier is a long expression.
    f = f.withColumn("framework", route_framework(F.concat(F.lit("/"), F.col("file")), F.col("text"))).persist()
    of = lambda *fw: f.filter(F.col("framework").isin(*fw)).select("file", "text")
    t = F.col("text")
    out = []

    out.append(_from_text(of("nextjs"), "nextjs", _verb_exports(HTTP, "=")))
    load, load_hit = _hit(r"export\s+const\s+load")
    actions, actions_hit = _hit(r"export\s+const\s+actions")
    out.append(_from_text(of("sveltekit"), "sveltekit", [*_verb_exports(HTTP, "="), (load | test(t, "PageServerLoad", ""), load_hit, "GET", "load"), (actions, actions_hit, "POST", "actions")]))
    out.append(_from_text(of("astro"), "astro", _verb_exports(HTTP[:5], "[:=]", False)))

    nuxt = of("nuxt").filter(test(t, "defineEventHandler|eventHandler", ""))
    any_auth, found = file_auth("nuxt", t)
    suffix = F.coalesce(F.upper(group(F.col("file"), r"\.(get|post|put|delete|patch)\.ts$", 1)), F.lit("GET"))
    out.append(_row(nuxt, "nuxt", suffix, "eventHandler", any_auth, found, line_of(t, _hit("defineEventHandler|eventHandler")[1])))
    for fw in ("nitro", "vinxi"):
        any_auth, found = file_auth(fw, t)
        suffix = F.coalesce(F.upper(group(F.col("file"), r"\.(get|post|put|delete|patch)\.(ts|js)$", 1)), F.lit("GET"))
        out.append(_row(of(fw).filter(test(t, r"defineEventHandler|eventHandler\(", "")), fw, suffix, "defineEventHandler", any_auth, found, line_of(t, _hit(r"defineEventHandler|eventHandler\(")[1])))
    out.append(_from_text(of("vinxi"), "vinxi", [(*_hit(r"server\$\s*\("), "POST", "server$")]))

    any_auth, found = file_auth("qwik", t)
    for p, m, h in ((r"export\s+const\s+\w+\s*=\s*routeLoader\$", "GET", "routeLoader$"), (r"export\s+const\s+\w+\s*=\s*(?:routeAction\$|globalAction\$)", "POST", "routeAction$")):
        each = of("qwik").select("file", "text", F.posexplode(F.regexp_extract_all("text", F.lit(js_regex(p)), F.lit(0))).alias("k", "hit"))
        out.append(_row(each, "qwik", m, h, any_auth, found, line_of(t, F.col("hit")), ord_col=F.col("k")))
    out.append(_from_text(of("qwik"), "qwik", [(*_hit(rf"export\s+const\s+{h}", "i"), "ALL" if h == "onRequest" else h[2:].upper(), h) for h in ("onRequest", "onGet", "onPost", "onPut", "onDelete")]))

    out.append(_from_text(of("solid-start"), "solid-start", [
        (*_hit(r"createServerData\$"), "GET", "createServerData$"), (*_hit(r"createServerAction\$"), "POST", "createServerAction$"), (*_hit(r"server\$\s*\("), "POST", "server$"), (*_hit(r"createServerFn\s*\("), "POST", "createServerFn"),
    ]))

    any_auth, found = file_auth("keystone", t)
    lists = of("keystone").select("file", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"list\s*\(\s*\{"), F.lit(0))).alias("k", "hit"))
    out.append(_row(lists, "keystone", "ALL", "list", test(t, r"access:\s*\{", "") | any_auth, found, line_of(t, F.col("hit")), ord_col=F.col("k")))
    plain = of("keystone").filter(test(t, r"context\.session", "") & ~test(t, r"list\s*\(\s*\{", ""))
    out.append(_row(plain, "keystone", "POST", "customResolver", F.lit(True), F.array(F.lit("context.session")), line_of(t, F.lit("context.session"))))

    loader, action = r"function loader|export const loader", r"function action|export const action"
    out.append(_from_text(of("remix"), "remix", [(*_hit(loader), "GET", "loader"), (*_hit(action), "POST", "action")]))

    calls = nodes.filter("kind = 'CallExpression'")
    in_files = lambda *fw: calls.join(of(*fw).select("file", F.col("text").alias("file_text")), "file")
    verb, path = group(t, r"\.(get|post|put|delete|patch|all|options|head)\s*\(\s*['\"`]([^'\"`]*)['\"`]", 1), group(t, r"\.(get|post|put|delete|patch|all|options|head)\s*\(\s*['\"`]([^'\"`]*)['\"`]", 2)
    line = F.col("start_line")
    at = {"ord_col": F.col("ord"), "node": F.col("ord")}
    is_mw = lambda a: test_any(a, MIDDLEWARE)
    is_hono = lambda a: test_any(a, [p for p, _ in FILE_AUTH["hono"]], "")
    config = group(t, r"method\s*:\s*['\"`](\w+)['\"`]", 1)
    place = group(t, r"path\s*:\s*['\"`]([^'\"`]*)['\"`]", 1)
    is_config = F.contains(t, F.lit(".route(")) & config.isNotNull() & place.isNotNull()
    fast = in_files("fastify").filter(is_config)
    fast_auth = test_any(t, [r"auth\s*:\s*['\"`]\w+['\"`]", r"auth\s*:\s*\{", r"preHandler\s*:"], "")
    out.append(_row(fast, "fastify", F.upper(config), None, fast_auth, F.when(fast_auth, F.array(F.lit("route-config"))), line, place, **at))
    for fw in ("express", "fastify", "hono"):
        rows = in_files(fw).filter(verb.isNotNull())
        rows = rows.filter(~is_config) if fw == "fastify" else rows
        named = _middleware_names(F.col("args"), is_mw)
        auth = F.exists("args", is_mw)
        if fw == "hono":
            named = F.concat(named, F.array_except(_middleware_names(F.col("args"), is_hono), named))
            auth = auth | F.exists("args", is_hono) | is_hono(F.col("file_text"))
        named = F.filter(named, lambda x: x != "")
        out.append(_row(rows, fw, F.upper(verb), None, auth, F.when(F.size(named) > 0, named), line, path, **at))

    koa_any, koa_found = file_auth("koa", F.col("file_text"))
    is_koa = lambda a: is_mw(a) | test_any(a, [p for p, _ in FILE_AUTH["koa"]], "")
    rest = F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))
    koa_named = F.filter(_middleware_names(rest, is_koa), lambda x: x != "")
    routed = test_any(t, [r"router\.(get|post|put|delete|patch|all|options|head)", r"\)\s*\.(get|post|put|delete|patch|all|options|head)\s*\("]) | any_of(F.contains("file_text", F.lit(w)) for w in ("@koa/router", "koa-router"))
    literal = group(F.get("args", 0), r"^['\"`]([^'\"`]*)['\"`]$", 1)
    koa = in_files("koa").filter(F.col("callee_object").isNotNull() & F.lower("name").isin("get", "post", "put", "delete", "patch", "all", "options", "head")).filter(routed & literal.isNotNull())
    out.append(_row(koa, "koa", F.upper("name"), None, koa_any | F.exists(rest, is_koa), F.when(F.size(koa_named) > 0, koa_named).otherwise(koa_found), line, literal, **at))

    hapi_any, hapi_found = file_auth("hapi", F.col("file_text"))
    hapi_path = group(t, r"path:\s*['\"`]([^'\"`]+)['\"`]", 1, "")
    hapi_auth = F.when(group(t, r"auth:\s*(['\"`]\w+['\"`]|\{[^}]+\}|false)", 1, "") != "false", group(t, r"auth:\s*(['\"`]\w+['\"`]|\{[^}]+\}|false)", 1, ""))
    hapi = in_files("hapi").filter(test(t, r"\.route\s*\(", "") & group(t, r"method:\s*['\"`](\w+)['\"`]", 1).isNotNull() & hapi_path.isNotNull())
    out.append(_row(hapi, "hapi", F.upper(group(t, r"method:\s*['\"`](\w+)['\"`]", 1)), None, hapi_any | hapi_auth.isNotNull(), F.coalesce(F.when(hapi_auth.isNotNull(), F.array(F.regexp_replace(hapi_auth, "['\"]", ""))), hapi_found), line, hapi_path, **at))

    el_any, el_found = file_auth("elysia", F.col("file_text"))
    out.append(_row(in_files("elysia").filter(verb.isNotNull()), "elysia", F.upper(verb), None, el_any | test_any(t, ["derive", "guard", "onBeforeHandle"], ""), el_found, line, path, **at))

    guard = lambda d: d.rlike("@UseGuards|@Roles|@Auth|@RequirePermission")
    guards = lambda ds: F.transform(F.filter(F.coalesce(ds, F.array().cast("array<string>")), guard), lambda d: F.regexp_extract(d, r"@(\w+)", 1))
    nest = nodes.join(of("nestjs").select("file"), "file", "left_semi")
    classes = nest.filter("kind = 'ClassDeclaration'").select("file", F.col("ord").alias("parent_ord"), guards(F.col("decorators")).alias("class_guards"))
    route = F.get(F.filter(F.col("decorators"), lambda d: d.rlike(r"(?i)@(Get|Post|Put|Delete|Patch|All|Options|Head)\s*\(([^)]*)\)")), -1 + F.size(F.filter(F.col("decorators"), lambda d: d.rlike(r"(?i)@(Get|Post|Put|Delete|Patch|All|Options|Head)\s*\(([^)]*)\)"))))
    methods = nest.filter("kind = 'MethodDeclaration'").join(classes, ["file", "parent_ord"], "left").withColumn("route", route).filter("route IS NOT NULL")
    both = F.concat(F.coalesce("class_guards", F.array().cast("array<string>")), guards(F.col("decorators")))
    rp = r"@(Get|Post|Put|Delete|Patch|All|Options|Head)\s*\(([^)]*)\)"
    where = F.nullif(F.trim(F.regexp_replace(group(F.col("route"), rp, 2), "['\"]", "")), F.lit(""))
    out.append(_row(methods, "nestjs", F.upper(group(F.col("route"), rp, 1)), F.col("name"), F.size(both) > 0, F.when(F.size(both) > 0, both), line, where, **at))

    value = F.regexp_replace(t, r"^[^:]*:\s*", "")
    props = nodes.filter("kind = 'PropertyAssignment'").join(of("trpc").select("file"), "file", "left_semi").withColumn("value", value)
    props = props.filter(any_of(F.contains("value", F.lit(w)) for w in ("Procedure", ".query", ".mutation")))
    guarded = test_any(F.col("value"), ["protectedProcedure", "authedProcedure", "adminProcedure"], "")
    out.append(_row(props, "trpc", F.when(F.contains("value", F.lit(".query")), "GET").otherwise("POST"), F.col("name"), guarded, F.when(guarded, F.array(F.lit("protectedProcedure"))), line, F.col("name"), **at))

    both_rows = out[0]
    for o in out[1:]:
        both_rows = both_rows.unionByName(o)
    return both_rows


def service_imports(bindings: DataFrame) -> DataFrame:
    """Bindings whose module looks like a service: file, local_name, source_module."""
    looks = test_any(F.concat(F.lit("from '"), F.col("source_module"), F.lit("'")), [r"from\s+['\"`].*service", r"from\s+['\"`]@/services", r"from\s+['\"`]~/services"])
    return bindings.filter(looks & F.col("type").isin("named", "default")).select("file", F.when(F.col("type") == "named", F.col("original_name")).otherwise(F.col("local_name")).alias("local_name"), "source_module")


def service_calls(routes_df: DataFrame, nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """file, route_ord, node, service_name, function_name, line: calls of imported services in each route's scope."""
    imports = service_imports(bindings)
    c = nodes.filter("kind = 'CallExpression'")
    obj = F.col("callee_object")
    by_object = c.filter(obj.isNotNull()).join(imports.select("file", F.col("local_name").alias("callee_object"), F.lit(True).alias("known")), ["file", "callee_object"], "left")
    known = by_object.filter("known OR lower(callee_object) LIKE '%service%'").select("file", "ord", "start_off", "end_off", F.col("callee_object").alias("service_name"), F.col("name").alias("function_name"), F.col("start_line").alias("line"), F.coalesce("known", F.lit(False)).alias("known"))
    plain = c.filter(obj.isNull()).join(imports.withColumnRenamed("local_name", "name"), ["file", "name"]).select(
        "file", "ord", "start_off", "end_off", F.coalesce(F.element_at(F.split("source_module", "/"), -1), F.lit("service")).alias("service_name"), F.col("name").alias("function_name"), F.col("start_line").alias("line"), F.lit(True).alias("known"))
    all_calls = known.unionByName(plain)
    scope = nodes.select("file", F.col("ord").alias("node"), F.col("start_off").alias("a"), F.col("end_off").alias("b"))
    r = routes_df.select("file", F.col("ord").alias("route_ord"), "node", "handler_name", "method").join(scope, ["file", "node"], "left")
    i = all_calls.withColumnRenamed("file", "f")
    held = F.when(F.col("node").isNull(), F.col("known")).otherwise((F.col("start_off") >= F.col("a")) & (F.col("end_off") <= F.col("b")) & (F.col("ord") > F.col("node")))
    return r.join(i, (F.col("file") == F.col("f")) & held).select("file", "route_ord", "node", "method", "service_name", "function_name", "line")
