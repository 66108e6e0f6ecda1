"""Pattern tables, word lists and weights that results depend on, in table order.

Patterns are written for case-insensitive matching unless the consumer says otherwise.
"""

# Authorization. Names are matched exactly, as lower-case parts, or as parts.
AUTHZ_FUNCTIONS = [
    "authorize", "requireAuth", "checkAuth", "checkPermission", "checkAccess", "requirePermission", "ensureAuth", "ensureAuthenticated",
    "assertAuth", "assertPermission", "verifyAuth", "verifyAccess", "canAccess", "hasPermission", "isAuthorized",
]
AUTHZ_PARTS = [
    "authorize", "requireauth", "checkauth", "checkpermission", "checkaccess", "requirepermission", "ensureauth", "assertauth",
    "verifyauth", "canaccess", "haspermission", "isauthorized", "guardaccess", "protectedroute", "requirerole", "checkrole",
]
AUTHZ_FRAMEWORK_PARTS = [
    "getServerSession", "getSession", "getToken", "withAuth", "useSession", "auth", "currentUser", "requireAuth",
    "protectedProcedure", "authedProcedure", "adminProcedure", "ctx.session", "ctx.user",
    "validateRequest", "validateSession", "lucia.validateSession",
    "auth()", "clerkClient", "getAuth",
    "locals.user", "locals.session", "event.locals", "authenticateRequest",
    "event.context.user", "event.context.session",
    "cookie.get", "useGetCurrentUser", "serverSideFetch",
    "Astro.locals", "context.session", "session.itemId", "permissions.", "getUser",
]
AUTHZ_DECORATORS = ["@UseGuards", "@Roles", "@RequirePermission", "@RequirePermissions", "@Public", "@Auth", "@Authorized", "@RequireAuth", "@JwtAuth", "@ApiKeyAuth"]
AUTHZ_MIDDLEWARE = [
    r"\.use\s*\(\s*.*auth", r"\.use\s*\(\s*.*protect", r"\.use\s*\(\s*.*guard", r"\.use\s*\(\s*requireAuth",
    r"\.use\s*\(\s*authenticate", r"\.use\s*\(\s*passport\.", r"\.use\s*\(\s*jwt\.", r"\.use\s*\(\s*session",
]
AUTHZ_ARGUMENT_PARTS = ["auth", "protect", "guard", "requireauth", "authenticate"]

# Cache operations, tested in the order delete, set, get: (pattern, flags).
CACHE_DELETE = [(r"cache\.del", "i"), (r"cache\.delete", "i"), (r"redis\.del", "i"), (r"invalidateCache", "i"), (r"clearCache", "i"), (r"removeFromCache", "i"), (r"cacheInvalidate", "i"), (r"\.del\s*\(", "")]
CACHE_SET = [(r"cache\.set", "i"), (r"redis\.set", "i"), (r"setCache", "i"), (r"cacheSet", "i"), (r"toCache", "i"), (r"writeCache", "i"), (r"\.setex\s*\(", "i")]
CACHE_GET = [(r"cache\.get", "i"), (r"redis\.get", "i"), (r"getFromCache", "i"), (r"getCached", "i"), (r"fromCache", "i"), (r"\.get\s*\(", ""), (r"cacheGet", "i"), (r"readCache", "i")]
CACHE_AUTH_KEYS = ["member", "membership", "permission", "role", "access", "auth", "user", "session", "token", "apiKey", "api-key", "team", "org", "tenant"]

# Transactions. The first two tables are case-sensitive where noted by the consumer.
TRANSACTION_CALLS = [
    r"\$transaction", r"\.transaction\(", r"beginTransaction", r"startTransaction", r"withTransaction", r"runTransaction",
    r"\.transacting\(", r"db\.tx\(", r"sequelize\.transaction",
]
SIDE_EFFECTS = [
    (r"send\w*Email", "email"), (r"send\w*Mail", "email"), (r"\w+Email\s*\(", "email"), (r"emailService\.", "email"), (r"mailer\.", "email"),
    (r"sendgrid\.send", "email"), (r"resend\.emails?\.", "email"), (r"nodemailer\.", "email"), (r"postmark\.sendEmail", "email"),
    (r"sendWebhook", "webhook"), (r"triggerWebhook", "webhook"), (r"fireWebhook", "webhook"), (r"dispatchWebhook", "webhook"),
    (r"notifyWebhook", "webhook"), (r"webhookService\.send", "webhook"), (r"svix\.", "webhook"),
    (r"\bfetch\s*\(", "external_api"), (r"axios\s*[.(]", "external_api"), (r"httpClient\.", "external_api"), (r"\$\.ajax", "external_api"), (r"\w+Service\s*\(", "external_api"),
    (r"analytics\.track", "analytics"), (r"posthog\.capture", "analytics"), (r"segment\.track", "analytics"), (r"mixpanel\.track", "analytics"), (r"amplitude\.", "analytics"),
    (r"queue\.add", "queue"), (r"\.enqueue\(", "queue"), (r"inngest\.send", "queue"), (r"trigger\.sendEvent", "queue"), (r"bullmq", "queue"),
]
SAFE_CALLS = [
    r"^[a-z_$][\w$.]*\.create\s*\(", r"^[a-z_$][\w$.]*\.update\s*\(", r"^[a-z_$][\w$.]*\.delete\s*\(", r"^[a-z_$][\w$.]*\.upsert\s*\(",
    r"^[a-z_$][\w$.]*\.findMany\s*\(", r"^[a-z_$][\w$.]*\.findUnique\s*\(", r"^[a-z_$][\w$.]*\.findFirst\s*\(", r"^[a-z_$][\w$.]*\.count\s*\(",
    r"^[a-z_$][\w$.]*\.aggregate\s*\(", r"^INSERT\s+INTO", r"^UPDATE\s+\w+\s+SET", r"^DELETE\s+FROM", r"^SELECT\s+",
]
ORM_CALLS = [
    r"^tx\.[a-z]\w*\.", r"^db\.[a-z]\w*\.", r"^prisma\.[a-z]\w*\.", r"^[a-z]\w*\(['\"`]\w+['\"`]\)\.", r"\.createMany\s*\(", r"\.deleteMany\s*\(",
    r"\.updateMany\s*\(", r"\.findFirstOrThrow\s*\(", r"\.findUniqueOrThrow\s*\(", r"\.connect\s*\(", r"\.disconnect\s*\(", r"\.set\s*\(\s*\[",
]
SCOPE_CALL_SKIPS = [
    r"^await$", r"^console\.", r"^JSON\.", r"^Object\.", r"^Array\.", r"^Promise\.", r"^tx\.", r"^db\.", r"\.create$", r"\.update$", r"\.delete$",
    r"\.findFirst$", r"\.findUnique$", r"\.findMany$", r"\.upsert$", r"\.count$",
]

# Membership mutations: (name pattern, mutation type, entity).
MUTATIONS = [
    (r"remove.*member", "remove", "member"), (r"delete.*member", "remove", "member"), (r"kick.*member", "remove", "member"),
    (r"removeFromTeam", "remove", "team"), (r"removeFromOrg", "remove", "team"), (r"leaveTeam", "remove", "team"), (r"leaveOrg", "remove", "team"),
    (r"update.*role", "update", "role"), (r"change.*role", "update", "role"), (r"set.*role", "update", "role"), (r"demote", "downgrade", "role"),
    (r"downgrade.*role", "downgrade", "role"), (r"remove.*role", "remove", "role"), (r"revoke.*role", "revoke", "role"),
    (r"revokePermission", "revoke", "permission"), (r"removePermission", "remove", "permission"), (r"updatePermission", "update", "permission"),
    (r"denyAccess", "revoke", "permission"), (r"revokeAccess", "revoke", "permission"),
    (r"revokeApiKey", "revoke", "apiKey"), (r"deleteApiKey", "remove", "apiKey"), (r"disableApiKey", "revoke", "apiKey"), (r"revokeToken", "revoke", "apiKey"),
    (r"invalidateToken", "revoke", "apiKey"), (r"rotateApiKey", "revoke", "apiKey"), (r"regenerateApiKey", "revoke", "apiKey"), (r"revokeJwt", "revoke", "apiKey"),
    (r"blacklistToken", "revoke", "apiKey"), (r"denylistToken", "revoke", "apiKey"), (r"addToBlocklist", "revoke", "apiKey"), (r"invalidateJwt", "revoke", "apiKey"),
    (r"revokeRefreshToken", "revoke", "apiKey"), (r"invalidateRefreshToken", "revoke", "apiKey"), (r"incrementTokenVersion", "revoke", "apiKey"), (r"bumpTokenVersion", "revoke", "apiKey"),
    (r"invalidateSession", "revoke", "session"), (r"revokeSession", "revoke", "session"), (r"destroySession", "remove", "session"), (r"logout", "revoke", "session"),
    (r"signOut", "revoke", "session"), (r"logoutAll", "revoke", "session"), (r"signOutAll", "revoke", "session"), (r"invalidateAllSessions", "revoke", "session"),
    (r"destroyAllSessions", "remove", "session"), (r"updateMembership", "update", "member"), (r"revokeMembership", "revoke", "member"),
]
INVALIDATIONS = [
    (r"cache\.del", "i"), (r"cache\.delete", "i"), (r"cache\.invalidate", "i"), (r"redis\.del", "i"), (r"invalidateCache", "i"), (r"clearCache", "i"),
    (r"removeFromCache", "i"), (r"cacheInvalidate", "i"), (r"\.del\s*\(", ""), (r"revalidate", "i"), (r"blocklist\.add", "i"), (r"denylist\.add", "i"),
    (r"blacklist\.add", "i"), (r"revokedTokens\.add", "i"), (r"revokedTokens\.set", "i"), (r"tokenBlocklist", "i"), (r"tokenVersion.*\+\+", "i"),
    (r"\.increment.*tokenVersion", "i"), (r"refreshTokenVersion.*\+\+", "i"), (r"sessionStore\.destroy", "i"), (r"sessions\.delete", "i"), (r"lucia\.invalidate", "i"),
]
AUTH_CACHE_KEYS = ["member", "membership", "permission", "role", "access", "auth", r"user:\w+", "session", "token", "apiKey", "team", "org"]
PARAMETER_SIGNALS = ["userId", "teamId", "memberId", "orgId", "roleId", "keyId", "apiKey", "sessionId", "tokenId"]
DATABASE_SIGNALS = [
    (r"\.delete\s*\(", "db:delete"), (r"\.update\s*\(", "db:update"), (r"\.remove\s*\(", "db:remove"), (r"teamMember", "db:teamMember"),
    (r"membership", "db:membership"), (r"apiKey", "db:apiKey"), (r"session", "db:session"), (r"role", "db:role"),
]

# Services. Paths of files that hold no services, with flags; then text patterns.
NON_SERVICE_PATHS = [
    (r"/admin-x-/", "i"), (r"/design-system/", "i"), (r"/components/", "i"), (r"/ui/", "i"), (r"/hooks/", "i"), (r"/stores?/", "i"), (r"\.client\.[tj]sx?$", "i"),
    (r"/client/", "i"), (r"/frontend/", "i"), (r"/utils/api/", "i"), (r"createMutation|createQuery", "i"), (r"use[A-Z][a-zA-Z]*\s*=", ""), (r"\.schema\.[tj]s$", "i"),
    (r"Schema\.[tj]s$", ""), (r"/schemas?/", "i"), (r"\.types?\.[tj]s$", "i"), (r"/types?/", "i"), (r"\.dto\.[tj]s$", "i"), (r"/dtos?/", "i"), (r"/models?/", "i"),
    (r"/repositories?/", "i"), (r"/dao/", "i"), (r"\.model\.[tj]s$", "i"), (r"\.repository\.[tj]s$", "i"), (r"\.entity\.[tj]s$", "i"), (r"/entities?/", "i"),
]
FRONTEND_TEXT = [r"^import.*from\s+['\"]react['\"]", r"^import.*from\s+['\"]@tanstack/react-query['\"]", r"^export\s+const\s+use[A-Z]", r"createMutation\s*[<(]", r"createQuery\s*[<(]"]
SERVICE_SKIP_DIRS = ["services", "service", "lib", "server", "api", "src"]

# Jobs.
JOB_PATHS = [r"/jobs?/", r"/workers?/", r"/tasks?/", r"/queues?/", r"/triggers?/", r"/inngest/", r"\.job\.ts$", r"\.worker\.ts$", r"\.task\.ts$"]
NON_JOB_PATHS = [
    r"\.e2e-spec\.ts$", r"\.spec\.ts$", r"\.test\.ts$", r"/__tests__/", r"/test/", r"vite\.config\.", r"jest\.config\.", r"vitest\.config\.", r"tsconfig", r"eslint",
    r"prettier", r"webpack\.config", r"rollup\.config", r"\.d\.ts$", r"/types/", r"/mocks?/", r"/fixtures?/",
]
JOB_IMPORTS = [(r"@trigger\.dev/sdk|from\s+['\"]@trigger\.dev", "trigger"), (r"from\s+['\"]bullmq['\"]|from\s+['\"]bull['\"]", "bullmq"), (r"from\s+['\"]inngest['\"]|@inngest/", "inngest")]
CUSTOM_JOBS = [(r"defineJob\s*\(", ""), (r"registerJob\s*\(", ""), (r"addJob\s*\(", ""), (r"process\w*Job\s*\(", "i"), (r"handle\w*Job\s*\(", "i"), (r"run\w*Job\s*\(", "i")]
JOB_IDEMPOTENCY = ["idempotency", "idempotent", "dedup", "deduplicate", "alreadyProcessed", "processedJobs", r"jobId.*exists", r"findUnique.*jobId", "upsert"]

# Webhooks.
WEBHOOK_ROUTES = [
    r"/webhooks?/", r"/hooks/", r"/stripe/webhook", r"/github/webhook", r"/slack/events", r"/twilio/webhook", r"/sendgrid/webhook", r"/lemon-?squeezy/webhook",
    r"/paddle/webhook", r"/clerk/webhook", r"/resend/webhook", r"/postmark/webhook", r"/shopify/webhook", r"/square/webhook", r"/paypal/webhook",
    r"/braintree/webhook", r"/plaid/webhook", r"/intercom/webhook", r"/zendesk/webhook",
]
NON_WEBHOOK_PATHS = [
    r"/components/", r"/hooks/", r"/stores?/", r"\.tsx$", r"/routers?/", r"/procedures?/", r"/__tests__/", r"\.test\.[tj]sx?$", r"\.spec\.[tj]sx?$",
    r"/lib/.*(?<!route)\.[tj]s$", r"/test/", r"/tests/", r"/fixtures?/", r"/mocks?/", r"/playwright/", r"/e2e/", r"/di/", r"/modules/", r"/cron/", r"/crons/",
    r"webhook-queue", r"webhook-delivery", r"lib/.*webhook", r"trigger-client", r"/audit/", r"/security/", r"sentry", r"/billing/portal", r"/resend/", r"/ui/",
    r"/admin-x-/", r"/design-system/", r"/src/api/", r"store_subscribe", r"\.client\.[tj]sx?$", r"/client/", r"/frontend/", r"/api/v\d+/webhooks?/(?:\[|route)", r"/service/.*webhook",
]
NON_HANDLER_NAMES = [
    (r"^create.*Webhook", "i"), (r"^delete.*Webhook", "i"), (r"^update.*Webhook", "i"), (r"^get.*Webhook", "i"), (r"^list.*Webhook", "i"), (r"^find.*Webhook", "i"),
    (r"^Webhook[A-Z][a-z]+$", ""), (r"^use.*Webhook", "i"), (r"Skeleton$", "i"), (r"Provider$", "i"), (r"Context$", "i"), (r"^validate.*Webhook", "i"),
    (r"^verify.*Webhook", "i"), (r"^construct.*Event", "i"), (r"Procedure$", "i"), (r"^Webhook[A-Z]\w*$", ""), (r"^on[A-Z]\w+Webhook", "i"), (r"^handle.*Payment", "i"),
    (r"^handle.*Subscription", "i"), (r"^handle.*Checkout", "i"), (r"^handle.*Invoice", "i"), (r"^handle.*Customer", "i"), (r"^process.*Payment", "i"),
    (r"^process.*Subscription", "i"), (r"^process.*Event", "i"), (r"^expect.*Webhook", "i"), (r"^mock.*Webhook", "i"), (r"^assert.*Webhook", "i"),
    (r"^send.*Webhook", "i"), (r"^trigger.*Webhook", "i"), (r"^fire.*Webhook", "i"), (r"^dispatch.*Webhook", "i"), (r"^emit.*Webhook", "i"), (r"^publish.*Webhook", "i"),
    (r"^revalidate.*Webhook", "i"), (r"^refresh.*Webhook", "i"), (r"^subscribe.*Webhook", "i"), (r"^unsubscribe.*Webhook", "i"), (r"^get$", "i"), (r"^set$", "i"),
    (r"^run$", "i"), (r"^execute$", "i"), (r"^call$", "i"), (r"^invoke$", "i"),
]
HANDLER_NAMES = [
    (r"handle.*Webhook", "i"), (r"processWebhook", "i"), (r"onWebhook", "i"), (r"webhookHandler", "i"), (r"handleStripeEvent", "i"), (r"handleGithubEvent", "i"),
    (r"handleSlackEvent", "i"), (r"handleTwilioEvent", "i"), (r"handleClerkEvent", "i"), (r"handleResendEvent", "i"), (r"handlePaddleEvent", "i"),
    (r"handleLemonSqueezyEvent", "i"), (r"handleShopifyEvent", "i"), (r"handlePaypalEvent", "i"), (r"handlePlaidEvent", "i"), (r"constructEvent", "i"),
    (r"verifyWebhookSignature", "i"), (r"^POST$", ""), (r"^GET$", ""),
]
STRONG_HANDLER_NAMES = [(r"^handle", "i"), (r"^on[A-Z]", ""), (r"^POST$", ""), (r"^GET$", "")]
HANDLER_PARAMETERS = ["req", "res", "request", "response", "ctx", "context", "event"]
WEBHOOK_IDEMPOTENCY = [
    r"event\.?id", r"eventId", r"idempotency", r"idempotent", r"processedEvents", r"processedWebhook", r"eventProcessed", r"alreadyProcessed", r"isDuplicate", r"dedup",
    r"duplicate:\s*true", r"if\s*\(\s*processed\s*\)", r"if\s*\(\s*existing", r"if\s*\(\s*already", r"return.*duplicate", r"\?\.\s*processed\s*\)",
    r"\.processed\s*===?\s*true", r"withLock\s*\(", r"acquireLock\s*\(", r"\bLock\s*\(", r"mutex\.",
]
EVENT_STORAGE = [r"insert.*event", r"create.*event", r"save.*event", r"store.*event", r"redis.*set", r"cache.*set"]
EVENT_ID_METHODS = {
    "stripe": [(r"event\.id", "stripe_event_id"), (r"stripeEvent\.id", "stripe_event_id")],
    "github": [(r"x-github-delivery", "github_delivery"), (r"delivery.*id", "github_delivery")],
    "slack": [(r"x-slack-request-timestamp", "header"), (r"event_id", "body_field")],
    "svix": [(r"svix-id", "svix_id"), (r"messageId", "svix_id")],
    "clerk": [(r"svix-id", "svix_id"), (r"webhook\.id", "body_field")],
    "resend": [(r"x-resend-webhook-id", "header"), (r"svix-id", "svix_id")],
    "paddle": [(r"event_id", "body_field"), (r"p-signature", "header")],
    "lemonsqueezy": [(r"x-event-id", "header"), (r"meta\.event_id", "body_field")],
    "twilio": [(r"MessageSid", "body_field"), (r"AccountSid", "body_field"), (r"x-twilio-signature", "header")],
    "sendgrid": [(r"sg_message_id", "body_field"), (r"sg_event_id", "body_field")],
    "postmark": [(r"MessageID", "body_field"), (r"x-postmark-unique-id", "header")],
    "shopify": [(r"x-shopify-webhook-id", "header"), (r"x-shopify-order-id", "header")],
    "paypal": [(r"x-paypal-transmission-id", "header"), (r"event_id", "body_field")],
    "plaid": [(r"webhook_code", "body_field"), (r"item_id", "body_field")],
    "generic": [(r"x-request-id", "header"), (r"idempotency-key", "header"), (r"event\.id", "body_field"), (r"payload\.id", "body_field")],
}
SIGNATURE_METHODS = {
    "stripe": [(r"stripe\.webhooks\.constructEvent", "stripe_construct_event"), (r"constructEvent", "stripe_construct_event")],
    "github": [(r"x-hub-signature-256", "github_signature"), (r"x-hub-signature", "github_signature"), (r"verifyGithub", "github_signature")],
    "slack": [(r"x-slack-signature", "slack_signature"), (r"verifySlack", "slack_signature")],
    "svix": [(r"svix", "svix_verify"), (r"Webhook\(", "svix_verify")],
    "clerk": [(r"svix", "svix_verify"), (r"Webhook\(", "svix_verify")],
    "resend": [(r"svix", "svix_verify"), (r"Webhook\(", "svix_verify")],
    "paddle": [(r"p-signature", "paddle_signature"), (r"verifyPaddle", "paddle_signature")],
    "paypal": [(r"x-paypal-transmission", "paypal_signature"), (r"verifyPaypal", "paypal_signature")],
    "twilio": [(r"x-twilio-signature", "generic_hmac"), (r"validateRequest", "generic_hmac")],
    "sendgrid": [(r"x-twilio-email-event-webhook-signature", "generic_hmac")],
    "postmark": [(r"x-postmark-signature", "generic_hmac")],
    "shopify": [(r"x-shopify-hmac-sha256", "generic_hmac")],
    "plaid": [(r"plaid-verification", "generic_hmac")],
    "lemonsqueezy": [(r"x-signature", "generic_hmac")],
    "generic": [(r"crypto\.createHmac", "generic_hmac"), (r"createHmac", "generic_hmac"), (r"timingSafeEqual", "generic_hmac"), (r"verifySignature", "generic_hmac")],
}
PERSIST_DATABASE = [r"prisma.*create.*processed", r"insert.*processed.*event", r"create.*webhook.*event", r"\.create\s*\(\s*\{[^}]*eventId", r"processedEvents\.create", r"processedWebhookEvent\.create", r"db\..*\.create"]
PERSIST_CACHE = [r"redis\.set", r"redis\.get", r"cache\.set", r"cache\.get", r"setex", r"\.set\s*\([^,]+,.*event"]
PERSIST_WRAPPERS = [
    r"tryProcess.*Webhook", r"checkAndMark.*Processed", r"markAs.*Processed", r"isWebhookProcessed", r"processWebhookIdempotent", r"withIdempotency", r"ensureIdempotent",
    r"deduplicateWebhook", r"withLock\s*\(", r"acquireLock\s*\(", r"runWithLock", r"lockAndProcess",
]
WEBHOOK_MANAGEMENT = [
    r"createWebhook\s*[=:]", r"updateWebhook\s*[=:]", r"deleteWebhook\s*[=:]", r"listWebhooks?\s*[=:]", r"getWebhook\s*[=:]", r"findWebhook", r"prisma\.webhook\.", r"db\.webhook\.",
    r"webhook\.create\(", r"webhook\.update\(", r"webhook\.delete\(", r"webhook\.findMany", r"webhook\.findUnique", r"subscribeWebhook", r"unsubscribeWebhook", r"registerWebhook", r"deregisterWebhook",
]
WEBHOOK_RECEIVERS = [
    r"stripe\.webhooks\.constructEvent", r"verifyWebhookSignature", r"x-hub-signature", r"x-slack-signature", r"svix-id", r"p-signature", r"handleStripeEvent",
    r"handleWebhookEvent", r"webhookHandler\s*=", r"processWebhookPayload",
]
#: Provider, words of which one is present, words that must be absent.
PROVIDERS = [
    ("stripe", ["stripe", "constructevent"], []), ("paddle", ["paddle", "p-signature"], []), ("lemonsqueezy", ["lemonsqueezy", "lemon-squeezy", "lemon_squeezy"], []),
    ("paypal", ["paypal", "x-paypal-transmission"], []), ("clerk", ["clerk"], ["postmark"]), ("resend", ["resend"], ["sendgrid"]), ("sendgrid", ["sendgrid", "sg_event_id"], []),
    ("postmark", ["postmark", "x-postmark"], []), ("twilio", ["twilio", "messagesid", "x-twilio-signature"], []), ("slack", ["slack", "x-slack-signature"], []),
    ("github", ["github", "x-hub-signature", "x-github-delivery"], []), ("shopify", ["shopify", "x-shopify-webhook"], []), ("plaid", ["plaid"], []), ("svix", ["svix", "svix-id"], []),
]

# Data flow. Case-sensitive unless flagged.
SOURCES = [
    (r"req(?:uest)?\.body\b", "request_body"), (r"request\.json\(\)", "request_body"), (r"req(?:uest)?\.params\b", "request_params"), (r"params\.[a-zA-Z]+", "request_params"),
    (r"req(?:uest)?\.query\b", "request_query"), (r"searchParams\.get\(|useSearchParams\(\)", "request_query"), (r"req(?:uest)?\.headers\b|request\.headers\.get\(", "request_headers"),
    (r"req(?:uest)?\.cookies\b|cookies\(\)\.get\(", "request_cookies"), (r"formData\.get\(|new FormData\(", "form_data"), (r"\{ params \}|context\.params", "url_param"), (r"userInput|input\s*[=:]", "user_input"),
]
UNTRUSTED = ["request_body", "request_params", "request_query", "request_headers", "request_cookies", "form_data", "url_param", "user_input"]
SINKS = [
    (r"\.findMany\(", "", "database_query", "Prisma findMany query"), (r"\.findFirst\(", "", "database_query", "Prisma findFirst query"), (r"\.findUnique\(", "", "database_query", "Prisma findUnique query"),
    (r"\.create\(", "", "database_write", "Prisma create"), (r"\.update\(", "", "database_write", "Prisma update"), (r"\.delete\(", "", "database_write", "Prisma delete"), (r"\.upsert\(", "", "database_write", "Prisma upsert"),
    (r"\$(?:query|execute)Raw(?:Unsafe)?", "", "sql_query", "Prisma raw query"), (r"(?:knex|sql)\.raw\s*\(", "", "sql_query", "raw SQL query"), (r"sequelize\.query\s*\(", "", "sql_query", "Sequelize raw query"),
    (r"(?:\.createQueryRunner|queryRunner\.query)\s*\(", "", "sql_query", "TypeORM query"), (r"\.query\s*\(\s*['\"`](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)", "i", "sql_query", "Direct SQL query"),
    (r"\.raw\s*\(", "", "sql_query", "raw query"), (r"sql`[^`]*\$\{", "", "sql_query", "SQL template interpolation"),
    (r"\.find\s*\(\s*\{", "", "nosql_query", "MongoDB find"), (r"\.aggregate\s*\(", "", "nosql_query", "MongoDB aggregate"),
    (r"(?:fs\.)?readFile\w*\s*\(", "", "file_read", "File read"), (r"(?:fs\.)?writeFile\w*\s*\(", "", "file_write", "File write"),
    (r"child_process\.(?:exec|spawn|fork)\w*\s*\(", "", "command_exec", "child_process"), (r"\bexec(?:Async|Sync|File)?\s*\(", "", "command_exec", "exec"), (r"\bspawn(?:Sync)?\s*\(\s*['\"`]", "", "command_exec", "spawn"),
    (r"\b(?:cp|proc)\.(?:exec|spawn)\s*\(", "", "command_exec", "cp/proc exec"), (r"\bexeca(?:\.sync)?\s*\(", "", "command_exec", "execa"), (r"\bshell(?:js)?\.exec\s*\(", "", "command_exec", "shelljs"),
    (r"eval\s*\(", "", "eval", "eval()"), (r"new Function\(", "", "eval", "new Function()"),
    (r"res\.redirect\(", "", "redirect", "HTTP redirect"), (r"redirect\(", "", "redirect", "Redirect"), (r"NextResponse\.redirect\(", "", "redirect", "Next.js redirect"),
    (r"res\.send\(", "", "html_response", "HTTP response"), (r"dangerouslySetInnerHTML", "", "html_response", "React dangerouslySetInnerHTML"),
    (r"res\.setHeader\s*\(", "", "header_set", "res.setHeader"), (r"res\.set\s*\(", "", "header_set", "res.set header"), (r"response\.headers\.set\s*\(", "", "header_set", "response.headers.set"),
    (r"res\.cookie\s*\(", "", "cookie_set", "res.cookie"), (r"response\.cookie\s*\(", "", "cookie_set", "response.cookie"), (r"cookies\.set\s*\(", "", "cookie_set", "cookies.set"),
    (r"jwt\.sign\s*\(", "", "eval", "jwt.sign"), (r"jwt\.verify\s*\(", "", "eval", "jwt.verify"), (r"jwt\.decode\s*\(", "", "eval", "jwt.decode"),
    (r"create(?:Cipher|Decipher)iv\s*\(", "", "command_exec", "crypto.createCipheriv"), (r"create(?:Hash|Hmac)\s*\(", "", "command_exec", "crypto.createHash"),
    (r"\.innerHTML\s*=", "", "dom_sink", "innerHTML assignment"), (r"document\.write\s*\(", "", "dom_sink", "document.write"), (r"insertAdjacentHTML\s*\(", "", "dom_sink", "insertAdjacentHTML"),
]
TRANSFORMS = [
    (r"\.(?:safe)?[Pp]arse\s*\(", "", "validate", "Schema parse"), (r"\.validate\s*\(", "", "validate", "Validation"), (r"(?:joi|yup|zod)\.", "i", "validate", "Schema validation"),
    (r"sanitize|DOMPurify|xss\(|escape|clean", "i", "sanitize", "Sanitization"), (r"encodeURI(?:Component)?|htmlEncode", "i", "encode", "Encoding"),
    (r"JSON\.parse|parseInt|parseFloat|Number\(", "", "parse", "Parse"), (r"\.(?:slice|substring|substr|take|limit)\s*\(", "", "slice", "Bounds"), (r"\.filter\s*\(", "", "filter", "Filter"),
]
ADMIN_PATHS = [r"/admin/", r"/dashboard/", r"/internal/", r"/backoffice/", r"admin\.ts$", r"admin-.*\.ts$"]
ADMIN_FUNCTIONS = [(r"^admin", "i"), (r"Admin$", ""), (r"^internal", "i"), (r"^superuser", "i")]

# Tenant columns: (pattern, kind).
TENANT_COLUMNS = [
    ("organizationId", "organization"), ("organisation_?id", "organization"), ("org_?id", "organization"), ("tenantId", "tenant"), ("tenant_?id", "tenant"),
    ("teamId", "team"), ("team_?id", "team"), ("workspaceId", "workspace"), ("workspace_?id", "workspace"), ("accountId", "account"), ("account_?id", "account"),
    ("companyId", "company"), ("company_?id", "company"), ("userId", "user"), ("user_?id", "user"), ("ownerId", "user"), ("owner_?id", "user"), ("createdById", "user"), ("authorId", "user"),
]

# Test and generated files.
TEST_PATHS = [(r"(^|/)__tests__(/|$)", ""), (r"(^|/)tests?(/|$)", ""), (r"(^|/)specs?(/|$)", ""), (r"(^|/)e2e(/|$)", ""), (r"\.(spec|test|e2e)\.[tj]sx?$", "i")]
TEST_IMPORTS = [r"^@jest/", r"^@playwright/test$", r"^@testing-library/", r"^@cypress/", r"^@mswjs/", r"^vitest$", r"^jest$", r"^mocha$", r"^chai$", r"^sinon$", r"^cypress$", r"^supertest$", r"^nock$", r"^msw$", r"^node:test$", r"^bun:test$", r"^tap$", r"^ava$", r"^uvu$"]
TEST_CALL = r"\b(describe|it|test|suite|context)\s*(?:\.(only|skip|todo|each))?\s*\("
TEST_HOOK = r"\b(beforeEach|afterEach|beforeAll|afterAll)\s*\("
TEST_ASSERT = r"\b(expect|assert)\s*\("
TEST_CYPRESS = r"\bcy\."
GENERATED_PATHS = [r"(^|/)__generated__(/|$)", r"(^|/)generated(/|$)", r"\.generated\.[tj]sx?$", r"(^|/)generated[^/]*\.[tj]sx?$"]
GENERATED_HEADERS = [r"@generated", r"auto-?generated", r"generated by", r"this file (?:was|is) generated", r"do not edit"]

# Framework signals.
DEPENDENCY_SIGNALS = {
    "next": "nextjs", "@nestjs/core": "nestjs", "@nestjs/common": "nestjs", "express": "express", "fastify": "fastify", "hono": "hono", "@trpc/server": "trpc", "koa": "koa",
    "koa-router": "koa", "@koa/router": "koa", "@hapi/hapi": "hapi", "hapi": "hapi", "@remix-run/node": "remix", "@remix-run/react": "remix", "@remix-run/serve": "remix",
    "@remix-run/dev": "remix", "@sveltejs/kit": "sveltekit", "nuxt": "nuxt", "astro": "astro", "@builder.io/qwik": "qwik", "@builder.io/qwik-city": "qwik", "solid-start": "solid-start",
    "@solidjs/start": "solid-start", "@keystone-6/core": "keystone", "@keystonejs/core": "keystone", "@keystone-next/core": "keystone", "@keystatic/core": "keystatic",
    "@prisma/client": "prisma", "prisma": "prisma", "drizzle-orm": "drizzle", "typeorm": "typeorm", "sequelize": "sequelize", "mongoose": "mongoose", "@supabase/supabase-js": "supabase",
}
CONFIG_SIGNALS = {
    "nextjs": ["next.config.js", "next.config.mjs", "next.config.ts"], "nestjs": ["nest-cli.json"], "sveltekit": ["svelte.config.js", "svelte.config.mjs", "svelte.config.ts"],
    "nuxt": ["nuxt.config.js", "nuxt.config.mjs", "nuxt.config.ts"], "astro": ["astro.config.js", "astro.config.mjs", "astro.config.ts"],
    "remix": ["remix.config.js", "remix.config.mjs", "remix.config.ts"], "qwik": ["qwik.config.ts", "qwik.config.js"], "solid-start": ["app.config.ts", "app.config.js"],
    "keystone": ["keystone.ts", "keystone.js"], "keystatic": ["keystatic.config.ts", "keystatic.config.tsx", "keystatic.config.js"], "prisma": ["prisma/schema.prisma"],
}
DEPENDENCY_CONFIDENCE, CONFIG_CONFIDENCE = 0.6, 0.8
FRAMEWORK_EXCLUDES = {
    "nextjs": ["**/.next/**", "**/.vercel/**", "**/out/**"], "nuxt": ["**/.nuxt/**", "**/.output/**"], "sveltekit": ["**/.svelte-kit/**"], "astro": ["**/.astro/**"],
    "remix": ["**/.cache/**", "**/build/**", "**/public/build/**"], "nestjs": ["**/dist/**"], "qwik": ["**/.qwik/**", "**/dist/**", "**/server/**/@qwik*/**"],
    "solid-start": ["**/.solid/**", "**/.vinxi/**", "**/dist/**"], "keystone": ["**/.keystone/**"], "keystatic": ["**/.keystatic/**"], "prisma": ["**/prisma/generated/**", "**/.prisma/**", "**/prisma/client/**"],
}

# Correlation rules in order: (rule pair, multiplier, description, signals, attack path title, exploitability, impact, time window).
COMPOUNDING = [
    (("WEBHOOK.IDEMPOTENT", "TRANSACTION.POST_COMMIT.SIDE_EFFECTS"), 2.0, "Webhook replay can cause duplicate side effects AND inconsistent database state", ["webhook_replay", "transaction_side_effect", "data_inconsistency"], "Webhook Replay Attack with Data Inconsistency", "easy", "high", "Immediate - no time limit on replay"),
    (("AUTHZ.SERVICE_LAYER.ENFORCED", "AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE"), 2.5, "Missing service-layer auth combined with delayed revocation allows extended unauthorized access", ["auth_bypass", "delayed_revocation", "privilege_persistence"], "Extended Privilege Persistence", "medium", "critical", "Until cache expires or session timeout"),
    (("CACHE.INVALIDATION.ON_AUTH_CHANGE", "AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE"), 2.0, "Membership change without cache invalidation allows continued access via stale cache", ["stale_cache", "permission_leak", "revocation_bypass"], "Stale Permission Cache Exploit", "medium", "high", "Cache TTL (often 5-15 minutes)"),
    (("TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "CACHE.INVALIDATION.ON_AUTH_CHANGE"), 1.5, "Side effect in transaction + missing cache invalidation can leave cache inconsistent after rollback", ["rollback_inconsistency", "cache_stale", "side_effect_mismatch"], None, None, None, None),
    (("BILLING.SERVER_ENFORCED", "AUTHZ.SERVICE_LAYER.ENFORCED"), 2.0, "Missing billing enforcement + auth gap allows access to paid features without payment", ["billing_bypass", "feature_theft", "revenue_loss"], "Billing Bypass via Auth Gap", "medium", "high", None),
    (("JOBS.RETRY_SAFE", "TRANSACTION.POST_COMMIT.SIDE_EFFECTS"), 1.8, "Non-idempotent job with side effects in transaction can cause duplicates on retry", ["job_retry", "duplicate_side_effect", "data_duplication"], None, None, None, None),
    (("AUTHZ.KEYS.REVOCATION.IMMEDIATE", "CACHE.INVALIDATION.ON_AUTH_CHANGE"), 2.0, "API key revocation without cache invalidation allows continued API access", ["key_still_valid", "cache_bypass", "api_access_leak"], "API Key Revocation Bypass", "easy", "high", "Until cache expires"),
]
ATTACK_STEPS = {
    "WEBHOOK.IDEMPOTENT": "Attacker replays webhook request (no idempotency protection)",
    "TRANSACTION.POST_COMMIT.SIDE_EFFECTS": "Side effect fires inside transaction (may be duplicated or inconsistent)",
    "AUTHZ.SERVICE_LAYER.ENFORCED": "Service function called without authorization check",
    "AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE": "Membership/role change does not immediately revoke access",
    "AUTHZ.KEYS.REVOCATION.IMMEDIATE": "API key revocation does not immediately invalidate the key",
    "CACHE.INVALIDATION.ON_AUTH_CHANGE": "Auth change does not invalidate cached permissions",
    "BILLING.SERVER_ENFORCED": "Billing/entitlement check bypassed or missing",
    "JOBS.RETRY_SAFE": "Background job is not idempotent (retry causes duplicates)",
}
SEVERITY_NUMBER = {"P0": 3, "P1": 2, "P2": 1}
SARIF_LEVEL = {"P0": ("error", "9.0"), "P1": ("warning", "7.0"), "P2": ("note", "4.0")}
WAIVER_REASONS = ["false_positive", "acceptable_risk", "will_fix_later", "not_applicable", "other"]
