"""The rule catalogue: identifier, severity and category of every definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defined but not active.
INACTIVE = ("ANALYTICS.SCHEMA.STABLE",)

# Identifier, severity, category.
RULES = [
    ("AUTHZ.SERVICE_LAYER.ENFORCED", "P0", "authz"),
    ("AUTHZ.MEMBERSHIP.REVOCATION.IMMEDIATE", "P0", "revocation"),
    ("AUTHZ.KEYS.REVOCATION.IMMEDIATE", "P0", "revocation"),
    ("WEBHOOK.IDEMPOTENT", "P0", "webhooks"),
    ("WEBHOOK.SIGNATURE.VERIFIED", "P0", "webhooks"),
    ("TRANSACTION.POST_COMMIT.SIDE_EFFECTS", "P0", "transactions"),
    ("AUTHZ.RLS.MULTI_TENANT", "P0", "rls"),
    ("AUTHZ.TENANT.ISOLATION", "P0", "rls"),
    ("DATAFLOW.UNTRUSTED.SQL_QUERY", "P0", "dataflow"),
    ("DATAFLOW.UNTRUSTED.COMMAND_EXEC", "P0", "dataflow"),
    ("CACHE.INVALIDATION.ON_AUTH_CHANGE", "P1", "cache"),
    ("JOBS.RETRY_SAFE", "P1", "jobs"),
    ("BILLING.SERVER_ENFORCED", "P1", "billing"),
    ("ANALYTICS.SCHEMA.STABLE", "P2", "analytics"),
    ("TESTS.NO_FALSE_CONFIDENCE", "P1", "tests"),
    ("DATAFLOW.UNTRUSTED.FILE_ACCESS", "P1", "dataflow"),
    ("DATAFLOW.UNTRUSTED.RESPONSE", "P1", "dataflow"),
    ("CORS.WILDCARD.ORIGIN", "P1", "config"),
    ("CORS.CREDENTIALS.WILDCARD", "P0", "config"),
    ("CRYPTO.WEAK.ALGORITHM", "P1", "crypto"),
    ("CRYPTO.INSECURE.RANDOM", "P1", "crypto"),
    ("LOGGING.SENSITIVE.DATA", "P1", "dataflow"),
    ("JWT.NO.EXPIRY", "P1", "auth"),
    ("JWT.WEAK.VERIFICATION", "P0", "auth"),
    ("GRAPHQL.INTROSPECTION.ENABLED", "P2", "config"),
    ("GRAPHQL.NO.DEPTH_LIMIT", "P1", "config"),
    ("RATE_LIMIT.MISSING", "P1", "config"),
    ("DEBUG.ENDPOINTS.EXPOSED", "P1", "config"),
    ("XSS.DOM.SINK", "P0", "dataflow"),
    ("XSS.TEMPLATE.INJECTION", "P1", "dataflow"),
    ("NOSQL.INJECTION", "P0", "dataflow"),
    ("HEADER.INJECTION", "P1", "dataflow"),
    ("REDIRECT.OPEN", "P1", "dataflow"),
    ("DESERIALIZATION.UNSAFE", "P0", "dataflow"),
    ("PROTOTYPE.POLLUTION", "P0", "dataflow"),
    ("EVAL.USER_INPUT", "P0", "dataflow"),
    ("REGEX.DOS", "P1", "dataflow"),
    ("SESSION.COOKIE.NO_HTTPONLY", "P1", "session"),
    ("SESSION.COOKIE.NO_SECURE", "P1", "session"),
    ("SESSION.COOKIE.NO_SAMESITE", "P1", "session"),
    ("SESSION.FIXATION", "P1", "session"),
    ("LDAP.INJECTION", "P0", "dataflow"),
    ("XML.INJECTION", "P0", "dataflow"),
    ("XXE.EXTERNAL_ENTITY", "P0", "dataflow"),
    ("SSTI.INJECTION", "P0", "dataflow"),
    ("LOG.INJECTION", "P1", "dataflow"),
    ("EMAIL.HEADER_INJECTION", "P1", "dataflow"),
    ("PDF.INJECTION", "P1", "dataflow"),
    ("CSV.INJECTION", "P1", "dataflow"),
    ("GRAPHQL.QUERY_INJECTION", "P0", "dataflow"),
    ("ORM.RAW_QUERY", "P0", "dataflow"),
    ("SHELL.EXPANSION", "P0", "dataflow"),
    ("SSRF.URL", "P0", "dataflow"),
    ("IDOR.SEQUENTIAL_ID", "P0", "authz"),
    ("IDOR.UUID_NO_AUTH", "P0", "authz"),
    ("AUTHZ.ROLE_ESCALATION_SELF", "P0", "authz"),
    ("AUTHZ.ADMIN_NO_ROLE_CHECK", "P0", "authz"),
    ("AUTHZ.MIDDLEWARE_ORDER_BYPASS", "P0", "authz"),
    ("AUTHZ.OPTIONAL_AUTH_DATA_LEAK", "P1", "authz"),
    ("GRAPHQL.FIELD_NO_AUTH", "P0", "authz"),
    ("TRPC.PUBLIC_MUTATION", "P0", "authz"),
    ("NEXTJS.API_UNPROTECTED", "P0", "authz"),
    ("EXPRESS.ROUTE_NO_AUTH", "P0", "authz"),
    ("AUTHZ.PERMISSION_CACHED_TTL", "P1", "authz"),
    ("AUTHZ.OWNERSHIP_NOT_VERIFIED", "P0", "authz"),
    ("DATA.SOFT_DELETE_BYPASS", "P1", "authz"),
    ("PAYMENT.NO_IDEMPOTENCY", "P0", "business-logic"),
    ("PAYMENT.CLIENT_AMOUNT", "P0", "business-logic"),
    ("RACE.BALANCE_CHECK", "P0", "business-logic"),
    ("RACE.INVENTORY_CHECK", "P0", "business-logic"),
    ("STATE.TRANSITION_SKIP", "P1", "business-logic"),
    ("FEATURE.FLAG_CLIENT_CONTROLLED", "P1", "business-logic"),
    ("BILLING.TRIAL_BYPASS", "P1", "business-logic"),
    ("RATE_LIMIT.PER_ENDPOINT", "P1", "business-logic"),
    ("AUTH.EMAIL_VERIFICATION_SKIP", "P1", "business-logic"),
    ("AUTH.MFA_BYPASS", "P0", "business-logic"),
    ("AUTH.INVITE_TOKEN_REUSE", "P1", "business-logic"),
    ("AUTH.PASSWORD_RESET_NO_EXPIRE", "P1", "business-logic"),
    ("NEXTJS.SSR_SECRET_LEAK", "P0", "dataflow"),
    ("NEXTJS.MIDDLEWARE_BYPASS", "P0", "authz"),
    ("NEXTJS.ISR_REVALIDATE_AUTH", "P0", "cache"),
    ("REACT.DANGEROUSLY_SET_USER_DATA", "P0", "dataflow"),
    ("PRISMA.RAW_INTERPOLATION", "P0", "dataflow"),
    ("PRISMA.SELECT_ALL_EXPOSURE", "P1", "dataflow"),
    ("TRPC.ERROR_LEAK", "P1", "config"),
    ("EXPRESS.TRUST_PROXY", "P1", "config"),
    ("EXPRESS.STATIC_DOTFILES", "P1", "config"),
    ("SOCKETIO.NO_AUTH", "P0", "authz"),
    ("GRAPHQL.BATCHING_DOS", "P1", "config"),
    ("APOLLO.PERSISTED_BYPASS", "P1", "config"),
    ("REMIX.LOADER_NO_AUTH", "P0", "authz"),
    ("CRYPTO.ECB_MODE", "P0", "crypto"),
    ("CRYPTO.STATIC_IV", "P0", "crypto"),
    ("CRYPTO.WEAK_KEY", "P0", "crypto"),
    ("CRYPTO.TIMING_ATTACK", "P1", "crypto"),
    ("JWT.NONE_ALGORITHM", "P0", "auth"),
    ("JWT.WEAK_SECRET", "P0", "auth"),
    ("AUTH.PASSWORD_PLAINTEXT", "P0", "auth"),
    ("AUTH.PASSWORD_WEAK_HASH", "P0", "auth"),
    ("ERROR.SECRET_LEAK", "P1", "dataflow"),
    ("CRYPTO.KEY_DERIVATION_WEAK", "P1", "crypto"),
]


def catalogue(spark: SparkSession, severity: str | None = None, category: str | None = None, active: bool = True) -> DataFrame:
    """Rules by severity and category: id, severity, category, name, description, required_proof.

    Names are derived from the identifiers; descriptions are left to the caller's own table.
    """
    rows = [(i, s, c, i.replace(".", " ").replace("_", " ").capitalize(), None, None) for i, s, c in RULES if not (active and i in INACTIVE)]
    df = spark.createDataFrame(rows, "id string, severity string, category string, name string, description string, required_proof string")
    for col, v in (("severity", severity), ("category", category)):
        df = df.filter(F.col(col) == v) if v else df
    return df


def known(invariant: Column) -> Column:
    return invariant.isin([r[0] for r in RULES])


def explain(spark: SparkSession, identifier: str, texts: dict[str, str] | None = None, width: int = 76) -> list[str]:
    """Lines that explain a rule, wrapped by words."""
    import textwrap

    hit = next((r for r in RULES if r[0] == identifier.upper()), None)
    if hit is None:
        raise KeyError(identifier)
    said = (texts or {}).get(hit[0], "No description.")
    return [f"{hit[0]} ({hit[1]}, {hit[2]})", *textwrap.wrap(said, width)]
