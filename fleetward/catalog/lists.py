"""Word lists and lookup tables.

Fixed values: these must equal the audited behaviour for results to be right.
"""

CATEGORIES = (
    "secrets", "database", "auth", "injection", "api_webhooks",
    "web_config", "dependencies", "ai_specific", "platform", "business_logic",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
MODES = ("blackbox", "whitebox")
SOURCES = ("native", "semgrep", "gitleaks", "osv-scanner")
GRADES = ("A", "B", "C", "D", "F")

# Severity weight and confidence multiplier; the product is taken in hundredths.
SEVERITY_WEIGHT = {"critical": 35, "high": 15, "medium": 6, "low": 2, "info": 0}
CONFIDENCE_PERCENT = {"high": 100, "medium": 50, "low": 15}
GRADE_FLOORS = (("A", 90), ("B", 75), ("C", 60), ("D", 40))

MAX_FILE_BYTES = 2_000_000

# Directories skipped wherever they occur in a path, and skipped file names.
IGNORED_DIRS = (
    "node_modules", ".next", "dist", "build", "coverage", ".git",
    "out", ".output", ".vercel", ".netlify", ".turbo", ".svelte-kit", ".nuxt",
    "venv", ".venv", "__pycache__", "vendor", ".tox", ".mypy_cache", ".pytest_cache", ".gradle",
    "test-fixtures", "fixtures", "__tests__", "__mocks__", ".storybook", "cypress", "e2e",
)
IGNORED_SUFFIXES = (".min.js", ".min.css", ".bundle.js")
IGNORED_INFIXES = (".test.", ".spec.", ".stories.")
LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb")

PROBED_TABLES = (
    "users", "profiles", "accounts", "customers",
    "orders", "payments", "subscriptions", "invoices",
    "billing", "messages", "api_keys", "secrets",
)
PROBED_DOTFILES = ("/.env", "/.env.local", "/.env.production", "/.git/config")

# header, label, severity when missing, pass title
REQUIRED_HEADERS = (
    ("content-security-policy", "Content-Security-Policy", "medium", "Content-Security-Policy is set"),
    ("strict-transport-security", "Strict-Transport-Security (HSTS)", "medium", "HTTPS is enforced (HSTS)"),
    ("x-frame-options", "X-Frame-Options", "medium", "Clickjacking protection is on (X-Frame-Options)"),
    ("x-content-type-options", "X-Content-Type-Options", "low", "MIME-sniffing protection is on"),
    ("referrer-policy", "Referrer-Policy", "low", "Referrer-Policy is set"),
    ("permissions-policy", "Permissions-Policy", "low", "Permissions-Policy is set"),
)

# Half-open ranges [min, fixed) of the middleware bypass, and the advisory floor.
MIDDLEWARE_RANGES = (("15.0.0", "15.2.3"), ("14.0.0", "14.2.25"), ("13.0.0", "13.5.9"))
MIDDLEWARE_PACKAGE = "next"
ADVISORY_FLOOR = (
    (
        "next", "CVE-2024-34351", "high", "13.0.0", "14.1.1",
        "SSRF in the Next.js image optimizer via crafted host header / remotePatterns.",
    ),
)

# pass id, category, title, detail, dependency names (a trailing * is a prefix)
PRACTICE_SIGNALS = (
    (
        "PASS_RATE_LIMITING", "api_webhooks", "Rate limiting is in place",
        "A rate-limiting library is set up, which helps block brute-force and abuse.",
        ("express-rate-limit", "rate-limiter-flexible", "@upstash/ratelimit", "@fastify/rate-limit",
         "@nestjs/throttler", "hono-rate-limiter", "next-rate-limit"),
    ),
    (
        "PASS_INPUT_VALIDATION", "injection", "Input validation is in use",
        "A schema-validation library is present to check untrusted input before you use it.",
        ("zod", "yup", "joi", "@hapi/joi", "valibot", "class-validator", "superstruct", "ajv"),
    ),
    (
        "PASS_ORM_PARAMETERIZED", "injection", "Database queries use an ORM / query builder",
        "Queries go through a library that parameterizes inputs, which guards against SQL injection.",
        ("@prisma/client", "prisma", "drizzle-orm", "typeorm", "sequelize", "kysely", "knex", "mongoose"),
    ),
    (
        "PASS_AUTH_LIBRARY", "auth", "Authentication uses a vetted library",
        "Sign-in is handled by an established auth library rather than hand-rolled.",
        ("next-auth", "@auth/*", "@clerk/*", "lucia", "@auth0/*", "passport", "@workos-inc/*"),
    ),
    (
        "PASS_SECURITY_HEADERS_CONFIG", "web_config", "Security headers are configured",
        "Your app sets security response headers in code (Helmet or a headers() config).",
        ("helmet",),
    ),
)

# category, title, detail of the "nothing found" passes
CLEAN_COVERAGE = (
    ("injection", "No injection vulnerabilities found",
     "We checked for SQL injection, XSS, command injection and SSRF and found none."),
    ("auth", "No authentication weaknesses found",
     "We checked your auth and access-control code and found no obvious gaps."),
    ("api_webhooks", "No API or webhook security issues found",
     "We checked your API routes and webhooks and found no obvious problems."),
    ("business_logic", "No business-logic issues found",
     "We checked for risky patterns like unrestricted uploads and found none."),
    ("dependencies", "No known-vulnerable dependencies",
     "We checked your dependencies against known advisories and none were flagged."),
)
PASS_SOURCEMAPS = (
    "PASS_WEB_CONFIG_NO_SOURCEMAPS", "web_config", "Source maps are not exposed",
    "Your production JavaScript does not serve .map files, so your original source stays private.",
)
PASS_RLS_PROBE = (
    "PASS_DATABASE_RLS_PROTECTING", "database", "Row-Level Security is protecting your database",
    "Using your public key, we could not read rows from common sensitive tables — RLS is blocking anonymous access.",
)
# Wording of this pass is inferred.
PASS_NO_SECRETS = (
    "PASS_SECRETS_NONE_EXPOSED", "secrets", "No exposed secrets found",
    "We checked your code for hardcoded credentials and found none.",
)

# Prefix of the impact text by path class.
CONTEXT_NOTES = {
    "docs": "Found in a documentation file — likely a teaching example, not live code. Verify it is not a real value before acting. ",
    "example": "Found in an example/sample file — likely a template, not live code. Verify it is not a real value before acting. ",
    "test": "Found in a test/fixture file — likely intentional test data, not live code. Verify before acting. ",
    "content": "Found in a content/marketing file — likely a sample in copy, not an executed code path. Verify before acting. ",
    "build": "Found in generated build output / vendored code, not your source. Fix it in the source file (and rotate if it is a real secret). ",
}
CONTENT_DOWNGRADED = ("injection", "api_webhooks", "business_logic", "platform")

# id, category, mode of every rule, in registry order
RULES = (
    ("SECRETS_HARDCODED", "secrets", "both"),
    ("SECRETS_COMMITTED_ENV", "secrets", "whitebox"),
    ("DATABASE_SUPABASE_RLS", "database", "whitebox"),
    ("DATABASE_FIREBASE_RULES_OPEN", "database", "whitebox"),
    ("DATABASE_SUPABASE_RLS_OPEN_LIVE", "database", "blackbox"),
    ("AUTH_NEXTJS_MIDDLEWARE_BYPASS", "auth", "whitebox"),
    ("AUTH_MISSING_CHECK", "auth", "whitebox"),
    ("INJECTION_SQL", "injection", "whitebox"),
    ("INJECTION_COMMAND", "injection", "whitebox"),
    ("INJECTION_XSS", "injection", "whitebox"),
    ("INJECTION_SSRF", "injection", "whitebox"),
    ("API_WEBHOOK_UNVERIFIED", "api_webhooks", "whitebox"),
    ("API_WEBHOOK_NO_IDEMPOTENCY", "api_webhooks", "whitebox"),
    ("API_MASS_ASSIGNMENT", "api_webhooks", "whitebox"),
    ("WEB_CONFIG_NEXTCONFIG", "web_config", "whitebox"),
    ("WEB_CONFIG_HEADERS_LIVE", "web_config", "blackbox"),
    ("WEB_CONFIG_EXPOSED_FILE", "web_config", "blackbox"),
    ("WEB_CONFIG_EXPOSED_SOURCEMAP", "web_config", "blackbox"),
    ("DEPENDENCIES_KNOWN_CVE", "dependencies", "whitebox"),
    ("AI_RISKY_RULES_FILE", "ai_specific", "whitebox"),
    ("AI_INSECURE_DEFAULTS", "ai_specific", "whitebox"),
    ("PLATFORM_PUBLIC_SECRET_VAR", "platform", "whitebox"),
    ("BUSINESS_INSECURE_UPLOAD", "business_logic", "whitebox"),
    ("POSITIVE_GOOD_PRACTICES", "web_config", "whitebox"),
)
