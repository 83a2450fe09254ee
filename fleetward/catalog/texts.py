"""Report texts and constants per finding variant.

Fixed values: rule ids, severities, weakness ids and wording must equal the audited
behaviour for reports to match, so they are stated as plain text.  ``<<0>>`` ...
stand for a finding's parameters, ``<<file>>`` and ``<<url>>`` for its location.
Wording of the variants marked (inferred) has no published definition.
"""

from __future__ import annotations

from typing import NamedTuple


class Variant(NamedTuple):
    rule_id: str | None  # None: the id is computed per finding
    category: str
    severity: str | None
    confidence: str | None
    cwe: str | None
    owasp: str | None
    mode: str
    title: str
    why: str
    fix: str | None
    fix_prompt: str | None


_RLS_NOTE = (
    " This applies if the tables are reachable through Supabase’s API (PostgREST) with your public anon key; "
    "it is not a risk if the database is only reached from your backend."
)
_SQL_FIX = (
    "Use parameterized queries / prepared statements (e.g. Prisma’s tagged `$queryRaw`, or `db.query(sql, [params])`)."
)
_SQL_PROMPT = (
    "Rewrite this database query to use parameterized/prepared statements so user input is passed as bound parameters, "
    "never concatenated into the SQL string. If using Prisma, switch $queryRawUnsafe to the tagged-template $queryRaw."
)
_XSS_FIX = (
    "Sanitize before rendering with DOMPurify:\n\n"
    "import DOMPurify from 'isomorphic-dompurify';\n\n"
    "<div dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(<<0>>) }} />\n\n"
    "Or, if HTML isn't needed, render it as text instead: <div>{<<0>>}</div>"
)
_XSS_PROMPT = (
    "Wrap the value passed to dangerouslySetInnerHTML in DOMPurify.sanitize() — add `import DOMPurify from "
    "'isomorphic-dompurify'` and change `__html: <<0>>` to `__html: DOMPurify.sanitize(<<0>>)`. If the value never needs "
    "to be HTML, render it as plain text ({value}) instead."
)
_SSRF_FIX = (
    "Validate the target URL against an allowlist of exact hosts before requesting it, and block link-local/private "
    "ranges (169.254.0.0/16, 10/8, 127/8, ::1)."
)
_SSRF_PROMPT = (
    "Before making this server-side request, validate the destination URL: allow only an explicit list of trusted hosts "
    "and reject any URL resolving to private/link-local ranges (including 169.254.169.254). Never pass user input "
    "straight into fetch/axios."
)
_TLS_FIX = "Remove the flag and fix the underlying certificate/trust issue properly."
_TLS_PROMPT = (
    "Remove this setting that disables TLS certificate verification and instead configure the correct CA/trust chain so "
    "certificates validate normally."
)
_ENV_FIX = (
    "Add `.env*` to .gitignore, remove the file from git (`git rm --cached`), and rotate every value it contained."
)
_ENV_PROMPT = (
    "Add a .gitignore entry for .env and .env.local, remove the committed .env from git tracking with "
    "`git rm --cached .env`, and rotate all secrets that were in it."
)
_SECRET_FIX = (
    "Rotate this credential now, then store it in an environment variable and read it from there (never commit it)."
)
_SECRET_PROMPT = (
    "A secret (<<0>>) is hardcoded in the repo. Move it to an environment variable, read it from process.env, and remove "
    "the literal from the code. Then rotate the credential since it was exposed."
)
_UPLOAD_FIX = "Allowlist accepted MIME types/extensions and enforce a maximum file size before storing the upload."
_UPLOAD_PROMPT = (
    "Add validation to this file-upload handler: allowlist specific MIME types/extensions and reject anything else, and "
    "enforce a maximum file size limit before saving the file."
)


def _secret(rule_id: str, severity: str, confidence: str, what: str) -> Variant:  # (inferred)
    return Variant(
        rule_id, "secrets", severity, confidence, "CWE-798", "A07:2021", "whitebox",
        f"Hardcoded secret in your code: {what}",
        "Anyone who can see the code — or its git history — can use this credential to access your systems.",
        _SECRET_FIX, _SECRET_PROMPT.replace("<<0>>", what),
    )


def _exposed(severity: str, suffix: str) -> Variant:
    return Variant(
        "WEB_CONFIG_EXPOSED_FILE", "web_config", severity, "high", "CWE-538", "A05:2021", "blackbox",
        "Your <<0>> file is publicly downloadable",
        f"Anyone can fetch <<0>> from your site{suffix}.",
        "Stop serving <<0>>. Ensure your host blocks dotfiles and that secrets are only in server env vars.",
        "Block public access to <<0>> at the web-server/CDN level and rotate any secrets it exposed.",
    )


def _upload(missing: str) -> Variant:
    return Variant(
        "BUSINESS_INSECURE_UPLOAD", "business_logic", "medium", "low", "CWE-434", "A04:2021", "whitebox",
        "File uploads aren’t validated",
        f"This upload handler doesn’t restrict {missing}, so attackers can upload malicious or oversized files.",
        _UPLOAD_FIX, _UPLOAD_PROMPT,
    )


VARIANTS: dict[str, Variant] = {
    "secret_stripe": _secret("SECRETS_STRIPE_SECRET_KEY", "critical", "high", "Stripe secret key"),
    "secret_service_role": _secret("SECRETS_SUPABASE_SERVICE_ROLE", "critical", "high", "Supabase service-role key"),
    "secret_service_role_jwt": _secret(
        "SECRETS_SUPABASE_SERVICE_ROLE_JWT", "critical", "high", "Supabase service-role token"
    ),
    "secret_private_key": _secret("SECRETS_PRIVATE_KEY", "critical", "high", "private key"),
    "secret_conn_string": _secret(
        "SECRETS_CONNECTION_STRING", "critical", "high", "database connection string with a password"
    ),
    "secret_generic": _secret("SECRETS_HARDCODED", "high", "medium", "credential-like value"),
    "env_ignored": Variant(
        "SECRETS_COMMITTED_ENV", "secrets", "high", "high", "CWE-538", "A05:2021", "whitebox",
        "A .env file with real values is committed (<<file>>)",
        "Environment files hold secrets; committing one puts them in your git history forever.",
        _ENV_FIX, _ENV_PROMPT,
    ),
    "env_not_ignored": Variant(
        "SECRETS_COMMITTED_ENV", "secrets", "high", "high", "CWE-538", "A05:2021", "whitebox",
        "A .env file with real values is committed (<<file>>)",
        "Your .gitignore does not exclude .env, so secrets get committed and shared with anyone who has the repo.",
        _ENV_FIX, _ENV_PROMPT,
    ),
    "firebase_open": Variant(
        "DATABASE_FIREBASE_RULES_OPEN", "database", "critical", "high", "CWE-1220", "A01:2021", "whitebox",
        "Your Firebase security rules are wide open",
        "`allow read, write: if true` lets anyone on the internet read and overwrite your entire database or storage bucket.",
        "Replace `if true` with ownership checks, e.g. `allow read, write: if request.auth != null && request.auth.uid == resource.data.ownerId;`.",
        "Rewrite these Firebase security rules so reads/writes require authentication AND ownership (request.auth.uid must match the document owner), instead of `if true`.",
    ),
    "rls_permissive": Variant(
        "DATABASE_RLS_PERMISSIVE_POLICY", "database", "critical", "high", "CWE-639", "A01:2021", "whitebox",
        "A Row Level Security policy lets any logged-in user read/write everything",
        "A policy like `using (auth.uid() is not null)` checks only that someone is signed in — any signed-up visitor can read every row, not just their own.",
        "Scope the policy to the owner, e.g. `using (auth.uid() = user_id)`.",
        "Rewrite this Supabase RLS policy so it only allows a user to access their own rows, e.g. `using (auth.uid() = user_id)` instead of checking only that the user is logged in.",
    ),
    "definer_view": Variant(
        "DATABASE_SECURITY_DEFINER_VIEW", "database", "high", "medium", "CWE-639", None, "whitebox",
        "A view may bypass Row Level Security",
        "Postgres views run with the creator’s permissions by default, so they can leak rows RLS would otherwise hide.",
        "Create the view with `WITH (security_invoker = true)`.",
        "Add `WITH (security_invoker = true)` to this Postgres view so it respects the querying user’s RLS policies.",
    ),
    "rls_disabled_one": Variant(
        "DATABASE_RLS_DISABLED", "database", "critical", "high", "CWE-1220", "A01:2021", "whitebox",
        'Table "<<0>>" has no Row Level Security',
        "Without RLS, anyone with your public anon key can read (and often write) every row in this table directly over the REST API." + _RLS_NOTE,
        "Run: ALTER TABLE <<0>> ENABLE ROW LEVEL SECURITY; then add owner-scoped policies.",
        'Enable Row Level Security on the "<<0>>" table and add policies so users can only access their own rows (e.g. using (auth.uid() = user_id)).',
    ),
    "rls_disabled_many": Variant(
        "DATABASE_RLS_DISABLED", "database", "critical", "high", "CWE-1220", "A01:2021", "whitebox",
        "<<1>> tables have no Row Level Security",
        "Without RLS, anyone with your public anon key can read (and often write) every row of these tables directly over the REST API: <<2>>." + _RLS_NOTE,
        "Enable RLS on each table (e.g. ALTER TABLE <<0>> ENABLE ROW LEVEL SECURITY;) then add owner-scoped policies. Tables: <<2>>.",
        "Enable Row Level Security on these Supabase tables and add owner-scoped policies (e.g. using (auth.uid() = user_id)) so users can only access their own rows: <<2>>.",
    ),
    "rls_open_live": Variant(
        "DATABASE_SUPABASE_RLS_OPEN_LIVE", "database", "critical", "high", "CWE-1220", "A01:2021", "blackbox",
        'Anyone can read your "<<0>>" table',
        "Using only your public anon key, we fetched real rows from this table over the internet — Row Level Security is not protecting it.",
        'Enable RLS on "<<0>>" and add owner-scoped policies so the anon role can’t read other users’ rows.',
        'Enable Row Level Security on the Supabase "<<0>>" table and add a policy so users can only read their own rows.',
    ),
    "middleware_bypass": Variant(
        "AUTH_NEXTJS_MIDDLEWARE_BYPASS", "auth", "critical", "high", "CWE-285", "A01:2021", "whitebox",
        "Your Next.js version is vulnerable to a middleware auth bypass (CVE-2025-29927)",
        "Next.js <<0>> lets an attacker skip middleware (including auth checks) by sending an x-middleware-subrequest header.",
        "Upgrade Next.js to 15.2.3+, 14.2.25+, or 13.5.9+.",
        "Upgrade Next.js to a patched version (15.2.3+, 14.2.25+, or 13.5.9+) to fix the CVE-2025-29927 middleware authorization bypass.",
    ),
    "missing_auth": Variant(
        "AUTH_MISSING_CHECK", "auth", "high", "low", "CWE-306", "A01:2021", "whitebox",
        "An endpoint changes data without checking who’s calling",
        "A write/delete handler with no authentication check can be called by anyone to modify or destroy data.",
        "Verify the session/token at the top of the handler and reject unauthenticated requests before any database write.",
        "Add an authentication check at the start of this API route/server action: load the current session (e.g. getServerSession/getUser/auth()), and return 401 if there is no authenticated user before performing any database mutation.",
    ),
    "sql_raw_unsafe": Variant(
        "INJECTION_SQL", "injection", "critical", "high", "CWE-89", "A03:2021", "whitebox",
        "You’re using a raw, unescaped SQL query",
        "Prisma’s $queryRawUnsafe/$executeRawUnsafe run SQL without escaping — user input reaches your database verbatim.",
        _SQL_FIX, _SQL_PROMPT,
    ),
    "sql_concat": Variant(
        "INJECTION_SQL", "injection", "critical", "high", "CWE-89", "A03:2021", "whitebox",
        "SQL is built by gluing strings together",
        "Concatenating user input into a SQL string lets an attacker rewrite your query (SQL injection).",
        _SQL_FIX, _SQL_PROMPT,
    ),
    "command": Variant(
        "INJECTION_COMMAND", "injection", "critical", "high", "CWE-78", "A03:2021", "whitebox",
        "A shell command is built from untrusted input",
        "Splicing input into a shell command lets an attacker run arbitrary commands on your server.",
        "Avoid the shell: pass arguments as an array to execFile/spawn, and validate/allowlist any user-provided values.",
        "Rewrite this to avoid shell interpolation: use execFile or spawn with the command and an array of arguments, and validate any user-supplied values against an allowlist.",
    ),
    "xss_user": Variant(
        "INJECTION_XSS", "injection", "high", "high", "CWE-79", "A03:2021", "whitebox",
        "Unsanitized user input is injected as HTML",
        "dangerouslySetInnerHTML with user-derived content lets an attacker run scripts in your users’ browsers (XSS).",
        _XSS_FIX, _XSS_PROMPT,
    ),
    "xss_unknown": Variant(
        "INJECTION_XSS", "injection", "low", "low", "CWE-79", "A03:2021", "whitebox",
        "Dynamic HTML injection — verify the source is not user input",
        "This value is injected as raw HTML. If it can ever contain user input it is an XSS risk; if it is fully static it is safe — verify the source.",
        _XSS_FIX, _XSS_PROMPT,
    ),
    "ssrf_metadata": Variant(
        "INJECTION_SSRF", "injection", "high", "high", "CWE-918", "A10:2021", "whitebox",
        "Your code makes a request to the cloud metadata endpoint",
        "A request to 169.254.169.254 (or the GCP/Alibaba equivalent) can read your cloud instance’s credentials — a classic SSRF-to-credential-theft path. Fetching it directly is almost never legitimate.",
        _SSRF_FIX, _SSRF_PROMPT,
    ),
    "ssrf_tainted": Variant(
        "INJECTION_SSRF", "injection", "high", "medium", "CWE-918", "A10:2021", "whitebox",
        "A server request is built from untrusted input (SSRF)",
        "Passing user-controlled data into the URL of a server-side request lets an attacker make your server call internal hosts or the cloud metadata endpoint (SSRF).",
        _SSRF_FIX, _SSRF_PROMPT,
    ),
    "webhook_stripe": Variant(
        "API_WEBHOOK_UNVERIFIED", "api_webhooks", "critical", "medium", "CWE-345", "A08:2021", "whitebox",
        "Your Stripe webhook doesn’t verify signatures",
        "Without signature verification, anyone can POST a fake “payment succeeded” event and get paid products for free.",
        "Verify every event with `stripe.webhooks.constructEvent(rawBody, sig, endpointSecret)` before processing, using the raw request body.",
        "Add Stripe webhook signature verification: read the raw request body, call stripe.webhooks.constructEvent(rawBody, stripe-signature header, STRIPE_WEBHOOK_SECRET), and reject the request if it throws.",
    ),
    "webhook_github": Variant(
        "API_WEBHOOK_UNVERIFIED", "api_webhooks", "critical", "medium", "CWE-345", "A08:2021", "whitebox",
        "Your GitHub webhook doesn’t verify signatures",
        "Without signature verification, anyone can forge webhook events and trigger your handler.",
        "Compute an HMAC of the raw body with your webhook secret and compare it to the signature header using timingSafeEqual.",
        'Verify the GitHub webhook signature: compute createHmac("sha256", secret) over the raw body and compare with the x-hub-signature-256 header using crypto.timingSafeEqual.',
    ),
    "webhook_replay": Variant(
        "API_WEBHOOK_NO_IDEMPOTENCY", "api_webhooks", "high", "medium", "CWE-799", "A04:2021", "whitebox",
        "Your webhook can be replayed to run twice",
        "This webhook acts on an event (credits, grants access, or writes to the database) without recording that the event was already handled — so a replay of the same signed event applies the effect again (e.g. double credits or double fulfilment). Providers like Stripe retry automatically, so this fires even without an attacker.",
        "Persist each processed event id with a unique constraint and no-op on repeats: before acting, insert the event id (or look it up), and if it already exists, return 200 without re-applying the side effect.",
        "Make this webhook handler idempotent: store processed Stripe event ids in a table with a unique constraint on the event id. At the start of the handler, try to insert the event.id (or look it up); if it already exists, return 200 immediately without crediting/granting again. Only apply the side effect for events not seen before.",
    ),
    "mass_assignment": Variant(
        "API_MASS_ASSIGNMENT", "api_webhooks", "high", "medium", "CWE-915", "A08:2021", "whitebox",
        "Users can grant themselves privileges by tampering with the request",
        "Writing client-controlled fields like isAdmin/tier/credits lets a user upgrade their own account or role for free.",
        "Never trust client input for privileged fields. Pick an explicit allowlist of updatable fields and set role/tier/credits server-side only.",
        "Change this handler so it only writes an explicit allowlist of user-editable fields, and never sets privileged fields (isAdmin, role, tier, credits) from req.body. Determine those server-side.",
    ),
    "cors_wildcard": Variant(
        "WEB_CONFIG_CORS_WILDCARD_CREDENTIALS", "web_config", "high", "high", "CWE-942", "A05:2021", "whitebox",
        "Your CORS policy lets any website make credentialed requests",
        "Allowing `*` origin together with credentials means any malicious site can call your API as your logged-in users.",
        "Never combine `Access-Control-Allow-Origin: *` with credentials. Allowlist specific trusted origins instead.",
        "Fix this CORS configuration: replace the `*` origin with an explicit allowlist of trusted origins when credentials are enabled, or disable credentials.",
    ),
    "image_wildcard": Variant(
        "WEB_CONFIG_NEXT_IMAGE_WILDCARD", "web_config", "medium", "high", "CWE-918", "A10:2021", "whitebox",
        "Your Next.js image optimizer accepts images from any host",
        "A wildcard hostname in images.remotePatterns lets anyone make your server fetch and optimize images from arbitrary URLs — an SSRF path to internal services and a way to exhaust your CPU/memory with huge images.",
        "Replace the wildcard with an explicit allowlist of the exact hostnames you serve images from.",
        'In next.config, change images.remotePatterns (or images.domains) from a wildcard host ("**"/"*") to an explicit allowlist of the specific hostnames your app loads images from.',
    ),
    "config_headers": Variant(
        "WEB_CONFIG_MISSING_SECURITY_HEADERS", "web_config", "medium", "medium", "CWE-693", "A05:2021", "whitebox",
        "Your app doesn’t set security headers",
        "Headers like CSP, HSTS and X-Frame-Options block common attacks (clickjacking, protocol downgrade, injection). None are configured.",
        "Add an async headers() function to next.config that sets Content-Security-Policy, Strict-Transport-Security, X-Frame-Options, X-Content-Type-Options, Referrer-Policy and Permissions-Policy.",
        "Add an async headers() function to next.config that applies these security headers to all routes: Content-Security-Policy, Strict-Transport-Security (max-age >= 1 year), X-Frame-Options: DENY, X-Content-Type-Options: nosniff, Referrer-Policy, and Permissions-Policy.",
    ),
    "header_missing": Variant(
        None, "web_config", None, "high", "CWE-693", "A05:2021", "blackbox",
        "Missing security header: <<0>>",
        "The <<0>> header helps block a class of common web attacks; your site doesn’t send it.",
        "Set the <<0>> response header on all routes.",
        "Configure your server/framework to send the <<0>> security header on every response.",
    ),
    "weak_cookie": Variant(
        "WEB_CONFIG_WEAK_COOKIE", "web_config", "medium", "medium", "CWE-1004", None, "blackbox",
        "A session cookie is missing HttpOnly/Secure flags",
        "Cookies without HttpOnly can be stolen by XSS; without Secure they can leak over plain HTTP.",
        "Set HttpOnly, Secure and SameSite on session cookies.",
        "Set the HttpOnly, Secure, and SameSite=Lax (or Strict) attributes on this session cookie.",
    ),
    "exposed_env": _exposed("critical", ""),
    "exposed_env_secret": _exposed("critical", " — and it contains secrets"),
    "exposed_git": _exposed("high", ""),
    "exposed_git_secret": _exposed("high", " — and it contains secrets"),
    "sourcemap": Variant(
        "WEB_CONFIG_EXPOSED_SOURCEMAP", "web_config", "medium", "high", "CWE-540", "A05:2021", "blackbox",
        "Your original source code is downloadable (source maps exposed)",
        "A publicly served .map file reconstructs your un-minified source — internal API routes, comments, and occasionally secrets — handing attackers a blueprint of your app.",
        "Disable source maps in production (Next.js: leave `productionBrowserSourceMaps` off / default), or block *.map at the CDN.",
        "Stop serving JavaScript source maps in production: ensure productionBrowserSourceMaps is not enabled in next.config, and/or block public access to *.map files at the CDN/web-server level.",
    ),
    "known_cve": Variant(
        None, "dependencies", None, "high", "CWE-1035", "A06:2021", "whitebox",
        "Outdated dependency with a known vulnerability: <<0>>@<<1>>",
        "<<3>> Attackers scan for exactly these versions.",
        "Upgrade <<0>> to a patched release and re-run your tests.",
        "Upgrade the <<0>> dependency to the latest patched version to resolve <<2>>, then run the test suite.",
    ),
    "ai_rules_file": Variant(
        "AI_RISKY_RULES_FILE", "ai_specific", "high", "medium", "CWE-1104", None, "whitebox",
        "Your AI rules file weakens security (<<file>>)",
        "This file tells your AI coding tool to <<0>>, so every feature it generates inherits the weakness.",
        "Remove the “<<0>>” instruction from <<file>>. AI rules files should reinforce security, not disable it.",
        "Edit <<file>> to remove any instruction that tells the assistant to skip authentication, hardcode secrets, disable TLS verification, or override the API base URL. Replace them with instructions to always enforce auth and validation.",
    ),
    "tls_off_option": Variant(
        "AI_INSECURE_DEFAULTS", "ai_specific", "high", "high", "CWE-295", "A05:2021", "whitebox",
        "TLS certificate verification is turned off",
        "`rejectUnauthorized: false` disables certificate checks, exposing you to man-in-the-middle attacks.",
        _TLS_FIX, _TLS_PROMPT,
    ),
    "tls_off_env": Variant(
        "AI_INSECURE_DEFAULTS", "ai_specific", "high", "high", "CWE-295", "A05:2021", "whitebox",
        "TLS verification is globally disabled",
        "Setting NODE_TLS_REJECT_UNAUTHORIZED=0 disables TLS validation for the entire process.",
        _TLS_FIX, _TLS_PROMPT,
    ),
    "public_secret_var": Variant(  # (inferred)
        "PLATFORM_PUBLIC_SECRET_VAR", "platform", "high", "high", "CWE-200", "A05:2021", "whitebox",
        "A secret is exposed to the browser through <<0>>",
        "Variables with a public prefix are bundled into client code, so anyone can read <<0>>.",
        "Rename <<0>> without the public prefix, read it on the server only, and rotate the value.",
        "Move <<0>> to a server-only environment variable without the public prefix and update every use, then rotate the secret.",
    ),
    "upload_both": _upload("file type or file size"),
    "upload_type": _upload("file type"),
    "upload_size": _upload("file size"),
    "gitleaks_dangerous": Variant(
        None, "secrets", "critical", "high", "CWE-798", None, "whitebox",
        "Hardcoded secret in your code: <<0>>",
        "This looks like a real credential committed to the repo. Anyone who can see the code — or its git history — can use it to access your systems.",
        _SECRET_FIX + "<<1>>", _SECRET_PROMPT,
    ),
    "gitleaks_other": Variant(
        None, "secrets", "high", "medium", "CWE-798", None, "whitebox",
        "Hardcoded secret in your code: <<0>>",
        "A value matching a known secret pattern is committed to the repo. If it is a real credential, anyone who sees the code or its git history can use it.",
        _SECRET_FIX + "<<1>>", _SECRET_PROMPT,
    ),
    "semgrep": Variant(
        None, "injection", None, "medium", None, None, "whitebox",
        "<<0>>", "A code pattern matching a known-dangerous rule was found.", None, None,
    ),
    "osv_fixable": Variant(
        None, "dependencies", None, "high", "CWE-1035", "A06:2021", "whitebox",
        "<<url>> has <<1>>",
        "This version of <<0>> has <<2>>. Attackers scan for exactly these versions. Advisories: <<3>>.",
        "Upgrade <<0>> to <<4>> or later, then re-run your tests.<<5>>",
        "Upgrade the <<0>> dependency to <<4>> or later to resolve these advisories (<<3>>), then run the test suite.",
    ),
    "osv_unfixed": Variant(
        None, "dependencies", None, "high", "CWE-1035", "A06:2021", "whitebox",
        "<<url>> has <<1>>",
        "This version of <<0>> has <<2>>. Attackers scan for exactly these versions. Advisories: <<3>>.",
        "Upgrade <<0>> to a patched release, then re-run your tests.",
        "Upgrade the <<0>> dependency to the latest patched version to resolve these advisories (<<3>>), then run the test suite.",
    ),
}

GITLEAKS_HISTORY_NOTE = (
    " It also remains in your git history — purge it (e.g. with git filter-repo) after rotating."
)
OSV_UNFIXED_NOTE = " (Some advisories have no fix yet.)"

# Extra pattern rules of the static-analysis pack: id, severity label, message.
PATTERN_PACK = (
    ("sql-injection-concat", "ERROR", "SQL query built by string concatenation — use parameterized queries."),
    ("command-injection", "ERROR", "OS command built from untrusted input — use execFile/spawn with an argument array."),
    ("xss-dangerously-set-inner-html", "WARNING", "dangerouslySetInnerHTML with dynamic content — sanitize with DOMPurify."),
)

MAX_PARAMS = 6
