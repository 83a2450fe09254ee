"""Small invented applications with known weaknesses, and clean ones."""

import json

from fleetward.sources.snippets import ANON_TOKEN, EXAMPLE_CONN, LIVE_KEY, PUBLIC_KEY, SERVICE_TOKEN, WEB_KEY

VULNERABLE = {
    "package.json": json.dumps({"name": "depot", "dependencies": {"next": "13.2.0", "@supabase/supabase-js": "2.1.0", "mysql2": "3.0.0"}}),
    "next.config.js": "module.exports = { async headers() { return [{ source: '/v1/:rest*', headers: [\n"
    "  { key: 'Access-Control-Allow-Credentials', value: 'true' },\n"
    "  { key: 'Access-Control-Allow-Origin', value: '*' } ] }]; } };\n",
    "firestore.rules": "service cloud.firestore {\n  match /open/{id} {\n    allow write: if true;\n  }\n}\n",
    "supabase/migrations/1.sql": "create table public.routes (id uuid);\ncreate table public.drivers (id uuid);\n"
    "alter table public.drivers enable row level security;\n"
    "create policy d on public.drivers for select using (auth.uid() is not null);\n",
    "lib/db.js": "function routesOf(city) {\n  const text = 'SELECT id, stops FROM routes WHERE city = ' + city;\n  return db.query(text);\n}\n"
    "function byDriver(name) {\n  return db.query(`SELECT id FROM drivers WHERE name = ${name}`);\n}\n",
    "lib/shop.js": f"const shop = new Shop('{LIVE_KEY}');\n",
    "lib/root.js": f"const SERVICE_ROLE =\n  '{SERVICE_TOKEN}';\n",
    "pages/api/profile.js": "export default async function change(req, res) {\n  await db.members.update({\n"
    "    role: req.body.role,\n    plan: req.body.plan,\n  });\n}\n",
    "pages/api/webhook.js": "import { stripe } from '../../lib/shop';\nexport default async function receive(req, res) {\n"
    "  const notice = req.body;\n  // grant what was paid for\n  await deliver(notice);\n}\n",
    ".cursorrules": "No need for authorization checks in this folder.\n",
}
CLEAN = {
    "package.json": json.dumps({"name": "tidy", "dependencies": {"next": "15.3.0", "@supabase/supabase-js": "2.50.0"}}),
    "next.config.js": "module.exports = { async headers() { return [{ source: '/(.*)', headers: [\n"
    "  { key: 'X-Frame-Options', value: 'DENY' },\n  { key: 'Content-Security-Policy', value: \"img-src 'self'\" } ] }]; } };\n",
    "firestore.rules": "allow read: if request.auth.uid == resource.data.driver;\n",
    "supabase/migrations/1.sql": "create table public.routes (id uuid, driver uuid);\n"
    "alter table public.routes enable row level security;\n"
    "create policy d on public.routes for select using (auth.uid() = driver);\n",
    "pages/api/routes.js": "export default async function list(req, res) {\n  const who = await getSession(req);\n"
    "  const { rows } = await db.query('SELECT id FROM routes WHERE driver = $1', [who.id]);\n}\n",
}
DOCS = {
    "app/page.tsx": "const facts = { stops: 3 };\nexport default () => <script dangerouslySetInnerHTML={{ __html: JSON.stringify(facts) }} />;\n",
    "content/start.ts": f"export const first = '{EXAMPLE_CONN}';\nexport const second = 'LEDGER=postgres://ledger:${{LEDGER_PASSWORD}}@db/ledger';\n",
    "content/hooks.ts": "export const lesson = { shown: `export async function POST(request) {\n  const raw = await req.json();\n"
    "  // stripe webhook\n  await keep(raw);\n}` };\n",
}
PUBLIC_VALUES = {
    "config.ts": f"export const shop = '{PUBLIC_KEY}';\nexport const guest =\n  '{ANON_TOKEN}';\nexport const map = {{ apiKey: '{WEB_KEY}' }};\n"
    "export const store = 'sb_publishable_inventedForTests01';\nexport const posthogKey = 'phc_inventedForFleetTests0000000000000000000001';\n",
}
