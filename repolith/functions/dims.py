"""Enumerations, file name tables, taint signatures, secret patterns and weights."""

SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_WEIGHT = {"critical": 15.0, "high": 7.0, "medium": 3.0, "low": 1.0, "info": 0.2}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
CERTAINTIES = ["unknown", "dynamic", "inferred", "resolved", "direct"]
CERTAINTY_CONFIDENCE = {"direct": 0.85, "resolved": 0.75, "inferred": 0.55, "dynamic": 0.35, "unknown": 0.2}
CATEGORIES = ["architecture", "quality", "security", "secrets", "dependency", "performance", "infrastructure"]
PROFILES = {
    "minimal": ["architecture"],
    "standard": ["architecture", "quality"],
    "security": ["security", "secrets"],
    "full": CATEGORIES,
    "enterprise": CATEGORIES,
}

LANGUAGE_BY_EXTENSION = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".sql": "sql", ".py": "python", ".pyi": "python",
}
DOCUMENTATION_EXTENSIONS = [".md", ".mdx", ".txt"]
ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".webp"]
BINARY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".webp", ".lockb"]
TEST_SEGMENTS = ["test", "tests", "__tests__", "__mocks__"]
GENERATED_SEGMENTS = ["dist", "build", ".next", "coverage", "generated", "out"]
VENDORED_SEGMENTS = ["vendor", "vendored", "third_party", "third-party"]
INFRASTRUCTURE_SEGMENTS = [".github", "k8s", "helm", "terraform"]
INFRASTRUCTURE_FILES = ["dockerfile", "docker-compose.yml", "docker-compose.yaml", "nginx.conf"]
CONFIG_FILES = [
    "package.json", "tsconfig.json", ".eslintrc.js", ".eslintrc.json", ".eslintrc.cjs", ".prettierrc",
    "jest.config.js", "jest.config.ts", "vitest.config.ts", "next.config.js", "next.config.mjs", "nest-cli.json",
    ".babelrc", "babel.config.js", "metro.config.js", ".env.example", "pyproject.toml", "requirements.txt",
    "setup.cfg", "pipfile",
]
TEST_NAME = r"(?i)\.(test|spec)\.[cm]?[jt]sx?$"
PYTHON_TEST_NAME = r"(?i)^(test_.+|.+_test)\.pyi?$"
GENERATED_NAME = r"(?i)\.(generated|gen)\.[cm]?[jt]sx?$"
CONFIG_NAME = r"(?i)^(tsconfig|jest\.config|vitest\.config|.*\.config)\.[cm]?[jt]sx?$"
ENTRY_POINT = r"(^|/)index\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$"

LOCKFILES = [("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm")]
FRAMEWORK_PACKAGES = {
    "express": "express", "nestjs": "@nestjs/core", "nextjs": "next", "react": "react",
    "react-native": "react-native", "angular": "@angular/core", "vue": "vue",
}
MODULE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]

#: name, role, kind, callee kind, callee names, receiver, receiver starts with, receiver ends with any of.
TAINT_SIGNATURES = [
    ("process.env", "source", "environment-variable", None, None, None, "process.env", None),
    ("req.query", "source", "query-parameter", None, None, None, "req.query", None),
    ("req.params", "source", "route-parameter", None, None, None, "req.params", None),
    ("req.body", "source", "request-body", None, None, None, "req.body", None),
    ("req.headers", "source", "header", None, None, None, "req.headers", None),
    ("req.cookies", "source", "cookie", None, None, None, "req.cookies", None),
    ("fs.readFile", "source", "file", "member", ["readFile", "readFileSync"], "fs", None, None),
    ("eval", "sink", "eval", "identifier", ["eval"], None, None, None),
    ("child_process.exec", "sink", "shell-command", "member", ["exec", "execSync"], "child_process", None, None),
    ("db-client.query", "sink", "sql", "member", ["query"], None, None, ["db", "pool", "connection", "client", "conn"]),
    ("prisma.$queryRawUnsafe", "sink", "sql", "member", ["$queryRawUnsafe", "$executeRawUnsafe"], None, None, None),
    ("template.render", "sink", "html-render", "member", ["render"], None, None, None),
    ("escapeHtml", "sanitizer", None, None, ["escapeHtml"], None, None, None),
    ("parseInt", "sanitizer", None, "identifier", ["parseInt"], None, None, None),
    ("mysql.escape", "sanitizer", None, "member", ["escape"], None, None, None),
]

#: id, name, pattern, confidence. All are CWE-798.
SECRET_PATTERNS = [
    ("secrets/aws-access-key-id", "AWS Access Key ID", r"AKIA[0-9A-Z]{16}", 0.75),
    ("secrets/github-token", "GitHub Token", r"gh[pousr]_[A-Za-z0-9]{36}", 0.8),
    ("secrets/slack-token", "Slack Token", r"xox[baprs]-[0-9A-Za-z-]{10,}", 0.7),
    ("secrets/private-key-header", "Private Key Header", r"-----BEGIN (RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----", 0.8),
    ("secrets/google-api-key", "Google API Key", r"AIza[0-9A-Za-z\-_]{35}", 0.65),
    ("secrets/stripe-live-secret-key", "Stripe Live Secret Key", r"sk_live_[0-9A-Za-z_]{24,}", 0.8),
]
