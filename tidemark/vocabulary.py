"""Word lists, tables and limits that results must agree on."""

BINARY_SUFFIXES = (
    ".7z", ".a", ".avi", ".bin", ".bmp", ".class", ".dll", ".dmg", ".doc", ".docx", ".eot", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg",
    ".jpg", ".lib", ".lockb", ".mov", ".mp3", ".mp4", ".o", ".otf", ".pdf", ".png", ".ppt", ".pptx", ".pyc", ".rar", ".so", ".tar", ".tif",
    ".tiff", ".ttf", ".wav", ".webm", ".webp", ".woff", ".woff2", ".xls", ".xlsx", ".xz", ".zip",
)
LANGUAGES = {
    ".c": "C", ".cc": "C++", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".go": "Go", ".h": "C/C++ Header", ".hpp": "C++ Header", ".html": "HTML",
    ".java": "Java", ".js": "JavaScript", ".jsx": "JavaScript", ".json": "JSON", ".kt": "Kotlin", ".lua": "Lua", ".md": "Markdown", ".php": "PHP",
    ".ps1": "PowerShell", ".py": "Python", ".rb": "Ruby", ".rs": "Rust", ".sh": "Shell", ".sql": "SQL", ".swift": "Swift", ".toml": "TOML",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".vue": "Vue", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML",
}
HIGH_SIGNAL_NAMES = (
    "agents.md", "changelog.md", "claude.md", "code_of_conduct.md", "contributing.md", "dockerfile", "handoff.md", "license", "license.md",
    "makefile", "package.json", "project_context.md", "pyproject.toml", "readme.md", "security.md", "task_queue.md",
)
EXCLUDED_DIRECTORIES = (
    ".aws", ".azure", ".claude", ".codex", ".cursor", ".docker", ".gcloud", ".git", ".gnupg", ".hg", ".idea", ".kube", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", ".ssh", ".svn", ".terraform", ".tox", ".venv", ".vscode", "__pycache__", "bower_components", "build", "dist",
    "node_modules", "target", "vendor",
)
EXCLUDED_NAMES = (
    ".dockerconfigjson", ".git-credentials", ".netrc", ".npmrc", ".pypirc", "auth.json", "cookies.sqlite", "credentials.json", "id_dsa", "id_ecdsa",
    "id_ed25519", "id_rsa", "service-account.json",
)
ARCHIVE_SUFFIX = ".tidemark.zip"
EXCLUDED_SUFFIXES = (ARCHIVE_SUFFIX, ".db", ".jks", ".kdbx", ".key", ".keystore", ".p12", ".pem", ".pfx", ".ppk", ".sqlite", ".sqlite3")
ENV_TEMPLATES = (".env.example", ".env.sample", ".env.template")
#: In the order in which they are tried; one is taken off.
BACKUP_SUFFIXES = (".backup", ".orig", ".save", ".bak", ".old", "~")
KEY_PREFIXES = ("id_rsa_", "id_dsa_", "id_ecdsa_", "id_ed25519_")
RESERVED_STEMS = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
BIDI_CONTROLS = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"
SENSITIVE_KEY_SUFFIXES = (
    "secretkeybase", "railsmasterkey", "secretaccesskey", "clientsecret", "accesstoken", "authtoken", "privatekey", "secretkey", "apikey",
    "password", "passwd", "secret", "token", "pwd",
)
PLACEHOLDER_WORDS = ("example", "sample", "changeme", "change_me", "replace_me", "replace-this", "dummy", "not-a-real", "not_a_real_secret")
GENERATED_ENTRIES = ("CONTEXT.md", "REDACTIONS.md", "adapters/AGENTS.md", "adapters/CLAUDE.md", "adapters/IMPORT_PROMPT.md", "adapters/cursor-context.mdc")

KIB, MIB = 1 << 10, 1 << 20
DEFAULT_FILE_BYTES, DEFAULT_TOTAL_BYTES, DEFAULT_FILES = MIB, 25 * MIB, 5_000
MOST_FILE_BYTES, MOST_TOTAL_BYTES, MOST_FILES, MOST_CANDIDATES = 8 * MIB, 48 * MIB, 10_000, 100_000
MOST_PATH_BYTES, MOST_MATCH_WORK = 32 * MIB, 2_000_000
MOST_POLICY_BYTES, MOST_RULES, MOST_PATTERN_BYTES = MIB, 512, 1_024
MOST_ARCHIVE_BYTES, MOST_MANIFEST_BYTES, MOST_DIRECTORY_BYTES, MOST_ENTRIES = 64 * MIB, 2 * MIB, 8 * MIB, 10_010
