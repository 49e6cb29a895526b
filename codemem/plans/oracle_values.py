"""Fixed values of the SQL counterparts, stated apart from the operators so that a wrong one shows."""

# White space and line breaks in Python's sense.
WS_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CLASS}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Secrets, in the order in which they are removed.
SECRET_PATTERNS = {
    "sk": r"sk-[a-zA-Z0-9]{48}",
    "gsk": r"gsk_[a-zA-Z0-9]{52}",
    "ghp": r"ghp_[a-zA-Z0-9]{36}",
    "google": r"AIzaSy[a-zA-Z0-9_-]{35}",
    "assignment": (
        r"(?iu)(?:api_key|api_secret|secret_key|password|passwd|token)" + WS + r"*=" + WS + r"*[\"'][^\"']{8,}[\"']"
    ),
}
SECRET_MARK = "[REDACTED_SECRET]"
MIN_CONTENT_CHARS = 15

# Files.
DATASET_PREFIX = "codemem_"
IGNORED_DIRS = (
    ".git", ".github", "__pycache__", ".venv", "venv", "env", "node_modules", ".cognee_store", ".pytest_cache",
    "dist", "build", "eggs", ".eggs",
)
TEXT_SUFFIXES = (
    ".py", ".md", ".txt", ".js", ".ts", ".html", ".css", ".json", ".yaml", ".yml", ".ini", ".toml", ".sh", ".bat",
)
EXPLICIT_FILES = (
    "requirements.txt", "setup.py", "package.json", "Dockerfile", "Makefile", "LICENSE", "gitignore", ".gitignore",
    ".env.example",
)

# Declarations.
JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")
GO_SUFFIX = ".go"
RUST_SUFFIX = ".rs"
JS_CLASS = rf"(?:export{WS}+)?(?:default{WS}+)?class{WS}+([A-Za-z0-9_]+)(?:{WS}+extends{WS}+([A-Za-z0-9_]+))?"
JS_FUNCTION = rf"(?:export{WS}+)?(?:async{WS}+)?function{WS}+([A-Za-z0-9_]+){WS}*\(([^)]*)\)"
JS_ARROW = rf"(?:export{WS}+)?(?:const|let|var){WS}+([A-Za-z0-9_]+){WS}*={WS}*(?:async{WS}*)?\(([^)]*)\){WS}*=>"
JS_IMPORT = rf"import{WS}+(?:\{{[^}}]+\}}|[A-Za-z0-9_]+){WS}+from{WS}+['\"]([^'\"]+)['\"]"
GO_STRUCT = rf"type{WS}+([A-Za-z0-9_]+){WS}+struct"
GO_FUNCTION = rf"func{WS}+(?:\([^)]+\){WS}+)?([A-Za-z0-9_]+){WS}*\(([^)]*)\)"
RUST_TYPE = rf"(?:pub{WS}+)?(?:struct|enum|trait){WS}+([A-Za-z0-9_]+)"
RUST_FUNCTION = rf"(?:pub{WS}+)?(?:async{WS}+)?fn{WS}+([A-Za-z0-9_]+){WS}*\(([^)]*)\)"

# Comments.
TAGS = ("TODO", "FIXME", "NOTE", "BUG", "HACK", "WARNING", "ADR", "DEPRECATED")
HASH_SUFFIXES = (".py", ".sh", ".yaml", ".yml", ".ini")
SLASH_SUFFIXES = (".js", ".ts", ".jsx", ".tsx", ".c", ".cpp", ".h", ".go", ".java", ".rs", ".css")
MARKUP_SUFFIXES = (".html", ".htm", ".xml", ".md")

# Commits.
DEFAULT_COMMITS = 50
FILES_PER_PART = 1000
ROOT_LABEL = "\n\nFiles added in root commit: "

# Graph: shape and size of a node of each group.
NODE_SHAPES = {"file": ("dot", 22), "class": ("diamond", 16), "func": ("triangle", 12)}
NO_SYMBOLS = "  - *(No top-level classes/functions extracted)*"

# Memory.
DEFAULT_K = 3
DEFAULT_CHUNK_TOKENS = 256
DEFAULT_DIM = 384
EMPTY_REPLY = "got it."
NO_RESULTS = "No relevant memories found in codebase index."
NO_TEXTS = "No relevant memories found."
DECISION_LEAD = "Architectural Decision Record:\n"
DECISION_DATASET = "adr_decision_"
