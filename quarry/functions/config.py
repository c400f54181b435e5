"""Settings of the analyses. Values that must be as the specification has them stand here, as text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Limits, thresholds and weights. Fixed values."""

    max_files: int = 5000
    max_bytes: int = 1024 * 1024
    go_max_bytes: int = 2 * 1024 * 1024
    dup_window: int = 50
    dup_min_lines: int = 6
    hash_base: int = 257
    hash_mod: int = 1_000_000_007
    complexity_warn: int = 10
    complexity_critical: int = 20
    weight_spec: float = 0.45
    weight_dup: float = 0.30
    weight_complexity: float = 0.25
    god_class_methods: int = 20
    god_class_lines: int = 400
    god_class_fields: int = 20
    god_method_lines: int = 80
    god_method_cc: int = 15
    long_params: int = 5
    fat_interface_methods: int = 15


DEFAULTS = Settings()

# Fixed values.
SKIPPED_DIRS = (
    "__pycache__", ".git", ".svn", ".idea", ".vscode", "node_modules", "venv", ".venv", "env", "dist", "build", "target",
    ".pytest_cache", "htmlcov", ".tox", ".mypy_cache", ".ruff_cache",
)
#: Directories that the architecture scan leaves out.
GENERATED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules",
    "bower_components", "target", "build", "dist", "out", ".idea", ".vscode",
)
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".env")
PY_SHORT_NAMES = ("i", "j", "k", "n", "m", "x", "y", "z", "_", "T", "K", "V", "e")
JAVA_SHORT_NAMES = ("i", "j", "k", "n", "x", "y", "z", "e", "ex")
PY_NUMBERS = (0.0, 1.0, -1.0, 2.0, 100.0, 1000.0)
JAVA_NUMBERS = ("0", "1", "-1", "2", "0L", "1L", "0.0", "1.0", "100", "1000")
LOCAL_PACKAGES = ("backend", "frontend", "tests", "scripts", "cli")
SECRET_KEY = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
PLACEHOLDER = r"\$\{[^}]+\}|%\([^)]+\)s|<[^>]+>|changeme|your[_-]?"
WEAK_VALUE = r"^(?:admin|root|password|passwd|secret|123456|test|demo|default)$"
DEBUG_KEY = r"debug|devtools|trace|verbose|show[_-]?sql"
TRUTHY = r"^(?:true|1|yes|on|enabled)$"
ORIGIN_KEY = r"allowed[_-]?origins|cors|origin"
#: Layers of the pattern recogniser and of layer violations: directory names, in order; rank (None: unranked).
LAYERS: tuple[tuple[str, tuple[str, ...], int | None], ...] = (
    ("controller", ("controller", "controllers", "handler", "handlers", "api", "rest", "web", "routes", "router", "routers", "views"), 10),
    ("service", ("service", "services", "biz", "business", "usecase", "usecases", "application", "logic"), 20),
    ("repository", ("repository", "repositories", "repo", "dao", "mapper", "mappers", "persistence"), 30),
    ("domain", ("domain", "model", "models", "entity", "entities", "aggregate", "aggregates"), 40),
    ("infra", ("infra", "infrastructure", "adapter", "adapters", "gateway", "gateways"), 50),
    ("cmd", ("cmd", "main"), None),
    ("internal", ("internal", "pkg"), None),
    ("view", ("view", "views", "ui", "frontend", "template", "templates"), 10),
    ("viewmodel", ("viewmodel", "viewmodels", "presenter", "presenters"), 20),
    ("event", ("event", "events", "message", "messages", "queue", "broker", "kafka", "mq"), None),
    ("command", ("command", "commands"), 20),
    ("query", ("query", "queries"), 20),
)
#: Layers of the radar's isolation score: names anywhere in a path, in order.
RADAR_LAYERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("controller", ("controller", "controllers", "handler", "handlers", "api", "routes", "router", "routers", "views", "web")),
    ("service", ("service", "services", "biz", "usecase", "usecases", "application")),
    ("repository", ("repository", "repositories", "repo", "dao", "mapper", "persistence")),
    ("domain", ("domain", "model", "models", "entity", "entities")),
    ("infra", ("infra", "infrastructure", "adapter", "adapters")),
)
#: Layers of dotted module ids: words, rank.
GO_LAYERS: tuple[tuple[str, tuple[str, ...], int], ...] = (
    ("presentation", ("routers", "controller", "controllers", "api", "views", "web"), 1),
    ("application", ("services", "usecase", "usecases"), 2),
    ("domain", ("engines", "domain", "core"), 3),
    ("data", ("models", "entities", "repository", "repositories", "dao"), 4),
    ("infra", ("utils", "helpers", "common", "database", "config"), 5),
)
#: Directories that speak for a clear structure.
CLARITY_DIRS = (
    "controller", "controllers", "service", "services", "repository", "repositories", "dao", "model", "models", "domain", "view",
    "views", "usecase", "usecases", "handler", "handlers", "api",
)
NOISE_SUFFIXES = ("Manager", "Helper", "Util", "Utils", "Wrapper", "Provider", "Service", "Handler")
