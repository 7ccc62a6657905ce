"""Fixed values and level settings shared by the jobs."""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# These must stay as they are for the results to be right.
# ---------------------------------------------------------------------------

IGNORED_DIRS = (
    ".git", ".svn", ".hg", ".bzr",
    "node_modules", "bower_components", "vendor", "packages",
    ".npm", "jspm_packages", "pnpm-store", ".yarn",
    "venv", ".venv", "env", "virtualenv", ".virtualenv",
    ".tox", ".direnv", "__pypackages__",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".coverage",
    "build", "dist", "out", "bin", "obj", "target",
    "Debug", "Release", "x64", "x86", "lib", ".cache",
    ".idea", ".vscode", ".vs", ".fleet",
    ".settings", ".config", ".vagrant", "__snapshots__",
    ".terraform", ".next", ".nuxt",
    ".github", ".husky", ".storybook",
)

IGNORED_NAMES = (
    "README.md", "README.txt", "README",
    "LICENSE", "LICENSE.txt", "LICENSE.md",
    "CHANGELOG.md", "CONTRIBUTING.md",
    "package-lock.json", "yarn.lock", "bun.lockb",
    "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock",
    "composer.lock", "Gemfile.lock", "cargo.lock",
    ".npmrc", ".yarnrc",
    ".DS_Store", "Thumbs.db", ".gitignore",
    "tsconfig.json", "jsconfig.json",
    ".editorconfig", ".eslintcache", ".eslintrc",
    ".prettierrc", ".babelrc",
)

IGNORED_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff",
    ".tif", ".psd", ".raw", ".heif", ".jfif", ".pct", ".pic", ".pict", ".pntg",
    ".svgz",
    ".vsdx", ".vsd", ".vss", ".vst", ".vdx", ".vsx", ".vtx", ".vssx", ".vstx",
    ".vsw", ".vsta", ".ai", ".eps", ".indd",
    ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv", ".wmv", ".mkv",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".min.js", ".min.css", ".map",
    ".sqlite", ".db", ".log",
)

LANGUAGE_BY_EXT = {
    ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".jsx": "react", ".tsx": "react", ".java": "java", ".rb": "ruby",
    ".go": "go", ".rs": "rust", ".php": "php", ".cs": "csharp",
    ".cpp": "cpp", ".c": "c", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".html": "html", ".css": "css", ".json": "json",
    ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".sh": "bash",
    ".sql": "sql",
}

README_NAMES = ("README.md", "README.txt", "README")
README_MISSING = "README not found."

# Entry points (score 10) and core-language extensions (score 8).
ENTRY_POINT_NAMES = ("main.py", "app.py", "index.js", "server.js", "app.js")
CORE_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx")

SKIPPED_SUMMARY_PATH = "_SKIPPED_FILES_SUMMARY.txt"
BINARY_PLACEHOLDER = "Skipped binary file"
BINARY_BY_SUFFIX_PLACEHOLDER = "Skipped binary file (based on extension)"
MISSING_ENCODING_PLACEHOLDER = "Skipped due to missing encoding"

# Text layout of a report.
README_HEADER = "README:\n"
STRUCTURE_HEADER = "Structure:\n"
FILES_HEADER = "File Contents:\n"
SUMMARY_HEADER = "Repository Analysis Summary:\n"

# ---------------------------------------------------------------------------
# Reduction levels.  The thresholds of LEVELS are fixed values: results depend on them.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """Thresholds of one reduction level.

    Heavy reduction keeps the ``keep_files`` most important files of a repository with
    more than ``keep_whole_up_to``; with ``keep_files=None`` it keeps and reduces all.
    """

    name: str
    min_lines: int
    import_threshold: int
    duplicate_threshold: int
    max_lines: int
    class_methods: int
    heavy: bool = False
    keep_whole_up_to: int = 20
    keep_files: int | None = 15


LEVELS = {
    "default": Level("default", 15, 5, 3, 500, 3),
    "light": Level("light", 40, 10, 8, 1000, 8),
    "medium": Level("medium", 25, 8, 5, 750, 5),
    "heavy": Level("heavy", 5, 3, 2, 300, 2, heavy=True),
}
LEVELS["heavy_all"] = replace(LEVELS["heavy"], name="heavy_all", keep_files=None)
