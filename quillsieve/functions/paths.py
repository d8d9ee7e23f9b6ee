"""What a path says: AI tools, sensitive names, technologies, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions.text import java_regex
from quillsieve.patterns import SENSITIVE_NAME, TECH_CONTENT, TECH_NAMES

# Path shapes of AI tools, their kinds, and what each kind is reported as.
AI_SCOPE = r"(^|/)\.(claude|cursor|continue|windsurf)/|\.aider|\.github/(copilot|prompts)|/copilot-instructions\.md"
AI_KINDS = (
    ("credential", r"/credentials?|/secrets?|/tokens?|/api_?key|\.env|/auth\.json", "AI credential/token path exposed", "HIGH"),
    ("prompt_history", "prompt|history|chat|conversation", "AI prompt/history path exposed", "MEDIUM"),
    ("state", "cache|state|session|workspace", "AI runtime state/session path exposed", "LOW"),
    ("config", "", "AI configuration path exposed", "MEDIUM"),
)
AI_TOOLS = (("claude", r"\.claude/"), ("cursor", r"\.cursor/"), ("continue", r"\.continue/"), ("aider", r"\.aider|/aider"), ("windsurf", r"\.windsurf/"), ("copilot", r"copilot|\.github/prompts"))
AI_PROVIDERS = ("openai", "anthropic", "huggingface", "cohere", "openrouter", "groq")


def plain(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def ai_kind(path: Column) -> Column:
    """credential, prompt_history, state or config for paths of AI tools, else null."""
    p = plain(path)
    out = F.lit("config")
    for name, regex, _, _ in reversed(AI_KINDS[:-1]):
        out = F.when(p.rlike(regex), name).otherwise(out)
    return F.when(p.rlike(AI_SCOPE), out)


def of_kind(kind: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for row in AI_KINDS:
        out = F.when(kind == row[0], row[which]).otherwise(out)
    return out


def is_sensitive(path: Column) -> Column:
    return path.rlike(java_regex(SENSITIVE_NAME)) | ai_kind(path).isNotNull()


def ai_metadata(pattern_id: Column, path: Column) -> Column:
    """struct<ai_related, ai_category, ai_tags> of a finding."""
    provider = F.when(pattern_id == "ai_provider_env_key", "multi_provider")
    for name in AI_PROVIDERS:
        provider = provider.when(F.startswith(pattern_id, F.lit(name)), name)
    kind = F.when(F.startswith(pattern_id, F.lit("ai_path_")), F.substring(pattern_id, 9, 100)).otherwise(F.concat(ai_kind(path), F.lit("_path")))
    p = plain(path)
    tools = F.array_compact(F.array(*[F.when(p.rlike(regex), name) for name, regex in AI_TOOLS]))
    tags = F.when(provider.isNotNull(), F.array(F.lit("ai"), F.lit("key_material"), provider)).when(kind.isNotNull(), F.concat(F.array(F.lit("ai"), F.lit("path"), kind), tools)).otherwise(F.array().cast("array<string>"))
    return F.struct((provider.isNotNull() | kind.isNotNull()).alias("ai_related"), F.when(provider.isNotNull(), "provider_key").otherwise(kind).alias("ai_category"), tags.alias("ai_tags"))


def tech_of_name(path: Column) -> Column:
    return F.array_compact(F.array(*[F.when(path.rlike(java_regex(r)), name) for name, r in TECH_NAMES]))


def tech_of_content(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike("(?d)" + r), name) for name, r in TECH_CONTENT]))


# Extensions of binary content, archives and databases first.
BINARY_EXTENSIONS = (
    "db", "sqlite", "sqlite3", "zip", "jar", "war", "ear", "whl", "gz", "tar", "tgz", "tbz", "tbz2", "txz", "bz2", "xz", "7z", "rar",
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "tiff", "avif", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp",
    "exe", "dll", "so", "dylib", "bin", "wasm", "o", "a", "lib", "obj", "mp3", "mp4", "wav", "ogg", "flac", "avi", "mov", "mkv", "webm", "m4a",
    "ttf", "otf", "woff", "woff2", "eot", "pyc", "pyo", "class",
)
# Technologies by parts of a local path, and the ending that a provider's path must have instead.
LOCAL_TECH = (
    ("Python", ("requirements.txt", "setup.py", "Pipfile", "pyproject.toml", "manage.py"), ()),
    ("Node.js", ("package.json", "yarn.lock", "package-lock.json", ".nvmrc"), ()),
    ("PHP", ("composer.json", "composer.lock"), (".php",)),
    ("Ruby", ("Gemfile", ".ruby-version", "Rakefile"), (".rb",)),
    ("Java", ("pom.xml", "build.gradle"), (".java",)),
    ("Go", ("go.mod", "go.sum"), (".go",)),
    ("Rust", ("Cargo.toml", "Cargo.lock"), (".rs",)),
    (".NET", (".csproj", ".sln", "web.config"), ()),
    ("Docker", ("Dockerfile", "docker-compose"), ()),
    ("Terraform", ("terraform.tfvars",), (".tf",)),
)


def is_binary_name(path: Column) -> Column:
    """Whether the part after the last dot (of a name without one the whole name) is a binary extension."""
    return F.lower(F.substring_index(path, ".", -1)).isin(*BINARY_EXTENSIONS)


def tech_of_path(path: Column, exact: bool = False) -> Column:
    """Technologies by a path's parts; ``exact`` wants extensions at its end, as for a provider's paths."""
    out = []
    for name, parts, endings in LOCAL_TECH:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(path, F.lit(p))
        for e in endings:
            hit = hit | (F.endswith(path, F.lit(e)) if exact else F.contains(path, F.lit(e)))
        out.append(F.when(hit, name))
    return F.array_compact(F.array(*out))


def safe_path(path: Column) -> Column:
    """The path without empty, dot and parent parts; null if it holds a NUL or nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    return F.when(~F.contains(path, F.lit("\0")) & (F.size(parts) > 0), F.array_join(parts, "/"))


def strict_path(path: Column) -> Column:
    """The path if no part climbs or is empty, else null."""
    parts = F.split(path, "/")
    return F.when((path != "") & ~F.contains(path, F.lit("\0")) & ~F.exists(parts, lambda x: x.isin("", ".", "..")), path)


def is_valid_sha(x: Column) -> Column:
    return x.rlike(r"\A[0-9a-fA-F]{40}\z")


def tree_kind(mode: Column) -> Column:
    """blob, tree or commit (a gitlink) by a tree entry's mode; null for others."""
    m = F.ltrim(mode, F.lit("0"))
    return F.when(m.isin("100644", "100755", "120000"), "blob").when(m == "40000", "tree").when(m == "160000", "commit")


def glob_regex(selector: Column) -> Column:
    """A case-blind regex of a name selector with * and ?."""
    quoted = F.regexp_replace(selector, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit(r"(?i)\A"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


