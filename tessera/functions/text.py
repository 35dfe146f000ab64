"""Text expressions: markers, tags, sanitizers, chunk kinds.  ASCII classes only, so other SQL engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marker patterns, counted without regard to case.
MARKERS = {
    "todo": "todo|fixme_later",
    "fixme": "fixme|xxx|hack",
    "deprecated": "deprecated|obsolete|legacy",
    "tests": "test|assert",
    "security": "password|secret|token|api[_-]?key",
    "license": "license|copyright",
}
#: Prompt-injection patterns, met without regard to case; other detectors must find the same texts.
INJECTION = [
    r"ignore\s+(?:previous|prior|all|your)\s+instructions?", r"disregard\s+(?:previous|prior|all|your)\s+(?:instructions?|prompts?)", r"forget\s+(?:everything|all|your)\s+(?:above|before|prior)",
    r"system\s*(?:prompt|message|instruction)", r"you\s+are\s+(?:now|actually)\s+a?\s*(?:different|new)", r"your\s+(?:role|purpose|function)\s+is\s+(?:now|actually)",
    r"(?:pretend|imagine|roleplay)\s+(?:you|to)\s+(?:are|be)", r"act\s+(?:as|like)\s+(?:a|an)?", r"simulate\s+(?:a|an|being)\s+",
    r"developer\s+mode", r"debug\s+mode", r"admin\s+mode", r"sudo\s+mode",
    r"what\s+(?:are|were)\s+(?:your|the)\s+(?:instructions|prompts?)", r"show\s+me\s+(?:your|the)\s+(?:system|original)\s+prompt", r"repeat\s+(?:your|the)\s+(?:instructions|prompt)",
    r"<\s*script\s*>", r"javascript\s*:", r"eval\s*\(", r"exec\s*\(",
    r"union\s+select", r"drop\s+table", r"delete\s+from", r"insert\s+into",
    r";\s*(?:rm|cat|ls|pwd|whoami)", r"\|\s*(?:nc|netcat|curl|wget)", r"`[^`]*`",
    r"\{\{.*\}\}", r"\{%.*%\}", r"\$\{.*\}",
]
#: Suffix to language.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "md": "markdown", "html": "html", "txt": "text"}


def marker_counts(text) -> list[Column]:
    return [F.regexp_count(F.lower(text), F.lit(p)).cast("long").alias(f"{name}_count") for name, p in MARKERS.items()]


def complexity(lines, sentences, capitals) -> Column:
    """Weighted saturating sum in 0..1, two decimals."""
    return F.round(F.least(F.lit(1.0), lines / 500 * 0.4 + sentences / 100 * 0.4 + capitals / 200 * 0.2), 2)


def chunk_type(text) -> Column:
    """Kind of a chunk from its first line."""
    line = F.trim(F.substring_index(text, "\n", 1))
    low = F.lower(line)
    return (F.when(low.startswith("class "), "class").when(low.startswith("def ") | low.contains("function "), "function").when(low.startswith("import ") | low.startswith("from "), "import")
            .when(low.contains("licen"), "license").when(line.startswith("#"), "heading").otherwise("text"))


def slug(name) -> Column:
    """Lower case, other characters to single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_id(text) -> Column:
    """Integer of the first 15 hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def line_number(text, offset) -> Column:
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def glob_regex(pattern: str) -> str:
    """A whole-path regex of a glob whose star also crosses slashes."""
    out = []
    for c in pattern:
        out.append(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c)
    return "^" + "".join(out).replace(".*.*", ".*") + "$"
