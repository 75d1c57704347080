"""Column functions over text: reliability classifier, sanitiser, hashes, entity types."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions whose matches define the results, by category, in order; all ignore case.
PATTERNS: dict[str, list[str]] = {
    "terminal_artifact_patterns": [
        r"\x1b\[[0-9;]*[A-Za-z]",
        r"(?m)^\s*-e\s+.*\x1b\[",
        r"(?m)^\s*-e\s+.*\bOS:\b.*\bVersion:\b",
        r"(?m)^\s*(?:-e\s+)?🖥️\s+.*\bOS:\b",
        r"(?m)^\s*(?:-e\s+)?🏠\s+.*\bHostname:\b",
        r"(?m)^\s*(?:-e\s+)?💡\s+.*\bIP Address:\b",
        r"(?m)^\s*(?:OS|Hostname|IP Address):\s+",
        r"\b(?:fastfetch|neofetch)\b",
    ],
    "fabrication_patterns": [
        r"\b(?:installed|deployed|created|configured|set up)\b.*\b(?:successfully|complete|done)\b",
        r"✅.*\b(?:operational|running|active|ready|complete)\b",
        r"\b(?:launched|initialized|activated)\b.*\b(?:diagnostics|session|system)\b",
        r"\b(?:achieves?|reaches?)\s+\d+%",
        r"\b\d+(?:\.\d+)?x\s+(?:speedup|faster|improvement)\b",
    ],
    "fake_tech_patterns": [
        r"\bfrom\s+local_llm\s+import\b",
        r"\bllm[\-_]cpp\b",
        r"\bCodeCritique\b",
        r"\bfastembed\b",
        r"\bMistral-7B.*\.gguf\b",
        r"\bclawhub\.ai\b",
    ],
    "retraction_patterns": [
        r"\bactually,?\s+(?:that's|this is|it's)\s+(?:not|wrong|incorrect)\b",
        r"\bcorrection:\b",
        r"\bignore\s+(?:the\s+)?(?:above|previous)\b",
        r"\bdisregard\b",
    ],
    "speculation_patterns": [
        r"\bi\s+(?:think|believe|guess)\s+(?:the|this|that|it)\b",
        r"\bprobably\s+(?:should|need|would|requires?)\b",
        r"\bi'm\s+(?:guessing|assuming)\b",
        r"\bnot sure (?:if|whether|about)\b",
        r"\bunverified\b",
        r"\bunconfirmed\b",
    ],
    "leaked_tag_patterns": [
        r"<[a-zA-Z_][\w.-]*(?:\s[^>]*)?>",
        r"</[a-zA-Z_][\w.-]*>",
    ],
    "placeholder_patterns": [
        r"\byour-\w+-here\b",
        r"\b\[(?:PLACEHOLDER|TODO|FIXME|INSERT)\]\b",
        r"\bexample\.com\b",
        r"\byour-nextcloud\.example\.com\b",
    ],
    "error_patterns": [
        r"\berror\b.*\b(?:occurred|happened|found|detected)\b",
        r"\bfailed?\b.*\b(?:to|when|because)\b",
        r"\bfailure\b",
        r"\bdoes.*not.*work\b",
        r"\bdoesn't work\b",
        r"\bnot working\b",
        r"\bbroken\b",
        r"\bcrash(?:es|ed|ing)?\b",
    ],
    "bad_command_patterns": [
        r"\bcommand\b.*\b(?:not found|syntax error|invalid|unknown)\b",
        r"\bsyntax\b.*\b(?:error|incorrect|wrong|invalid)\b",
        r"\binvalid\b.*\b(?:command|option|flag|argument|syntax)\b",
        r"\bunknown\b.*\b(?:command|option|flag|argument)\b",
        r"\bpermission denied\b",
        r"\bno such file or directory\b",
        r"\bcommand not found\b",
    ],
    "error_loop_patterns": [
        r"\btried\b.*\bbut\b.*\b(?:failed|didn't work|error)\b",
        r"\battempted\b.*\b(?:without success|unsuccessfully)\b",
        r"\bkeeps? (?:failing|crashing|erroring)\b",
        r"\bstill (?:broken|failing|not working)\b",
        r"\bpreviously failed\b",
        r"\blast time.*\b(?:failed|broke|crashed|error)\b",
    ],
    "deprecated_patterns": [
        r"\bdeprecated\b",
        r"\bobsolete\b",
        r"\bno longer (?:works|supported|valid|available)\b",
        r"\bold (?:method|approach|way|syntax|command)\b",
        r"\breplaced by\b",
        r"\bworkaround\b.*\b(?:for|is needed)\b",
    ],
    "stale_state_patterns": [
        r"\bdocker\b.*\btailscale\b.*\b(?:needed|required|setup|configure)\b",
        r"\btailscale\b.*\bdocker\b.*\b(?:needed|required|setup|configure)\b",
        r"\bCNC\b.*\b(?:requires|needs|setup|config)\b",
        r"\bthe (?:correct|right|proper) (?:path|command|config|setup) is\b",
        r"\bpath\b.*\b(?:should be|needs to be|is set to)\b",
        r"\bcurrently (?:set to|configured as|running|using)\b.*\b(?:version|port|path)\b",
        r"\bverified that\b.*\b(?:works|is correct|is set)\b",
        r"\bconfirmed\b.*\b(?:working|correct|set up)\b",
    ],
}
# What makes a terminal artefact certain; a session log's marks; what ends an assistant's lines.
SYSINFO = r"(?m)^\s*(?:-e\s+)?(?:🖥️|🏠|💡)?\s*(?:OS:|Hostname:|IP Address:)\b"
FETCH = r"(?i)\b(?:fastfetch|neofetch)\b"
ECHO = r"(?m)^\s*-e\s+.*\x1b\["
SESSION, SESSION_KEY = r"(?m)^#\s+Session:", r"(?m)^- \*\*Session Key\*\*:"
NOT_ASSISTANT = r"^(?:user:|\[Telegram\b|System:|-e\s|\x1b\[|```|#\s|- \*\*Session)"
TERMINAL, TAGS = "terminal_artifact_patterns", "leaked_tag_patterns"

# The sanitiser's removals, in order.
PLATFORM = r"(?i)^\s*\[(?:Telegram|Discord|WhatsApp|Signal|Slack|IRC|Matrix)\s[^\]]*\]\s*"
REMOVALS = (
    PLATFORM,
    r"(?m)^\s*(?:user:\s*)?\[(?:Telegram|Discord|WhatsApp|Slack)\b[^\]]*\]\s*$",
    r"(?m)^\s*(?:user|assistant|system):\s*$",
    r"\bid:\d{5,}",
    r"[+-]\d+h\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+GMT[+-]\d+",
)
TAG = r"</?[a-zA-Z_][\w.-]*(?:\s[^>]*)?>"


def like_python(pattern: str) -> str:
    """The pattern as Python reads it: classes and word boundaries of all scripts, and only ``\\n`` ends a line."""
    return "(?dU)" + pattern


#: What Python takes for white space.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end; Spark's trim() knows only blanks."""
    return F.btrim(c, F.lit(SPACES))


def let(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def assistant_text(text: Column) -> Column:
    """The assistant's lines of a session log, stripped, non-empty, joined by line ends."""
    from . import verdict as V

    return F.arrow_udf(V.assistant_batch, "string")(text)


def verdict(text: Column) -> Column:
    """struct<is_flagged, confidence, severity, patterns, categories>: whether a text is unfit as a memory.

    Null and empty texts are not flagged.  Of a session log only the assistant's lines
    are judged, but for terminal artefacts.  Runs on Arrow batches: the patterns are
    defined by Python's regular expressions, and its search for the words that a pattern
    needs, before the pattern, takes an eighth of the time of the JVM's.
    """
    from . import verdict as V

    return F.arrow_udf(V.judge_batch, V.FIELDS)(text)


def sanitize(text: Column) -> Column:
    """Chat metadata, bare role markers, platform ids and timestamps removed, blank lines collapsed, stripped."""
    for p in REMOVALS:
        text = F.regexp_replace(text, like_python(p), "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_meta(text: Column) -> Column:
    return stripped(F.regexp_replace(text, like_python(PLATFORM), ""))


def has_tags(text: Column) -> Column:
    return text.rlike(like_python(TAG))


def remove_tags(text: Column) -> Column:
    return F.regexp_replace(text, like_python(TAG), "")


def concept_tokens(text: Column) -> Column:
    """Distinct lower-case words of four or more letters, digits or underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1)))


def accents() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without, from their Unicode decompositions."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms(text: Column) -> Column:
    """Search terms: lower case, without marks, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *accents()), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def term_finder():
    """A function of a text, or null, that gives its search terms in order; for Python workers."""
    import re

    marks, find = str.maketrans(*accents()), re.compile(r"[^\W_]+").findall

    def words(t: str | None) -> list[str]:
        low = (t or "").lower()
        return find(low if low.isascii() else low.translate(marks))

    return words


def term_counts(text: Column, wanted: list[str]) -> Column:
    """array<long>: how many search terms a text has, then how many of them have the stem of each wanted term.  Runs on Arrow batches."""
    import pyarrow as pa

    from .stem import Stems

    stem, find = Stems(), term_finder()
    stems = [stem[w] for w in wanted]
    heads = tuple({s[:-1] or s for s in stems})  # a stem differs from its word's beginning in its last letter at most

    def count(t: str | None) -> list[int]:
        words = find(t)
        near = [stem[w] for w in words if w.startswith(heads)]
        return [len(words), *(near.count(s) for s in stems)]

    return F.arrow_udf(lambda texts: pa.array([count(t) for t in texts.to_pylist()], pa.list_(pa.int64())), "array<bigint>")(text)


# Names and substrings that tell an entity's type.
AGENTS = ("agent", "system", "max", "user", "assistant")
SERVICES = ("postgres", "redis", "nextcloud", "ollama", "gateway", "stt", "embedding", "tts")
SUFFIXES = (".py", ".md", ".json", ".sh", ".txt")


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def entity_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.isin(*AGENTS), "agent")
        .when(low.contains("skill") | name.startswith("skills/"), "skill")
        .when(_any(name, (".py", ".sh")) | name.startswith("tools/") | name.startswith("scripts/"), "tool")
        .when(_any(low, SERVICES), "service")
        .when(low.contains("api_key"), "api")
        .when(low.contains("cron"), "cron")
        .when(_any(name, SUFFIXES), "file")
        .otherwise("other")
    )


def subject_type(name: Column) -> Column:
    """As entity_type(), with a few more names."""
    low = F.lower(name)
    return (
        F.when(low.isin(*AGENTS, "me"), "agent")
        .when(low.contains("skill") | (name.contains("/") & name.startswith("skills")), "skill")
        .when(_any(name, (".py", ".sh", "tools/", "scripts/")), "tool")
        .when(_any(low, (*SERVICES, "dashboard")), "service")
        .when(low.contains("api_key"), "api")
        .when(_any(low, ("cron", "scheduled")), "cron")
        .when(_any(name, SUFFIXES), "file")
        .otherwise("other")
    )


def normalize_entity(name: Column) -> Column:
    c = F.regexp_replace(stripped(name), like_python(r"^[-*]\s*"), "")
    c = F.regexp_replace(F.regexp_replace(c, "`", ""), like_python(r"\s+"), " ")
    return F.substring(F.regexp_replace(c, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""), 1, 80)


# What a question may name, and words that count as names.
QUESTION_PATTERNS = (
    r"skills?/([a-zA-Z0-9_-]+)",
    r"([a-zA-Z0-9_-]+)_skill",
    r"tools?/([a-zA-Z0-9_]+\.py)",
    r"scripts?/([a-zA-Z0-9_]+\.sh)",
    r"(postgres|redis|nextcloud|ollama|gateway)",
    r"(OPENAI_API_KEY|GROQ_API_KEY|GEMINI_API_KEY|PERPLEXITY_API_KEY)",
)
QUESTION_WORDS = ("skill", "browser", "tts", "stt", "healthcheck", "opencode", "perplexity", "command", "tool", "script")


def _all_of(text: Column, low: Column, pattern: str) -> Column:
    """All first groups of a pattern, whatever their case; texts without the words that it needs are not searched."""
    from .verdict import needles

    may = F.lit(True)
    for words in needles(pattern):
        may = may & _any(low, [w.lower() for w in words])
    found = F.regexp_extract_all(text, F.lit(like_python("(?i)" + pattern)), F.lit(1))
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def question_entities(text: Column) -> Column:
    """Entities that a question names, lower case, distinct, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [_all_of(text, low, p) for p in QUESTION_PATTERNS]
    words = F.filter(F.array(*[F.when(low.contains(w), F.lit(w)) for w in QUESTION_WORDS]), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found, words), lambda x: F.lower(x))))


# Patterns by which entities of a type are found in text; the first group is the entity.
ENTITY_PATTERNS = {
    "skill": (r"skills/([a-zA-Z0-9_-]+)/?", r"`?([a-z]+-[a-z]+)_skill`?", r"skill[:\s]+([a-zA-Z0-9_-]+)"),
    "tool": (r"tools/([a-zA-Z0-9_]+\.py)", r"scripts/([a-zA-Z0-9_]+\.sh)", r"`([a-zA-Z0-9_]+\.py)`", r"`([a-zA-Z0-9_]+\.sh)`"),
    "file": (r"`([^`]+\.(?:py|md|json|sh|txt|yml|yaml))`", r"([a-zA-Z0-9_/-]+\.(?:py|md|json|sh|txt|yml|yaml))"),
    "service": (r"(postgres|postgresql)", r"(redis)", r"(nextcloud)", r"(ollama)", r"(openclaw[_-]?gateway)", r"(embedding[_-]?server)", r"(stt[_-]?server)", r"(tts[_-]?gen)", r"(dashboard)"),
    "api": (r"(OPENAI_API_KEY)", r"(GROQ_API_KEY)", r"(GEMINI_API_KEY)", r"(PERPLEXITY_API_KEY)", r"(OPENROUTER_API_KEY)"),
    "port": (r"port[=:\s]+(\d{4,5})", r"(\d{4,5})[=:\s]+\w+"),
    "cron": (r"cron[job]*[:\s]+([a-zA-Z0-9_-]+)", r"scheduled[:\s]+([a-zA-Z0-9_-]+)"),
}


def entities(text: Column, kind: str) -> Column:
    """Distinct normalised entities of a kind, sorted."""
    found = [_all_of(text, F.lower(F.coalesce(text, F.lit(""))), p) for p in ENTITY_PATTERNS[kind]]
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(*found), lambda x: x != ""), normalize_entity)))


TELEGRAM = r"\[Telegram\s.*?(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2})\s+GMT([+-]?\d+)"


def telegram_epoch(text: Column) -> Column:
    """Seconds since 1970 of the first chat timestamp, null without one."""
    day, hour, zone = (F.regexp_extract(text, like_python(TELEGRAM), k) for k in (1, 2, 3))
    at = F.unix_timestamp(F.concat_ws(" ", day, hour), "yyyy-MM-dd HH:mm")
    return F.when(text.rlike(like_python(TELEGRAM)), at - F.regexp_replace(zone, r"^\+", "").cast("long") * 3600)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
