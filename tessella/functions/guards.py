"""Text guards as Column expressions: injection, encoding and leakage checks, scrubbing, caps.

Patterns are written for Java with ``(?U)``, so that classes are those of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words, limits and texts of the guards.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"you\s+are\s+now\s+(in\s+)?developer\s+mode",
    r"system\s+override",
    r"reveal\s+(your\s+)?(system\s+)?prompt",
    r"repeat\s+(the\s+)?(text|instructions?)\s+(above|before)",
    r"what\s+(are|were)\s+your\s+(exact\s+)?instructions",
    r"act\s+as\s+if\s+you.*(not|no)\s+bound",
    r"do\s+anything\s+now",
    r"jailbreak",
    r"DAN\s+mode",
    r"pretend\s+you\s+(are|have)\s+no\s+(restrictions?|rules?|limits?)",
    r"disregard\s+(all\s+)?(safety|previous|prior|your)",
    r"bypass\s+(all\s+)?(safety|filters?|restrictions?|rules?)",
)
KEYWORDS = ("ignore", "bypass", "override", "reveal", "delete", "system", "inject", "jailbreak", "prompt")
LEAKAGE = (
    r"you\s+are\s+{assistant}.*data\s+analysis",
    r"##\s*(Rules|Dataset|Cache Context)",
    r"ALWAYS\s+use\s+tools\s+to\s+compute",
    r"SYSTEM_INSTRUCTIONS?:",
    r"my\s+(system\s+)?instructions?\s+(are|say|tell)",
)
SCRUBS = (
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"(?U)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CARD_REDACTED]"),
    (r"(?iU)(?:api[_-]?key|secret|token|password)\s*[:=]\s*\S+", "[SECRET_REDACTED]"),
    (r"(?iU)/(?:home|app|usr|etc|var|tmp)/[\w/.]+", "[PATH_REDACTED]"),
)
INVISIBLE = "​‌‍‎‏⁠⁡⁢⁣⁤﻿"
IMAGES = (r"(?U)!\[[^\]]*\]\(\s*(?:data:image/[^\)]*|BASE64:[^\)]*)\)?", r"(?U)(?:data:image/\S+|BASE64:\S+)", r"(?U)!\[[^\]]*\]\s*\(\s*$")
DECODED_WORDS = "ignore|system|prompt|override|bypass"
MAX_INPUT, MAX_OUTPUT, PREVIEW = 2000, 10_000, 200
TRUNCATED = "\n\n[Response truncated]"
REFUSAL = "I'm unable to share that information. How can I help you with the dataset?"
NO_ANSWER = "I wasn't able to generate a response. Try rephrasing your question."
INTERNAL_ERROR = "An internal error occurred. Please try again."
TRACEBACK = "Traceback (most recent call last)"


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike("(?iU)" + p) for p in patterns])


def injection(c: Column) -> Column:
    return _any(c, INJECTION)


def leakage(c: Column, assistant: str = r"\w+") -> Column:
    """``assistant``: pattern of the assistant's name in its own prompt."""
    return _any(c, tuple(p.replace("{assistant}", assistant) for p in LEAKAGE))


def strip_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def scrambled(c: Column) -> Column:
    """Whether a word has a keyword's length, first, last and inner letters, but is not it."""
    sign = lambda w: (w[0], w[-1], "".join(sorted(w[1:-1])))
    signs = F.array(*[F.lit("\x00".join(sign(k))) for k in KEYWORDS])
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w+)\b"), 1)
    own = lambda w: F.concat_ws("\x00", F.substring(w, 1, 1), F.right(w, F.lit(1)), F.array_join(F.array_sort(F.split(w.substr(F.lit(2), F.length(w) - 2), "")), ""))
    return F.exists(words, lambda w: (F.length(w) >= 4) & ~w.isin(*KEYWORDS) & F.array_contains(signs, own(w)))


def encoded_injection(c: Column) -> Column:
    """Whether a base64 run decodes to text with a telling word; runs Python would refuse are skipped."""
    runs = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9+/]{20,}={0,2})"), 1)

    def tells(x: Column) -> Column:
        body = F.rtrim(x, F.lit("="))
        n, p = F.length(body), F.length(x) - F.length(body)
        valid = (n % 4 == 0) | ((n % 4 == 3) & (p >= 1)) | ((n % 4 == 2) & (p == 2))
        text = F.make_valid_utf8(F.try_to_binary(F.rpad(body, (F.ceil(n / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string"))
        return valid & F.coalesce(F.lower(F.replace(text, F.lit("�"), F.lit(""))).rlike(DECODED_WORDS), F.lit(False))

    return F.exists(runs, tells)


def input_reason(c: Column) -> Column:
    """Why a message is refused, the first reason in order, or null.  Length counts before stripping."""
    clean = strip_invisible(c)
    return (
        F.when(F.length(c) > MAX_INPUT, "Message too long")
        .when(injection(clean) | scrambled(clean), "prompt_injection_detected")
        .when(encoded_injection(clean), "encoded_injection_detected")
    )


def scrub(c: Column) -> Column:
    """Personal data and secrets replaced, in the fixed order."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1].replace("[", r"\[")), SCRUBS, c)


def truncate(c: Column, limit: int = MAX_OUTPUT, mark: str = TRUNCATED) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def strip_images(c: Column) -> Column:
    return F.regexp_replace(reduce(lambda x, p: F.regexp_replace(x, p, ""), IMAGES, c), r"(?U)^\s+|\s+$", "")


def canned(c: Column) -> Column:
    """Fixed texts for an empty answer and for one that shows a traceback."""
    return F.when(c.isNull() | (F.regexp_replace(c, r"(?U)\s", "") == ""), NO_ANSWER).when(F.contains(c, F.lit(TRACEBACK)), INTERNAL_ERROR).otherwise(c)


def output_guard(c: Column, assistant: str = r"\w+", refusal: str = REFUSAL) -> Column:
    """The text to show: refusal on leakage, else scrubbed and capped; null and empty pass."""
    return F.when(leakage(c, assistant), F.lit(refusal)).otherwise(truncate(scrub(c)))


def answer_text(c: Column, order: str = "strip_first") -> Column:
    """The whole output path: ``strip_first`` (one reply) or ``guard_first`` (streamed reply)."""
    start = canned(c)
    return output_guard(strip_images(start)) if order == "strip_first" else strip_images(output_guard(start))


def valid_request(session: Column, message: Column, role: Column | None = None) -> Column:
    """Session id of one character or more, message of 1 to 2000, role user or assistant; null fails."""
    ok = (F.length(session) >= 1) & F.length(message).between(1, MAX_INPUT)
    if role is not None:
        ok = ok & role.isin("user", "assistant")
    return F.coalesce(ok, F.lit(False))
