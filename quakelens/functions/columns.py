"""Reusable column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA, MIN_SCALE_FRACTION, ABSOLUTE_MIN_SCALE = 1.4826, 0.05, 1e-9  # fixed values
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = 0.35, 0.85  # fixed values


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def error_ratio(failures: Column, requests: Column) -> Column:
    """Failures by request, 0 without requests, to 6 digits."""
    return F.round(F.when(requests > 0, failures / requests).otherwise(0.0), 6)


def robust_scale(median: Column, mad: Column, points: Column, reference: Column | None = None) -> Column:
    """A standard deviation from the median absolute deviation that never falls below a share of the level.

    A series flat at zero takes its scale from the reference level, where one is given.
    """
    floor = F.lit(ABSOLUTE_MIN_SCALE)
    lone = floor if reference is None else F.when(F.coalesce(reference, F.lit(0.0)) != 0, F.abs(reference) * MIN_SCALE_FRACTION).otherwise(floor)
    flat = floor if reference is None else F.when((median == 0) & (F.coalesce(reference, F.lit(0.0)) != 0), F.abs(reference) * MIN_SCALE_FRACTION).otherwise(floor)
    return F.when(points < 2, lone).otherwise(F.greatest(mad * MAD_TO_SIGMA, F.abs(median) * MIN_SCALE_FRACTION, flat))


def robust_z(baseline: Column, incident: Column, scale: Column) -> Column:
    """Signed distance of the incident median from the baseline's, in scales; 0 where a side is missing."""
    return F.coalesce((incident - baseline) / scale, F.lit(0.0))


def directed(signed: Column, direction: Column) -> Column:
    """The part of a signed score that counts for a direction UP, DOWN or EITHER."""
    return F.when(direction == "UP", F.greatest(signed, F.lit(0.0))).when(direction == "DOWN", F.greatest(-signed, F.lit(0.0))).otherwise(F.abs(signed))


def confidence_from_ratio(top: Column, runner_up: Column) -> Column:
    """How far the first of a ranking stands from the second, between floor and ceiling; the floor without a second."""
    spread = CONFIDENCE_CEILING - CONFIDENCE_FLOOR
    scaled = 1.0 - 1.0 / F.greatest(top / runner_up, F.lit(1.0))
    return F.when(runner_up.isNull(), F.lit(CONFIDENCE_FLOOR)).when(runner_up <= 0, F.lit(CONFIDENCE_CEILING)).otherwise(F.round(CONFIDENCE_FLOOR + spread * scaled, 4))


def _falling(n: Column, k: int) -> Column:
    """n (n-1) ... (n-k+1)."""
    product = F.lit(1.0)
    for i in range(k):
        product = product * (n - i)
    return product


def pass_at_k(correct: Column, trials: Column, k: int) -> Column:
    """The chance that one of k trials drawn from those made is correct."""
    return F.when(trials - correct < k, F.lit(1.0)).otherwise(1.0 - _falling(trials - correct, k) / _falling(trials, k))


def pass_hat_k(correct: Column, trials: Column, k: int) -> Column:
    """The chance that all of k trials drawn from those made are correct."""
    return F.when(correct < k, F.lit(0.0)).otherwise(_falling(correct, k) / _falling(trials, k))


#: A word boundary as ASCII has it, whatever the regex library takes for a letter.
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_WORD = "[A-Za-z0-9_]"


def ascii_bounded(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY)


def _bounded_mask(pattern: str) -> str:
    """A mask whose match starts and ends with a word character needs only to look to the outside."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return pattern if inner == pattern else f"(?<!{_WORD}){inner}(?!{_WORD})"


#: Patterns of a log line's variable parts and what stands for them, in this order: fixed values.
MASK = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r'"[^"]*"', "<str>"),
    (r"'[^']*'", "<str>"),
    (r"-?\d+(?:\.\d+)?", "<num>"),
]


#: What a line must hold for any mask to match.
_MASKED = r"""[0-9"']|[a-fA-F]{8}"""


def mask_log(body: Column) -> Column:
    """A log line with its variable parts replaced, so that lines of one kind are equal."""
    found = body
    for pattern, mark in MASK:
        found = F.regexp_replace(found, _bounded_mask(pattern), mark)
    return F.when(body.rlike(_MASKED), found).otherwise(body)


#: Words that say nothing: fixed values.
RUNBOOK_STOPWORDS = "a an the is are was were be been of in on at to for and or with what why how do does did it this that i we".split()
MEMORY_STOPWORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()


def tokens(text: Column, pattern: str, stopwords: list[str]) -> Column:
    """The lower-case words of a text without stopwords, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def runbook_tokens(text: Column) -> Column:
    return tokens(text, "[a-z0-9]+", RUNBOOK_STOPWORDS)


def memory_tokens(text: Column) -> Column:
    return tokens(text, "[a-z0-9][a-z0-9_-]*", MEMORY_STOPWORDS)


#: What text that gives orders looks like, by category: fixed values.
INJECTION = [
    ("imperative", r"(?i)\b(ignore|disregard|forget|override)\b[^.]{0,40}?\b(previous|prior|above|earlier|all)\b[^.]{0,20}?\b(instruction|instructions|prompt|prompts|rule|rules|context)\b"),
    ("imperative", r"(?i)\b(you must|you should now|your new task|new instructions?)\b|\b(assistant|agent|ai|llm|model)\s*[:,]\s*(please\s+)?(restart|disable|delete|drop|execute|run|stop|kill)\b"),
    ("fake_conclusion", r"(?i)\b(root cause (is|found|identified)|the culprit is|no further investigation (is )?(needed|required)|incident (is )?resolved by)\b"),
    ("prompt_structure", r"(?im)(<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|^\s*(system|assistant|user)\s*:\s*you\b)"),
    ("encoded_payload", r"(?i)\b(decode|base64|eval|exec|payload)\b[^\n]{0,40}?[A-Za-z0-9+/]{40,}={0,2}"),
]
OPENING, CLOSING = "<<<untrusted-telemetry>>>", "<<<end-untrusted-telemetry>>>"


def injection_categories(text: Column) -> Column:
    """The distinct categories of orders that a text holds; a closing delimiter counts as prompt structure."""
    found = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in INJECTION]
    found.append(F.when(F.contains(F.lower(text), F.lit(CLOSING)), F.lit("prompt_structure")))
    return F.array_distinct(F.array_compact(F.array(*found)))


def withheld(text: Column) -> Column:
    """The text, or a note with the categories where it gives orders."""
    kinds = injection_categories(text)
    return F.when(F.size(kinds) > 0, F.concat(F.lit("suspicious content, withheld ("), F.array_join(kinds, ", "), F.lit(")"))).otherwise(text)


def wrapped(text: Column, opening: str = OPENING) -> Column:
    """Text in delimiters that it can't close itself."""
    return F.concat(F.lit(opening + "\n"), F.regexp_replace(text, "(?i)" + CLOSING, "[delimiter removed]"), F.lit("\n" + CLOSING))


def question_id(kind: str, query: Column, window_start: Column, window_end: Column, fingerprint: Column) -> Column:
    """ev_<kind>_<12 hex digits> of what was asked, over which window, of which data."""
    text = F.concat_ws("\n", query, iso_utc(window_start), iso_utc(window_end), fingerprint)
    return F.concat(F.lit(f"ev_{kind}_"), F.substring(F.sha2(text, 256), 1, 12))
