"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take for white space.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_for_matching(text: Column) -> Column:
    """Lower case, plain apostrophes, punctuation and runs of white space as one space, stripped."""
    low = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    words = F.regexp_replace(low, r"[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", " ")
    return strip(F.regexp_replace(words, f"{SPACE}+", " "))


def is_mostly_uppercase(text: Column) -> Column:
    """At least three letters that have a case, and none of them lower; null gives false.

    Letters whose upper and lower forms are equal do not count.
    """
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    chars = F.filter(F.split(letters, ""), lambda c: (c != "") & (F.upper(c) != F.lower(c)))
    upper = F.size(F.filter(chars, lambda c: c == F.upper(c)))
    lower = F.size(F.filter(chars, lambda c: (c != F.upper(c)) & (c == F.lower(c))))
    # one small Latin letter settles it, and most texts have one: no look at each character then
    return F.coalesce(F.when(text.rlike("[a-z]"), F.lit(False)).otherwise((upper + lower >= 3) & (lower == 0)), F.lit(False))


def normalize_segment_text(text: Column) -> Column:
    """Stripped; all-caps texts lowered."""
    plain = strip(text)
    return F.when(is_mostly_uppercase(plain), F.lower(plain)).otherwise(plain)


def text_from_words(words: Column, field: str = "word") -> Column:
    """Stripped non-blank words joined by spaces, all-caps lowered."""
    parts = F.filter(F.transform(words, lambda w: strip(w[field])), lambda w: w != "")
    return normalize_segment_text(F.array_join(parts, " "))


def normalize_language(language: Column) -> Column:
    """Stripped; blank and ``auto`` are null."""
    plain = strip(language)
    return F.when(~F.lower(plain).isin("", "auto"), plain)


def trusted_language(language: Column, probability: Column, least: float = 0.5) -> Column:
    """The language if its probability is ``least`` or more, else ``unknown``; null probability is 0."""
    ok = (F.coalesce(probability, F.lit(0.0)) >= least) & (F.coalesce(language, F.lit("")) != "")
    return F.when(ok, language).otherwise(F.lit("unknown"))


def alignment_language(configured: Column, override: Column, languages: Column) -> Column:
    """Configured, else a valid override, else the first known of ``languages``, else ``en``."""
    ok = F.when(~F.lower(override).isin("", "auto", "unknown"), override)
    known = F.get(F.filter(languages, lambda x: x.isNotNull() & ~x.isin("", "unknown")), F.lit(0))
    return F.coalesce(F.when(configured != "", configured), ok, known, F.lit("en"))


#: Labels with one of these in them are of the speech family (fixed values).
SPEECH_STEMS = ("speech", "conversation", "narration", "monologue", "babbling")


def is_speech_label(label: Column) -> Column:
    return F.lower(label).rlike("|".join(SPEECH_STEMS))


def prompt_relevant(label: Column, allow: tuple[str, ...] = ()) -> Column:
    """True if the list is empty (blank entries do not count) or has the label, case aside."""
    names = sorted({a.strip().lower() for a in allow if a.strip()})
    return F.lower(label).isin(*names) if names else F.lit(True)
