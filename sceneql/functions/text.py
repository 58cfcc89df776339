"""Text expressions: words with Unicode classes, sentence ends, spacing, cues, time codes, slugs and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneql.functions import vocabularies as L


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(s) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(s), r"\s+", " "))


def tokens(s) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def lexical(s) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(r"\p{L}+"), F.lit(0))


def bigrams(t: Column) -> Column:
    """left::right of neighbours; empty for fewer than two tokens."""
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws("::", a, b)))


def word_grams(s) -> Column:
    """Words and pairs of neighbouring words, lower-cased."""
    t = tokens(s)
    return F.concat(t, F.transform(bigrams(t), lambda x: F.replace(x, F.lit("::"), F.lit(" "))))


def char_grams(s, least: int = 3, most: int = 5) -> Column:
    """Runs of `least` to `most` characters within the words, each with a space before and behind; a word that is no longer
    than a run counts once."""

    def of(word: Column) -> Column:
        p, n = F.concat(F.lit(" "), word, F.lit(" ")), F.char_length(word) + 2
        parts = []
        for k in range(least, most + 1):
            runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), _run(p, k))
            parts.append(runs if k == least else F.when(n > k - 1, runs).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(F.filter(F.split(F.lower(_c(s)), r"\s+"), lambda w: w != ""), of))


def _run(text: Column, size: int):
    return lambda i: F.substring(text, i, F.lit(size))


def ends_sentence(s) -> Column:
    return F.trim(_c(s)).rlike("[.!?\u2026]+([\"'\u201d\u2019)\\]]+)?$")


def asks(s) -> Column:
    return F.trim(_c(s)).rlike("\\?([\"'\u201d\u2019)\\]]+)?$")


def complete(s, dangling: Sequence[str] = L.DANGLING) -> Column:
    """Not empty, not ending in a comma, semicolon or colon, and its last word no connective that leads on."""
    last = F.element_at(lexical(s), -1)
    return (F.trim(_c(s)) != "") & ~F.trim(_c(s)).rlike("[,;:]$") & ~F.coalesce(last.isin(*dangling), F.lit(False))


def continues(s, starters: Sequence[str] = L.CONTINUATION) -> Column:
    return F.coalesce(F.element_at(lexical(s), 1).isin(*starters), F.lit(False))


def join_words(words) -> Column:
    """Words with single spaces and none before punctuation."""
    return F.regexp_replace(F.array_join(_c(words), " "), "\\s+([,.;:!?\u2026])", "$1")


def has_prefix(s, term: str) -> Column:
    """Whether a word begins with the term."""
    return F.lower(_c(s)).rlike("(?<![\\p{L}\\p{N}_])" + term)


def has_any(s, markers: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(_c(s)), m))


def seconds_of(code) -> Column:
    """MM:SS or HH:MM:SS as seconds."""
    return F.aggregate(F.split(_c(code), ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def timecode(seconds) -> Column:
    """HH:MM:SS.mmm of seconds."""
    ms = F.round(_c(seconds) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def slug(s, most: int = 20) -> Column:
    return F.substring(F.lower(F.regexp_replace(_c(s), "[^a-zA-Z0-9]+", "_")), 1, most)


def hash_place(token: Column, size: int = 512) -> Column:
    """Signed feature hashing: the first four bytes of SHA-256, little end first, modulo size."""
    h = F.sha2(token.cast("binary"), 256)
    swapped = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(swapped, 16, 10).cast("long") % size


def hash_sign(token: Column) -> Column:
    """1 or -1 by the lowest bit of the fifth byte."""
    return F.when(F.conv(F.substring(F.sha2(token.cast("binary"), 256), 9, 2), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)


def first_object(s) -> Column:
    """The first {...} without nested braces in a noisy text; null if none."""
    return F.nullif(F.regexp_extract(_c(s), r"\{[^{}]*\}", 0), F.lit(""))


def config_hash(struct: Column) -> Column:
    """SHA-256 of compact JSON; fields must be in name order."""
    return F.sha2(F.to_json(struct), 256)


def translate_event(label, table: Sequence[tuple[str, str]] = L.SOUND_LABELS) -> Column:
    """The value of the first entry whose key is part of the label; the label itself if none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table])
    hits = F.filter(pairs, lambda p: F.contains(F.lower(_c(label)), p["k"]))
    return F.coalesce(F.get(hits, F.lit(0))["v"], _c(label))


def short_copy(s, words: int) -> Column:
    """The first words of a caption without its introduction."""
    return F.array_join(F.slice(F.split(collapse(F.regexp_replace(_c(s), r"(?i)^(a|an|the)\s+(photo|picture|image) of\s+", "")), " "), 1, words), " ")


def dialogue_cues(s, positive: Sequence[str] = L.POSITIVE, negative: Sequence[str] = L.NEGATIVE, decision: Sequence[str] = L.DECISION) -> Column:
    """struct(polarity, intensity, decision, confidence) of how many cues begin a word; four places."""
    words = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def hits(cues: Sequence[str]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.exists(words, lambda w: F.startswith(w, c))))

    p, n, d = hits(positive), hits(negative), hits(decision)
    one = F.lit(1.0)
    return F.struct(
        F.round((p - n) / F.greatest(p + n, F.lit(1)), 4).alias("polarity"), F.round(F.least(one, (p + n) / 2.0), 4).alias("intensity"),
        F.round(F.least(one, d / 2.0), 4).alias("decision"), F.round(F.least(F.lit(0.75), 0.25 * (p + n) + 0.15 * d), 4).alias("confidence"),
    )
