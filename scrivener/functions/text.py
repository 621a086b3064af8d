"""Text expressions: sentences, tokens, tags, counts, bins and display forms.

All are column expressions, so they stay inside generated code. Sentences and tokens
follow patterns instead of a trained pipeline; README names the differences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"
LEXICAL = r"\p{L}+"
COUNTED = r"[\p{L}\p{N}]+"
#: A run of word characters, inner apostrophes and hyphens included.
WORDLIKE = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
# The characters that count as white space, those of Unicode included, as the inside of a class.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NON_SPACE = rf"[\p{{L}}\p{{N}}]+|[^{SPACE}\p{{L}}\p{{N}}]"

# Closed-class words and suffixes of the coarse tagger.
CLOSED_CLASS = {
    "DET": ("the", "a", "an", "this", "that", "these", "those", "le", "la", "les", "un", "une", "der", "die", "das", "el", "los", "las"),
    "PRON": ("i", "you", "he", "she", "it", "we", "they", "who", "which", "qui", "que"),
    "ADP": ("of", "in", "on", "at", "by", "for", "with", "from", "to", "de", "en", "dans", "par", "von", "mit", "zu", "por", "para", "con"),
    "CONJ": ("and", "or", "but", "et", "ou", "und", "oder", "y"),
    "AUX": ("is", "are", "was", "were", "be", "has", "have", "had", "est", "ist", "es"),
}
SUFFIXES = (("ADV", "ly"), ("VERB", "ing"), ("VERB", "ed"), ("NOUN", "tion"), ("NOUN", "ment"), ("NOUN", "heit"), ("NOUN", "keit"), ("ADJ", "ble"), ("ADJ", "ous"), ("ADJ", "lich"))


def strip(text: Column) -> Column:
    """Without the white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Array of the stripped, non-blank sentences."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def tokens(text: Column, pattern: str = LEXICAL) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return count_matches(text, f"[^{SPACE}]+")


def regex_word_count(text: Column) -> Column:
    """Runs of word characters, inner apostrophes and hyphens included."""
    return count_matches(text, WORDLIKE)


def grams(items: Column, n: int) -> Column:
    """Every n items in a row, joined by a space; for arrays of n items or more.

    Built from whole slices: a lambda that cut the array at each place would make the
    array anew for every item once the optimizer inlines it.
    """
    size = F.size(items) - (n - 1)
    out = F.slice(items, 1, size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(items, k, size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def tag(token: Column) -> Column:
    """A coarse part of speech by closed-class words, shape and suffix."""
    out = F.lit("NOUN")
    for name, suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(token, F.lit(suffix)), name).otherwise(out)
    out = F.when(F.length(token) <= 3, "X").otherwise(out)
    out = F.when(token.rlike(r"^\p{N}"), "NUM").otherwise(out)
    for name, words in reversed(CLOSED_CLASS.items()):
        out = F.when(token.isin(*words), name).otherwise(out)
    return out


def normalise_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def lenient_int(value: Column) -> Column:
    """int(float(v)), and 0 for what is no number."""
    return F.coalesce(value.try_cast("double").try_cast("long"), F.lit(0))


def strict_int(value: Column, sentinel: int = 10**12) -> Column:
    """An integer literal, or a sentinel that sorts last; ``12.0`` is none."""
    return F.when(value.rlike(rf"^[{SPACE}]*[+-]?\d+[{SPACE}]*$"), strip(value).try_cast("long")).otherwise(F.lit(sentinel))


def preview(text: Column, width: int = 240) -> Column:
    line = strip(F.regexp_replace(text, r"\n", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


#: Inclusive upper bounds of the word-count bins; the last is open.
WORD_BINS = ((20, "0-20"), (40, "21-40"), (60, "41-60"), (80, "61-80"), (100, "81-100"), (150, "101-150"), (200, "151-200"))


def word_bin(n: Column) -> Column:
    out = F.lit("201+")
    for top, name in reversed(WORD_BINS):
        out = F.when(n <= top, name).otherwise(out)
    return out


def margin_bin(margin: Column) -> Column:
    """Ten half-open bins of 0.05 over [0, 0.5], the last closed; null outside."""
    out = F.lit(None).cast("string")
    edges = [f"{k * 0.05:.2f}" for k in range(11)]
    for k in reversed(range(10)):
        low, high = float(edges[k]), float(edges[k + 1])
        inside = (margin >= low) & ((margin <= high) if k == 9 else (margin < high))
        out = F.when(inside, f"{edges[k]}-{edges[k + 1]}").otherwise(out)
    return out


def checked_margin_bin(margin: Column) -> Column:
    """``margin_bin``, but a margin outside [0, 0.5] is an error; null stays null."""
    name = margin_bin(margin)
    return F.when(margin.isNotNull() & name.isNull(), F.raise_error(F.concat(F.lit("no bin for the margin "), margin.cast("string")))).otherwise(name)


def fixed(value: Column, digits: int) -> Column:
    """So many decimals of the double itself, not of its shortest decimal form: 0.0045 lies below its tie.

    The product with a power of ten is taken with its rounding error, which decides what only
    looks like a tie. A double that lies on one (0.90625) goes to the even digit, as in printf.
    """
    scale, size = float(10**digits), F.abs(value)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    product = size * scale
    error = (high * scale - product) + (size - high) * scale
    low, over = F.floor(product), (product - F.floor(product) - 0.5) + error
    whole = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%.{digits}f", F.signum(value) * whole.cast("double") / scale)


def feature_text(value: Column, size: Column | None = None) -> Column:
    """Two decimals from 100, three from 10, else four with trailing zeros cut; ``Unavailable`` for null.

    ``size`` is what chooses the decimals, where ``value`` was rounded before.
    """
    size = F.abs(value if size is None else size)
    small = F.regexp_replace(F.regexp_replace(fixed(value, 4), "0+$", ""), r"\.$", "")
    by_size = F.when(size >= 100, fixed(value, 2)).when(size >= 10, fixed(value, 3)).otherwise(small)
    return F.when(value.isNull(), "Unavailable").otherwise(by_size)


def signal_text(p: Column) -> Column:
    """Three decimals; ``Not reported`` for null."""
    return F.when(p.isNull(), "Not reported").otherwise(fixed(p, 3))


def number_text(value: Column) -> Column:
    """Thousands separators and two decimals; ``n/a`` for null."""
    return F.coalesce(F.format_number(value, 2), F.lit("n/a"))


# What is shown for each outcome.
HEADLINES = {"insufficient": "INSUFFICIENT EVIDENCE", "ai_associated": "AI-ASSOCIATED EVIDENCE", "human_associated": "HUMAN-ASSOCIATED EVIDENCE"}
EXPLANATIONS = {
    "none": "Submit a passage to inspect the available measurements.",
    "insufficient": "The text does not contain enough usable information for reliable stylistic analysis.",
    "ai_associated": "The measured writing characteristics are more consistent with the machine-associated examples used by the model.",
    "human_associated": "The measured writing characteristics are more consistent with the human-associated examples used by the model.",
}


def headline(state: Column, label: Column) -> Column:
    unsure = state.isNull() | (state == "insufficient_evidence")
    return F.when(unsure, HEADLINES["insufficient"]).when(label == "ai_associated", HEADLINES["ai_associated"]).otherwise(HEADLINES["human_associated"])


def explanation(state: Column, label: Column) -> Column:
    """A null state stands for no result yet."""
    known = F.when(state == "insufficient_evidence", EXPLANATIONS["insufficient"]).when(label == "ai_associated", EXPLANATIONS["ai_associated"]).otherwise(EXPLANATIONS["human_associated"])
    return F.when(state.isNull(), EXPLANATIONS["none"]).otherwise(known)
