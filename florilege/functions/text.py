"""Text functions as columns; Python only where Spark has no built-in (Unicode folding, all character references)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no subject.
STOPWORDS = ("a", "as", "o", "os", "e", "de", "da", "das", "do", "dos", "em", "no", "na", "nos", "nas", "um", "uma", "uns", "umas", "para", "por", "com", "sem", "ao", "aos", "à", "às", "que", "se", "the", "of", "and", "in")

#: Named character references that are decoded without Python.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&raquo;", "»"), ("&laquo;", "«"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))

#: What a text with broken encoding, repeated signs, markup and so on looks like.
BROKEN = "�|Ã[\\x{80}-\\x{bf}]"
REPEATED_SIGN = r"([!?.,;:])\1"
ODD_UNDERSCORE = r"(?U)\w_[\s/)]|_$|_{2,}"
REPEATED_LONG_WORD = r"(?iU)\b([\wÀ-ÿ]{4,})\s+\1\b"
REPEATED_WORD = r"(?iU)(?<![\p{L}\p{N}_])([A-Za-zÀ-ÖØ-öø-ÿ]{3,})(?:\s+\1(?![\p{L}\p{N}_]))+"

#: Accented letters of Latin-1 and what folding makes of them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"

_SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Every named and numeric character reference decoded."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkd_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text, what is none replaced by U+FFFD."""
    return content.map(lambda x: bytes(x).decode("utf-8", "replace"), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def unescape_common(text: Column) -> Column:
    """The references of REFERENCES decoded on the JVM side, & last."""
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def fold_latin(text: Column) -> Column:
    """Lower-case Latin-1 letters without accents."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def compact(text: Column) -> Column:
    """White space runs as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def without_tags(text: Column) -> Column:
    """Scripts, styles and tags as spaces; references stay."""
    text = F.coalesce(text, F.lit(""))
    for block in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{block}\b.*?</{block}>", " ")
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_html(text: Column, exact: bool = False, shortcodes: bool = False) -> Column:
    """Visible text: tags go before references are decoded, so escaped tags become visible.

    exact: decode every reference (Python); else the common ones. shortcodes: drop [short code] marks of up to 180 characters.
    """
    text = without_tags(text)
    if shortcodes:
        text = F.regexp_replace(text, r"\[[^\]]{1,180}\]", " ")
    return compact(html_unescape(text) if exact else unescape_common(text))


def norm_text(text: Column, exact: bool = False) -> Column:
    """Folded words of letters a-z and digits, one space between."""
    text = F.lower(strip_html(text, exact))
    text = nfkd_fold(text) if exact else F.translate(text, ACCENTED, FOLDED)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def norm_word(word: Column, exact: bool = False) -> Column:
    return nfkd_fold(F.lower(word)) if exact else fold_latin(word)


def _kept(tokens: Column, least: int) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS))


def token_list(text: Column) -> Column:
    """Normalised words of four letters or more that are no number and no stop word."""
    return F.filter(_kept(F.split(norm_text(text), " "), 4), lambda t: ~t.rlike("^[0-9]+$"))


def slug_tokens(slug: Column) -> Column:
    """Distinct normalised words of three letters or more of a percent-encoded slug."""
    return F.array_distinct(_kept(F.split(norm_text(F.coalesce(F.try_url_decode(slug), slug)), " "), 3))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{4,}"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).cast("long")


def shortened(text: Column, limit: int = 140) -> Column:
    """Visible text of at most limit characters, the last an ellipsis where it was cut."""
    text = strip_html(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def excerpt(text: Column, at: Column, width: int = 95) -> Column:
    """The text around character `at` (from 0), white space compacted."""
    begin = F.greatest(at - width, F.lit(0))
    return compact(F.substring(text, (begin + 1).cast("int"), (at + width - begin).cast("int")))


def paragraphs(text: Column) -> Column:
    """Non-blank pieces between line ends and after sentence ends."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), compact), lambda p: p != "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_latin(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def masked_error(message: Column) -> Column:
    """A message with long quotes and identifiers masked, so that equal causes read alike."""
    # fixed values: what is masked
    return F.regexp_replace(F.regexp_replace(message, "'[^']{60,}'", "'…'"), r"\bDLP-[^\s,;]+", "DLP-…")


def escape_markup(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def escape_wiki(text: Column) -> Column:
    for sign, name in (("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def is_roman(word: Column) -> Column:
    return word.rlike("(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (word != "")


def is_capitalised(word: Column) -> Column:
    return (F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1))) & (F.lower(F.substring(word, 1, 1)) != F.substring(word, 1, 1))


def trimmed_words(text: Column, n: int) -> Column:
    """The first n words, with an ellipsis where more follow."""
    words = F.split(compact(text), " ")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, F.lit("…")).otherwise(F.lit("")))


_RUN = r"([a-zà-ÿ])\1+"


def collapsed(word: Column) -> Column:
    """The forms of a lower-case word with one of its repeated runs as one letter, or as two; the others stay."""
    runs, rest = F.regexp_extract_all(word, F.lit(_RUN), F.lit(0)), F.split(word, _RUN, -1)
    join = lambda i, n: F.array_join(F.transform(rest, lambda part, j: F.concat(part, F.when(j == i, F.repeat(F.left(F.get(runs, j), F.lit(1)), F.lit(n))).otherwise(F.coalesce(F.get(runs, j), F.lit(""))))), "")
    forms = F.flatten(F.transform(runs, lambda _, i: F.array(join(i, 1), join(i, 2))))
    return F.array_distinct(F.coalesce(forms, F.array().cast("array<string>")))


def is_spelling_candidate(word: Column, known: tuple[str, ...] = ()) -> Column:
    lower = F.lower(word)
    return (F.length(word) >= 5) & ~lower.isin(*STOPWORDS, *known) & ~word.rlike("[0-9]") & ~is_capitalised(word)


def is_slug_candidate(word: Column) -> Column:
    """A word of a slug is looked up only if it is long or has a tripled letter: slugs hold many names."""
    return (F.length(word) >= 8) | word.rlike(r"([a-z])\1\1")


def quality_warnings(text: Column, slug: Column | None = None) -> Column:
    """Names of what looks wrong in a text: eight checks."""
    raw = F.coalesce(text, F.lit(""))
    both = F.trim(F.concat_ws(" ", raw, slug if slug is not None else F.lit("")))
    count = lambda sign: F.length(raw) - F.length(F.replace(raw, F.lit(sign), F.lit("")))
    checks = (
        ("encoding", (F.contains(both, F.lit("�")) | F.contains(both, F.lit("Ã"))) & both.rlike(BROKEN)),
        ("double space", raw.rlike(r"(?U)\s{2,}")),
        ("repeated word", raw.rlike(REPEATED_LONG_WORD)),
        ("repeated punctuation", raw.rlike(REPEATED_SIGN)),
        ("unbalanced brackets", (count("(") != count(")")) | (count("[") != count("]"))),
        ("odd underscore", F.contains(both, F.lit("_")) & both.rlike(ODD_UNDERSCORE)),
        ("visible markup", raw.rlike("<[^>]+>|&lt;|&gt;")),
        # letters that are neighbours once normalised were so before, which is cheaper to see
        ("tripled letter", fold_latin(raw).rlike(r"([a-z])\1\1") & norm_text(raw).rlike(r"([a-z])\1\1")),
    )
    return F.when(both == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in checks])))


def repeated_in(text: Column) -> Column:
    """Words of three letters or more that stand twice in a row with white space between, as they stand first; once however often they follow."""
    return F.regexp_extract_all(text, F.lit(REPEATED_WORD), F.lit(1))


def percent(share: Column) -> Column:
    """A share as whole per cent, halves to the even number."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def repeated_words(text: Column, allowed: tuple[str, ...] = ("que", "the", "and", "para")) -> Column:
    """Words of three letters or more that stand twice in a row, lower-cased."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when((a == b) & (F.length(a) >= 3) & ~a.isin(*allowed), a))
    return F.array_compact(pairs)
