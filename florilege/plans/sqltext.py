"""Pieces of DuckDB SQL that say what the text functions say."""

from florilege.functions.text import ACCENTED, FOLDED, REFERENCES, STOPWORDS

STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def without_tags(x: str) -> str:
    for block in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{block}\\b.*?</{block}>', ' ', 'g')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def strip_html(x: str) -> str:
    x = without_tags(f"coalesce({x}, '')")
    for name, sign in REFERENCES:
        x = f"replace({x}, {quoted(name)}, {quoted(sign)})"
    return f"trim(regexp_replace({x}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{FOLDED}')"


def norm_text(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({strip_html(x)}), '{ACCENTED}', '{FOLDED}'), '[^a-z0-9]+', ' ', 'g'))"


def title() -> str:
    return "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


def slug() -> str:
    return "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)"
