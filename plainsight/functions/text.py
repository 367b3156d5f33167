"""Text functions: case, cleaning, numbers kept as text, keys and display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col

# Marks a word break that is no blank; control characters do not occur in names.
_BREAK = "\u0001 "


def title_case(c: Column | str) -> Column:
    """Capitalise every word, where any character but letter, digit and ' ends a word.

    ``initcap`` only knows blanks, so other word ends get one for its sake.
    """
    spaced = F.regexp_replace(as_col(c), r"([^\p{L}\p{N}' ])", f"$1{_BREAK}")
    return F.replace(F.initcap(spaced), F.lit(_BREAK), F.lit(""))


def lower_trim(c: Column | str) -> Column:
    return F.lower(trim_all(c))


def trim_all(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def squash_blanks(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\s", "")


def percent_to_ratio(c: Column | str) -> Column:
    """``"75%"`` to 0.75; only the first percent sign is removed."""
    bare = F.regexp_replace(as_col(c), r"^([^%]*)%", "$1")
    return bare.try_cast("double") / F.lit(100.0)


def strip_to_number(c: Column | str) -> Column:
    """Keep digits and points only, then read a number. The minus sign is lost."""
    return F.regexp_replace(as_col(c), r"[^0-9.]", "").try_cast("double")


def comma_number(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit(","), F.lit("")).try_cast("double")


def parse_number(c: Column | str) -> Column:
    """The first signed number in a text, grouping marks ignored; it may start with its point."""
    found = F.regexp_substr(as_col(c), F.lit(r"-?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)"))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def dash_to_zero(c: Column | str) -> Column:
    """Read a number; a dash, other bad text and NULL all become 0."""
    return F.coalesce(as_col(c).try_cast("double"), F.lit(0.0))


def capture(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL where nothing matches."""
    c = as_col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_uri_part(c: Column | str) -> Column:
    """``scheme:kind:id`` to ``id``."""
    return capture(c, r".*:.*:(.*)")


def slug(c: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """Blanks to underscores, with whole-value overrides checked first."""
    c = as_col(c)
    out = F.replace(c, F.lit(" "), F.lit("_"))
    for name, replacement in (overrides or {}).items():
        out = F.when(c == name, F.lit(replacement)).otherwise(out)
    return out


def any_of(c: Column | str, words: list[str]) -> Column:
    """Case-insensitive match of any word; NULL is no match."""
    return F.coalesce(as_col(c).rlike("(?i)" + "|".join(re.escape(w) for w in words)), F.lit(False))


def clean_list_item(c: Column | str) -> Column:
    """Strip the list brackets and quotes that surround a name, and trim it."""
    bare = F.regexp_replace(as_col(c), r"\['|'\]|'", "")
    return trim_all(bare)


def dollars(c: Column | str, digits: int = 2) -> Column:
    """``$1,234.50``, with the sign in front of the currency mark."""
    c = as_col(c)
    body = F.concat(F.lit("$"), F.format_number(F.abs(c), digits))
    return F.when(c < 0, F.concat(F.lit("-"), body)).otherwise(body)


def grouped(c: Column | str, digits: int = 0) -> Column:
    """``1,234`` with thousands marks."""
    return F.format_number(as_col(c), digits)


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(as_col(c) * 100, digits), F.lit("%"))


def clean_name(name: str) -> str:
    """One column name in snake case."""
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    if not name:
        return "x"
    return f"x{name}" if name[0].isdigit() else name


def clean_names(names: list[str]) -> list[str]:
    """Snake-case names, repeated ones numbered from ``_2``."""
    seen: dict[str, int] = {}
    out = []
    for name in map(clean_name, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
