"""Text rules as SQL text."""

# Characters of the standard font beyond ASCII and Latin-1, and the
# set an edited text is reduced to when it holds anything else.
STANDARD_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
EDIT_KEEP = "€„“”‚‘’–—"


def extent_w(text: str, size: str) -> str:
    return f"array_max(transform(split({text}, '\\n', -1), l -> length(l))) * {size} * 0.55D"


def extent_h(text: str, size: str) -> str:
    return f"size(split({text}, '\\n', -1)) * {size} * 1.25D"


def drawable(c: str) -> str:
    """True when the standard font has every character (line breaks and tabs are handled by layout)."""
    return f"NOT ({c} RLIKE '[^\\\\n\\\\r\\\\t\\\\f\\\\x0B\\\\x20-\\\\x7E\\\\xA0-\\\\xFF{STANDARD_EXTRA}]')"


def drawn(c: str) -> str:
    """Text as drawn: unchanged when drawable, else ``?`` for what the font lacks."""
    astral = f"regexp_replace({c}, '[\\\\x{{10000}}-\\\\x{{10FFFF}}]', '??')"
    return f"CASE WHEN {drawable(c)} THEN {c} ELSE regexp_replace({astral}, '[^\\\\x20-\\\\xFF{EDIT_KEEP}]', '?') END"


def winansi_hex(c: str) -> str:
    """A drawable text as hexadecimal bytes in the standard font's encoding."""
    codes = STANDARD_EXTRA.encode("cp1252").decode("latin-1")
    return f"hex(encode(translate({c}, '{STANDARD_EXTRA}', '{codes}'), 'ISO-8859-1'))"


def number(e: str) -> str:
    """Two decimals at most, without a trailing ``.0``."""
    return f"regexp_replace(CAST(floor(({e}) * 100 + 0.5D) / 100D AS STRING), '\\\\.0$', '')"


def valid_json(c: str) -> str:
    """True for exactly one JSON value.

    The parser stops after the first value, so the text is tried inside a list
    and inside an object: only a complete value closes both.
    """
    inside = [f"concat('[', {c}, ']')", f"concat('{{\"v\":', {c}, '}}')"]
    return " AND ".join(f"try_parse_json({t}) IS NOT NULL" for t in inside)
