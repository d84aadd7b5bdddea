"""File name rules as SQL text, usable in ``expr`` and ``selectExpr``."""

from ..fixed import INTAKE_ENDING

_ENDING = INTAKE_ENDING.replace("\\", "\\\\")


def base_name(c: str) -> str:
    """Last path part of the trimmed name, unusual characters folded to ``_``."""
    trimmed = f"regexp_replace(regexp_replace(coalesce({c}, ''), '^\\\\s+|\\\\s+$', ''), '/+$', '')"
    return f"regexp_replace(regexp_extract({trimmed}, '([^/]*)$', 1), '[^\\\\w.\\\\-() ]+', '_')"


def safe_pdf_name(c: str, now_ms: str) -> str:
    b = base_name(c)
    named = f"CASE WHEN {b} IN ('', '.pdf') THEN concat('scan_', {now_ms}, '.pdf') ELSE {b} END"
    return f"CASE WHEN lower({named}) LIKE '%.pdf' THEN {named} ELSE concat({named}, '.pdf') END"


def safe_raw_name(c: str, now_ms: str, fallback: str = "'.pdf'") -> str:
    b = base_name(c)
    named = f"CASE WHEN {b} = '' OR {b} LIKE '.%' THEN concat('datei_', {now_ms}, {fallback}) ELSE {b} END"
    return f"CASE WHEN {named} RLIKE '{_ENDING}' THEN {named} ELSE concat({named}, {fallback}) END"


def accepted_ending(c: str) -> str:
    return f"{c} RLIKE '{_ENDING}'"


def file_kind(c: str) -> str:
    return f"CASE WHEN lower({c}) LIKE '%.pdf' THEN 'pdf' ELSE 'image' END"


def image_ending(mime: str) -> str:
    return f"CASE WHEN coalesce({mime}, '') LIKE '%png%' THEN 'png' ELSE 'jpg' END"


def resolved_parts(path: str) -> str:
    """Path segments after resolving ``.`` and ``..``."""
    return (
        f"aggregate(split({path}, '/'), CAST(array() AS ARRAY<STRING>), (a, s) -> CASE WHEN s IN ('', '.') THEN a"
        " WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 0)) ELSE concat(a, array(s)) END)"
    )


def inside_dir(path: str, folder: str) -> str:
    """True when the resolved parent of ``path`` is exactly ``folder``."""
    parts = resolved_parts(path)
    return (
        f"size({parts}) > 0 AND array_join(slice({parts}, 1, greatest(size({parts}) - 1, 0)), '/')"
        f" = array_join({resolved_parts(folder)}, '/')"
    )


def fmt_size(c: str) -> str:
    return (
        f"CASE WHEN {c} < 1024 THEN concat({c}, ' B')"
        f" WHEN {c} < 1048576 THEN format_string('%.1f KB', {c} / 1024D)"
        f" ELSE format_string('%.2f MB', {c} / 1048576D) END"
    )


def classify_error(c: str) -> str:
    return f"CASE WHEN {c} RLIKE '(?i)password|encrypt' THEN 'protected' ELSE 'error' END"


def stem(c: str) -> str:
    """Name without its last ending; a leading dot is not an ending."""
    return f"regexp_extract({c}, '^(.+?)(\\\\.[^.]*)?$', 1)"


def ending(c: str) -> str:
    return f"regexp_extract({c}, '^(.+?)(\\\\.[^.]*)?$', 2)"
