"""Small numeric expressions; all return SQL text for ``expr``/``selectExpr``."""


def nearest(e: str) -> str:
    """Round half towards plus infinity (not away from zero)."""
    return f"floor(({e}) + 0.5D)"


def clamp(e: str, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {e}))"


def or_default(e: str, default) -> str:
    """Default for null *and* zero."""
    return f"coalesce(nullif({e}, 0), {default})"
