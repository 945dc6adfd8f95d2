"""Window frames over a symbol's bars, as SQL text."""

W = "(PARTITION BY stock_code ORDER BY date)"


def frame(n: int, lag: int = 0) -> str:
    """The n rows that end `lag` rows before the current one."""
    end = f"{lag} PRECEDING" if lag else "CURRENT ROW"
    return f"OVER (PARTITION BY stock_code ORDER BY date ROWS BETWEEN {n - 1 + lag} PRECEDING AND {end})"


def rolling(agg: str, x: str, n: int, least: int = 1, lag: int = 0) -> str:
    """agg(x) over the frame, null while it holds fewer than `least` values."""
    f = frame(n, lag)
    return f"CASE WHEN count({x}) {f} >= {least} THEN {agg}({x}) {f} END"


def prev(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"
