"""Small SQL text helpers. DuckDB divides decimals as doubles, so ratios use integer arithmetic, rounded half up."""

from __future__ import annotations


def ratio(num: str, den: str, digits: int = 6, kind: str = "DECIMAL(18,6)", num_scale: int = 0) -> str:
    """num / den rounded half away from zero; NULL for a 0 or NULL denominator.

    ``num_scale`` is the number of decimals of ``num`` (2 for money).
    """
    whole = f"CAST(({num}) * {10**num_scale} AS HUGEINT) * {10 ** (digits - num_scale)}"
    unit = "1" if digits == 0 else f"CAST({10**-digits:.{digits}f} AS DECIMAL({digits + 1},{digits}))"
    rounded = f"sign({whole}) * ((2 * abs({whole}) + ({den})) // (2 * ({den})))"
    return f"CASE WHEN ({den}) > 0 THEN CAST(CAST({rounded} AS DECIMAL(24,0)) * {unit} AS {kind}) END"


def pct(part: str, whole: str, kind: str = "DECIMAL(6,2)") -> str:
    return ratio(f"100 * CAST({part} AS HUGEINT)", whole, 2, kind)


def clean(c: str, case: str = "", blank_to_null: bool = False) -> str:
    out = f"{case}(trim(replace({c}, chr(13), '')))" if case else f"trim(replace({c}, chr(13), ''))"
    return f"nullif({out}, '')" if blank_to_null else out


def ts(c: str) -> str:
    return f"try_strptime({clean(c)}, '%Y-%m-%d %H:%M:%S')"


def flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER)"


def n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
