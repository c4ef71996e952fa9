"""Pieces of DuckDB SQL that the oracles share."""


def half_even(x: str, places: int) -> str:
    """Half-even rounding of a double by its shortest decimal form, as Spark's ``bround`` has it."""
    return f"CAST(round_even(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(30, 14)), {places}) AS DOUBLE)"
