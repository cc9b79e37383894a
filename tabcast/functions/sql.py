"""Small helpers to write one SQL expression per column.

A plan over many columns is built much faster from SQL text than from one
Python call per operator.
"""


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | None) -> str:
    return "cast(null as double)" if value is None else f"cast('{float(value)!r}' as double)"


def flag(value: bool) -> str:
    return "true" if value else "false"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{text(label)}, {value}" for label, value in fields.items()) + ")"


def table_lookup(pairs: dict[str, str], key: str) -> str:
    """Value of ``key`` in a fixed map of texts."""
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs.items()) + f")[{key}]"


def spread(variance: str, mean: str) -> str:
    """A variance, or null when it is no more than rounding around a constant."""
    return f"case when {variance} > 1e-24 * ({mean}) * ({mean}) then {variance} end"
