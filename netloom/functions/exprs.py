"""Builders of SQL expressions by name, for use with DataFrame.agg(F.expr(...)).

They keep to what Spark SQL and ANSI engines share, so that one definition of a feature
serves the plan here and, by `ansi`, its check in another engine.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ansi(expr: str) -> str:
    """The same expression for engines that call the exact percentile quantile_cont, one share at a time."""

    def one(m: re.Match) -> str:
        return f"quantile_cont({m[1]}, {m[2].split(', ')[int(m[4])]}){m[3]}"

    expr = re.sub(r"\(percentile\((.+?), array\(([^)]*)\)\)( FILTER \(WHERE [^\[]*\))?\)\[(\d)\]", lambda m: one(m) if m[3] else one([m[0], m[1], m[2], "", m[4]]), expr)
    return re.sub(r"\bpercentile\(", "quantile_cont(", expr)


def _where(cond: str | None) -> str:
    return f" FILTER (WHERE {cond})" if cond else ""


def stats6(x: str, prefix: str, where: str | None = None) -> dict[str, str]:
    """Maximum, minimum, mean, population deviation, sum, median; 0 where there are no values."""
    f = _where(where)
    made = {"max": f"max({x})", "min": f"min({x})", "mean": f"avg({x})", "std": f"stddev_pop({x})", "sum": f"sum({x})", "median": f"percentile({x}, 0.5)"}
    return {f"{prefix}_{k}": f"coalesce({e}{f}, 0)" for k, e in made.items()}


def stats8(x: str, prefix: str, where: str | None = None, names: int = 8) -> dict[str, str]:
    """Mean, population deviation, minimum, maximum, quantiles .5, .25, .75, .9; 0 where there are no values. All quantiles come from one list of the values."""
    f = _where(where)
    made = {k: e + f for k, e in {"mean": f"avg({x})", "std": f"stddev_pop({x})", "min": f"min({x})", "max": f"max({x})"}.items()}
    shares = ["0.5", "0.25", "0.75", "0.9"][: max(names - 4, 0)]
    made |= {f"q{q[2:]:0<2}": f"(percentile({x}, array({', '.join(shares)})){f})[{i}]" for i, q in enumerate(shares)}
    return {f"{prefix}_{k}": f"coalesce({e}, 0)" for k, e in list(made.items())[:names]}


def ratio(a: str, b: str, least: str = "1") -> str:
    """a over b, b at least so much."""
    return f"({a}) / greatest({b}, {least})"


def share(count: str, of: str) -> str:
    return f"({count}) / greatest({of}, 1)"


def histogram(x: str, edges: list[float], prefix: str, where: str | None = None) -> dict[str, str]:
    """Shares of values in [edge, next edge), the last one open; values below the first edge fall out."""
    out = {}
    total = f"greatest(count({x}){_where(where)}, 1)"
    for i, lo in enumerate(edges):
        hi = f" AND {x} < {edges[i + 1]}" if i + 1 < len(edges) else ""
        out[f"{prefix}_{i}"] = f"count_if({x} >= {lo}{hi}){_where(where)} / {total}"
    return out


def rounded(named: dict[str, str], digits: int = 6) -> list[Column]:
    """Columns as doubles, rounded."""
    return [F.expr(f"round(cast({e} as double), {digits})").alias(n) for n, e in named.items()]


def rounded_ansi(named: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(cast({ansi(e)} as double), {digits}) AS {n}" for n, e in named.items())


def entropy_of_counts(c: str, log: str = "log2") -> str:
    """Of a table with one row per value and its count c; 0 for a single value."""
    return f"coalesce({log}(sum({c})) - sum({c} * {log}({c})) / sum({c}), 0)"


def finite(x: Column, other: float = 0.0) -> Column:
    """x, with null, NaN and infinities replaced."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(other)).otherwise(x)


def safe_ratio(a: Column, b: Column) -> Column:
    """0 where b is next to nothing."""
    return F.when(F.abs(b) > 1e-12, a / b).otherwise(F.lit(0.0))


def ip_to_u32(ip: Column) -> Column:
    """A dotted quad as a number; 0 if it isn't one."""
    parts = F.transform(F.split(ip, r"[.]"), lambda x: x.try_cast("bigint"))
    whole = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, v: a * 256 + v)
    ok = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & x.between(0, 255))
    return F.when(ok, whole).otherwise(F.lit(0).cast("bigint"))


def slash24(ip_number: Column) -> Column:
    return ip_number.bitwiseAND(F.lit(4294967040))


def hex_share(digest: Column) -> Column:
    """The first eight hex digits as a share of all values they can have."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


#: Bits of the TCP flags, in the order of their names.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}


def flag_names(flags: Column) -> Column:
    """Upper-case names of the flags that are set, lowest bit first."""
    return F.filter(F.array(*[F.when(flags.bitwiseAND(F.lit(m)) != 0, F.lit(n.upper())) for n, m in TCP_FLAGS.items()]), lambda x: x.isNotNull())


#: Ports on which QUIC is looked for.
QUIC_PORTS = (443, 8443, 7890, 853, 8853)


def is_quic_port(*ports: Column) -> Column:
    """Whether one of the ports is; a client's own port, which is any number, is left out where it is known."""
    return reduce(Column.__or__, [p.isin(*QUIC_PORTS) for p in ports])
