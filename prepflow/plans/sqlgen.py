"""Small builders of DuckDB SQL text for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.columns import hash_uniform_sql


def u(keys: Sequence[str] | str, seed: str) -> str:
    return hash_uniform_sql([keys] if isinstance(keys, str) else list(keys), seed)


def group_mode(src: str, keys: Sequence[str], col: str, alias: str) -> str:
    """Subquery: per key tuple, the most frequent non-null ``col`` (smallest on ties)."""
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"""(SELECT {k}, {col} AS {alias} FROM (
      SELECT {k}, {col}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {col} ASC) AS __rn
      FROM {src} WHERE {nn} AND {col} IS NOT NULL GROUP BY {k}, {col}) WHERE __rn = 1)"""


def frequency_dictionary(src: str, features: Sequence[str], buckets: int = 1024) -> str:
    """Subquery with feature, value, n, total, rel_freq, cum_lo, cum_hi; slots
    ordered by (hash bucket of the value, n desc, value)."""
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value FROM {src} WHERE {f} IS NOT NULL"
        for f in features)
    bucket = f"floor({u('value', 'dict')} * {buckets})"
    return f"""(SELECT feature, value, n, total, CAST(n AS DOUBLE) / total AS rel_freq,
              cum_hi - n AS cum_lo, cum_hi FROM (
      SELECT feature, value, n,
             CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total,
             CAST(sum(n) OVER (PARTITION BY feature ORDER BY {bucket}, n DESC, value ASC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_hi
      FROM (SELECT feature, value, count(*) AS n FROM ({long}) GROUP BY feature, value)))"""


def sample_pick(dict_name: str, feature: str, u_expr: str, alias: str) -> str:
    """Correlated scalar subquery picking the dictionary value for a draw ``u``."""
    return f"""(SELECT d.value FROM {dict_name} d WHERE d.feature = '{feature}'
       AND floor(({u_expr}) * d.total) >= d.cum_lo AND floor(({u_expr}) * d.total) < d.cum_hi) AS {alias}"""


def alias_tables(name: str, dictionary: str, buckets: int = 1024) -> str:
    """CTEs that end in ``name``: feature, slot, value, keep, alias, total, k of the alias tables of ``dictionary``."""
    bucket = f"floor({u('value', 'dict')} * {buckets})"
    return f"""{name}_k AS (SELECT feature, value, n, total, CAST(count(*) OVER (PARTITION BY feature) AS BIGINT) AS k
             FROM {dictionary}),
{name}_r AS (SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS slot,
                    greatest(total - n * k, 0) AS room, greatest(n * k - total, 0) AS surplus,
                    CAST(sum(greatest(total - n * k, 0)) OVER w AS BIGINT) AS room_hi,
                    CAST(sum(greatest(n * k - total, 0)) OVER w AS BIGINT) AS sur_hi
             FROM {name}_k
             WINDOW w AS (PARTITION BY feature ORDER BY {bucket}, value ROWS UNBOUNDED PRECEDING)),
{name}_e AS (SELECT h.*, COALESCE(l.room_hi - h.sur_hi, 0) AS over
             FROM {name}_r h LEFT JOIN {name}_r l
               ON l.feature = h.feature AND l.room > 0 AND h.surplus > 0
                  AND l.room_hi - l.room < h.sur_hi AND h.sur_hi <= l.room_hi
             WHERE h.room = 0),
{name}_p AS (SELECT feature, slot, value, total, k, n * k AS keep, room_hi - room AS point FROM {name}_r WHERE room > 0
             UNION ALL
             SELECT feature, slot, value, total, k, total - over, sur_hi FROM {name}_e WHERE over > 0),
{name} AS (SELECT p.feature, p.slot, p.value, p.keep, s.value AS alias, p.total, p.k
           FROM {name}_p p JOIN {name}_r s
             ON s.feature = p.feature AND s.surplus > 0 AND s.sur_hi - s.surplus <= p.point AND p.point < s.sur_hi
           UNION ALL
           SELECT feature, slot, value, total, NULL, total, k FROM {name}_e WHERE over = 0)"""


def alias_pick(name: str, feature: str, u_expr: str, alias: str) -> str:
    """Correlated scalar subquery drawing a value from the alias table of a feature."""
    at = f"({u_expr}) * a.k"
    return f"""(SELECT CASE WHEN ({at} - floor({at})) * a.total < a.keep THEN a.value ELSE a.alias END
       FROM {name} a WHERE a.feature = '{feature}' AND a.slot = floor({at})) AS {alias}"""
