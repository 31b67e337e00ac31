"""SQL for the matching ratio of two texts, written as recursive CTEs.

The ratio is ``SequenceMatcher(None, later, earlier).ratio()``: take the longest
common run (the first in the later text, then in the earlier one), widen it, and
do the same left and right of it. Characters that make up more than a hundredth
of an earlier text of 200 characters or more start no run, they only widen one.
"""
from __future__ import annotations

from gleaner.operators.similar_text import DEFAULT_THRESHOLD

STEPS = ", ".join(str(2**i) for i in range(15, -1, -1))  # texts shorter than 65,536 characters


def _longest(upto: str, test: str) -> str:
    """Largest k for which a test holds that, once false, stays false; by halving steps."""
    held = f"k + s <= {upto} AND {test.replace('{k}', '(k + s)')}"
    return f"list_reduce([{STEPS}], lambda k, s: CASE WHEN {held} THEN k + s ELSE k END, 0)"


def ratios(nodes: str, threshold: float = DEFAULT_THRESHOLD) -> str:
    """CTEs that end in ``ratios(earlier, later, ratio)`` of all pairs of ``nodes``.

    ``nodes(gid, text)`` are distinct texts. Both orders of a pair are measured,
    ``earlier`` naming the second text of the ratio. Pairs whose character counts
    rule the threshold out are not measured. Needs ``WITH RECURSIVE``.
    """
    run = _longest("length(a) - i + 1", "contains(r, substr(a, i, {k}))")
    left = _longest("least(i, j) - 1", "substr(a, i - {k}, {k}) = substr(b, j - {k}, {k})")
    right = _longest(
        "least(length(a) - i - n, length(b) - j - n) + 1", "substr(a, i + n, {k}) = substr(b, j + n, {k})"
    )
    return f"""
letters AS (SELECT gid, c, count(*) AS n FROM (
    SELECT gid, unnest(string_split(text, '')) AS c FROM {nodes}) GROUP BY gid, c),
sized AS (
  SELECT gid, text, array_to_string(list_transform(string_split(text, ''), lambda c:
      CASE WHEN list_contains(common, c) THEN chr(1) ELSE c END), '') AS rare
  FROM (SELECT x.gid, any_value(x.text) AS text,
      coalesce(list(y.c) FILTER (length(x.text) >= 200 AND y.n > length(x.text) // 100 + 1), []) AS common
    FROM {nodes} x LEFT JOIN letters y USING (gid) GROUP BY x.gid)),
alike AS (
  SELECT e.gid AS earlier, l.gid AS later, length(e.text) + length(l.text) AS total
  FROM sized e JOIN sized l ON e.gid <> l.gid
    AND 2 * least(length(e.text), length(l.text)) >= {threshold} * (length(e.text) + length(l.text)) - 0.001),
hopeful AS (
  SELECT earlier, later, total FROM alike JOIN letters x ON x.gid = earlier
  JOIN letters y ON y.gid = later AND y.c = x.c
  GROUP BY ALL HAVING 2 * sum(least(x.n, y.n)) >= {threshold} * total - 0.001),
stretches AS (
  SELECT earlier, later, total, l.text AS a, e.text AS b, e.rare AS r, 0::BIGINT AS matched
  FROM hopeful JOIN sized e ON e.gid = earlier JOIN sized l ON l.gid = later
  UNION ALL
  SELECT earlier, later, total, side.a, side.b, side.r, side.matched FROM (
    SELECT earlier, later, total, unnest([
      {{'a': left(a, i - 1 - x), 'b': left(b, j - 1 - x), 'r': left(r, j - 1 - x), 'matched': x + n + y}},
      {{'a': substr(a, i + n + y), 'b': substr(b, j + n + y), 'r': substr(r, j + n + y), 'matched': 0}}]) AS side
    FROM (
      SELECT *, {left} AS x, {right} AS y FROM (
        SELECT *, CASE WHEN n = 0 THEN 1 ELSE strpos(r, substr(a, i, n)) END AS j FROM (
          SELECT *, best.n AS n, -best.i AS i FROM (
            SELECT *, list_max(list_transform(range(1, length(a) + 1), lambda i:
              {{'n': {run}, 'i': -i}})) AS best
            FROM stretches WHERE a <> '' AND b <> ''))))
    WHERE x + n + y > 0)),
ratios AS MATERIALIZED (
  SELECT earlier, later, 2.0::DOUBLE * sum(matched) / total AS ratio FROM stretches
  GROUP BY earlier, later, total HAVING 2.0::DOUBLE * sum(matched) / total >= {threshold}::DOUBLE)"""
