"""Boosted trees and the seeded sample against SQL: the first trees of the
level-wise configuration, node by node, and the rows that attribution explains."""

from pyspark.sql import functions as F

from clickspark.operators import boosting as bo
from clickspark.operators import models as mo
from clickspark.plans.oracle import rnp, with_ev
from clickspark.plans.q_features import ML_CTES, ml, split_cte
from clickspark.plans.registry import query
from clickspark.schema import FEATURE_COLS

#: Trees and levels that SQL grows too.
TREES, DEPTH = 2, 4
_U = "4294967296.0"


def _gain(g: str, h: str) -> str:
    return f"(CAST({g} AS DOUBLE) / {_U}) * (CAST({g} AS DOUBLE) / {_U}) / (CAST({h} AS DOUBLE) / {_U} + 1.0)"


def _tree_ctes(t: int) -> list[str]:
    """Tree ``t`` from the rows ``r{t}`` (user_id, y, margin): gradients in units
    of 2^-32, then level by level the best cut of every node."""
    out = [f"""g{t} AS (SELECT user_id, CAST(round_even((p - y) * {_U}, 0) AS BIGINT) AS g,
    CAST(round_even(p * (1 - p) * {_U}, 0) AS BIGINT) AS h FROM (SELECT user_id, y, 1 / (1 + exp(-margin)) AS p FROM r{t}) x)""",
           f"n{t}_0 AS (SELECT user_id, '' AS path FROM g{t})"]
    for k in range(DEPTH):
        out += [f"""c{t}_{k} AS (SELECT path, f, e, SUM(SUM(g)) OVER w AS gl, SUM(SUM(h)) OVER w AS hl, SUM(COUNT(*)) OVER w AS nl,
    SUM(SUM(g)) OVER a AS gt, SUM(SUM(h)) OVER a AS ht, SUM(COUNT(*)) OVER a AS nt
  FROM n{t}_{k} JOIN g{t} USING (user_id) JOIN bins USING (user_id) GROUP BY path, f, e
  WINDOW w AS (PARTITION BY path, f ORDER BY e NULLS LAST), a AS (PARTITION BY path, f))""",
                f"""b{t}_{k} AS (SELECT path, f, e, gain FROM (SELECT *, {_gain('gl', 'hl')} + {_gain('(gt - gl)', '(ht - hl)')}
      - {_gain('gt', 'ht')} AS gain FROM c{t}_{k} WHERE e IS NOT NULL AND nl < nt AND hl >= {_U} AND ht - hl >= {_U}) x
  WHERE gain > 1e-9 QUALIFY ROW_NUMBER() OVER (PARTITION BY path ORDER BY gain DESC, f, e) = 1)""",
                f"""n{t}_{k + 1} AS (SELECT n.user_id, n.path || CASE WHEN x.x <= b.e THEN 'L' ELSE 'R' END AS path
  FROM n{t}_{k} n JOIN b{t}_{k} b USING (path) JOIN xs x ON x.user_id = n.user_id AND x.f = b.f)"""]
    rows = " UNION ALL ".join(f"SELECT user_id, path FROM n{t}_{k}" for k in range(DEPTH + 1))
    cuts = " UNION ALL ".join(f"SELECT * FROM b{t}_{k}" for k in range(DEPTH))
    out += [f"""t{t} AS (SELECT {t} AS tree, s.path, b.f, b.e AS threshold, b.gain, s.h / {_U} AS cover, s.n AS "rows",
    CASE WHEN b.f IS NULL THEN -0.05 * (s.g / {_U}) / (s.h / {_U} + 1.0) END AS value
  FROM (SELECT path, CAST(SUM(g) AS DOUBLE) AS g, CAST(SUM(h) AS DOUBLE) AS h, COUNT(*) AS n
        FROM ({rows}) x JOIN g{t} USING (user_id) GROUP BY path) s LEFT JOIN ({cuts}) b USING (path))""",
            f"""r{t + 1} AS (SELECT r.user_id, r.y, r.margin + v.value AS margin FROM r{t} r
  JOIN (SELECT x.user_id, t.value FROM ({rows}) x JOIN t{t} t ON t.path = x.path AND t.value IS NOT NULL) v USING (user_id))"""]
    return out


def _first_trees_sql() -> str:
    values = " UNION ALL ".join(f"SELECT user_id, {i} AS f, CAST({c} AS DOUBLE) AS x FROM tr" for i, c in enumerate(FEATURE_COLS))
    ctes = [split_cte(), "tr AS (SELECT * FROM sp WHERE is_test = 0)", f"xs AS ({values})",
            """cuts AS (SELECT DISTINCT f, x AS e FROM (SELECT f, x, COUNT(DISTINCT x) OVER (PARTITION BY f) AS d, COUNT(*) OVER (PARTITION BY f) AS n,
    ROW_NUMBER() OVER (PARTITION BY f ORDER BY x) AS rn, MAX(x) OVER (PARTITION BY f) AS top FROM xs) z
  WHERE x < top AND (d <= 256 OR rn IN (SELECT (i * n + 255) // 256 FROM range(1, 256) r(i))))""",
            "bins AS (SELECT xs.user_id, xs.f, MIN(e) AS e FROM xs LEFT JOIN cuts ON cuts.f = xs.f AND cuts.e >= xs.x GROUP BY xs.user_id, xs.f)",
            """r0 AS (SELECT user_id, label AS y, (SELECT ln(q / (1 - q)) FROM (SELECT CAST(SUM(label) AS DOUBLE) / COUNT(*) AS q FROM tr) b) AS margin
  FROM tr)"""]
    for t in range(TREES):
        ctes += _tree_ctes(t)
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURE_COLS)) + " END"
    union = " UNION ALL ".join(f"SELECT * FROM t{t}" for t in range(TREES))
    return with_ev(f"""SELECT tree, path, {names} AS feature, threshold, {rnp('gain', 6)} AS gain, {rnp('cover', 6)} AS cover, "rows",
  {rnp('value', 9)} AS value FROM ({union}) u""", *ML_CTES, *ctes)


def _round(c: str, n: int):
    return (F.rint(F.col(c) * float(10 ** n)) / float(10 ** n)).alias(c)


@query("boosted_first_trees", _first_trees_sql())
def _bft(spark, d):
    """Nodes by their path from the root (L, R)."""
    train, _ = mo.split(ml(spark, d))
    own = {**mo.MODEL_PARAMS["XGBoost"], **mo.GROWTH["XGBoost"], "maxIter": TREES, "maxDepth": DEPTH}
    model = bo.fit_boosted(train, **own)
    paths = []
    for i, t in enumerate(model.trees):
        at = {0: ""}
        for n in range(len(t.feature)):
            if t.feature[n] >= 0:
                at[t.left[n]], at[t.right[n]] = at[n] + "L", at[n] + "R"
        paths += [(i, n, p) for n, p in at.items()]
    named = spark.createDataFrame(paths, "tree int, node int, path string")
    return model.nodes(spark).join(F.broadcast(named), ["tree", "node"]).select(
        "tree", "path", "feature", "threshold", _round("gain", 6), _round("cover", 6), "rows", _round("value", 9))


@query("explained_sample", with_ev("""SELECT user_id FROM sp WHERE is_test = 1
QUALIFY ROW_NUMBER() OVER (ORDER BY md5('42:' || user_id), user_id) <= 50""", *ML_CTES, split_cte()))
def _es(spark, d):
    """The seeded sample (50 of the test rows here)."""
    _, test = mo.split(ml(spark, d))
    return mo.seeded_sample(test, 50).select("user_id")
