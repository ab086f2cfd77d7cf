"""Reference SQL for the workload queries, for DuckDB.

The least-squares and ridge systems are solved in SQL too: moments by join, then elimination on a
list of lists in a recursive query.
"""

from __future__ import annotations

TRAIN_SHARE = 0.8
ORDER_NUMERIC = ("n_lines", "qty", "avg_disc", "order_year")
ORDER_CATEGORICAL = ("o_orderpriority", "o_orderstatus", "c_mktsegment")
# The grid of penalties.
RIDGE_GRID = (0.0, 0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 1.0, 1.5)


def _hash32(salt: str, *keys: str) -> str:
    cast = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{salt}', {cast})), 1, 8) AS BIGINT)"


def _unit(salt: str, *keys: str) -> str:
    return f"({_hash32(salt, *keys)} / CAST(4294967296 AS DOUBLE))"


def _fold(salt: str, k: int, *keys: str) -> str:
    return f"CAST({_hash32(salt, *keys)} % {k} AS INTEGER)"


ORDER_FEATURES = """order_features AS (
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS order_year,
         o_orderpriority, o_orderstatus, c_mktsegment,
         count(*) AS n_lines, sum(l_quantity) AS qty,
         round(avg(l_discount), 6) AS avg_disc, round(sum(l_extendedprice), 2) AS target
  FROM orders
  JOIN lineitem ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  GROUP BY ALL)"""

DOC_FEATURES = """doc_features AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""

MARKED = f"""marked AS (
  SELECT *, CASE WHEN {_unit('42', 'o_orderkey')} < {TRAIN_SHARE} THEN 'train' ELSE 'test' END AS split,
         {_fold('fold-42', 5, 'o_orderkey')} AS fold
  FROM order_features)"""


def _normalized(text: str) -> str:
    dashed = f"regexp_replace(lower(trim({text})), '[^a-zA-Z0-9]+', '-', 'g')"
    return f"trim({dashed}, '-')"


def _correlations(cols: tuple[str, ...], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r FROM {table}"
        for a in cols
        for b in cols
    )


def _solved(
    numeric: tuple[str, ...],
    categorical: tuple[str, ...],
    penalties: tuple[float, ...],
    folds: int = 0,
    rows: str = "train_rows",
) -> str:
    """CTEs that end in ``coef(f, lam, slot, field, category, b)`` and ``icept(f, lam, b0)``.

    ``f`` is the fold left out of the fit, or -1 for a fit on all rows. Without a penalty the
    first level of each category is left out of the system, its coefficient is 0, and afterwards
    the levels of each category are centred.
    """
    parts = [
        f"SELECT o_orderkey AS rid, fold, '{c}' AS slot, '{c}' AS field, "
        f"CAST(NULL AS VARCHAR) AS category, CAST({c} AS DOUBLE) - shift_{c} AS x "
        f"FROM {rows} CROSS JOIN shifts"
        for c in numeric
    ] + [
        f"SELECT o_orderkey, fold, '{c}_vec_' || {c}, '{c}', {c}, CAST(1 AS DOUBLE) "
        f"FROM {rows} WHERE {c} IS NOT NULL"
        for c in categorical
    ]
    long = " UNION ALL ".join(parts)
    if folds:
        fits = f"SELECT CAST(range AS INTEGER) AS f FROM range({folds})"
    else:
        fits = "SELECT CAST(-1 AS INTEGER) AS f"
    lams = ", ".join(f"(CAST({lam} AS DOUBLE))" for lam in penalties)
    # Numbers as differences from their mean, which keeps the sums of products accurate.
    shifts = ", ".join(f"avg({c}) AS shift_{c}" for c in numeric)
    shift = " ".join(f"WHEN '{c}' THEN (SELECT shift_{c} FROM shifts)" for c in numeric)
    return f"""shifts AS (SELECT {shifts} FROM {rows}),
long AS ({long}),
fits AS ({fits}),
lams(lam) AS (VALUES {lams}),
slots AS (
  SELECT slot, field, category, CASE slot {shift} ELSE 0 END AS shift,
         category IS NOT NULL AND row_number() OVER (PARTITION BY field ORDER BY slot) = 1 AS is_base
  FROM (SELECT DISTINCT slot, field, category FROM long)),
ystat AS (
  SELECT f, CAST(count(*) AS DOUBLE) AS n, avg(target) AS my, stddev_pop(target) AS sy
  FROM {rows} JOIN fits ON fold <> f GROUP BY f),
sx AS (
  SELECT f, slot, sum(x) / any_value(n) AS mx
  FROM long JOIN fits ON fold <> f JOIN ystat USING (f) GROUP BY f, slot),
sxy AS (
  SELECT f, slot, sum(x * (target - my)) / any_value(n) AS cy
  FROM long JOIN {rows} r ON r.o_orderkey = rid JOIN fits ON long.fold <> f JOIN ystat USING (f)
  GROUP BY f, slot),
sxx AS (
  SELECT f, a.slot AS s1, b.slot AS s2, sum(a.x * b.x) / any_value(n) AS xx
  FROM long a JOIN long b ON a.rid = b.rid JOIN fits ON a.fold <> f JOIN ystat USING (f)
  GROUP BY f, a.slot, b.slot),
cov AS (
  SELECT p.f, p.slot AS s1, q.slot AS s2, coalesce(xx, 0) - p.mx * q.mx AS c
  FROM sx p JOIN sx q ON p.f = q.f LEFT JOIN sxx ON sxx.f = p.f AND s1 = p.slot AND s2 = q.slot),
used AS (
  SELECT lam, slot, row_number() OVER (PARTITION BY lam ORDER BY slot) AS k
  FROM lams JOIN slots ON lam > 0 OR NOT is_base),
line AS (
  SELECT f, lam, a.k AS k,
         list(c + CASE WHEN s1 = s2 THEN lam / sy * c ELSE 0 END ORDER BY b.k) AS lhs
  FROM used a JOIN used b USING (lam) JOIN cov ON s1 = a.slot AND s2 = b.slot JOIN ystat USING (f)
  GROUP BY f, lam, a.k),
system AS (
  SELECT f, lam, CAST(0 AS BIGINT) AS i, count(*) AS size,
         list(list_append(lhs, cy) ORDER BY k) AS m
  FROM line JOIN used USING (lam, k) JOIN sxy USING (f, slot) GROUP BY f, lam),
elim AS (
  SELECT * FROM system
  UNION ALL
  SELECT f, lam, i + 1, size,
         list_transform(m, lambda row, r: CASE
           WHEN r = i + 1 THEN list_transform(row, lambda v: v / row[i + 1])
           ELSE list_transform(row, lambda v, c: v - row[i + 1] * m[i + 1][c] / m[i + 1][i + 1]) END)
  FROM elim WHERE i < size),
raw AS (
  SELECT f, lam, slot, field, category, coalesce(m[k][size + 1], 0) AS b
  FROM elim JOIN slots ON true LEFT JOIN used USING (lam, slot) WHERE i = size),
centred AS (
  SELECT f, lam, slot, field, category, b,
         CASE WHEN lam = 0 AND category IS NOT NULL
              THEN avg(b) OVER (PARTITION BY f, lam, field) ELSE 0 END AS centre
  FROM raw),
coef AS (SELECT f, lam, slot, field, category, b - centre AS b FROM centred),
icept AS (
  SELECT f, lam, any_value(my) - sum(b * (mx + shift)) AS b0,
         any_value(my) - sum(b * mx) AS b0_of_differences
  FROM coef JOIN sx USING (f, slot) JOIN slots USING (slot) JOIN ystat USING (f)
  GROUP BY f, lam)"""


def _fit(
    select: str,
    numeric: tuple[str, ...],
    categorical: tuple[str, ...] = (),
    penalties: tuple[float, ...] = (0.0,),
    folds: int = 0,
) -> str:
    return (
        f"WITH RECURSIVE {ORDER_FEATURES}, {MARKED}, "
        "train_rows AS (SELECT * FROM marked WHERE split = 'train'), "
        f"{_solved(numeric, categorical, penalties, folds)} {select}"
    )


COEFFICIENTS = """
SELECT slot AS feature, field, category, round(b, 1) + 0.0 AS coefficient,
       round(abs(b), 1) AS abs_coefficient,
       round(b * sd / (SELECT stddev_samp(target) FROM train_rows), 9) + 0.0 AS std_coefficient
FROM coef JOIN (
  SELECT s1 AS slot, sqrt(c * n / (n - 1)) AS sd FROM cov JOIN ystat USING (f) WHERE s1 = s2) USING (slot)
UNION ALL
SELECT '(intercept)', '(intercept)', NULL, round(b0, 1) + 0.0, round(abs(b0), 1), NULL FROM icept"""

ROLLUP = """
SELECT field, round(avg(abs(b)), 2) AS avg_abs_coefficient, round(sum(abs(b)), 2) AS sum_abs_coefficient,
       round(median(abs(b)), 2) AS median_abs_coefficient
FROM coef GROUP BY field"""


def _predictions(numeric: tuple[str, ...], categorical: tuple[str, ...]) -> str:
    terms = [f"{c} * (SELECT b FROM coef WHERE slot = '{c}')" for c in numeric]
    joins = ""
    for i, c in enumerate(categorical):
        joins += f" LEFT JOIN coef k{i} ON k{i}.field = '{c}' AND k{i}.category = {c}"
        terms.append(f"coalesce(k{i}.b, 0)")
    return (
        "SELECT o_orderkey, split, o_orderpriority, CAST(target AS DOUBLE) AS actual, "
        f"(SELECT b0 FROM icept) + {' + '.join(terms)} AS prediction FROM marked{joins}"
    )


def _metrics(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n,
  round(sqrt(avg((actual - prediction) * (actual - prediction))), 3) AS rmse,
  round(avg(abs(actual - prediction)), 3) AS mae,
  round(1 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual), 8) AS r2
FROM ({source}) scored GROUP BY ALL"""


def _cv(name: str, numeric: tuple[str, ...], categorical: tuple[str, ...], penalties: tuple[float, ...], best: bool = False) -> str:
    held_out = """
, pred AS (
  SELECT f, lam, rid, any_value(b0_of_differences) + sum(b * x) AS p
  FROM long JOIN coef ON long.fold = coef.f AND long.slot = coef.slot JOIN icept USING (f, lam)
  GROUP BY f, lam, rid),
by_fold AS (
  SELECT f, lam, 1 - sum((target - p) * (target - p)) / (var_pop(target) * count(*)) AS r2,
         sqrt(avg((target - p) * (target - p))) AS rmse
  FROM pred JOIN train_rows ON o_orderkey = rid GROUP BY f, lam)
"""
    if best:
        select = f"""{held_out} SELECT '{name}' AS model, 'regParam' AS param, lam AS "value"
FROM (SELECT lam, avg(r2) AS r2 FROM by_fold GROUP BY lam ORDER BY r2 DESC LIMIT 1)"""
    else:
        point = "CAST(dense_rank() OVER (ORDER BY lam) - 1 AS INTEGER)"
        select = f"""{held_out}
SELECT '{name}' AS model, {point} AS point, 'regParam' AS param, lam AS "value", 'r2' AS metric,
       round(avg(r2), 8) AS mean, round(stddev_pop(r2), 8) AS std FROM by_fold GROUP BY lam
UNION ALL
SELECT '{name}', {point}, 'regParam', lam, 'rmse', round(avg(rmse), 3), round(stddev_pop(rmse), 3)
FROM by_fold GROUP BY lam"""
    return _fit(select, numeric, categorical, penalties, folds=5)


def _describe(table: str) -> str:
    return f"""SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, column_name AS "column",
  CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
       WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END AS "type",
  "null" = 'YES' AS nullable
FROM (DESCRIBE {table})"""


def _cardinality(table: str, cols: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END "
        f"AS n_values FROM {table}"
        for c in cols
    )


DOC_TYPES = {
    "doc_id": "bigint",
    "lang": "string",
    "source": "string",
    "n_chars": "bigint",
    "quality": "int",
    "toxic": "int",
}


def _null_profile(types: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS \"type\", count(*) AS n, count({c}) AS n_non_null, "
        f"count(*) - count({c}) AS n_null, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 8) "
        f"AS null_fraction FROM {table}"
        for c, t in types.items()
    )


def _quartiles(value: str) -> str:
    return (
        f"round(quantile_cont({value}, 0.25), 4) AS q1, round(quantile_cont({value}, 0.5), 4) AS median, "
        f"round(quantile_cont({value}, 0.75), 4) AS q3"
    )


def _box(by: str) -> str:
    using = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN box USING ({by})" if by else "CROSS JOIN box"
    return f"""WITH {ORDER_FEATURES},
box AS (
  SELECT {using}quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.5) AS median,
         quantile_cont(target, 0.75) AS q3 FROM order_features {group}),
fenced AS (
  SELECT {using}target, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM order_features {join})
SELECT {using}round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence, count(*) AS n,
       min(target) FILTER (target BETWEEN lo AND hi) AS whisker_low,
       max(target) FILTER (target BETWEEN lo AND hi) AS whisker_high,
       count(*) FILTER (target NOT BETWEEN lo AND hi) AS n_outliers
FROM fenced GROUP BY {using}q1, median, q3, lo, hi"""


def _order_query(select: str) -> str:
    return f"WITH {ORDER_FEATURES} {select}"


def _doc_query(select: str) -> str:
    return f"WITH {DOC_FEATURES} {select}"


def _ranked(column: str, others: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({column}, {c}), 8) AS r, "
        f"round(abs(corr({column}, {c})), 8) AS abs_r FROM order_features"
        for c in others
    )


def _wide(cols: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature, "
        + ", ".join(f"round(corr({a}, {b}), 8) AS {b}" for b in cols)
        + " FROM order_features"
        for a in cols
    )


def _wide_gaps(width: int) -> str:
    columns = ", ".join(
        f"CASE WHEN (l_orderkey * 7 + l_linenumber) % {width} <> {k} THEN "
        f"(l_extendedprice + l_quantity * 500) * {1.0 + k}::DOUBLE + (l_partkey * {k + 3} % 997) * 100.0::DOUBLE END AS c{k:02d}"
        for k in range(width)
    )
    names = [f"c{k:02d}" for k in range(width)]
    return f"WITH gaps AS (SELECT {columns} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM gaps" for a in names for b in names
    )


def _index_of(table: str, key: str, cols: tuple[str, ...]) -> str:
    ctes = ", ".join(
        f"i{n} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) "
        f"AS {c}_idx FROM {table} GROUP BY {c})"
        for n, c in enumerate(cols)
    )
    joins = " ".join(f"JOIN i{n} USING ({c})" for n, c in enumerate(cols))
    wanted = ", ".join(f"{c}, {c}_idx" for c in cols)
    return f"WITH {ctes} SELECT {key}, {wanted} FROM {table} {joins}"


def _slot_totals() -> str:
    dummies = " UNION ALL ".join(
        f"SELECT '{c}_vec_' || {c} AS slot, '{c}' AS field, {c} AS category, "
        f"CAST(count(*) AS DOUBLE) AS total FROM order_features GROUP BY {c}"
        for c in ORDER_CATEGORICAL
    )
    numbers = " UNION ALL ".join(
        f"SELECT '{c}', '{c}', NULL, round(CAST(sum({c}) AS DOUBLE), 2) FROM order_features"
        for c in ORDER_NUMERIC
    )
    return _order_query(f"{dummies} UNION ALL {numbers}")


def _residuals(numeric: tuple[str, ...], categorical: tuple[str, ...], digits: int) -> str:
    return _fit(
        f"""SELECT o_orderkey, split, actual, round(prediction, {digits}) + 0.0 AS prediction,
  round(actual - prediction, {digits}) + 0.0 AS residual FROM ({_predictions(numeric, categorical)}) p""",
        numeric,
        categorical,
    )


def _model_report(
    name: str,
    numeric: tuple[str, ...],
    categorical: tuple[str, ...],
    penalty: float = 0.0,
) -> str:
    metrics = _metrics(_predictions(numeric, categorical), "split")
    return _fit(
        f"SELECT '{name}' AS model, * FROM ({metrics}) q", numeric, categorical, (penalty,)
    )


def _best_splits(rows: str, name: str) -> str:
    """CTE ``name``: for each node of ``rows`` the column and value whose split cuts variance most."""
    side = "({q} / {n} - ({s} / {n}) * ({s} / {n}))".format
    return f"""{name}_long AS (
  SELECT node, 'n_lines' AS f, CAST(n_lines AS DOUBLE) AS v, target AS y FROM {rows}
  UNION ALL SELECT node, 'order_year', order_year, target FROM {rows}),
{name}_sums AS (
  SELECT node, f, v, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS q
  FROM {name}_long GROUP BY node, f, v),
{name}_cuts AS (
  SELECT node, f, v, sum(n) OVER below AS nl, sum(s) OVER below AS sl, sum(q) OVER below AS ql,
         sum(n) OVER whole AS nn, sum(s) OVER whole AS ss, sum(q) OVER whole AS qq
  FROM {name}_sums
  WINDOW below AS (PARTITION BY node, f ORDER BY v), whole AS (PARTITION BY node, f)),
{name} AS (
  SELECT node, arg_max(f, gain) AS f, arg_max(v, gain) AS t, max(gain) AS gain, max(nn) AS nn
  FROM (SELECT node, f, v, nn,
          {side(q="qq", s="ss", n="nn")} - nl / nn * {side(q="ql", s="sl", n="nl")}
          - (nn - nl) / nn * {side(q="(qq - ql)", s="(ss - sl)", n="(nn - nl)")} AS gain
        FROM {name}_cuts WHERE nl < nn) g
  GROUP BY node)"""


def _tree(select: str) -> str:
    """A regression tree of depth 2; ``leaves`` has the rows with their prediction."""
    value = "CASE {b}.f WHEN 'n_lines' THEN n_lines ELSE order_year END".format
    return f"""WITH {ORDER_FEATURES}, {MARKED},
root AS (SELECT *, 0 AS node FROM marked WHERE split = 'train'),
{_best_splits("root", "first_cut")},
halves AS (
  SELECT m.*, CASE WHEN {value(b="b")} <= b.t THEN 1 ELSE 2 END AS node
  FROM marked m CROSS JOIN first_cut b),
below AS (SELECT * FROM halves WHERE split = 'train'),
{_best_splits("below", "second_cut")},
quarters AS (
  SELECT h.*, CASE WHEN {value(b="b")} <= b.t THEN 1 ELSE 2 END AS leaf
  FROM halves h JOIN second_cut b USING (node)),
means AS (SELECT node, leaf, avg(target) AS prediction FROM quarters WHERE split = 'train' GROUP BY node, leaf),
leaves AS (
  SELECT o_orderkey, split, CAST(target AS DOUBLE) AS actual, prediction
  FROM quarters JOIN means USING (node, leaf)),
gains AS (
  SELECT f, sum(gain * nn) AS g FROM (SELECT * FROM first_cut UNION ALL SELECT * FROM second_cut) c GROUP BY f),
importances AS (
  SELECT feature, coalesce(g, 0) / (SELECT sum(g) FROM gains) AS importance
  FROM (VALUES ('n_lines'), ('order_year')) v(feature) LEFT JOIN gains ON f = feature)
{select}"""


def _tree_cv(select: str) -> str:
    """Scores of trees of depth 1 and 2 over the folds; ``points`` has their mean and spread."""
    value = "CASE {b}.f WHEN 'n_lines' THEN n_lines ELSE order_year END".format
    return f"""WITH {ORDER_FEATURES}, {MARKED},
folded AS (SELECT *, {_fold('fold-42', 5, 'o_orderkey')} AS fold FROM marked WHERE split = 'train'),
turns AS (SELECT DISTINCT fold AS held FROM folded),
root AS (SELECT f.*, held AS node FROM folded f JOIN turns ON fold <> held),
{_best_splits("root", "first_cut")},
halves AS (
  SELECT m.*, held, 2 * held + CASE WHEN {value(b="b")} <= b.t THEN 0 ELSE 1 END AS node
  FROM folded m CROSS JOIN turns JOIN first_cut b ON b.node = held),
below AS (SELECT * FROM halves WHERE fold <> held),
{_best_splits("below", "second_cut")},
quarters AS (
  SELECT h.*, CASE WHEN {value(b="b")} <= b.t THEN 1 ELSE 2 END AS leaf
  FROM halves h JOIN second_cut b USING (node)),
shallow AS (SELECT node, avg(target) AS p FROM below GROUP BY node),
deep AS (SELECT node, leaf, avg(target) AS p FROM quarters WHERE fold <> held GROUP BY node, leaf),
scored AS (
  SELECT 1 AS depth, held, target AS y, p FROM halves JOIN shallow USING (node) WHERE fold = held
  UNION ALL SELECT 2, held, target, p FROM quarters JOIN deep USING (node, leaf) WHERE fold = held),
scores AS (
  SELECT depth, held, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse,
         avg(abs(y - p)) AS mae
  FROM scored GROUP BY depth, held),
points AS (
  SELECT depth, metric, avg(score) AS mean, stddev_pop(score) AS std
  FROM (UNPIVOT scores ON r2, rmse, mae INTO NAME metric VALUE score) u GROUP BY depth, metric)
{select}"""


TREE_IMPORTANCE = """SELECT feature, feature AS field, round(importance, 6) AS importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM importances"""

MEASURES = (*ORDER_NUMERIC, "target")
STRONG_GRID = (0.0, 5000.0, 20000.0, 100000.0)
LINE_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
PRIORITY = (("n_lines",), ("o_orderpriority",))
FULL = (ORDER_NUMERIC, ORDER_CATEGORICAL)


def oracle_queries() -> dict[str, str]:
    return {
        "schema_of_lineitem": _describe("lineitem"),
        "csv_round_trip": "SELECT * FROM customer",
        "csv_inferred": "SELECT * REPLACE (CAST(p_partkey AS INTEGER) AS p_partkey) FROM part",
        "parquet_round_trip": "SELECT * FROM orders",
        "correlation_csv": _order_query(_wide(MEASURES)),
        "coefficient_csv": _fit(
            "SELECT slot AS feature, round(b, 1) + 0.0 AS coefficient, round(abs(b), 1) AS abs_coefficient "
            "FROM coef",
            *FULL,
        ),
        "renamed_columns": "SELECT c_custkey AS customer_id, c_name, c_nationkey, "
        "c_acctbal AS balance, c_mktsegment AS segment FROM customer",
        "dropped_columns": "SELECT s_suppkey, s_acctbal FROM supplier",
        "normalized_priorities": f"SELECT o_orderkey, {_normalized('o_orderpriority')} "
        "AS o_orderpriority FROM orders",
        "normalized_parts": f"SELECT p_partkey, {_normalized('p_name')} AS p_name, "
        f"{_normalized('p_brand')} AS p_brand, {_normalized('p_type')} AS p_type FROM part",
        "normalized_documents": f"SELECT doc_id, {_normalized('text')} AS text FROM documents",
        "order_cardinality": _cardinality(
            "orders", ("o_orderstatus", "o_orderpriority", "o_custkey")
        ),
        "document_cardinality": _doc_query(
            _cardinality("doc_features", ("lang", "source", "quality", "toxic"))
        ),
        "clean_category_cardinality": f"WITH clean AS (SELECT {_normalized('p_type')} AS p_type, "
        f"{_normalized('p_brand')} AS p_brand FROM part) {_cardinality('clean', ('p_type', 'p_brand'))}",
        "part_types": 'SELECT p_type AS "value", count(*) AS n FROM part GROUP BY p_type',
        "label_values": _doc_query(
            'SELECT quality AS "value", count(*) AS n FROM doc_features GROUP BY quality'
        ),
        "null_profile_of_documents": _doc_query(_null_profile(DOC_TYPES, "doc_features")),
        "sparse_columns_dropped": _doc_query(
            "SELECT doc_id, lang, source, n_chars FROM doc_features"
        ),
        "correlation_matrix": _order_query(
            f"SELECT a, b, round(r, 8) AS r FROM ({_correlations(MEASURES, 'order_features')}) c"
        ),
        "correlation_matrix_of_labels": _doc_query(
            "SELECT a, b, round(r, 8) AS r FROM "
            f"({_correlations(('n_chars', 'quality', 'toxic'), 'doc_features')}) c"
        ),
        "correlation_by_blocks": "SELECT a, b, round(r, 8) AS r FROM "
        f"({_correlations(LINE_MEASURES, 'lineitem')}) c",
        "correlation_wide": _order_query(_wide(MEASURES)),
        "target_correlation": _order_query(_ranked("target", ORDER_NUMERIC)),
        "collinear_with_lines": _order_query(
            f"SELECT * FROM ({_ranked('n_lines', ORDER_NUMERIC[1:])}) c WHERE abs_r >= 0.75"
        ),
        "strongest_predictors": _order_query(
            f"SELECT * FROM ({_ranked('target', ORDER_NUMERIC)}) c ORDER BY abs_r DESC LIMIT 2"
        ),
        "distribution_by_priority": _order_query(
            "SELECT o_orderpriority, count(target) AS n, round(avg(target), 4) AS mean, "
            "round(stddev_samp(target), 4) AS std, min(target) AS min, "
            f"{_quartiles('target')}, max(target) AS max FROM order_features GROUP BY o_orderpriority"
        ),
        "line_price_quartiles": f"SELECT l_returnflag, l_linestatus, {_quartiles('l_extendedprice')} "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "box_stats_by_priority": _box("o_orderpriority"),
        "box_stats_of_target": _box(""),
        "price_histogram": """WITH binned AS (
  SELECT CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice > 110000 THEN 23
         ELSE least(CAST(floor(l_extendedprice / 5000) AS INTEGER) + 1, 22) END AS bin FROM lineitem),
counted AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)
SELECT CAST(e.bin AS INTEGER) AS bin,
       CASE WHEN e.bin > 0 THEN CAST((e.bin - 1) * 5000 AS DOUBLE) END AS lower,
       CASE WHEN e.bin < 23 THEN CAST(e.bin * 5000 AS DOUBLE) END AS upper, coalesce(n, 0) AS n
FROM (SELECT range AS bin FROM range(24)) e LEFT JOIN counted USING (bin)
WHERE e.bin BETWEEN 1 AND 22 OR n > 0""",
        "yearly_average": 'SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", count(*) AS n, '
        "round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders GROUP BY ALL",
        "yearly_average_of_orders": _order_query(
            'SELECT order_year AS "year", count(*) AS n, round(avg(n_lines), 4) AS avg_n_lines, '
            "round(avg(qty), 4) AS avg_qty, round(avg(target), 4) AS avg_target "
            "FROM order_features GROUP BY order_year"
        ),
        "scatter_sample": _order_query(
            "SELECT o_orderkey, n_lines, target FROM order_features "
            f"WHERE {_unit('scatter-42', 'o_orderkey')} < 0.1"
        ),
        "scatter_points": _order_query(
            "SELECT o_orderkey, n_lines, target FROM order_features "
            f"ORDER BY {_unit('scatter-42', 'o_orderkey')}, o_orderkey LIMIT 500"
        ),
        "auto_histogram": """WITH ends AS (SELECT min(c_acctbal) AS least, max(c_acctbal) AS greatest FROM customer),
width AS (
  SELECT pow(2.0::DOUBLE, min(e)) AS w, floor(any_value(least) / pow(2.0::DOUBLE, min(e))) AS low,
         floor(any_value(greatest) / pow(2.0::DOUBLE, min(e))) AS high
  FROM ends, range(-30, 30) r(e)
  WHERE floor(greatest / pow(2.0::DOUBLE, e)) - floor(least / pow(2.0::DOUBLE, e)) < 30),
counted AS (SELECT floor(c_acctbal / w) AS cell, count(*) AS n FROM customer, width GROUP BY cell)
SELECT CAST(cell - low + 1 AS INTEGER) AS bin, cell * w AS lower, (cell + 1) * w AS upper, coalesce(n, 0) AS n
FROM (SELECT unnest(range(CAST(low AS BIGINT), CAST(high AS BIGINT) + 1))::DOUBLE AS cell, low, w FROM width) c
LEFT JOIN counted USING (cell)""",
        "hash_split": f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN {_unit('42', 'l_orderkey', 'l_linenumber')} < 0.8 THEN 'train' ELSE 'test' END AS side
FROM lineitem""",
        "folds": "SELECT l_orderkey, l_linenumber, "
        f"{_fold('fold-42', 5, 'l_orderkey', 'l_linenumber')} AS fold FROM lineitem",
        "category_index": _index_of("part", "p_partkey", ("p_brand", "p_type")),
        "level_index": _index_of("part", "p_partkey", ("p_brand", "p_type")),
        "slot_table_of_parts": """WITH names AS (
  SELECT p_name AS category, row_number() OVER (ORDER BY count(*) DESC, p_name) - 1 AS idx FROM part GROUP BY p_name),
kinds AS (
  SELECT p_type AS category, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1
         + (SELECT count(*) FROM names) AS idx FROM part GROUP BY p_type)
SELECT idx, 'p_name_vec_' || category AS slot, 'p_name' AS field, category FROM names
UNION ALL SELECT idx, 'p_type_vec_' || category, 'p_type', category FROM kinds
UNION ALL SELECT (SELECT count(*) FROM names) + (SELECT count(*) FROM kinds), 'p_size', 'p_size', NULL""",
        "feature_slot_totals": _slot_totals(),
        "linear_numeric": _fit(COEFFICIENTS, ORDER_NUMERIC),
        "ridge_numeric": _fit(COEFFICIENTS, ORDER_NUMERIC, (), (20000.0,)),
        "linear_full": _fit(COEFFICIENTS, *FULL),
        "ridge_full": _fit(COEFFICIENTS, *FULL, (20000.0,)),
        "linear_pipeline": _fit(COEFFICIENTS, *FULL),
        "ridge_pipeline": _fit(COEFFICIENTS, *FULL, (20000.0,)),
        "linear_priority": _fit(COEFFICIENTS, *PRIORITY),
        "field_rollup": _fit(ROLLUP, *FULL),
        "ridge_field_rollup": _fit(ROLLUP, *FULL, (20000.0,)),
        "field_of_slots": """WITH every AS (
  SELECT 'p_type_vec_' || p_type AS slot, 'p_type' AS field FROM part
  UNION ALL SELECT p_brand || '_vec', p_brand FROM part
  UNION ALL SELECT p_brand, p_brand FROM part)
SELECT slot, field, count(*) AS n FROM every GROUP BY slot, field""",
        "priority_residuals": _residuals(*PRIORITY, 1),
        "full_residuals": _residuals(*FULL, 1),
        "metrics_by_priority": _fit(
            _metrics(
                f"SELECT * FROM ({_predictions(*PRIORITY)}) p WHERE split = 'test'",
                "o_orderpriority",
            ),
            *PRIORITY,
        ),
        "linear_overfit": _model_report("linear_full", *FULL),
        "linear_leaderboard": " UNION ALL ".join(
            f"SELECT * FROM ({sql}) m{i}"
            for i, sql in enumerate(
                (
                    _model_report("linear_numeric", ORDER_NUMERIC, ()),
                    _model_report("linear_full", *FULL),
                    _model_report("linear_priority", *PRIORITY),
                    _model_report("ridge_full", *FULL, 20000.0),
                )
            )
        ),
        "ridge_cv_numeric": _cv("numeric", ORDER_NUMERIC, (), RIDGE_GRID),
        "ridge_cv_full": _cv("full", *FULL, RIDGE_GRID),
        "ridge_cv_priority": _cv("priority", *PRIORITY, RIDGE_GRID),
        "ridge_cv_strong": _cv("strong", *FULL, STRONG_GRID),
        "best_penalty": _cv("strong", *FULL, STRONG_GRID, best=True),
        "cv_by_refitting": _cv("refitted", *PRIORITY, RIDGE_GRID),
        "ridge_cv_full_pipeline": 'SELECT model, point, param, "value", metric, '
        "CASE metric WHEN 'r2' THEN round(mean, 6) ELSE round(mean, 1) END AS mean, "
        "CASE metric WHEN 'r2' THEN round(std, 6) ELSE round(std, 1) END AS std "
        f"FROM ({_cv('full', *FULL, RIDGE_GRID)}) c",
        "tree_residuals": _tree(
            "SELECT o_orderkey, split, actual, round(prediction, 2) + 0.0 AS prediction, "
            "round(actual - prediction, 2) + 0.0 AS residual FROM leaves"
        ),
        "tree_metrics": _tree(
            f"SELECT 'tree' AS model, * FROM ({_metrics('SELECT * FROM leaves', 'split')}) q"
        ),
        "tree_leaderboard": " UNION ALL ".join(
            f"SELECT * FROM ({sql}) m{i}"
            for i, sql in enumerate(
                (
                    _model_report("linear_numeric", ORDER_NUMERIC, ()),
                    _tree(f"SELECT 'tree' AS model, * FROM ({_metrics('SELECT * FROM leaves', 'split')}) q"),
                    _model_report("ridge_full", *FULL, 20000.0),
                    _model_report("linear_priority", *PRIORITY),
                )
            )
        ),
        "tree_importance": _tree(TREE_IMPORTANCE),
        "importance_csv": _tree(TREE_IMPORTANCE),
        "tree_importance_by_field": _tree(
            "SELECT feature AS field, round(importance, 6) AS importance FROM importances"
        ),
        "forest_properties": f"""WITH {ORDER_FEATURES}, {MARKED}
SELECT 'rows ' || split AS name, CAST(count(*) AS DOUBLE) AS "value" FROM marked GROUP BY split
UNION ALL SELECT unnest(['importance', 'importance of fields']), 1.0
UNION ALL SELECT unnest(['slots n_lines', 'slots qty', 'slots avg_disc', 'slots order_year']), 1.0
UNION ALL SELECT 'slots o_orderpriority', count(DISTINCT o_orderpriority) FROM marked WHERE split = 'train'
UNION ALL SELECT 'slots o_orderstatus', count(DISTINCT o_orderstatus) FROM marked WHERE split = 'train'
UNION ALL SELECT 'slots c_mktsegment', count(DISTINCT c_mktsegment) FROM marked WHERE split = 'train'""",
        "small_unit_fit": f"""WITH {ORDER_FEATURES}, {MARKED},
train AS (SELECT n_lines, target FROM marked WHERE split = 'train')
SELECT 'tiny' AS feature, round(regr_slope(target, n_lines), 2) AS coefficient FROM train
UNION ALL SELECT '(intercept)', round(regr_intercept(target, n_lines), 2) FROM train""",
        "histogram_with_gaps": """WITH counted AS (
  SELECT least(CAST(floor(l_quantity / 10) AS INTEGER) + 1, 6) AS bin, count(*) AS n
  FROM lineitem WHERE l_linenumber NOT IN (2, 3) GROUP BY bin)
SELECT CAST(e.bin AS INTEGER) AS bin, CAST((e.bin - 1) * 10 AS DOUBLE) AS lower,
       CAST(e.bin * 10 AS DOUBLE) AS upper, coalesce(n, 0) AS n
FROM (SELECT range AS bin FROM range(1, 7)) e LEFT JOIN counted USING (bin)""",
        "correlation_with_gaps": """WITH pairs AS (
  SELECT l_extendedprice AS x, l_extendedprice * l_discount AS y FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT 'x' AS a, 'y' AS b, round(corr(x, y), 6) AS r FROM pairs
UNION ALL SELECT 'y', 'x', round(corr(x, y), 6) FROM pairs
UNION ALL SELECT unnest(['x', 'y']), unnest(['x', 'y']), 1.0""",
        "correlation_wide_gaps": _wide_gaps(24),
        "linear_many_levels": """WITH rows AS (
  SELECT CAST(l_orderkey % 2200 AS VARCHAR) AS level, l_quantity AS x, l_extendedprice AS y FROM lineitem),
means AS (SELECT level, avg(x) AS mx, avg(y) AS my FROM rows GROUP BY level),
slope AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM rows JOIN means USING (level)),
effects AS (SELECT level, my - b * mx AS e, avg(my - b * mx) OVER () AS centre FROM means CROSS JOIN slope)
SELECT 'level_vec_' || level AS feature, 'level' AS field, level AS category, round(e - centre, 2) + 0.0 AS coefficient
FROM effects
UNION ALL SELECT 'l_quantity', 'l_quantity', NULL, round(b, 2) + 0.0 FROM slope""",
        "gradient_many_levels": """WITH rows AS (
  SELECT CAST(l_orderkey % 2200 AS VARCHAR) AS level, l_quantity AS x, l_extendedprice AS y FROM lineitem),
means AS (SELECT level, avg(x) AS mx, avg(y) AS my FROM rows GROUP BY level),
slope AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM rows JOIN means USING (level)),
effects AS (SELECT level, my - b * mx AS e, avg(my - b * mx) OVER () AS centre FROM means CROSS JOIN slope)
SELECT 'level_vec_' || level AS feature, 'level' AS field, level AS category, round(e - centre, 2) + 0.0 AS coefficient
FROM effects
UNION ALL SELECT 'l_quantity', 'l_quantity', NULL, round(b, 2) + 0.0 FROM slope""",
        "gradient_full": _fit(COEFFICIENTS, *FULL, (20000.0,)),
        "tree_cv": _tree_cv(
            "SELECT 'tree' AS model, CAST(depth - 1 AS INTEGER) AS point, param, "
            "CASE param WHEN 'numTrees' THEN 1.0::DOUBLE WHEN 'maxDepth' THEN depth ELSE 0.0 END AS \"value\", "
            "metric, round(mean, 4) AS mean, round(std, 4) AS std FROM points "
            "CROSS JOIN (VALUES ('numTrees'), ('maxDepth'), ('minInfoGain')) p(param)"
        ),
        "best_tree": _tree_cv(
            "SELECT 'tree' AS model, unnest(['numTrees', 'maxDepth', 'minInfoGain']) AS param, "
            "unnest([1.0::DOUBLE, depth, 0.0]) AS \"value\" "
            "FROM (SELECT * FROM points WHERE metric = 'r2' ORDER BY mean DESC LIMIT 1) b"
        ),
    }
