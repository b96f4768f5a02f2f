"""The same results in DuckDB SQL, written independently of the Spark side.

Only the stand-in columns and the texts of the explanations are shared.
"""

from __future__ import annotations

from prospectra import schema, standins
from prospectra.operators import explain
from prospectra.queries import ABSENT_REQUEST_COLUMNS, HOLE

_LABEL, _ID = schema.LABEL, schema.ID
_KIND = {f.name: f.kind for f in schema.FEATURES}
_TYPES = {f.name: f.dataType.simpleString() for f in schema.customer_schema().fields}
_STAGE1 = [*schema.CUSTOMER_COLUMNS, _LABEL]
_STAGE2 = [c for c in _STAGE1 if c not in schema.DROPPED_IN_CLEANING]
_NUMERIC = [c for c in schema.CUSTOMER_COLUMNS if _TYPES[c] in ("int", "double")]
_DOUBLES = [c for c in _NUMERIC if _TYPES[c] == "double"]
_TEXT = [c for c in schema.CUSTOMER_COLUMNS if _TYPES[c] == "string"]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return ", ".join(items)


def _customer_sql() -> str:
    aggregates = {**standins.ORDER_AGGREGATES,
                  "policy_counts": "cast(count(distinct o_orderkey) as double)",
                  "fwd_max_flag": "case when count(distinct o_orderkey) >= 12 then 1 else 0 end"}
    inner = _list(f"{sql} AS {_q(name)}" for name, sql in aggregates.items())
    outer = _list(f"{standins.CUSTOMER_EXPRESSIONS.get(c, _q(c))} AS {_q(c)}" for c in schema.CUSTOMER_COLUMNS)
    return (f"SELECT {outer} FROM customer LEFT JOIN (SELECT o_custkey, {inner} FROM orders GROUP BY o_custkey) a "
            "ON c_custkey = o_custkey")


_BASE = f"""
fx_transactions AS (
  SELECT o_custkey AS accountid, concat(p_brand, ' ', p_type) AS cnttype_desc
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
targets AS (
  SELECT DISTINCT accountid FROM fx_transactions
  WHERE accountid IN (SELECT accountid FROM fx_transactions WHERE cnttype_desc = '{standins.TARGET_PRODUCT}')
    AND cnttype_desc <> '{standins.TARGET_PRODUCT}'),
fx_customer_360 AS ({_customer_sql()}),
stage1 AS (
  SELECT c.*, CASE WHEN t.accountid IS NOT NULL THEN 1 ELSE 0 END AS {_LABEL}
  FROM fx_customer_360 c LEFT JOIN targets t ON c.client_id = t.accountid),
stage2 AS (SELECT * EXCLUDE (birth_date, insured_age, policy_counts) FROM stage1),
scored AS (
  SELECT client_id, {_LABEL} AS y, (client_id * 37) % 101 + 30 * {_LABEL} AS score_i,
         cast((client_id * 37) % 101 + 30 * {_LABEL} AS double) / 131.0::double AS score
  FROM stage1)"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([_BASE, *more]) + "\n" + body


def _rounded(columns, digits: int = 6) -> str:
    """Select list with doubles rounded and dates as text."""
    out = []
    for c in columns:
        kind = _TYPES.get(c)
        value = _q(c)
        if kind == "double":
            value = f"round({_q(c)}, {digits})"
        elif kind == "date":
            value = f"cast({_q(c)} AS varchar)"
        out.append(f"{value} AS {_q(c)}")
    return _list(out)


def _melt(name: str, columns, to: str, keep=()) -> str:
    """(keep..., column_name, value) without missing values."""
    parts = []
    for c in columns:
        value = f"cast({_q(c)} AS {to})"
        where = f"{_q(c)} IS NOT NULL" + (f" AND NOT isnan({value})" if to == "double" else "")
        parts.append(f"SELECT {_list([*map(_q, keep), _s(c) + ' AS column_name', value + ' AS value'])} "
                     f"FROM stage1 WHERE {where}")
    return f"{name} AS (" + "\nUNION ALL ".join(parts) + ")"


def _clean(c: str) -> str:
    if c in (_ID, _LABEL):
        return _q(c)
    if _TYPES[c] == "double":
        return f"CASE WHEN isfinite({_q(c)}) THEN {_q(c)} ELSE 0.0::double END"
    return f"coalesce({_q(c)}, {_s('0') if _TYPES[c] == 'string' else 0})"


_CLEANED = "cleaned AS (SELECT " + _list(f"{_clean(c)} AS {_q(c)}" for c in _STAGE2) + " FROM stage2)"


# Tables and features

def _conformed() -> str:
    out = []
    for f in schema.FEATURES:
        to = {"id": "bigint", "num": "double", "flag": "double", "cat": "varchar"}[f.kind]
        default = _s(f.default) if f.kind == "cat" else str(f.default)
        if f.name in ABSENT_REQUEST_COLUMNS:
            value = f"cast({default} AS {to})"
        elif f.kind == "num":
            value = f"round(coalesce(CASE WHEN NOT isnan({_q(f.name)}) THEN {_q(f.name)} END, {default}), 6)"
        else:
            value = f"cast(coalesce({_q(f.name)}, {default}) AS {to})"
        if f.kind == "flag":
            value = f"CASE WHEN {value} > 0 THEN 1.0::double ELSE 0.0::double END"
        out.append(f"{value} AS {_q(f.name)}")
    return "SELECT " + _list(out) + " FROM stage2"


_TABLES = {
    "feature_table": _with(f"SELECT {_rounded(_STAGE1)} FROM stage1"),
    "target_accounts": _with("SELECT accountid FROM targets"),
    "target_accounts_semi": _with("SELECT accountid FROM targets"),
    "clean_features": _with(f"SELECT {_rounded(_STAGE2)} FROM stage2"),
    "normalize_columns": "SELECT c_custkey AS client_id, c_name AS full_name, c_acctbal AS account_balance, "
                         "c_mktsegment AS segment FROM customer",
    "csv_transactions": _with(
        "SELECT o_custkey AS accountid, 'say \"' || concat(p_brand, ' ', p_type) || '\";' || chr(10) || 'next' AS cnttype_desc, "
        "o_orderkey AS order_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"),
    "csv_customers": _with("SELECT " + _rounded(schema.CUSTOMER_COLUMNS)
                           + " FROM fx_customer_360"),
    "table_roundtrip": _with(f"SELECT {_rounded(schema.CUSTOMER_COLUMNS)} FROM fx_customer_360"),
    "swapped_table": _with(f"SELECT {_rounded(schema.CUSTOMER_COLUMNS)} FROM fx_customer_360"),
    "preview": _with(f"SELECT {_rounded(_STAGE1)} FROM stage1 ORDER BY client_id LIMIT 10"),
    "conform_features": _with(_conformed()),
    "clean_values": _with(f"SELECT {_rounded(_STAGE2)} FROM cleaned", _CLEANED),
    "row_ids": "SELECT count(*) AS rows, count(*) AS ids, 0::bigint AS first_id, count(*) - 1 AS last_id FROM customer",
}

# Profiling

_N = _melt("cells", _NUMERIC, "double")
_T = _melt("texts", _TEXT, "varchar")
_T_ALL = _melt("texts", ["birth_date", *_TEXT], "varchar")


def _info() -> str:
    rows = []
    for c in _STAGE1:
        dtype = "int" if c == _LABEL else _TYPES[c]
        kind = ("other" if c in (_ID, _LABEL) or dtype == "date" else
                "categorical" if dtype == "string" else "numeric")
        missing = f"{_q(c)} IS NULL" + (f" OR isnan({_q(c)})" if dtype == "double" else "")
        rows.append(f"SELECT {_s(c)} AS column_name, {_s(dtype)} AS dtype, {_s(kind)} AS kind, "
                    f"count(*) - count(*) FILTER (WHERE {missing}) AS non_null, "
                    f"count(*) FILTER (WHERE {missing}) AS missing FROM stage1")
    return "info AS (" + "\nUNION ALL ".join(rows) + ")"


_EDGES = """edges AS (
  SELECT column_name, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM (SELECT column_name, min(value) AS lo, max(value) AS hi FROM cells WHERE isfinite(value) GROUP BY 1))"""

_BOX = """box AS (
  SELECT column_name, is_target_customer, count(*) AS n, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM cells GROUP BY 1, 2)"""

_BOX_BODY = """SELECT b.column_name, b.is_target_customer, any_value(n) AS count, round(q1, 6) AS q1,
  round(median, 6) AS median, round(q3, 6) AS q3,
  round(least(q1, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))), 6) AS whisker_low,
  round(greatest(q3, max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))), 6) AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM box b JOIN cells c ON b.column_name = c.column_name AND b.is_target_customer = c.is_target_customer
GROUP BY b.column_name, b.is_target_customer, q1, median, q3"""


def _correlations(columns, digits: int = 6) -> tuple[str, str, str]:
    """(column_a, column_b, correlation); a constant side gives NULL."""
    return (
        _melt("pair_cells", columns, "double", (_ID,)),
        "grid(name) AS (SELECT unnest([" + _list(map(_s, columns)) + "]))",
        f"""pairs AS (
  SELECT p.name AS column_a, q.name AS column_b, r AS correlation FROM grid p CROSS JOIN grid q LEFT JOIN (
    SELECT a.column_name AS ca, b.column_name AS cb,
      CASE WHEN min(a.value) < max(a.value) AND min(b.value) < max(b.value) THEN
        CASE WHEN a.column_name = b.column_name THEN 1.0::double ELSE round(corr(a.value, b.value), {digits}) END END AS r
    FROM pair_cells a JOIN pair_cells b ON a.client_id = b.client_id
    WHERE isfinite(a.value) AND isfinite(b.value) GROUP BY 1, 2) m ON p.name = ca AND q.name = cb)""")


_PROFILE = {
    "class_distribution": _with(
        f"SELECT {_LABEL}, count(*) AS count, round(count(*) * 100.0::double / (SELECT count(*) FROM stage1), 2) "
        f"AS percentage FROM stage1 GROUP BY {_LABEL}"),
    "imbalance_ratio": _with(
        f"SELECT total, positives, negatives, round(CASE WHEN positives > 0 THEN negatives::double / positives "
        f"ELSE 'Infinity'::double END, 6) AS ratio FROM (SELECT count(*) AS total, "
        f"count(*) FILTER (WHERE {_LABEL} = 1) AS positives, count(*) FILTER (WHERE {_LABEL} = 0) AS negatives "
        "FROM stage1)"),
    "missing_counts": _with("SELECT column_name, missing FROM info WHERE missing > 0", _info()),
    "column_info": _with("SELECT column_name, dtype, kind, non_null FROM info", _info()),
    "column_kinds": _with("SELECT kind, count(*) AS columns, cast(sum(non_null) AS bigint) AS non_null FROM info "
                          "GROUP BY kind", _info()),
    "describe_numeric": _with(
        "SELECT n.column_name, count(value) AS count, round(avg(value), 6) AS mean, "
        "round(CASE WHEN count(*) FILTER (WHERE isinf(value)) = 0 THEN stddev_samp(value) FILTER (WHERE isfinite(value)) END, 6) AS std, "
        "round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, "
        "round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max "
        "FROM names n LEFT JOIN cells c ON n.column_name = c.column_name GROUP BY n.column_name",
        _N, "names AS (SELECT unnest([" + _list(map(_s, _NUMERIC)) + "]) AS column_name)"),
    "describe_categorical": _with(
        'SELECT column_name, cast(sum(n) AS bigint) AS count, count(*) AS "unique", '
        "first(value ORDER BY n DESC, value) AS top, max(n) AS freq "
        "FROM (SELECT column_name, value, count(*) AS n FROM texts GROUP BY 1, 2) GROUP BY 1", _T_ALL),
    "histogram": _with(
        "SELECT e.column_name, cast(b.bin AS integer) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS lower, "
        "round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS upper, count(c.value) AS count "
        "FROM edges e CROSS JOIN (SELECT unnest(range(30)) AS bin) b LEFT JOIN cells c "
        "ON c.column_name = e.column_name AND isfinite(c.value) "
        "AND least(floor((c.value - lo) * 30 / (hi - lo)), 29) = b.bin GROUP BY 1, b.bin, lo, hi", _N, _EDGES),
    "top_categories": _with(
        "SELECT column_name, value, n AS count, cast(rank AS integer) AS rank FROM (SELECT column_name, value, "
        "count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS rank "
        "FROM texts GROUP BY 1, 2) WHERE rank <= 10", _T),
    "correlation": _with("SELECT column_a, column_b, correlation FROM pairs", *_correlations(_NUMERIC)),
    "correlation_gaps_first": _with(
        "SELECT a.name AS column_a, b.name AS column_b, correlation FROM names a CROSS JOIN names b "
        "LEFT JOIN pairs ON column_a = a.name AND column_b = b.name",
        *_correlations(_DOUBLES), "names(name) AS (SELECT unnest([" + _list(map(_s, [*_DOUBLES, "tenth", "third"])) + "]))"),
    "merged_moments": _with(
        "SELECT n.column_name, (SELECT count(*) FROM stage1) AS rows, count(value) FILTER (WHERE isfinite(value)) AS count, "
        "(SELECT count(*) FROM stage1) - count(value) FILTER (WHERE isfinite(value)) AS missing, "
        "round(avg(value) FILTER (WHERE isfinite(value)), 6) AS mean, round(stddev_samp(value) FILTER (WHERE isfinite(value)), 6) AS std, "
        "round(min(value) FILTER (WHERE isfinite(value)), 6) AS min, round(max(value) FILTER (WHERE isfinite(value)), 6) AS max "
        "FROM names n LEFT JOIN cells c ON n.column_name = c.column_name GROUP BY n.column_name",
        _N, "names AS (SELECT unnest([" + _list(map(_s, _NUMERIC)) + "]) AS column_name)"),
    "merged_correlation": _with("SELECT column_a, column_b, correlation FROM pairs", *_correlations(_NUMERIC)),
    "boxplot_stats": _with(_BOX_BODY, _melt("cells", _NUMERIC, "double", (_LABEL,)), _BOX),
    "boxplot_stats_doubles": _with(_BOX_BODY, _melt("cells", _DOUBLES, "double", (_LABEL,)), _BOX),
    "target_rate": _with(
        "SELECT column_name, value, round(rate, 6) AS rate, n AS count, cast(rank AS integer) AS rank FROM ("
        f"SELECT column_name, value, avg({_LABEL}) AS rate, count(*) AS n, row_number() OVER "
        f"(PARTITION BY column_name ORDER BY avg({_LABEL}) DESC, value) AS rank FROM texts GROUP BY 1, 2) "
        "WHERE rank <= 10", _melt("texts", _TEXT, "varchar", (_LABEL,))),
    "top_k_coefficients": _with(
        "SELECT feature, round(coefficient, 6) AS coefficient, side FROM ("
        "SELECT *, 'top' AS side, row_number() OVER (ORDER BY coefficient DESC, feature) AS r FROM slopes "
        "UNION ALL SELECT *, 'bottom' AS side, row_number() OVER (ORDER BY coefficient, feature) AS r FROM slopes) "
        "WHERE r <= 20",
        *_correlations([*_NUMERIC, _LABEL], 9),
        f"slopes AS (SELECT column_b AS feature, correlation AS coefficient FROM pairs WHERE column_a = '{_LABEL}' "
        f"AND column_b <> '{_LABEL}' AND correlation IS NOT NULL)"),
    "feature_labels": _with(
        "SELECT i.column_name, i.non_null, l.label FROM info i JOIN labels_of l ON i.column_name = l.column_name",
        _info(), "labels_of(column_name, label) AS (VALUES " + _list(
            f"({_s(c)}, {_s(c.replace('_', ' ').title())})" for c in _STAGE1) + ")"),
}

# Metrics

_STEPS = """steps AS (
  SELECT {by}score_i, cast(sum(y) AS double) AS p, cast(count(*) - sum(y) AS double) AS n FROM {source} GROUP BY ALL),
ranked AS (
  SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS reached, sum(p) OVER g AS total_p, sum(n) OVER g AS total_n
  FROM steps WINDOW w AS ({part} ORDER BY score_i DESC), g AS ({part})),
measured AS (
  SELECT {by}cast(max(total_p + total_n) AS bigint) AS rows, cast(max(total_p) AS bigint) AS positives,
    CASE WHEN max(total_p) > 0 AND max(total_n) > 0 THEN sum(n * (tp - p + p / 2)) / (max(total_p) * max(total_n)) END AS roc_auc,
    CASE WHEN max(total_p) > 0 THEN sum(p / total_p * tp / reached) END AS average_precision
  FROM ranked {group})"""


def _steps(source: str = "scored", by: str = "") -> str:
    return _STEPS.format(source=source, by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "",
                         group=f"GROUP BY {by}" if by else "")


def _hash(seed: int) -> str:
    return f"substr(md5('{seed}:' || cast(client_id AS varchar)), 1, 8)"


def _fold(seed: int) -> str:
    h = _hash(seed)
    return " + ".join(f"cast({h} >= '{cut}' AS integer)" for cut in ("33333333", "66666666", "99999999", "cccccccc"))


def _cells(source: str) -> str:
    return _CELLS.replace("FROM scored)", f"FROM {source})")


_CELLS = """m AS (
  SELECT cast(count(*) FILTER (WHERE y = 0 AND score < 0.5) AS double) AS tn,
         cast(count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS double) AS fp,
         cast(count(*) FILTER (WHERE y = 1 AND score < 0.5) AS double) AS fn,
         cast(count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS double) AS tp FROM scored),
r AS (
  SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
         tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS total FROM m),
f AS (
  SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
         CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1, (tn + tp) / total AS acc FROM r)"""


def _line(name: str, p: str, r: str, f: str, support: str) -> str:
    return (f"SELECT '{name}' AS class, round({p}, 4) AS precision, round({r}, 4) AS recall, round({f}, 4) AS f1, "
            f"cast({support} AS bigint) AS support FROM f")


def _avg(x: str) -> str:
    return f"({x}0 + {x}1) / 2"


def _weighted(x: str) -> str:
    return f"({x}0 * s0 + {x}1 * s1) / total"


_REPORT = " UNION ALL ".join([
    _line("0", "p0", "r0", "f0", "s0"), _line("1", "p1", "r1", "f1", "s1"),
    _line("accuracy", "acc", "acc", "acc", "total"),
    _line("macro avg", _avg("p"), _avg("r"), _avg("f"), "total"),
    _line("weighted avg", _weighted("p"), _weighted("r"), _weighted("f"), "total")])

_METRICS = {
    "roc_auc": _with("SELECT rows, positives, round(roc_auc, 6) AS roc_auc FROM measured", _steps()),
    "average_precision": _with("SELECT rows, positives, round(average_precision, 6) AS average_precision FROM measured",
                               _steps()),
    "confusion_matrix": _with(
        "SELECT cast(a.v AS integer) AS actual, cast(p.v AS integer) AS predicted, count(s.client_id) AS count "
        "FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v) "
        "LEFT JOIN scored s ON s.y = a.v AND cast(s.score >= 0.5 AS integer) = p.v GROUP BY 1, 2"),
    "classification_report": _with(_REPORT, _CELLS),
    "cv_summary": _with(
        "SELECT count(*) AS folds, round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_pop(roc_auc), 6) AS roc_auc_std, "
        "round(avg(average_precision), 6) AS average_precision_mean, "
        "round(stddev_pop(average_precision), 6) AS average_precision_std FROM measured",
        f"folded AS (SELECT *, {_fold(43)} AS fold FROM scored)", _steps("folded", "fold")),
    "select_best": _with(
        "SELECT family, rows, positives, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision "
        "FROM measured ORDER BY measured.average_precision DESC, family LIMIT 1",
        "both_scores AS (SELECT 'logistic' AS family, y, score_i FROM scored UNION ALL "
        "SELECT 'tree', y, (client_id * 53) % 89 + 25 * y FROM scored)", _steps("both_scores", "family")),
}

# Preparation

_IMPUTED = {"int": lambda c: f"cast(coalesce({c}, 0) AS double)",
            "double": lambda c: f"round(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END, 6)",
            "string": lambda c: f"coalesce({c}, '0')"}
_SCALED = [c for c in _STAGE2 if c in _NUMERIC]


def _order_key(seed: int) -> str:
    return f"substr(md5('{seed}:' || cast(client_id AS varchar)), 1, 15)"


_IDS = f"ids AS (SELECT client_id, y AS {_LABEL}, {_order_key(42)} AS k42, {_order_key(43)} AS k43 FROM scored)"


def _ranked(key: str) -> str:
    return (f"placed AS (SELECT *, row_number() OVER (PARTITION BY {_LABEL} ORDER BY {key}) AS r, "
            f"count(*) OVER (PARTITION BY {_LABEL}) AS n FROM ids)")


_PREP = {
    "impute": _with("SELECT " + _list(
        f"{_q(c) if c in (_ID, _LABEL) else _IMPUTED[_TYPES[c]](_q(c))} AS {_q(c)}" for c in _STAGE2) + " FROM stage2"),
    "standardize": _with("SELECT client_id, " + _list(
        f"round(({_q(c)} - avg({_q(c)}) OVER ()) / CASE WHEN stddev_pop({_q(c)}) OVER () = 0 THEN 1 "
        f"ELSE stddev_pop({_q(c)}) OVER () END, 6) AS {_q(c)}" for c in _SCALED) + " FROM cleaned", _CLEANED),
    "one_hot": _with(" UNION ALL ".join(
        f"SELECT client_id, concat('{c}_', coalesce({c}, '0')) AS feature, 1.0::double AS value FROM stage2"
        for c in _TEXT)),
    "class_weights": _with(
        f"SELECT {_LABEL}, n AS count, round(cast(sum(n) OVER () AS double) / (count(*) OVER () * n), 6) AS weight "
        f"FROM (SELECT {_LABEL}, count(*) AS n FROM stage2 GROUP BY 1)"),
    "split_hash": _with(f"SELECT client_id, y AS {_LABEL}, cast({_hash(42)} < '33333333' AS integer) AS is_test "
                        "FROM scored"),
    "split_exact": _with(f"SELECT client_id, {_LABEL}, cast(r <= round(n * 0.2) AS integer) AS is_test FROM placed",
                         _IDS, _ranked("k42")),
    "kfold_assign": _with(f"SELECT client_id, y AS {_LABEL}, {_fold(43)} AS fold FROM scored"),
    "kfold_exact": _with(f"SELECT client_id, {_LABEL}, " + " + ".join(
        f"cast(r > round(n * {share}) AS integer)" for share in (0.2, 0.4, 0.6, 0.8)) + " AS fold FROM placed",
        _IDS, _ranked("k43")),
}

# Models: what SQL can know of them.  Sides and folds are ranked like the exact split and folds.

_SIDES = (
    "sides AS (SELECT client_id, " + _LABEL + ", k43, cast(r <= round(n * 0.2) AS integer) AS is_test FROM placed)",
    f"""ranked_sides AS (SELECT *, row_number() OVER (PARTITION BY {_LABEL}, is_test ORDER BY k43) AS r2,
  count(*) OVER (PARTITION BY {_LABEL}, is_test) AS n2 FROM sides)""",
    f"marked AS (SELECT client_id, {_LABEL}, is_test, " + " + ".join(
        f"cast(r2 > round(n2 * {share}) AS integer)" for share in (0.2, 0.4, 0.6, 0.8)) + " AS fold FROM ranked_sides)")
_MARKED = (_IDS, _ranked("k42"), *_SIDES)
_FEATURES = [c for c in _STAGE2 if c not in (_ID, _LABEL)]
_SLOTS = "slots(slot, feature) AS (SELECT cast(row_number() OVER (ORDER BY part, feature_order, feature) - 1 AS integer), feature FROM (" + (
    " UNION ALL ".join([f"SELECT 0 AS part, {i} AS feature_order, {_s(c)} AS feature"
                        for i, c in enumerate(c for c in _FEATURES if c in _NUMERIC)]
                       + [f"SELECT 1, {i}, concat({_s(c + '_')}, level) FROM (SELECT DISTINCT coalesce({_q(c)}, '0') AS level "
                          "FROM stage2 JOIN marked USING (client_id) WHERE is_test = 0)"
                          for i, c in enumerate(c for c in _FEATURES if c in _TEXT)])) + "))"
_BOTH = "(VALUES ('logistic'), ('tree')) f(family)"

def _gini(a: str, b: str) -> str:
    return f"(1.0 - ({a} / ({a} + {b})) * ({a} / ({a} + {b})) - ({b} / ({a} + {b})) * ({b} / ({a} + {b})))"


def _tree(depth: int = 5, leaf_rows: int = 50) -> tuple[str, ...]:
    """A tree fitted on the training side: ``placed<k>`` has each customer's node at depth k, ``best<k>`` the cuts there."""
    cells = _list(
        "{'pos': " + f"{i}, 'value': coalesce(cast({_q(c)} AS double), 0), 'level': cast(NULL AS varchar)" + "}" if c in _NUMERIC else
        "{'pos': " + f"{i}, 'value': cast(0 AS double), 'level': coalesce({_q(c)}, '0')" + "}"
        for i, c in enumerate(_TREE_COLUMNS))
    out = [f"cells AS (SELECT client_id, c.pos AS pos, c.value AS value, c.level AS level FROM (SELECT client_id, unnest([{cells}]) AS c FROM cleaned))",
           f"placed0 AS (SELECT client_id, {_LABEL} AS y, is_test, cast(1 AS bigint) AS node FROM marked)",
           "class_weights AS (SELECT cast(count(*) AS double) / (2 * sum(1 - y)) AS w0, cast(count(*) AS double) / (2 * sum(y)) AS w1 "
           "FROM placed0 WHERE is_test = 0)"]
    left, right, whole = ("w0 * l0", "w1 * l1"), ("w0 * (t0 - l0)", "w1 * (t1 - l1)"), ("w0 * t0", "w1 * t1")
    gain = (f"{_gini(*whole)} - (({left[0]} + {left[1]}) / ({whole[0]} + {whole[1]})) * {_gini(*left)}"
            f" - (({right[0]} + {right[1]}) / ({whole[0]} + {whole[1]})) * {_gini(*right)}")
    for k in range(depth):
        out += [
            f"counts{k} AS (SELECT node, pos, value, level, sum(1 - y) AS n0, sum(y) AS n1 FROM placed{k} JOIN cells USING (client_id) "
            "WHERE is_test = 0 GROUP BY node, pos, value, level)",
            f"totals{k} AS (SELECT node, sum(1 - y) AS t0, sum(y) AS t1 FROM placed{k} WHERE is_test = 0 GROUP BY node HAVING min(y) < max(y))",
            f"""cuts{k} AS (
  SELECT node, pos, value, level, t0, t1, lead(value) OVER w AS following,
    CASE WHEN level IS NULL THEN sum(n0) OVER w ELSE t0 - n0 END AS l0, CASE WHEN level IS NULL THEN sum(n1) OVER w ELSE t1 - n1 END AS l1
  FROM counts{k} JOIN totals{k} USING (node) WINDOW w AS (PARTITION BY node, pos ORDER BY value))""",
            f"""best{k} AS (
  SELECT node, pos, level, {gain} AS gain,
    CASE WHEN level IS NULL THEN CASE WHEN (value + following) / 2 < following THEN (value + following) / 2 ELSE value END END AS threshold
  FROM cuts{k} CROSS JOIN class_weights WHERE l0 + l1 >= {leaf_rows} AND t0 + t1 - l0 - l1 >= {leaf_rows}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, pos, value, cuts{k}.level) = 1)""",
            f"""placed{k + 1} AS (
  SELECT p.client_id, y, is_test, CASE WHEN b.node IS NULL THEN p.node ELSE 2 * p.node + cast(
    CASE WHEN b.level IS NULL THEN c.value > b.threshold ELSE c.level = b.level END AS bigint) END AS node
  FROM placed{k} p LEFT JOIN best{k} b ON b.node = p.node LEFT JOIN cells c ON c.client_id = p.client_id AND c.pos = b.pos)"""]
    names = _list(f"({i}, {_s(c)})" for i, c in enumerate(_TREE_COLUMNS))
    every = " UNION ".join(f"SELECT node, count(*) AS rows, cast(sum(y) AS bigint) AS positives FROM placed{k} WHERE is_test = 0 GROUP BY node"
                           for k in range(depth + 1))
    cuts = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(depth))
    a, b = "w0 * (rows - positives)", "w1 * positives"
    out += [f"cut_names(pos, column_name) AS (VALUES {names})", f"every AS ({every})", f"cuts AS ({cuts})",
            f"""tree AS (
  SELECT node, cast(length(bin(node)) - 1 AS integer) AS depth, rows, positives, {a} + {b} AS weight,
    {_gini(a, b)} AS impurity, {b} / ({a} + {b}) AS probability, column_name, level, threshold, gain
  FROM every CROSS JOIN class_weights LEFT JOIN cuts USING (node) LEFT JOIN cut_names USING (pos))"""]
    return tuple(out)


_TREE_COLUMNS = [*[c for c in _FEATURES if c in _NUMERIC], *[c for c in _FEATURES if c not in _NUMERIC]]

_TESTED = "tested AS (SELECT y, probability AS score, probability AS score_i FROM placed5 JOIN tree USING (node) WHERE is_test = 1)"

_MODELS = {
    "exact_tree": _with("SELECT node, depth, rows, positives, round(weight, 6) AS weight, round(impurity, 6) AS impurity, "
                        "round(probability, 6) AS probability, column_name, level, round(threshold, 6) AS threshold, "
                        "round(gain, 6) AS gain FROM tree", _CLEANED, *_MARKED, *_tree()),
    "exact_tree_importances": _with(
        "SELECT feature, round(taken / sum(taken) OVER (), 6) AS importance FROM (SELECT column_name || coalesce('_' || level, '') AS feature, "
        "sum(weight * gain) AS taken FROM tree WHERE column_name IS NOT NULL GROUP BY feature)", _CLEANED, *_MARKED, *_tree()),
    "exact_tree_scores": _with(
        "SELECT client_id, node AS leaf, round(probability, 6) AS score, cast(probability >= 0.2 AS integer) AS flag "
        "FROM placed5 JOIN tree USING (node)", _CLEANED, *_MARKED, *_tree()),
    "exact_tree_metrics": _with(
        "SELECT rows, positives, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM measured",
        _CLEANED, *_MARKED, *_tree(), _TESTED, _steps("tested")),
    "exact_tree_report": _with(_REPORT, _CLEANED, *_MARKED, *_tree(), _TESTED, _cells("tested")),
    "train_folds": _with(f"SELECT client_id, {_LABEL}, is_test, fold FROM marked", *_MARKED),
    "cv_scores": _with(f"SELECT family, fold, count(*) AS rows, cast(sum({_LABEL}) AS bigint) AS positives, true AS metrics_in_range "
                       f"FROM marked CROSS JOIN {_BOTH} WHERE is_test = 0 GROUP BY family, fold", *_MARKED),
    "train_and_select": _with(f"SELECT family, count(*) AS rows, cast(sum({_LABEL}) AS bigint) AS positives, true AS choice_is_best "
                              f"FROM marked CROSS JOIN {_BOTH} WHERE is_test = 1 GROUP BY family", *_MARKED),
    "model_report": _with(f"SELECT cast({_LABEL} AS varchar) AS class, count(*) AS support FROM marked WHERE is_test = 1 "
                          f"GROUP BY {_LABEL}", *_MARKED),
    "coefficients": _with("SELECT slot, feature FROM slots", *_MARKED, _SLOTS),
    "train_logistic": _with("SELECT feature, true AS at_optimum FROM slots", *_MARKED, _SLOTS),
    "importances": _with("SELECT count(*) AS slots, true AS sum_is_one, true AS none_negative FROM slots", *_MARKED, _SLOTS),
    "train_tree": _with("SELECT count(*) AS rows, true AS leaves_are_large, true AS depth_is_bounded FROM marked "
                        "WHERE is_test = 0", *_MARKED),
    "score_batch": _with("SELECT client_id, true AS in_range, true AS flag_follows, true AS coefficients_agree FROM stage2"),
}

# Scores and explanations

_SCORE = "1 / (1 + exp(-({} + {})))".format(standins.LINEAR_INTERCEPT, " + ".join(
    f"coalesce(cast({_q(c)} AS double), 0) * {w}::double" for c, w in standins.LINEAR_WEIGHTS.items()))
_LINEAR = f"linear AS (SELECT *, {_SCORE} AS score FROM cleaned)"


def _labels(names: dict[str, str]) -> str:
    return "concat_ws(', ', " + _list(f"CASE WHEN {_q(c)} > 0 THEN {_s(t)} END" for c, t in names.items()) + ")"


def _rule_rows() -> list[tuple[str, str, str]]:
    """(rule, condition, sentence)"""
    return [
        ("age", "ages <> ''", "'Age band: ' || ages || '.'"),
        ("relationship", "fwd_max_flag > 0", "'Holds the strongest relationship status.'"),
        ("yearly", "yearly_payment > 0", "'Pays premiums yearly.'"),
        ("monthly", "monthly_payment > 0", "'Pays premiums monthly.'"),
        ("online", "ecomm_counts > 0", "'Buys online.'"),
        ("channel", "bank_transfer_payment > 0 OR credit_card_payment > 0",
         "'Pays by bank transfer or credit card.'"),
        ("premium", "ape_sums > 0",
         "'Annual premium of about ' || format('{:,}', cast(round_even(ape_sums, 0) AS bigint)) || '.'"),
        ("policies", "inforce_counts > 0",
         "'Policies in force: ' || cast(cast(round_even(inforce_counts, 0) AS bigint) AS varchar) || '.'"),
        ("interests", "interests <> ''", "'Interested in ' || interests || '.'"),
        ("segment", "true", "CASE WHEN score >= 0.5 THEN 'High' WHEN score >= 0.2 THEN 'Medium' ELSE 'Low' END "
                            "|| ' potential.'"),
    ]


_EXPLAINED = (f"explained AS (SELECT *, {_labels(explain.AGE_LABELS)} AS ages, "
              f"{_labels(explain.INTEREST_LABELS)} AS interests FROM linear)")
_SAID = _list(f"CASE WHEN {on} THEN {text} END" for _, on, text in _rule_rows())
_NAMED = _list(f"CASE WHEN {on} THEN '{name}' END" for name, on, _ in _rule_rows())
_COUNTED = " + ".join(f"cast(coalesce({on}, false) AS bigint)" for _, on, _ in _rule_rows())

_FLAGGED = (f"flagged AS (SELECT client_id AS scored_id, round(score, 6) AS score FROM linear "
            f"WHERE round(score, 6) >= {schema.FLAG_THRESHOLD})")

_SCORES = {
    "score_linear": _with("SELECT client_id, round(score, 6) AS score, cast(score >= 0.2 AS integer) AS flag "
                          "FROM linear", _CLEANED, _LINEAR),
    "flag_scores": _with("SELECT client_id, round(score, 6) AS score, cast(score >= 0.2 AS integer) AS flag, "
                         "cast(score >= 0.5 AS integer) AS predicted FROM scored"),
    "segments": _with(
        "SELECT client_id, CASE WHEN s IS NOT NULL THEN round(greatest(0, least(1, s)), 6) END AS clamped, CASE WHEN s >= 0.5 THEN 'High' "
        "WHEN s >= 0.2 THEN 'Medium' ELSE 'Low' END AS segment FROM (SELECT client_id, "
        "CASE WHEN client_id % 13 <> 0 AND client_id % 11 <> 0 THEN score * 1.5::double - 0.25::double END AS s "
        "FROM scored)"),
    "percent_labels": _with("SELECT client_id, printf('%.2f', cast(score_i AS double) / 128 * 100) || '%' AS percent "
                            "FROM scored"),
    "explanations": _with(
        f"SELECT client_id, concat_ws(' | ', {_SAID}) AS explanations, concat_ws(',', {_NAMED}) AS rules, "
        f"{_COUNTED} AS sentences FROM explained", _CLEANED, _LINEAR, _EXPLAINED),
    "explanation_counts": _with(" UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS customers FROM explained WHERE {on} HAVING count(*) > 0"
        for name, on, _ in _rule_rows()), _CLEANED, _LINEAR, _EXPLAINED),
    "driver_texts": _with(
        "SELECT feature, coalesce(text, 'Driver ' || rank || ': ' || feature || CASE WHEN coefficient >= 0 THEN ' raises' "
        "ELSE ' lowers' END || ' the score.') AS text, customers FROM (SELECT *, row_number() OVER (ORDER BY abs(coefficient) DESC, "
        "feature) AS rank FROM given) JOIN held USING (feature) LEFT JOIN texts t ON lower(t.key) = lower(feature) WHERE rank <= 3 "
        "AND customers > 0",
        "given(feature, coefficient) AS (VALUES " + _list(f"({_s(k)}, {v}::double)" for k, v in standins.LINEAR_WEIGHTS.items()) + ")",
        "texts(key, text) AS (VALUES " + _list(f"({_s(k)}, {_s(v)})" for k, v in standins.DRIVER_TEXTS.items()) + ")",
        "held AS (" + " UNION ALL ".join(f"SELECT {_s(c)} AS feature, count(*) FILTER (WHERE {_q(c)} > 0) AS customers FROM stage2"
                                         for c in standins.LINEAR_WEIGHTS) + ")"),
    "prospects": _with(
        f"SELECT {_rounded(schema.CUSTOMER_COLUMNS)}, score, 1::integer AS flag FROM flagged "
        "LEFT JOIN fx_customer_360 ON client_id = scored_id", _CLEANED, _LINEAR, _FLAGGED),
    "prospects_unmatched": _with(
        "SELECT count(*) AS rows, min(score) AS lowest, max(score) AS highest FROM flagged "
        f"WHERE CASE WHEN scored_id % {HOLE} = 0 THEN -scored_id ELSE scored_id END NOT IN "
        "(SELECT client_id FROM fx_customer_360)",
        _CLEANED, _LINEAR, _FLAGGED),
}

_SCORES["scored_sink"] = _SCORES["score_linear"]

ORACLE_SQL: dict[str, str] = {**_TABLES, **_PROFILE, **_METRICS, **_PREP, **_MODELS, **_SCORES}
