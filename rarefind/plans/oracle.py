"""The same results as SQL over the given tables, for a second engine to check."""

from __future__ import annotations

from rarefind.operators.project import PUBLISHED_DROPPED, PUBLISHED_FLAGS
from rarefind.plans.fixtures import (
    COMPONENT_FLAGS,
    COMPONENTS,
    FEATURES,
    PUBLISHED_COMPONENTS,
    ROW_KEYS,
)
from rarefind.operators.search import PUBLISHED_FOLDS, PUBLISHED_RATES
from rarefind.plans.queries import GRID_RULES, RULE_CUTS, RULE_FOLDS, RULE_RATES

_K = ", ".join(ROW_KEYS)
_F = ", ".join(FEATURES)

_TXN = """txn AS (
  SELECT l_orderkey, l_linenumber AS l_lineno, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, CAST(l_linenumber AS double) AS l_linenumber,
         CAST(CASE WHEN l_discount >= 0.09 AND l_quantity >= 46 THEN 1 ELSE 0 END AS double) AS Class
  FROM lineitem)"""

_PCA = "pca AS (SELECT vec_id, {}, CAST(CASE WHEN label = 0 THEN 1 ELSE 0 END AS double) AS Class FROM embeddings)".format(
    ", ".join(f"CAST(embedding[{i + 1}] AS double) AS {c}" for i, c in enumerate(COMPONENTS))
)

_SCORED = """scored AS (
  SELECT *, Class AS label,
         CAST(CASE WHEN l_quantity >= 46 AND l_discount >= 0.08 THEN 1 ELSE 0 END AS double) AS prediction
  FROM txn)"""

_COUNTS = """counts AS (
  SELECT CAST(count(*) FILTER (prediction = 1 AND label = 1) AS bigint) AS tp,
         CAST(count(*) FILTER (prediction = 1 AND label = 0) AS bigint) AS fp,
         CAST(count(*) FILTER (prediction = 0 AND label = 1) AS bigint) AS fn
  FROM scored)"""


def _u(salt: str) -> str:
    text = f"md5('{salt}' || l_orderkey || '-' || l_lineno || '-' || l_partkey)"
    return f"(CAST('0x' || substr({text}, 1, 8) AS bigint) / CAST(4294967296 AS double))"


def _rank_hash(salt: str) -> str:
    text = f"md5('{salt}' || l_orderkey || '-' || l_lineno || '-' || l_partkey || '-' || l_suppkey)"
    return f"CAST('0x' || substr({text}, 1, 15) AS bigint)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _f1(tp: str, fp: str, fn: str, scale: str) -> str:
    p = f"(CAST({tp} AS double) / ({tp} + {fp}))"
    r = f"(CAST({tp} AS double) / ({tp} + {fn}))"
    return (
        f"CASE WHEN {tp} = 0 THEN CAST(0 AS double) "
        f"ELSE 2 / (1 / {r} + 1 / ({p} / ({p} + (1 - {p}) * {scale}))) END"
    )


_MISSING = {"null": "NULL", "zero": "CAST(0 AS double)"}


def _raw(missing: str, class_text: str) -> str:
    values = ", ".join(
        c if c == "l_linenumber" else f"CASE WHEN l_lineno = 1 THEN {_MISSING[missing]} ELSE {c} END AS {c}"
        for c in FEATURES
    )
    return f"{_with(_TXN)}SELECT {_K}, {values}, {class_text} FROM txn"


_QUOTED = """'"' || CAST(CAST(Class AS int) AS varchar) || '"' AS class_text"""
_UNQUOTED = "CAST(CAST(Class AS int) AS varchar) AS class_text"


def _moments(where: str) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES)
    return f"moments AS (SELECT {parts} FROM txn WHERE {where})"


def _zscore(where: str) -> str:
    scaled = ", ".join(
        f"CASE WHEN s_{c} = 0 THEN CAST(0 AS double) ELSE round(({c} - m_{c}) / s_{c}, 6) END AS {c}"
        for c in FEATURES
    )
    return f"{_with(_TXN, _moments(where))}SELECT {_K}, {scaled} FROM txn, moments"


def _flags(spec, suffix: str) -> str:
    return ", ".join(
        f"CAST(CASE WHEN {c} {op} {cut} THEN 1 ELSE 0 END AS int) AS {c}{suffix}" for c, op, cut in spec
    )


def _ranked(by: str, salt: str) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER ({by} ORDER BY {_rank_hash(salt)}, {_K}) AS rn, count(*) OVER ({by}) AS n
  FROM txn)"""


_TRIALS = """trials AS (
{}
)""".format(
    "\nUNION ALL\n".join(
        f"""  SELECT CAST({k * len(RULE_CUTS) + j} AS int) AS trial, CAST({rate} AS double) AS rate,
         CAST({j} AS int) AS grid_id, fold,
         CAST(count(*) FILTER (hit AND Class = 1) AS bigint) AS tp,
         CAST(count(*) FILTER (hit AND Class = 0) AS bigint) AS fp,
         CAST(count(*) FILTER (NOT hit AND Class = 1) AS bigint) AS fn
  FROM (SELECT *, (l_quantity >= {q} AND l_discount >= {d} AND (Class = 1 OR u < {rate})) AS hit FROM folded)
  GROUP BY fold"""
        for k, rate in enumerate(RULE_RATES)
        for j, (q, d) in enumerate(RULE_CUTS)
    )
)
_FOLDED = f"""folded AS (
  SELECT *, CAST(floor({_u("fold:")} * {RULE_FOLDS}) AS int) AS fold, {_u("under:")} AS u FROM txn)"""
_METRICS = f"metrics AS (SELECT *, {_f1('tp', 'fp', 'fn', '(1 / rate)')} AS metric FROM trials)"


def _describe() -> str:
    rows = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, CAST(count({c}) AS bigint) AS count, round(avg({c}), 7) AS mean,
       round(stddev_samp({c}), 7) AS std, round(min({c}), 7) AS min,
       round(quantile_cont({c}, 0.25), 7) AS p25, round(quantile_cont({c}, 0.5), 7) AS p50,
       round(quantile_cont({c}, 0.75), 7) AS p75, round(max({c}), 7) AS max FROM txn"""
        for c in [*FEATURES, "Class"]
    )
    return _with(_TXN) + rows


def _histogram(source: str, name: str, columns: list[str]) -> str:
    cells = "\nUNION ALL\n".join(
        f"SELECT Class AS class, '{c}' AS feature, {c} AS x FROM {name}" for c in columns
    )
    return _with(
        source,
        f"cells AS (\n{cells})",
        "ranges AS (SELECT class, feature, min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM cells GROUP BY ALL)",
    ) + """SELECT class, feature,
       CASE WHEN w > 0 THEN CAST(least(floor((x - lo) / w), 49) AS bigint) ELSE CAST(0 AS bigint) END AS bin,
       CAST(count(*) AS bigint) AS n
FROM cells JOIN ranges USING (class, feature) GROUP BY ALL"""


def _chi_square() -> str:
    cells = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {i} AS place, floor({c}) AS v, Class AS y FROM pca"
        for i, c in enumerate(COMPONENTS)
    )
    return _with(
        _PCA,
        f"cells AS (\n{cells})",
        "observed AS (SELECT feature, v, y, count(*) AS o FROM cells GROUP BY ALL)",
        "by_value AS (SELECT feature, v, count(*) AS r FROM cells GROUP BY ALL)",
        "by_class AS (SELECT feature, y, count(*) AS c FROM cells GROUP BY ALL)",
        "sizes AS (SELECT feature, count(*) AS n FROM cells GROUP BY ALL)",
        """terms AS (
  SELECT feature, v, y, r * CAST(c AS double) / n AS e, coalesce(o, 0) AS o
  FROM by_value JOIN by_class USING (feature) JOIN sizes USING (feature)
  LEFT JOIN observed USING (feature, v, y))""",
        """scores AS (
  SELECT feature, sum((o - e) * (o - e) / e) AS statistic,
         CAST((count(DISTINCT v) - 1) * (count(DISTINCT y) - 1) AS bigint) AS dof
  FROM terms GROUP BY feature)""",
    ) + """SELECT feature, round(statistic, 4) AS statistic, dof,
       row_number() OVER (ORDER BY round(statistic, 9) DESC, place) <= 30 AS selected
FROM scores JOIN (SELECT DISTINCT feature, place FROM cells) USING (feature)"""


def _rule_grid() -> str:
    rules = ", ".join(f"({i}, {q}, {d})" for i, (q, d) in enumerate(GRID_RULES))
    rates = ", ".join(f"({i}, CAST({r} AS double))" for i, r in enumerate(PUBLISHED_RATES))
    folded = _FOLDED.replace(f"* {RULE_FOLDS}", f"* {PUBLISHED_FOLDS}")
    hit = "(l_quantity >= q AND l_discount >= d AND (Class = 1 OR u < rate))"
    trials = f"""trials AS (
  SELECT CAST(k * {len(GRID_RULES)} + j AS int) AS trial, rate, CAST(j AS int) AS grid_id, fold,
         CAST(count(*) FILTER ({hit} AND Class = 1) AS bigint) AS tp,
         CAST(count(*) FILTER ({hit} AND Class = 0) AS bigint) AS fp,
         CAST(count(*) FILTER (NOT {hit} AND Class = 1 ) AS bigint) AS fn
  FROM folded, (VALUES {rules}) AS rules(j, q, d), (VALUES {rates}) AS rates(k, rate)
  GROUP BY ALL)"""
    return f"{_with(_TXN, folded, trials, _METRICS)}SELECT * REPLACE (round(metric, 6) AS metric) FROM metrics"


def _network_report() -> str:
    def ranked(name: str, source: str, salt: str, by: str) -> str:
        order = f"CAST('0x' || substr(md5('{salt}' || vec_id), 1, 15) AS bigint), vec_id"
        return (
            f"{name} AS (SELECT *, row_number() OVER ({by} ORDER BY {order}) AS rn, "
            f"count(*) OVER ({by}) AS n FROM {source})"
        )

    return _with(
        "rows AS (SELECT vec_id, CAST(CASE WHEN label = 0 THEN 1 ELSE 0 END AS double) AS Class FROM embeddings)",
        ranked("sampled", "rows", "sample:", "PARTITION BY Class"),
        "held_out AS (SELECT vec_id, Class FROM sampled WHERE rn > round(0.8 * n))",
        ranked("halves", "held_out", "shuffle:", ""),
    ) + """SELECT 'train' AS part, Class AS label, CAST(count(*) AS bigint) AS n, true AS report_ok
FROM sampled WHERE rn <= round(0.8 * n) GROUP BY Class
UNION ALL
SELECT 'test', Class, CAST(count(*) AS bigint), true FROM halves WHERE rn > n // 2 GROUP BY Class"""


def _vector_index() -> str:
    codes = ",\n".join(
        f"""codes_{c} AS (
  SELECT {c} AS v, row_number() OVER (ORDER BY CASE WHEN {c} = 0 THEN 0 ELSE 1 END, {c}) - 1 AS code,
         count(*) OVER () AS m
  FROM (SELECT DISTINCT {c} FROM txn))"""
        for c in FEATURES
    )
    joins = " ".join(f"JOIN codes_{c} ON txn.{c} = codes_{c}.v" for c in FEATURES)
    values = ", ".join(
        f"CAST(CASE WHEN codes_{c}.m <= 10 THEN codes_{c}.code ELSE txn.{c} END AS double) AS {c}"
        for c in FEATURES
    )
    return f"{_with(_TXN, codes)}SELECT {_K}, {values} FROM txn {joins}"


def _index_by_frequency(value: str, source: str) -> str:
    return f"""SELECT {value}, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({value} AS varchar)) - 1 AS double)
       AS label FROM {source} GROUP BY {value}"""


def _support(flag: str) -> str:
    return (
        f"{_with(_TXN)}SELECT Class AS label, CAST(count(*) AS bigint) AS n, true AS {flag} "
        f"FROM txn WHERE {_u('split:')} >= 0.6 GROUP BY Class"
    )


def _trial_counts(n_maps: int) -> str:
    """Trials of a search over three rates and folds: how many, and the positives of their validation rows."""
    rates = ", ".join(f"(CAST({r} AS double))" for r in PUBLISHED_RATES)
    return f"""{_with(_TXN)}SELECT rate, fold, CAST({n_maps} AS bigint) AS trials,
       CAST({n_maps} * count(*) FILTER (Class = 1) AS bigint) AS positives, true AS quality_ok
FROM (SELECT Class, CAST(floor({_u("fold:")} * 3) AS int) AS fold FROM txn WHERE {_u("split:")} < 0.6),
     (VALUES {rates}) AS r(rate)
GROUP BY rate, fold"""


_SQL = {
    "read_raw_csv": _raw("null", _QUOTED),
    "drop_header_rows": _raw("null", _QUOTED),
    "read_typed_csv": _raw("null", "Class"),
    "preview": f"{_with(_TXN)}SELECT * FROM txn ORDER BY {_K} LIMIT 20",
    "strip_quoted_flags": _raw("null", _UNQUOTED),
    "null_text_to_zero": _raw("zero", _QUOTED),
    "cast_all_double": (
        "SELECT "
        + ", ".join(f"CAST({k} AS double) AS {k}" for k in ROW_KEYS)
        + f", {_F}, Class FROM ({_raw('zero', 'Class')})"
    ),
    "bad_number_counts": _with(_TXN)
    + "SELECT "
    + ", ".join(f"CAST(0 AS bigint) AS {c}" for c in [*ROW_KEYS, "l_linenumber"])
    + ", "
    + ", ".join(
        f"CAST(count(*) FILTER (l_lineno = 1) AS bigint) AS {c}" for c in FEATURES if c != "l_linenumber"
    )
    + ", CAST(count(*) AS bigint) AS Class FROM txn",
    "floor_discretize": _with(_PCA)
    + f"SELECT vec_id, {', '.join(f'floor({c}) AS {c}' for c in COMPONENTS)}, Class FROM pca",
    "drop_columns": f"{_with(_PCA)}SELECT * EXCLUDE ({', '.join(PUBLISHED_DROPPED)}) FROM pca",
    "slice_columns": f"{_with(_PCA)}SELECT {', '.join(PUBLISHED_COMPONENTS)} FROM pca",
    "rename_column": f"{_with(_TXN)}SELECT {_K}, Class AS Fraud FROM txn",
    "threshold_flags": _with(_PCA)
    + f"SELECT *, {_flags(COMPONENT_FLAGS, '_')}, {_flags(PUBLISHED_FLAGS, '_published')} FROM pca",
    "complement_label": f"{_with(_TXN)}SELECT {_K}, Class, CAST(1 - Class AS int) AS Normal FROM txn",
    "stack_label_columns": f"{_with(_TXN)}SELECT {_K}, Class AS Fraud, CAST(1 - Class AS int) AS Normal FROM txn",
    "filter_class": f"{_with(_TXN)}SELECT * FROM txn WHERE Class = 1",
    "add_random_column": f"{_with(_TXN)}SELECT {_K}, {_u('fold:')} AS _rand FROM txn",
    "range_filter": f"""{_with(_TXN)}SELECT {_K}, {_u("fold:")} AS _rand FROM txn
WHERE {_u("fold:")} >= 0.2 AND {_u("fold:")} < 0.4""",
    "complement_filter": f"""{_with(_TXN)}SELECT {_K}, {_u("fold:")} AS _rand FROM txn
WHERE NOT ({_u("fold:")} >= 0.2 AND {_u("fold:")} < 0.4)""",
    "class_weight": f"""{_with(_TXN, "w AS (SELECT count(*) / sum(Class) * 1.25 AS w FROM txn)")}
SELECT {_K}, Class, CASE WHEN Class = 1 THEN round(w, 6) ELSE CAST(1 AS double) END AS weight FROM txn, w""",
    "zscore": _zscore(f"{_u('split:')} < 0.6"),
    "zscore_all": _zscore("true"),
    "random_split": f"""{_with(_TXN)}SELECT {_K}, Class,
       CASE WHEN {_u("split:")} < 0.6 THEN 'train' ELSE 'test' END AS part FROM txn""",
    "undersample_negatives": f"{_with(_TXN)}SELECT * FROM txn WHERE Class = 1 OR {_u('under:')} < 0.2",
    "exact_fraction_sample": f"""{_with(_TXN, _ranked("PARTITION BY Class", "sample:"))}
SELECT {_K}, Class, CASE WHEN rn <= round(0.8 * n) THEN 'sample' ELSE 'rest' END AS part FROM ranked""",
    "concat_rows": f"{_with(_TXN)}SELECT * FROM txn WHERE Class = 1 UNION ALL SELECT * FROM txn WHERE Class = 0",
    "remainder_rows": f"{_with(_TXN)}SELECT * FROM txn WHERE Class = 0 AND {_u('under:')} >= 0.8",
    "shuffle_rows": f"{_with(_TXN)}SELECT {_K}, {_rank_hash('shuffle:')} AS _order FROM txn",
    "half_split": f"""{_with(_TXN, _ranked("", "shuffle:"))}
SELECT {_K}, Class, CASE WHEN rn <= n // 2 THEN 'validation' ELSE 'test' END AS half FROM ranked""",
    "assign_folds": f"{_with(_TXN)}SELECT {_K}, CAST(floor({_u('fold:')} * 5) AS int) AS fold FROM txn",
    "confusion_matrix": f"""{_with(_TXN, _SCORED)}
SELECT label, prediction, CAST(count(*) AS bigint) AS n FROM scored
WHERE {_u("split:")} >= 0.6 GROUP BY label, prediction""",
    "confusion_matrix_wide": f"""{_with(_TXN, _SCORED)}
SELECT label, CAST(count(*) FILTER (prediction = 0) AS bigint) AS predicted_0,
       CAST(count(*) FILTER (prediction = 1) AS bigint) AS predicted_1 FROM scored GROUP BY label""",
    "confusion_counts": f"{_with(_TXN, _SCORED, _COUNTS)}SELECT * FROM counts",
    "corrected_f1": f"""{_with(_TXN, _SCORED, _COUNTS)}
SELECT tp, fp, fn, round({_f1("tp", "fp", "fn", "5.0")}, 6) AS metric FROM counts""",
    "trial_metrics": f"""{_with(_TXN, _FOLDED, _TRIALS, _METRICS)}
SELECT * REPLACE (round(metric, 6) AS metric) FROM metrics""",
    "sum_fold_metrics": f"""{_with(_TXN, _FOLDED, _TRIALS, _METRICS)}
SELECT rate, grid_id, round(sum(metric), 6) AS metric FROM metrics GROUP BY rate, grid_id""",
    "best_trial": f"""{_with(_TXN, _FOLDED, _TRIALS, _METRICS)}
SELECT rate, grid_id, round(sum(metric), 6) AS metric, trial FROM metrics GROUP BY rate, grid_id, trial
ORDER BY sum(metric) DESC, trial LIMIT 1""",
    "rule_grid": _rule_grid(),
    "f1_by_class": f"""{_with(_TXN, _SCORED)}
SELECT c AS class, round(2.0 * count(*) FILTER (label = c AND prediction = c)
       / (count(*) FILTER (label = c) + count(*) FILTER (prediction = c)), 6) AS f1
FROM scored, (SELECT CAST(unnest([0, 1]) AS double) AS c) GROUP BY c""",
    "accuracy": f"""{_with(_TXN, _SCORED)}
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored""",
    "weighted_cross_entropy": f"""{_with(
        _TXN,
        "w AS (SELECT count(*) / sum(Class) * 1.25 AS w FROM txn)",
        "p AS (SELECT *, 1 / (1 + exp(-(l_quantity / 10 + l_discount * 20 - 6.5))) AS p FROM txn)",
    )}
SELECT round(sum(-CASE WHEN Class = 1 THEN w * ln(greatest(p, 1e-12)) ELSE ln(greatest(1 - p, 1e-12)) END), 3)
       AS loss FROM p, w""",
    "describe": _describe(),
    "class_counts": f"{_with(_TXN)}SELECT Class, CAST(count(*) AS bigint) AS n FROM txn GROUP BY Class",
    "class_counts_documents": """SELECT toxic, CAST(count(*) AS bigint) AS n
FROM labels JOIN documents USING (doc_id) GROUP BY toxic""",
    "class_histogram": _histogram(_PCA, "pca", COMPONENTS),
    "class_histogram_lines": _histogram(_TXN, "txn", FEATURES),
    "chi_square_select": _chi_square(),
    "assemble": f"{_with(_TXN)}SELECT {_K}, {', '.join(f'{c} AS f{i}' for i, c in enumerate(FEATURES))} FROM txn",
    "labeled_point": f"""{_with(_PCA)}SELECT Class AS label,
       {', '.join(f'{c} AS f{i}' for i, c in enumerate(COMPONENTS))} FROM pca""",
    "string_index_label": f"""{_with(_TXN, f"codes AS ({_index_by_frequency('Class', 'txn')})")}
SELECT {_K}, Class, label FROM txn JOIN codes USING (Class)""",
    "string_index_majority": f"""{_with(
        "docs AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id))",
        f"codes AS ({_index_by_frequency('quality', 'docs')})",
    )}
SELECT doc_id, quality, label FROM docs JOIN codes USING (quality)""",
    "vector_index": _vector_index(),
    "feature_stages": _support("quality_ok"),
    "train_random_forest": _support("quality_ok"),
    "train_gbt": _support("quality_ok"),
    "train_gbt_early_stop": _support("quality_ok"),
    "train_linear_svm": _support("quality_ok"),
    "train_linear_svm_weighted": _support("quality_ok"),
    "train_mlp": _support("quality_ok"),
    "train_weighted_mlp": _support("quality_ok"),
    "train_until_no_gain": f"""{_with(
        _TXN,
        _ranked("PARTITION BY Class", "sample:"),
        "held_out AS (SELECT * EXCLUDE (rn, n) FROM ranked WHERE rn > round(0.8 * n))",
        _ranked("", "shuffle:").replace("ranked AS", "halves AS").replace("FROM txn", "FROM held_out"),
    )}
SELECT Class AS label, CAST(count(*) AS bigint) AS n, true AS quality_ok
FROM halves WHERE rn > n // 2 GROUP BY Class""",
    "tune_imbalanced": _support("quality_ok"),
    "tune_forest_axes": _trial_counts(16),
    "tune_boosting_axes": _trial_counts(15),
    "score": _support("predictions_ok").replace(
        "AS predictions_ok", "AS predictions_ok, true AS probabilities_ok"
    ),
    "save_load_model": _support("same_scores"),
    "save_load_network": f"""{_with(_TXN)}
SELECT Class AS label, CAST(count(*) AS bigint) AS n, true AS same_scores FROM txn GROUP BY Class""",
    "network_report": _network_report(),
    "score_linear": f"""{_with(_TXN)}SELECT {_K}, Class AS label,
       CAST(CASE WHEN -67.5 + l_quantity * 1.0 + l_discount * 250.0 + l_tax * (-1.0) > 0 THEN 1 ELSE 0 END AS double)
       AS prediction FROM txn""",
    "argmax_prediction": """SELECT vec_id,
       CAST(list_position(embedding, list_max(embedding)) - 1 AS bigint) AS prediction FROM embeddings""",
    "fraud_report": _support("quality_ok"),
    "fraud_report_gbt": _support("quality_ok"),
}


def oracle_sql() -> dict[str, str]:
    """SQL per query name."""
    return dict(_SQL)
