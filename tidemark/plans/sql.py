"""SQL pieces that the oracles of several queries share, in DuckDB's dialect."""

CASES = """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(o_orderkey AS VARCHAR) AS complaint_id, 'N' || c_nationkey AS company,
 r_name AS location, CAST(o_orderdate AS DATE) AS opening_date, o_orderstatus AS status, o_orderkey AS k, o_totalprice AS amount,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS target_resolved
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

OBSERVED = f"SELECT * FROM ({CASES}) WHERE target_resolved IS NOT NULL"

CANDIDATES = """SELECT CAST(i + 1 AS INTEGER) AS fold, CAST(v - INTERVAL 1 DAY AS DATE) AS train_end, CAST(v AS DATE) AS validation_start,
 CAST(v + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS validation_end, CAST(v + INTERVAL 3 MONTH AS DATE) AS test_start,
 CAST(v + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS test_end
 FROM (SELECT i, DATE '1999-01-01' + to_months(CAST(3 * i AS INTEGER)) AS v FROM range(0, 40) t(i)) WHERE v <= DATE '2001-08-01'"""

FOLDS = f"SELECT * FROM ({CANDIDATES}) WHERE test_end <= DATE '2001-08-01'"

SPLITS = f"""SELECT fold, 'train' AS split, DATE '1995-01-01' AS low, train_end AS high FROM ({FOLDS})
 UNION ALL SELECT fold, 'validation', validation_start, validation_end FROM ({FOLDS})
 UNION ALL SELECT fold, 'test', test_start, test_end FROM ({FOLDS})"""

MODELS = """SELECT * FROM (VALUES ('m1'), ('m2'), ('m3'), ('good')) t(model)"""

SCORED = f"""SELECT model, fold, split, record_id, company, opening_date, target_resolved, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
 FROM (SELECT model, fold, split, record_id, company, opening_date, target_resolved, CASE model
 WHEN 'm1' THEN CAST((k * 7919) % 1000 AS DOUBLE) / 1000 WHEN 'm2' THEN CAST((k * 104729) % 1000 AS DOUBLE) / 1000
 WHEN 'm3' THEN CAST((k * 1299709) % 1000 AS DOUBLE) / 1000
 ELSE CAST(300 * target_resolved + (k * 7919) % 700 AS DOUBLE) / 1000 END AS score
 FROM ({OBSERVED}) JOIN ({SPLITS}) ON opening_date BETWEEN low AND high CROSS JOIN ({MODELS}) WHERE split <> 'train')"""


def div(a: str, b: str, otherwise: str = "0.0") -> str:
    return f"(CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {otherwise} END)"


def f1(tp: str, fp: str, fn: str) -> str:
    return div(f"2 * ({tp})", f"2 * ({tp}) + ({fp}) + ({fn})")


def macro(tp: str, fp: str, fn: str, tn: str) -> str:
    return f"(({f1(tp, fp, fn)} + {f1(tn, fp, fn)}) / 2)"


def swept(source: str, keys: str, score: str = "score", target: str = "target_resolved") -> str:
    """keys, score, n, p, cn, cp, total, positives."""
    return f"""SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS cn, CAST(sum(p) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS cp,
 CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total, CAST(sum(p) OVER (PARTITION BY {keys}) AS BIGINT) AS positives
 FROM (SELECT {keys}, {score} AS score, count(*) AS n, CAST(sum({target}) AS BIGINT) AS p FROM ({source}) GROUP BY ALL)"""


def threshold(source: str, keys: str) -> str:
    """keys, threshold, macro_f1 of E1."""
    return f"""WITH w AS ({swept(source, keys)}),
 c AS (SELECT {keys}, score AS threshold, {macro('cp', '(cn - cp)', '(positives - cp)', '(total - cn - positives + cp)')} AS macro_f1 FROM w
 UNION ALL SELECT {keys}, nextafter(max(score), CAST('inf' AS DOUBLE)), {macro('0', '0', 'max(positives)', 'max(total) - max(positives)')} FROM w GROUP BY {keys}),
 b AS (SELECT *, max(macro_f1) OVER (PARTITION BY {keys}) AS best FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(threshold - 0.5), threshold DESC) AS place FROM b WHERE macro_f1 >= best - 1e-12)
 SELECT {keys}, threshold, macro_f1 FROM r WHERE place = 1"""


def confusion(source: str, keys: str) -> str:
    cell = lambda y, z, name: f"CAST(count(*) FILTER (WHERE target_resolved = {y} AND prediction = {z}) AS BIGINT) AS {name}"
    return f"SELECT {keys}, {cell(1, 1, 'tp')}, {cell(0, 1, 'fp')}, {cell(1, 0, 'fn')}, {cell(0, 0, 'tn')} FROM ({source}) GROUP BY ALL"


CLASS_METRICS = f"""round({div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,
 round(({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / greatest(1, CAST(tp + fn > 0 AS INTEGER) + CAST(tn + fp > 0 AS INTEGER)), 6) AS balanced_accuracy,
 round({div('tp', 'tp + fp')}, 6) AS precision_resolved, round({div('tp', 'tp + fn')}, 6) AS recall_resolved, round({f1('tp', 'fp', 'fn')}, 6) AS f1_resolved,
 round({div('tn', 'tn + fn')}, 6) AS precision_unresolved, round({div('tn', 'tn + fp')}, 6) AS recall_unresolved, round({f1('tn', 'fp', 'fn')}, 6) AS f1_unresolved,
 round({macro('tp', 'fp', 'fn', 'tn')}, 6) AS macro_f1"""


def ranks(source: str, keys: str) -> str:
    """keys, roc_auc, pr_auc, brier_score, rounded."""
    return f"""SELECT {keys}, round(CASE WHEN max(positives) > 0 AND max(total) > max(positives) THEN
 sum(p * ((total - positives) - (cn - cp) + (n - p) / 2.0)) / (CAST(max(positives) AS DOUBLE) * (max(total) - max(positives))) ELSE CAST('nan' AS DOUBLE) END, 6) AS roc_auc,
 round({div('sum(CAST(p AS DOUBLE) * cp / cn)', 'max(positives)')}, 6) AS pr_auc,
 round(sum((n - p) * score * score + p * (1 - score) * (1 - score)) / max(total), 6) AS brier_score FROM ({swept(source, keys)}) GROUP BY {keys}"""
