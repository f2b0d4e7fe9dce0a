"""Queries of cleaning, features, folds, history, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import clean, compare, evaluation, folds, history, report
from tidemark.plans import sql as Q
from tidemark.sources import cases as S
from tidemark.sources.files import shared, written  # noqa: F401

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FOLD_ARGS = ("1999-01-01", "2001-08-01")
TRAIN_START = "1995-01-01"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: the order of sums differs between engines."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def windows(spark: SparkSession) -> DataFrame:
    return folds.splits(folds.temporal_folds(spark, *FOLD_ARGS), TRAIN_START)


def scored(spark: SparkSession, sf_dir: str, splits: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Long predictions of four stand-in models, exact in both engines, with ties."""
    k, y = F.col("k"), F.col("target_resolved")
    of = {
        "m1": ((k * 7919) % 1000).cast("double") / 1000, "m2": ((k * 104729) % 1000).cast("double") / 1000,
        "m3": ((k * 1299709) % 1000).cast("double") / 1000, "good": (300 * y + (k * 7919) % 700).cast("double") / 1000,
    }
    assigned = folds.assign(S.order_cases(spark, sf_dir), windows(spark).where(F.col("split").isin(*splits)))
    wide = assigned.withColumns({f"s_{m}": c for m, c in of.items()})
    keep = ["fold", "split", "record_id", "company", "opening_date", "target_resolved"]
    long = compare.unpivoted(wide, {m: f"s_{m}" for m in of}, keep)
    return long.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


TEXT_CASES = """SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS company, text AS complaint_text, upper(lang) AS location,
 CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS opening_date, CAST(quality AS INTEGER) AS target_resolved
 FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)"""
RAW = f"""SELECT record_id AS "ID", 'C' || record_id AS id_case, ' ' || company || '  x ' AS company, chr(9) || ' ' || complaint_text || '  ' || chr(9) || '!' AS text,
 CASE WHEN CAST(record_id AS BIGINT) % 2 = 1 THEN strftime(opening_date, '%d/%m/%Y') ELSE strftime(opening_date, '%Y-%m-%d') END AS opened,
 'City - ' || CASE WHEN CAST(record_id AS BIGINT) % 2 = 1 THEN 'SP ' ELSE location END AS location,
 CASE target_resolved WHEN 1 THEN 'Resolved' WHEN 0 THEN 'Unresolved' ELSE 'Open' END AS status FROM ({TEXT_CASES})"""
CLEAN = f"""SELECT * FROM (SELECT trim("ID") AS record_id, trim(id_case) AS complaint_id, trim(regexp_replace(coalesce(company, ''), '[[:space:]]+', ' ', 'g')) AS company,
 trim(regexp_replace(coalesce(text, ''), '[[:space:]]+', ' ', 'g')) AS complaint_text, trim(location) AS location,
 coalesce(TRY_CAST(opened AS DATE), CAST(try_strptime(opened, '%d/%m/%Y') AS DATE)) AS opening_date,
 CAST(CASE status WHEN 'Resolved' THEN 1 ELSE 0 END AS INTEGER) AS target_resolved FROM ({RAW}) WHERE status IN ('Resolved', 'Unresolved'))
 WHERE opening_date IS NOT NULL AND length(complaint_text) >= 10 AND len(string_split(complaint_text, ' ')) >= 2"""


@query("clean_cases", CLEAN)
def clean_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = clean.binary_outcome(S.raw_corpus(spark, sf_dir), "status", "Resolved", "Unresolved")
    return clean.clean_cases(raw)


_W = "CAST(len(string_split(complaint_text, ' ')) AS BIGINT)"
_N = "CAST(len(regexp_extract_all(complaint_text, '\\[[A-ZÀ-Ü_]+\\]')) AS BIGINT)"
_T = lambda c: f"CAST(length(complaint_text) - length(replace(complaint_text, '{c}', '')) AS BIGINT)"
FEATURES = f"""SELECT record_id, complaint_id, company, complaint_text, location,
 CASE WHEN upper(regexp_extract(location, '([A-Z]{{2}})\\s*$', 1)) IN ({', '.join(repr(u) for u in C.UNITS)}) THEN upper(regexp_extract(location, '([A-Z]{{2}})\\s*$', 1)) ELSE 'UNKNOWN' END AS uf,
 opening_date, target_resolved, CAST(length(complaint_text) AS BIGINT) AS text_char_count, {_W} AS text_word_count,
 round(ln(1.0 + length(complaint_text)), 6) AS log_text_char_count, round(ln(1.0 + {_W}), 6) AS log_text_word_count,
 {_T('!')} AS exclamation_count, {_T('?')} AS question_count, {_N} AS anonymization_marker_count,
 CAST(contains(complaint_text, '!') AS BIGINT) AS has_exclamation, CAST(contains(complaint_text, '?') AS BIGINT) AS has_question, CAST({_N} > 0 AS BIGINT) AS has_anonymization_marker,
 CAST(month(opening_date) AS BIGINT) AS opening_month, CAST(dayofweek(opening_date) AS BIGINT) AS opening_weekday,
 round(sin(2 * pi() * month(opening_date) / 12.0), 6) AS opening_month_sin, round(cos(2 * pi() * month(opening_date) / 12.0), 6) AS opening_month_cos,
 round(sin(2 * pi() * dayofweek(opening_date) / 7.0), 6) AS opening_weekday_sin, round(cos(2 * pi() * dayofweek(opening_date) / 7.0), 6) AS opening_weekday_cos FROM ({CLEAN})"""


@query("feature_table", FEATURES)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.add_features(clean_cases(spark, sf_dir)))


@query("temporal_folds", """WITH b AS (SELECT date_trunc('month', min(CAST(o_orderdate AS DATE))) + INTERVAL 48 MONTH AS low, CAST(date_trunc('month', max(CAST(o_orderdate AS DATE))) AS DATE) AS high FROM orders),
 c AS (SELECT CAST(i + 1 AS INTEGER) AS fold, low + to_months(CAST(3 * i AS INTEGER)) AS v, high FROM b, range(0, 80) t(i))
 SELECT fold, CAST(v - INTERVAL 1 DAY AS DATE) AS train_end, CAST(v AS DATE) AS validation_start, CAST(v + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS validation_end,
 CAST(v + INTERVAL 3 MONTH AS DATE) AS test_start, CAST(v + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS test_end FROM c WHERE CAST(v + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) <= high""")
def temporal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds between the table's own bounds: four years of training first, complete up to the first of its last month."""
    day = F.col("o_orderdate").cast("date")
    low, high = S.table(spark, sf_dir, "orders").agg(F.add_months(C.first_of_month(F.min(day)), 48), C.first_of_month(F.max(day))).first()
    return folds.temporal_folds(spark, str(low), str(high))


@query("test_window_eligibility", f"""SELECT c.fold, c.test_end <= DATE '2001-08-01' AS complete, count(*) AS records, CAST(sum(target_resolved) AS BIGINT) AS positives
 FROM ({Q.OBSERVED}) o JOIN ({Q.CANDIDATES}) c ON opening_date BETWEEN test_start AND test_end
 WHERE c.fold <= (SELECT max(fold) + 1 FROM ({Q.FOLDS})) GROUP BY ALL""")
def test_window_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = folds.fold_candidates(spark, *FOLD_ARGS).select("fold", "complete", F.col("test_start").alias("low"), F.col("test_end").alias("high"))
    return folds.assign(S.order_cases(spark, sf_dir), ends).groupBy("fold", "complete").agg(
        F.count("*").alias("records"), F.sum("target_resolved").cast("long").alias("positives")
    )


@query("split_summary", f"""SELECT fold, split, count(*) AS records, CAST(sum(target_resolved) AS BIGINT) AS positives, CAST(sum(1 - target_resolved) AS BIGINT) AS negatives,
 round(avg(target_resolved), 6) AS rate, min(opening_date) AS first_date, max(opening_date) AS last_date FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high GROUP BY ALL""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.split_summary(S.order_cases(spark, sf_dir), windows(spark)))


def _train_history_sql(source: str, ids: str, spans: tuple[int, ...], target: str = "target_resolved") -> str:
    own = ", ".join(
        f"coalesce(sum(n) OVER (PARTITION BY company ORDER BY opening_date RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS n_{k},"
        f" coalesce(sum(p) OVER (PARTITION BY company ORDER BY opening_date RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS p_{k}" for k in spans
    )
    outs = ", ".join(
        f"CAST(n_{k} AS BIGINT) AS company_history_count_{k}d, round(ln(1.0 + n_{k}), 6) AS log_company_history_count_{k}d, round({Q.div(f'p_{k}', f'n_{k}', Q.div('cp', 'cn', Q.div('ap', 'an', '0.5')))}, 6) AS company_history_rate_{k}d"
        for k in spans
    )
    return f"""WITH d AS (SELECT company, opening_date, count(*) AS n, sum({target}) AS p FROM ({source}) GROUP BY ALL),
 c AS (SELECT company, opening_date, coalesce(sum(n) OVER w, 0) AS cn, coalesce(sum(p) OVER w, 0) AS cp, {own} FROM d
 WINDOW w AS (PARTITION BY company ORDER BY opening_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT opening_date, coalesce(sum(n) OVER w, 0) AS an, coalesce(sum(p) OVER w, 0) AS ap FROM (SELECT opening_date, sum(n) AS n, sum(p) AS p FROM d GROUP BY 1)
 WINDOW w AS (ORDER BY opening_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT {ids}, CAST(cn AS BIGINT) AS company_history_count, round(ln(1.0 + cn), 6) AS log_company_history_count,
 round({Q.div('cp', 'cn', Q.div('ap', 'an', '0.5'))}, 6) AS company_history_rate, CAST(cn > 0 AS INTEGER) AS company_seen_before, round({Q.div('ap', 'an', '0.5')}, 6) AS global_history_rate, {outs}
 FROM ({source}) JOIN c USING (company, opening_date) JOIN g USING (opening_date)"""


IDS = ["record_id", "company", "opening_date", "target_resolved"]


@query("train_history", _train_history_sql(Q.OBSERVED, ", ".join(IDS), history.WINDOWS))
def train_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.train_history(S.order_cases(spark, sf_dir).select(*IDS)))


_EVENTS = """SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS company, CAST(ts AS DATE) AS opening_date,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS target_resolved FROM events"""


@query("train_history_events", _train_history_sql(_EVENTS, ", ".join(IDS), (3, 7, 14)))
def train_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.train_history(S.event_cases(spark, sf_dir), (3, 7, 14)))


_LINES = """SELECT CAST(l_suppkey AS VARCHAR) AS company, CAST(l_shipdate AS DATE) AS opening_date, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target_resolved FROM lineitem"""


@query("history_summary_lines", f"""SELECT company, count(*) AS records, round(avg(company_seen_before), 6) AS seen_rate, round(avg(company_history_count), 6) AS mean_count,
 max(company_history_count) AS max_count, round(avg(company_history_rate), 6) AS mean_rate, round(avg(global_history_rate), 6) AS mean_global_rate
 FROM ({_train_history_sql(_LINES, 'company, opening_date, target_resolved', (30, 365))}) GROUP BY 1""")
def history_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(history.train_history(S.line_cases(spark, sf_dir), (30, 365)))
    return rounded(history.history_summary(found, ["company"]))


def _future_sql(spans: tuple[int, ...]) -> str:
    sums = ", ".join(
        f"sum(CASE WHEN opening_date > train_end - {k} THEN 1 ELSE 0 END) AS n_{k}, sum(CASE WHEN opening_date > train_end - {k} THEN target_resolved ELSE 0 END) AS p_{k}" for k in spans
    )
    outs = ", ".join(
        f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS company_history_count_{k}d, round(ln(1.0 + coalesce(n_{k}, 0)), 6) AS log_company_history_count_{k}d, round({Q.div(f'p_{k}', f'coalesce(n_{k}, 0)', Q.div('cp', 'coalesce(cn, 0)', 'g'))}, 6) AS company_history_rate_{k}d"
        for k in spans
    )
    return f"""WITH h AS (SELECT fold, company, count(*) AS cn, sum(target_resolved) AS cp, {sums} FROM ({Q.OBSERVED}) JOIN ({Q.FOLDS}) ON opening_date <= train_end GROUP BY 1, 2),
 g AS (SELECT fold, CAST(sum(cp) AS DOUBLE) / sum(cn) AS g FROM h GROUP BY 1)
 SELECT record_id, company, opening_date, target_resolved, fold, split, CAST(coalesce(cn, 0) AS BIGINT) AS company_history_count, round(ln(1.0 + coalesce(cn, 0)), 6) AS log_company_history_count,
 round({Q.div('cp', 'coalesce(cn, 0)', 'g')}, 6) AS company_history_rate, CAST(coalesce(cn, 0) > 0 AS INTEGER) AS company_seen_before, round(g, 6) AS global_history_rate, {outs}
 FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high LEFT JOIN h USING (fold, company) LEFT JOIN g USING (fold) WHERE split <> 'train'"""


def future(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = S.order_cases(spark, sf_dir).select(*IDS)
    later = folds.assign(cases, windows(spark).where("split <> 'train'"))
    return history.future_history(cases, later, folds.temporal_folds(spark, *FOLD_ARGS))


@query("future_history", _future_sql(history.WINDOWS))
def future_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(future(spark, sf_dir))


@query("history_summary", f"""SELECT fold, split, count(*) AS records, round(avg(company_seen_before), 6) AS seen_rate, round(avg(company_history_count), 6) AS mean_count,
 max(company_history_count) AS max_count, round(avg(company_history_rate), 6) AS mean_rate, round(avg(global_history_rate), 6) AS mean_global_rate FROM ({_future_sql((30,))}) GROUP BY ALL""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history_summary(rounded(future(spark, sf_dir)), ["fold", "split"])
    return rounded(found)


_BASE = f"""WITH t AS (SELECT fold, company, count(*) AS n, sum(target_resolved) AS p FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high WHERE split = 'train' GROUP BY 1, 2),
 g AS (SELECT fold, CAST(sum(p) AS DOUBLE) / sum(n) AS g, count(*) AS companies FROM t GROUP BY 1),
 b AS (SELECT record_id, company, opening_date, target_resolved, fold, split, g AS global_score, coalesce(CAST(p AS DOUBLE) / n, g) AS company_score, CAST(n IS NOT NULL AS INTEGER) AS company_seen
 FROM ({Q.OBSERVED}) JOIN ({Q.SPLITS}) ON opening_date BETWEEN low AND high LEFT JOIN t USING (fold, company) JOIN g USING (fold) WHERE split <> 'train')"""


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, splits = S.order_cases(spark, sf_dir).select(*IDS), windows(spark)
    by_company, by_fold = history.frozen_rates(cases, splits)
    return compare.baseline_scores(folds.assign(cases, splits.where("split <> 'train'")), by_company, by_fold)


@query("baseline_predictions", _BASE + "SELECT record_id, company, opening_date, target_resolved, fold, split, round(global_score, 6) AS global_score, round(company_score, 6) AS company_score, company_seen FROM b")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir))


@query("baseline_coverage", _BASE + "SELECT fold, split, count(*) AS records, CAST(sum(company_seen) AS BIGINT) AS seen, round(avg(company_seen), 6) AS seen_rate, round(max(global_score), 6) AS train_rate, max(companies) AS train_companies FROM b JOIN g USING (fold) GROUP BY ALL")
def baseline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, splits = S.order_cases(spark, sf_dir).select(*IDS), windows(spark)
    by_company, by_fold = history.frozen_rates(cases, splits)
    scores = compare.baseline_scores(folds.assign(cases, splits.where("split <> 'train'")), by_company, by_fold)
    found = scores.groupBy("fold", "split").agg(
        F.count("*").alias("records"), F.sum("company_seen").cast("long").alias("seen"), F.avg(F.col("company_seen").cast("double")).alias("seen_rate"),
        F.max("global_score").alias("train_rate"),
    )
    return rounded(found.join(F.broadcast(by_fold.select("fold", F.col("companies").alias("train_companies"))), "fold"))


_LONG = """SELECT m.model, fold, split, record_id, company, opening_date, target_resolved, CASE m.model WHEN 'global' THEN global_score ELSE company_score END AS score FROM b CROSS JOIN (VALUES ('global'), ('company')) m(model)"""


def baseline_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds tuned on validation, all metrics on test, for both baselines and every fold in one plan."""
    long = compare.unpivoted(baseline(spark, sf_dir), {"global": "global_score", "company": "company_score"}, ["fold", "split", "record_id", "target_resolved"])
    # One aggregation serves tuning, confusion and ranks: counts of both splits side by side, so that its shuffle is reused.
    test, hit = F.col("split") == "test", F.col("target_resolved") == 1
    counts = long.groupBy("model", "fold", "score").agg(
        F.count_if(~test).alias("vn"), F.count_if(~test & hit).alias("vp"), F.count_if(test).alias("tn"), F.count_if(test & hit).alias("tp")
    )
    keys = ["model", "fold"]
    tuned = evaluation.threshold_of(counts.where("vn > 0").select(*keys, "score", F.col("vn").alias("n"), F.col("vp").alias("p")), keys)
    chosen = tuned.select(*keys, F.when(F.col("model") == "global", 0.5).otherwise(F.col("threshold")).alias("threshold"))  # the global one is fixed
    judged = counts.where("tn > 0").select(*keys, "score", F.col("tn").alias("n"), F.col("tp").alias("p")).join(F.broadcast(chosen), keys)
    return rounded(evaluation.metric_set_of(judged, [*keys, "threshold"]))


_THRESHOLDS = Q.threshold("SELECT * FROM l WHERE split = 'validation' AND model = 'company'", "model, fold")
QUERIES["baseline_evaluation"] = baseline_evaluation
ORACLE["baseline_evaluation"] = f"""{_BASE}, l AS ({_LONG}),
 h AS (SELECT model, fold, threshold FROM ({_THRESHOLDS}) UNION ALL SELECT DISTINCT 'global', fold, 0.5 FROM l),
 j AS (SELECT l.*, threshold, CAST(score >= threshold AS INTEGER) AS prediction FROM l JOIN h USING (model, fold) WHERE split = 'test'),
 c AS ({Q.confusion('SELECT * FROM j', 'model, fold, threshold')})
 SELECT model, fold, round(threshold, 6) AS threshold, tp, fp, fn, tn, {Q.CLASS_METRICS}, tp + fp + fn + tn AS records, round(CAST(tp + fn AS DOUBLE) / (tp + fp + fn + tn), 6) AS positive_rate, roc_auc, pr_auc, brier_score
 FROM c JOIN ({Q.ranks('SELECT * FROM j', 'model, fold, threshold')}) USING (model, fold, threshold)"""
