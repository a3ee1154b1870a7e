"""Queries by name over the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

import contextlib
import datetime
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli, config
from ..functions import binary, text, units
from ..operators import metrics, models, split, submission
from ..sources import assets, files, store, tables
from ..trace import Tracer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_F1 = """conf AS (SELECT t, p, count(*) AS n FROM y GROUP BY 1, 2),
side AS (SELECT t AS label, n AS true_n, 0 AS pred_n, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM conf UNION ALL SELECT p, 0, n, 0 FROM conf),
cls AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(true_n) AS BIGINT) AS true_n, CAST(sum(pred_n) AS BIGINT) AS pred_n FROM side GROUP BY 1),
f AS (SELECT *, 2.0::DOUBLE * tp / (true_n + pred_n) AS f1 FROM cls)"""
_ORDERS = "y AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 150000 THEN '1-URGENT' WHEN o_totalprice > 80000 THEN '3-MEDIUM' ELSE '5-LOW' END AS p FROM orders)"
_UNITS = ", ".join(f"('{s}', '{u}')" for s, u in units.spellings().items())


def _orders(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _table(spark, d, "orders").select(F.col("o_orderpriority").alias("y_true"), F.when(price > 150000, "1-URGENT").when(price > 80000, "3-MEDIUM").otherwise("5-LOW").alias("y_pred"))


@query(f"""WITH y AS (SELECT CAST(l.quality AS VARCHAR) AS t, CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END AS p FROM documents d JOIN labels l USING (doc_id)), {_F1}
SELECT round((SELECT avg(CASE WHEN lower(t) = lower(p) THEN 1.0::DOUBLE ELSE 0 END) FROM y), 6) AS exact_match, round(avg(f1), 6) AS f1_macro, round(2.0::DOUBLE * sum(tp) / (sum(true_n) + sum(pred_n)), 6) AS f1_micro,
round(sum(f1 * true_n) / sum(true_n), 6) AS f1_weighted, round((SELECT 100 * avg(abs(p::DOUBLE - t::DOUBLE) / ((abs(t::DOUBLE) + abs(p::DOUBLE)) / 2 + 1e-8::DOUBLE)) FROM y), 6) AS smape, (SELECT count(*) FROM y) AS n_joined FROM f""")
def evaluate_join(spark: SparkSession, d: str) -> DataFrame:
    truth = _table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("prediction"))
    pred = _table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("prediction"))
    return _rounded(metrics.evaluate(metrics.join_predictions(truth, pred, "doc_id")), "exact_match", "f1_macro", "f1_micro", "f1_weighted", "smape")


@query(f"WITH {_ORDERS}, {_F1} SELECT label, tp, true_n, pred_n, round(f1, 6) AS f1 FROM f")
def f1_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.f1_per_class(_orders(spark, d)), "f1")


@query(f"WITH {_ORDERS}, {_F1} SELECT round(avg(f1), 6) AS f1_macro, round(2.0::DOUBLE * sum(tp) / (sum(true_n) + sum(pred_n)), 6) AS f1_micro, round(sum(f1 * true_n) / sum(true_n), 6) AS f1_weighted FROM f")
def f1_macro_micro_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.f1_scores(_orders(spark, d)), "f1_macro", "f1_micro", "f1_weighted")


@query("SELECT round(avg(CASE WHEN lower(trim(o_orderpriority)) = lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '  ' || upper(o_orderpriority) || ' ' END)) THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match FROM orders")
def exact_match_case(spark: SparkSession, d: str) -> DataFrame:
    y = _table(spark, d, "orders").select(F.col("o_orderpriority").alias("y_true"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" "))).alias("y_pred"))
    return y.agg(F.round(metrics.exact_match(y), 6).alias("exact_match"))


@query("SELECT round(100 * avg(abs(l_quantity * 1500 - l_extendedprice) / ((abs(l_extendedprice) + abs(l_quantity * 1500)) / 2 + 1e-8::DOUBLE)), 6) AS smape FROM lineitem")
def smape_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").agg(F.round(metrics.smape(F.col("l_extendedprice"), F.col("l_quantity") * 1500), 6).alias("smape"))


@query("""WITH y AS (SELECT p_brand, CAST(p_size AS VARCHAR) AS t, CASE WHEN p_brand = 'Brand#11' AND p_partkey % 7 = 0 THEN '1d' ELSE ' 1_0 ' END AS p FROM part),
v AS (SELECT p_brand, try_cast(t AS DOUBLE) AS t, CASE WHEN p = '1d' THEN NULL ELSE 10.0::DOUBLE END AS p FROM y)
SELECT p_brand, CASE WHEN bool_and(t IS NOT NULL AND p IS NOT NULL) THEN round(100 * avg(abs(p - t) / ((abs(t) + abs(p)) / 2 + 1e-8::DOUBLE)), 6) END AS smape FROM v GROUP BY 1""")
def smape_gate(spark: SparkSession, d: str) -> DataFrame:
    y = _table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("y_true"), F.when((F.col("p_brand") == "Brand#11") & (F.col("p_partkey") % 7 == 0), "1d").otherwise(" 1_0 ").alias("y_pred"))
    return y.groupBy("p_brand").agg(F.round(metrics.smape_gated(y), 6).alias("smape"))


@query("SELECT doc_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INT) AS fold FROM documents")
def kfold_plain(spark: SparkSession, d: str) -> DataFrame:
    return split.kfold(_table(spark, d, "documents").select("doc_id"), id_col="doc_id")


_STRAT = "SELECT doc_id, lang, CAST((row_number() OVER (ORDER BY lang, md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM documents"


@query(_STRAT)
def kfold_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_kfold(_table(spark, d, "documents").select("doc_id", "lang"), "lang", id_col="doc_id")


@query(f"SELECT lang, fold, count(*) AS n FROM ({_STRAT}) GROUP BY 1, 2")
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    return kfold_stratified(spark, d).groupBy("lang", "fold").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE g AS (SELECT user_id AS "group", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY 1),
s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, -1 AS fold UNION ALL
SELECT s.i + 1, list_transform(s.load, lambda x, k: CASE WHEN k = list_position(s.load, list_min(s.load)) THEN x + g.n ELSE x END), CAST(list_position(s.load, list_min(s.load)) - 1 AS INT) FROM s JOIN g ON g.i = s.i + 1)
SELECT g."group", g.n, CAST(s.fold AS INT) AS fold FROM g JOIN s USING (i)""")
def kfold_group(spark: SparkSession, d: str) -> DataFrame:
    return split.group_folds(_table(spark, d, "events"), "user_id")


@query("""SELECT 'documents.lang' AS name, count(DISTINCT lang) < 0.5 * count(*) AS low FROM documents UNION ALL
SELECT 'part.p_name', count(DISTINCT p_name) < 0.5 * count(*) FROM part UNION ALL SELECT 'orders.o_orderkey', count(DISTINCT o_orderkey) < 0.5 * count(*) FROM orders""")
def target_cardinality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"{t}.{c}", bool(split.low_cardinality(_table(spark, d, t), c))) for t, c in (("documents", "lang"), ("part", "p_name"), ("orders", "o_orderkey"))]
    return spark.createDataFrame(rows, "name string, low boolean")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def sample_exact_n(spark: SparkSession, d: str) -> DataFrame:
    return split.sample_exact(_table(spark, d, "orders").select("o_orderkey"), 100, id_col="o_orderkey")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS c,
(SELECT count(*) FROM documents) AS n FROM documents WHERE lang IS NOT NULL) WHERE rn <= round_even(c * least(1.0::DOUBLE, 100.0::DOUBLE / n), 0)""")
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.sample_stratified(_table(spark, d, "documents").select("doc_id", "lang"), "lang", 100, id_col="doc_id")


def _golden_sql(table: str, key: str, train: int, val: int) -> str:
    return f"""WITH s AS (SELECT {key}, count(*) OVER () AS n FROM {table}), pool AS (SELECT * FROM s ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key} LIMIT {train + val}),
r AS (SELECT {key}, n, row_number() OVER (ORDER BY md5('43:' || CAST({key} AS VARCHAR)), {key}) AS rk FROM pool),
z AS (SELECT *, CASE WHEN n >= {train + val} THEN {val} ELSE n - CAST(floor(n * {train}.0::DOUBLE / {train + val}) AS BIGINT) END AS v FROM r)
SELECT {key}, CASE WHEN rk <= v THEN 'val' ELSE 'train' END AS split FROM z"""


@query(_golden_sql("orders", "o_orderkey", 500, 100))
def golden_split(spark: SparkSession, d: str) -> DataFrame:
    return split.golden(_table(spark, d, "orders").select("o_orderkey"), train_size=500, val_size=100, id_col="o_orderkey")


@query(_golden_sql("labels", "doc_id", 500000, 100000))
def golden_downscale(spark: SparkSession, d: str) -> DataFrame:
    return split.golden(_table(spark, d, "labels").select("doc_id"), train_size=500000, val_size=100000, id_col="doc_id")


_RAW = "(['g', ' KG ', 'ml', 'fl oz', 'unknown_unit', 'INCHES', 'Liter'])[CAST(p_partkey % 7 AS INT) + 1]"
_TITLE = f"CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' ' || CAST(p_size AS VARCHAR) || '.5 ' || {_RAW} || ' pack 2 cm' END"


def _raw() -> F.Column:
    return F.element_at(F.array(*map(F.lit, ["g", " KG ", "ml", "fl oz", "unknown_unit", "INCHES", "Liter"])), (F.col("p_partkey") % 7 + 1).cast("int"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "), _raw(), F.lit(" pack 2 cm")))
    return _table(spark, d, "part").select("p_partkey", "p_brand", title.alias("title"))


@query(f"WITH u(s, c) AS (VALUES {_UNITS}), r AS (SELECT p_partkey, {_RAW} AS raw FROM part) SELECT p_partkey, raw, coalesce(c, lower(trim(raw))) AS unit FROM r LEFT JOIN u ON s = lower(trim(raw))")
def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", _raw().alias("raw"), units.normalize_unit(_raw()).alias("unit"))


_EXTRACT = rf"""u(s, c) AS (VALUES {_UNITS}), x AS (SELECT p_partkey, p_brand, {_TITLE} AS title FROM part),
m AS (SELECT p_partkey, unnest(regexp_extract_all(title, '(\b\d+(?:\.\d+)?)\s*([a-zA-Z]+)(?:\s+([a-zA-Z]+))?', 1)) AS num, unnest(regexp_extract_all(title, '(\b\d+(?:\.\d+)?)\s*([a-zA-Z]+)(?:\s+([a-zA-Z]+))?', 2)) AS w1,
unnest(regexp_extract_all(title, '(\b\d+(?:\.\d+)?)\s*([a-zA-Z]+)(?:\s+([a-zA-Z]+))?', 3)) AS w2, generate_subscripts(regexp_extract_all(title, '(\b\d+(?:\.\d+)?)\s*([a-zA-Z]+)(?:\s+([a-zA-Z]+))?', 1), 1) AS i FROM x),
h AS (SELECT m.p_partkey, m.num || ' ' || coalesce(u2.c, u1.c) AS q, row_number() OVER (PARTITION BY m.p_partkey ORDER BY i) AS rn FROM m LEFT JOIN u u2 ON u2.s = lower(w1) || ' ' || lower(w2) LEFT JOIN u u1 ON u1.s = lower(w1) WHERE coalesce(u2.c, u1.c) IS NOT NULL),
e AS (SELECT x.p_partkey, x.p_brand, h.q FROM x LEFT JOIN h ON h.p_partkey = x.p_partkey AND h.rn = 1)"""


@query(f"WITH {_EXTRACT} SELECT p_partkey, q AS extracted FROM e")
def extract_quantity(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("p_partkey", units.extract_quantity(F.col("title")).alias("extracted"))


_MODE = "(SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1)"


@query(f"WITH {_EXTRACT} SELECT p_partkey, coalesce(q, {_MODE}) AS prediction FROM e")
def rule_predict(spark: SparkSession, d: str) -> DataFrame:
    df = _titles(spark, d)
    return models.RulePredictor(text_cols=["title"]).fit(df, "p_brand").transform(df).select("p_partkey", "prediction")


class _Given(models.Predictor):
    """A member whose predictions are a column of the table."""

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.is_fitted = True

    def fit(self, df: DataFrame, target_col: str) -> _Given:
        return self

    def column(self, df: DataFrame):
        return F.col(self.name)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(self.name))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'None' WHEN 2 THEN 'b' WHEN 3 THEN 'b' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'fallback' END END AS prediction FROM part""")
def cascade_predict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    df = _table(spark, d, "part").select("p_partkey", F.when(k == 0, " a ").when(k == 1, "None").when(k == 2, "  ").when(k == 3, "NaN").alias("first"), F.when((k != 4) | (F.col("p_partkey") % 2 == 0), "b").alias("second"))
    return models.Cascade([_Given("first"), _Given("second")], fallback="fallback").transform(df).select("p_partkey", "prediction")


_PRED = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'nAn' ELSE ' ' || o_orderpriority || ' ' END"


def _preds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.when(k == 0, None).when(k == 1, "  ").when(k == 2, "nAn").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("prediction"))


@query("""SELECT o_orderkey AS "index", CASE WHEN o_orderkey % 6 < 3 THEN 'none' ELSE trim(o_orderpriority) END AS prediction FROM orders""")
def sanitize_predictions(spark: SparkSession, d: str) -> DataFrame:
    return submission.format_submission(_preds(spark, d), fallback="none")


@query(f"SELECT count(*) AS total_rows, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count, CAST(sum(CASE WHEN trim(p) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_count FROM (SELECT o_orderkey, {_PRED} AS p FROM orders)")
def validate_nulls_blanks(spark: SparkSession, d: str) -> DataFrame:
    df = _preds(spark, d)
    return df.agg(F.count("*").alias("total_rows"), submission.null_cells(df).alias("null_count"), submission.blank_cells(F.col("prediction")).alias("blank_count"))


_DIFF = "(SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL)"


@query(f"SELECT {_DIFF} AS id_mismatches")
def validate_id_symdiff(spark: SparkSession, d: str) -> DataFrame:
    return submission.id_mismatches(_table(spark, d, "documents"), _table(spark, d, "labels"), "doc_id")


@query(f"SELECT (SELECT count(*) FROM labels) AS total_rows, (SELECT count(*) FROM documents) AS expected_rows, (SELECT count(*) FROM labels WHERE doc_id IS NULL OR quality IS NULL) AS null_count, {_DIFF} AS id_mismatches")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    sub, ref = _table(spark, d, "labels").select("doc_id", "quality"), _table(spark, d, "documents")
    one = F.lit(1).alias("_one")
    a = sub.agg(F.count("*").alias("total_rows"), submission.null_cells(sub).alias("null_count")).select("*", one)
    b = ref.agg(F.count("*").alias("expected_rows")).select("*", one)
    c = submission.id_mismatches(sub, ref, "doc_id").select("*", one)
    return a.join(b, "_one").join(c, "_one").select("total_rows", "expected_rows", "null_count", "id_mismatches")


_URL = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN upper(url) WHEN 2 THEN 'httpfoo' WHEN 3 THEN '' ELSE url END"


def _urls() -> F.Column:
    k = F.col("page_id") % 5
    return F.when(k == 0, None).when(k == 1, F.upper("url")).when(k == 2, "httpfoo").when(k == 3, "").otherwise(F.col("url"))


@query(f"SELECT page_id, CASE WHEN u IS NULL OR NOT starts_with(u, 'http') THEN 'invalid_url' END AS reason FROM (SELECT page_id, {_URL} AS u FROM pages)")
def asset_url_classify(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", assets.url_reason(_urls()).alias("reason"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN octet_length(encode(html)) > 1024 ELSE false END AS valid FROM pages")
def asset_signature(spark: SparkSession, d: str) -> DataFrame:
    k, body = F.col("page_id") % 4, F.encode("html", "UTF-8")
    data = F.when(k == 0, F.concat(F.unhex(F.lit("FFD8FF")), body)).when(k == 1, F.concat(F.unhex(F.lit("524946460000000057454250")), body)).when(k == 2, body).otherwise(F.unhex(F.lit("FFD8FF")))
    return _table(spark, d, "pages").select("page_id", binary.is_valid_image(data).alias("valid"))


@query(f"""SELECT CAST(sum(CASE WHEN starts_with(u, 'http') AND n > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN starts_with(u, 'http') AND n > 9000 THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
CAST(sum(CASE WHEN starts_with(u, 'http') AND n > 2000 THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM (SELECT {_URL} AS u, length(html) AS n FROM pages)""")
def asset_tallies(spark: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(assets.url_reason(_urls()), F.when(F.length("html") <= 2000, "corrupted_or_html"), F.when(F.length("html") > 9000, "already_exists"))
    return assets.tallies(_table(spark, d, "pages").select(F.col("url").alias("path"), (reason.isNull() | (reason == "already_exists")).alias("ok"), reason.alias("reason")))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50")
def head_limit(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS source_rows, CAST(least(count(*), 50) AS BIGINT) AS golden_train_rows, CAST(least(count(*), 10) AS BIGINT) AS golden_val_rows, 5 AS n_splits, 42 AS seed FROM documents")
def split_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "documents").select("doc_id")
    picked = split.golden(df, train_size=50, val_size=10, id_col="doc_id").select("split")
    n = df.select(F.lit(None).cast("string").alias("split"), F.lit(1).alias("source")).unionByName(picked.withColumn("source", F.lit(0)))
    return n.agg(F.sum("source").alias("source_rows"), F.count_if(F.col("split") == "train").alias("golden_train_rows"), F.count_if(F.col("split") == "val").alias("golden_val_rows")).withColumns({"n_splits": F.lit(5), "seed": F.lit(42)})


@query("""WITH w AS (SELECT CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id // 2 END AS id FROM pages), l AS (SELECT page_id // 3 AS id, octet_length(encode(url)) * 2 AS n FROM pages UNION ALL SELECT NULL, 500)
SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = w.id AND l.n > 100)""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    wanted = pages.select(F.when(F.col("page_id") % 7 != 0, F.floor(F.col("page_id") / 2)).alias("id"))
    listed = pages.select(F.floor(F.col("page_id") / 3).alias("id"), (F.octet_length("url") * 2).alias("length"))
    return assets.remaining(wanted, listed.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 500 AS length")), "id")


@query("SELECT count(DISTINCT doc_id) AS shared_ids FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def id_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id").intersect(_table(spark, d, "labels").select("doc_id")).agg(F.count("*").alias("shared_ids"))


@query("""SELECT p_partkey, try_cast(CASE p_partkey % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1000' WHEN 2 THEN NULL WHEN 3 THEN '1e3' WHEN 4 THEN NULL ELSE '-.5' END AS DOUBLE) AS value FROM part""")
def parse_float(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, [" 12 ", "1_000", "1d", "1e3", "0x10", "-.5"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", text.py_float(given).alias("value"))


# Operators that read and write files, reports, command lines: each writes to the shared folder and reads back.

_STRAT_PART = "SELECT p_partkey, p_brand, CAST((row_number() OVER (ORDER BY p_brand, md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey) - 1) % 5 AS INT) AS fold FROM part"


@query(_STRAT_PART)
def assign_folds_by_target(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(_table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "no_such_column", id_col="p_partkey")


@query("SELECT o_orderkey, o_totalprice, CAST(ntile(5) OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS INT) AS fold FROM orders")
def assign_folds_plain(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", id_col="o_orderkey")


@query(f"""WITH RECURSIVE {SQL["kfold_group"].removeprefix("WITH RECURSIVE ").rsplit("SELECT g.", 1)[0]}
SELECT event_id, user_id, CAST(s.fold AS INT) AS fold FROM events JOIN g ON g."group" = events.user_id JOIN s USING (i)""")
def assign_folds_by_group(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(_table(spark, d, "events").select("event_id", "user_id"), "user_id", "user_id")


_GOLDEN_STRAT = """WITH d AS (SELECT doc_id, lang, md5('42:' || CAST(doc_id AS VARCHAR)) AS k, count(*) OVER () AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS rn FROM d),
pool AS (SELECT doc_id FROM s WHERE lang IS NOT NULL AND rn <= round_even(c * least(1.0::DOUBLE, 77.0::DOUBLE / n), 0)),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS r FROM s WHERE doc_id NOT IN (SELECT doc_id FROM pool)),
filled AS (SELECT doc_id FROM pool UNION ALL SELECT doc_id FROM rest WHERE r <= 77 - (SELECT count(*) FROM pool)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM filled)
SELECT doc_id, CASE WHEN rk <= 17 THEN 'val' ELSE 'train' END AS split FROM z WHERE rk <= 77"""


@query(_GOLDEN_STRAT)
def golden_stratified(spark: SparkSession, d: str) -> DataFrame:
    return split.golden(_table(spark, d, "documents").select("doc_id", "lang"), "lang", 60, 17, id_col="doc_id").select("doc_id", "split")


_CELL = "CASE p_partkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN p_name || ', \"q\"' WHEN 2 THEN p_name || chr(10) || 'two' WHEN 3 THEN ' ' ELSE p_name END"


def _cells() -> F.Column:
    k = F.col("p_partkey") % 6
    return F.when(k == 0, "NA").when(k == 1, F.concat("p_name", F.lit(', "q"'))).when(k == 2, F.concat("p_name", F.lit("\ntwo"))).when(k == 3, " ").otherwise(F.col("p_name"))


def _csv(spark: SparkSession, df: DataFrame, label: str, single: bool = False) -> str:
    path = files.scratch(spark, label) + ".csv"
    tables.write_csv(df, path, single)
    return path


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {_CELL} END AS cell FROM part")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, _csv(spark, _table(spark, d, "part").select(F.col("p_partkey").alias("id"), _cells().alias("cell")), "cells"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE {_CELL} END AS cell FROM part WHERE p_partkey % 6 <> 2")
def csv_single_file(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "part").where("p_partkey % 6 <> 2").select(F.col("p_partkey").alias("id"), _cells().alias("cell"))
    path = _csv(spark, df, "one", single=True)
    if tables.has_quoted_newlines(spark, path) or tables.header(spark, path) != ["id", "cell"]:
        raise ValueError("the file is not what was written")
    return tables.read_table(spark, path)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "orders") + ".parquet"
    _table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(path)
    return tables.read_table(spark, path)


def _shape_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {n})) AS n_columns" for n in names)


@query(_shape_sql("region", "nation", "part", "documents"))
def table_shape(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, *tables.shape(_table(spark, d, n))) for n in ("region", "nation", "part", "documents")], "name string, n_rows long, n_columns long")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def table_preview(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(tables.preview(_table(spark, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus")), "o_orderkey long, o_orderstatus string")


_REPORT = "is_valid boolean, total_rows long, expected_rows long, null_count long, blank_count long, id_mismatches long, n_errors long, columns string"


def _reported(spark: SparkSession, r: submission.Report) -> DataFrame:
    return spark.createDataFrame([(r.is_valid, r.total_rows, r.expected_rows, r.null_count, r.empty_string_count, r.id_mismatches, len(r.errors), ",".join(r.columns))], _REPORT)


@query("""WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 4 <> 0), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 5 <> 0)
SELECT false AS is_valid, (SELECT count(*) FROM s) AS total_rows, (SELECT count(*) FROM r) AS expected_rows, (SELECT count(*) FROM s WHERE p IS NULL) AS null_count, (SELECT count(*) FROM s WHERE trim(p) = '') AS blank_count,
(SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM r)) + (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM s)) AS id_mismatches, 5::BIGINT AS n_errors, 'index,prediction' AS columns""")
def validate_submission(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = _table(spark, d, "orders")
    sub = orders.where(k % 4 != 0).select(k.alias("index"), F.when(k % 6 == 0, None).when(k % 6 == 1, "  ").otherwise(F.col("o_orderpriority")).alias("prediction"))
    sample = orders.where(k % 5 != 0).select(k.alias("index"), F.lit("x").alias("other"))
    return _reported(spark, submission.validate(spark, _csv(spark, sub, "sub", True), _csv(spark, sample, "sample", True)))


@query("SELECT true AS is_valid, count(*) AS total_rows, count(*) AS expected_rows, 0::BIGINT AS null_count, 0::BIGINT AS blank_count, 0::BIGINT AS id_mismatches, 0::BIGINT AS n_errors, 'index,prediction' AS columns FROM orders")
def format_and_save(spark: SparkSession, d: str) -> DataFrame:
    df, path = _preds(spark, d), files.scratch(spark, "formatted") + ".csv"
    sample = _csv(spark, df.select("index", F.lit("x").alias("prediction")), "sample", True)
    return _reported(spark, submission.format_and_save(df, path, sample_path=sample, fallback="none"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS "index", CASE WHEN p = 'nAn' THEN 'nAn' ELSE p END AS prediction, (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0) AS filled FROM (SELECT o_orderkey, {_PRED} AS p FROM orders)""")
def save_predictions(spark: SparkSession, d: str) -> DataFrame:
    saved = submission.save_predictions(_preds(spark, d), files.scratch(spark, "saved"))
    return tables.read_table(spark, saved.path).select("index", "prediction", F.lit(saved.filled).cast("long").alias("filled"))


@query("SELECT doc_id IN (SELECT doc_id FROM labels) AS ok, count(*) AS n FROM documents GROUP BY 1")
def missing_file_report(spark: SparkSession, d: str) -> DataFrame:
    report = submission.validate(spark, files.scratch(spark, "nothing") + ".csv")
    if report.is_valid or len(report.errors) != 1:
        raise ValueError("a missing file was taken for a submission")
    known = _table(spark, d, "labels").select("doc_id", F.lit(True).alias("ok")).distinct()
    return _table(spark, d, "documents").join(known, "doc_id", "left").groupBy(F.coalesce("ok", F.lit(False)).alias("ok")).agg(F.count("*").alias("n"))


_SPLIT = "SELECT count(*) AS source_rows, 'lang' AS target_col, 40::BIGINT AS golden_train_rows, 10::BIGINT AS golden_val_rows, 4::BIGINT AS n_splits, 7::BIGINT AS seed, count(*) AS folded_rows, 4::BIGINT AS folds, 50::BIGINT AS csv_rows FROM documents"


def _split_outputs(spark: SparkSession, out: str) -> DataFrame:
    meta = json.loads(files.read_text(spark, files.join(out, "split_metadata.json")))
    folded = spark.read.parquet(files.join(out, "train_folded.parquet")).agg(F.count("*"), F.count_distinct("fold")).first()
    csv_rows = sum(tables.read_table(spark, files.join(out, f"golden_{n}.csv")).count() for n in ("train", "val"))
    row = (meta["source_rows"], meta["target_col"], meta["golden_train_rows"], meta["golden_val_rows"], meta["n_splits"], meta["seed"], *folded, csv_rows)
    return spark.createDataFrame([row], "source_rows long, target_col string, golden_train_rows long, golden_val_rows long, n_splits long, seed long, folded_rows long, folds long, csv_rows long")


def _docs_parquet(spark: SparkSession, d: str) -> str:
    path = files.scratch(spark, "source") + ".parquet"
    _table(spark, d, "documents").select("doc_id", "lang").write.parquet(path)
    return path


@query(_SPLIT)
def split_driver(spark: SparkSession, d: str) -> DataFrame:
    out = files.scratch(spark, "splits")
    split.run_splitter(spark, _docs_parquet(spark, d), out, "lang", None, 40, 10, 4, 7, "doc_id")
    return _split_outputs(spark, out)


def _printed(*argv: str) -> tuple[int, list[str]]:
    """Exit code and lines of a command."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        code = cli.main(list(argv))
    return code, out.getvalue().splitlines()


@query(_SPLIT)
def cli_split(spark: SparkSession, d: str) -> DataFrame:
    out = files.scratch(spark, "splits")
    _printed("split", "--input", _docs_parquet(spark, d), "--output-dir", out, "--target-col", "lang", "--id-col", "doc_id", "--golden-train", "40", "--golden-val", "10", "--n-splits", "4", "--seed", "7")
    return _split_outputs(spark, out)


@query(f"""WITH y AS (SELECT CAST(l.quality AS VARCHAR) AS t, CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END AS p FROM documents d JOIN labels l USING (doc_id)), {_F1}
SELECT 'exact_match' AS name, printf('%.4f', (SELECT avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END) FROM y)) AS value UNION ALL SELECT 'f1_macro', printf('%.4f', avg(f1)) FROM f UNION ALL SELECT 'f1_micro', printf('%.4f', 2.0::DOUBLE * sum(tp) / (sum(true_n) + sum(pred_n))) FROM f
UNION ALL SELECT 'f1_weighted', printf('%.4f', sum(f1 * true_n) / sum(true_n)) FROM f UNION ALL SELECT 'smape', printf('%.4f', (SELECT 100 * avg(abs(p::DOUBLE - t::DOUBLE) / ((abs(t::DOUBLE) + abs(p::DOUBLE)) / 2 + 1e-8::DOUBLE)) FROM y))
UNION ALL SELECT 'n_joined', CAST((SELECT count(*) FROM y) AS VARCHAR) UNION ALL SELECT 'n_truth', CAST((SELECT count(*) FROM labels) AS VARCHAR) UNION ALL SELECT 'n_pred', CAST((SELECT count(*) FROM documents) AS VARCHAR)
UNION ALL SELECT 'n_missing', CAST((SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS VARCHAR)""")
def cli_evaluate(spark: SparkSession, d: str) -> DataFrame:
    truth = _csv(spark, _table(spark, d, "labels").select(F.col("doc_id").alias("index"), F.col("quality").alias("prediction")), "truth", True)
    pred = _csv(spark, _table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("prediction")), "pred", True)
    _, lines = _printed("evaluate", "--truth", truth, "--predictions", pred)
    return spark.createDataFrame([tuple(x.split(": ", 1)) for x in lines], "name string, value string")


@query("SELECT 1 AS line, 'rows ' || (SELECT count(*) FROM orders) || ', nulls 0, blanks 0, id mismatches 0' AS text, 0 AS code UNION ALL SELECT 2, 'valid', 0")
def cli_validate(spark: SparkSession, d: str) -> DataFrame:
    path = _csv(spark, _table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("prediction")), "sub", True)
    code, lines = _printed("validate", path, "--sample", path)
    return spark.createDataFrame([(i + 1, x, code) for i, x in enumerate(lines)], "line int, text string, code int")


@query("SELECT 'success ' || (SELECT count(*) FROM nation WHERE n_regionkey = 0) || ', skipped ' || (SELECT count(*) FROM nation WHERE n_regionkey = 0) || ', failed ' || (SELECT count(*) FROM nation WHERE n_regionkey > 0) AS text, 0 AS code")
def cli_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Files that are there are skipped, whatever their url; other urls are none."""
    nation, out = _table(spark, d, "nation").select("n_nationkey", "n_regionkey"), files.scratch(spark, "assets")
    for r in nation.where("n_regionkey = 0").collect():  # 25 nations
        files.write_bytes(spark, files.join(out, f"{r.n_nationkey}.jpg"), bytes(200))
    source = _csv(spark, nation.select(F.col("n_nationkey").alias("index"), F.when(F.col("n_regionkey") == 1, "").otherwise("ftp://x").alias("image_link")), "urls", True)
    code, lines = _printed("fetch", "--input", source, "--output-dir", out, "--partitions", "3")
    return spark.createDataFrame([(x, code) for x in lines], "text string, code int")


def _region_files(spark: SparkSession, d: str) -> str:
    out = files.scratch(spark, "regions")
    for r in _table(spark, d, "region").collect():  # five regions
        files.write_bytes(spark, files.join(out, str(r.r_regionkey), f"{r.r_name}.txt"), r.r_name.encode() * 100_000)
    return out


@query("SELECT r_regionkey || '/' || r_name || '.txt' AS key, CAST(length(r_name) * 100000 AS BIGINT) AS length, 0 AS code FROM region")
def store_push_pull(spark: SparkSession, d: str) -> DataFrame:
    """All files under a prefix, pushed by the command line and pulled again."""
    source, there, back = _region_files(spark, d), files.scratch(spark, "pushed"), files.scratch(spark, "pulled")
    code = _printed("store", "push", source, there)[0] + _printed("store", "pull", there, back)[0]
    return store.listing(spark, back).select(F.substring_index("path", back.rsplit("/", 1)[-1] + "/", -1).alias("key"), "length", F.lit(code).alias("code"))


@query("SELECT printf('%8.2f MB', length(r_name) * 100000 / 1048576.0::DOUBLE) AS size, r_name || '.txt' AS name FROM region")
def store_list(spark: SparkSession, d: str) -> DataFrame:
    _, lines = _printed("store", "list", _region_files(spark, d))
    return spark.createDataFrame([(x.split(" | ")[1], x.rsplit("/", 1)[1]) for x in lines], "size string, name string")


@query("SELECT 'golden_train.parquet' AS name, count(*) AS n_rows, 2::BIGINT AS n_columns FROM region UNION ALL SELECT 'golden_val.parquet', NULL, NULL")
def store_pull_golden(spark: SparkSession, d: str) -> DataFrame:
    prefix = files.scratch(spark, "golden")
    _table(spark, d, "region").select("r_regionkey", "r_name").write.parquet(files.join(prefix, "golden_train.parquet"))
    got = store.pull_golden(spark, prefix, files.scratch(spark, "local"))
    return spark.createDataFrame([(n, *(x if isinstance(x, tuple) else (None, None))) for n, x in got.items()], "name string, n_rows long, n_columns long")


@query("""SELECT count(*) AS n_truth, (SELECT count(*) FROM lineitem) AS n_pred, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS n_joined,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_missing FROM orders""")
def join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(_table(spark, d, "orders").select(F.col("o_orderkey").alias("index")), _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index")))


@query(f"WITH {_EXTRACT}, y AS (SELECT p_brand AS t, coalesce(q, {_MODE}) AS p FROM e) SELECT round(avg(CASE WHEN lower(t) = lower(p) THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match, count(*) AS n_joined FROM y")
def rule_evaluate(spark: SparkSession, d: str) -> DataFrame:
    df = _titles(spark, d)
    return _rounded(models.RulePredictor(text_cols=["title"]).fit(df, "p_brand").evaluate(df, "p_brand").select("exact_match", "n_joined"), "exact_match")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'even' WHEN p_partkey % 3 = 0 THEN 'three' ELSE 'rest' END AS prediction FROM part")
def cascade_opaque(spark: SparkSession, d: str) -> DataFrame:
    class Stepped(models.Predictor):
        def fit(self, df: DataFrame, target_col: str) -> Stepped:
            return self

        def transform(self, df: DataFrame) -> DataFrame:
            by, word = self.name.split()
            return df.withColumn("prediction", F.when(F.col("p_partkey") % int(by) == 0, f" {word} "))

    return models.Cascade([Stepped("2 even"), Stepped("3 three")], fallback="rest").transform(_table(spark, d, "part").select("p_partkey")).select("p_partkey", "prediction")


@query("SELECT * FROM (VALUES ('read', 'unit', true, NULL, 2, true), ('check', NULL, false, 'no rows', 0, true)) AS t(span_name, provider, guardrail_passed, error, items, timed)")
def trace_spans(spark: SparkSession, d: str) -> DataFrame:
    tracer = Tracer("catalog", {"table": "region"})
    with tracer.span("read", "unit", {"items": 2}):
        _table(spark, d, "region").count()
    with contextlib.suppress(LookupError), tracer.span("check"):
        raise LookupError("no rows")
    schema = "trace_id string, total_latency_ms double, success boolean, spans array<struct<span_name:string,provider:string,guardrail_passed:boolean,error:string,duration_ms:double,metadata:map<string,int>>>"
    text = spark.createDataFrame([(tracer.finish(False).to_json(),)], "t string")
    spans = text.select(F.from_json("t", schema).alias("t")).where("not t.success and length(t.trace_id) = 36").select("t.total_latency_ms", F.explode("t.spans").alias("s"))
    timed = (F.col("s.duration_ms") >= 0) & (F.col("s.duration_ms") == F.round("s.duration_ms", 2)) & (F.col("total_latency_ms") >= F.col("s.duration_ms"))
    return spans.select("s.span_name", "s.provider", "s.guardrail_passed", "s.error", F.coalesce(F.col("s.metadata")["items"], F.lit(0)).alias("items"), timed.alias("timed"))


@query("SELECT * FROM (VALUES ('A', '1'), ('B', 'two words'), ('C', 'x=y'), ('D', '')) AS t(name, value)")
def dotenv_variables(spark: SparkSession, d: str) -> DataFrame:
    found = config.parse_dotenv("# note\nA=1\n B = 'two words' \nbad line\nC=x=y\n#E=5\nD=\n")
    return spark.createDataFrame(list(found.items()), "name string, value string")


@query("SELECT 'healthy' AS status, '0.1.0' AS version, 5 AS n_splits, 5000 AS golden_train, 1000 AS golden_val, 42 AS seed")
def config_defaults(spark: SparkSession, d: str) -> DataFrame:
    health, c = config.health(), config.get_config().split
    return spark.createDataFrame([(health["status"], health["version"], c.n_splits, c.golden_train_size, c.golden_val_size, c.seed)], "status string, version string, n_splits int, golden_train int, golden_val int, seed int")


@query("SELECT CAST(range AS INT) AS status, range IN (429, 500, 502, 503, 504) AS again, 3.0::DOUBLE AS waited FROM range(400, 520)")
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(400, 520).select(F.col("id").cast("int").alias("status"), F.col("id").isin(*assets.RETRYABLE).alias("again"), F.lit(sum(assets.waits(3))).alias("waited"))


@query("SELECT 'submissions/submission_20260203_040506.csv' AS path, true AS now_fits")
def timestamped_path(spark: SparkSession, d: str) -> DataFrame:
    path = spark.createDataFrame([(submission.default_path(datetime.datetime(2026, 2, 3, 4, 5, 6)), submission.default_path())], "path string, now string")
    return path.select("path", F.col("now").rlike("^submissions/submission_[0-9]{8}_[0-9]{6}[.]csv$").alias("now_fits"))
