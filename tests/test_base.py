"""Unit tests of the operators on small literals and edge cases."""

import http.server
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera import config, trace
from tessera.functions import binary, text, units
from tessera import cli
from tessera.operators import metrics, models, ranking, split, submission
from tessera.sources import assets, files, store, tables


def one(spark, value, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(expr(F.col("v"))).collect()]


def test_float_grammar(spark):
    given = [" 12 ", "1_000", "1d", "1f", "inf", "nan", "1e3", "0x10", "", "-.5", "1_", "٣"]
    got = one(spark, given, text.py_float)
    for g, s in zip(got, given, strict=True):
        try:
            want = float(s)
        except ValueError:
            want = None
        if s == "٣":  # digits beyond ASCII are not read
            want = None
        assert (g is None and want is None) or g == want or (math.isnan(g) and math.isnan(want))


def test_python_text_of_doubles(spark):
    given = [1.0, 10000000.0, 1e16, 1e-5, 0.1, 123.456, -2.5, float("nan"), float("inf"), 0.0005, 1.5e300, None]
    got = one(spark, given, lambda c: text.py_str(c, "double"), "double")
    assert got == [*map(str, given[:-1]), "nan"]


def test_strip_takes_unicode_space(spark):
    given = ["  a\x1c", "\t\nb", ""]
    assert one(spark, given, text.py_strip) == [s.strip() for s in given]


@pytest.mark.parametrize(
    ("given", "want"),
    [("1,500 g", "500 gram"), ("5 in 1", "5 inch"), ("v2.5kg", "5 kilogram"), ("10x20 cm", None), ("10 x 20 cm", "20 centimetre"), ("2 pack 500 g", "500 gram"), ("100 fl  oz", "100 fluid ounce"), ("1.5.2 kg", "5.2 kilogram"), ("500gPack", None), ("5gé", "5 gram"), ("5 Kg", None), ("nothing", None), (None, None)],
)
def test_extraction(spark, given, want):
    assert one(spark, [given], units.extract_quantity) == [want]


def test_units(spark):
    assert one(spark, ["g", "gms", "KG", "ml", "cm", "unknown_unit"], units.normalize_unit) == ["gram", "gram", "kilogram", "millilitre", "centimetre", "unknown_unit"]


def test_images(spark):
    given = [b"\xff\xd8\xff" + bytes(30), b"\x89PNG\r\n\x1a\n" + bytes(30), b"<html>" + bytes(20), b"", b"GIF8" + bytes(30), b"RIFF0000WEBP" + bytes(30), b"x" * 1024, b"x" * 1025]
    want = [True, True, False, False, True, True, False, True]
    assert one(spark, given, binary.is_valid_image, "binary") == want == [assets.valid_image(x) for x in given]


def pairs(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"y_true {kind}, y_pred {kind}")


def test_metrics(spark):
    r = metrics.evaluate(pairs(spark, [("A", "A"), ("B", "B"), ("A", "B"), ("B", "B")])).first()
    assert r.f1_macro == pytest.approx(11 / 15) and r.f1_micro == 0.75 and r.smape is None
    r = metrics.evaluate(pairs(spark, [("10", "10"), ("20", "25"), ("30", "30")])).first()
    assert r.exact_match == pytest.approx(2 / 3) and r.smape > 0
    r = metrics.evaluate(pairs(spark, [("Gram", "gram"), (None, None)])).first()
    assert r.exact_match == 1.0 and r.f1_micro == 0.5
    assert math.isnan(metrics.evaluate(pairs(spark, [("nan", "1")])).first().smape)


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, "x"), (1, "a"), (1, "b"), (2, "z")], "index int, prediction string")
    assert metrics.join_predictions(a, a).count() == 1 + 4 + 1
    with pytest.raises(ValueError, match="missing"):
        metrics.join_predictions(a, a, target_col="nope")


def test_folds(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id long, target string")
    got = split.assign_folds(df, "target", id_col="id")
    assert sorted(r["count"] for r in got.groupBy("fold", "target").count().collect()) == [10] * 10
    plain = split.kfold(df.limit(98), 5, id_col="id").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in plain] == [20, 20, 20, 19, 19]
    other = split.kfold(df, 5, seed=1, id_col="id").join(split.kfold(df, 5, id_col="id").withColumnRenamed("fold", "f"), "id")
    assert other.where("fold <> f").count() > 20
    groups = spark.createDataFrame([(g,) for g, n in zip("wxyz", (5, 3, 2, 2), strict=True) for _ in range(n)], "g string")
    assert sorted(r["count"] for r in split.group_kfold(groups, "g", 3).groupBy("fold").count().collect()) == [3, 4, 5]
    with pytest.raises(ValueError, match="n_splits"):
        split.kfold(df.limit(3), 5)


def greedy(sizes, n_splits):
    loads, folds = [0] * n_splits, []
    for n in sizes:
        k = min(range(n_splits), key=lambda i: (loads[i], i))
        loads[k] += n
        folds.append(k)
    return folds


def test_group_folds_are_greedy_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_GROUPS", 3, raising=False)
    rng = random.Random(0)
    sizes = {None: 2, "giant": 150, **{f"g{rng.randrange(10**6)}": rng.choice([1, 1, 1, 2, 2, 3, 7, 20]) for _ in range(400)}}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    order = sorted(sizes, key=lambda g: (-sizes[g], g is not None, g or ""))
    want = dict(zip(order, greedy([sizes[g] for g in order], 5), strict=True))
    got = split.group_folds(df, "g", 5)
    assert {r.group: (r.n, r.fold) for r in got.collect()} == {g: (sizes[g], want[g]) for g in sizes} and got.count() == len(sizes)


def test_runs_of_a_deal_are_greedy():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randint(1, 7)
        kinds = [(n, rng.randint(1, 40)) for n in sorted(rng.sample(range(1, 60), rng.randint(1, 6)), reverse=True)]
        got = [folds[(r - first) % len(folds)] for _, first, end, folds in split.deal(kinds, k) for r in range(first, end)]
        assert got == greedy([n for n, c in kinds for _ in range(c)], k)


def test_fold_is_the_same_under_any_partitioning(spark):
    df = spark.range(500).withColumn("c", F.col("id") % 7)
    rows = lambda n: sorted(split.stratified_kfold(df.repartition(n), "c", id_col="id").select("id", "fold").collect())
    assert rows(3) == rows(11)


def test_golden(spark):
    df = spark.createDataFrame([(i, "cd"[i % 2]) for i in range(200)], "id long, target string")
    got = split.golden(df, "target", 50, 20, id_col="id")
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 50, "val": 20}
    assert got.select("id").distinct().count() == 70
    assert split.scaled_sizes(10, 5000, 1000) == (8, 2)
    uneven = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(200)], "id long, target string")
    assert split.golden(uneven, "target", 50, 20, id_col="id").count() == 70


def test_csv_and_validation(spark, tmp_path):
    sub, sample = tmp_path / "sub.csv", tmp_path / "sample.csv"
    sample.write_text("index,prediction\n1,10 g\n2,20 kg\n3,30 cm\n")
    sub.write_text('index,prediction\n1,"10\ng"\n\n2,"say ""x"""\n3,   \n')
    assert [r.prediction for r in tables.read_csv(spark, str(sub)).collect()] == ["10\ng", 'say "x"', "   "]
    bad = submission.validate(spark, str(sub), str(sample))
    assert bad.empty_string_count == 1 and not bad.is_valid and bad.null_count == 0
    assert submission.validate(spark, str(sample), str(sample)).is_valid
    sub.write_text("index,prediction\n1,10 g\n2,NA\n")
    short = submission.validate(spark, str(sub), str(sample))
    assert short.null_count == 1 and short.id_mismatches == 1 and any("Row count mismatch" in e for e in short.errors) and any("NaN/Null" in e for e in short.errors)
    assert not submission.validate(spark, str(tmp_path / "none.csv")).is_valid
    df = spark.createDataFrame([(101, "500 gram"), (102, "10 metre"), (103, None)], "index long, prediction string")
    out = str(tmp_path / "out.csv")
    assert submission.format_and_save(df, out, fallback="fallback_value").is_valid
    assert tables.read_csv(spark, out).where("index = '103'").first().prediction == "fallback_value"


def test_rules_and_cascade(spark):
    df = spark.createDataFrame([(1, "Organic Almonds 500 g Pack", ""), (2, "Stainless Steel Ruler 30 cm", ""), (3, "Generic Unlabeled Item", "")], "index long, title string, description string")
    rules = models.RulePredictor().fit(df, "title")
    assert [r.prediction for r in rules.transform(df).orderBy("index").collect()] == ["500 gram", "30 centimetre", "Generic Unlabeled Item"]

    class Opaque(models.Predictor):
        def fit(self, df, target_col):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.when(F.col("index") == 3, "  three "))

    got = models.Cascade([Opaque("o"), models.RulePredictor(fallback="")], fallback="none").transform(df)
    assert sorted((r["index"], r["prediction"]) for r in got.collect()) == [(1, "500 gram"), (2, "30 centimetre"), (3, "three")]


def test_fetch(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path.startswith("/ok")
            self.send_response(200 if ok or self.path == "/html" else 404)
            self.end_headers()
            self.wfile.write(b"\xff\xd8\xff" + bytes(200) if ok else b"<html>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(1, f"{base}/ok"), (2, f"{base}/html"), (3, f"{base}/no"), (4, None)], "index long, image_link string")
    reasons = lambda: {r.path.rsplit("/", 1)[1]: r.reason for r in assets.fetch(df, str(tmp_path / "a")).collect()}
    assert reasons() == {"1.jpg": None, "2.jpg": "corrupted_or_html", "3.jpg": "http_status_404", "4.jpg": "invalid_url"}
    assert reasons()["1.jpg"] == "already_exists"
    server.shutdown()
    assert store.listing(spark, str(tmp_path / "a")).count() == 1
    assert store.copy(spark, str(tmp_path / "a"), str(tmp_path / "b")) and not store.copy(spark, str(tmp_path / "none"), str(tmp_path / "c"))


def test_trace_config(tmp_path, monkeypatch):
    t = trace.Tracer("p")
    with t.span("one", provider="unit"):
        pass
    with pytest.raises(RuntimeError), t.span("two"):
        raise RuntimeError("no")
    assert [s.span_name for s in t.finish().spans] == ["one", "two"] and t.spans[1].error == "no" and '"two"' in t.to_json()
    assert config.Config().split.golden_train_size == 5000 and config.Config().store.region == "us-east-1" and config.health()["status"] == "healthy"
    with pytest.raises(ValueError, match="n_splits"):
        config.SplitConfig(n_splits=1)
    (tmp_path / ".env").write_text("# x\nTESSERA_T1='a b'\nbad\n")
    monkeypatch.delenv("TESSERA_T1", raising=False)
    config.load_dotenv(str(tmp_path / ".env"))
    import os

    assert os.environ.pop("TESSERA_T1") == "a b"


def test_evaluate_reads_its_input_once(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("y_true"), (F.col("id") % 7).cast("string").alias("y_pred"))
    plan = metrics.evaluate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    assert metrics.evaluate(df.limit(0)).first().n_joined == 0


@pytest.mark.parametrize("bucket_rows", [10, 250_000])
def test_ranks_do_not_depend_on_buckets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(ranking, "RANGES", 3)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", *(f"c{rng.randrange(40)}" for _ in range(3))])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string")
    key = {r.id: r.k for r in df.select("id", ranking.seeded_key(F.col("id"), 42).alias("k")).collect()}
    want = {i: n % 5 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] or "nan", key[r[0]], r[0])))}
    assert {r.id: r.fold for r in split.stratified_kfold(df, "c", id_col="id").collect()} == want
    got = {r.id: r["rank"] for r in ranking.global_rank(df.withColumn("k", ranking.seeded_key(F.col("id"), 42)), [F.col("k"), F.col("id")], "k", 400).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(key, key=lambda i: (key[i], i)))}
    assert ranking.prefix_digits(10**11) > 2 or bucket_rows == 10


def test_files_of_any_scheme(spark, tmp_path):
    assert files.join("s3a://b/x/", "/y", "z.json") == "s3a://b/x/y/z.json"
    assert files.relative_key("s3a://b/p/a/b.txt", "s3a://b/p") == "a/b.txt" and files.relative_key("s3a://b/p.txt", "s3a://b/p.txt") == "p.txt"
    assert files.arrow_place("file:/tmp/x") == files.arrow_place("file:///tmp/x") == files.arrow_place("/tmp/x")
    path = str(tmp_path / "one.txt")
    files.write_bytes(spark, path, b"a\nb")
    assert files.read_text(spark, path) == "a\nb" and store.copy(spark, path, str(tmp_path / "deep" / "two.txt"))
    assert (tmp_path / "deep" / "two.txt").read_bytes() == b"a\nb"
    (tmp_path / "empty").mkdir()
    assert not store.copy(spark, str(tmp_path / "empty"), str(tmp_path / "n"))


def test_csv_is_one_file_and_splits_when_it_can(spark, tmp_path):
    df = spark.createDataFrame([(i, f" x, {i}") for i in range(100)], "id long, v string").repartition(5)
    path = str(tmp_path / "one.csv")
    tables.write_csv(df, path, single=True)
    assert (tmp_path / "one.csv").is_file() and len((tmp_path / "one.csv").read_text().splitlines()) == 101
    assert not tables.has_quoted_newlines(spark, path)
    assert sorted(map(tuple, tables.read_csv(spark, path).collect())) == sorted((str(i), f" x, {i}") for i in range(100))
    assert sorted(map(tuple, tables.read_csv(spark, path, multi_line=True).collect())) == sorted((str(i), f" x, {i}") for i in range(100))


def test_rows_of_too_many_fields_are_reported(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("index,prediction\n1,a\n2,b,c\n3\n")
    report = submission.validate(spark, str(path))
    assert not report.is_valid and len(report.errors) == 1 and "not a readable CSV" in report.errors[0]
    path.write_text("index,prediction\n1,a\n3\n")
    assert submission.validate(spark, str(path)).null_count == 1
    path.write_text("")
    assert not submission.validate(spark, str(path)).is_valid


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("index,prediction\n1,a\n2,\n")
    assert cli.main(["validate", str(tmp_path / "a.csv")]) == 1 and "NaN/Null" in capsys.readouterr().out
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    assert cli.main(["store", "list", str(tmp_path)]) == 0
    assert sum(".txt" in line for line in capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["store", "pull", str(tmp_path / "none"), str(tmp_path / "to")]) == 1
    (tmp_path / "urls.csv").write_text("index,image_link\n1,\n2,ftp\n")
    assert cli.main(["fetch", "--input", str(tmp_path / "urls.csv"), "--output-dir", str(tmp_path / "f"), "--limit", "1"]) == 1


def test_waits_and_retries(monkeypatch, tmp_path):
    slept, answers = [], iter([(None, "max_retries_exceeded", True), (None, "error_URLError", True), (b"\xff\xd8\xff" + bytes(40), "", False)])
    monkeypatch.setattr(assets.time, "sleep", slept.append)
    monkeypatch.setattr(assets, "answer", lambda url, timeout: next(answers))
    assert assets.fetch_one("http://x", str(tmp_path / "a" / "1.jpg")) == (str(tmp_path / "a" / "1.jpg"), True, None)
    assert slept == [0.0, 1.0, 2.0] and (tmp_path / "a" / "1.jpg").stat().st_size == 43
    monkeypatch.setattr(assets, "answer", lambda url, timeout: (None, "max_retries_exceeded", True))
    assert assets.fetch_one("http://x", str(tmp_path / "2.jpg"))[2] == "max_retries_exceeded"


def test_save_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None), (3, float("nan"))], "index long, prediction double")
    saved = submission.save_predictions(df, str(tmp_path))
    assert (saved.rows, saved.filled, len(saved.preview)) == (3, 2, 3)
    assert sorted(map(tuple, tables.read_csv(spark, saved.path).collect()), key=str) == [("1", "2.5"), ("2", None), ("3", None)]


def test_entry_lets_broken_operators_fail(tmp_path):
    import shutil
    import subprocess
    import sys

    root = files.__file__.rsplit("/tessera/", 1)[0]
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    alone = run()
    assert alone.returncode == 0 and len(set(alone.stdout.split())) == 1
    (tmp_path / "tessera" / "llm" / "__pycache__").mkdir(parents=True)
    assert run().stdout == alone.stdout
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_module" in run().stderr


def test_native_operators_plan_no_python(spark):
    df = spark.createDataFrame([("1 g", "1 g")], "y_true string, y_pred string")
    plan = metrics.evaluate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    plan = split.kfold(spark.range(50), 5, id_col="id")._jdf.queryExecution().toString()
    assert "Python" not in plan
