"""One bad record, label or file never ends a job or spoils its neighbours."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.validate import canonical_flows
from flowsieve.operators import ml
from flowsieve.operators.evaluate import classification_report
from flowsieve.operators.labels import encode_labels
from flowsieve.operators.rolling import rolling_features
from flowsieve.operators.selection import anova_f_scores, mutual_info_scores
from flowsieve.plans.pipelines import adhoc_process
from flowsieve.sources import zeek
from flowsieve.sources.csv_flows import load_flow_csv, read_exporter_csv, sniff_files
from test_parsers_and_edges import CONN


def _with(line, at, value):
    parts = line.split("\t")
    parts[at] = value
    return "\t".join(parts)


@pytest.mark.parametrize("at,value", [(3, "4294967296"), (5, "12345678901234567890"), (0, "99999999999999.0"),
                                      (0, "garbage"), (9, "99999999999999999999")])
def test_a_field_out_of_range_drops_its_line_only(spark, at, value):
    lines = spark.createDataFrame([(CONN,), (_with(CONN, at, value),)], "value string")
    assert zeek.parse_conn(lines).count() == 1


def test_bad_time_drops_the_record_and_missing_time_is_now(spark):
    rows = [("garbage", "10.0.0.1"), ("2024-01-01 00:00:00", "10.0.0.2"), (None, "10.0.0.3")]
    raw = spark.createDataFrame([(ts, ip, "10.1.1.1", "1", "2", "TCP") for ts, ip in rows],
                                "flow_ts string, src_ip string, dst_ip string, src_port string, dst_port string, protocol string")
    got = {r.src_ip: r.flow_ts for r in canonical_flows(raw).collect()}
    assert set(got) == {"10.0.0.2", "10.0.0.3"} and got["10.0.0.3"].year >= 2024


def test_encoding_is_decided_by_whole_files(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "a.csv"), "wb") as fh:
        fh.write(b"Flow Duration;Label\n" + b"1;x\n" * 3000 + b"2;Caf\xe9\n")
    with open(os.path.join(tmpdir_path, "b.csv"), "wb") as fh:
        fh.write("Flow Duration,Label\n3,Café �\n".encode())
    kinds = sniff_files(spark, tmpdir_path)
    assert {k: [os.path.basename(f) for f in v] for k, v in kinds.items()} == {
        (";", "iso-8859-1"): ["a.csv"], (",", "utf-8"): ["b.csv"]}
    labels = {r.label for r in load_flow_csv(spark, tmpdir_path).select("label").distinct().collect()}
    assert labels == {"x", "Café", "Café �"}


def test_exporter_nan_reads_zero(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "f.csv")
    with open(path, "w") as fh:
        fh.write("Src IP,Flow Bytes/s,Flow Packets/s\n1.1.1.1,NaN,3\n")
    r = read_exporter_csv(spark, path).first()
    assert (r.flow_bytes_s, r.flow_packets_s) == (0.0, 3.0)


def test_labels_lose_any_white_space(spark):
    rows = [("BENIGN\t",), ("Benign\r\n",), (" benign",), ("DDoS ",), (None,)]
    enc, fit = encode_labels(spark.createDataFrame(rows, "label string"))
    assert fit.classes == ["BENIGN", "DDOS", "NAN"]
    assert sorted(r.binary_label for r in enc.collect()) == [0, 0, 0, 1, 1]


def test_many_classes_are_joined(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("label"))
    enc, fit = encode_labels(df)
    assert len(fit.classes) == 3000
    assert enc.where(F.concat(F.lit("c"), F.lpad(F.col("label").cast("string"), 5, "0")) == F.col("original_label")).count() == 3000


def test_wide_integers_have_windows(spark):
    values = [(-1) ** i * (10 ** 18 - i * 7919) for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, x long")
    got = rolling_features(df, ["x"], "k", kinds=("var_std", "skew_kurt", "quantiles", "mean_std")).orderBy("k").toPandas()
    want = pd.Series([float(v) for v in values]).rolling(5, min_periods=1).var().fillna(0)
    assert ((got.x_variance - want).abs() <= 1e-9 * want.abs().max()).all()


def test_empty_report(spark):
    got = classification_report(spark.createDataFrame([], "y int, pred int")).collect()
    assert all(r.f1 == 0.0 and r.support == 0 for r in got) and len(got) == 5


def _labelled(spark):
    return spark.range(400).select(
        F.col("id").alias("flow_seq"), (F.col("id") % 7).cast("double").alias("noise"), (F.col("id") % 2 * 10 + F.col("id") % 3).alias("sig"),
        (F.col("id") * 0.0 + 1).alias("flat"), F.when(F.col("id") % 2 == 0, "BENIGN").otherwise("DDoS").alias("label"))


@pytest.mark.parametrize("select", ["univariate", "mutual_info", "importance"])
def test_selection_methods_keep_column_order(spark, select):
    res = adhoc_process(_labelled(spark), features=False, select=select, k=2)
    assert "sig" in res.features and res.features == [c for c in ["noise", "sig", "flat"] if c in res.features]


def test_unknown_selection_is_refused(spark):
    with pytest.raises(ValueError):
        adhoc_process(_labelled(spark), select="best")


def test_one_pass_statistics_skip_missing_values(spark):
    df = _labelled(spark).withColumn("y", (F.col("flow_seq") % 2).cast("int")).withColumn(
        "holes", F.when(F.col("flow_seq") % 5 == 0, F.lit(None)).otherwise(F.col("sig"))).withColumn(
        "none", F.lit(None).cast("double"))
    f = {r.feature: r.f_score for r in anova_f_scores(df, ["sig", "holes", "noise", "none"], "y").collect()}
    assert f["sig"] > f["noise"] and f["holes"] > f["noise"] and "none" not in f
    mi = {r.feature: r.mi for r in mutual_info_scores(df, ["sig", "noise", "none"], "y").collect()}
    assert mi["sig"] > 0.6 > mi["noise"] and "none" not in mi


def test_pca_projects_the_rows(spark):
    df = spark.range(200).select(F.col("id").alias("flow_seq"), (F.col("id") * 1.0).alias("a"),
                                 (F.col("id") * 2.0 + F.col("id") % 2).alias("b"), (F.col("id") % 5 * 0.001).alias("c"))
    got = ml.apply_pca(df, ["a", "b", "c"], 0.95)
    assert got.columns == ["flow_seq", "PC1"] and got.count() == 200
    assert abs(got.agg(F.corr("PC1", F.col("flow_seq").cast("double"))).first()[0]) > 0.999


def test_last_header_of_a_file_counts(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "x.log"), "w") as fh:
        fh.write("#fields\ta\tb\n#fields\tb\tc\n1\t2\n")
    df = zeek.read_zeek_tsv(spark, tmpdir_path)
    assert [(r.b, r.c) for r in df.collect()] == [("1", "2")]


def test_too_many_protocols_are_refused(spark):
    from flowsieve.operators.features import protocol_values

    with pytest.raises(ValueError):
        protocol_values(spark.range(1500).select(F.col("id").cast("string").alias("protocol")))
