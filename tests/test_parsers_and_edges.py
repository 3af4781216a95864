"""Hand-computed sensor lines, CSV sniffing and edge rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.validate import canonical_flows, fit_width, valid_ip
from flowsieve.operators.alerts import recommended_action, severity
from flowsieve.operators.clean import clean_dataset
from flowsieve.operators.features import extract_flow_features
from flowsieve.operators.labels import binary_label, encode_labels, normalized_label
from flowsieve.operators.rolling import rolling_features
from flowsieve.sources import zeek
from flowsieve.sources.csv_flows import load_flow_csv, read_exporter_csv

TAB = "\t"
CONN = TAB.join(["1609459200.123456", "CAbc", "192.168.1.100", "12345", "10.0.0.1", "80", "tcp", "http",
                 "10.5", "15", "8", "1500", "800", "SF", "-", "T", "F", "0", "ShADadFf", "15", "2100",
                 "8", "1120"])
DNS = TAB.join(["1609459200.5", "CDns", "192.168.1.100", "54321", "8.8.8.8", "53", "udp", "12345",
                "0.02", "example.com", "1", "C_INTERNET", "1", "A", "0", "NOERROR", "F", "F", "T", "T"])


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_conn_sample_line(spark):
    r = zeek.parse_conn(_lines(spark, CONN)).collect()[0]
    assert r.flow_ts == dt.datetime(2021, 1, 1, 0, 0, 0, 123456)
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol) == ("192.168.1.100", 12345, "10.0.0.1", 80, "tcp")
    assert r.flow_duration == pytest.approx(10_500_000)
    assert (r.total_fwd_packets, r.total_backward_packets) == (15, 8)
    assert r.flow_bytes_s == pytest.approx(219.047619, abs=1e-6)
    assert r.flow_packets_s == pytest.approx(2.190476, abs=1e-6)
    assert (r.fwd_packet_length_mean, r.fwd_packet_length_max, r.fwd_packet_length_min) == (100, 150, 50)
    assert r.flow_iat_mean == pytest.approx(456521.739, abs=1e-3)
    assert r.flow_iat_std == pytest.approx(136956.522, abs=1e-3)
    assert r.connection_state == "SF"


def test_dns_sample_line(spark):
    r = zeek.parse_dns(_lines(spark, DNS)).collect()[0]
    assert (r.dns_query, r.dns_qtype, r.dns_rcode, r.protocol) == ("example.com", "A", "NOERROR", "udp")
    assert (r.src_port, r.dst_port) == (54321, 53)
    assert (r.flow_duration, r.flow_bytes_s, r.flow_packets_s) == (100000, 1920, 20)


def test_conn_edge_lines(spark):
    f = CONN.split(TAB)
    dash_port = TAB.join(f[:3] + ["-"] + f[4:])
    bad_port = TAB.join(f[:3] + ["80.0"] + f[4:])
    no_dur = TAB.join(f[:8] + ["-"] + f[9:])
    short = TAB.join(f[:10])
    rows = zeek.parse_conn(_lines(spark, dash_port, bad_port, no_dur, short, "#fields\tts", "", "  ")).collect()
    assert len(rows) == 2
    assert {r.src_port for r in rows} == {0, 12345}
    assert {r.flow_duration for r in rows} == {0.0, 10_500_000.0}
    zero = [r for r in rows if r.flow_duration == 0.0][0]
    assert zero.flow_bytes_s == 0 and zero.flow_packets_s == 0


def test_weird_ports_and_addresses(spark):
    line = TAB.join(["1609459200", "-", "-", "x1", "10.0.0.1", "-", "bad_TCP_checksum"])
    six = TAB.join(["1609459200", "C1", "1.1.1.1", "1", "2.2.2.2", "2"])
    rows = {r.zeek_uid: r for r in zeek.parse_weird(_lines(spark, line, six)).collect()}
    assert rows["-"].src_ip == "0.0.0.0" and rows["-"].src_port == 0 and rows["-"].dst_port == 0
    assert rows["C1"].weird_name == "unknown" and rows["C1"].weird_notice


def test_zeek_folder_and_header_scan(spark, tmpdir_path):
    for name, body in {"conn.log": CONN, "dns.log": DNS, "notice.log": "x\ty"}.items():
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            fh.write("#fields\tts\tuid\tid.orig_h\n" + body + "\n")
    assert zeek.read_zeek_dir(spark, tmpdir_path).count() == 2
    tsv = zeek.read_zeek_tsv(spark, os.path.join(tmpdir_path, "conn.log"))
    r = tsv.collect()[0]
    assert r["ts"] == "1609459200.123456" and r["id.orig_h"] == "192.168.1.100"


def test_csv_sniff_tab_and_latin1(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "data.csv")
    with open(path, "wb") as fh:
        fh.write(" Label\tFlow Duration\tTotal Fwd Packets\tnote\n".encode("latin-1"))
        fh.write("BENIGN\t100\t3\tcaf\xe9\n".encode("latin-1"))
        fh.write("DDoS\tinf\t4\tx\n".encode("latin-1"))
    df = load_flow_csv(spark, path)
    assert set(df.columns) >= {"label", "flow_duration", "total_fwd_packets", "note"}
    rows = df.orderBy("total_fwd_packets").collect()
    assert rows[0]["note"] == "café" and rows[1]["flow_duration"] == float("inf")


def test_exporter_csv_missing_cells(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "flows.csv")
    with open(path, "w") as fh:
        fh.write("Src IP,Src Port,Dst IP,Dst Port,Flow Duration,Flow Bytes/s\n")
        fh.write(",1234,10.0.0.1,,100,nan\n")
    r = read_exporter_csv(spark, path).collect()[0]
    assert (r.src_ip, r.dst_port, r.flow_duration, r.source) == ("0.0.0.0", 0, 100.0, "cicflowmeter_real")
    assert r.total_fwd_packets == 0.0


def test_clean_dataset_edges(spark):
    rows = [(1.0, 2, "BENIGN"), (float("inf"), 2, "BENIGN"), (None, None, None), (3.0, 4, "DDoS"),
            (3.0, 4, "DDoS"), (float("nan"), 6, "x")]
    df = spark.createDataFrame(rows, "`Flow Duration` double, fwd_packets long, Label string")
    out = clean_dataset(df)
    assert set(out.columns) == {"flow_duration", "total_fwd_packets", "label"}
    got = sorted((r.flow_duration, r.total_fwd_packets) for r in out.collect())
    # median of the finite durations (1, 3, 3) is 3
    assert got == [(1.0, 2), (3.0, 2), (3.0, 4), (3.0, 6)]


def test_label_edges(spark):
    labels = ["benign", " Normal ", "0", "0.0", None, "LEGITIMATE", "PortScan"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [r[0] for r in df.select(binary_label(normalized_label(F.col("label")))).collect()]
    assert got == [0, 0, 0, 1, 1, 0, 1]
    enc, fit = encode_labels(df)
    assert fit.classes == sorted(fit.classes) and "NAN" in fit.classes


def test_ip_literals(spark):
    vals = ["256.1.1.1", "1.2.3", "1.2.3.4.", "::1", "fe80::1", "", "010.1.1.1", "192.168.0.1",
            "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8:9"]
    df = spark.createDataFrame([(v,) for v in vals], "ip string")
    got = [r[0] for r in df.select(valid_ip(F.col("ip"))).collect()]
    assert got == [False, False, False, True, True, False, False, True, True, False]


def test_canonical_flow_defaults_and_drops(spark):
    rows = [("1.1.1.1", "2.2.2.2", "1", "80", None), ("1.1.1.1", "2.2.2.2", "1", "80.0", "UDP"),
            ("1.1.1.1", None, "1", "80", "UDP")]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port string, dst_port string, protocol string")
    out = canonical_flows(df).collect()
    assert len(out) == 1 and out[0].protocol == "TCP" and out[0].flow_duration == 0.0
    assert out[0].source == "real_traffic"


def test_port_classes(spark):
    ports = [0, 1023, 1024, 49151, 49152, 65535]
    df = spark.createDataFrame([(p,) for p in ports], "dst_port int")
    out = extract_flow_features(df, protocols=[]).frame.orderBy("dst_port").collect()
    assert [(r.dst_port_is_wellknown, r.dst_port_is_registered, r.dst_port_is_dynamic) for r in out] == [
        (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]


def test_single_row_and_constant_frames(spark):
    df = spark.createDataFrame([(i, 5) for i in range(6)], "seq long, x long")
    out = rolling_features(df, ["x"], "seq").orderBy("seq").collect()
    assert out[0].x_variance == 0 and out[0].x_skewness == 0 and out[0].x_kurtosis == 0
    assert out[5].x_skewness == 0 and out[5].x_kurtosis == -3 and out[5].x_iqr == 0


def test_severity_cuts(spark):
    df = spark.createDataFrame([(0.7,), (0.8,), (0.9,), (0.69,)], "c double")
    got = df.select(severity(F.col("c")), recommended_action(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("MEDIUM", "MONITOR_CLOSELY"), ("HIGH", "INVESTIGATE_URGENT"),
                                      ("CRITICAL", "BLOCK_IMMEDIATELY"), ("LOW", "LOG_AND_REVIEW")]


def test_fit_width(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    r = df.select(fit_width(F.col("a"), 5).alias("p"), fit_width(F.col("a"), 2).alias("t")).collect()[0]
    assert r.p == [1.0, 2.0, 3.0, 0.0, 0.0] and r.t == [1.0, 2.0]
