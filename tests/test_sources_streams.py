"""Streaming sources bound by name, callbacks and batch exports."""

import gzip
import os
import re

import pytest

from flowsieve.sources.csv_flows import load_csv
from flowsieve.streaming import sinks
from flowsieve.schema import CIC_HEADER_MAP
from flowsieve.streaming.sources import LOG_NAME_RE, flow_stream
from flowsieve.streaming.tail import TailReader
from test_parsers_and_edges import CONN, DNS


def test_zeek_stream_over_rotated_logs(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "logs")
    os.makedirs(src)
    for i, (name, body) in enumerate([("conn.log", CONN), ("dns.log", DNS), ("x.log", "a\tb")]):
        sub = os.path.join(src, f"r{i}")
        os.makedirs(sub)
        with open(os.path.join(sub, name), "w") as fh:
            fh.write(body + "\n")
    stream = flow_stream(spark, "zeek", os.path.join(src, "*"), max_files_per_trigger=1)
    out = os.path.join(tmpdir_path, "out")
    sinks.append_table(stream, out, os.path.join(tmpdir_path, "ck")).awaitTermination()
    kinds = sorted(r.zeek_log_type for r in spark.read.parquet(out).collect())
    assert kinds == ["conn", "dns"]


def test_exporter_stream_and_callback(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"f{i}.csv"), "w") as fh:
            fh.write("Timestamp,Src IP,Src Port,Dst IP,Dst Port,Flow Duration\n")
            fh.write(f"2024-01-01 00:00:0{i},10.0.0.{i},1{i},10.0.1.1,80,{100 * i}\n")
    seen = []

    def callback(batch, batch_id):
        seen.append((batch_id, batch.count()))

    stream = flow_stream(spark, "cicflowmeter", src, max_files_per_trigger=1)
    sinks.on_each_batch(stream, callback, os.path.join(tmpdir_path, "ck")).awaitTermination()
    assert sorted(seen) == [(0, 1), (1, 1), (2, 1)]


def _tail_run(spark, src, folder, kind="zeek_tail", **options):
    out = os.path.join(folder, "out")
    stream = flow_stream(spark, kind, src, **options)
    sinks.append_table(stream, out, os.path.join(folder, "ck")).awaitTermination()
    return spark.read.parquet(out)


def test_growing_and_rotated_logs_are_read_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "logs")
    os.makedirs(src)
    log = os.path.join(src, "conn.log")

    def line(i):
        return CONN.replace(CONN.split("\t")[1], f"C{i}")

    def uids(df):
        return sorted(r.zeek_uid for r in df.collect())
    with open(log, "w") as fh:
        fh.write("#separator\n" + line(0) + "\n" + line(1)[:20])       # the last line is not complete
    assert uids(_tail_run(spark, src, tmpdir_path)) == ["C0"]
    with open(log, "a") as fh:
        fh.write(line(1)[20:] + "\n" + line(2) + "\n")
    assert uids(_tail_run(spark, src, tmpdir_path)) == ["C0", "C1", "C2"]
    os.rename(log, os.path.join(src, "conn.2024-01-01-00-00-00.log"))    # rotation: same file, new name
    with open(log, "w") as fh:
        fh.write(line(3) + "\n")
    with gzip.open(os.path.join(src, "conn.2023-12-31.log.gz"), "wt") as fh:
        fh.write(line(4) + "\n" + "4294967296\n")
    assert uids(_tail_run(spark, src, tmpdir_path)) == ["C0", "C1", "C2", "C3", "C4"]
    assert uids(_tail_run(spark, src, tmpdir_path)) == ["C0", "C1", "C2", "C3", "C4"]


def test_tail_pieces_cut_at_line_ends(tmpdir_path):
    path = os.path.join(tmpdir_path, "x.log")
    lines = [f"line {i} " + "y" * (i % 37) for i in range(500)]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\nunfinished")
    reader = TailReader({"path": tmpdir_path, "pieceBytes": "300"})
    end = reader.latestOffset()
    pieces = reader.partitions({}, end)
    assert len(pieces) > 20 and [v for p in pieces for v, _ in reader.read(p)] == lines


def test_canonical_streams_share_a_schema(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    path = os.path.join(src, "flows.csv")
    header = ",".join(["Timestamp", *CIC_HEADER_MAP])
    cells = {"Timestamp": "2024-01-01 00:00:01", "Src IP": "10.0.0.1", "Src Port": "1", "Dst IP": "10.0.0.2",
             "Dst Port": "80", "Protocol": "TCP", "Flow Bytes/s": "NaN"}
    row = ",".join(cells.get(h, "5") for h in ["Timestamp", *CIC_HEADER_MAP])
    with open(path, "w") as fh:
        fh.write(header + "\n" + row + "\n" + row.replace("10.0.0.1", "nowhere") + "\n")
    got = _tail_run(spark, src, tmpdir_path, "cicflowmeter_tail", canonical=True)
    assert [(r.src_ip, r.dst_port) for r in got.collect()] == [("10.0.0.1", 80)]
    with open(path, "a") as fh:
        fh.write(row.replace("10.0.0.1", "10.0.0.9") + "\n")
    assert _tail_run(spark, src, tmpdir_path, "cicflowmeter_tail", canonical=True).count() == 2
    zeek = flow_stream(spark, "zeek", src, canonical=True)
    assert zeek.dtypes == flow_stream(spark, "cicflowmeter", src, canonical=True).dtypes


def test_rotated_names():
    names = {"/d/conn.log": "conn", "/d/conn.2024-01-01-00-00-00.log": "conn", "/d/dns.10:00:00-11:00:00.log.gz": "dns",
             "/d/http.log/part-0.txt": "http", "/d/conn.txt": None}
    for name, kind in names.items():
        found = re.search(LOG_NAME_RE, name)
        assert (found and found.group(1)) == kind


def test_unknown_source_type(spark):
    with pytest.raises(ValueError):
        flow_stream(spark, "pcap", "/nowhere")


def test_uploaded_csv_and_export(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "up.csv")
    with open(path, "w") as fh:
        fh.write("a,b\n1,x\n2, y \n")
    df = load_csv(spark, path)
    assert dict(df.dtypes)["a"] == "int"
    out = os.path.join(tmpdir_path, "export")
    sinks.export_csv(df, out)
    back = spark.read.option("header", True).csv(out).orderBy("a").collect()
    assert [r.b for r in back] == ["x", " y "]
