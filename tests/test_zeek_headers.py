"""Typed sensor records by their ``#fields`` lines."""

import os

import pytest

from flowsieve.sources import zeek

NAMES = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_pkts", "resp_pkts",
         "orig_bytes", "resp_bytes", "conn_state", "local_orig"]


def record(i):
    return [f"{1700000000 + i}.5", f"C{i}", f"10.0.0.{i % 250}", str(1000 + i), "10.1.1.1", "443", "tcp", "ssl", "1.5", str(i), str(2 * i),
            str(10 * i), str(20 * i), "SF", "T"]


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.write("\n".join(lines) + "\n")


def flows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("split_bytes", ["134217728", "500"])
def test_headers_that_change_inside_a_file(spark, tmpdir_path, split_bytes):
    """Also where the file is read in many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        turned = NAMES[5:] + NAMES[:5]
        lines = ["\t".join(record(0)), "#separator \\x09", "\t".join(["#fields", *NAMES])]  # one line before any header
        lines += ["\t".join(record(i)) for i in range(1, 30)]
        lines += ["\t".join(["#fields", *turned]), "#types\tx"] + ["\t".join(dict(zip(NAMES, record(i)))[n] for n in turned) for i in range(30, 60)]
        lines += ["\t".join(["#fields", *NAMES])] + ["\t".join(record(i)) for i in range(60, 70)] + ["\t".join(record(70)[:9]), "#close"]
        write(tmpdir_path + "/a", "conn.log", lines)
        write(tmpdir_path + "/a", "conn.2.log", ["\t".join(record(i)) for i in range(70, 80)])  # no header at all
        got = zeek.read_zeek_log(spark, tmpdir_path + "/a", "conn")
        plain = spark.createDataFrame([("\t".join(record(i)),) for i in range(80)], "value string")
        assert flows(got) == flows(zeek.parse_conn(plain))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_missing_and_further_fields(spark, tmpdir_path):
    names = ["extra", *[n for n in NAMES if n != "service"], "more"]
    rows = ["\t".join(["#fields", *names])] + ["\t".join(["x", *[v for n, v in zip(NAMES, record(i)) if n != "service"], "y"]) for i in range(3)]
    write(tmpdir_path + "/b", "conn.log", rows)
    got = zeek.read_zeek_log(spark, tmpdir_path + "/b", "conn").collect()
    assert sorted(r.total_fwd_packets for r in got) == [0, 1, 2] and {r.connection_state for r in got} == {"SF"}
    dns = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id", "query", "qtype_name", "rcode_name"]
    write(tmpdir_path + "/d", "dns.log", ["\t".join(["#fields", *dns]), "1700000000.1\tD\t10.0.0.1\t5353\t10.0.0.2\t53\tudp\t7\texample.org\tA\tNOERROR"])
    row = zeek.read_zeek_log(spark, tmpdir_path + "/d", "dns").first()
    assert (row.dns_query, row.dns_qtype, row.dns_rcode, row.dst_port) == ("example.org", "A", "NOERROR", 53)


def test_no_lines(spark, tmpdir_path):
    write(tmpdir_path + "/e", "conn.log", ["#fields\tts", ""])
    assert zeek.read_zeek_log(spark, tmpdir_path + "/e", "conn").count() == 0
