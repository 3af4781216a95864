"""Registered queries: CSV round trips (dataset CSV with sniffing, exporter CSV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.session import work_dir
from flowsieve.sources.csv_flows import load_flow_csv, read_exporter_csv
from flowsieve.sources.tables import flow_view

DATASET_HEADERS = [
    ("flow_seq", "Flow Seq"), ("src_ip", "Source IP"), ("src_port", "Source Port"),
    ("dst_port", "Destination Port"), ("protocol", "Protocol"), ("flow_duration", "Flow Duration"),
    ("total_fwd_packets", "Total Fwd Packets"), ("total_backward_packets", "Total Backward Packets"),
    ("total_length_fwd_packets", "Total Length of Fwd Packets"),
    ("total_length_bwd_packets", "Total Length of Bwd Packets"),
    ("flow_iat_mean", "Flow IAT Mean"), ("flow_iat_std", "Flow IAT Std"),
    ("fwd_psh_flags", "Fwd PSH Flags"), ("label", " Label"),
]


def write_dataset_csv(spark, sf_dir) -> str:
    path = work_dir(spark, "dataset-csv")
    fl = flow_view(spark, sf_dir)
    (fl.select(*[F.col(c).alias(h) for c, h in DATASET_HEADERS])
     .write.option("header", True).option("sep", ";")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .mode("overwrite").csv(path))
    return path


def q_csv_sniff(spark, sf_dir):
    df = load_flow_csv(spark, write_dataset_csv(spark, sf_dir))
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rate(num, den):
    """The quotient as an exporter writes it: infinite or NaN where the divisor is 0."""
    none = F.when(num == 0, F.lit(float("nan"))).otherwise(F.signum(num.cast("double")) * F.lit(float("inf")))
    return F.when(den == 0, none).otherwise(F.try_divide(num, den))


def exporter_frame(spark, sf_dir):
    """The flow view in flow-exporter column names, some cells empty."""
    return exporter_rows(flow_view(spark, sf_dir))


def exporter_rows(fl):
    q = F.col("flow_seq")
    fwd, bwd = F.col("total_fwd_packets"), F.col("total_backward_packets")
    fwd_len, bwd_len = F.col("total_length_fwd_packets"), F.col("total_length_bwd_packets")
    dur = F.col("flow_duration")
    mean = F.when(fwd > 0, fwd_len / fwd).otherwise(F.lit(0.0))
    return fl.select(
        F.date_format("flow_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.when(q % 29 == 0, F.lit(None)).otherwise(F.col("src_ip")).alias("Src IP"),
        F.col("src_port").alias("Src Port"), F.col("dst_ip").alias("Dst IP"),
        F.when(q % 31 == 0, F.lit(None)).otherwise(F.col("dst_port")).alias("Dst Port"),
        F.col("protocol").alias("Protocol"), dur.alias("Flow Duration"),
        fwd.alias("Total Fwd Packets"), bwd.alias("Total Backward Packets"),
        fwd_len.alias("Total Length of Fwd Packets"), bwd_len.alias("Total Length of Bwd Packets"),
        (mean * 1.5).alias("Fwd Packet Length Max"), (mean * 0.5).alias("Fwd Packet Length Min"),
        mean.alias("Fwd Packet Length Mean"),
        F.when(q % 17 == 0, F.lit("NaN")).otherwise(_rate((fwd_len + bwd_len) * 1000000.0, dur).cast("string"))
        .alias("Flow Bytes/s"),
        _rate((fwd + bwd) * 1000000.0, dur).alias("Flow Packets/s"),
        F.col("flow_iat_mean").alias("Flow IAT Mean"),
        F.when(q % 13 == 0, F.lit(None)).otherwise(F.col("flow_iat_std")).alias("Flow IAT Std"),
        q.alias("Flow Seq"))


def q_cic_csv_flows(spark, sf_dir):
    path = work_dir(spark, "exporter-csv")
    exporter_frame(spark, sf_dir).write.option("header", True).mode("overwrite").csv(path)
    df = read_exporter_csv(spark, path)
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
