"""Column types of the tables. Nothing is inferred: readers pass these.

Unsigned fields take the next wider signed type; pair lists keep order and repeated keys, which maps
would not; times are milliseconds, whose whole range timestamps can't hold.
"""

from __future__ import annotations

from pyspark.sql import types as T

PAIRS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]), False
)

# A run info's fields in the format's order.
RUN_INFO = T.StructType(
    [
        T.StructField("acquisition_id", T.StringType()),
        T.StructField("acquisition_start_time_ms", T.LongType()),
        T.StructField("adc_max", T.ShortType()),
        T.StructField("adc_min", T.ShortType()),
        T.StructField("context_tags", PAIRS),
        T.StructField("experiment_name", T.StringType()),
        T.StructField("flow_cell_id", T.StringType()),
        T.StructField("flow_cell_product_code", T.StringType()),
        T.StructField("protocol_name", T.StringType()),
        T.StructField("protocol_run_id", T.StringType()),
        T.StructField("protocol_start_time_ms", T.LongType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("sequencing_kit", T.StringType()),
        T.StructField("sequencer_position", T.StringType()),
        T.StructField("sequencer_position_type", T.StringType()),
        T.StructField("software", T.StringType()),
        T.StructField("system_name", T.StringType()),
        T.StructField("system_type", T.StringType()),
        T.StructField("tracking_id", PAIRS),
    ]
)
RUN_INFO_TEXTS = tuple(f.name for f in RUN_INFO.fields if isinstance(f.dataType, T.StringType))
#: Bounds of integer fields, both included.
RUN_INFO_RANGES = {
    "acquisition_start_time_ms": (-(2**63), 2**63 - 1),
    "protocol_start_time_ms": (-(2**63), 2**63 - 1),
    "adc_min": (-(2**15), 2**15 - 1),
    "adc_max": (-(2**15), 2**15 - 1),
    "sample_rate": (0, 2**16 - 1),
}

# Names and widths of a read's fields.
READ_META = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("read_pos", T.LongType()),
        T.StructField("read_id", T.BinaryType()),
        T.StructField("num_samples", T.LongType()),
        T.StructField("read_number", T.LongType()),
        T.StructField("start_sample", T.LongType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("well", T.ShortType()),
        T.StructField("pore_type", T.StringType()),
        T.StructField("calibration_offset", T.FloatType()),
        T.StructField("calibration_scale", T.FloatType()),
        T.StructField("median_before", T.FloatType()),
        T.StructField("end_reason", T.StringType()),
        T.StructField("end_reason_forced", T.BooleanType()),
        T.StructField("acquisition_id", T.StringType()),
        T.StructField("num_minknow_events", T.LongType()),
        T.StructField("tracked_scaling_scale", T.FloatType()),
        T.StructField("tracked_scaling_shift", T.FloatType()),
        T.StructField("predicted_scaling_scale", T.FloatType()),
        T.StructField("predicted_scaling_shift", T.FloatType()),
        T.StructField("num_reads_since_mux_change", T.LongType()),
        T.StructField("time_since_mux_change", T.FloatType()),
        T.StructField("open_pore_level", T.FloatType()),
    ]
)
SIGNAL = T.StructField("signal", T.ArrayType(T.ShortType()))
READS = T.StructType([*READ_META.fields, SIGNAL])
CHUNKS = "read_pos long, seq int, start long, valid int"
TOKENS = "read_pos long, seq int, center float, scale float, codes array<int>"
CODEBOOK = "code int, vec array<float>"

#: How reads may end.
END_REASONS = (
    "unknown", "mux_change", "unblock_mux_change", "data_service_unblock_mux_change", "signal_positive",
    "signal_negative", "api_request", "device_data_error", "analysis_config_change", "paused",
)
