"""POD5 files, where the pod5 library is installed. Parquet in the READS schema is the tested interchange.

Nothing here could be run where this was written, as the library is not available there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sigtok.errors import SigtokError
from sigtok.schema import READ_META, READS, RUN_INFO

FORMAT = "sigtok-pod5"


def library() -> Any:
    try:
        import pod5
    except ImportError as e:
        raise SigtokError("the pod5 library is not installed", "read Parquet with the READS schema instead") from e
    return pod5


class Batch(InputPartition):
    """One record batch of a file."""

    def __init__(self, index: int, first: int) -> None:
        super().__init__(index)
        self.first = first


class Pod5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.with_signal = options.get("includesignal", "true").lower() != "false"

    def partitions(self) -> list[Batch]:
        with library().Reader(self.path) as reader:
            parts, first = [], 0
            for k in range(reader.batch_count):
                parts.append(Batch(k, first))
                first += reader.get_batch(k).num_reads
            return parts

    def read(self, partition: Batch) -> Iterator[tuple]:
        with library().Reader(self.path) as reader:
            for k, r in enumerate(reader.get_batch(partition.value).reads()):
                row = {
                    "file": self.path,
                    "read_pos": partition.first + k,
                    "read_id": r.read_id.bytes,
                    "num_samples": r.num_samples,
                    "read_number": r.read_number,
                    "start_sample": r.start_sample,
                    "channel": r.pore.channel,
                    "well": r.pore.well,
                    "pore_type": r.pore.pore_type,
                    "calibration_offset": r.calibration.offset,
                    "calibration_scale": r.calibration.scale,
                    "median_before": r.median_before,
                    "end_reason": r.end_reason.name,
                    "end_reason_forced": r.end_reason.forced,
                    "acquisition_id": r.run_info.acquisition_id,
                    "num_minknow_events": r.num_minknow_events,
                    "tracked_scaling_scale": r.tracked_scaling.scale,
                    "tracked_scaling_shift": r.tracked_scaling.shift,
                    "predicted_scaling_scale": r.predicted_scaling.scale,
                    "predicted_scaling_shift": r.predicted_scaling.shift,
                    "num_reads_since_mux_change": r.num_reads_since_mux_change,
                    "time_since_mux_change": r.time_since_mux_change,
                    "open_pore_level": getattr(r, "open_pore_level", float("nan")),
                    "signal": None,
                }
                missing = [n for n, v in row.items() if v is None and n != "signal"]
                if missing:
                    raise SigtokError(f"read {row['read_pos']} has no {missing[0]}")
                if self.with_signal:
                    signal = r.signal
                    if str(signal.dtype) != "int16" or len(signal) != row["num_samples"]:
                        raise SigtokError(f"read {row['read_pos']}: its signal doesn't fit its metadata")
                    row["signal"] = signal.tolist()
                yield tuple(row[n] for n in READS.names)


class Pod5Source(DataSource):
    """``spark.read.format("sigtok-pod5")``; options path, includeSignal."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return READS

    def reader(self, schema: T.StructType) -> Pod5Reader:
        return Pod5Reader({k.lower(): v for k, v in self.options.items()})


def read_pod5(spark: SparkSession, path: str, with_signal: bool = True) -> DataFrame:
    from sigtok.session import ship

    library()
    ship(spark).dataSource.register(Pod5Source)
    return spark.read.format(FORMAT).option("path", path).option("includeSignal", str(with_signal).lower()).load()


def run_infos(spark: SparkSession, path: str) -> DataFrame:
    """The run informations of a file; the first of each acquisition_id counts."""
    with library().Reader(path) as reader:
        rows, seen = [], set()
        for info in reader.run_info_table.read_pandas().itertuples():
            if info.acquisition_id not in seen:
                seen.add(info.acquisition_id)
                values = {}
                for n in RUN_INFO.names:
                    v = getattr(info, n.removesuffix("_ms"))
                    if n.endswith("_ms"):
                        v = int(v.value // 1_000_000)
                    elif n in ("context_tags", "tracking_id"):
                        v = [(str(k), str(x)) for k, x in v]
                    values[n] = v
                rows.append(tuple(values[n] for n in RUN_INFO.names))
    return spark.createDataFrame(rows, RUN_INFO)


def write_pod5(reads: DataFrame, run_info: DataFrame, path: str, force: bool = False) -> None:
    """Writes reads in read_pos order, streaming them through the driver: a POD5 file has one writer."""
    import uuid

    import numpy as np

    from sigtok.sources.output import check_target

    pod5 = library()
    target = check_target(path, force)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}.part")
    infos = {}
    for r in run_info.collect():
        d = r.asDict(recursive=True)
        for n in ("context_tags", "tracking_id"):
            d[n] = [(e["key"], e["value"]) for e in d[n]]
        infos[d["acquisition_id"]] = pod5.RunInfo(
            **{k.removesuffix("_ms"): v for k, v in d.items()}
        )
    try:
        with pod5.Writer(part) as writer:
            for r in reads.select(*READ_META.names, "signal").orderBy("read_pos").toLocalIterator(prefetchPartitions=True):
                writer.add_read(
                    pod5.Read(
                        read_id=uuid.UUID(bytes=bytes(r.read_id)),
                        pore=pod5.Pore(r.channel, r.well, r.pore_type),
                        calibration=pod5.Calibration(r.calibration_offset, r.calibration_scale),
                        median_before=r.median_before,
                        end_reason=pod5.EndReason(pod5.EndReasonEnum[r.end_reason.upper()], r.end_reason_forced),
                        read_number=r.read_number,
                        run_info=infos[r.acquisition_id],
                        start_sample=r.start_sample,
                        num_minknow_events=r.num_minknow_events,
                        tracked_scaling=pod5.ShiftScalePair(r.tracked_scaling_shift, r.tracked_scaling_scale),
                        predicted_scaling=pod5.ShiftScalePair(r.predicted_scaling_shift, r.predicted_scaling_scale),
                        num_reads_since_mux_change=r.num_reads_since_mux_change,
                        time_since_mux_change=r.time_since_mux_change,
                        signal=np.array(r.signal, dtype=np.int16),
                    )
                )
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
