"""Master files: parsing of the JSON and of the older text form, names of data files, scan parameters."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from photonspark.functions.decode import UNITS
from photonspark.sources.files import read_bytes

CTB = ("ChipTestBoard", "Xilinx_ChipTestBoard", "XilinxChipTestBoard")


@dataclass(frozen=True)
class FileName:
    """``<base>_master_<index>.json|raw``."""

    folder: str
    base: str
    index: int
    ext: str
    old_scheme: bool = False

    @classmethod
    def parse(cls, path: str) -> FileName:
        folder, _, name = path.rpartition("/")
        m = re.fullmatch(r"(.+)_master_(\d+)(\.json|\.raw)", name)
        if not m:
            raise ValueError(f"not the name of a master file: {name}")
        return cls(folder, m[1], int(m[2]), m[3])

    def data(self, module: int, file: int) -> str:
        number = f"{file:012d}" if self.old_scheme else str(file)
        return str(PurePosixPath(self.folder) / f"{self.base}_d{module}_f{number}_{self.index}.raw") if "://" not in self.folder else f"{self.folder}/{self.base}_d{module}_f{number}_{self.index}.raw"


def duration_ns(text: str | None) -> int | None:
    if text is None:
        return None
    m = re.fullmatch(r"\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2] not in (*UNITS, ""):
        raise ValueError(f"not a duration: {text}")
    return round(float(m[1]) * UNITS[m[2] or "s"])


@dataclass(frozen=True)
class Scan:
    enabled: bool = False
    dac: str = ""
    start: int = 0
    stop: int = 0
    step: int = 0
    settle_ns: int = 0

    @classmethod
    def parse(cls, text: str, inclusive: bool = False) -> Scan:
        """``inclusive``: old versions name the last point, which then belongs to the scan."""
        if "enabled" not in text:
            return cls()
        found = dict(re.findall(r"^(dac|start|stop|step|settleTime) +(.+?)\s*$", text, re.MULTILINE))
        start, stop, step = (int(found[k]) for k in ("start", "stop", "step"))
        return cls(True, found.get("dac", ""), start, stop + inclusive, step, duration_ns(found.get("settleTime", "0ns")))

    def __iter__(self):
        return iter(range(self.start, self.stop, self.step))


@dataclass(frozen=True)
class Master:
    version: str
    detector_type: str
    timing_mode: str
    geometry_row: int
    geometry_col: int
    image_size_bytes: int
    frames_in_file: int
    total_frames_expected: int
    pixels_x: int
    pixels_y: int
    bitdepth: int
    max_frames_per_file: int
    frame_padding: int
    discard_policy: str
    exptime_ns: int | None = None
    period_ns: int | None = None
    quad: int = 0
    udp_row: int = 1
    udp_col: int = 1
    analog_samples: int | None = None
    digital_samples: int | None = None
    transceiver_samples: int | None = None
    number_of_rows: int | None = None
    counter_mask: int | None = None
    reading_mode: str = "UNKNOWN"
    rois: tuple[tuple[int, int, int, int], ...] = ()
    scan: Scan = field(default_factory=Scan)


def _version(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", str(text))[:3])


def reading_mode(detector: str, analog: bool, digital: bool, transceiver: bool) -> str:
    """Which streams a chip test board read out; other detectors have none."""
    if detector not in CTB:
        return "UNKNOWN"
    return {(True, False, False): "ANALOG_ONLY", (False, True, False): "DIGITAL_ONLY", (True, True, False): "ANALOG_AND_DIGITAL", (False, False, True): "TRANSCEIVER_ONLY", (False, True, True): "DIGITAL_AND_TRANSCEIVER"}.get((analog, digital, transceiver), "UNKNOWN")


def _number(text) -> int:
    return int(str(text), 0) if not isinstance(text, int) else text


def parse_json(text: str) -> Master:
    j = json.loads(text)
    get = lambda *keys, default=None: next((j[k] for k in keys if k in j), default)
    flag = lambda name, samples: get(samples) if get(name, default=0) else None
    version, detector = str(get("Version")), get("Detector Type")
    rois = [r for r in (get("Receiver Rois") or [get("Receiver Roi")]) if r and r["xmin"] != 4294967295]
    rois = [(r["xmin"], r["xmax"] + 1, r.get("ymin", 0), r.get("ymax", 0) + 1) for r in rois]
    scan = get("Scan Parameters", default="[disabled]")
    if isinstance(scan, dict):
        scan = Scan(bool(scan["enable"]), str(scan.get("dacInd", "")), scan.get("start offset", 0), scan.get("stop offset", 0), scan.get("step size", 0), scan.get("dac settle time ns", 0)) if scan.get("enable") else Scan()
    else:
        scan = Scan.parse(scan, inclusive=_version(version) < (7, 21))
    bits = get("Dynamic Range", default=16)
    udp = get("Number of UDP Interfaces", default=1)
    return Master(
        version=version,
        detector_type=detector,
        timing_mode=get("Timing Mode"),
        geometry_row=j["Geometry"]["y"],
        geometry_col=j["Geometry"]["x"],
        image_size_bytes=get("Image Size in bytes", "Image Size"),
        frames_in_file=get("Frames in File"),
        total_frames_expected=get("Total Frames"),
        pixels_x=get("Pixels", default={"x": 0})["x"],
        pixels_y=get("Pixels", default={"y": 0})["y"],
        bitdepth=bits,
        max_frames_per_file=get("Max Frames Per File"),
        frame_padding=get("Frame Padding", default=0),
        discard_policy=get("Frame Discard Policy", default=""),
        exptime_ns=duration_ns(get("Exptime", "Exposure Time")) if isinstance(get("Exptime", "Exposure Time"), str) else None,
        period_ns=duration_ns(get("Period", "Acquisition Period")) if isinstance(get("Period", "Acquisition Period"), str) else None,
        quad=get("Quad", default=0),
        udp_row=udp if detector in ("Jungfrau", "Moench") else 1,
        udp_col=2 if detector == "Eiger" else 1,
        analog_samples=flag("Analog Flag", "Analog Samples"),
        digital_samples=flag("Digital Flag", "Digital Samples"),
        transceiver_samples=flag("Transceiver Flag", "Transceiver Samples"),
        number_of_rows=get("Number of rows"),
        counter_mask=None if get("Counter Mask") is None else _number(get("Counter Mask")),
        reading_mode=reading_mode(detector, bool(get("Analog Flag")), bool(get("Digital Flag")), bool(get("Transceiver Flag"))),
        rois=tuple(rois),
        scan=scan,
    )


def parse_text(text: str) -> Master:
    """``key : value`` lines up to the frame header's description."""
    found: dict[str, str] = {}
    for line in text.split("#Frame Header")[0].splitlines():
        key, colon, value = line.partition(":")
        if colon:
            found[key.strip()] = value.strip()
    pair = lambda name: tuple(map(int, re.findall(r"\d+", found.get(name, ""))[:2])) or (0, 0)
    whole = lambda *names, default=0: next((int(re.findall(r"-?\d+", found[n])[0]) for n in names if n in found), default)
    flags = [bool(whole(f"{k} Flag")) for k in ("Analog", "Digital", "Transceiver")]
    px, geometry, detector = pair("Pixels"), pair("Geometry"), found.get("Detector Type", "")
    return Master(
        version=found.get("Version", ""),
        detector_type=detector,
        timing_mode=found.get("Timing Mode", ""),
        geometry_row=geometry[1] or whole("row", default=0),
        geometry_col=geometry[0] or whole("col", default=0),
        image_size_bytes=whole("Image Size"),
        frames_in_file=whole("Frames in File"),
        total_frames_expected=whole("Total Frames"),
        pixels_x=px[0],
        pixels_y=px[1],
        bitdepth=whole("Dynamic Range", default=16),
        max_frames_per_file=whole("Max Frames Per File", "Max. Frames Per File"),
        frame_padding=whole("Frame Padding"),
        discard_policy=found.get("Frame Discard Policy", ""),
        exptime_ns=duration_ns(found.get("Exptime")),
        period_ns=duration_ns(found.get("Period")),
        quad=whole("Quad"),
        analog_samples=whole("Analog Samples") if flags[0] else None,
        digital_samples=whole("Digital Samples") if flags[1] else None,
        transceiver_samples=whole("Transceiver Samples") if flags[2] else None,
        reading_mode=reading_mode(detector, *flags),
        scan=Scan.parse(found.get("Scan Parameters", "[disabled]")),
    )


def read_master(path: str) -> Master:
    text = read_bytes(path).decode()
    return parse_json(text) if path.endswith(".json") else parse_text(text)


SCHEMA = (
    "version string, detector_type string, timing_mode string, geometry_row int, geometry_col int, image_size_bytes long, frames_in_file long, total_frames_expected long, "
    "pixels_x int, pixels_y int, bitdepth int, max_frames_per_file long, frame_padding int, discard_policy string, exptime_ns long, period_ns long, quad int, udp_row int, udp_col int, "
    "analog_samples int, digital_samples int, transceiver_samples int, number_of_rows int, counter_mask long, reading_mode string, "
    "rois array<struct<xmin: long, xmax: long, ymin: long, ymax: long>>, scan struct<enabled: boolean, dac: string, start: int, stop: int, step: int, settle_ns: long>"
)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The master file as one row."""
    row = asdict(read_master(path))
    row["scan"] = tuple(row["scan"].values())
    return spark.createDataFrame([tuple(row.values())], SCHEMA)
