"""Names, logs and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def pid_and_cam(name: Column) -> tuple[Column, Column]:
    """Person and camera of names like ``0001_c2s1_000151.jpg``: the first part is the person, the second begins ``c`` and a number.

    Without a camera part the camera is 0; a name without a numeric person gives -1 and -1.
    """
    parts = F.split(F.element_at(F.split(name, "/"), -1), "_")
    pid = F.regexp_extract(parts[0], r"^(-?\d+)", 1).try_cast("bigint")
    cam = F.coalesce(F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"^c(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(pid.isNull(), F.lit(-1)).otherwise(pid).cast("bigint"), F.when(pid.isNull(), F.lit(-1)).otherwise(cam).cast("bigint")


def id_and_camera(name: Column, anchored: bool = True) -> tuple[Column, Column]:
    """(id, camera) of ``<id>_c<camera>``; anywhere in the name, or at its beginning only."""
    pattern = ("^" if anchored else "") + r"(\d+)_c(\d+)"
    return _number(name, pattern, 1), _number(name, pattern, 2)


def id_and_camera_fallback(name: Column) -> tuple[Column, Column]:
    """Names ``dddd_dd_dddddd.jpg`` are id and camera; others as :func:`id_and_camera` with an underscore after the camera."""
    dated, plain = r"^(\d{4})_(\d{2})_\d{6}\.jpg$", r"^(\d+)_c(\d+)_"
    return F.coalesce(_number(name, dated, 1), _number(name, plain, 1)), F.coalesce(_number(name, dated, 2), _number(name, plain, 2))


def renamed(name: Column) -> Column:
    """``pid_cloth_cam_frame.png`` as ``pid_cam_fframe.jpg``; other names stay."""
    return F.regexp_replace(name, r"^(\d+)_(\d+)_(c?\d+)_(\d+)\.png$", "$1_$3_f$4.jpg")


def market_name(pid: Column, cam: Column, seq: Column, frame: Column) -> Column:
    return F.format_string("%04d_c%ds%d_%02d_00.jpg", pid, cam, seq, frame)


def percent(text: Column, label: str) -> Column:
    """The fraction behind ``label ... 12.3%`` in a log."""
    return F.regexp_extract(text, label + r"[^0-9\n]*([0-9]+(?:\.[0-9]+)?)%", 1).try_cast("double") / 100


def epoch_of(name: Column) -> Column:
    return _number(name, r"epoch_(\d+)", 1)


def step_of(name: Column) -> Column:
    return _number(name, r"step_(\d+)", 1)


def clean_attribute(text: Column) -> Column:
    """Without quotes, the first letter upper-case and the others lower-case."""
    bare = F.trim(F.regexp_replace(text, "\"", ""))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substr(bare, F.lit(2))))


def duration_seconds(text: Column) -> Column:
    """``h:mm:ss.ffffff`` in seconds."""
    p = F.split(text, ":")
    return p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")


def clock(date: Column, time: Column) -> Column:
    """Timestamp of ``M/d/yyyy`` and ``H:m:s`` texts, padded or not."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("M/d/yyyy H:m:s"))


def replace_setting(text: Column, key: str, value: str) -> Column:
    """A YAML text in which the line of ``key`` has another value."""
    return F.regexp_replace(text, rf"(?m)^(\s*{key}:).*$", f"$1 {value}")
