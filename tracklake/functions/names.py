"""Names of videos, clips, frames and individuals; times on a clock and in a video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def frame_number(filename: Column | str) -> Column:
    """The number after the last underscore and before the next point: frame_00000011.png is 11."""
    return F.substring_index(F.substring_index(col(filename), "_", -1), ".", 1).try_cast("int")


def video_name(filename: Column | str) -> Column:
    return F.substring_index(base_name(filename), "-Loop", 1)


def clip_file(filename: Column | str) -> Column:
    """04.09.2023-01-Right-Loop05_tracks.csv is of the clip 04.09.2023-01-Right-Loop05.mp4."""
    stem = F.regexp_replace(base_name(filename), r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, "_tracks$", ""), F.lit(".mp4"))


def clip_id(clip_filename: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(col(clip_filename), "-", -1), r"\.[^.]*$", "")


def clock_seconds(clock: Column | str) -> Column:
    """Seconds since midnight of HH:MM:SS."""
    part = F.split(col(clock), ":")
    return part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")


def frame_at(clock: Column | str, start: Column | str, fps: Column | float) -> Column:
    """The frame shown at a time of day; the fraction is cut off."""
    return ((clock_seconds(clock) - clock_seconds(start)) * (fps if isinstance(fps, Column) else F.lit(float(fps)))).cast("int")


def individual_label(number: Column | str, width: Column | int) -> Column:
    return F.concat(F.lit("id_"), F.lpad(col(number).cast("string"), width, "0"))


def clip_length(first: Column | str, last: Column | str) -> Column:
    return col(last) - col(first) + 1


def pts_window(first_pts: Column | str, last_pts: Column | str, fps: Column | str, fraction: float = 0.5) -> tuple[Column, Column]:
    """Times from which (inclusive) and to which (exclusive) a clip's frames are cut: a fraction of a frame around its ends."""
    margin = F.lit(fraction) / col(fps)
    return col(first_pts) - margin, col(last_pts) + margin


def frames_to_minutes(frames: Column | str, fps: Column | float) -> Column:
    return col(frames) / (fps if isinstance(fps, Column) else F.lit(float(fps))) / 60


def rate(fraction: Column | str) -> Column:
    """Frames a second of a fraction such as 60000/1001."""
    part = F.split(col(fraction), "/")
    return part[0].cast("double") / F.coalesce(F.try_element_at(part, F.lit(2)).cast("double"), F.lit(1.0))


def timecode_frames(timecode: Column | str, fraction: Column | str) -> Column:
    """Frames from 00:00:00:00 of HH:MM:SS:FF. At 29.97 and 59.94 a second two (four) frame numbers are skipped each minute but the tenth."""
    part = F.split(F.translate(col(timecode), ";.", "::"), ":")
    h, m, s, f = (part[i].cast("long") for i in range(4))
    exact = rate(fraction)
    nominal = F.round(exact).cast("long")
    minutes = h * 60 + m
    drop = F.when(F.abs(exact - nominal * 1000 / 1001) < 0.001, F.when(nominal % 30 == 0, (nominal / 15).cast("long")).otherwise(0)).otherwise(0)
    return (minutes * 60 + s) * nominal + f - drop * (minutes - F.floor(minutes / 10))


def timecode_end(start_frames: Column | str, n_frames: Column | str) -> Column:
    return col(start_frames) + col(n_frames) - 1


def instant_name(prefix: str = "") -> Column:
    """A name of the present time, for runs and folders."""
    return F.concat(F.lit(prefix), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
