"""Audio by external tools: duration, normalisation and clips, as table functions over binaryFile rows.

The tools run on the executors, in a folder of the task's own; bytes come from and go back into the table, so that no path has
to be shared.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.profiles import InputError

#: Fixed arguments and limits: mono at 16 kHz, even loudness, the shortest audio, and where the tool's banner names a duration.
MONO_16K = ("-vn", "-ac", "1", "-ar", "16000")
EVEN = ("-af", "loudnorm")
LEAST_SECONDS = 0.5
BANNER = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"


class DependencyError(RuntimeError):
    """An external tool that is not installed."""


class Tool:
    """One external program: where it is, and what it says when it runs."""

    def __init__(self, name: str):
        self.name = name

    def path(self) -> str | None:
        if found := shutil.which(self.name):
            return found
        try:  # a packaged copy, where there is one
            import imageio_ffmpeg
        except ImportError:
            return None
        return imageio_ffmpeg.get_ffmpeg_exe() if self.name == "ffmpeg" else None

    def command(self, *args: str) -> list[str]:
        if (path := self.path()) is None:
            raise DependencyError(f"{self.name} is not installed")
        return [path, *args]

    def said(self, *args: str, must: bool = False) -> str:
        """Everything that the program writes; with ``must`` a failure is an error."""
        done = subprocess.run(self.command(*args), stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, check=False)
        if must and done.returncode:
            raise InputError(done.stdout.strip()[-500:])
        return done.stdout


FFMPEG, FFPROBE = Tool("ffmpeg"), Tool("ffprobe")


def banner_seconds(text: Column) -> Column:
    """The duration that the tool's banner names; null if it names none."""
    part = [F.regexp_extract(text, BANNER, i).try_cast("double") for i in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]


def clip_command(source: str, target: str, start: float, end: float) -> list[str]:
    """The command that cuts [start, end) seconds out of a file."""
    if end <= start:
        raise InputError("the clip is empty")
    window = ("-ss", f"{max(0.0, start):.3f}", "-i", source, "-t", f"{max(0.1, end - start):.3f}")
    return FFMPEG.command("-y", *window, *MONO_16K, target)


def clip(source: str, target: str, start: float, end: float) -> str:
    """Cut [start, end) seconds of ``source`` into the file ``target``."""
    FFMPEG.said(*clip_command(source, target, start, end)[1:], must=True)
    return target


def seconds_of(path: str) -> float:
    """Seconds of an audio file: what the probe answers, else what the banner names."""
    answer = FFPROBE.said("-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path).strip() if FFPROBE.path() else ""
    if re.fullmatch(r"\d+(\.\d+)?", answer):
        found = float(answer)
    else:
        parts = re.search(BANNER, FFMPEG.said("-hide_banner", "-i", path))
        found = sum(float(x) * each for x, each in zip(parts.groups(), (3600, 60, 1), strict=True)) if parts else 0.0
    if found <= 0:
        raise InputError("the audio has no duration")
    return found


def _one_normalised(content: bytes | None) -> tuple[bytes | None, float | None, str | None]:
    """(wav, seconds, error) of one file's bytes."""
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, "in"), Path(folder, "out.wav")
        try:
            source.write_bytes(content or b"")
            seconds = seconds_of(str(source))
            if seconds < LEAST_SECONDS:
                raise InputError("the audio is too short")
            FFMPEG.said("-y", "-i", str(source), *MONO_16K, *EVEN, str(target), must=True)
            return target.read_bytes(), seconds, None
        except (InputError, DependencyError, OSError) as error:  # kept in the row
            return None, None, f"{type(error).__name__}: {error}"


def normalised(audio: DataFrame) -> DataFrame:
    """path, wav (16 kHz, mono, even loudness), duration and error of binaryFile rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):  # one file at a time is held
                wav, seconds, error = _one_normalised(batch.column("content")[r].as_py())
                values = (batch.column("path").slice(r, 1), pa.array([wav], pa.binary()), pa.array([seconds], pa.float64()), pa.array([error], pa.string()))
                yield pa.RecordBatch.from_arrays(values, names=["path", "wav", "duration", "error"])

    return audio.select("path", "content").mapInArrow(run, "path string, wav binary, duration double, error string")
