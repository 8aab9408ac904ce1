"""What a scan looks at and how sure each rule is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -------------------------------------------------------------------------------

#: Rules, strongest first: name, confidence in percent, whether it works by closeness.
METHODS = [
    ("exact", 100, False),
    ("audio", 98, False),
    ("tag", 92, False),
    ("feat", 90, False),
    ("title", 72, False),
    ("name", 70, False),
    ("duration", 58, True),
    ("size", 40, True),
]

AUDIO = [".mp3", ".flac", ".m4a", ".mp4a", ".aac", ".ogg", ".oga", ".opus", ".wav", ".wma", ".alac", ".aiff", ".aif", ".ape", ".wv", ".mpc", ".m4b", ".mka", ".dsf", ".tta"]
VIDEO = [".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".m4v", ".mpg", ".mpeg", ".webm"]
IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".heic", ".raw", ".cr2", ".nef"]

#: Folders of the system, skipped wherever they stand below a root.
SYSTEM_FOLDERS = ["$recycle.bin", "system volume information", "windows", "winsxs", "program files", "program files (x86)", "programdata", "appdata", "node_modules", ".git", ".svn", "__pycache__", "$windows.~bt", "recovery", "perflogs"]

#: Parts of folder names that speak against keeping a file.
PASSING_FOLDERS = ["\\downloads", "\\temp", "\\tmp", "\\new folder", "\\telegram desktop", "\\دانلود", "\\بارگیری"]

FEAT_BUCKET, FEAT_SECONDS = 60, 2.5
DURATION_LEAST, DURATION_WINDOW, DURATION_SIZES = 20.0, 1.5, 0.25
SURE, TRUSTED, MOST_GROUPS = 95, 70, 4000

# -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScanConfig:
    """Options of a scan.

    The title rule runs with the tag rule, whatever ``use_title`` says, and ``use_feat`` needs ``use_tags``.
    """

    roots: tuple[str, ...] = ()
    recursive: bool = True
    mode: str = "audio"
    extensions: tuple[str, ...] = ()
    min_size: int = 65536
    size_tolerance: float = 2.0
    skip_hidden: bool = True
    fold_case: bool = False
    use_exact: bool = True
    use_audio: bool = True
    use_tags: bool = True
    use_feat: bool = True
    use_title: bool = True
    use_name: bool = True
    use_duration: bool = True
    use_size: bool = True
    include_untagged: bool = False
    unicode: bool = True
    #: Partitions that files are dealt to before their keys are computed; None leaves those of a catalogue in many splits.
    key_partitions: int | None = None
    #: The guest-credit rule leaves out titles of more files than this (FEAT_BUCKET in the reference); None leaves out none.
    feat_bucket: int | None = None

    def __post_init__(self):
        if self.mode not in ("audio", "all", "custom"):
            raise ValueError(f"no such mode: {self.mode}")
        if self.min_size < 0 or self.size_tolerance < 0:
            raise ValueError("sizes and tolerances are not negative")
        if not any((self.use_exact, self.use_audio, self.use_tags, self.use_name, self.use_duration, self.use_size)):
            raise ValueError("at least one rule must be on")


def methods(spark: SparkSession) -> DataFrame:
    """(method, stage, confidence, fuzzy): eight rows."""
    return spark.createDataFrame([(m, k + 1, c, f) for k, (m, c, f) in enumerate(METHODS)], "method string, stage int, confidence int, fuzzy boolean")
