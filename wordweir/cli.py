"""``python -m wordweir FILE FOLDER``: prints the first word of FILE that does not repeat, if there is one.

The profile is built segment by segment in FOLDER; the same command over an interrupted run goes on where it was.
"""

from __future__ import annotations

import argparse
import errno
import os
import re
import sys
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from .functions.scalars import SizeError, parse_size
from .operators import profile as P
from .sources.files import FileError, regular
from .sources.raw import raw_counts
from .sources.store import Run, RunError

#: Least sizes (fixed values).
LEAST_MEMORY, LEAST_SYNC = 4096, 512 << 20
USAGE = 255


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{self.prog}: {message}\n")

    def print_help(self, file=None) -> None:  # noqa: ANN001
        super().print_help(file or sys.stderr)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = Parser(prog="wordweir", description=__doc__.splitlines()[0])
    p.add_argument("file", help="a regular file of any bytes")
    p.add_argument("folder", help="folder of the run; any file system that Spark writes")
    p.add_argument("-m", "--memory-size", default="1g", help="bytes of input in a segment, as 4096, 64k, 1g (default 1g)")
    p.add_argument("-d", "--sync-distance", default="2g", help="most bytes of input between two commits; 0: no such bound (default 2g)")
    p.add_argument("-p", "--page-pinned", action="store_true", help="accepted; memory is Spark's to manage")
    p.add_argument("--profile-only", action="store_true", help="stop once all segments are profiled")
    p.add_argument("--merge-only", action="store_true", help="stop once the segments are merged")
    p.add_argument("--keep-segments", action="store_true", help="keep the segments' profiles after the merge")
    p.add_argument("-n", "--first", type=int, default=1, help="print so many words, each on a line (default 1)")
    found = p.parse_args(argv)
    try:
        found.memory_size, found.sync_distance = parse_size(found.memory_size), parse_size(found.sync_distance)
    except SizeError as e:
        p.error(str(e))
    if found.memory_size < LEAST_MEMORY:
        p.error(f"the memory size is at least {LEAST_MEMORY} bytes")
    if 0 < found.sync_distance < LEAST_SYNC:
        p.error(f"the sync distance is 0 or at least {LEAST_SYNC} bytes")
    if found.first < 1:
        p.error("at least one word is asked for")
    return found


def reason(e: Exception) -> tuple[int, str]:
    """Error number and text of what Spark says went wrong with a file."""
    text = str(e.java_exception) if isinstance(e, Py4JJavaError) else str(e)
    known = ((errno.EACCES, "ermission denied|AccessControl"), (errno.ENOSPC, "No space left"), (errno.ENOENT, "No such file|FileNotFound|does not exist"))
    code = next((n for n, pattern in known if re.search(pattern, text)), errno.EIO)
    return code, os.strerror(code)


def main(argv: Sequence[str] | None = None, spark=None) -> int:  # noqa: ANN001
    found = arguments(argv)
    role, path = "input", found.file
    try:
        at = regular(found.file)
        if spark is None:
            from .session import session

            spark = session()
        source = found.file if "://" in found.file else os.path.abspath(found.file)
        step = min(found.memory_size, found.sync_distance or found.memory_size)
        role, path = "run", found.folder
        run = Run(spark, found.folder, f"{source} {at.size} {at.mtime_ns} by {step}")
        n = max(1, -(-at.size // step))
        if not run.merged:
            n = run.profile_segments(lambda a, b: raw_counts(spark, source, step, start=a, end=b), at.size, step)
        if found.profile_only:
            return 0
        merged = run.merge(n, found.keep_segments)
        if found.merge_only:
            return 0
        for row in P.first_words(merged, found.first).collect():
            sys.stdout.buffer.write(bytes(row["word"]) + b"\n")
        sys.stdout.flush()
        return 0
    except FileError as e:
        print(f"Error: {e.filename} ({role}): {e.strerror}", file=sys.stderr)
        return -e.errno & 0xFF
    except RunError as e:
        print(f"Error: {e}", file=sys.stderr)
        return -errno.EIO & 0xFF
    except (OSError, Py4JJavaError, PySparkException) as e:
        code, text = (e.errno, e.strerror) if isinstance(e, OSError) and e.errno else reason(e)
        print(f"Error: {path} ({role}): {text}", file=sys.stderr)
        return -code & 0xFF
