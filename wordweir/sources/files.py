"""Files by their address, opened by tasks and the driver alike: mounted paths, and what else pyarrow opens (HDFS, S3, GCS)."""

from __future__ import annotations

import errno
import os

from pyarrow import fs


class FileError(OSError):
    """A path that cannot be read as one file."""


def store(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address as Spark writes it."""
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        address = "/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        address = f"s3:{rest}"
    elif not rest.startswith("//"):
        address = os.path.abspath(address)
    return fs.FileSystem.from_uri(address)


def regular(address: str) -> fs.FileInfo:
    """What is known of a regular file; a folder, a special file or one that cannot be read is refused."""

    def refuse(code: int) -> FileError:
        return FileError(code, os.strerror(code), address)

    try:
        system, path = store(address)
        found = system.get_file_info(path)
        kinds = {fs.FileType.NotFound: errno.ENOENT, fs.FileType.Directory: errno.EISDIR, fs.FileType.Unknown: errno.EIO}
        if found.type in kinds:
            raise refuse(kinds[found.type])
        with system.open_input_file(path) as f:
            f.read(1)
    except FileError:
        raise
    except OSError as e:
        raise refuse(e.errno or errno.EIO) from e
    return found
