"""Small files of shared folders, read and replaced whole from the driver or a task."""

from __future__ import annotations


def located(path: str):
    """(file system, path inside it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read_text(path: str) -> str | None:
    """The file's text; None where there is none."""
    system, inner = located(path)
    try:
        with system.open_input_stream(inner, compression=None) as stream:
            return stream.read().decode()
    except FileNotFoundError:
        return None


def replace_text(path: str, text: str) -> None:
    """Beside the place first, then moved there: a reader sees the old text or the new one, never a part."""
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(f"{inner}.new", compression=None) as out:
        out.write(text.encode())
    system.move(f"{inner}.new", inner)
