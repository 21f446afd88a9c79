"""Feed files as a Spark data source, in batch and as a stream that goes on where it stopped.

    register(spark)
    spark.read.format("feed_files").load(path)
    spark.readStream.format("feed_files").load(path)

A partition is a file, read by the executor that gets it.  The stream's progress is the time of the last file taken, and the names of
those of that very time: a file that comes later but says it was changed before counts as seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

ITEMS = "title string, link string, published timestamp, file string"


def register(spark: SparkSession) -> None:
    """Make the format "feed_files" known to a session.  Options: path, a folder with RSS files, subfolders included; suffix, of their names (.xml).

    Items without a link are left out; so are files that aren't XML.  published is null where a date can't be read.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    class File(InputPartition):
        def __init__(self, path: str, size: int) -> None:
            self.path, self.size = path, size

    def listed(path: str, suffix: str) -> list[tuple[int, str, int]]:
        """(time, name, bytes) of the files, in that order."""
        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        infos = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns, f.path, f.size) for f in infos if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))

    def items(where: str, part: File | None) -> Iterator[tuple]:
        import xml.etree.ElementTree as ET
        from datetime import timezone
        from email.utils import parsedate_to_datetime

        import pyarrow.fs as pafs

        if part is None:  # what Spark reads where there are no partitions
            return
        fs, _ = pafs.FileSystem.from_uri(where if ":" in where else f"file://{where}")
        out = []
        with fs.open_input_stream(part.path) as f:
            try:
                for _, e in ET.iterparse(f):
                    if e.tag != "item":
                        continue
                    title, link, date = (e.findtext(x) for x in ("title", "link", "pubDate"))
                    e.clear()
                    if not link or not link.strip():
                        continue
                    try:
                        at = parsedate_to_datetime(date).astimezone(timezone.utc) if date else None
                    except (TypeError, ValueError):
                        at = None
                    out.append((title, link.strip(), at, part.path))
            except ET.ParseError:
                return  # a file is taken whole or not at all
        yield from out

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.suffix = options["path"], options.get("suffix", ".xml")

        def partitions(self) -> list[File]:
            return [File(p, n) for _, p, n in listed(self.path, self.suffix)]

        def read(self, partition: File) -> Iterator[tuple]:
            return items(self.path, partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.path, self.suffix = options["path"], options.get("suffix", ".xml")

        def initialOffset(self) -> dict:
            return {"at": "0", "names": ""}

        def latestOffset(self) -> dict:
            files = listed(self.path, self.suffix)
            last = files[-1][0] if files else 0
            return {"at": str(last), "names": "\n".join(p for t, p, _ in files if t == last)}

        def partitions(self, start: dict, end: dict) -> list[File]:
            a, b, seen = int(start["at"]), int(end["at"]), set(start["names"].split("\n"))
            last = set(end["names"].split("\n"))
            return [File(p, n) for t, p, n in listed(self.path, self.suffix) if (t > a or t == a and p not in seen) and (t < b or t == b and p in last)]

        def read(self, partition: File) -> Iterator[tuple]:
            return items(self.path, partition)

        def commit(self, end: dict) -> None:
            pass

    class FeedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "feed_files"

        def schema(self) -> str:
            return ITEMS

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options)

    spark.dataSource.register(FeedFiles)
