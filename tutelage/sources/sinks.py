"""What the library writes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object per line, foldered by module."""
    chunks.write.mode("overwrite").partitionBy("module").json(path)


def write_flashcards(cards: DataFrame, path: str) -> None:
    """Tab-separated cards.  Fields hold no tabs or line breaks, so nothing is quoted."""
    cards.select("id", "front", "back", "lesson", "tags").toDF(
        "ID", "Front", "Back", "Lesson", "Tags").write.mode("overwrite").csv(
        path, sep="\t", header=True, quote="", escape="\\",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def write_files(rows: DataFrame, root: str) -> None:
    """One file per row (``path`` below ``root``, ``content`` text).

    Each task writes its own rows; writing a file again replaces it, so a retried
    task leaves the same result.
    """
    def write(batch):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for row in batch:
            folder, _, name = f"{base}/{row.path}".rpartition("/")
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(row.content.encode())

    rows.select("path", "content").foreachPartition(write)
