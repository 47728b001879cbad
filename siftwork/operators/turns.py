"""State of a loop, turn by turn: tables that count from the moment their turn is marked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from . import files


class Turns:
    """A folder with a folder of tables for each turn, and a marker for each whole turn, written last.

    A loop writes the tables of a turn, then marks it. A driver that is lost in between leaves no marker, so a new one
    starts from the newest whole turn and writes the lost turn's tables again. Tables are only ever added, so the state
    after a turn is the union of its table with those of all turns before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def newest(self) -> int:
        """The last of the whole turns, counted from the first without a gap; 0 if there is none."""
        whole = {int(n.removeprefix("turn-")) for n in files.names(self.spark, f"{self.folder}/whole") if files.read_whole(self.spark, f"{self.folder}/whole/{n}") is not None}
        turn = 0
        while turn + 1 in whole:
            turn += 1
        return turn

    def write(self, turn: int, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of a turn that is not whole yet, and read it again."""
        path = self.path(turn, name)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def mark(self, turn: int) -> None:
        """From here on the turn is whole."""
        path = f"{self.folder}/whole/turn-{turn}"
        if not files.write_once(self.spark, path, str(turn)) and files.read_whole(self.spark, path) is None:
            files.remove(self.spark, path)  # a marker that was not written to its end
            files.write_once(self.spark, path, str(turn))

    def path(self, turn: int, name: str) -> str:
        return f"{self.folder}/turn={turn}/{name}"

    def read(self, turn: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(turn, name))

    def upto(self, turn: int, name: str, none: DataFrame) -> DataFrame:
        """A table of the turns 1 to `turn` together, with the columns of `none`, which is what there is without turns."""
        return reduce(DataFrame.unionByName, [self.read(t, name).select(none.columns) for t in range(1, turn + 1)], none)
