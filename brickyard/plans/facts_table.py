"""Facts by content: a file that was measured once, in whatever revision or place, isn't read again.

A row of facts depends on a file's text and on whether it is a test, so the text's git blob id and that flag are its key.
The table is Parquet in a folder that runs share; a run parses only what the table doesn't have, and appends it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions.facts import extract
from brickyard.session import kept

KEY = ["oid", "is_test"]
_PLACE = ("brick", "type", "dir", "file", "is_test", "ord")


def _by_content(files: DataFrame) -> DataFrame:
    """One file of each content and kind, with its facts; the places of the others are left out."""
    one = files.select(*KEY, "source").dropDuplicates(KEY)
    null = F.lit(None).cast("string")
    rows = extract(one.select(null.alias("brick"), null.alias("type"), null.alias("dir"), F.col("oid").alias("file"), "is_test", F.lit(0).alias("ord"), "source"))
    return rows.select(F.col("file").alias("oid"), "is_test", *[c for c in rows.columns if c not in _PLACE])


class FactsTable:
    """Facts by content, kept for this run and, if there is a folder, for later ones."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        #: How many files were parsed so far, not taken from the table.
        self.parsed = 0
        self._known: DataFrame | None = None
        if folder and self._exists():
            # Runs at the same time may append the same facts twice.
            self._known = spark.read.parquet(folder).dropDuplicates(KEY)

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def of(self, files: DataFrame) -> DataFrame:
        """files(brick, type, dir, file, is_test, ord, oid, source) -> one row of facts a file, kept."""
        missing = files if self._known is None else files.join(self._known.select(*KEY), KEY, "left_anti")
        new = kept(_by_content(missing))
        count = new.count()
        self.parsed += count
        if self.folder and count:
            new.write.mode("append").parquet(self.folder)
        self._known = new if self._known is None else self._known.unionByName(new)
        facts = files.drop("source").join(self._known, KEY)
        return kept(facts.select(*_PLACE, *[c for c in facts.columns if c not in (*_PLACE, "oid")]))
