"""Tables in a folder that Spark reads, partitioned by space: versions and what was added since, each visible once it is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.schema import GONE, KEYS, TABLES
from quillmesh.streaming import incremental

#: Byte limits of a page and of a PDF, and its first characters.
PAGE_BYTES, PDF_BYTES, PDF_MAGIC = 10 * 1024 * 1024, 25 * 1024 * 1024, "%PDF-"
#: Additions to a version before it is written anew as one.
ADDITIONS = 16


class Store:
    """A folder of versioned tables. A version is a whole table; additions to it are folders of their own, so that writing a row costs a row.

    Readers see the last version whose write ended with its complete additions; an interrupted write leaves no trace in
    results. In tables with keys the last addition's rows stand for those before with their keys.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _parts(self, table: str) -> dict[int, list[int]]:
        """Complete versions with the numbers of their complete additions."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n[1:].split("-") for n in names if n.startswith("v") and n[1:].replace("-", "").isdigit() and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1])]
        out: dict[int, list[int]] = {int(x[0]): [] for x in done if len(x) == 1}
        for v, *rest in done:
            if rest and int(v) in out:
                out[int(v)].append(int(rest[0]))
        return {v: sorted(out[v]) for v in sorted(out)}

    def versions(self, table: str) -> list[int]:
        return list(self._parts(table))

    def state(self, table: str) -> tuple[int, int]:
        """The last version and its last addition: changes with each write."""
        parts = self._parts(table)
        last = max(parts, default=0)
        return last, max(parts.get(last, []), default=0)

    def _read(self, table: str, folder: str) -> DataFrame:
        names = [f.split()[0] for f in TABLES[table].split(", ")]
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/{folder}").select(*names)

    def read(self, table: str) -> DataFrame:
        parts = self._parts(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        last = max(parts)
        out = self._read(table, f"v{last}")
        if not parts[last]:
            return self._seen(table, out)
        keys = KEYS.get(table)
        added = None
        for k in parts[last]:
            one = self._read(table, f"v{last}-{k}").withColumn("_seq", F.lit(k))
            added = one if added is None else added.unionByName(one)
        return self._seen(table, incremental.latest(out, added, keys) if keys else out.unionByName(added.drop("_seq")))

    @staticmethod
    def _seen(table: str, rows: DataFrame) -> DataFrame:
        """Without the rows that only say that something is gone."""
        return rows.filter(f"NOT ({GONE[table]})") if table in GONE else rows

    def _claim(self, table: str, name: Callable[[int], str], number: int) -> str:
        """The first free folder name from this number on, claimed by a file that only one writer can create."""
        while True:
            fs, p = self._fs(f"{self.root}/{table}/_claims/{name(number)}")
            try:
                if fs.createNewFile(p):
                    return name(number)
            except Exception:  # noqa: BLE001 - stores tell of an existing file in their own ways
                if not fs.exists(p):
                    raise
            number += 1

    def _write(self, table: str, df: DataFrame, folder: str) -> None:
        names = [f.split()[0] for f in TABLES[table].split(", ")]
        df.select(*names).write.mode("overwrite").partitionBy("space_id").parquet(f"{self.root}/{table}/{folder}")

    def replace(self, table: str, df: DataFrame) -> None:
        """Commits df as the table; the version before it stays for running readers."""
        found = self._parts(table)
        self._write(table, df, self._claim(table, lambda n: f"v{n}", max(found, default=0) + 1))
        for old in list(found)[:-1]:
            for folder in (f"v{old}", *(f"v{old}-{k}" for k in found[old])):
                fs, p = self._fs(f"{self.root}/{table}/{folder}")
                fs.delete(p, True)

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows; in tables with keys they stand for those with their keys. df may come from the table itself."""
        parts = self._parts(table)
        if not parts:
            return self.replace(table, df)
        last = max(parts)
        self._write(table, df, self._claim(table, lambda n: f"v{last}-{n}", max(parts[last], default=0) + 1))
        if len(parts[last]) + 1 >= ADDITIONS:
            self.replace(table, self.read(table))

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """Rows of df take the place of those with the table's keys."""
        if KEYS.get(table) != keys:
            raise ValueError(f"{table} is not kept by {keys}")
        self.append(table, df)

    def archive(self, ids: DataFrame) -> None:
        """Marks objects (space_id, id) as archived; nothing is erased."""
        gone = self.read("objects").join(ids.select("space_id", "id").distinct(), ["space_id", "id"], "left_semi")
        self.append("objects", gone.withColumn("archived", F.lit(True)))


def backup(df: DataFrame, path: str) -> None:
    """JSON lines at a path where nothing may be yet."""
    df.write.mode("errorifexists").json(path)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, pdf, text, verdict) of files: PDFs told by their first bytes, pages cut at their limit, too large PDFs refused."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    pdf = F.substring("content", 1, 1024).cast("string").contains(PDF_MAGIC)
    text = F.when(~pdf, F.substring("content", 1, PAGE_BYTES).cast("string"))
    return raw.select("path", "content", pdf.alias("pdf"), text.alias("text"), F.when(pdf & (F.col("length") > PDF_BYTES), "pdf_too_large").when(pdf, "pdf_needs_a_reader").alias("verdict"))
