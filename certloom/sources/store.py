"""The stored tables: reads, upserts, deletions and the joins between them.

Upserts append; the latest row of an entity counts. Deletions rewrite what stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.config import SETTINGS, Settings
from certloom.operators.lineage import delete
from certloom.schema import TABLES

#: Folders of a table from which on a commit writes it as one.
FOLDERS = 64


class Store:
    """Tables with the declared schemas below one folder, changed by commits.

    A commit writes the new rows of all its tables to folders of their own and then one
    small file that names the folders of every table in the next version. Readers see a
    version whole: a failure between the writes leaves the last version as it was, and what
    was written is deleted. Files of versions are created exclusively, so that of two writers
    of one version the second fails and may try again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self) -> None:
        """The first version, with all tables empty, if there is none."""
        if not self._versions():
            self._publish(1, {name: [] for name in TABLES}, {})

    def version(self) -> int:
        """The number of the last complete version, 0 if there is none."""
        return self._last()[0]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table in the last or in an earlier version that is kept; columns added later
        are null in old rows."""
        _, manifest = self._last() if version is None else (version, self._load(version))
        if manifest is None:
            raise LookupError(f"the store has no version {version}")
        folders = manifest["tables"].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def latest(self, table: str) -> DataFrame:
        return latest(self.read(table), "entity_id", "created_at")

    def commit(self, added: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, source: str | None = None, number: int = 0) -> bool:
        """Append and replace rows of several tables, all or none.

        ``source`` and ``number`` name a step of a numbered run, as the batches of a stream: a
        step that is not after the last committed one of its source is left out, and False
        returned.
        """
        version, manifest = self._last()
        steps = dict(manifest["steps"]) if manifest else {}
        if source is not None:
            if number <= steps.get(source, -1):
                return False
            steps[source] = number
        tables = {name: list(folders) for name, folders in manifest["tables"].items()} if manifest else {}
        new: list[str] = []
        try:
            for name, rows in (replaced or {}).items():
                tables[name] = [self._write(name, rows, new)]
            for name, rows in (added or {}).items():
                folder = self._write(name, rows, new)
                tables[name] = [*tables.get(name, []), folder]
                if len(tables[name]) > FOLDERS:
                    tables[name] = [self._write(name, self.spark.read.schema(TABLES[name]).parquet(*tables[name]), new)]
            self._publish(version + 1, tables, steps)
        except Exception:
            for folder in new:
                delete(self.spark, folder)
            raise
        return True

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit(added={table: rows})

    def replace(self, table: str, rows: DataFrame) -> None:
        self.commit(replaced={table: rows})

    def delete(self, table: str, ids: DataFrame, key: str = "entity_id") -> None:
        self.replace(table, without(self.read(table), ids, key))

    def purge_orphans(self, images: DataFrame) -> dict[str, int]:
        """Delete the vectors whose image is gone. ``images``: entity_id. Returns how many
        entities went (deleted) and how many are left (remaining)."""
        vectors = self.read("vectors")
        gone = orphans(vectors, images).select("entity_id").distinct()
        before = vectors.select("entity_id").distinct().count()
        self.delete("vectors", gone)
        remaining = self.read("vectors").select("entity_id").distinct().count()
        return {"deleted": before - remaining, "remaining": remaining}

    def append_run(self, header: DataFrame, issues: DataFrame) -> int:
        """Append the header of a run under the next number and its issues with it."""
        last = self.read("cross_validate_runs").agg(F.max("run_id").alias("n")).first()["n"]
        run_id = (last or 0) + 1
        self.commit(added={"cross_validate_runs": with_run(header, run_id), "fraud_issues": with_run(issues.withColumn("issue_type", F.lit("cross")), run_id)})
        return run_id

    def replace_single_issues(self, issues: DataFrame, ids: DataFrame) -> None:
        self.replace("fraud_issues", single_issues_replaced(self.read("fraud_issues"), issues, ids))

    def counts(self) -> DataFrame:
        """(table, n) of all tables."""
        out = None
        for name in TABLES:
            row = self.read(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
            out = row if out is None else out.unionByName(row)
        return out

    def clean(self, keep: int = 2) -> None:
        """Delete all but the last few versions, and the folders that only those named or that
        a writer which failed left behind. Not for use while others write."""
        versions = [v for v in self._versions() if self._load(v) is not None]
        kept = versions[-keep:]
        used = {folder.rsplit("/", 1)[1] for v in kept for folders in self._load(v)["tables"].values() for folder in folders}
        for v in self._versions():
            if v not in kept:
                delete(self.spark, self._file(v))
        for name in TABLES:
            for folder in self._names(f"{self.folder}/{name}"):
                if folder not in used:
                    delete(self.spark, f"{self.folder}/{name}/{folder}")

    def _write(self, table: str, rows: DataFrame, new: list[str]) -> str:
        new.append(f"{self.folder}/{table}/{uuid.uuid4().hex}")
        conform(rows, TABLES[table]).write.parquet(new[-1])
        return new[-1]

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path(folder), self._fs()
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(name) for name in self._names(f"{self.folder}/versions") if name.isdigit())

    def _publish(self, version: int, tables: dict[str, list[str]], steps: dict[str, int]) -> None:
        out = self._fs().create(self.spark._jvm.org.apache.hadoop.fs.Path(self._file(version)), False)
        out.write(bytearray(json.dumps({"tables": tables, "steps": steps}).encode()))
        out.close()

    def _load(self, version: int) -> dict | None:
        """A version's tables; None if its file is absent or was not written to its end."""
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path(self._file(version)), self._fs()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _last(self) -> tuple[int, dict | None]:
        """The number after which the next version comes, and the last complete version."""
        versions = self._versions()
        for v in reversed(versions):
            manifest = self._load(v)
            if manifest is not None:
                return versions[-1], manifest
        return (versions[-1] if versions else 0), None


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns, cast; those that are absent are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def without(table: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, time: str, *more: Column) -> DataFrame:
    """The newest row of each key; further columns decide ties."""
    newest = Window.partitionBy(key).orderBy(F.desc(time), *more)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def insert_missing(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key the table does not have."""
    return rows.join(table.select(key), key, "left_anti")


def with_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors, each asserted to have ``dim`` components."""
    wrong = F.concat(F.lit(f"expected {dim} components, got "), F.size("vector").cast("string"))
    return vectors.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(wrong).cast("array<float>")))


def fields_of(ids: DataFrame, images: DataFrame, faces: DataFrame, templates: DataFrame) -> DataFrame:
    """The vectors of three stores by id; a store without one gives an empty array."""
    empty = F.array().cast("array<double>")
    out = ids.select("entity_id")
    for name, store in (("image_vector", images), ("face_vector", faces), ("template_vector", templates)):
        out = out.join(store.select("entity_id", F.col("vector").cast("array<double>").alias(name)), "entity_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def ocr_list(certificates: DataFrame, ocr: DataFrame, ps: DataFrame) -> DataFrame:
    """Certificates with their fields and assessment, by id; status done or pending."""
    joined = certificates.join(ocr, "entity_id", "left").join(ps, "entity_id", "left")
    return joined.withColumn("status", F.when(F.col("ocr_done"), "done").otherwise("pending")).orderBy("entity_id")


def filter_list(rows: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of a status whose file name or school holds the text, whatever its case."""
    if status:
        rows = rows.where(F.col("status") == status)
    if text:
        needle = text.lower()
        rows = rows.where(F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(needle)) | F.contains(F.lower(F.coalesce("school", F.lit(""))), F.lit(needle)))
    return rows


def page(rows: DataFrame, order: str, number: int, size: int = 50) -> DataFrame:
    """A page, from 1, newest first."""
    return rows.orderBy(F.desc(order)).offset((number - 1) * size).limit(size)


def id_universe(table: DataFrame, scan: DataFrame) -> DataFrame:
    """(entity_id, filename) of the table, and of scanned files that it lacks."""
    known = table.select("entity_id", "filename")
    return known.unionByName(scan.select("entity_id", "filename").join(known, "entity_id", "left_anti"))


def orphans(vectors: DataFrame, images: DataFrame) -> DataFrame:
    """Vectors whose image is gone."""
    return vectors.join(images.select("entity_id"), "entity_id", "left_anti")


def truncated(rows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Long texts cut to what their columns hold."""
    limits = {"raw_text": s.raw_text_limit, "raw_response": s.raw_response_limit}
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in limits.items() if c in rows.columns})


def with_run(rows: DataFrame, run_id: int) -> DataFrame:
    return rows.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("created_at", F.current_timestamp())


def single_issues_replaced(stored: DataFrame, issues: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored issues without those of type single of the named records, and the new ones.

    ``issues``: entity_id, rule, detail, severity. Issues of other types and records stay.
    """
    of_them = (stored["issue_type"] == "single") & (stored["entity_id"] == ids["entity_id"])
    new = issues.select("entity_id", F.col("rule").alias("rule_name"), "detail", "severity", F.array("entity_id").alias("related_ids"), F.lit("single").alias("issue_type"))
    return stored.join(ids, of_them, "left_anti").unionByName(new, allowMissingColumns=True)


def flat_forensics(nested: DataFrame) -> DataFrame:
    """The forensic table's columns from nested measurements: ela, photo_edge, seal,
    risk_level, risk_flags."""
    return nested.select(
        "entity_id",
        F.col("ela.ela_std").alias("ela_std"),
        F.coalesce("ela.suspicious", F.lit(False)).alias("ela_suspicious"),
        F.coalesce("photo_edge.suspicious", F.lit(False)).alias("photo_edge_suspicious"),
        F.coalesce("seal.has_red_seal", F.lit(False)).alias("has_red_seal"),
        F.coalesce("seal.printed", F.lit(False)).alias("seal_printed"),
        "risk_level",
        F.coalesce("risk_flags", F.array().cast("array<string>")).alias("risk_flags"),
    )


def encoded_assessments(rows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Assessments with their lists as JSON text and the raw response cut to its column."""
    lists = ("key_evidence", "no_tampering_evidence", "suspect_regions")
    return truncated(rows.withColumns({c: F.to_json(F.coalesce(F.col(c), F.from_json(F.lit("[]"), rows.schema[c].dataType))) for c in lists if c in rows.columns}), s)


def search_columns(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever its case."""
    needle = F.lit(text.lower())
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
    return rows.where(found)


def by_severity(issues: DataFrame, first: int | None = None) -> DataFrame:
    """Issues from 高 over 中 to 低, by rule and detail within; the first few if asked."""
    place = F.when(F.col("severity") == "高", 0).when(F.col("severity") == "中", 1).otherwise(2)
    ordered = issues.orderBy(place, "rule", "detail")
    return ordered if first is None else ordered.limit(first)


def public_columns(rows: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])
