"""The nine domain tables: schemas, readers and the report sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}


def _schema(text: str) -> T.StructType:
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind], True))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "terms": _schema("Year_Semester int, College string, Term_Start_Date date"),
    "students": _schema(
        "Student_Id bigint, Gender string, Ethnicity string, Language string, Foster_Youth int"
    ),
    "cohorts": _schema("Student_Id bigint, Cohort int, Cohort_College string"),
    "awards": _schema(
        "Student_Id bigint, College string, Major_Code string, Award_Type string, "
        "Award_Date date, Catalog_Year int"
    ),
    "programs": _schema(
        "College string, Major_Code string, Major string, Award_Type string, "
        "Catalog_Year int, Final_Term int"
    ),
    "enrollments": _schema(
        "Student_Id bigint, College string, Year_Semester int, Section_Number bigint, Grade string"
    ),
    "sections2": _schema(
        "Section_Number bigint, College string, Year_Semester int, Discipline string, "
        "Course string, Noncredit int, Enrollment int, FTES double, Standard_Hours double, "
        "Teaching_Load double"
    ),
    "student_profiles": _schema(
        "Student_Id bigint, College string, Year_Semester int, Units_Attempted bigint, "
        "Units_Completed bigint, SGEC_Units bigint, Online_Units bigint, Online_Only int, "
        "SGEC_Only int, PSA_Only int, Concurrent_Student int, Major_Code string, "
        "Term_Age bigint, Education_Goal string, Military int, Residency_Status string, "
        "DSPS int, EOPS int, CalWorks int, BOGG int, Total_Award double, "
        "District_Cumulative_GPA double"
    ),
    "ethnicity_details": _schema("Student_Id bigint, Any_Hispanic int, Any_Asian int"),
}

# Tables that reports read by term: stored in term order, so a bound on the term skips files.
TERM_ORDERED = {"enrollments": "Student_Id", "student_profiles": "Student_Id", "sections2": "Section_Number"}


# The same enrollments stored by section beside those by student, see `Domain.save_tables`.
BY_SECTION = "enrollments_by_section"
SECTION_KEYS = ["Section_Number", "College", "Year_Semester"]


def typed(df: DataFrame, name: str) -> DataFrame:
    """Columns cast to the declared schema; others, such as further indicators, stay."""
    kinds = {f.name: f.dataType for f in SCHEMAS[name].fields}
    # A column that has its type stays as it is; a cast would hide the buckets it is stored by.
    return df.select([
        df[c].cast(kinds[c]).alias(c) if c in kinds and df.schema[c].dataType != kinds[c] else df[c]
        for c in df.columns])


Loader = Callable[[], DataFrame]


class Domain:
    """Named access to the domain tables; each one is resolved on first use.

    `shared` names tables that are computed and that others are computed from (see `held`).
    """

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Loader], shared: Sequence[str] = ()):
        self.spark = spark
        self._shared = tuple(shared)
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> Domain:
        return cls(spark, {name: (lambda frame=frame: frame) for name, frame in frames.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Domain:
        """One parquet dataset per table, read with its declared schema."""
        def loader(name: str) -> Loader:
            return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

        return cls(spark, {name: loader(name) for name in SCHEMAS})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, id_bounds: tuple[int, int], partitions: int,
                  section_bounds: tuple[int, int] | None = None, **options: str) -> Domain:
        """Read from a SQL server; student-keyed tables are read in parallel id ranges.

        Sections are read in ranges of `section_bounds` on their number. The bounds only
        place the cuts: rows outside them still arrive, in the first and last partition.
        """

        def loader(name: str) -> Loader:
            def load() -> DataFrame:
                reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
                keyed = [(key, bounds) for key, bounds in
                         (("Student_Id", id_bounds), ("Section_Number", section_bounds))
                         if key in SCHEMAS[name].names and bounds is not None]
                if keyed:
                    key, (low, high) = keyed[0]
                    reader = reader.options(partitionColumn=key, lowerBound=str(low),
                                            upperBound=str(high), numPartitions=str(partitions))
                return typed(reader.load(), name)

            return load

        return cls(spark, {name: loader(name) for name in SCHEMAS})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        return self[name]

    @contextmanager
    def held(self) -> Iterator[None]:
        """Shared tables are computed once while this lasts, and kept by the executors, in memory or on disk.

        For a step that reads several tables which all come from the same join.
        """
        frames = [f for f in map(self.__getitem__, self._shared) if not f.is_cached and f.storageLevel == StorageLevel.NONE]
        for frame in frames:
            frame.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield
        finally:
            for frame in frames:
                frame.unpersist()

    def save(self, folder: str, **options: str) -> None:
        """Write every table as parquet, so that later sessions scan instead of derive.

        A stored table replaces its plan here, so tables derived from it read the files.
        """
        for name in self._loaders:
            path = f"{folder}/{name}"
            rows = self[name]
            if name in TERM_ORDERED:
                rows = rows.repartitionByRange("Year_Semester", TERM_ORDERED[name])
                rows = rows.sortWithinPartitions("Year_Semester", TERM_ORDERED[name])
            rows.write.mode("overwrite").options(**options).parquet(path)
            self._frames[name] = self.spark.read.parquet(path)
        self._shared = ()

    def save_tables(self, database: str, buckets: int) -> None:
        """Write catalog tables, bucketed by what they are joined on.

        Tables with a student are bucketed by student, so per-student grouping, windows and joins
        start without a shuffle. Sections, and a second copy of the enrollments, are bucketed by
        section: the largest join then reads both sides where they lie. Worth it if no single
        student or section dominates: a bucket is one task and is never split.
        """
        def save(rows: DataFrame, name: str, keys: list[str]) -> None:
            # The hash that deals rows to tasks is that of the buckets, so a bucket is one file.
            rows = rows.repartition(buckets, *keys)
            writer = rows.write.mode("overwrite").format("parquet")
            writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"{database}.{name}")

        for name, schema in SCHEMAS.items():
            if "Student_Id" in schema.names:
                save(self[name], name, ["Student_Id"])
            elif name == "sections2":
                save(self[name], name, SECTION_KEYS)
            else:
                self[name].write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")
        save(self.enrollments, BY_SECTION, SECTION_KEYS)

    @property
    def by_section(self) -> DataFrame | None:
        """Enrollments stored with their sections, if there is such a copy."""
        return self[BY_SECTION] if BY_SECTION in self._loaders else None

    @classmethod
    def from_tables(cls, spark: SparkSession, database: str) -> Domain:
        """Tables of `save_tables`, or others of these names; the copy by section is used if it is there."""
        def loader(name: str, like: str) -> Loader:
            return lambda: typed(spark.table(f"{database}.{name}"), like)

        loaders = {name: loader(name, name) for name in SCHEMAS}
        if spark.catalog.tableExists(f"{database}.{BY_SECTION}"):
            loaders[BY_SECTION] = loader(BY_SECTION, "enrollments")
        return cls(spark, loaders)
