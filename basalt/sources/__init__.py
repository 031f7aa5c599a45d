"""Sources and sinks: table folders, named links to other folders or databases, schema paths, record files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _make_type_verifier

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAX_LEVELS, MAX_PATH = 8, 511


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small file over all cores, for long expressions: as a file is read it would be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def register(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables of a folder."""
    for name in names or TABLES:
        read_table(spark, root, name).createOrReplaceTempView(name)


SCHEMA_MODES = ("none", "fixed", "context_aware", "hierarchical", "mirror")


@dataclass
class Link:
    """Where a link leads, and how a schema path on this side becomes one on the other.

    none drops it; fixed always takes ``remote``; context_aware takes ``remote``
    with CURRENT, HOME or USER replaced by those of the session; hierarchical
    puts what lies below ``local`` below ``remote``; mirror takes the path as it is.
    """

    root: str | None = None
    jdbc: dict[str, str] = field(default_factory=dict)
    mode: str = "none"
    local: str = ""
    remote: str = ""

    def schema(self, path: str, context: dict[str, str]) -> str:
        if self.mode == "none":
            return ""
        if self.mode == "fixed":
            return self.remote
        if self.mode == "mirror":
            return path
        if self.mode == "context_aware":
            return ".".join(context[p.upper()] if p.upper() in ("CURRENT", "HOME", "USER") else p for p in self.remote.split(".") if p)
        if self.local and path != self.local and not path.startswith(self.local + "."):
            raise ValueError(f"{path!r} is not below {self.local!r}")
        rest = path[len(self.local) :].strip(".")
        return ".".join(p for p in (self.remote, rest) if p)


class Links:
    """Named remote sources (``table AT link``): a folder of parquet tables, a subfolder for each schema, or a JDBC database."""

    def __init__(self, **context: str):
        self._links: dict[str, Link] = {}
        self.context = {k.upper(): v for k, v in context.items()}

    def add(self, name: str, root: str | None = None, mode: str = "none", local: str = "", remote: str = "", **jdbc: str) -> None:
        if (root is None) == (not jdbc):
            raise ValueError("a link is a folder or a JDBC source")
        if mode not in SCHEMA_MODES:
            raise ValueError(f"no schema mode {mode!r}")
        self._links[name.lower()] = Link(root, jdbc, mode, local, remote)

    def alter(self, name: str, mode: str) -> None:
        if mode not in SCHEMA_MODES:
            raise ValueError(f"no schema mode {mode!r}")
        self._links[name.lower()].mode = mode

    def drop(self, name: str) -> None:
        del self._links[name.lower()]

    def remote_name(self, table: str, link: str) -> str:
        """The other side's name of a table that this side calls ``schema.path.table``."""
        *path, name = table.split(".")
        schema = self._links[link.lower()].schema(".".join(path), self.context)
        return f"{schema}.{name}" if schema else name

    def read(self, spark: SparkSession, table: str, link: str) -> DataFrame:
        to, name = self._links[link.lower()], self.remote_name(table, link)
        if to.root:
            return read_table(spark, to.root, name.replace(".", "/"))
        return spark.read.format("jdbc").options(**to.jdbc, dbtable=name).load()

    def execute(self, spark: SparkSession, sql: str, link: str) -> DataFrame:
        """A statement run on the other side: JDBC ``query``, or SQL over views of the folder."""
        to = self._links[link.lower()]
        if to.root:
            register(spark, to.root)
            return spark.sql(sql)
        return spark.read.format("jdbc").options(**to.jdbc, query=sql).load()


class Schemas:
    """Hierarchical schema paths of up to eight levels over the flat names of a session catalog."""

    def __init__(self, search: list[str] | None = None):
        self.known: dict[str, set[str]] = {}
        self.search = search or []

    @staticmethod
    def parts(path: str) -> list[str]:
        names = path.split(".")
        if len(path) > MAX_PATH or not 1 <= len(names) <= MAX_LEVELS or not all(names):
            raise ValueError(f"not a schema path: {path!r}")
        return [n.upper() if not n.startswith('"') else n.strip('"') for n in names]

    def create(self, path: str) -> None:
        names = self.parts(path)
        for i in range(1, len(names)):
            if ".".join(names[:i]) not in self.known:
                raise ValueError(f"no schema {'.'.join(names[:i])}")
        self.known.setdefault(".".join(names), set())

    @staticmethod
    def view_name(path: str, table: str) -> str:
        return "__".join([*Schemas.parts(path), table.upper()]).lower()

    def add(self, path: str, table: str, df: DataFrame) -> None:
        self.known[".".join(self.parts(path))].add(table.upper())
        df.createOrReplaceTempView(self.view_name(path, table))

    def resolve(self, name: str) -> str:
        """The view of a qualified name, or of the first schema of the search path that has the table."""
        *schema, table = name.split(".")
        for path in [".".join(schema)] if schema else self.search:
            if table.upper() in self.known.get(".".join(self.parts(path)), ()):
                return self.view_name(path, table)
        raise KeyError(name)


def record_file(spark: SparkSession, path: str, fields: list[tuple[str, int, str]]) -> DataFrame:
    """An external table of fixed-length text records: (name, width, type) in order; blanks are trimmed."""
    rows, at, cols = spark.read.text(path), 1, []
    for name, width, kind in fields:
        cols.append(F.trim(F.substring("value", at, width)).cast(kind).alias(name))
        at += width
    return rows.select(*cols)


def virtual(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A virtual (in-memory) table."""
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}.parquet")


class Batch:
    """Batch ingest: rows are gathered, checked one by one against a table's types, and added together.

    ``execute`` gives the new table and the status of each row: 1, or the reason
    why it was refused.  Without ``multi_error`` the rows from the first refused one on are left out.
    """

    def __init__(self, table: DataFrame, multi_error: bool = False, most: int = 100_000):
        self.table, self.multi_error, self.most, self.rows = table, multi_error, most, []

    def add(self, *row: object) -> None:
        if len(self.rows) >= self.most:
            raise ValueError(f"more than {self.most} rows in a batch")
        self.rows.append(row)

    def execute(self) -> tuple[DataFrame, list[int | str]]:
        verify, fine, status = _make_type_verifier(self.table.schema), [], []
        for row in self.rows:
            try:
                verify(row)
            except (PySparkTypeError, PySparkValueError) as error:
                status.append(str(error))
                if not self.multi_error:
                    break
            else:
                fine.append(row)
                status.append(1)
        self.rows = []
        return self.table.unionByName(self.table.sparkSession.createDataFrame(fine, self.table.schema)), status
