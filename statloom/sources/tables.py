"""Access to the base tables of a folder and to the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.sources.views import BASES, SPARK_VIEWS, VIEWS

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Rows of a text table in one task, at most, where a query deals them out itself.
TASK_ROWS = 20000


class Tables:
    """``tables.pages`` reads a parquet table, ``tables.view('obs')`` a derived view. With ``spread``, as in all registered
    queries, tables that texts are made of are dealt over all cores."""

    def __init__(self, spark: SparkSession, folder: str, spread: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.spread = spread
        self._cache: dict[str, DataFrame] = {}
        self._sizes: dict[str, int] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def set(self, name: str, rows: DataFrame) -> None:
        """Use these rows, also of a stream, as the table."""
        self._cache[name] = rows
        self._sizes[name] = 0  # not counted: it may not be a file

    def wide(self, name: str) -> DataFrame:
        """A table that texts are read from or rendered from. A parquet file is cut into tasks by its row groups, and a group
        of narrow rows holds up to a million pages, so the scan alone would leave most cores idle: with ``spread`` the
        rows are dealt out before texts are made, to tasks of at most ``TASK_ROWS`` rows, so that the longest task doesn't grow
        with the table; its rows are counted in the footers of its files. ``statloom.text.tasks`` in the session asks for a
        number of tasks.
        Rows of a stream are dealt out in each batch."""
        rows = getattr(self, name)
        tasks = self.spark.conf.get("statloom.text.tasks", None)
        if tasks is None and self.spread:
            if name not in self._sizes:
                self._sizes[name] = rows.count()
            least = max(3 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            tasks = max(least, -(-self._sizes[name] // TASK_ROWS))
        return rows if tasks is None else rows.repartition(int(tasks))

    def view(self, name: str) -> DataFrame:
        key = f"view:{name}"
        if key not in self._cache:
            inputs = {}
            for base in BASES[name]:
                heavy = base in ("pages", "documents", "part") or (base, name) == ("orders", "api_json")
                inputs[base] = self.view(base) if base in VIEWS else (self.wide(base) if heavy else getattr(self, base))
            sql = SPARK_VIEWS.get(name, VIEWS[name]).replace("{", "{{").replace("}", "}}")
            for base in BASES[name]:
                sql = sql.replace(f"FROM {base}\n", f"FROM {{{base}}}\n")
            self._cache[key] = self.spark.sql(sql, **inputs)
        return self._cache[key]
