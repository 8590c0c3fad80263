"""A store: a folder of Parquet tables with the operations of the name library (section 2.13 of the survey)."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession

from .config import Settings
from .operators import clusters as K
from .operators import extract as E
from .operators import lookup as L
from .operators import percolate as P
from .schema import FACTS
from .sources import readers, writers


KNOWN = 100_000


class Store:
    """Loads add facts; build() makes the indexes anew; then lookup, extract and percolate answer batches or single strings."""

    def __init__(self, spark: SparkSession, uri: str | None = None, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.uri = (uri or self.settings.uri).rstrip("/")
        self._patterns: DataFrame | None = None
        self._kept: dict[str, DataFrame] = {}
        self._known: OrderedDict[tuple, Row | None] = OrderedDict()

    # lifecycle (K8): writes are done when a call returns, so there is nothing to flush but what is kept

    def flush(self) -> None:
        """Forgets what is kept of the tables, so that the next query reads what is there now."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        self._known.clear()

    def close(self) -> None:
        self.flush()
        self._patterns = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def warm(self) -> Store:
        """Keeps the lookup's tables in the executors (C3, C4), for those who ask many single questions."""
        for name in ("clusters", "phonetic", "postings", "patterns"):
            self._kept[name] = self._table(name).persist()
            self._kept[name].count()
        return self

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def _table(self, name: str) -> DataFrame:
        return self._kept[name] if name in self._kept else self.spark.read.parquet(self.path(name))

    # loading

    def put(self, entities: DataFrame | Iterable[Mapping]) -> None:
        rows = entities if isinstance(entities, DataFrame) else readers.from_rows(self.spark, entities)
        self.flush()
        writers.append_facts(K.facts(K.unpack(rows, self.settings)), self.path("facts"))

    def load_entities(self, uri: str, sync: bool = False) -> None:
        self._load(readers.entities(self.spark, uri), sync)

    def load_names(self, uri: str, schema: str | None = None) -> None:
        self._load(readers.names(self.spark, uri, schema), False)

    def load_dataset(self, uri: str, sync: bool = False) -> None:
        self._load(readers.dataset(self.spark, uri), sync)

    def load_catalog(self, uri: str, sync: bool = False) -> None:
        self._load(readers.catalog(self.spark, uri), sync)

    def _load(self, rows: DataFrame, sync: bool) -> None:
        self.put(rows)
        if sync:
            self.build()

    # clusters

    def facts(self) -> DataFrame:
        """Nothing was loaded yet only where the table isn't there; what else is wrong with it is an error."""
        if not writers.exists(self.spark, self.path("facts")):
            return self.spark.createDataFrame([], FACTS)
        return self._table("facts").dropDuplicates()

    def clusters(self, key: str | None = None) -> DataFrame:
        return K.scan(K.clusters(self.facts()), key)

    def get_doc(self, key: str) -> Row | None:
        return self.clusters(key).first()

    def count(self) -> int:
        return K.count(self.facts()).first()[0]

    # index

    def build(self) -> None:
        """Rebuilds all indexes from the facts: clusters once, then what derives from the written clusters."""
        self.flush()
        writers.table(K.clusters(self.facts()), self.path("clusters"), "key")
        c = self._table("clusters")
        writers.table(K.postings(c), self.path("postings"), "token")
        writers.table(K.phonetic_postings(c), self.path("phonetic"), "code")
        writers.table(E.patterns(c, self.settings), self.path("patterns"), "first_bigram")

    # queries

    def lookup_all(self, queries: DataFrame, threshold: float | None = None, schemata: list[str] | None = None) -> DataFrame:
        return L.lookup(queries, self._table("clusters"), self._table("phonetic"), threshold=threshold, schemata=schemata, settings=self.settings)

    def lookup(self, q: str, threshold: float | None = None, schemata: list[str] | None = None) -> Row | None:
        """The answer to one string; the last KNOWN answers are kept until something is loaded or built."""
        asked = (q, threshold, tuple(schemata) if schemata else None)
        if asked not in self._known:
            self._known[asked] = self.lookup_all(self.spark.createDataFrame([(q,)], "query string"), threshold, schemata).first()
            if len(self._known) > KNOWN:
                self._known.popitem(last=False)
        self._known.move_to_end(asked)
        return self._known[asked]

    # patterns in a file

    def save_patterns(self, path: str) -> None:
        writers.patterns_tsv(self._table("patterns"), path)

    def load_patterns(self, path: str) -> bool:
        """Extraction uses the patterns of this file from now on; False, and nothing changes, if there is none."""
        if not writers.exists(self.spark, path):
            return False
        self._patterns = readers.patterns_tsv(self.spark, path)
        return True

    def _text(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "doc_id long, text string")

    def extract_all(self, docs: DataFrame) -> DataFrame:
        return E.extract(docs, self._table("patterns") if self._patterns is None else self._patterns)

    def extract(self, text: str) -> list[Row]:
        return self.extract_all(self._text(text)).drop("doc_id").orderBy("start", "end").collect()

    def percolate_all(self, docs: DataFrame, slop: int = 0) -> DataFrame:
        return P.percolate(docs, self._table("clusters"), self._table("postings"), slop, self.settings)

    def percolate(self, text: str, slop: int = 0) -> list[Row]:
        return self.percolate_all(self._text(text), slop).drop("doc_id").orderBy("start", "end").collect()


@functools.lru_cache(maxsize=8)
def _store(spark: SparkSession, uri: str, settings: Settings) -> Store:
    return Store(spark, uri, settings)


def get_store(spark: SparkSession, uri: str | None = None) -> Store:
    """The store of this URI and of the environment's settings, the same one each time."""
    settings = Settings.from_env()
    return _store(spark, uri or settings.uri, settings)


def lookup(spark: SparkSession, q: str, threshold: float | None = None, uri: str | None = None, schemata: list[str] | None = None) -> Row | None:
    return get_store(spark, uri).lookup(q, threshold, schemata)
